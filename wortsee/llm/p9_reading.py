"""Problem 9: reading level of each document.

Words and signs of a text are found in Arrow batches from code-point class
arrays. Two families of features come from them: vocabulary, each word's share
in the documents of each grade, and syntax, the same for triples of a skeleton in
which only the frequent words and the signs stay as they are. Each family says
how likely the words or triples of a text are at each grade. A linear ranker is
learned from pairs of graded documents (logistic loss on score differences), and
isotonic regression maps its scores to the share of graders at or above a grade.

The shares are counted on the executors, by language and by fold; copies of a
text fall into one fold. For a document that the ranker learns from, they are
those of the other folds. The driver gets the counts and a row of features for
each labelled document, never texts.

Only the training is bounded: at most MAX_LABELLED labelled documents, taken in
the order of a hash of their ids. Every document gets a score over its whole text.

Defined results: null, empty and wordless texts have no grade (null); grades of
documents in other languages are extrapolated and left out of p9_found; labels
with null grade, a grade outside of the scale or an unknown document are
ignored; without any label every grade is null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, code_points, cut, table, text_buffers
from .p7_tokens import LETTER, classes

#: Labelled documents that the model learns from at most.
MAX_LABELLED = 20_000
#: Pairs that the ranker learns from at most.
MAX_PAIRS = 200_000
CHUNK_BYTES = 2 << 20
FOLDS = 5
KINDS = ("chapter", "dialogue", "foreword")
MIN_CHARS = 300
LEVELS = np.arange(1, 6)
#: Labelled documents from which a language gets a ranker of its own.
MIN_OWN = 80
#: Share of a language's labelled documents from which a word is frequent and stays in the skeleton.
FREQUENT = 0.2
#: Occurrences that a word or triple needs to tell something.
MIN_COUNT = 3
#: How much of the evidence of single words or triples, which are not independent, makes the expected level.
TEMPERS = ((1.0, 0.3), (0.5, 0.2))

#: Frequent words that tell a text's language.
LANGUAGE_WORDS = {
    "de": "der die das und ein eine einen einem den dem des ist nicht mit auf für von zu im am sich auch dass wie wer warum hier dort dann weil während obwohl".split(),
    "en": "the and of to is it that with for was her his she he they not this are which because whenever at see from you".split(),
    "fr": "le la les et un une des du est dans où pour que qui au aux il elle pourquoi demande ne pas mme".split(),
    "es": "el los las y una del es en que con por para quién al no su dónde sr dra se lo".split(),
    "it": "il gli che di è per non della sono".split(),
    "nl": "het een van en is niet dat op te zijn".split(),
}
_LANGS = tuple(LANGUAGE_WORDS)
#: Skeleton of words that are not frequent, and of signs in the order of their weight.
CAPITAL, SMALL, DIGIT, FIRST = 0, 1, 2, 16
SIGNS = (";", ".!?…。！？", ",", ":", "–—", "\"„“”»«")
#: Skeletons have fewer symbols than this; triples of them fit into 60 bits.
SYMBOLS = 1 << 20
VOCABULARY, SYNTAX = 0, 1

LABELLED = "text string, shares array<double>"


def sign_of(text: str) -> int:
    """Symbol of what stands between two words, -1 for mere blanks."""
    if any(c.isdigit() for c in text):
        return DIGIT
    return next((DIGIT + 1 + k for k, signs in enumerate(SIGNS) if any(c in signs for c in text)), -1)


class Chunk:
    """Words and what stands between them in some texts: codes of distinct slices, and each slice's text."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.n = len(off) - 1
        cp, at = code_points(data)
        row_start = np.zeros(len(data) + 1, bool)
        row_start[off[:-1]] = True
        edge = row_start[at]
        letter = classes()[cp] == LETTER
        change = edge.copy()
        change[1:] |= letter[1:] != letter[:-1]
        starts = np.flatnonzero(change)
        bounds = np.append(at[starts], len(data))
        slices = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        coded = slices.dictionary_encode()
        self.said = [s.decode("utf-8", "replace") for s in coded.dictionary.to_pylist()]
        self.low = [s.lower() for s in self.said]
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.row = np.searchsorted(off, at[starts], "right") - 1
        self.word = letter[starts]
        self.words = np.bincount(self.row[self.word], minlength=self.n)

    def languages(self) -> list[str | None]:
        """Language of each text by its share of frequent words, None where no language has enough."""
        known = _language_bits()
        bits = np.fromiter((known.get(w, 0) for w in self.low), np.int64, len(self.low))
        latin = np.fromiter((w.isascii() or any(c in "äöüßéèêàâçñáíóúœ" for c in w) for w in self.low), bool, len(self.low))
        at, row = self.code[self.word], self.row[self.word]
        votes = np.array([np.bincount(row[(bits[at] >> k) & 1 == 1], minlength=self.n) for k in range(len(_LANGS))])
        own = np.bincount(row[latin[at]], minlength=self.n)
        top = votes.argmax(0)
        return [_LANGS[top[i]] if votes[top[i], i] >= 0.05 * self.words[i] and own[i] > 0.5 * self.words[i] else None for i in range(self.n)]

    def keys(self, frequent: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys, rows) of the words, and of the triples of the skeleton."""
        is_word = np.zeros(len(self.said), bool)
        is_word[self.code[self.word]] = True
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 if a else 0 for w, a in zip(self.low, is_word)), np.int64, len(self.low))
        symbol = np.fromiter(
            ((frequent[w] if w in frequent else CAPITAL if s[0].isupper() else SMALL) if a else sign_of(s) for s, w, a in zip(self.said, self.low, is_word)), np.int64, len(self.low)
        )
        s, r = symbol[self.code], self.row
        s, r = s[s >= 0], r[s >= 0]
        one_text = r[2:] == r[:-2]
        triples = ((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[one_text]
        return [(hashes[self.code[self.word]], self.row[self.word]), (triples, r[2:][one_text])]


@cache
def _language_bits() -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for k, words in enumerate(LANGUAGE_WORDS.values()):
        for w in words:
            bits[w] |= 1 << k
    return dict(bits)


def texts_of(arr) -> Iterator[tuple[int, int, Chunk]]:
    """Ranges of rows of an Arrow string array, with their words."""
    off, data = text_buffers(arr)
    for i, j in chunks(off, CHUNK_BYTES):
        yield i, j, Chunk(data[off[i] : off[j]], off[i : j + 1] - off[i])


def fold_of(text: str) -> int:
    """Fold of a text by its letters, so that copies in other formatting share it."""
    return xxhash.xxh3_64_intdigest("".join(c for c in text.lower() if c.isalpha())) % FOLDS


def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): in how many texts of a batch each word occurs; the empty word stands for all texts of the language."""
    for b in batches:
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for _, _, c in texts_of(b.column("text")):
            langs = [lang or "" for lang in c.languages()]
            for lang in langs:
                seen[lang, ""] += 1
            if len(c.low):
                first = {}
                same = np.fromiter((first.setdefault(w, k) for k, w in enumerate(c.low)), np.int64, len(c.low))
                for p in np.unique(c.row[c.word] * len(c.low) + same[c.code[c.word]]):
                    seen[langs[p // len(c.low)], c.low[p % len(c.low)]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


COUNTS = "lang string, family int, key long, fold int, " + ", ".join(f"g{k} double" for k in LEVELS)


def count_keys(frequent: dict[str, int]) -> Callable:
    """Counts of words and triples by language, fold and grade, added up within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = np.array(b.column("shares").to_pylist(), float).reshape(-1, len(LEVELS))
            folds = np.fromiter(map(fold_of, b.column("text").to_pylist()), np.int64, b.num_rows)
            for i, j, c in texts_of(b.column("text")):
                langs = np.array([lang or "" for lang in c.languages()], object)
                for lang in sorted(set(langs)):
                    for family, (key, row) in enumerate(c.keys(frequent)):
                        mine = (langs == lang)[row]
                        pairs, at = np.unique(np.stack([key[mine], folds[i:j][row[mine]]]), axis=1, return_inverse=True)
                        sums = [pa.array(np.bincount(at.ravel(), shares[i:j][row[mine], k], pairs.shape[1]).astype(float)) for k in range(len(LEVELS))]
                        n = pairs.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, family, np.int32)), pa.array(pairs[0]), pa.array(pairs[1].astype(np.int32)), *sums], names=["lang", "family", "key", "fold", *(f"g{k}" for k in LEVELS)])

    return run


class Shares:
    """How much likelier each word or triple of a language is at each grade than over all, for all folds and without each one."""

    def __init__(self, key: np.ndarray, counts: np.ndarray) -> None:
        """Keys, possibly repeated, and the counts of each by fold and grade."""
        self.keys, at = np.unique(key, return_inverse=True)
        by_fold = np.zeros((FOLDS, len(self.keys), len(LEVELS)))
        np.add.at(by_fold, (slice(None), at), counts.transpose(1, 0, 2))
        whole = by_fold.sum(0)
        self.tables = [self._ratios(whole - by_fold[f]) for f in range(FOLDS)] + [self._ratios(whole)]

    @staticmethod
    def _ratios(counts: np.ndarray) -> np.ndarray:
        by_key, by_grade = counts.sum(1), counts.sum(0)
        total = max(1.0, by_key.sum())
        made = np.log(counts / np.maximum(by_grade, 1e-9) + 1 / total) - np.log((by_key + 1) / total)[:, None]
        made[by_key < MIN_COUNT] = 0
        return made.astype(np.float32)

    def features(self, key: np.ndarray, row: np.ndarray, n: int, fold: np.ndarray | None, prior: np.ndarray, tempers: tuple[float, ...]) -> np.ndarray:
        """For each of n texts the mean ratios, and the expected level at each temper; fold: the one that each text is left out with."""
        if not len(self.keys):
            at, known = np.zeros(0, np.int64), np.zeros(len(key), bool)
        else:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            at = at[known]
        row = row[known]
        if fold is None:
            got = self.tables[FOLDS][at]
        else:
            got = np.stack(self.tables)[fold[row], at]
        sums = np.column_stack([np.bincount(row, got[:, k], n).astype(float) for k in range(len(LEVELS))])
        telling = np.bincount(row[(got != 0).any(1)], minlength=n)[:, None]
        out = [sums / np.maximum(1, telling)]
        for t in tempers:
            z = t * sums + np.log(prior)
            z = np.exp(z - z.max(1, keepdims=True))
            out.append((z @ LEVELS / z.sum(1))[:, None])
        return np.hstack(out)


class Evidence:
    """Frequent words, and the shares by language; "" stands for all languages together."""

    def __init__(self, frequent: dict[str, int], lang: np.ndarray, family: np.ndarray, key: np.ndarray, counts: np.ndarray, sizes: dict[str, int]) -> None:
        self.frequent = frequent
        self.prior = {}
        self.shares = {}
        for name in ("", *(la for la, n in sizes.items() if la and n >= MIN_OWN)):
            mine = (lang == name) if name else np.ones(len(lang), bool)
            self.shares[name] = [Shares(key[at], counts[at]) for at in (mine & (family == f) for f in (VOCABULARY, SYNTAX))]
            # Triples stand for texts by their length; that is near enough for a prior.
            by_grade = counts[mine & (family == SYNTAX)].sum((0, 1)) + 1
            self.prior[name] = by_grade / by_grade.sum()

    def names(self, langs: list[str | None]) -> np.ndarray:
        return np.array([lang if lang in self.shares else "" for lang in langs], object)

    def features(self, c: Chunk, langs: list[str | None], folds: np.ndarray | None, every: bool = False) -> dict[str, np.ndarray]:
        """For each name of shares the features of the texts that go by it, or of every text."""
        keys, names, out = c.keys(self.frequent), self.names(langs), {}
        for name in self.shares if every else sorted(set(names)):
            pick = np.ones(c.n, bool) if every else names == name
            parts = [s.features(k[pick[r]], r[pick[r]], c.n, folds, self.prior[name], t) for s, (k, r), t in zip(self.shares[name], keys, TEMPERS)]
            out[name] = np.hstack(parts)
        return out


def learn_ranker(x: np.ndarray, grade: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the linear pairwise ranker, by Newton steps on the logistic loss of score differences."""
    n = len(x)
    if n * (n - 1) // 2 <= 2 * max_pairs:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = np.random.default_rng(7).integers(0, n, (2, 2 * max_pairs))
    keep = np.flatnonzero(np.abs(grade[i] - grade[j]) >= 0.5)[:max_pairs]
    i, j = i[keep], j[keep]
    swap = grade[i] < grade[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    d = x[i] - x[j]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / max(1, len(d)) + ridge * np.eye(len(w)), d.T @ p / max(1, len(d)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the non-decreasing mean grades at them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, sum of scores
    for s, g in zip(score[order], grade[order]):
        blocks.append([g, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Evidence, and a ranker with its calibration for each of its languages and for all together."""

    def __init__(self, evidence: Evidence, features: dict[str, np.ndarray], names: np.ndarray, shares: np.ndarray) -> None:
        """features: of every labelled document by each name; names: which of them it goes by; shares: of its graders by grade."""
        self.evidence, self.parts = evidence, {}
        grade = shares @ LEVELS
        for name, x in features.items():
            mine = np.flatnonzero(names == name) if name else np.arange(len(names))
            center, scale = x[mine].mean(0), x[mine].std(0) + 1e-9
            w = learn_ranker((x[mine] - center) / scale, grade[mine]) / scale
            score = (x[mine] - center) @ w
            self.parts[name] = (center, w, [isotonic(score, shares[mine][:, LEVELS >= k].sum(1)) for k in LEVELS[1:]])

    def predict(self, c: Chunk, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected level (nan where there is no word) and grade: the highest level that is likelier reached than not."""
        level, grade = np.full(c.n, np.nan), np.ones(c.n, np.int32)
        names = self.evidence.names(langs)
        for name, x in self.evidence.features(c, langs, None).items():
            center, w, steps = self.parts[name]
            at = np.flatnonzero((names == name) & (c.words > 0))
            score = (x[at] - center) @ w
            reached = np.array([np.interp(score, s, g) for s, g in steps])
            level[at] = LEVELS[0] + reached.sum(0)
            grade[at] = LEVELS[0] + (reached >= 0.5).sum(0)
        return level, grade


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, shares of its graders by grade) of at most `most` labelled documents with a text, by the hash of their ids."""
    valid = labels.where(f"doc_id is not null and grade between {LEVELS[0]} and {LEVELS[-1]}")
    shares = F.array(*[F.avg((F.col("grade") == int(k)).cast("double")) for k in LEVELS])
    marks = valid.groupBy("doc_id").agg(shares.alias("shares")).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most).drop("_h")
    return docs.where("text <> ''").select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "shares")


def learn(known: DataFrame) -> Model | None:
    """Model of labelled documents (text, shares); None if there is none with a word."""
    spark = known.sparkSession
    known = cut(known)
    in_texts = known.select("text").mapInArrow(frequent_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    in_texts = cut(in_texts)
    sizes = {r["lang"]: r["n"] for r in in_texts.where("word = ''").collect()}
    if not sizes:
        return None
    least = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, FREQUENT * n)])
    # Words in a fifth of the texts: no more than five times the distinct words of a text.
    words = sorted({r["word"] for r in in_texts.where((F.col("word") != "") & (F.col("n") >= F.element_at(least, F.col("lang")))).select("word").collect()})
    frequent = {w: FIRST + k for k, w in enumerate(words)}
    grades = [f"g{k}" for k in LEVELS]
    counts = known.mapInArrow(count_keys(frequent), COUNTS)
    by_fold = F.array(*[F.sum(F.when(F.col("fold") == f, F.col(g)).otherwise(0.0)).cast("float") for f in range(FOLDS) for g in grades])
    by_key = counts.groupBy("lang", "family", "key").agg(by_fold.alias("by_fold"), F.sum(sum((F.col(g) for g in grades[1:]), F.col(grades[0]))).alias("n"))
    got = by_key.where(F.col("n") >= MIN_COUNT).select("lang", "family", "key", "by_fold").toArrow().combine_chunks()
    lang, family, key = (got.column(c).to_numpy() for c in ("lang", "family", "key"))
    sums = np.array(got.column("by_fold").to_pylist(), float).reshape(-1, FOLDS, len(LEVELS))
    evidence = Evidence(frequent, lang, family, key, sums, sizes)
    shipped = spark.sparkContext.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds = np.fromiter(map(fold_of, b.column("text").to_pylist()), np.int64, b.num_rows)
            for i, j, c in texts_of(b.column("text")):
                langs = c.languages()
                x = shipped.value.features(c, langs, folds[i:j], every=True)
                rows = [{"name": name, "words": int(n), "shares": s, "x": [x[k][r].tolist() for k in x]} for r, (name, n, s) in enumerate(zip(shipped.value.names(langs), c.words, b.column("shares").slice(i, j - i).to_pylist()))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("words", pa.int64()), ("shares", pa.list_(pa.float64())), ("x", pa.list_(pa.list_(pa.float64())))]))

    rows = known.mapInArrow(run, "name string, words long, shares array<double>, x array<array<double>>").where("words > 0").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("x").to_pylist())
    return Model(evidence, {name: x[:, k] for k, name in enumerate(evidence.shares)}, np.array(rows.column("name").to_pylist(), object), np.array(rows.column("shares").to_pylist()))


def read_levels(docs: DataFrame, text: str, model: Model | None) -> DataFrame:
    """Adds reading: struct<lang, level (not rounded), grade> to documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("level", pa.float64()), ("grade", pa.int32())])

    @F.arrow_udf("struct<lang:string,level:double,grade:int>")
    def level(arr: pa.Array) -> pa.Array:
        langs: list[str | None] = []
        levels, grades = [np.zeros(0)], [np.zeros(0, np.int32)]
        for i, j, c in texts_of(arr):
            lang = c.languages()
            got, grade = shipped.value.predict(c, lang) if shipped.value else (np.full(j - i, np.nan), np.ones(j - i, np.int32))
            langs += lang
            levels.append(got)
            grades.append(grade)
        got, grade = np.concatenate(levels), np.concatenate(grades)
        missing = np.isnan(got)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(got, pa.float64(), mask=missing), pa.array(grade, pa.int32(), mask=missing)], fields=list(kind))

    # Else filters on the result would be made of a second evaluation.
    return docs.withColumn("reading", level.asNondeterministic()(F.col(text)))


def _levels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return read_levels(docs, "text", learn(labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("kind").isin(*KINDS) & (F.col("n_chars") >= MIN_CHARS)).select("doc_id", "text")
    return _levels(spark, docs, sf_dir).where(F.col("reading.lang").isin("de", "en") & F.col("reading.grade").isNotNull()).select("doc_id", "reading.grade")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _levels(spark, docs, sf_dir).select("doc_id", "reading.lang", F.round("reading.level", 3).alias("level"), "reading.grade")
