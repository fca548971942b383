"""Problem 1: mapping free-entered values to a canonical list.

A value is brought into one writing (encoding damage and look-alike letters
repaired, compatibility forms composed, case folded). A multi-pattern automaton
over the list's names and their aliases then finds embedded mentions; the
longest non-overlapping ones win, and the value is mapped if nothing but card
notation stands around them. What remains goes to token-set similarity: the
tokens are the letter pairs of the value, and all entries that share enough of
them to be within the allowed number of slips are taken in the order of that
similarity and checked by the cost of the slips.

Compound entries tell how further compounds would be built. Those that the list
lacks are counter-candidates: a value nearest to one of them stands for none of
the list. They are found by the letter pairs of their two parts and are never
written down, so the index grows in proportion to the list. A value of more
letters than any name or compound can have within the allowed slips is near none.

Defined results: null and blank values and values that equal an entry make no
case; a value that means no entry has id 0; of repeated entries of the list the
smallest id counts; an empty list maps every value to 0.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, table

#: Entries that a reference list may have; it is held whole in every Python worker.
MAX_LIST = 200_000
#: Letter pairs that a slip takes from a value for each unit of its cost, at most: three for a transposition of cost 0.8.
LOST = 3.75
#: By how much less cost a counter-candidate beats an entry.
CLEARLY = 0.5
#: How often the first and the last part of a compound must occur in the list to count as parts.
MIN_PART = 3

# Words and signs of card notation.
ARTICLES = frozenset("der die das den dem des ein eine einen einem einer eines".split())
PARTICLES = ARTICLES | {"sich", "zu", "etwas", "etw", "jemanden", "jmdn", "jemandem", "jmdm"}
#: How cards mark what is no part of a word: text in brackets, tags, a label or number before it, endings of other forms, references and remarks behind it.
NOTES = re.compile(r"\([^)]*\)|\[[^\]]*\]|<[^>]*>|\{[^}]*\}|#\s*\w+|^\s*\w+\s*:|^\s*\d+\s*[.)]\s*|,\s*(?:¨|̈)?\s*-\s*\w*|/\s*-\s*$|=.*$|\s[–—-]\s+\w+\s*$|\b(?:s\.|siehe|vgl\.?|cf\.?)\s+\w+\s*$")
#: Brackets that may also stand around a part of the word itself.
BRACKETS = str.maketrans(dict.fromkeys("()[]<>{}"))
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеоорсухіјѕԁһкмтвнАЕОРСХІЈЅКМТВНУαοερνικ", "aeoopcyxijsdhkmtbhAEOPCXIJSKMTBHYaoepvik")
#: Digits and signs misread for letters.
MISREAD = str.maketrans({"1": "l", "0": "o", "5": "s", "8": "b", "|": ""})
#: Rows of the German keyboard.
KEYBOARD = ("qwertzuiopü", "asdfghjklöä", "yxcvbnm")
#: Spellings that sound alike.
SOUNDS = (("f", "v"), ("v", "w"), ("d", "t"), ("g", "k"), ("b", "p"), ("s", "z"), ("c", "k"), ("i", "y"), ("e", "ä"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("e", "a"))

_WORD = re.compile(r"[^\W\d_]+")


def _near_keys() -> frozenset[tuple[str, str]]:
    near = set()
    for y, row in enumerate(KEYBOARD):
        for x, a in enumerate(row):
            for dy in (-1, 0, 1):
                if 0 <= y + dy < len(KEYBOARD):
                    for dx in (-1, 0, 1):
                        if 0 <= x + dx < len(KEYBOARD[y + dy]) and (dx or dy):
                            near.add((a, KEYBOARD[y + dy][x + dx]))
    return frozenset(near)


NEAR_KEYS = _near_keys()
ALIKE = frozenset(SOUNDS) | frozenset((b, a) for a, b in SOUNDS)


def _damage() -> dict[str, str]:
    """What letters become when their UTF-8 bytes are read as cp1252, also after a change of case."""
    made = {}
    for c in "äöüÄÖÜßéèêàâçñáíóú–—„“”‚‘’…":
        bad = c.encode("utf-8").decode("cp1252", "replace")
        for form in (bad, bad.lower(), bad.upper(), bad.casefold()):
            if len(form) > 1 and form.isprintable():
                made.setdefault(form, c)
    return made


DAMAGE = _damage()
_DAMAGED = re.compile("|".join(map(re.escape, sorted(DAMAGE, key=len, reverse=True))))


def one_writing(value: str) -> str:
    """Repaired, composed, case-folded; underscores and all white space as single blanks."""
    v = _DAMAGED.sub(lambda m: DAMAGE[m[0]], value)  # before ¼ and the like are taken apart
    v = unicodedata.normalize("NFKC", v).translate(LOOKALIKES)
    v = _DAMAGED.sub(lambda m: DAMAGE[m[0]], v)
    v = "".join(c for c in v if unicodedata.category(c) != "Cf")
    return unicodedata.normalize("NFC", " ".join(v.replace("_", " ").split()).casefold())


def letters_of(text: str) -> str:
    return "".join(c for c in text if c.isalpha())


def readings(value: str) -> list[str]:
    """The letters of a value in one writing with its notation taken off, most likely reading first."""
    out = []
    for form in (NOTES.sub(" ", value), NOTES.sub(" ", value.translate(BRACKETS))):
        for piece in (re.split(r"[,;=/]|\s[–—-]\s", form)[0], form):
            tokens = piece.translate(MISREAD).split()
            while len(tokens) > 1 and letters_of(tokens[0]) in PARTICLES:
                tokens = tokens[1:]
            while len(tokens) > 1 and letters_of(tokens[-1]) in ARTICLES:
                tokens = tokens[:-1]
            key = letters_of(" ".join(tokens))
            if key and key not in out:
                out.append(key)
    return out


def spellings(key: str) -> Iterator[str]:
    """A name's letters, and its aliases without umlauts."""
    yield key
    for to in (("ae", "oe", "ue"), ("a", "o", "u")):
        other = key
        for a, b in zip("äöü", to):
            other = other.replace(a, b)
        if other != key:
            yield other


def compound_parts(keys: Iterable[str], least: int = MIN_PART) -> tuple[set[str], set[str]]:
    """First and last parts of the compounds of a list: parts that meet at least so many different others."""
    keys = set(keys)
    tails, heads = defaultdict(set), defaultdict(set)
    for k in keys:
        for i in range(3, len(k) - 2):
            heads[k[:i]].add(k[i:])
            tails[k[i:]].add(k[:i])
    # A split holds if both parts are productive; of a word's splits the one with the most meetings.
    first, last = Counter(), Counter()
    for k in keys:
        best, at = 0, 0
        for i in range(3, len(k) - 2):
            a, b = len(heads[k[:i]]), len(tails[k[i:]])
            if a >= least and b >= least and min(a, b) > best:
                best, at = min(a, b), i
        if at:
            first[k[:at]] += 1
            last[k[at:]] += 1
    return {p for p, n in first.items() if n >= least}, {p for p, n in last.items() if n >= least}


def slip_cost(a: str, b: str, most: float) -> float:
    """Weighted edit distance with transpositions; beyond `most` any larger number."""
    la, lb = len(a), len(b)
    if abs(la - lb) * 0.6 > most:
        return 99.0
    # What both begin and end with costs nothing; two letters of it stay, for doublings and transpositions.
    i, short = 0, min(la, lb)
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[la - 1 - j] == b[lb - 1 - j]:
        j += 1
    i, j = max(0, i - 2), max(0, j - 2)
    if i or j:
        a, b = a[i : la - j], b[i : lb - j]
        la, lb = len(a), len(b)
    # A way that leaves the band takes more letters in or out than `most` allows.
    band = int(most / 0.6) + 1
    before2: list[float] = []
    before = [0.0] * (lb + 1)
    for j in range(1, lb + 1):
        before[j] = before[j - 1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i in range(1, la + 1):
        x = a[i - 1]
        twin = i > 1 and x == a[i - 2]
        row = [99.0] * (lb + 1)
        if i <= band:
            row[0] = before[0] + (0.6 if twin else 1.0)
        low = row[0]
        for j in range(max(1, i - band), min(lb, i + band) + 1):
            y = b[j - 1]
            if x == y:
                c = before[j - 1]
            else:
                c = before[j - 1] + (0.7 if (x, y) in ALIKE else 0.75 if (x, y) in NEAR_KEYS else 1.0)
                d = before[j] + (0.6 if twin or (i < la and x == a[i]) else 0.95)
                if d < c:
                    c = d
                d = row[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 0.95)
                if d < c:
                    c = d
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d = before2[j - 2] + 0.8
                    if d < c:
                        c = d
            row[j] = c
            if c < low:
                low = c
        if low > most:
            return 99.0
        before2, before = before, row
    return before[lb]


def allowed(length: int) -> float:
    """Cost of the slips that a value of so many letters may have."""
    return 0.0 if length < 3 else 1.0 if length < 6 else 2.0 if length < 9 else 2.6 if length < 13 else 3.0


class Postings:
    """Letter pairs of some strings: how many of a value's pairs each of them has."""

    def __init__(self, strings: list[str], pairs: Callable[[str], set[str]]) -> None:
        found: dict[str, list[int]] = defaultdict(list)
        for n, s in enumerate(strings):
            for p in pairs(s):
                found[p].append(n)
        self.strings = strings
        self.places = {p: np.array(v, np.int32) for p, v in found.items()}

    def shared(self, pairs: set[str]) -> np.ndarray:
        hits = [self.places[p] for p in pairs if p in self.places]
        return np.bincount(np.concatenate(hits), minlength=len(self.strings)) if hits else np.zeros(len(self.strings), np.int64)


def pairs_of(key: str) -> set[str]:
    return {key[i : i + 2] for i in range(len(key) - 1)}


class Canon:
    """Index over a reference list: exact spellings, automaton, letter pairs, parts of compounds."""

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.exact = {name for _, name in entries}
        self.ids: dict[str, int] = {}
        self.auto = ahocorasick.Automaton()
        for i, name in sorted(entries, reverse=True):
            key = letters_of(one_writing(name))
            if key:
                self.ids[key] = i
                words = " ".join(_WORD.findall(one_writing(name)))
                self.auto.add_word(words, (i, len(words)))
        names = {letters_of(one_writing(n)) for _, n in entries} - {""}
        self.of_name = {key: self.ids[key] for key in names}
        for key, i in list(self.ids.items()):
            for alias in spellings(key):
                self.ids.setdefault(alias, i)
        for i, name in sorted(entries, reverse=True):
            for alias in spellings(" ".join(_WORD.findall(one_writing(name)))):
                if alias and not self.auto.exists(alias):
                    self.auto.add_word(alias, (i, len(alias)))
        self.auto.make_automaton()
        # Compounds that the list lacks are never written down: a value is held against their parts.
        first, last = compound_parts(names)
        self.first_spelled = {s: a for a in sorted(first, reverse=True) for s in spellings(a)}
        self.last_spelled = {s: b for b in sorted(last, reverse=True) for s in spellings(b)}
        self.firsts, self.lasts = Postings(sorted(first), lambda a: pairs_of("^" + a)), Postings(sorted(last), lambda b: pairs_of(b + "$"))
        self.names = sorted(names)
        self.postings = Postings(self.names, self.pairs)
        self.lengths = np.array([len(n) for n in self.names], np.int32)
        self.longest = max([0, *map(len, names), max(map(len, first), default=0) + max(map(len, last), default=0)])
        self.signs = {c: i for i, c in enumerate(sorted({c for n in self.names for c in n}))}
        self.bags = np.array([self.bag(n)[0] for n in self.names], np.int16).reshape(len(self.names), len(self.signs))
        self.first_bags, self.last_bags = (np.array([self.bag(x)[0] for x in p.strings], np.int16).reshape(len(p.strings), len(self.signs)) for p in (self.firsts, self.lasts))
        self.cache: dict[str, int] = {}

    @staticmethod
    def pairs(key: str) -> set[str]:
        return pairs_of(f"^{key}$")

    def bag(self, key: str) -> tuple[np.ndarray, int]:
        """How often each letter of the list occurs in a key, and how many other letters it has."""
        counts, others = np.zeros(len(self.signs), np.int16), 0
        for c in key:
            if c in self.signs:
                counts[self.signs[c]] += 1
            else:
                others += 1
        return counts, others

    def mention(self, text: str) -> int | None:
        """The entry mentioned in a value, if nothing but notation stands around its longest mention."""
        if not len(self.auto):
            return None
        words = " ".join(_WORD.findall(NOTES.sub(" ", text)))
        found = []
        for end, (i, size) in self.auto.iter(words):
            start = end - size + 1
            if (start == 0 or words[start - 1] == " ") and (end + 1 == len(words) or words[end + 1] == " "):
                found.append((size, start, end + 1, i))
        taken: list[tuple[int, int, int]] = []
        for size, start, end, i in sorted(found, key=lambda f: (-f[0], f[1])):
            if all(end <= a or start >= b for a, b, _ in taken):
                taken.append((start, end, i))
        if not taken or len({i for *_, i in taken}) > 1:
            return None
        around = list(words)
        for a, b, _ in taken:
            around[a:b] = " " * (b - a)
        return taken[0][2] if all(t in PARTICLES or len(t) == 1 for t in "".join(around).split()) else None

    def lacks(self, key: str) -> bool:
        """Whether a value's letters are a compound that the list lacks."""
        return any(
            (a := self.first_spelled.get(key[:i])) and (b := self.last_spelled.get(key[i:])) and a + b not in self.of_name for i in range(1, len(key))
        )

    def lacked(self, key: str, pairs: set[str], counts: np.ndarray, others: int, most: float) -> float:
        """Cost of the nearest compound that the list lacks; 99 if none is within `most`."""
        need = max(1, len(pairs) - LOST * most) - 1  # one pair may stand where the parts meet
        a, b = self.firsts.shared(pairs), self.lasts.shared(pairs)
        if most <= 0 or not len(a) or not len(b):
            return 99.0
        by_count = np.argsort(-b, kind="stable")
        firsts = np.flatnonzero(a + b[by_count[0]] >= need)
        reach = np.searchsorted(-b[by_count], a[firsts] - need, "right")
        i = np.repeat(firsts, reach)
        j = by_count[np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)]
        gap = self.first_bags[i] + self.last_bags[j] - counts
        at_least = 0.6 * np.maximum(np.where(gap > 0, gap, 0).sum(1), np.where(gap < 0, -gap, 0).sum(1) + others)
        best = most
        found = 99.0
        for k in np.flatnonzero(at_least <= most)[np.argsort(at_least[at_least <= most], kind="stable")]:
            if at_least[k] > best:
                break
            name = self.firsts.strings[i[k]] + self.lasts.strings[j[k]]
            if name not in self.of_name and len(pairs & self.pairs(name)) >= len(pairs) - LOST * best and (c := slip_cost(key, name, best)) <= best:
                best = found = c
        return found

    def nearest(self, key: str, most: float) -> tuple[float, int]:
        """Cost and id of the entry or counter-candidate nearest to a value's letters; (99, 0) if none is near enough.

        Entries are taken in the order of their token-set similarity to the
        value, over letter pairs as tokens; the cost of the slips is the check
        that the similar ones must pass.
        """
        if most <= 0 or not self.names or len(key) > self.longest + most / 0.6:
            return 99.0, 0
        pairs = self.pairs(key)
        shared = self.postings.shared(pairs)
        at = np.flatnonzero(shared >= max(1, len(pairs) - LOST * most))
        # Letters that one has and the other lacks cost at least 0.6 each to bring in or out.
        counts, others = self.bag(key)
        gap = self.bags[at] - counts
        at_least = 0.6 * np.maximum(np.where(gap > 0, gap, 0).sum(1), np.where(gap < 0, -gap, 0).sum(1) + others)
        alike = 2.0 * shared[at] / (len(pairs) + self.lengths[at] + 1)
        # Narrow bounds first; wider ones only if those find nothing.
        for bound in sorted({b for b in (1.0, 2.0) if b < most} | {most}):
            near = (at_least <= bound) & (shared[at] >= len(pairs) - LOST * bound)
            best, ids = bound + 1e-9, set()
            for k in np.flatnonzero(near)[np.argsort(-alike[near], kind="stable")]:
                n = at[k]
                if at_least[k] > best or shared[n] < len(pairs) - LOST * best:
                    continue
                c = slip_cost(key, self.names[n], best)
                if c < best - 1e-9:
                    best, ids = c, {self.of_name[self.names[n]]}
                elif c <= best + 1e-9:
                    ids.add(self.of_name[self.names[n]])
            # Slips are made on words that learners have: a name of the list is meant unless one that it lacks is clearly nearer.
            reach = best - CLEARLY if ids else bound
            lacked = self.lacked(key, pairs, counts, others, reach)
            if ids and lacked >= best - CLEARLY:
                return best, ids.pop() if len(ids) == 1 else 0
            if lacked < bound - CLEARLY or (lacked <= bound and bound == most):
                return lacked, 0
        return 99.0, 0

    def find(self, value: str) -> int:
        if (got := self.cache.get(value)) is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[value] = self._find(value)
        return got

    def _find(self, value: str) -> int:
        text = one_writing(value)
        if (i := self.mention(text)) is not None:
            return i
        keys = readings(text)
        for key in keys:
            if (i := self.ids.get(key)) is not None:
                return i
        for key in keys[:1]:
            if self.lacks(key):
                return 0
        best = (99.0, 0)
        for key in keys[:2]:
            got = self.nearest(key, min(allowed(len(key)), best[0]))
            if got[0] < best[0]:
                best = got
            if best[1]:
                break
        return best[1]


_built: dict[str, Canon] = {}


def map_values(df: DataFrame, value: str, entries: list[tuple[int, str]], to: str) -> DataFrame:
    """Adds to `df` the id of the entry that each value stands for (0: none); rows whose value makes no case leave."""
    if len(entries) > MAX_LIST:
        raise ValueError(f"the list has {len(entries)} entries; at most {MAX_LIST} are held in a worker")
    spark = df.sparkSession
    shipped, mark = spark.sparkContext.broadcast(entries), uuid.uuid4().hex

    @F.arrow_udf("long")
    def find(arr: pa.Array) -> pa.Array:
        if mark not in _built:
            _built.clear()
            _built[mark] = Canon(shipped.value)
        canon = _built[mark]
        return pa.array([canon.find(v) for v in arr.to_pylist()], pa.int64())

    name = f"`{value}`"
    names = spark.createDataFrame([(n,) for _, n in entries], f"{name} string").distinct()
    cases = df.where(F.col(name).isNotNull() & ~F.col(name).rlike(f"^{WS_CLASS}*$"))
    cases = cases.join(F.broadcast(names), value, "left_anti")
    # Each distinct value is looked up once; small as they are, the values need all the cores.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cases.select(name).distinct().repartition(tasks, name).withColumn(to, find.asNondeterministic()(F.col(name)))  # else filters on the id would evaluate it again
    return cases.join(found, value)


def _list(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    rows = table(spark, sf_dir, "headwords").where("headword_id is not null and headword is not null").select("headword_id", "headword").limit(MAX_LIST + 1).collect()
    return [(r[0], r[1]) for r in rows]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its place; a record that was delivered again has the same values, which fall to one at the end."""
    cards = table(spark, sf_dir, "known_words").where("card_id is not null").select(F.lit("known_words").alias("origin"), F.col("card_id").alias("record_id"), F.lit(0).alias("word_no"), F.col("entry").alias("value"))
    words = table(spark, sf_dir, "sentence_words").where("sw_id is not null").select(F.lit("sentence_words").alias("origin"), F.col("sw_id").alias("record_id"), F.posexplode("words.lemma").alias("p", "value"))
    return cards.unionByName(words.select("origin", "record_id", (F.col("p") + 1).alias("word_no"), "value"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_values(_values(spark, sf_dir), "value", _list(spark, sf_dir), "headword_id").select("origin", "record_id", "word_no", "value", "headword_id").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_values(_values(spark, sf_dir), "value", _list(spark, sf_dir), "headword_id").select("origin", "record_id", "word_no", "headword_id").distinct()


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the values that stand for none, with how many records have them."""
    return p1_values(spark, sf_dir).where("headword_id = 0").groupBy("value").agg(F.count("*").alias("n"))
