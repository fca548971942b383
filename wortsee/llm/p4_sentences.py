"""Problem 4: sentence boundaries across languages and scripts.

The records of a source are put together in blocks of consecutive keys, with a
few records of the neighbours as context, so that a source of any length is
spread over many tasks. Within its block each terminator is judged by what is
certain there (case of what follows, brackets, quotations, script). Where that
does not decide, the document decides, by the counts of all its blocks, each of
its own records only: a token that goes on in small letters
elsewhere is an abbreviation, a word that has a capital only after certain ends
begins sentences, a word with a capital elsewhere too is a name or noun. Where
the document is silent, the same counts over the whole corpus do, by joins.

Scripts have their own terminators; where there are none (Thai), blanks are
boundaries if what follows begins as what follows after certain final particles.

Defined results: records without a key are no records, null and blank texts add
nothing, a source without text has no sentence; the last character of a source
always ends one; redelivered records count once.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Keys in a block, and keys of either neighbour that it sees as context.
BLOCK, CONTEXT = 2048, 16
#: Within so many code points a quotation in undirected signs must close again; brackets deeper than this are no brackets.
QUOTE_REACH, DEEPEST = 600, 8
#: Share of continued occurrences from which a token is an abbreviation.
ABBREVIATION = 0.2
#: A token is one that names follow if this share of its capitalised successors at least are names or nouns (a token with a full stop inside needs none), and fewer begin sentences.
BEFORE_NAMES = 0.25
#: From so many capitalised successors on that share tells something.
ENOUGH = 3
#: A word begins sentences if the document has it so many times as often in small letters as with a capital within sentences; records that were cut anywhere give a few false capitals.
SMALL_TIMES = 20
#: What a document says of a word with a capital: nothing; that it has it elsewhere too; that it is seen only where sentences begin, as names are too; that it is else written small, so it begins a sentence.
SILENT, NO_START, ONLY_STARTS, BEGINS = -1, 0, 1, 2
#: Share of sentence beginnings among its capitalised successors from which an abbreviation also ends sentences.
ENDS_TOO = 0.3

#: Fixed value: the characters that str.strip() takes off.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Terminators, quotation marks (opening -> closing), dashes and signs of continuation.
WIDE_STOPS = "。！？｡．"
SCRIPT_STOPS = "।॥؟۔።፧။།"
STOPS = ".!?…" + WIDE_STOPS + SCRIPT_STOPS
QUOTES = {"„": "“”\"", "‚": "‘’", "»": "«", "«": "»", "›": "‹", "‹": "›", "“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉", '"': '"'}
BRACKETS = {"(": ")", "[": "]"}
#: Signs that may open or close or be apostrophes.
UNSURE = frozenset("\"‚‘")
GO_ON = frozenset(",;:–—-)]}、，；：·/&=+")
#: Abbreviations before names and numbers, asked unless the corpus shows that what follows one of them begins sentences.
TITLES = ("Dr", "Dra", "Prof", "Hr", "Hrn", "Fr", "Frl", "St", "Mr", "Mrs", "Ms", "Sr", "Sra", "Srta", "Mme", "Mlle", "Nr", "Bd", "Kap", "Abb", "Tab", "Jh", "Sec", "Fig", "vgl", "bzw", "ca")
#: How speech is ascribed after a quotation in Chinese and Japanese.
ASCRIBED = re.compile(r"^\s*(?:と|って|、|，)|^[^。！？「“]{0,14}?(?:道|说|說|问|問|喊|答|叫|言)")
#: Thai final particles.
THAI_ENDS = ("ค่ะ", "คะ", "ครับ", "แล้ว", "นะ", "จ้ะ", "จ๊ะ", "ๆ")

#: Signs to a block that its source has other blocks, and that one comes after it.
MANY, MORE = "many", "more"
_ENDED = re.compile("[" + re.escape(STOPS) + r"][\"'”’»«›‹」』)\]]*$")
_STOP = re.compile(r"\.(?:\s\.){1,}(?:\s?\.)*|[" + re.escape(STOPS) + r"]+")
_PARTING = re.compile(r"[\"“”„«»‚‘‹›()\[\]–—,;:!?…]|\.$|(?<!\w)['’]|['’](?!\w)")
_WORD = re.compile(r"[\w’'-]+")
_LOWER = re.compile(r"(?<![\w’'.-])[a-zß-öø-ÿ][\w’'-]*")
_MID = re.compile(r"(?<=[a-zß-öø-ÿ,] )[A-ZÀ-ÖØ-Þ][\w’'-]*")
_ROMAN = re.compile(r"^[IVXLCDM]{1,7}$")
_THAI = re.compile(r"[฀-๿]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]$")
_OPENERS = "".join(QUOTES) + "([¿¡{"
_OPENING = frozenset("".join(QUOTES) + "([")
_SIGNS = re.compile("[" + re.escape("".join(sorted({*"".join(QUOTES), *"".join(QUOTES.values()), *"()[]"}))) + "]")


def closing(text: str, at: int, signs: list[tuple[int, str]], k: int) -> int:
    """Place of the sign that closes the one at `at`, which is signs[k]; -1 if it is unpaired.

    A directed quotation closes with the first sign that can close it, a bracket
    with the one of its depth, however far; one that begins anew before that was
    unpaired. Signs that may be anything (", ', apostrophes) are paired within
    QUOTE_REACH only.
    """
    sign = text[at]
    if sign in BRACKETS:
        depth, end = 0, BRACKETS[sign]
        for j in range(k, len(signs)):
            p, c = signs[j]
            depth += (c == sign) - (c == end)
            if not depth:
                return p
            if depth > DEEPEST:
                return -1
        return -1
    if sign in UNSURE:
        ends = [p for c in QUOTES[sign] if (p := text.find(c, at + 1, at + QUOTE_REACH)) >= 0]
        end = min(ends) if ends else -1
        while sign in "‚‘" and end >= 0 and text[end] == "’" and text[end + 1 : end + 2].isalpha():  # an apostrophe
            ends = [p for c in QUOTES[sign] if (p := text.find(c, end + 1, at + QUOTE_REACH)) >= 0]
            end = min(ends) if ends else -1
        return end
    for j in range(k + 1, len(signs)):
        p, c = signs[j]
        if c in QUOTES[sign]:
            return p
        if c == sign:
            return -1
    return -1


def spans(text: str) -> list[tuple[int, int]]:
    """Quotations and brackets as (place of the opening sign, place of the closing sign), outermost only."""
    signs = [(m.start(), m[0]) for m in _SIGNS.finditer(text)]
    out, after = [], 0
    for k, (at, sign) in enumerate(signs):
        if at < after or sign not in _OPENING:
            continue
        before = text[at - 1 : at]
        if sign in "»«›‹‘\"“" and ((before and not (before.isspace() or before in "([–—-:、，。！？" or ord(before) > 0x2E7F)) or at + 1 == len(text)):
            continue  # closes, or is an apostrophe
        end = closing(text, at, signs, k)
        if end >= 0:
            out.append((at, end))
            after = end + 1
    return out


def token_before(text: str, at: int) -> str:
    """The token that ends before a full stop, with the initial that it follows."""
    near = text[max(0, at - 60) : at]
    if not near or near[-1].isspace():
        return ""
    token = near.rsplit(None, 1)[-1]
    if not token.isalnum():
        token = _PARTING.split(token)[-1]
    if 0 < len(token) <= 3 and token.isalpha() and (start := at - len(token)) > 2 and text[start - 1].isspace():
        # z. B., u. a., p. ej.: a small initial with a full stop before it belongs to the token.
        rest = text[max(0, start - 8) : start].rstrip()
        if len(rest) >= 2 and rest[-1] == "." and rest[-2].islower() and (len(rest) == 2 or not (rest[-3].isalnum() or rest[-3] == ".")):
            return f"{rest[-2]}.{token}"
    return token


class Block:
    """What a block knows: certain ends, doubtful ends, counts for document and corpus."""

    def __init__(self, text: str, lo: int, hi: int, last: bool) -> None:
        """text: block with context; lo, hi: where the block itself begins and ends; last: nothing follows the text."""
        self.text, self.lo, self.hi = text, lo, hi
        self.sure: list[int] = []
        self.doubt: list[tuple[int, str, str, str]] = []  # end, kind, token, next word
        self.tokens: dict[str, list[int]] = {}  # token -> goes on, followed by a number, followed by a capital
        self.starts: Counter = Counter()
        self.long: Counter = Counter()  # (long token, next word)
        if _THAI.search(text):
            self._thai()
        self._scan()
        if last and text:
            self.sure.append(len(text))
        self.lower = Counter(_LOWER.findall(text[lo:hi]))
        self.mid = Counter(_MID.findall(text, lo, hi))

    def _thai(self) -> None:
        text = self.text
        for m in re.finditer(r"(?<=[฀-๿])(\s+)(?=[฀-๿])", text):
            before, after = text[max(0, m.start() - 6) : m.start()], text[m.end() : m.end() + 3]
            if text.startswith(THAI_ENDS, m.end()):
                continue
            if before.endswith(THAI_ENDS):
                self.sure.append(m.start())
                self.starts["@" + after] += self._own(m.start())
            else:
                self.doubt.append((m.start(), "thai", "@thai", "@" + after))

    def _scan(self) -> None:
        text, n = self.text, len(self.text)
        inside = spans(text)
        k, done = 0, 0
        for m in _STOP.finditer(text):
            at, e = m.start(), m.end()
            if at < done:
                continue
            while k < len(inside) and inside[k][1] < at:
                k += 1
            closed = False
            if k < len(inside) and inside[k][0] < at < inside[k][1]:
                close = inside[k][1]
                if text[inside[k][0]] in "([" or text[e:close].strip():
                    continue
                e, closed = close + 1, True
            # A stop right after a closing sign belongs to it, and further closing signs belong to the sentence.
            while e < n and (text[e] in STOPS or text[e] in "”’»›」』\"" and not text[e - 1].isspace() and text[e : e + 2].strip() != text[e : e + 2]):
                e += 1
            done = e
            self._judge(at, m.end(), e, closed)

    def _judge(self, at: int, stop_end: int, e: int, closed: bool) -> None:
        text, n = self.text, len(self.text)
        # The plain case first: a full stop, a blank, a capital.
        if e == at + 1 and not closed and text[at] == "." and e + 1 < n and text[e] == " " and text[e + 1].isupper():
            self._full_stop(at, e, e + 1, _WORD.match(text, e + 1)[0], True)
            return
        stop = text[at:stop_end]
        f = e
        while f < n and text[f].isspace():
            f += 1
        if f >= n:
            return  # the end of the text is an end of its own
        c = text[f]
        wide = stop[-1] in WIDE_STOPS
        if wide or (ord(c) >= 0x3040 and stop[-1] in "!?"):
            if closed and not (c in QUOTES and not ASCRIBED.search(text[f : f + 20])) and ASCRIBED.search(text[f : f + 20]):
                return
            if c in "、，；：,":
                return
            self.sure.append(e)
            return
        if stop[-1] in SCRIPT_STOPS:
            if c not in GO_ON:
                self.sure.append(e)
            return
        if f == e and not closed and c not in QUOTES and not (ord(c) >= 0x2E80):
            return  # 3.5, z.B.
        dots = stop == "…" or len(stop) > 1 and not stop.strip(". …")
        if c in GO_ON or c.islower():
            if stop == "." and not closed:
                self._note(at, 0, token_before(text, at))
            return
        g = f
        while g < n and (text[g] in _OPENERS or text[g].isspace()):
            g += 1
        w = _WORD.match(text, g)
        word = w[0] if w else ""
        if word and word[0].islower() and g > f:
            word = word.capitalize()
        if stop[-1] in "!?" or closed:
            self.sure.append(e)
            if word and not word[0].isdigit():
                self.starts[word] += self._own(e)
            return
        if dots:
            self.doubt.append((e, "dots", "…", word))
            return
        self._full_stop(at, e, g, word, stop == ".")

    def _full_stop(self, at: int, e: int, g: int, word: str, plain: bool) -> None:
        """Judge a full stop at `at`, whose sentence would end at e and after which `word` stands at g; plain: no other sign is with it."""
        text = self.text
        token = token_before(text, at)
        if not token:
            self.sure.append(e)
            return
        if _DEVANAGARI.search(token):
            return
        if len(token) == 1 and token.islower():
            if plain:
                self._note(at, 2, token)
            return  # d. J., z. B.
        if len(word) == 1 and word.isupper() and text[g + 1 : g + 2] == ".":
            word = ""  # an initial tells nothing
        number = word[:1].isdigit()
        if plain:
            self._note(at, 1 if number else 2, token)
        bare = token.rsplit(".", 1)[-1]
        if token.isdigit():
            if len(token) > 2 or text[max(0, at - len(token) - 12) : at - len(token)].rstrip().endswith("."):
                self.sure.append(e)
            else:
                self.doubt.append((e, "ordinal", "@1", word))
        elif len(token) == 1 and token.isupper():
            self.doubt.append((e, "initial", "@I", word))
        elif len(token) == 1 and not token.islower() and token.isalpha():
            self.doubt.append((e, "initial", token, word))  # a script without case
        elif _ROMAN.match(token) and len(token) > 1:
            self.doubt.append((e, "roman", "@R", word))
        else:
            self.doubt.append((e, "number" if number else "word", token, word))
            if len(bare) > 5 and "." not in token and word and not number:
                self.long[token, word] += self._own(e)

    def _note(self, at: int, how: int, token: str) -> None:
        """Count that a token with a full stop goes on in small letters (0), or stands before a number (1) or a capital (2)."""
        if token and not token.isdigit():
            if (counts := self.tokens.get(token)) is None:
                counts = self.tokens[token] = [0, 0, 0]
            counts[how] += self.lo <= at < self.hi

    def _own(self, p: int) -> bool:
        """Whether a place is the block's own and not its context's."""
        return self.lo < p <= self.hi

    def result(self, many: bool) -> tuple:
        """What JUDGED has of a block; many: the source has other blocks, which may ask for any word.

        Of a source of one block the document's evidence is all here, so doubts
        that it settles come out as ends or leave, and the others take it along.
        All words come out, since other sources may ask the corpus for any.
        """
        # What follows a long token begins a sentence, if the token is not seen to go on anywhere in the document.
        long = [(token, word, n) for (token, word), n in self.long.items() if n]
        if not many:
            for token, word, n in long:
                if not self.tokens.get(token, (0,))[0]:
                    self.starts[word] += n
            long = []
        doubt = [(e - self.lo, kind, token, word) for e, kind, token, word in self.doubt if self._own(e)]
        asked = {w for w in self.starts if w} | {d[3] for d in doubt if d[3] and not d[3][0].isdigit()}
        small = {w[0].upper() + w[1:]: n for w, n in self.lower.items() if len(w[0].upper()) == 1}
        words = asked | self.mid.keys() | small.keys()
        sure = {p - self.lo for p in self.sure if self._own(p)}
        begun: Counter = Counter()
        names: Counter = Counter()
        if many:
            left = [(*d, None, 0, 0, 0, 0) for d in doubt]
        else:
            begins = {w: self._begins(w, small.get(w, 0)) for w in asked}
            open_ones = []
            for d in doubt:
                e, kind, token, word = d
                b = begins.get(word, SILENT)
                begun[token] += b > NO_START
                names[token] += b == NO_START
                if kind == "number" or b == SILENT or (b == NO_START and kind == "word") or (b == ONLY_STARTS and kind not in ("dots", "thai")):
                    open_ones.append((*d, b))
                elif b > NO_START:
                    sure.add(e)
            left = [(*d, *self.tokens.get(d[2], (0, 0, 0)), begun[d[2]] if d[2] in self.tokens else 0) for d in open_ones]
        return (
            self.hi - self.lo,
            many,
            sorted(sure),
            left,
            [(t, a, b, c, begun[t], names[t]) for t, (a, b, c) in self.tokens.items()],
            [(w, self.starts[w], small.get(w, 0), self.mid[w], w in asked) for w in words],
            long,
        )

    def _begins(self, word: str, low: int) -> int:
        """What the document says of a word, as begins_in() does from its sums."""
        start, mid = self.starts[word], self.mid[word]
        if word[0] == "@":
            return BEGINS if start > 0 else SILENT
        if low > 0 and SMALL_TIMES * mid <= low:
            return BEGINS
        return NO_START if mid > 0 else ONLY_STARTS if start > 1 else SILENT


def judge_block(block: int, keys: list[int], texts: list[str], size: int = BLOCK) -> tuple:
    """keys and stripped texts of the block's records and of its context, in any order, possibly repeated.

    Rows without a key say that the source has other blocks (MANY), and that one of them comes after this (MORE).
    """
    said = {t for k, t in zip(keys, texts) if k is None}
    many, more = MANY in said, MORE in said
    once = {k: t for k, t in zip(keys, texts) if k is not None}
    parts, lo, hi, n = [], None, None, 0
    for key in sorted(once):
        own = key // size == block
        if own and lo is None:
            lo = n
        n += len(once[key]) + 1
        parts.append(once[key])
        if own:
            hi = n - 1
    if lo is None or hi is None:
        return (0, many, [], [], [], [], [])
    text = " ".join(parts)
    # Where the next record is too far to be seen, a block's end is an end if a terminator says so.
    return Block(text, lo, hi, hi == n - 1 and (not more or bool(_ENDED.search(text)))).result(many)


_INT, _TEXT = pa.int32(), pa.string()
JUDGED = pa.struct([
    ("size", pa.int64()), ("many", pa.bool_()), ("sure", pa.list_(_INT)),
    ("doubt", pa.list_(pa.struct([("e", _INT), ("kind", _TEXT), ("token", _TEXT), ("word", _TEXT), ("begins", _INT), ("on", _INT), ("num", _INT), ("cap", _INT), ("begun", _INT)]))),
    ("tokens", pa.list_(pa.struct([("token", _TEXT), ("on", _INT), ("num", _INT), ("cap", _INT), ("begun", _INT), ("names", _INT)]))),
    ("words", pa.list_(pa.struct([("word", _TEXT), ("start", _INT), ("low", _INT), ("mid", _INT), ("asked", pa.bool_())]))),
    ("long", pa.list_(pa.struct([("token", _TEXT), ("word", _TEXT), ("n", _INT)]))),
])
JUDGED_DDL = (
    "struct<size:long,many:boolean,sure:array<int>,doubt:array<struct<e:int,kind:string,token:string,word:string,begins:int,on:int,num:int,cap:int,begun:int>>,"
    "tokens:array<struct<token:string,on:int,num:int,cap:int,begun:int,names:int>>,words:array<struct<word:string,start:int,low:int,mid:int,asked:boolean>>,"
    "long:array<struct<token:string,word:string,n:int>>>"
)


def begins_in():
    """What a document says of a word by its sums d_start, d_low and d_mid."""
    return (
        F.when(F.col("word").startswith("@"), F.when(F.col("d_start") > 0, BEGINS).otherwise(SILENT))
        .when((F.col("d_low") > 0) & (SMALL_TIMES * F.col("d_mid") <= F.col("d_low")), BEGINS)
        .when(F.col("d_mid") > 0, NO_START).when(F.col("d_start") > 1, ONLY_STARTS).otherwise(SILENT)
    )


def sentence_ends(records: DataFrame, size: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """(origin, source_id, end_pos) of the sentences of records (origin, source_id, key, text); size: keys in a block."""

    def judge(block: pa.Array, keys: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([judge_block(*row, size) for row in zip(block.to_pylist(), keys.to_pylist(), texts.to_pylist())], JUDGED)

    texts = records.where("source_id is not null and key is not null and text is not null").withColumn("key", F.col("key").cast("long"))
    place = F.pmod("key", F.lit(size))
    block = F.floor((F.col("key") - place) / size)
    blocks = F.array_compact(F.array(block, F.when(place >= size - context, block + 1), F.when(place < context, block - 1)))
    stripped = texts.select("origin", "source_id", "key", F.trim("text", F.lit(WHITE)).alias("text")).where("text <> ''")
    spread = stripped.select("origin", "source_id", F.explode(blocks).alias("block"), "key", "text")
    # Blocks of sources that have several are told so, and whether one comes after them, by rows without a key.
    several = texts.where(block != 0).select("origin", "source_id", block.alias("block")).distinct()
    several = several.unionByName(several.select("origin", "source_id", F.lit(0).cast("long").alias("block"))).distinct()
    last = several.groupBy("origin", "source_id").agg(F.max("block").alias("last"))
    signs = F.when(F.col("block") < F.col("last"), F.array(F.lit(MANY), F.lit(MORE))).otherwise(F.array(F.lit(MANY)))
    told = several.join(last, ["origin", "source_id"]).select("origin", "source_id", "block", F.lit(None).cast("long").alias("key"), F.explode(signs).alias("text"))
    spread = spread.unionByName(told)
    grouped = spread.groupBy("origin", "source_id", "block").agg(F.collect_list(F.struct("key", "text")).alias("rows"))
    judged = cut(grouped.select("origin", "source_id", "block", F.arrow_udf(judge, JUDGED_DDL)(F.col("block"), F.col("rows.key"), F.col("rows.text")).alias("j")).select("origin", "source_id", "block", "j.*"))
    judged = judged.where("size > 0")  # not before: a filter below would have the blocks judged twice
    # Where a block begins in its source's text: the sizes before it and the blanks between.
    before = Window.partitionBy("origin", "source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = judged.withColumn("offset", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)))
    source = ["origin", "source_id"]
    words = judged.select(*source, "many", F.explode("words").alias("w")).select(*source, "many", "w.*")
    tokens = judged.select(*source, "many", F.explode("tokens").alias("t")).select(*source, "many", "t.*")
    doubt = placed.select(*source, "many", "offset", F.explode("doubt").alias("d")).select(*source, "many", "offset", "d.*")
    counted = tokens.where("many").groupBy(*source, "token").agg(*[F.sum(c).alias(c) for c in ("on", "num", "cap")])
    long = judged.select(*source, "many", F.explode("long").alias("l")).select(*source, "many", "l.*")
    long = long.groupBy(*source, "many", "token", "word").agg(F.sum("n").alias("start")).join(counted.where("on > 0"), [*source, "token"], "left_anti")
    words = words.unionByName(long.select(*source, "many", "word", "start", F.lit(0).alias("low"), F.lit(0).alias("mid"), F.lit(True).alias("asked")))
    # Over the corpus, every block counts, whether it asks for the word or not. Small letters count once for each block, as a block of any text has the common words.
    all_words = words.groupBy("word").agg(F.sum("start").alias("c_start"), F.sum((F.col("low") > 0).cast("int")).alias("c_low"), F.sum("mid").alias("c_mid"))
    # Sources of several blocks: the blocks' counts are added up, and the doubts get them by joins.
    sums = words.where("many").groupBy(*source, "word").agg(*[F.sum(c).alias(f"d_{c}") for c in ("start", "low", "mid")], F.bool_or("asked").alias("asked")).where("asked")
    asking = doubt.where("many").select(*source, "offset", "e", "kind", "token", "word").join(sums.select(*source, "word", begins_in().alias("begins")), [*source, "word"], "left")
    asking = cut(asking.withColumn("begins", F.coalesce("begins", F.lit(SILENT))))
    after = asking.groupBy(*source, "token").agg(F.sum((F.col("begins") > NO_START).cast("int")).alias("begun"), F.sum((F.col("begins") == NO_START).cast("int")).alias("names"))
    joint = counted.join(after, [*source, "token"], "left")
    fields = [*source, "offset", "e", "kind", "token", "word", "begins", "on", "num", "cap", "begun"]
    doubts = doubt.where("not many").select(fields).unionByName(asking.join(joint.drop("names"), [*source, "token"], "left").select(fields))
    counts = ("on", "num", "cap", "begun", "names")
    all_tokens = tokens.where("not many").select("token", *counts).unionByName(joint.select("token", *counts)).groupBy("token")
    all_tokens = all_tokens.agg(*[F.sum(c).alias(f"c_{c}") for c in ("on", "num", "cap", "names")], F.sum("begun").alias("c_begins"))
    both = doubts.join(all_words, "word", "left").join(all_tokens, "token", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # Names begin sentences too: after what names follow, only words that are also written small count.
    common = F.when(F.col("begins").isin(NO_START, BEGINS), F.col("begins") == BEGINS).otherwise((zero("c_low") > 0) & (3 * zero("c_low") > zero("c_mid")))
    begins = F.when(F.col("begins") > SILENT, F.col("begins") > NO_START).otherwise(zero("c_start") + zero("c_low") > 3 * zero("c_mid"))
    # A number after a word counts as going on.
    goes_on = zero("on") + F.when(F.col("kind") == "word", zero("num")).otherwise(0)
    c_continued = (zero("c_on") + zero("c_num")) / F.greatest(F.lit(1), zero("c_on") + zero("c_num") + zero("c_cap"))
    continued = F.when(goes_on > 0, goes_on / (goes_on + zero("cap"))).otherwise(c_continued)
    contradicted = zero("c_begins") >= BEFORE_NAMES * F.greatest(F.lit(1), zero("c_cap"))
    abbreviation = (continued >= ABBREVIATION) | (F.col("token").isin(*TITLES) & ~contradicted) | ((zero("c_cap") >= ENOUGH) & ((zero("c_names") >= BEFORE_NAMES * zero("c_cap")) | F.col("token").contains(".")) & (zero("c_begins") < BEFORE_NAMES * zero("c_cap")))
    # Where the corpus has the token as a common word, it tells nothing of what the document's abbreviation does.
    own = (zero("on") > 0) & (c_continued < ABBREVIATION)
    ends_too = F.when(own, zero("begun") >= ENDS_TOO * F.greatest(F.lit(1), zero("cap"))).otherwise(zero("c_begins") >= ENDS_TOO * F.greatest(F.lit(1), zero("c_cap")))
    is_end = (
        F.when(F.col("kind") == "thai", begins)
        .when(F.col("kind") == "dots", begins)
        .when(F.col("kind").isin("ordinal", "initial", "roman"), common)
        .when(F.col("kind") == "number", (zero("c_on") + zero("c_num") < ABBREVIATION * (zero("c_on") + zero("c_num") + zero("c_cap"))) | (F.col("token") == ""))
        .otherwise(~abbreviation | common | ends_too)
    )
    sure = placed.select("origin", "source_id", "offset", F.explode("sure").alias("e"))
    ends = sure.unionByName(both.where(is_end).select("origin", "source_id", "offset", "e"))
    return ends.select("origin", "source_id", (F.col("offset") + F.col("e")).cast("long").alias("end_pos"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "segments").select(F.lit("segments").alias("origin"), "source_id", F.col("seg_id").alias("key"), "text")
    sen = table(spark, sf_dir, "sentences").select(F.lit("sentences").alias("origin"), "source_id", F.col("pos").alias("key"), "text")
    return seg.unionByName(sen)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_ends(_records(spark, sf_dir))
