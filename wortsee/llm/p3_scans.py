"""Problem 3: noise in text from scanned pages.

1. Page edges: the outermost lines of each page are brought to a form in which
   misread characters, spacing and leader dots make no difference. Lines whose
   form returns at the edges of other pages of the book, or is the title of the
   chapter or book, are running heads, and so are title-like lines whose form is
   near one of these by the letter pairs that they share. Numbers at page edges are furniture if
   they count along with the pages: their distance to the page is the one most
   frequent in the book, or one that several pages share. A scan converted
   without page divs is known by its lines, which are filled up to one width
   and run on; its pages are found by the numbers that count up across the text
   and by lines that stand outside of its flow.
2. What remains is joined to paragraphs across lines and pages. Whether a hyphen
   at a line end belongs to the word is decided by the vocabulary of the corpus.
3. Words that share a form under the classes of confusable characters are
   compared over the whole corpus: a rare one that turns into a frequent one by
   undoing misreadings is misread. Vocabulary and confusions are tables that are
   joined, not broadcast.

Defined results: null and empty html, and clean markup, make no case; a
null book or title only takes away that evidence; redelivered chapters count
once; a chapter without text has an empty list of paragraphs.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, once, table

#: Lines at the head and at the foot of a page that may be furniture.
HEAD_LINES, FOOT_LINES = 2, 2
#: Pages of a book on whose edges a line returns to be a running head without being a title.
MIN_PAGES = 2
#: Likeness from which a line is a head that returns with misreadings of other kinds, and letters that it has at least.
NEAR, NEAR_LETTERS = 0.8, 8
#: A word is misread if the word it comes from is so many times as frequent.
TIMES = 5
HYPHENS = "-‐‑¬=\xad"
#: Lines of a scan are no longer than this; so many that run on and are filled, and such a share of its lines and of those that run on, make a scan without page divs.
LONGEST, MIN_WRAPPED, SHARE_OF_LINES, SHARE_OF_RUNS = 160, 2, 0.1, 0.6
#: Lines that each page left out between two page numbers has at least; candidates before a number that are looked at as its predecessor.
LEAST_LINES, LOOK_BACK = 5, 64

# How scanners misread (as it should read -> as read).
MISREADINGS = (
    ("e", "c"), ("c", "e"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("g", "q"), ("q", "g"), ("i", "í"), ("l", "1"), ("l", "|"), ("l", "I"), ("I", "l"), ("I", "1"), ("I", "|"), ("i", "1"), ("i", "l"), ("o", "0"), ("O", "0"), ("S", "5"), ("s", "5"), ("B", "8"), ("ü", "ii"), ("ü", "u"), ("ä", "a"), ("ö", "o"), ("Ü", "U"), ("Ä", "A"), ("Ö", "O"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("W", "VV"), ("d", "cl"), ("k", "lc"), ("r", "r'"), ("ß", "B"), ("ss", "ß"),
)
#: Words after which a hyphen before a line end stands for a left-out part.
SUSPENDED = frozenset("und oder bzw sowie wie bis noch als".split())
#: Closed forms of the classes of confusable characters; longer ones read as several.
FORMS = str.maketrans({
    "e": "c", "d": "ci", "n": "ii", "u": "ii", "ü": "ii", "m": "rii", "b": "h", "t": "f", "g": "q", "í": "i", "l": "i", "1": "i", "|": "i", "I": "i", "0": "o", "ö": "o", "O": "o", "Ö": "o", "ä": "a", "Ä": "A", "Ü": "U", "w": "vv", "W": "VV", "k": "ic", "5": "S", "s": "S", "ß": "SS", "8": "B", "'": "", "\xad": "",
})
STRIP = ".,;:!?…„“”\"»«›‹‚‘’()[]{}–—*/&" + " \xa0"

_PAGE = re.compile(r"<div\b[^>]*\bclass=[\"'](?:pg|page)[\"'][^>]*>", re.I)
_PAGE_NO = re.compile(r"\bid=[\"']\D*(\d+)[\"']", re.I)
_BLOCK = re.compile(r"<(/?)(p|div|h[1-6]|li|blockquote|section)\b([^>]*)>", re.I)
_BREAK = re.compile(r"<br\b[^>]*>|\n", re.I)
_TAGS = re.compile(r"<[^>]*>")
_ROMAN = re.compile(r"^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_NUMBER = re.compile(r"^[\[(–—\-\s.*]*(?:(?:seite|page|s\.|p\.)\s*)?([0-9lIOoSB|]{1,5}|[ivxlcdm]{1,9})[\])–—\-\s.*]*$", re.I)
_NUMBER_FIRST = re.compile(r"^([\[(–—\-]*\s*(?:(?:seite|page)\s*)?(?:[0-9lIO|]{1,5}|[ivxlcdm]{1,9})\s*[\])–—\-]*)\s+(\S.*)$", re.I)
_NUMBER_LAST = re.compile(r"^(.*\S)\s+([\[(–—\-]*\s*(?:(?:seite|page)\s*)?(?:[0-9lIO|]{1,5}|[ivxlcdm]{1,9})\s*[\])–—\-]*)$", re.I)
_NUMERALS = frozenset("0123456789lio|vxcdmsb")
_LEADERS = re.compile(r"[\s.…·_]{2,}$|^[\s.…·_]{2,}")
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "B": "8"})


@lru_cache(maxsize=200_000)
def form(word: str) -> str:
    """The form that a word shares with all it can be misread as."""
    return word.translate(FORMS)


@lru_cache(maxsize=50_000)
def line_form(line: str) -> str:
    """Form of a line: letters only, case-folded, misreadings undone."""
    return form("".join(c for c in _LEADERS.sub("", line) if c.isalnum() or c in "|'").lower()).lower()


def roman(text: str) -> int | None:
    if not text or not _ROMAN.match(text):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(text, text[1:] + " "):
        total += -value[a] if b in value and value[b] > value[a] else value[a]
    return total


def numbers_of(text: str) -> list[tuple[str, int]]:
    """Readings (arabic or roman, value) of a line or part of a line that is only a page number."""
    m = _NUMBER.match(text)
    if not m:
        return []
    said, out = m[1], []
    digits = said.translate(_DIGITS)
    if digits.isdecimal() and any(c.isdecimal() for c in said):
        out.append(("a", int(digits)))
    if (v := roman(said.lower())) is not None:
        out.append(("r", v))
    return out


def _may_count(token: str) -> bool:
    """Whether a line's first or last token can be of a page number: its signs only, or the word or sign beside it."""
    bare = token.strip("[]()–—-.*").lower()
    return not bare or bare in ("seite", "page", "s", "p") or _NUMERALS.issuperset(bare)


def parts_of(line: str) -> list[tuple[str, str]]:
    """Ways to read a line as (number, text)."""
    tokens = line.split()
    line = " ".join(tokens)
    if not tokens or not (_may_count(tokens[0]) or _may_count(tokens[-1])):
        return [("", line)]
    if numbers_of(line):
        return [(line, "")]
    out = []
    for m, number, text in ((_NUMBER_FIRST.match(line), 1, 2), (_NUMBER_LAST.match(line), 2, 1)):
        if m and numbers_of(m[number]):
            out.append((m[number], m[text]))
    return [*out, ("", line)]


def _said(raw: str) -> str:
    """Text of a piece of markup."""
    text = _TAGS.sub("", raw) if "<" in raw else raw
    return html_lib.unescape(text) if "&" in text else text


def pages(markup: str) -> list[tuple[int, list[tuple[str, bool]]]]:
    """Pages as (number, lines); a line is its text and whether a paragraph may begin with it."""
    marks = list(_PAGE.finditer(markup))
    indented = 'class="in"' in markup
    out = []
    for k, m in enumerate(marks):
        body = markup[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(markup)]
        no = _PAGE_NO.search(m[0])
        lines: list[tuple[str, bool]] = []
        pos, starts = 0, True
        for b in [*_BLOCK.finditer(body), None]:
            chunk = body[pos : b.start() if b else len(body)]
            for raw in _BREAK.split(chunk) if chunk and not chunk.isspace() else ():
                text = _said(raw).strip()
                if text:
                    lines.append((text, starts))
                    starts = False
            if b:
                pos = b.end()
                if not b[1]:
                    starts = 'class="in"' in b[3] if indented else True
        out.append((int(no[1]) if no else k, lines))
    return out


def flat_lines(markup: str) -> list[tuple[str, bool]]:
    """Lines of markup without page divs: the text, and whether it is indented."""
    out, pos, classed = [], 0, False
    for b in [*_BLOCK.finditer(markup), None]:
        chunk = markup[pos : b.start() if b else len(markup)]
        for k, raw in enumerate(_BREAK.split(chunk) if chunk and not chunk.isspace() else ()):
            said = _said(raw)
            if text := said.strip():
                out.append((text, classed or (k > 0 and said[0].isspace())))
                classed = False
        if b:
            pos = b.end()
            classed = not b[1] and 'class="in"' in b[3]
    return out


_ENDED = re.compile(r"[.!?…:][\"»«“”‘’›‹)\]]*$")


def wrapped(lines: list[tuple[str, bool]]) -> tuple[int, int, int, int]:
    """Of lines: how many run on in small letters, how many of these are filled, the width up to which, and the pairs of lines."""
    if len(lines) < 2 or max(len(t) for t, _ in lines) > LONGEST:
        return 0, 0, 0, max(0, len(lines) - 1)
    runs = [(a, b) for (a, _), (b, _) in zip(lines, lines[1:]) if b[0].islower() and not _ENDED.search(a)]
    width = max((len(a) for a, _ in runs), default=0)
    return len(runs), sum(len(a) + 1 + len(b.split()[0]) >= width for a, b in runs), width, len(lines) - 1


def _heading(text: str) -> bool:
    """Whether a line may be a running head; spaced letters count as words of their own not."""
    return bool(text) and not _sentence_like(text) and not text[0].islower() and sum(len(w) > 1 for w in text.split()) <= 8 and any(c.isalpha() for c in text)


def _capitals(text: str) -> bool:
    """Whether a line is set in capitals, spaced or not."""
    return sum(c.isalpha() for c in text) > 3 and text.upper() == text


def counting(lines: list[tuple[str, bool]], unfilled: list[bool]) -> set[int]:
    """Places of the lines with a page number: of those with a number the chain that counts up with the lines."""
    found: list[tuple[int, str, int, int]] = []  # place, kind, value, weight
    for i, (text, indented) in enumerate(lines):
        if indented:
            continue
        for number, rest in parts_of(text):
            # The last line of a paragraph may be a number too, but has a full stop.
            if not number or (not rest and text[-1] in ".,") or (rest and not _heading(rest)):
                continue
            marked = unfilled[i] or _capitals(rest) or bool(_LEADERS.search(rest)) or bool(re.match(r"(?i)\W*(?:seite|page)\b", number))
            found += [(i, kind, value, 3 if not rest else 2 if marked else 1) for kind, value in numbers_of(number)]
    best: list[tuple[int, int]] = []  # weight of the chain that ends here, its place before
    for j, (at, kind, value, weight) in enumerate(found):
        most, back = 0, -1
        for k in range(max(0, j - LOOK_BACK), j):
            at_k, kind_k, value_k, weight_k = found[k]
            follows = kind == kind_k and 0 < value - value_k and at - at_k > LEAST_LINES * (value - value_k - 1)
            # Numbers may start anew, or turn from roman to arabic, on lines of their own.
            anew = not follows and at > at_k and ((kind_k, kind) == ("r", "a") or (kind == kind_k and value < value_k and weight == weight_k == 3))
            if (follows or anew) and best[k][0] - 2 * anew > most:
                most, back = best[k][0] - 2 * anew, k
        best.append((weight + most, back))
    chain: set[int] = set()
    if found:
        j = max(range(len(found)), key=lambda k: (best[k][0], -k))
        if best[j][0] > 1:
            while j >= 0:
                chain.add(found[j][0])
                j = best[j][1]
    return chain


def inferred(markup: str) -> tuple[list[tuple[int, list[tuple[str, bool]]]], set[tuple[int, int]]]:
    """Pages of a scan without page divs as pages() has them, and (page's place, line's place) of the page numbers."""
    lines = flat_lines(markup)
    width = wrapped(lines)[2] or max((len(t) for t, _ in lines), default=0)
    room = lambda i, after: len(lines[i][0]) + 1 + len(after.split()[0]) < width - 1 if after else True
    numbers = counting(lines, [room(i, lines[i + 1][0] if i + 1 < len(lines) else "") for i in range(len(lines))])
    # Lines outside of the flow, from the end on: what follows a line is the next line of the text.
    outside, after = set(numbers), ""
    for i in range(len(lines) - 1, -1, -1):
        text, indented = lines[i]
        if i in numbers:
            continue
        if not indented and _heading(text) and (room(i, after) or _capitals(text) or (i - 1 in numbers and _LEADERS.search(text))):
            outside.add(i)
        else:
            after = text
    cuts = {0}
    for i in sorted(outside):
        if i - 1 not in outside:
            m = 1
            while i + m in outside:
                m += 1
            cuts.add(i + max(0, m - HEAD_LINES) if i else 0)
    indents = any(indented for _, indented in lines)
    starts = [ind if indents else i == 0 or bool(_ENDED.search(lines[i - 1][0]) and room(i - 1, t)) for i, (t, ind) in enumerate(lines)]
    # Pages without a number have negative ones, which differ between chapters.
    unknown = zlib.crc32(markup.encode("utf-8", "replace")) % 2_000_000 * 1000
    edges = [*sorted(cuts), len(lines)]
    out, places = [], set()
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        said = [v for i in range(a, b) if i in numbers for n, _ in parts_of(lines[i][0]) if n for _, v in numbers_of(n)]
        out.append((said[0] if said else -1 - unknown - k % 1000, [(lines[i][0], starts[i]) for i in range(a, b)]))
        places |= {(k, i - a) for i in range(a, b) if i in numbers}
    return out, places


def edge_places(n: int) -> list[int]:
    """Places of a page's n lines that may be furniture."""
    return sorted({*range(min(HEAD_LINES, n)), *range(max(0, n - FOOT_LINES), n)})


def edges_of(markup: str | None) -> list[dict]:
    """Evidence of a chapter's page edges: forms of texts, and distances of numbers to their page."""
    out = []
    paged = bool(_PAGE.search(markup or ""))
    for no, lines in pages(markup) if paged else inferred(markup or "")[0]:
        for at in edge_places(len(lines)):
            for number, text in parts_of(lines[at][0]):
                for kind, value in numbers_of(number) if number and paged else ():
                    out.append({"what": kind, "value": str(value - no), "page": no})
                if text and (number or not _sentence_like(text)):
                    out.append({"what": "t", "value": line_form(text), "page": no})
    return out


_SENTENCE = re.compile(r"(?<![\s.…])[.!?:;,“”«»‘’‹›]$|[" + HYPHENS + r"]$|[,;!?„»«]")


def _sentence_like(text: str) -> bool:
    """Whether a line ends or goes on as a sentence does: not so a head, which may end with leaders."""
    return bool(_SENTENCE.search(text))


@lru_cache(maxsize=50_000)
def _pairs(shape: str) -> frozenset[str]:
    return frozenset(a + b for a, b in zip(shape, shape[1:]))


def near_one(shape: str, shapes: set[str]) -> bool:
    """Whether a line's form is all but one of these: of like length, and alike by the Dice coefficient of their letter pairs."""
    if len(shape) < NEAR_LETTERS:
        return False
    mine = _pairs(shape)
    return any(abs(len(shape) - len(s)) <= 2 and 2 * len(mine & (p := _pairs(s))) >= NEAR * (len(mine) + len(p)) for s in shapes if len(s) >= NEAR_LETTERS)


def _title_like(text: str) -> bool:
    """Whether a line may be a head that was never seen before: few words, the first capital, no sentence."""
    return not _sentence_like(text) and len(text.split()) <= 8 and not text[:1].islower()


def furniture(markup: str, titles: list[str | None], heads: list[str], distances: list[str]) -> tuple[list[tuple[int, list[tuple[str, bool]]]], list[str]]:
    """Pages without their furniture, and the lines removed."""
    title_forms = {line_form(t) for t in titles if t} - {""}
    heads_set, known = set(heads), set(distances)
    kept, removed = [], []
    paged = bool(_PAGE.search(markup))
    found, places = (pages(markup), set()) if paged else inferred(markup)
    for k, (no, lines) in enumerate(found):
        n, sure, numbered = len(lines), set(), set()
        for at in edge_places(n):
            for number, text in parts_of(lines[at][0]):
                counts = bool(number) and (any(f"{kind}{v - no}" in known for kind, v in numbers_of(number)) if paged else (k, at) in places)
                shape = line_form(text)
                head = bool(shape) and (shape in title_forms or (shape in heads_set and not _sentence_like(text)) or (_title_like(text) and near_one(shape, title_forms | heads_set)))
                if counts and not text:
                    sure.add(at)
                    numbered.add(at)
                elif counts and (head or (at in (0, n - 1) and _title_like(text)) or not paged):
                    sure.add(at)
                elif head and not number:
                    sure.add(at)
        # Furniture reaches inwards from the edge without a gap; nothing of the text stands outside of a page number.
        drop: set[int] = set()
        for order in (range(min(HEAD_LINES, n)), range(n - 1, max(-1, n - 1 - FOOT_LINES), -1)):
            inmost = -1
            for depth, at in enumerate(order):
                outside_titles = all(o in sure or _title_like(lines[o][0]) for o in list(order)[:depth])
                if at in sure and (depth == inmost + 1 or (at in numbered and outside_titles)):
                    inmost = depth
            drop |= set(list(order)[: inmost + 1])
        removed += [" ".join(lines[at][0].split()) for at in sorted(drop)]
        kept.append((no, [line for i, line in enumerate(lines) if i not in drop]))
    return kept, removed


@lru_cache(maxsize=200_000)
def core(token: str) -> tuple[str, str, str]:
    """Punctuation before, word, punctuation after."""
    a = token.lstrip(STRIP)
    b = a.rstrip(STRIP)
    return token[: len(token) - len(a)], b, a[len(b) :]


def paragraphs(kept: list[tuple[int, list[tuple[str, bool]]]]) -> list[list[tuple[str, str]]]:
    """Paragraphs as tokens (token, ''), or (first part, second part) where a line end breaks a word."""
    out: list[list[tuple[str, str]]] = []
    for _, lines in kept:
        for i, (text, starts) in enumerate(lines):
            tokens = text.split()
            if not tokens:
                continue
            open_end = bool(out and out[-1]) and not re.search(r"[.!?…][\"»«“”‘’›‹)\]]*$", "".join(out[-1][-1]))
            broken = bool(out and out[-1]) and out[-1][-1][1] == "" and len(out[-1][-1][0]) > 1 and out[-1][-1][0][-1] in HYPHENS and out[-1][-1][0][-2].isalnum()
            if out and (not starts or (i == 0 and open_end) or broken):
                if broken:
                    out[-1][-1] = (out[-1][-1][0], tokens[0])
                    tokens = tokens[1:]
                out[-1] += [(t, "") for t in tokens]
            else:
                out.append([(t, "") for t in tokens])
    return out


def break_forms(a: str, b: str) -> tuple[str, str, str, str]:
    """Of a broken word: the word as one, the word with its hyphen, what stands before, what after."""
    before, left, _ = core(a[:-1])
    _, right, after = core(b)
    return left + right, f"{left}-{right}", before, after


def read_scan(markup: str | None, titles: list[str | None], heads: list[str], distances: list[str]) -> dict:
    """What a scanned chapter gives: lines removed, word counts and broken words."""
    if not markup:
        return {"removed": [], "words": [], "breaks": []}
    kept, removed = furniture(markup, titles, heads, distances)
    tokens: Counter = Counter(t for paragraph in paragraphs(kept) for t in paragraph)
    breaks = [t for t in tokens if t[1]]
    made = []
    for a, b in sorted(breaks):
        one, hyphened, *_ = break_forms(a, b)
        made.append({"a": a, "b": b, "one": one, "hyphened": hyphened})
    return {"removed": removed, "words": _word_counts((a, n) for (a, b), n in tokens.items() if not b), "breaks": made}


def clean_words(markup: str | None) -> dict:
    tokens = Counter(html_lib.unescape(_TAGS.sub(" ", markup or "")).split())
    return {"removed": [], "words": _word_counts(tokens.items()), "breaks": []}


def _word_counts(tokens: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """Words of tokens without adjoining punctuation, with their counts."""
    words: Counter = Counter()
    for token, n in tokens:
        if w := core(token)[1]:
            words[w] += n
    return list(words.items())


@lru_cache(maxsize=100_000)
def explains(right: str, wrong: str) -> int:
    """Number of misreadings that turn one word into the other, 0 if they don't or the words are equal."""
    if right == wrong or abs(len(right) - len(wrong)) > 4:
        return 0
    states: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(right) + 1):
        for (x, j), n in sorted(s for s in states.items() if s[0][0] == i):
            if i < len(right) and j < len(wrong) and right[i] == wrong[j]:
                key = (i + 1, j + 1)
                states[key] = min(states.get(key, 99), n)
            for a, b in MISREADINGS:
                if right.startswith(a, i) and wrong.startswith(b, j):
                    key = (i + len(a), j + len(b))
                    states[key] = min(states.get(key, 99), n + 1)
    return states.get((len(right), len(wrong)), 0)


def odd(word: str) -> bool:
    """Whether a word has signs that no word has."""
    return bool(re.search(r"[^\W\d_][01589|'](?=[^\W\d_]|$)|(?:^|[^\w])[158|0](?=[^\W\d_]{2})|í|vv|[a-z]\|", word)) and any(c.isalpha() for c in word)


def corrections(members: list[tuple[str, int]]) -> list[tuple[str, int, str, int]]:
    """For each word of a form and its count: the word, its count, the word as it should read, that word's count.

    Only words without odd signs are held against a word, the frequent ones
    first and no further than they are frequent enough; of a form there are few
    of these, however many misreadings it has.
    """
    rights = sorted(((w, n) for w, n in members if n and not odd(w)), key=lambda m: (-m[1], m[0]))
    out = []
    for word, n in members:
        best, best_n = word, n
        strange = odd(word)
        if rights and (strange or sum(c.isalpha() for c in word) >= 2):
            least = max(1, n) if strange else max(2, TIMES * n, n + 1)
            most = max(1, len(word) // 3)
            for right, m in rights:
                if m < least:
                    break
                if 0 < explains(right, word) <= most:
                    best, best_n = right, m
                    break
        out.append((word, n, best, best_n))
    return out


READ = "struct<removed:array<string>,words:array<struct<word:string,n:int>>,breaks:array<struct<a:string,b:string,one:string,hyphened:string>>>"
_READ = pa.struct([
    ("removed", pa.list_(pa.string())),
    ("words", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))),
    ("breaks", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("one", pa.string()), ("hyphened", pa.string())]))),
])
CORRECTED = "array<struct<word:string,n:long,right:string,n_right:long>>"
LOOKED = "struct<paged:boolean,short:boolean,runs:int,filled:int,pairs:int,edges:array<struct<what:string,value:string,page:int>>>"
_LOOKED = pa.struct([
    ("paged", pa.bool_()), ("short", pa.bool_()), ("runs", pa.int32()), ("filled", pa.int32()), ("pairs", pa.int32()),
    ("edges", pa.list_(pa.struct([("what", pa.string()), ("value", pa.string()), ("page", pa.int32())]))),
])


def look(markup: str) -> dict:
    """What a chapter's layout tells: page divs, only short lines, counts of wrapped lines; evidence of its page edges if it may be a scan."""
    paged = bool(_PAGE.search(markup))
    lines = [] if paged else flat_lines(markup)
    short = bool(lines) and max(len(t) for t, _ in lines) <= LONGEST
    runs, filled, _, pairs = wrapped(lines)
    return {"paged": paged, "short": short, "runs": runs, "filled": filled, "pairs": pairs, "edges": edges_of(markup) if paged or short else []}


def _look(markup: pa.Array) -> pa.Array:
    return pa.array([look(m) for m in markup.to_pylist()], _LOOKED)


def _read(scan: pa.Array, markup: pa.Array, title: pa.Array, book: pa.Array, heads: pa.Array, distances: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (scan, markup, title, book, heads, distances)))
    return pa.array([read_scan(m, [t, b], h or [], d or []) if s else clean_words(m) for s, m, t, b, h, d in rows], _READ)


def _corrections(members: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64()), ("right", pa.string()), ("n_right", pa.int64())]))
    names = ("word", "n", "right", "n_right")
    return pa.array([[dict(zip(names, c)) for c in corrections([(m["word"], m["n"]) for m in ms])] for ms in members.to_pylist()], kind)


def _form(word: pa.Array) -> pa.Array:
    return pa.array([form(w) for w in word.to_pylist()], pa.string())


def furniture_evidence(edges: DataFrame) -> DataFrame:
    """For each book: the forms that return at page edges, and the distance of its page numbers."""
    edges = edges.where("source_id is not null").select("source_id", F.explode("edges").alias("e")).select("source_id", "e.*").where("value <> ''")
    counted = edges.groupBy("source_id", "what", "value").agg(F.countDistinct("page").alias("pages"))
    heads = F.collect_list(F.when((F.col("what") == "t") & (F.col("pages") >= MIN_PAGES), F.col("value")))
    # The most frequent distance counts even on one page, which may be the book's only one.
    number = F.concat("what", "value")
    best = F.max_by(number, F.when(F.col("what") != "t", F.struct("pages", "what", "value")))
    # Numbers may start anew within a book, so each distance that pages share counts.
    shared = F.collect_list(F.when((F.col("what") != "t") & (F.col("pages") >= MIN_PAGES), number))
    return counted.groupBy("source_id").agg(heads.alias("heads"), F.array_compact(F.array_append(shared, best)).alias("distances"))


def _wraps(runs: str, filled: str, pairs: str):
    return (F.col(filled) >= MIN_WRAPPED) & (F.col(filled) >= SHARE_OF_LINES * F.col(pairs)) & (F.col(filled) >= SHARE_OF_RUNS * F.col(runs))


def prepare(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """(chapter_id, html, title, book, scan, heads, distances) of every chapter."""
    once_each = once(chapters.where("html is not null"), ["chapter_id"], ["source_id", "title", "html"])
    looked = cut(once_each.select("chapter_id", "source_id", F.arrow_udf(_look, LOOKED)(F.col("html")).alias("l")).select("chapter_id", "source_id", "l.*"))
    # A chapter of a few lines shows no layout of its own: then that of its book counts.
    sums = looked.where("short and source_id is not null").groupBy("source_id").agg(*[F.sum(c).alias(f"b_{c}") for c in ("runs", "filled", "pairs")])
    book_wraps = sums.select("source_id", _wraps("b_runs", "b_filled", "b_pairs").alias("wraps"))
    # Whether it has page divs was seen; lines alone make a scan only where all of them are short.
    is_scan = F.col("paged") | (F.col("short") & (_wraps("runs", "filled", "pairs") | F.coalesce(F.col("wraps"), F.lit(False))))
    flags = looked.join(book_wraps, "source_id", "left").select("chapter_id", "source_id", "edges", is_scan.alias("scan"))
    evidence = furniture_evidence(flags.where("scan"))
    books = once(sources, ["source_id"], ["title"]).withColumnRenamed("title", "book")
    told = flags.drop("edges").join(books, "source_id", "left").join(evidence, "source_id", "left").drop("source_id")
    return once_each.drop("source_id").join(told, "chapter_id")


def scan_tables(chapters: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters as read, words): words has word, n, right and n_right for every word of the corpus and every form of a broken word."""
    return read_tables(prepare(chapters, sources))


def read_tables(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scan_tables() of what prepare() gives."""
    got = cut(prepared.select("chapter_id", "scan", F.arrow_udf(_read, READ)("scan", "html", "title", "book", "heads", "distances").alias("read")).select("chapter_id", "read.*", "scan"))
    said = got.select(F.explode("words").alias("w")).select("w.word", F.col("w.n").cast("long").alias("n"))
    broken = got.select(F.explode("breaks").alias("b"))
    forms = broken.select(F.explode(F.array("b.one", "b.hyphened")).alias("word"), F.lit(0).cast("long").alias("n"))
    counts = said.unionByName(forms).groupBy("word").agg(F.sum("n").alias("n"))
    groups = counts.groupBy(F.arrow_udf(_form, "string")(F.col("word")).alias("form")).agg(F.collect_list(F.struct("word", "n")).alias("members"))
    words = groups.select(F.explode(F.arrow_udf(_corrections, CORRECTED)(F.col("members"))).alias("c")).select("c.*")
    return got, cut(words)


def broken_words(got: DataFrame, words: DataFrame) -> DataFrame:
    """(chapter_id, a, b, value): each broken word as it should read; null where the hyphen stands for a left-out part."""
    breaks = got.select("chapter_id", F.explode("breaks").alias("k")).select("chapter_id", "k.*")
    one = words.select(F.col("word").alias("one"), F.col("right").alias("one_right"), F.col("n_right").alias("one_n"))
    hyph = words.select(F.col("word").alias("hyphened"), F.col("right").alias("hyph_right"), F.col("n_right").alias("hyph_n"))
    both = breaks.join(one, "one", "left").join(hyph, "hyphened", "left")
    sign = F.substring("a", -1, 1)
    first = F.regexp_extract("b", r"^[^\p{L}]*(\p{L})", 1)
    value = (
        F.when(sign.isin("¬", "=", "\xad"), F.col("one_right"))
        .when((first != F.lower(first)) & (F.col("hyph_n") >= F.col("one_n")), F.col("hyph_right"))
        .when(F.regexp_extract(F.lower("b"), r"^(\p{L}*)", 1).isin(*SUSPENDED) & (F.col("one_n") == 0), F.lit(None).cast("string"))
        .when(F.col("hyph_n") > F.col("one_n"), F.col("hyph_right"))
        .otherwise(F.col("one_right"))
    )
    misread = F.when(value == F.col("hyph_right"), F.col("hyph_right") != F.col("hyphened")).otherwise(value != F.col("one"))
    return both.select("chapter_id", "a", "b", value.alias("value"), misread.alias("misread"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return scan_tables(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "sources"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, words = _tables(spark, sf_dir)
    scans = got.where("scan")
    removed = scans.select("chapter_id", F.lit("removed").alias("kind"), F.explode("removed").alias("value"))
    wrong = words.where("right <> word").select("word", "right")
    fixed = scans.select("chapter_id", F.explode("words.word").alias("word")).join(wrong, "word").select("chapter_id", F.lit("fixed").alias("kind"), F.col("right").alias("value"))
    broken = cut(broken_words(scans, words).where("value is not null"))
    joined = broken.select("chapter_id", F.lit("joined").alias("kind"), "value")
    both = broken.where("misread").select("chapter_id", F.lit("fixed").alias("kind"), "value")
    return removed.unionByName(fixed).unionByName(joined).unionByName(both).distinct()


def _repaired(markup: pa.Array, title: pa.Array, book: pa.Array, heads: pa.Array, distances: pa.Array, fixes: pa.Array, broken: pa.Array) -> pa.Array:
    out = []
    for m, t, b, h, d, f, k in zip(*(x.to_pylist() for x in (markup, title, book, heads, distances, fixes, broken))):
        right = {x["word"]: x["right"] for x in f or []}
        whole = {(x["a"], x["b"]): x["value"] for x in k or []}
        kept, _ = furniture(m, [t, b], h or [], d or [])
        texts = []
        for paragraph in paragraphs(kept):
            said = []
            for x, y in paragraph:
                if y:
                    _, _, before, after = break_forms(x, y)
                    value = whole.get((x, y))
                    said.append(f"{x} {y}" if value is None else before + value + after)
                else:
                    before, w, after = core(x)
                    said.append(before + right.get(w, w) + after)
            texts.append(" ".join(said))
        out.append(texts)
    return pa.array(out, pa.list_(pa.string()))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter_id, paragraph, text) of every scanned chapter, continuous and repaired."""
    prepared = cut(prepare(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "sources")))
    got, words = read_tables(prepared)
    wrong = words.where("right <> word").select("word", "right")
    fixes = got.where("scan").select("chapter_id", F.explode("words.word").alias("word")).join(wrong, "word").groupBy("chapter_id").agg(F.collect_list(F.struct("word", "right")).alias("fixes"))
    broken = broken_words(got.where("scan"), words).where("value is not null").groupBy("chapter_id").agg(F.collect_list(F.struct("a", "b", "value")).alias("broken"))
    full = prepared.where("scan").join(fixes, "chapter_id", "left").join(broken, "chapter_id", "left")
    return full.select("chapter_id", F.posexplode(F.arrow_udf(_repaired, "array<string>")("html", "title", "book", "heads", "distances", "fixes", "broken")).alias("paragraph", "text"))
