"""Unicode text as Catalyst expressions: white space, case folding, notation of cards.

Everything here is native, so it stays inside code generation and needs no
Python worker. Null gives null.
"""

from __future__ import annotations

import sys
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 29 characters that str.split() takes as white space, as a Java regex class.
WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Articles and the reflexive pronoun that cards write with a word.
ARTICLES = ("der", "die", "das", "ein", "eine")
REFLEXIVE = "sich"


def collapse_ws(c: Column) -> Column:
    """White-space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


@cache
def folding_exceptions() -> dict[str, str]:
    """Characters whose case folding is not their small letter, from the running Unicode tables; ß is apart."""
    every = (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    return {c: c.casefold() for c in every if c.casefold() != c.lower() and c != "ß"} | {"Σ": "σ"}


@cache
def plain_ranges(gap: int = 100) -> list[tuple[int, int]]:
    """Long ranges of code points without exceptions; few, so that a regex class of them is quick."""
    odd = sorted(map(ord, folding_exceptions()))
    edges = zip([-1, *odd], [*odd, sys.maxunicode + 1])
    return [(a + 1, b - 1) for a, b in edges if b - a > gap]


def casefold(c: Column) -> Column:
    """Full Unicode case folding. Strings of plain ranges only, nearly all, take the short way."""
    table = F.create_map(*[F.lit(x) for pair in folding_exceptions().items() for x in pair])
    plain = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in plain_ranges())
    each = F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), F.replace(F.lower(ch), F.lit("ß"), F.lit("ss"))))
    return F.when(c.rlike(f"[^{plain}]"), F.array_join(each, "")).otherwise(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def normalize_word(c: Column) -> Column:
    return casefold(collapse_ws(c))


def tokens(c: Column) -> Column:
    """Parts between white space; an empty array for a blank string."""
    flat = collapse_ws(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def bracket_readings(piece: Column) -> Column:
    """A piece without its bracketed parts, and with them but without the brackets."""
    return F.array(F.regexp_replace(piece, WS + r"*\([^)]*\)", ""), F.translate(piece, "()", ""))


def slash_readings(phrase: Column) -> Column:
    """One phrase for each way to choose among the alternatives that slashes part, tokens joined by blanks."""
    choices = F.transform(tokens(phrase), lambda t: F.split(t, "/"))
    start = F.array(F.lit(None).cast("string"))
    grow = lambda acc, alt: F.flatten(F.transform(acc, lambda a: F.transform(alt, lambda b: F.when(a.isNull(), b).otherwise(F.concat(a, F.lit(" "), b)))))
    return F.transform(F.aggregate(choices, start, grow), lambda p: F.coalesce(p, F.lit("")))


def _bare(words: Column) -> Column:
    """Without the reflexive pronoun, then without one leading article if more words follow."""
    kept = F.filter(words, lambda t: t != REFLEXIVE)
    led = (F.size(kept) > 1) & F.get(kept, F.lit(0)).isin(*ARTICLES)
    return F.when(led, F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1)))).otherwise(kept)


def headword_forms(phrase: Column) -> Column:
    """Forms that a phrase stands for: as written, without trailing notation, and both without article or pronoun."""
    words = tokens(phrase)
    plain = F.transform(words, lambda t: F.coalesce(F.nullif(F.regexp_replace(t, "[-.]+$", ""), F.lit("")), t))
    forms = F.array(*[F.array_join(x, " ") for x in (words, plain, _bare(words), _bare(plain))])
    return F.filter(forms, lambda f: f != "")


def match_keys(entry: Column) -> Column:
    """All keys by which a card entry is matched, distinct and sorted; an empty array for a blank entry."""
    pieces = F.split(normalize_word(entry), ",")
    expand = lambda arr, f: F.flatten(F.transform(arr, f))
    found = reduce(expand, (bracket_readings, slash_readings, headword_forms), pieces)
    return F.array_sort(F.array_distinct(found))
