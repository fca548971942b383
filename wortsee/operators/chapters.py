"""Chapters: splitting markup for requests, verdicts on documents, selection."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput
from ..functions.markup import parse_document

#: Code points that one request takes.
MAX_PART = 60_000
#: Kinds of documents.
KINDS = ("chapter", "foreword", "afterword", "cover", "title_page", "copyright", "dedication", "toc", "index", "navigation", "advertisement", "other")
BLOCK_START = r"(?i)(?=<(?:p|div|h[1-6]|section|article)\b)"


def split_markup(html: Column, limit: int = MAX_PART) -> Column:
    """Parts of at most `limit` code points, cut before blocks where possible; their concatenation is the markup.

    A greedy fold over blocks: a block that does not fit begins a new part, and
    a block longer than a part is cut hard, its rest going on as a block.
    """
    block = lambda s: F.struct(s.alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        size = F.length(piece)
        hard = F.floor((size - 1) / limit).cast("int")  # full parts before the rest; the rest is never empty
        cuts = F.when(hard > 0, F.transform(F.sequence(F.lit(0), hard - 1), lambda i: F.substr(piece, (i * limit + 1).cast("int"), F.lit(limit)))).otherwise(F.array().cast("array<string>"))
        rest = F.substr(piece, (hard * limit + 1).cast("int"), F.lit(limit))
        fits = F.length(state["open"]) + size <= limit
        flushed = F.concat(state["done"], F.when(state["open"] != "", F.array(state["open"])).otherwise(F.array().cast("array<string>")), cuts)
        return F.struct(F.when(fits, state["done"]).otherwise(flushed).alias("done"), F.when(fits, F.concat(state["open"], piece)).otherwise(rest).alias("open"))

    pieces = F.filter(F.split(html, BLOCK_START), lambda p: p != "")
    folded = F.aggregate(pieces, block(F.array().cast("array<string>")), add, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return F.when(F.length(html) <= limit, F.array(html)).otherwise(folded)


def paragraphs(html: Column) -> Column:
    """struct<title, paragraphs> of XHTML documents, by a tolerant parser in Arrow batches."""
    kind = pa.struct([("title", pa.string()), ("paragraphs", pa.list_(pa.string()))])

    def run(arr: pa.Array) -> pa.Array:
        out = []
        for markup in arr.to_pylist():
            title, texts = parse_document(markup) if markup is not None else (None, [])
            out.append({"title": title, "paragraphs": texts})
        return pa.array(out, kind)

    return F.arrow_udf(run, "struct<title:string,paragraphs:array<string>>")(html)


def combine_parts(verdicts: DataFrame, key: list[str], part: str = "part") -> DataFrame:
    """One verdict for each document of several parts: content if any part is.

    The kind is that of the first content part, else of the first part; the
    sentences are those of the content parts, in order.
    """
    content = F.col("is_content")
    said = F.array_sort(F.collect_list(F.when(content, F.struct(F.col(part).alias("p"), F.col("sentences").alias("s")))))
    return verdicts.groupBy(*key).agg(
        F.coalesce(F.min_by("kind", F.when(content, F.col(part))), F.min_by("kind", part)).alias("kind"),
        F.bool_or(content).alias("is_content"),
        F.flatten(F.transform(said, lambda x: x["s"])).alias("sentences"),
    )


def combined(parts: list[tuple[str, bool, list[str]]]) -> tuple[str, bool, list[str]]:
    """combine_parts() for the verdicts on one document's parts, in order."""
    content = [p for p in parts if p[1]]
    kind = next((p[0] for p in [*content, *parts]), "other")
    return kind, bool(content), [s for p in content for s in p[2]]


def content_sentences(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos, text) of the sentences of content documents."""
    return verdicts.where("is_content").select(*key, F.posexplode("sentences").alias("pos", "text"))


def with_verdicts(chapters: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Documents with their verdicts; a document without one leaves. Documents keep the columns that order them."""
    return chapters.join(verdicts, key)


def char_count(paragraphs: Column) -> Column:
    """Code points of a document's paragraphs."""
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda n, p: n + F.length(p))


def title_or_name(title: Column, href: Column) -> Column:
    """The title, or the last part of the path where it is null or empty."""
    return F.coalesce(F.nullif(title, F.lit("")), F.element_at(F.split(href, "/"), -1))


def parse_selection(spec: str) -> list[tuple[int, int]]:
    """Ranges of a selection such as '0,3-20,25'."""
    ranges = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise BadInput(f"invalid --chapters value {part!r}: a number or a range of two is expected")
        first, last = int(m[1]), int(m[2] or m[1])
        if last < first:
            raise BadInput(f"invalid --chapters range {part!r}: it runs backwards")
        ranges.append((first, last))
    if not ranges:
        raise BadInput("--chapters selected nothing")
    return ranges


def selected(index: Column, spec: str) -> Column:
    """Whether an index is selected; plain comparisons, which reach the scan."""
    hit = F.lit(False)
    for first, last in parse_selection(spec):
        hit = hit | index.between(first, last)
    return hit
