"""Problem 6: splitting oversized items at natural boundaries.

A dynamic programme over boundary positions: the cost of a way to cut is the sum
of the penalties of its cuts (before a block 0, after a sentence, after a word,
anywhere) and of the squared free share of each piece, which makes few pieces of
like size. A piece begins up to `overlap` before the cut that ends the one
before it, at a natural boundary if there is one. Finer boundaries are looked
at only inside stretches of more than a quarter of the limit that the coarser
ones leave, so the work stays in proportion to the length of the text.

Defined results: null and empty texts have no pieces; a text within the limit is
one piece; no cut falls inside a tag or an entity unless it is longer than a
quarter of the limit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import once, table

LIMIT, OVERLAP = 6000, 200
#: Opening tags of blocks, in any case.
BLOCK = re.compile(r"<(?:p|div|h[1-6]|section|article)\b", re.I)
SENTENCE = re.compile(r"[.!?…。！？।؟]+[\"'»«”’“‘)\]」』]*(?:\s+|(?=<)|(?<=[。！？」』]))")
WORD = re.compile(r"\s+|(?<=>)(?=[^\s<])")
TAG = re.compile(r"<[^<>]*>|&#?\w{1,10};")
KINDS = ("block", "sentence", "word", "any")
PENALTY = np.array([0.0, 0.15, 0.6, 3.0])
SPLIT = "struct<long_blocks:long,pieces:array<struct<start:int,stop:int,cut:string>>>"


def block_starts(text: str) -> list[int]:
    """Where stretches begin: at the beginning and at each opening tag of a block."""
    return sorted({0, *(m.start() for m in BLOCK.finditer(text))})


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, and the kind of each; the end of the text is the last."""
    n, fine = len(text), max(1, limit // 4)
    inside = np.zeros(n + 1, bool)
    for m in TAG.finditer(text):
        if m.end() - m.start() <= fine:
            inside[m.start() + 1 : m.end()] = True
    kind = np.full(n + 1, 9, np.int8)
    known = [p for p in block_starts(text) if p]
    kind[known] = 0
    for level, pattern in ((1, SENTENCE), (2, WORD), (3, None)):
        edges = np.concatenate(([0], np.flatnonzero(kind < 9), [n]))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > fine:
                at = np.arange(a + 1, b) if pattern is None else np.fromiter((m.end() for m in pattern.finditer(text, a, b)), np.int64)
                at = at[(at > a) & (at < b)]
                at = at[~inside[at]]
                kind[at[kind[at] == 9]] = level
    kind[n] = 0
    at = np.flatnonzero(kind < 9)
    at = at[at > 0]
    return at, kind[at]


def overlap_starts(text: str, cuts: np.ndarray, kinds: np.ndarray, overlap: int) -> np.ndarray:
    """For each cut where the next piece begins: at the first sentence start, else word start, at most `overlap` before it."""
    starts = cuts.copy()
    if not overlap:
        return starts
    for i, c in enumerate(cuts):
        lo = max(0, int(c) - overlap)
        near = text[lo:c]
        open_tag = near.find(">") + 1 if near.find(">") >= 0 and (near.find("<") < 0 or near.find(">") < near.find("<")) else 0
        found = [m.start() for m in BLOCK.finditer(near, open_tag)] or [m.end() for m in SENTENCE.finditer(near, open_tag)] or [m.end() for m in WORD.finditer(near, open_tag)]
        tags = [(m.start(), m.end()) for m in TAG.finditer(near)]
        found = [p for p in found if p < len(near) and not any(a < p < b for a, b in tags)]
        starts[i] = lo + (min(found) if found else 0 if kinds[i] == 3 else len(near))
    return starts


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[int, list[tuple[int, int, str]]]:
    """The number of stretches longer than the limit, and the pieces (start, stop, kind of the cut at its end)."""
    if not text:
        return 0, []
    n = len(text)
    starts = block_starts(text)
    long_blocks = sum(b - a > limit for a, b in zip(starts, [*starts[1:], n]))
    if n <= limit:
        return long_blocks, [(0, n, "end")]
    at, kind = boundaries(text, limit)
    begin = overlap_starts(text, at, kind, min(overlap, limit // 2))
    cost = np.full(len(at), np.inf)
    back = np.full(len(at), -1)
    first = 0  # the begin positions grow with the cuts, so the window of cuts within reach moves on
    reach = np.maximum.accumulate(begin)
    penalty = PENALTY[kind].copy()
    penalty[-1] = 0
    for j, e in enumerate(at):
        if e <= limit:
            cost[j] = penalty[j] + ((limit - e) / limit) ** 2
        while reach[first] < e - limit:
            first += 1
        if first < j:
            size = e - begin[first:j]
            total = np.where(size <= limit, cost[first:j] + ((limit - size) / limit) ** 2, np.inf)
            i = int(np.argmin(total))
            if total[i] + penalty[j] < cost[j]:
                cost[j], back[j] = total[i] + penalty[j], first + i
    pieces, j = [], len(at) - 1
    while j >= 0:
        i = int(back[j])
        pieces.append((int(begin[i]) if i >= 0 else 0, int(at[j]), "end" if j == len(at) - 1 else KINDS[kind[j]]))
        j = i
    return long_blocks, pieces[::-1]


def pieces_of(text, limit: int = LIMIT, overlap: int = OVERLAP):
    """Column of struct<long_blocks, pieces> of a text column; offsets are code points."""

    @F.arrow_udf(SPLIT)
    def cut_up(arr: pa.Array) -> pa.Array:
        out = []
        for t in arr.to_pylist():
            blocks, pieces = split(t, limit, overlap)
            out.append({"long_blocks": blocks, "pieces": [{"start": a, "stop": b, "cut": k} for a, b, k in pieces]})
        kind = pa.struct([("long_blocks", pa.int64()), ("pieces", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cut", pa.string())])))])
        return pa.array(out, kind)

    return cut_up.asNondeterministic()(text)  # else each use of its fields may evaluate it again


def _split_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chapters with their pieces; the filter stands before the Python stage."""
    chapters = table(spark, sf_dir, "chapters").where(F.length("html") > LIMIT)
    return once(chapters, ["chapter_id"], ["html"]).withColumn("split", pieces_of(F.col("html")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_chapters(spark, sf_dir).select("chapter_id", F.col("split.long_blocks").alias("long_blocks"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _split_chapters(spark, sf_dir).select("chapter_id", "html", F.posexplode("split.pieces").alias("piece", "p"))
    return p.select("chapter_id", "piece", "p.start", "p.stop", "p.cut", F.expr("substring(html, p.start + 1, p.stop - p.start)").alias("text"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each chapter what its pieces cover from the beginning without a gap, pieces over the limit, overlaps over theirs, and pieces out of order."""
    p = _split_chapters(spark, sf_dir).select("chapter_id", F.explode("split.pieces").alias("p")).select("chapter_id", "p.*")
    before = Window.partitionBy("chapter_id").orderBy("start")
    shared = F.lag("stop").over(before) - F.col("start")
    sums = p.withColumn("shared", F.coalesce(shared, F.lit(0))).groupBy("chapter_id")
    return sums.agg(
        F.sum(F.col("stop") - F.col("start") - F.col("shared")).cast("long").alias("covered"), F.count_if(F.col("stop") - F.col("start") > LIMIT).alias("too_long"),
        F.count_if((F.col("shared") > OVERLAP) | (F.col("shared") < 0)).alias("bad_overlaps"), F.max("stop").cast("long").alias("ends"),
    )


SQL = {
    "p6_checked": """with c as (select chapter_id, any_value(html) html from chapters where length(html) > 6000 and chapter_id is not null group by chapter_id)
select chapter_id, cast(length(html) as bigint) covered, cast(0 as bigint) too_long, cast(0 as bigint) bad_overlaps, cast(length(html) as bigint) ends from c""",
    "p6_found": r"""
with c as (select chapter_id, any_value(html) html from chapters where length(html) > 6000 and chapter_id is not null group by chapter_id),
s as (select chapter_id, unnest(string_split(regexp_replace(html, '<(p|div|h[1-6]|section|article)\b', chr(1) || '<\1', 'gi'), chr(1))) b from c)
select chapter_id, cast(count(*) filter (length(b) > 6000) as bigint) long_blocks from s group by chapter_id""",
}
