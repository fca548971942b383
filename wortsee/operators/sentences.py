"""Sentences: joining segments, splitting text, mending ordinals, counting distinct ones.

Order is data: every operator takes and gives explicit positions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse_ws, strip_ws

#: Positions of a group that are worked on together.
BLOCK = 4096
#: A sentence that ends in a number of one or two digits and a full stop.
ORDINAL_END = r"(^|[\s\x{85}\x{A0}\x{2028}\x{2029}])\p{Nd}{1,2}\.$"
#: German abbreviations of the rule profile, with escaped full stops.
ABBREVIATIONS = r"(z\.\s?B|d\.\s?h|u\.\s?a|u\.\s?Ä|o\.\s?ä|i\.\s?d|s\.\s?o|s\.\s?u|v\.\s?a|Dr|Prof|Hr|Fr|St|Nr|Bd|Kap|Abb|Tab|S|usw|bzw|ca|etc|evtl|ggf|inkl|vgl|mind|max|Mr|Mrs|Ms|Jan|Febr|Aug|Sept|Okt|Nov|Dez)"
#: Where the rule profile cuts: white space after a terminator with closing signs, before a capital, a digit or an opening sign.
_CUT = r"(?<=[.!?…][\"'»«“”’)]{0,3})\s+(?=[\"'„»«“‚(]*[\p{Lu}\p{Nd}])"
_INITIAL = r"(?<![\p{L}])([a-zäöü])\.(?=\s)"
_SHIELD = r"(?<![\p{L}])" + ABBREVIATIONS + r"\.(?=\s)"


def join_segments(segments: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """One document for each group: texts stripped, empty and null ones left out, joined by one blank in order.

    A group whose texts are all empty gives an empty document. A document is one
    value, so this holds a whole group; long groups are better left in rows.
    """
    stripped = segments.withColumn("_t", strip_ws(F.col(text)))
    pairs = F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))))
    return stripped.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), " ").alias("text"))


def merge_ordinals(sentences: DataFrame, group: list[str], pos: str, text: str, block: int = BLOCK) -> DataFrame:
    """Puts back together what was split after an ordinal number, for any chain of such splits.

    The first position of a chain is its position. Only the sentence before
    decides whether one goes on, as a merged one ends as its last part does; so
    a group is worked on in blocks of positions, each told by a short table of
    the blocks how the one before it ends and which chain is open there. A group
    of any length is spread; a single chain is one value. A null text ends in no
    number; rows that share a position are taken as parts of one chain.
    """
    at = [*group, "_block"]
    rows = sentences.withColumn("_block", F.floor(F.col(pos) / block)).withColumn("_goes_on", F.coalesce(F.col(text).rlike(ORDINAL_END), F.lit(False)))
    within = Window.partitionBy(*at).orderBy(pos)
    # 1: begins a chain, 0: goes on, null: the block's first row, which only the block before can tell.
    begins = F.when(F.lag("_goes_on").over(within), 0).when(F.lag("_goes_on").over(within).isNotNull(), 1)
    rows = rows.withColumn("_begins", begins)
    ends = rows.groupBy(*at).agg(F.max_by("_goes_on", pos).alias("_open"), F.max(F.when(F.col("_begins") == 1, F.col(pos))).alias("_last"), F.min(pos).alias("_first"))
    order = Window.partitionBy(*group).orderBy("_block")
    told = ends.withColumn("_goes_over", F.coalesce(F.lag("_open").over(order), F.lit(False)))
    # The chain that is open where a block ends: the last one that begins in it or in a block before.
    opens = F.coalesce(F.col("_last"), F.when(~F.col("_goes_over"), F.col("_first")))
    before = F.last(opens, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = told.select(*at, F.when(F.col("_goes_over"), before).otherwise(F.col("_first")).alias("_head"))
    short = heads.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], "_head")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(at)))
    begun = F.max(F.when(F.col("_begins") == 1, F.col(pos))).over(within.rowsBetween(Window.unboundedPreceding, 0))
    chained = rows.withColumn("_begun", begun).join(short, same).withColumn("_chain", F.coalesce("_begun", "_head"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return chained.groupBy(*group, "_chain").agg(F.min(pos).alias(pos), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias(text)).drop("_chain")


def rule_split(text: Column) -> Column:
    """Sentences of a text by the rule profile, white space collapsed; native, for German and like languages."""
    flat = collapse_ws(text)
    shielded = F.regexp_replace(flat, _SHIELD, "$1\u0001")
    shielded = F.regexp_replace(shielded, _INITIAL, "$1\u0001")
    parts = F.split(F.regexp_replace(shielded, _CUT, "\u0002"), "\u0002")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\u0001"), F.lit(".")))), lambda p: p != "")


def split_with(text: Column, segmenter: Callable[[str], list[str]]) -> Column:
    """Sentences of a text by a segmenter of the caller, in Arrow batches, white space collapsed."""

    def run(arr: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [s for s in (" ".join(x.split()) for x in segmenter(t)) if s] for t in arr.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def explode_sentences(documents: DataFrame, key: list[str], sentences: Column) -> DataFrame:
    return documents.select(*key, F.posexplode(sentences).alias("pos", "text"))


def split_documents(documents: DataFrame, key: list[str], text: str, segmenter: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(key, pos, text) of the sentences of documents, ordinals put back together."""
    cut = split_with(F.col(text), segmenter) if segmenter else rule_split(F.col(text))
    return merge_ordinals(explode_sentences(documents, key, cut), key, "pos", "text")


def distinct_sentences(sentences: DataFrame, group: list[str], pos: str, text: str) -> DataFrame:
    """(group, text, count, ord): exact texts with their number and first position; combined map-side."""
    return sentences.where(F.col(text).isNotNull()).groupBy(*group, text).agg(F.count("*").alias("count"), F.min(pos).alias("ord"))
