"""Problem 5: duplicates hidden by formatting differences.

Each distinct value of a batch is canonicalised once (dictionary encoding), and
gets an integer id of field name and canonical value, 128 bits as two longs, the
same in every task, so no dictionary of the whole collection has to be shared
or joined. A record becomes the sorted tuple of its field-value ids, so the order of
fields has no meaning while the place of a list element is part of its field
name. Records are alike if group (here the source) and tuple are equal; the
tuples are written once and grouped with map-side combining, and only groups
with several keys meet their records again, in a join whose skewed side can be
split by AQE.

Two of ten thousand million different values share an id with a probability
below 10**-18, and only inside one source could that join different records.

Defined results: rows without a record key are no records; a null group is a
group of its own; values that are null, torn JSON and JSON that is no object
make no case; texts without any letter or digit are alike if they have that in
common; redelivered rows are one record.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

TUPLES = "origin string, group_id long, key long, ids array<long>"

#: Id of a value: two longs.
Id = tuple[int, int]


class _Drop(dict):
    """For str.translate: None for code points that are neither letters nor digits, found once each."""

    def __missing__(self, c: int):
        self[c] = got = c if unicodedata.category(chr(c))[0] in "LN" else None
        return got


_DROP = _Drop()


def letters(text: str) -> str:
    """Canonically composed and case-folded, letters and digits only."""
    return unicodedata.normalize("NFC", text).casefold().translate(_DROP)


_TWO_LONGS = struct.Struct("<qq")


def value_id(field: str, value: str | None) -> Id:
    """128-bit id of a canonical value of a field; null is a value of its own."""
    said = field + ("\1" if value is None else "\2" + value)
    return _TWO_LONGS.unpack(blake2b(said.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def text_tuple(text: str | None) -> list[Id] | None:
    return None if text is None else [value_id("text", letters(text))]


def lemma_tuple(lemma: str | None) -> list[Id] | None:
    return None if lemma is None or not lemma.strip() else [value_id("lemma", letters(lemma))]


def line_tuple(line: str | None) -> list[Id] | None:
    """Ids of a checkpoint line: text and, by place, the letters of lemma, word type and article of each word."""
    try:
        got = json.loads(line or "")
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    text, words = got.get("text"), got.get("words")
    ids = [value_id("text", letters(text) if isinstance(text, str) else None if text is None else json.dumps(text, sort_keys=True))]
    if not isinstance(words, list):
        return sorted([*ids, value_id("words", None if words is None else json.dumps(words, sort_keys=True))])
    for i, w in enumerate(words):
        if isinstance(w, dict):
            lemma = w.get("lemma")
            said = json.dumps([letters(lemma) if isinstance(lemma, str) else lemma, w.get("word_type"), w.get("article")], sort_keys=True)
        else:
            said = "!" + json.dumps(w, sort_keys=True)
        ids.append(value_id(f"word {i}", said))
    return sorted(ids)


def type_tuple(word_type: str | None) -> list[Id]:
    return [value_id("word_type", word_type)]


def tuples(df: DataFrame, origin: str, key: str, group: str, fields: dict[str, Callable[[str | None], list[Id] | None]]) -> DataFrame:
    """Records as sorted integer tuples. fields: for each column what makes its ids; None makes the record no case."""
    makers = list(fields.values())

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = []
            for make, col in zip(makers, b.columns[2:]):
                coded = col.dictionary_encode(null_encoding="encode")
                made = [make(v) for v in coded.dictionary.to_pylist()]
                columns.append([made[i] for i in coded.indices.to_pylist()])
            rows = ([p[0] if len(p) == 1 else None if None in p else sorted(chain(*p)) for p in zip(*columns)])
            made = pa.array([None if r is None else [*chain(*r)] for r in rows], pa.list_(pa.int64()))
            rows = pa.RecordBatch.from_arrays([pa.array([origin] * len(made)), b.column(0), b.column(1), made], names=["origin", "group_id", "key", "ids"])
            yield rows.filter(made.is_valid())

    picked = df.where(F.col(key).isNotNull()).select(F.col(group).cast("long").alias("group_id"), F.col(key).cast("long").alias("key"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    return picked.mapInArrow(rewrite, TUPLES)


def _source_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    sw = tuples(table(spark, sf_dir, "sentence_words"), "sentence_words", "sw_id", "source_id", {"text": text_tuple})
    we = tuples(table(spark, sf_dir, "word_entries"), "word_entries", "entry_id", "source_id", {"lemma": lemma_tuple, "word_type": type_tuple})
    cl = tuples(table(spark, sf_dir, "checkpoint_lines"), "checkpoint_lines", "line_id", "source_id", {"line": line_tuple})
    return sw.unionByName(we).unionByName(cl)


def collapse(records: DataFrame) -> DataFrame:
    """One row for each class of like records: origin, group_id, keep_id, copies (distinct keys)."""
    return (
        records.groupBy("origin", "group_id", "ids").agg(F.min("key").alias("keep_id"), F.countDistinct("key").alias("copies")).select("origin", "group_id", "keep_id", "copies")
    )


def copies(records: DataFrame) -> DataFrame:
    """(origin, keep_id, dup_id): each record that repeats another of its group with a smaller key."""
    records = cut(records.withColumn("h", F.xxhash64("origin", "group_id", "ids")))
    # Groups of one key cannot hold copies; they leave before the join.
    several = records.groupBy("h", "origin", "group_id", "ids").agg(F.min("key").alias("keep_id"), F.max("key").alias("last")).where("keep_id < last")
    r, s = records.alias("r"), several.alias("s")
    on = (F.col("r.h") == F.col("s.h")) & (F.col("r.origin") == F.col("s.origin")) & F.col("r.group_id").eqNullSafe(F.col("s.group_id")) & (F.col("r.ids") == F.col("s.ids"))
    return r.join(s, on).where("r.key > s.keep_id").select("r.origin", "s.keep_id", F.col("r.key").alias("dup_id")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_source_tuples(spark, sf_dir))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(_source_tuples(spark, sf_dir)).select("origin", F.col("group_id").alias("source_id"), "keep_id", "copies")


def _letters_sql(x: str) -> str:
    return rf"regexp_replace(replace(lower(nfc_normalize({x})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"


_RECORDS_SQL = rf"""
with sw as (select 'sentence_words' origin, sw_id k, any_value(source_id) s, any_value(text) t from sentence_words where sw_id is not null group by sw_id),
we as (select 'word_entries' origin, entry_id k, any_value(source_id) s, any_value(lemma) t, any_value(word_type) w from word_entries where entry_id is not null group by entry_id),
cl as (select 'checkpoint_lines' origin, line_id k, any_value(source_id) s, any_value(line) l from checkpoint_lines where line_id is not null group by line_id),
js as (select *, l::json j from cl where json_valid(l) and json_type(l) = 'OBJECT'),
jl as (select origin, k, s, {_letters_sql("j->>'$.text'")} t, array_to_string(list_transform((j->'$.words')::json[], lambda x: {_letters_sql("x->>'$.lemma'")} || '|' || coalesce(x->>'$.word_type', '-') || '|' || coalesce(x->>'$.article', '-')), '/') w from js),
r as (select origin, k, s, {_letters_sql("t")} v from sw where t is not null
 union all select origin, k, s, {_letters_sql("t")} || '|' || coalesce(w, '-') from we where trim(t) <> ''
 union all select origin, k, s, coalesce(t, '-') || '/' || coalesce(w, '-') from jl)"""

SQL = {
    "p5_found": _RECORDS_SQL + " select origin, m keep_id, k dup_id from (select origin, k, min(k) over (partition by origin, s, v) m from r) where k > m",
    "p5_records": _RECORDS_SQL + " select origin, s source_id, min(k) keep_id, count(*) copies from r group by origin, s, v",
}
