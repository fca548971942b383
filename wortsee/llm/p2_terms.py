"""Problem 2: frequency of every distinct term, and marks for those too rare or too common.

Terms are made once for each distinct value of a batch. (term, list, record)
keys are then range partitioned and sorted (Spark's external sort), and a
run-length scan over the sorted rows counts occurrences, distinct lists and
distinct records. The range covers the whole key, so a term that a third of all
rows have is spread over many tasks; what its parts have in common, the list at
either edge of a part, travels as an edge and is counted once when the parts
are added up.

Defined results: null and blank values are no terms; a null count is 0; rows
without a record key are no records, and a record counts once however often it
was delivered; a null list counts occurrences but is no list; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A term with at most this total is rare.
RARE_TOTAL = 2
#: A term in more than one of so many lists is common.
COMMON_ONE_IN = 10
NO_LIST = np.iinfo(np.int64).min


def term_of(value: str) -> str:
    """Whitespace runs as one space, trimmed and case-folded."""
    return " ".join(value.split()).casefold()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value = batch.column(0)
        coded = value.dictionary_encode()
        terms = pa.array([term_of(v) or None for v in coded.dictionary.to_pylist()], pa.string())
        term = terms.take(coded.indices)
        rows = pa.RecordBatch.from_arrays([term, *(batch.column(i) for i in (1, 2, 3))], names=["term", "list", "record", "n"])
        yield rows.filter(pc.is_valid(term))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan over rows sorted by term, list and record; one row for each term of a batch.

    The first and the last (term, list) run of the partition are not counted
    in n_lists; they come out as edge.
    """
    before: tuple | None = None  # term, list and record of the row before
    open_run: tuple | None = None  # the run that may turn out to be the partition's last
    names = ["term", "total", "n_records", "n_lists", "edge"]
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        lists = batch.column(1).fill_null(NO_LIST).to_numpy()
        record = batch.column(2).to_numpy()
        n = batch.column(3).fill_null(0).to_numpy()
        terms = coded.dictionary
        first = terms[0].as_py()
        new_term = np.concatenate(([before is None or before[0] != first], code[1:] != code[:-1]))
        new_list = new_term | np.concatenate(([before is None or before[1] != lists[0]], lists[1:] != lists[:-1]))
        new_record = new_list | np.concatenate(([before is None or before[2] != record[0]], record[1:] != record[:-1]))
        at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        total = np.add.reduceat(np.where(new_record, n, 0), at)
        records = np.add.reduceat(new_record.astype(np.int64), at)
        counted = new_list & (lists != NO_LIST)
        edges: list[tuple[str, int]] = []
        if before is None and counted[0]:
            counted[0] = False
            edges.append((first, int(lists[0])))
        if len(runs := np.flatnonzero(counted)):
            # The last run is held back until another follows; the one held so far is then counted.
            if open_run is not None:
                yield pa.RecordBatch.from_arrays([pa.array([open_run[0]]), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([1], pa.int64()), pa.array([None], pa.int64())], names=names)
            open_run = (terms[int(code[runs[-1]])].as_py(), int(lists[runs[-1]]))
            counted[runs[-1]] = False
        n_lists = np.add.reduceat(counted.astype(np.int64), at)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[at])), pa.array(total), pa.array(records), pa.array(n_lists), pa.nulls(len(at), pa.int64())], names=names)
        for term, edge in edges:
            yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([edge], pa.int64())], names=names)
        before = (terms[int(code[-1])].as_py(), lists[-1], record[-1])
    if open_run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_run[0]]), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([open_run[1]], pa.int64())], names=names)


def term_frequencies(df: DataFrame, value: str, lists: str, record: str, count: str) -> DataFrame:
    """(term, total, n_records, n_lists) of every distinct term of a value column."""
    rows = df.where(F.col(record).isNotNull()).select(
        F.col(value).cast("string").alias("value"), F.col(lists).cast("long").alias("list"), F.col(record).cast("long").alias("record"), F.col(count).cast("long").alias("n")
    )
    keys = rows.mapInArrow(_keys, "term string, list long, record long, n long")
    runs = (
        keys.repartitionByRange("term", "list", "record").sortWithinPartitions("term", "list", "record").mapInArrow(_runs, "term string, total long, n_records long, n_lists long, edge long")
    )
    return (
        runs.groupBy("term")
        .agg(F.sum("total").alias("total"), F.sum("n_records").alias("n_records"), F.sum("n_lists").alias("inner_lists"), F.collect_set("edge").alias("edges"))
        .select("term", "total", "n_records", (F.col("inner_lists") + F.size("edges")).alias("n_lists"))
    )


def marked(terms: DataFrame, n_lists: int, rare_total: int = RARE_TOTAL, common_one_in: int = COMMON_ONE_IN) -> DataFrame:
    """Adds mark: rare, common or null. n_lists: number of lists of the whole collection."""
    mark = F.when(F.col("total") <= rare_total, "rare").when(F.col("n_lists") * common_one_in > n_lists, "common")
    return terms.withColumn("mark", mark)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "word_entries")
    n_lists = entries.agg(F.countDistinct("source_id")).first()[0]
    return marked(term_frequencies(entries, "lemma", "source_id", "entry_id", "count"), n_lists)


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("term", "mark", "total", "n_lists")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where("mark is not null")


SQL = {
    "p2_terms": r"""
with r as (select entry_id, any_value(source_id) source_id, any_value(lemma) lemma, any_value(count) n from word_entries where entry_id is not null group by entry_id),
t as (select replace(lower(trim(regexp_replace(lemma, '[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), 'ß', 'ss') term, source_id, n from r),
s as (select term, cast(sum(coalesce(n, 0)) as bigint) total, count(distinct source_id) n_lists from t where term <> '' group by term)
select term, case when total <= 2 then 'rare' when n_lists * 10 > (select count(distinct source_id) from word_entries) then 'common' end mark, total, n_lists from s""",
}
SQL["p2_found"] = f"select * from ({SQL['p2_terms']}) where mark is not null"
