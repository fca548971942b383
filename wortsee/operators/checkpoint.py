"""Checkpoints and answers: reading lines, last wins, what is pending, what goes together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE = "text string, words array<struct<lemma:string,word_type:string,article:string>>"


def parsed_lines(lines: DataFrame, group: list[str], seq: str, line: str) -> DataFrame:
    """Lines with status: record (a JSON object), blank, torn (the group's last line that is not blank) or bad.

    Blank lines are no records; a torn last line is ignored by readers, a bad
    line before it is an error for them. The last line is found by an aggregate
    and a join, so a group of any length is spread.
    """
    blank = F.col(line).isNull() | (F.trim(F.regexp_replace(line, r"[\s\x{85}\x{A0}\x{2028}\x{2029}]", "")) == "")
    kind = F.when(blank, "blank").when(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), "record").otherwise("bad")
    marked = lines.withColumn("status", kind)
    last = lines.groupBy(*group).agg(F.max(seq).alias("_last"))
    torn = (F.col("status") == "bad") & (F.col(seq) == F.col("_last"))
    return marked.join(last, group, "left").withColumn("status", F.when(torn, "torn").otherwise(F.col("status"))).drop("_last")


def records(parsed: DataFrame, line: str, schema: str = LINE) -> DataFrame:
    """Records of the lines that hold one, as columns of `schema`."""
    return parsed.where("status = 'record'").withColumn("_r", F.from_json(line, schema)).select(*[c for c in parsed.columns if c not in (line, "status")], "_r.*")


def last_wins(rows: DataFrame, key: list[str], seq: list[str | Column]) -> DataFrame:
    """Of the rows of a key the last; an aggregate, combined map-side, so repeats cost one row a task."""
    rest = [c for c in rows.columns if c not in key]
    picked = F.max_by(F.struct(*rest), F.struct(*seq))
    return rows.groupBy(*key).agg(picked.alias("_p")).select(*key, "_p.*")


def pending(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return items.join(done.select(*key).distinct(), key, "left_anti")


def still_wanted(done: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    return done.join(items.select(*key).distinct(), key, "left_semi")


def fold_in(done: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Finished and new answers together; the new one wins."""
    both = done.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_wins(both, key, ["_new"]).drop("_new")


def answered(items: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Items with their answers; items keep their order column."""
    return items.join(answers, key, "inner")


def numbered(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Adds index: the place within the group, from 0."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*group).orderBy(*by)) - 1)
