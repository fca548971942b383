"""The word list: unknown words counted, with articles and example sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import casefold, collapse_ws
from .known import drop_known


def explode_words(sentences: DataFrame, group: list[str], ord_: str = "ord", text: str = "text", count: str = "count", words: str = "words") -> DataFrame:
    """(group, s_ord, w_ord, text, count, lemma, word_type, article) in the order of sentences and words."""
    return sentences.select(*group, F.col(ord_).alias("s_ord"), F.col(text).alias("text"), F.col(count).cast("long").alias("count"), F.posexplode(words).alias("w_ord", "_w")).select(
        *group, "s_ord", "w_ord", "text", "count", "_w.lemma", "_w.word_type", "_w.article"
    )


def dedup_words(words: DataFrame, sentence: list[str]) -> DataFrame:
    """The first of the words of a sentence that share case-folded lemma and type, with collapsed white space."""
    w = words.withColumn("lemma", collapse_ws(F.col("lemma"))).withColumn("_k", casefold(F.col("lemma")))
    n = F.row_number().over(Window.partitionBy(*sentence, "_k", "word_type").orderBy("w_ord"))
    return w.withColumn("_n", n).where("_n = 1").drop("_k", "_n")


def _keyed(words: DataFrame, known_keys: DataFrame | None) -> DataFrame:
    """Unknown words with the key that they are counted by; known ones leave before anything is shuffled by it."""
    w = words.where("lemma is not null")
    if known_keys is not None:
        w = drop_known(w, "lemma", known_keys)
    return w.withColumn("lemma_key", casefold(F.col("lemma"))).withColumn("at", F.struct("s_ord", "w_ord"))


def build(words: DataFrame, group: list[str], known_keys: DataFrame | None = None, min_count: int = 1, examples: str | None = "array") -> DataFrame:
    """(group, lemma, word_type, article, count, ...): one row for each case-folded lemma and type.

    lemma is the form first seen, article the first that is not null. examples:
    "array" adds sentences, the distinct texts in order of first sight, which
    puts all texts of an entry into one value and is meant for lists to export;
    "count" adds only their number, n_sentences; None adds nothing and shuffles
    sums only. example_rows() has the texts as rows, for entries of any size.
    Texts are made distinct in a first aggregation by (key, text), so a frequent
    text reaches an entry once. Null counts count nothing; null lemmas leave.
    """
    w = _keyed(words, known_keys)
    key = [*group, "lemma_key", "word_type"]
    seen = [
        F.min_by("lemma", "at").alias("lemma"),
        F.min_by("article", F.when(F.col("article").isNotNull(), F.col("at"))).alias("article"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"),
    ]
    if not examples:
        return w.groupBy(*key).agg(*seen).where(F.col("count") >= min_count)
    by_text = w.groupBy(*key, "text").agg(*seen, F.min(F.when(F.col("article").isNotNull(), F.col("at"))).alias("article_at"), F.min("at").alias("at"))
    if examples == "count":
        texts = F.count("text").alias("n_sentences")
    else:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("sentences")
    entries = by_text.groupBy(*key).agg(F.min_by("lemma", "at").alias("lemma"), F.min_by("article", "article_at").alias("article"), F.sum("count").alias("count"), texts)
    return entries.where(F.col("count") >= min_count)


def example_rows(words: DataFrame, group: list[str], known_keys: DataFrame | None = None) -> DataFrame:
    """(group, lemma_key, word_type, at, text): the distinct texts of every entry, at is where it is first seen."""
    return _keyed(words, known_keys).where("text is not null").groupBy(*group, "lemma_key", "word_type", "text").agg(F.min("at").alias("at"))


def order(group: list[str]) -> list[Column]:
    """The list's order, total within a group: count falling, case-folded lemma, type."""
    return [*map(F.col, group), F.desc("count"), F.asc("lemma_key"), F.asc("word_type")]
