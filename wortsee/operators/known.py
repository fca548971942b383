"""Known words: shapes of answers, entries, match keys, the filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_keys, normalize_word


def from_response(data) -> list[str]:
    """Words of an answer: a list of strings and objects with "word" or "lemma", or an object with such a list as "words"."""
    if isinstance(data, dict):
        if (data := data.get("words")) is None:
            raise ValueError('unexpected known-words answer: an object without a "words" array')
    if not isinstance(data, list):
        raise ValueError(f"unexpected known-words answer of type {type(data).__name__}")
    words = []
    for item in data:
        word = (item.get("word") or item.get("lemma")) if isinstance(item, dict) else item
        if not isinstance(word, str):
            raise ValueError(f'a known-words entry is neither a string nor an object with "word" or "lemma": {item!r}')
        words.append(word)
    return words


def shapes(answers: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """(keep, word) of the words of answers in any of the shapes, natively; items of another shape give null.

    An answer that is no JSON, or has no list, gives one row with a null word.
    """
    v = F.try_parse_json(body)
    top = F.schema_of_variant(v)
    listed = F.when(top.startswith("ARRAY"), v).otherwise(F.try_variant_get(v, "$.words", "variant"))
    items = F.coalesce(F.when(F.schema_of_variant(listed).startswith("ARRAY"), F.try_variant_get(listed, "$", "array<variant>")), F.array(F.lit(None).cast("variant")))
    exploded = answers.select(*keep, F.explode(items).alias("_i"))
    kind = F.schema_of_variant("_i")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("_i", path, "variant")) == "STRING", F.try_variant_get("_i", path, "string"))
    word = F.when(kind == "STRING", F.try_variant_get("_i", "$", "string")).when(kind.startswith("OBJECT"), F.coalesce(F.nullif(text("$.word"), F.lit("")), text("$.lemma")))
    return exploded.select(*keep, word.alias("word"))


def entries(cards: DataFrame, word: str) -> DataFrame:
    """Distinct entries in their normal form; blank and null ones leave."""
    return cards.select(normalize_word(F.col(word)).alias("entry")).where("entry <> ''").distinct()


def keys(known: DataFrame, entry: str = "entry") -> DataFrame:
    """(entry, key): expanded on the side of the cards, never on the side of the facts."""
    return known.select(entry, F.explode(match_keys(F.col(entry))).alias("key"))


def drop_known(words: DataFrame, lemma: str, known_keys: DataFrame) -> DataFrame:
    """Words that no key matches.

    An anti-join on equality; Catalyst broadcasts the keys if their size, which
    it checks, is under its threshold, and shuffles both sides otherwise. A null
    lemma is never known.
    """
    w = words.withColumn("_key", normalize_word(F.col(lemma)))
    k = known_keys.select(F.col("key").alias("_key")).distinct()
    return w.join(k, "_key", "left_anti").drop("_key")

