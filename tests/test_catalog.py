import pytest
from pyspark.sql import functions as F

from wortsee.operators import validation as va
from wortsee.plans import catalog
from wortsee.sources import artifacts as art
from wortsee.sources import epub

from tests.sql import assert_equal


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, data, name):
    assert_equal(spark, catalog.QUERIES[name], catalog.SQL[name], data)


def test_every_query_but_the_markup_reader_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"html_paragraphs"}


def test_content_documents_as_columns(spark):
    cases = [(h, m, p) for h in ("a.xhtml", "b.HTM", "c.png", "d", "") for m in (None, "", "text/html", " Application/XHTML+xml ", "image/png") for p in (None, "", "nav", "x  nav", "navx")]
    df = spark.createDataFrame(cases, "h string, m string, p string")
    for r in df.select("*", epub.content_document(F.col("h"), F.col("m"), F.col("p")).alias("is")).collect():
        assert r["is"] == epub.is_content(r["h"], (r["m"] or "").strip().lower(), (r["p"] or "").split()), r


def test_artifacts_given_as_text(spark):
    one = '{"schema_version": 1, "sentences": ["a", "b"], "llm_model": "m"}'
    df = spark.createDataFrame([(7, one)], "k int, body string")
    assert [tuple(r) for r in art.records(df, "k", "body", "sentences", "llm_model string").orderBy("pos").collect()] == [(7, "m", 0, "a"), (7, "m", 1, "b")]
    for bad, said in (('{"schema_version": 2, "sentences": []}', "schema_version 2"), ('{"schema_version": 1}', "sentences"), ('{"schema_version": 1, "sent', "(?i)malformed|parse")):
        with pytest.raises(Exception, match=said):
            art.records(spark.createDataFrame([(7, bad)], "k int, body string"), "k", "body", "sentences").collect()
    assert art.records(df.limit(0), "k", "body", "sentences").count() == 0


def test_answers_as_columns(spark):
    df = spark.createDataFrame([(0, None), (1, "{"), (2, '{"words": [{"lemma": " a  b ", "word_type": "x"}]}'), (3, '{"kind": "toc", "is_content": true, "sentences": [" x "]}')], "i int, b string")
    got = df.select(va.word_answers(F.col("b")).alias("w"), va.chapter_answers(F.col("b")).alias("c")).orderBy("i").collect()
    assert got[0]["w"] is None and got[0]["c"] is None and got[1]["w"]["words"] is None and got[1]["c"]["error"]
    assert got[2]["w"]["words"][0]["lemma"] == "a b" and got[2]["w"]["error"] is None and got[3]["c"]["sentences"] == ["x"] and "words" in got[3]["w"]["error"]
