import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.model import Model
from wortsee.operators import chapters as ch
from wortsee.operators import checkpoint as cp
from wortsee.operators import extract as ex
from wortsee.operators import known as kn
from wortsee.operators import sentences as se
from wortsee.operators import validation as va
from wortsee.operators import wordlist as wl

WORDS = "array<struct<lemma:string,word_type:string,article:string>>"


def build(spark, sentences, known=None, **options):
    rows = spark.createDataFrame([(i, t, n, w) for i, (t, n, w) in enumerate(sentences)], f"ord long, text string, count long, words {WORDS}")
    keys = None if known is None else kn.keys(kn.entries(spark.createDataFrame([(k,) for k in known], "w string"), "w"))
    made = wl.build(wl.explode_words(rows, []), [], keys, **options).orderBy(*wl.order([]))
    return [(r["lemma"], r["word_type"], r["article"], r["count"], list(r["sentences"])) for r in made.collect()]


def test_words_are_counted_with_examples_in_order(spark):
    s = [("Er läuft.", 1, [("laufen", "verb", None)]), ("Sie laufen.", 1, [("laufen", "verb", None)])]
    assert build(spark, s) == [("laufen", "verb", None, 2, ["Er läuft.", "Sie laufen."])]


def test_multiplicity_counts_but_gives_one_example(spark):
    assert build(spark, [("Ja.", 3, [("ja", "other", None)])]) == [("ja", "other", None, 3, ["Ja."])]


def test_homonyms_article_and_first_form(spark):
    s = [("a", 1, [("Laufen", "noun", None), ("laufen", "verb", None)]), ("b", 1, [("LAUFEN", "noun", "das")])]
    assert build(spark, s) == [("Laufen", "noun", "das", 2, ["a", "b"]), ("laufen", "verb", None, 1, ["a"])]


def test_known_words_leave(spark):
    s = [("Der Hund bellt.", 1, [("Hund", "noun", "der"), ("bellen", "verb", None), ("Strasse", "noun", "die"), ("Bäume", "noun", None)])]
    assert [e[0] for e in build(spark, s, ["der Hund", "Straße", "Baume"])] == ["Bäume", "bellen"] or [e[0] for e in build(spark, s, ["der Hund", "Straße", "Baume"])] == ["bellen", "Bäume"]
    assert len(build(spark, s, [])) == 4


def test_min_count_and_order(spark):
    s = [("1", 1, [("Zebra", "noun", None), ("Katze", "noun", None), ("Affe", "noun", None)]), ("2", 1, [("Katze", "noun", None)])]
    assert [e[0] for e in build(spark, s)] == ["Katze", "Affe", "Zebra"]
    assert [e[0] for e in build(spark, s, min_count=2)] == ["Katze"]


def test_empty_and_null_words(spark):
    assert build(spark, []) == []
    assert build(spark, [("a", None, [(None, "noun", None), ("b", "noun", None)])], min_count=0) == [("b", "noun", None, 0, ["a"])]


def test_build_equals_a_plain_fold(spark):
    rnd = random.Random(5)
    s = [(f"s{rnd.randrange(40)}", rnd.randrange(1, 4), [(rnd.choice(["Ha", "ha", "Maß", "mass", "b"]), rnd.choice(["noun", "verb"]), rnd.choice([None, "der"])) for _ in range(rnd.randrange(4))]) for _ in range(150)]
    fold = {}
    for text, n, words in s:
        for lemma, kind, article in words:
            e = fold.setdefault((lemma.casefold(), kind), [lemma, kind, article, 0, []])
            e[2] = e[2] or article
            e[3] += n
            if text not in e[4]:
                e[4].append(text)
    assert build(spark, s) == [tuple(e) for e in sorted(fold.values(), key=lambda e: (-e[3], e[0].casefold(), e[1]))]


def test_join_segments(spark):
    rows = spark.createDataFrame([(1, 0, "Der Hund "), (1, 1, ""), (1, 2, "　 "), (1, 3, "bellt laut."), (1, 4, None), (2, 0, " ")], "g int, o int, t string")
    assert {r["g"]: r["text"] for r in se.join_segments(rows, ["g"], "o", "t").collect()} == {1: "Der Hund bellt laut.", 2: ""}


def sentences_of(spark, text, **options):
    docs = spark.createDataFrame([(1, text)], "d int, t string")
    return [r["text"] for r in se.split_documents(docs, ["d"], "t", **options).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Das ist z. B. ein Hund. Dr. Müller kommt heute.", ["Das ist z. B. ein Hund.", "Dr. Müller kommt heute."]),
        ("Der  Hund\n bellt.  Er  schläft.", ["Der Hund bellt.", "Er schläft."]),
        ("Am 3. Oktober ist frei. Er wohnt im 2. Stock.", ["Am 3. Oktober ist frei.", "Er wohnt im 2. Stock."]),
        ("Das war 1998. Dann kam er.", ["Das war 1998.", "Dann kam er."]),
        (" \n", []),
    ],
)
def test_rule_split(spark, text, expected):
    assert sentences_of(spark, text) == expected


def test_other_segmenter(spark):
    assert sentences_of(spark, "a|b  c", segmenter=lambda t: t.split("|")) == ["a", "b c"]


def test_ordinal_merge_equals_a_fold(spark):
    import re

    rnd = random.Random(3)
    groups = {g: [rnd.choice(["Am 3.", "Oktober.", "im 12.", "x", "1998.", "7."]) for _ in range(rnd.randrange(9))] for g in range(60)}
    rows = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g int, pos int, text string")
    got = {g: [] for g in groups}
    for r in se.merge_ordinals(rows, ["g"], "pos", "text").orderBy("g", "pos").collect():
        got[r["g"]].append(r["text"])
    for g, ts in groups.items():
        fold = []
        for t in ts:
            if fold and re.search(r"(?:^|\s)\d{1,2}\.$", fold[-1]):
                fold[-1] += " " + t
            else:
                fold.append(t)
        assert got[g] == fold


def test_distinct_sentences(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "pos int, text string")
    assert [(r["text"], r["count"]) for r in se.distinct_sentences(rows, [], "pos", "text").orderBy("ord").collect()] == [("a", 2), ("b", 1)]


def parts_of(spark, html, limit):
    return spark.createDataFrame([(html,)], "h string").select(ch.split_markup(F.col("h"), limit)).first()[0]


def test_split_markup(spark):
    rnd = random.Random(1)
    for _ in range(25):
        html = "".join(rnd.choice(["<p>", "<DIV>", "<pre>", "x", "ü", "😀", "<h1>", "</p>"]) for _ in range(rnd.randrange(200)))
        parts = parts_of(spark, html, 60)
        assert "".join(parts) == html and all(len(p) <= 60 for p in parts)
    assert parts_of(spark, "x" * 150, 60) == ["x" * 60, "x" * 60, "x" * 30]
    assert parts_of(spark, "<p>" + "a" * 30 + "<p>" + "b" * 40, 60) == ["<p>" + "a" * 30, "<p>" + "b" * 40]
    assert parts_of(spark, "", 60) == [""]
    assert parts_of(spark, None, 60) is None


def test_verdicts_of_parts(spark):
    rows = spark.createDataFrame([(1, 0, "toc", False, []), (1, 1, "chapter", True, ["a"]), (1, 2, "other", True, ["b"]), (2, 1, "index", False, []), (2, 0, "cover", False, ["x"])], "d int, part int, kind string, is_content boolean, sentences array<string>")
    got = ch.combine_parts(rows, ["d"])
    assert {r["d"]: (r["kind"], r["is_content"], list(r["sentences"])) for r in got.collect()} == {1: ("chapter", True, ["a", "b"]), 2: ("cover", False, [])}
    assert [r["text"] for r in ch.content_sentences(got, ["d"]).orderBy("pos").collect()] == ["a", "b"]


def test_selection():
    assert ch.parse_selection("0, 3-5 ,8") == [(0, 0), (3, 5), (8, 8)]
    for bad in ("", "abc", "5-2", "1-", " , "):
        with pytest.raises(ValueError, match="--chapters"):
            ch.parse_selection(bad)


def test_paragraphs(spark):
    html = "<html><head><title>no</title></head><body><h1>Kapitel&nbsp;1</h1><p>Ein <b>Satz</b>.<br/>Zwei<p>Drei<script>x</script></body>"
    nested = "<h1><div>X</div></h1><p>Y"
    got = spark.createDataFrame([(html,), (nested,), (None,), ("",)], "h string").select(ch.paragraphs(F.col("h")).alias("p")).select("p.*").collect()
    assert [(r["title"], r["paragraphs"]) for r in got] == [("Kapitel 1", ["Kapitel 1", "Ein Satz.", "Zwei", "Drei"]), (None, ["X", "Y"]), (None, []), (None, [])]


def test_known_shapes(spark):
    assert kn.from_response(["laufen", " Haus ", ""]) == ["laufen", " Haus ", ""]
    assert kn.from_response({"words": [{"word": "laufen"}, {"lemma": "Haus"}, {"word": "", "lemma": "x"}]}) == ["laufen", "Haus", "x"]
    for bad in ("laufen", {"items": []}, [{"name": "x"}], [42], [{"word": 5}]):
        with pytest.raises(ValueError):
            kn.from_response(bad)
    rows = spark.createDataFrame([(1, '["laufen"," Haus ",""]'), (2, '{"words":["a"]}'), (3, '[{"word":"b"},{"lemma":"c"},5]'), (4, "{"), (5, '"x"')], "i int, b string")
    got = {}
    for r in kn.shapes(rows, "b", ["i"]).collect():
        got.setdefault(r["i"], []).append(r["word"])
    assert got == {1: ["laufen", " Haus ", ""], 2: ["a"], 3: ["b", "c", None], 4: [None], 5: [None]}
    assert [r[0] for r in kn.entries(kn.shapes(rows, "b", ["i"]), "word").orderBy("entry").collect()] == ["a", "b", "c", "haus", "laufen"]


def test_checkpoint(spark):
    lines = spark.createDataFrame([(1, 1, '{"text":"a","words":[]}'), (1, 2, " "), (1, 3, '{"text": "Er f'), (2, 1, "[]"), (2, 2, '{"text":"b"}'), (3, 1, None)], "g int, n int, l string")
    got = cp.parsed_lines(lines, ["g"], "n", "l")
    assert {(r["g"], r["n"]): r["status"] for r in got.collect()} == {(1, 1): "record", (1, 2): "blank", (1, 3): "torn", (2, 1): "bad", (2, 2): "record", (3, 1): "blank"}
    assert sorted(r["text"] for r in cp.records(got, "l").collect()) == ["a", "b"]


def test_resume(spark):
    items = spark.createDataFrame([("a",), ("b",)], "text string")
    old = spark.createDataFrame([("a", 1), ("z", 9)], "text string, v int")
    assert [r[0] for r in cp.pending(items, old, ["text"]).collect()] == ["b"]
    assert [r[0] for r in cp.still_wanted(old, items, ["text"]).collect()] == ["a"]
    both = cp.fold_in(old, spark.createDataFrame([("a", 2)], "text string, v int"), ["text"])
    assert {r["text"]: r["v"] for r in both.collect()} == {"a": 2, "z": 9}


def test_word_answers():
    w = lambda lemma, article=None, kind="noun": {"lemma": lemma, "word_type": kind, "article": article}
    assert va.word_answer({"words": [w(" Hund  x", "der"), w("HUND X")]}) == [("Hund x", "noun", "der")]
    for bad in ([], {"words": 1}, {"words": [1]}, {"words": [w(" ")]}, {"words": [w("a", "den")]}, {"words": [w("a", None, "")]}):
        with pytest.raises(ValueError):
            va.word_answer(bad)
    assert va.chapter_answer({"kind": "toc", "is_content": False, "sentences": [" a  b ", " "]}) == ("toc", False, ["a b"])
    for bad in ({"kind": "", "is_content": True, "sentences": []}, {"kind": "x", "is_content": 1, "sentences": []}, {"kind": "x", "is_content": True, "sentences": [1]}):
        with pytest.raises(ValueError):
            va.chapter_answer(bad)


@pytest.mark.parametrize(("choice", "said"), [({"finish_reason": "length", "message": {}}, "cut off"), ({"message": {"refusal": "no"}}, "refused"), ({"message": {"content": ""}}, "no content"), ({"message": {"content": "{"}}, "valid JSON"), ({}, "unexpected")])
def test_completions(choice, said):
    with pytest.raises(va.AnswerError, match=said):
        va.completion({"choices": [choice]}, "x")
    assert va.completion({"choices": [{"message": {"content": '{"a":1}'}}]}, "x") == {"a": 1}


def test_each_distinct_sentence_is_asked_once(spark):
    rows = spark.createDataFrame([("Ein Hund.",), ("Ein Hund.",), ("Ein Rad.",), (None,)], "t string")
    done = spark.createDataFrame([("Ein Rad.",)], "text string")
    got = ex.ask_words(rows, "t", ex.token_extractor, done).collect()
    assert [(r["text"], [w["lemma"] for w in r["words"]], r["error"]) for r in got] == [("Ein Hund.", ["Ein", "Hund"], None)]
    assert ex.ask_words(rows.limit(0), "t", ex.token_extractor).count() == 0


def test_starts_keep_the_rate_in_any_window():
    s = ex.Starts(2)
    assert [s.next_time(t) for t in (0.0, 0.0, 1.0, 1.0, 70.0, 200.0)] == [0.0, 0.0, 60.0, 60.0, 120.0, 200.0]
    rnd = random.Random(3)
    s, now, given = ex.Starts(5), 0.0, []
    for _ in range(200):
        now += rnd.choice([0, 0, 1, 30])
        given.append(s.next_time(now))
    assert given == sorted(given) and all(b - a >= 60 for a, b in zip(given, given[5:]))
    with pytest.raises(ValueError):
        ex.Starts(0)


def test_at_most_so_many_at_a_time_and_none_after_an_error():
    import threading
    import time

    now, most, lock = [0], [0], threading.Lock()

    def work(n):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        if n == 12:
            raise ValueError("no")
        return n

    got = list(ex.in_flight(iter(range(100)), work, 4))
    assert 1 < most[0] <= 4 and len(got) < 20 and [str(e) for *_, e in got if e] == ["no"]
    assert [u for u, *_ in ex.in_flight(iter(range(100)), work, 1)] == list(range(13))


def test_requests_keep_the_rate_over_batches_and_are_tried_again(spark, monkeypatch):
    from wortsee import cli
    from wortsee.operators import prompts

    model = Model()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(f"Satz {i}.",) for i in range(18)], "t string")
        ask = ex.chat_extractor(ex.with_retries(cli.post(model.url)), "m", prompts.WORDS, prompts.WORDS_FORMAT)
        got = ex.ask_words(rows, "t", ask, pace=ex.Pace(8, 3, 1, name="rate test", window=1.0)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        model.server.shutdown()
    assert len(got) == 18 and all(r["error"] is None and r["words"][0]["lemma"] == "Satz" for r in got)
    body, key = model.bodies[0]
    assert body["messages"][0] == {"role": "system", "content": prompts.WORDS} and body["response_format"]["json_schema"]["strict"] and key.startswith("Bearer")
    assert len(model.times) > 18 and model.times[-1] - model.times[0] >= 2 - 0.2  # 18 starts at 8 in a second
    with pytest.raises(ValueError, match="spread"):
        ex.ask_words(rows, "t", ask, pace=ex.Pace(2, 1, 4))


def test_a_bad_answer_loses_no_other(spark, tmp_path):
    model, journal = Model("Satz 9."), tmp_path / "x.jsonl"
    from wortsee import cli

    rows = spark.createDataFrame([(f"Satz {i}.",) for i in range(12)], "t string")
    ask = ex.chat_extractor(ex.with_retries(cli.post(model.url)), "m", "", {})
    got = ex.ask_words(rows, "t", ask, pace=ex.Pace(None, 2, 1, str(journal))).collect()
    model.server.shutdown()
    good = {r["text"] for r in got if r["error"] is None}
    assert [r["text"] for r in got if r["error"]] == ["Satz 9."] and {json.loads(x)["text"] for x in journal.read_text().splitlines()} == good


def test_documents_are_judged_part_by_part(spark, tmp_path):
    asked = []

    def judge(text, what):
        with open(tmp_path / "asked", "a") as f:
            f.write(what + "\n")
        return {"kind": "chapter" if "b" in text.partition("\n\n")[2] else "toc", "is_content": "b" in text.partition("\n\n")[2], "sentences": [text.partition("\n\n")[2]]}

    rows = spark.createDataFrame([(0, "x.html", ["a", "b1", "b2"]), (1, "y.html", ["c"]), (2, "z.html", [])], "n int, h string, parts array<string>")
    got = {r["href"]: (r["kind"], r["is_content"], r["sentences"]) for r in ex.ask_documents(rows, "h", "n", "parts", judge, ex.Pace(None, 2, 1, str(tmp_path / "j"))).collect()}
    assert got == {"x.html": ("chapter", True, ["b1", "b2"]), "y.html": ("toc", False, []), "z.html": ("other", False, [])}
    asked = (tmp_path / "asked").read_text().splitlines()
    assert [a for a in asked if "x.html" in a] == [f"chapter 0 (x.html), part {k} of 3" for k in (1, 2, 3)] and "chapter 1 (y.html)" in asked
    assert len((tmp_path / "j").read_text().splitlines()) == 3


def test_ordinals_are_put_together_over_blocks(spark):
    rnd = random.Random(5)
    rows = [(g, p, rnd.choice(["Am 3.", "Mai 4.", "Das war 12.", "Ende.", "", None, "So 123."])) for g in (1, 2, None) for p in rnd.sample(range(-20, 200), 90)]
    df = spark.createDataFrame(rows, "g int, pos int, text string").withColumn("x", F.lit(1))
    expected = {}
    for g in (1, 2, None):
        merged, last = [], ""
        for p, t in sorted(((p, t) for a, p, t in rows if a == g), key=lambda r: r[0]):
            if merged and re.search(r"(^|\s)\d{1,2}\.$", last or ""):
                merged[-1][1].append(t)
            else:
                merged.append((p, [t]))
            last = t
        expected |= {(g, p): " ".join(t for t in ts if t is not None) for p, ts in merged}
    for block in (1, 3, 1000):
        got = {(r["g"], r["pos"]): r["text"] for r in se.merge_ordinals(df, ["g"], "pos", "text", block).collect()}
        assert got == expected, block
    assert se.merge_ordinals(df.limit(0), ["g"], "pos", "text").count() == 0


def test_examples_as_rows_and_counts(spark):
    rows = spark.createDataFrame([(i, t, 1, [("Hund", "noun", None)]) for i, t in enumerate(["b", "a", "b", None])], f"ord long, text string, count long, words {WORDS}")
    words = wl.explode_words(rows, [])
    assert [(r["text"], r["at"]["s_ord"]) for r in wl.example_rows(words, []).orderBy("at").collect()] == [("b", 0), ("a", 1)]
    r = wl.build(words, [], examples="count").first()
    assert (r["count"], r["n_sentences"]) == (4, 2)


def test_dedup_within_a_sentence(spark):
    rows = spark.createDataFrame([(1, "t", 1, [("Hund", "noun", "der"), ("hund", "noun", None), ("Hund", "verb", None)])], f"ord long, text string, count long, words {WORDS}")
    got = wl.dedup_words(wl.explode_words(rows, []), ["s_ord"]).orderBy("w_ord").collect()
    assert [(r["lemma"], r["word_type"], r["article"]) for r in got] == [("Hund", "noun", "der"), ("Hund", "verb", None)]
