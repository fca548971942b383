import io
import json
import subprocess
import zipfile

import pytest

from tests.model import Model
from wortsee import cli
from wortsee.errors import BadInput
from wortsee.functions.markup import decode
from wortsee.operators.extract import Pace, token_extractor
from wortsee.operators.validation import AnswerError
from wortsee.plans import stages
from wortsee.sources import artifacts as art
from wortsee.sources import audio, epub, jsonl, known_api
from wortsee.streaming.pending import answer_stream

CONTAINER = '<container xmlns="u"><rootfiles><rootfile full-path="OEBPS/pack%20age.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="d"><metadata><dc:title/><dc:title>Das  Buch</dc:title><dc:creator>A. B.</dc:creator></metadata>
<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c" href="cover.xhtml" media-type="application/xhtml+xml"/>
<item id="a" href="text/k%20a.xhtml#x" media-type="application/xhtml+xml"/><item id="b" href="b.htm"/><item id="i" href="x.png" media-type="image/png"/><item id="m" href="missing.xhtml" media-type="text/html"/></manifest>
<spine><itemref idref="nav"/><itemref idref="c"/><itemref idref="zzz"/><itemref idref="i"/><itemref idref="a"/><itemref idref="m"/><itemref idref="b"/></spine></package>"""


def book(**more):
    members = {"META-INF/container.xml": CONTAINER, "OEBPS/pack age.opf": OPF, "OEBPS/cover.xhtml": "<html><body><img/></body></html>", "OEBPS/text/k a.xhtml": "<h1>Eins</h1><p>Ein Satz. Noch einer.</p>", "OEBPS/b.htm": "<p>Ende."} | more
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in members.items():
            if text is not None:
                z.writestr(name, text)
    return buffer.getvalue()


def test_book():
    said, found = epub.read_book(book(), "x")
    assert said == {"title": "Das Buch", "creator": "A. B.", "language": None}
    assert [f[:4] for f in found] == [(0, "OEBPS/cover.xhtml", "cover.xhtml", 0), (1, "OEBPS/text/k a.xhtml", "Eins", 25), (3, "OEBPS/b.htm", "b.htm", 5)]
    assert [f[0] for f in epub.read_book(book(), "x", [(1, 2)])[1]] == [1]


@pytest.mark.parametrize(
    ("data", "said"),
    [(b"no zip", "not a ZIP"), (book(**{"META-INF/encryption.xml": ""}), "DRM"), (book(**{"META-INF/container.xml": None}), "no META-INF"), (book(**{"OEBPS/pack age.opf": None}), "missing from"), (book(**{"OEBPS/pack age.opf": "<a"}), "well-formed"), (book(**{"META-INF/container.xml": "<a/>"}), "no rootfile"), (book(**{"OEBPS/pack age.opf": "<a/>"}), "no XHTML")],
)
def test_bad_books(data, said):
    with pytest.raises(ValueError, match=said):
        epub.read_book(data, "x")


def test_book_scan(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.epub").write_bytes(b"bad")
    rows = epub.scan(spark, str(tmp_path), "1-9", on_error="row").collect()
    assert sorted((r["index"] if r["error"] is None else -1) for r in rows) == [-1, 1, 3]
    assert {r["book_title"] for r in rows} == {"Das Buch", None}


def test_decode():
    assert decode("\n<?xml version='1.0' encoding=\"iso-8859-1\"?>ü".encode("latin-1")).endswith("ü")
    assert decode("ü".encode()) == "ü" and decode("ü".encode("cp1252")) == "ü"
    assert decode(b"\x81\xff") == "��" and decode(b"<?xml encoding='nonsense'?>\xc3\xbc").endswith("ü")


def test_artifacts(tmp_path):
    p = tmp_path / "d" / "x.json"
    art.write_document(p, {"schema_version": 1, "a": "ü"})
    assert p.read_text(encoding="utf-8").endswith('"ü"\n}\n') and art.read_document(p)["a"] == "ü" and art.cached(p, False) and not art.cached(p, True)
    for text, said in (('{"schema', "not valid JSON"), ("", "it is empty"), ("<html>", "not valid JSON"), ("[]", "expected a JSON object"), ('{"schema_version": 99}', "schema_version 99")):
        p.write_text(text)
        with pytest.raises(ValueError, match=said):
            art.read_document(p)
    p.write_bytes(b"\xff")
    with pytest.raises(ValueError, match="not UTF-8"):
        art.read_document(p)
    with pytest.raises(FileNotFoundError, match="artifact not found"):
        art.read_document(tmp_path / "none")
    with pytest.raises(ValueError, match="missing"):
        art.record_list({}, "a", "p")
    with pytest.raises(ValueError, match="a str"):
        art.record_list({"a": "x"}, "a", "p")
    with pytest.raises(ValueError, match="malformed"):
        art.sentence_word_rows({"sentences": [{"text": "a", "count": 1, "words": [{"lemma": "a", "word_type": "x", "extra": 1}]}]})


def test_artifact_scan(spark, tmp_path):
    art.write_document(tmp_path / "a.json", {"schema_version": 1, "sentences": ["x", "y"], "llm_model": "m"})
    rows = art.scan(spark, str(tmp_path / "a.json"), "sentences", "llm_model string").orderBy("pos").collect()
    assert [(r["pos"], r["record"], r["llm_model"]) for r in rows] == [(0, "x", "m"), (1, "y", "m")]
    art.write_document(tmp_path / "b.json", {"schema_version": 2, "sentences": []})
    with pytest.raises(Exception, match="schema_version 2"):
        art.scan(spark, str(tmp_path / "b.json"), "sentences").collect()


def test_jsonl(tmp_path):
    p = tmp_path / "c.jsonl"
    assert jsonl.read_lines(p) == []
    good = json.dumps({"text": "a", "words": []})
    p.write_text(good + '\n\n{"text": "Er f')
    assert jsonl.word_answers(p) == {"a": []}
    p.write_text("bad\n" + good)
    with pytest.raises(ValueError, match=":1"):
        jsonl.read_lines(p)
    p.write_text(json.dumps({"index": 1, "href": "h", "kind": "toc", "is_content": False, "sentences": []}))
    assert jsonl.chapter_answers(p) == {(1, "h"): ("toc", False, [])}


def test_known_api(spark):
    sent = []

    def answer(status, kind, body):
        return lambda url, headers, timeout: (sent.append(headers), (status, kind, body))[1]

    assert known_api.fetch("u", "t", transport=answer(200, "", '["a"]')) == ["a"] and sent[-1] == {"Authorization": "Bearer t"}
    known_api.fetch("u", None, transport=answer(200, "", "[]"))
    assert sent[-1] == {}
    for status, kind, body, said in ((401, "", "no", "token may be"), (404, "", "", "<empty body>"), (500, "", "x" * 300, r"\.\.\."), (200, "text/html; x", "<html>", "text/html"), (200, "", '{"a":1}', "words")):
        with pytest.raises(known_api.KnownWordsError, match=said):
            known_api.fetch("u", "t", transport=answer(status, kind, body))

    def dead(*_):
        raise OSError("gone")

    with pytest.raises(known_api.KnownWordsError, match="cannot reach"):
        known_api.fetch("u", transport=dead)
    assert [r[0] for r in known_api.known_entries(spark, [" Straße ", "strasse", ""]).collect()] == ["strasse"]


def test_audio(spark, tmp_path):
    payload = json.dumps({"streams": [{"codec_name": "ac3", "channels": 6, "tags": {"language": "ger", "title": "T"}}, {"channels": 2, "tags": {}}, {}]})
    expected = [(0, "ac3", 6, "ger", "T"), (1, "?", 2, "und", ""), (2, "?", None, "und", "")]
    assert [tuple(r.values()) for r in audio.track_rows(payload)] == expected
    rows = audio.tracks(spark.createDataFrame([(payload,)], "p string"), [], "p").orderBy("track").collect()
    assert [tuple(r) for r in rows] == expected
    assert "language=ger, ac3, 6ch (T)" in audio.format_tracks(audio.track_rows(payload)) and "no audio" in audio.format_tracks([])
    command = audio.extract_command("a.mkv", "b.flac", track=2)
    assert command[command.index("-map") + 1] == "0:a:2" and command[-1] == "b.flac"
    assert "0:a:m:language:ger" in audio.extract_command("a", "b", track=2, language="ger") and "0:a:0" in audio.extract_command("a", "b")
    assert audio.extract("none", tmp_path / "x", dry_run=True) == tmp_path / "x"
    with pytest.raises(FileNotFoundError):
        audio.extract(tmp_path / "none", tmp_path / "x")
    (tmp_path / "in").write_text("x")

    def fail(command, check):
        raise subprocess.CalledProcessError(1, command)

    with pytest.raises(RuntimeError, match="exit 1"):
        audio.extract(tmp_path / "in", tmp_path / "x", run=fail)
    with pytest.raises(RuntimeError, match="missing or empty"):
        audio.extract(tmp_path / "in", tmp_path / "x", run=lambda c, check: None)
    assert audio.pick_device("cuda") == ("cuda", "float16") and audio.pick_device("auto", lambda: 1) == ("cuda", "float16") and audio.pick_device("auto", lambda: 0) == ("cpu", "int8")
    assert audio.pick_backend("auto", "darwin", "arm64", lambda m: True) == "mlx" and audio.pick_backend("auto", "linux") == "faster-whisper" and audio.pick_backend("mlx") == "mlx"
    assert audio.mlx_repository("a/b") == "a/b" and audio.mlx_repository("tiny").endswith("whisper-tiny-mlx")
    assert audio.progress_line(900, 9000, 600) == "10.0% (900/9000 s of audio, 1.50x realtime, ~90 min left)" and "ETA unknown" in audio.progress_line(0, 10, 0)
    got = audio.recognise(spark.createDataFrame([("f",)], "path string"), "path", lambda p: audio.Heard([(0, 0.123, 2.675, " Hallo ")])).collect()
    assert [tuple(r) for r in got] == [("f", 0, 0.12, 2.67, "Hallo")]


def test_a_film_from_speech_to_list(spark, tmp_path):
    (tmp_path / "f.flac").write_text("x")
    heard = [(0, 0, 1, " Der Hund "), (1, 1, 2, ""), (2, 2, 3, "bellt. Der Hund bellt. Am 3. Mai.")]
    t = stages.speech(tmp_path / "f.flac", tmp_path / "t.json", lambda p: audio.Heard(iter(heard), 4.125, "nl", "b", "cpu", "int8"), "m")
    assert [t[k] for k in ("duration", "language", "backend", "device", "compute_type", "model", "text")] == [4.12, "nl", "b", "cpu", "int8", "m", "Der Hund  bellt. Der Hund bellt. Am 3. Mai."]
    assert stages.speech(tmp_path / "f.flac", tmp_path / "t2.json", lambda p: audio.Heard(iter(heard)), "m")["duration"] == 3
    s = stages.sentences(spark, tmp_path / "t.json", tmp_path / "s.json")
    assert s["sentences"] == ["Der Hund bellt.", "Der Hund bellt.", "Am 3. Mai."]
    stages.partial(tmp_path / "w.json").write_text(json.dumps({"text": "Am 3. Mai.", "words": [{"lemma": "Mai", "word_type": "noun", "article": "der"}]}) + '\n{"text": "torn')
    w = stages.words(spark, tmp_path / "s.json", tmp_path / "w.json", token_extractor, "m")
    assert [(x["text"], x["count"]) for x in w["sentences"]] == [("Der Hund bellt.", 2), ("Am 3. Mai.", 1)] and w["sentences"][1]["words"][0]["lemma"] == "Mai"
    assert not stages.partial(tmp_path / "w.json").exists()
    b = stages.build(spark, tmp_path / "w.json", tmp_path / "l.json", ["der Hund"], "url")
    assert [(e["lemma"], e["count"]) for e in b["words"]] == [("bellt", 2), ("Der", 2), ("Mai", 1)]
    assert json.loads((tmp_path / "known-words.json").read_text())["match_keys"] == ["der hund", "hund"]
    (tmp_path / "e.json").write_text('{"schema_version": 1, "segments": [{"text": " "}]}')
    with pytest.raises(ValueError, match="no text"):
        stages.sentences(spark, tmp_path / "e.json", tmp_path / "e2.json")


def test_answers_survive_a_crash(spark, tmp_path):
    texts = [f"Satz {i}." for i in range(9)]
    art.write_document(tmp_path / "s.json", {"schema_version": 1, "sentences": texts})

    def ask(text, what):
        with open(tmp_path / "asked", "a") as f:
            f.write(text + "\n")
        if text == "Satz 5." and not (tmp_path / "well").exists():
            raise RuntimeError("gone")
        return token_extractor(text)

    out = tmp_path / "w.json"
    stages.partial(out).write_text(json.dumps({"text": "Satz 0.", "words": []}))  # whole, but its line is not ended
    with pytest.raises(AnswerError, match="gone.*run the stage again"):
        stages.words(spark, tmp_path / "s.json", out, ask, "m", pace=Pace(None, 2, 1))
    kept = set(jsonl.word_answers(stages.partial(out)))
    assert kept == set((tmp_path / "asked").read_text().split("\n")) - {"Satz 5.", ""} | {"Satz 0."}
    (tmp_path / "well").touch()
    (tmp_path / "asked").unlink()
    w = stages.words(spark, tmp_path / "s.json", out, ask, "m", pace=Pace(None, 2, 1))
    assert [s["text"] for s in w["sentences"]] == texts and set((tmp_path / "asked").read_text().split()) and not kept & set((tmp_path / "asked").read_text().split("\n"))
    assert not stages.partial(out).exists()


def test_lists_as_tables(spark, tmp_path):
    words = lambda *ws: [{"lemma": w, "word_type": "noun", "article": None} for w in ws]
    for n, said in (("a", [("Der Hund.", 2, words("Hund")), ("Ein Rad.", 1, words("Rad", "hund"))]), ("b", [("Der Hund.", 1, words("Hund"))])):
        art.write_document(tmp_path / f"in/{n}.json", {"schema_version": 1, "sentences": [{"text": t, "count": c, "words": w} for t, c, w in said]})
    stages.build_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"), known=["das Rad"])
    got = spark.read.parquet(str(tmp_path / "out/words")).collect()
    assert sorted((r["file"][-6:], r["lemma"], r["count"], r["n_sentences"]) for r in got) == [("a.json", "Hund", 3, 2), ("b.json", "Hund", 1, 1)]
    assert spark.read.parquet(str(tmp_path / "out/examples")).count() == 3


def test_a_book_from_file_to_sentences(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(book())
    c = stages.book(tmp_path / "b.epub", tmp_path / "c.json")
    assert (c["total_chapters"], c["char_count"], c["title"]) == (3, 30, "Das Buch")

    def judge(text, what):
        return {"kind": "chapter", "is_content": True, "sentences": ["Ein  Satz."]} if "Satz" in text else {"kind": "cover", "is_content": False, "sentences": []}

    s = stages.sentences(spark, tmp_path / "c.json", tmp_path / "s.json", judge, "m")
    assert s["sentences"] == ["Ein Satz."] and [x["kind"] for x in s["chapters"]] == ["cover", "chapter", "cover"]
    with pytest.raises(ValueError, match="no chapter"):
        stages.sentences(spark, tmp_path / "c.json", tmp_path / "s2.json", lambda *_: {"kind": "toc", "is_content": False, "sentences": []}, "m")


def test_command_line(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "b.epub").write_bytes(book())
    assert cli.main(["epub", "b.epub", "--list-chapters"]) == 0 and "--chapters 1: Eins (25 chars" in capsys.readouterr().out
    assert cli.main(["epub", "b.epub", "-o", "c.json", "--chapters", "1"]) == 0 and art.read_document("c.json")["total_chapters"] == 1
    assert cli.main(["--force", "epub", "b.epub", "-o", "c.json", "--chapters", "x"]) == 1 and "--chapters" in capsys.readouterr().err
    assert cli.main(["build", "none.json"]) == 1 and "artifact not found" in capsys.readouterr().err
    assert cli.error_line(KeyError("x")) == "KeyError: 'x'" and cli.error_line(BadInput("a")) == "a" and cli.error_line(RuntimeError()) == "RuntimeError" and cli.error_line(ValueError("a")) == "ValueError: a"


def test_the_words_stage_from_the_command_line(spark, tmp_path, monkeypatch, capsys):
    model = Model()
    monkeypatch.chdir(tmp_path)
    art.write_document("s.json", {"schema_version": 1, "sentences": ["Ein Hund.", "Ein Rad.", "Ein Hund."]})
    (tmp_path / ".env").write_text(f"OPENAI_API_KEY=k\nexport OPENAI_MODEL='m'\nOPENAI_BASE_URL={model.url.removesuffix('/chat/completions')}\n")
    for name in ("OPENAI_API_KEY", "OPENAI_MODEL", "OPENAI_BASE_URL"):
        monkeypatch.delenv(name, raising=False)
    with monkeypatch.context() as m:
        m.setattr(cli, "load_env", lambda: None)
        assert cli.main(["words", "s.json", "-o", "w.json"]) == 1 and "OPENAI_MODEL is not set" in capsys.readouterr().err
    try:
        assert cli.main(["words", "s.json", "-o", "w.json", "--llm-rpm", "600", "--llm-concurrency", "2"]) == 0
    finally:
        model.server.shutdown()
        for name in ("OPENAI_API_KEY", "OPENAI_MODEL", "OPENAI_BASE_URL"):
            monkeypatch.delenv(name, raising=False)
    w = art.read_document("w.json")
    assert w["llm_model"] == "m" and [(s["text"], s["count"], [x["lemma"] for x in s["words"]]) for s in w["sentences"]] == [("Ein Hund.", 2, ["Ein", "Hund"]), ("Ein Rad.", 1, ["Ein", "Rad"])]
    assert cli.main(["words", "s.json", "-o", "w2.json", "--llm-rpm", "0"]) == 1 and not (tmp_path / "w.json.partial.jsonl").exists()


def test_answers_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Ein Hund.\nEin Hund.\nEin Rad.\nEin Dach.\n")
    known = spark.createDataFrame([("Ein Dach.", [])], "text string, words array<struct<lemma:string,word_type:string,article:string>>")

    def ask(text, what):
        with open(tmp_path / "asked", "a") as f:
            f.write(text + "\n")
        if text == "Eine Uhr." and not (tmp_path / "well").exists():
            raise RuntimeError("gone")
        return token_extractor(text)

    def go():
        answer_stream(spark.readStream.text(str(tmp_path / "in")), "value", ask, str(tmp_path / "answers"), str(tmp_path / "cp"), known=known).awaitTermination()

    go()
    (tmp_path / "in" / "b.txt").write_text("Ein Rad.\nEine Tür.\n")
    go()
    (tmp_path / "in" / "c.txt").write_text("Eine Uhr.\nEin Hund.\n")
    with pytest.raises(Exception, match="gone"):
        go()
    (tmp_path / "well").touch()
    go()  # the batch that failed runs again
    got = [r["text"] for r in spark.read.parquet(str(tmp_path / "answers")).collect()]
    assert sorted(got) == ["Ein Hund.", "Ein Rad.", "Eine Tür.", "Eine Uhr."]
    assert sorted((tmp_path / "asked").read_text().splitlines()) == [*sorted(got), "Eine Uhr."]


def test_every_query_runs(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_package_can_be_sent_to_executors(spark):
    import zipfile as z

    import wortsee

    sent = []
    wortsee.ship(type("S", (), {"sparkContext": type("C", (), {"addPyFile": staticmethod(sent.append)})}))
    names = z.ZipFile(sent[0]).namelist()
    assert "wortsee/__init__.py" in names and "wortsee/operators/extract.py" in names
