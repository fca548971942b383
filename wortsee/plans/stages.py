"""The stages of one work directory: each reads an artifact and writes the next, on the operators of this engine."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chapters as ch
from ..operators import sentences as se
from ..operators import wordlist
from ..operators.extract import Extractor, Pace, ask_documents, ask_words
from ..operators.known import keys
from ..operators.validation import AnswerError
from ..sources import artifacts as art
from ..errors import BadInput, Missing
from ..sources import epub, jsonl
from ..sources.audio import Recogniser
from ..sources.known_api import known_entries

log = logging.getLogger(__name__)
WORDS = art.WORDS


def partial(output: Path) -> Path:
    """Checkpoint beside an output."""
    return output.with_name(output.name + ".partial.jsonl")


def kept_beside(output: Path, pace: Pace) -> Pace:
    """The pace with the output's checkpoint as its journal, on a line of its own after a torn one."""
    path = partial(output)
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.exists() and (said := path.read_bytes()) and not said.endswith(b"\n"):
        whole = said[: said.rfind(b"\n") + 1]
        path.write_bytes(said + b"\n" if jsonl.is_record(said[len(whole) :]) else whole)
    return replace(pace, journal=str(path.resolve()))


@contextmanager
def resumable(output: Path):
    """Failures are told with where the answers so far are kept."""
    try:
        yield
    except Exception as e:
        raise AnswerError(f"{e} Finished answers are kept in {partial(output)}; run the stage again to go on.") from e


def book(source: Path, output: Path, selection: str | None = None, force: bool = False) -> dict:
    if art.cached(output, force):
        return art.read_document(output)
    if not Path(source).exists():
        raise Missing(f"EPUB file not found: {source}")
    said, found = epub.read_book(Path(source).read_bytes(), str(source), ch.parse_selection(selection) if selection else None)
    if not found:
        raise BadInput(f"no readable chapters in {source}; --list-chapters shows them, and --chapters may have left none")
    payload = {
        "schema_version": art.SCHEMA_VERSION, "source_type": "epub", "source_file": str(source), "title": said["title"], "author": said["creator"], "language": said["language"],
        "total_chapters": len(found), "char_count": sum(f[3] for f in found),
        "chapters": [{"index": i, "href": h, "title": t, "chars": n, "html": m} for i, h, t, n, m in found],
    }
    art.write_document(output, payload)
    return payload


def speech(audio: Path, output: Path, recogniser: Recogniser, model: str, force: bool = False) -> dict:
    """Recognised speech of an audio file, with what the recogniser says of it and of itself."""
    if art.cached(output, force):
        return art.read_document(output)
    if not Path(audio).exists():
        raise Missing(f"audio file not found: {audio}")
    heard = recogniser(str(audio))
    segments = [{"id": i, "start": a, "end": b, "text": t} for i, a, b, t in heard.cleaned()]
    duration = heard.duration if heard.duration is not None else segments[-1]["end"] if segments else 0.0
    about = {"model": model, "backend": heard.backend, "device": heard.device, "compute_type": heard.compute_type, "language": heard.language, "duration": round(duration, 2)}
    payload = {"schema_version": art.SCHEMA_VERSION, "source_type": "audio", "audio_file": str(audio), **about, "text": " ".join(s["text"] for s in segments), "segments": segments}
    art.write_document(output, payload)
    return payload


def sentences(spark: SparkSession, source: Path, output: Path, extractor: Extractor | None = None, model: str | None = None, segmenter: Callable | None = None, force: bool = False, pace: Pace = Pace()) -> dict:
    """Sentence list of recognised speech, or of the content chapters of a book by an extractor's verdicts."""
    if art.cached(output, force):
        return art.read_document(output)
    payload = art.read_document(source)
    if "segments" not in payload and isinstance(payload.get("chapters"), list):
        return _chapter_sentences(spark, payload, source, output, extractor, model, pace)
    try:
        rows = [(0, i, s["text"]) for i, s in enumerate(art.record_list(payload, "segments", source))]
    except (KeyError, TypeError) as e:
        raise BadInput(f"{source}: a segment without 'text' ({type(e).__name__}: {e}); run the text stage again with --force") from e
    doc = se.join_segments(spark.createDataFrame(rows, "doc int, pos int, text string"), ["doc"], "pos", "text").where("text <> ''")
    found = [r["text"] for r in se.split_documents(doc, ["doc"], "text", segmenter).orderBy("pos").collect()]
    if not found:
        raise BadInput(f"{source} contains no text ({len(rows)} segment(s), all empty)")
    result = {"schema_version": art.SCHEMA_VERSION, "segmenter": "rules" if segmenter is None else getattr(segmenter, "__name__", "custom"), "source": str(source), "total_sentences": len(found), "sentences": found}
    art.write_document(output, result)
    return result


def _chapter_sentences(spark, payload: dict, source: Path, output: Path, extractor: Extractor | None, model: str | None, pace: Pace) -> dict:
    chapters = art.record_list(payload, "chapters", source)
    for c in chapters:
        if not isinstance(c, dict) or not isinstance(c.get("html"), str):
            raise BadInput(f"{source}: a chapter record without 'html' ({c!r:.120}); run the epub stage again with --force")
    if not chapters:
        raise BadInput(f"{source} contains no chapters; run the epub stage again with --force")
    order = [(int(c["index"]), str(c["href"])) for c in chapters]
    done = {k: v for k, v in jsonl.chapter_answers(partial(output)).items() if k in set(order)}
    todo = {k: c for k, c in zip(order, chapters) if k not in done}
    if todo:
        if extractor is None:
            raise AnswerError("the chapters of a book need a model to judge them; none is configured")
        rows = spark.createDataFrame([(i, h, str(c.get("title", "")), c["html"]) for (i, h), c in todo.items()], "i int, href string, title string, html string")
        documents = rows.select("i", "href", "title", ch.split_markup(F.col("html")).alias("parts"))
        with resumable(output):
            for r in ask_documents(documents, "href", "i", "parts", extractor, kept_beside(output, pace), "title").toLocalIterator():
                if r["error"]:
                    raise AnswerError(r["error"])
                done[(r["index"], r["href"])] = (r["kind"], r["is_content"], list(r["sentences"]))
    found = [s for k in order if done[k][1] for s in done[k][2]]
    if not found:
        kinds = ", ".join(f"{h} ({done[(i, h)][0]})" for i, h in order)
        raise BadInput(f"no chapter of {source} was judged to be content: {kinds}. If that is wrong, narrow the input with --chapters and use --force")
    result = {
        "schema_version": art.SCHEMA_VERSION, "segmenter": "llm", "llm_model": model, "source": str(source), "total_sentences": len(found),
        "chapters": [{"index": k[0], "href": k[1], "title": str(c.get("title", "")), "kind": done[k][0], "is_content": done[k][1], "sentences": len(done[k][2])} for k, c in zip(order, chapters)],
        "sentences": found,
    }
    art.write_document(output, result)
    partial(output).unlink(missing_ok=True)
    return result


def words(spark: SparkSession, source: Path, output: Path, extractor: Extractor, model: str | None, force: bool = False, pace: Pace = Pace()) -> dict:
    """Words of every distinct sentence; finished answers are kept beside the output until the stage ends."""
    if art.cached(output, force):
        return art.read_document(output)
    listed = art.sentence_list(art.read_document(source), source)
    if not listed:
        raise BadInput(f"{source} contains no sentences; run the sentences stage again with --force")
    rows = spark.createDataFrame(list(enumerate(listed)), "pos bigint, text string")
    distinct = se.distinct_sentences(rows, [], "pos", "text")
    done = {t: w for t, w in jsonl.word_answers(partial(output)).items() if t in set(listed)}
    answers = spark.createDataFrame(list(done.items()), f"text string, words {WORDS}")
    with resumable(output):
        for r in ask_words(distinct, "text", extractor, answers, kept_beside(output, pace)).toLocalIterator():
            if r["error"]:
                raise AnswerError(r["error"])
            done[r["text"]] = [tuple(w) for w in r["words"]]
    names = ("lemma", "word_type", "article")
    found = [{"text": r["text"], "count": r["count"], "words": [dict(zip(names, w)) for w in done[r["text"]]]} for r in distinct.orderBy("ord").collect()]
    result = {"schema_version": art.SCHEMA_VERSION, "llm_model": model, "source": str(source), "total_sentences": len(found), "sentences": found}
    art.write_document(output, result)
    partial(output).unlink(missing_ok=True)
    return result


def build(spark: SparkSession, source: Path, output: Path, known: list[str] | None = None, known_source: str | None = None, known_output: Path | None = None, min_count: int = 1) -> dict:
    """The word list; never cached. known: entries of the learner's cards."""
    payload = art.read_document(source)
    rows = spark.createDataFrame(art.sentence_word_rows(payload, source), f"ord bigint, text string, count bigint, words {WORDS}")
    known_keys = None
    if known is not None:
        entries = known_entries(spark, known)
        known_keys = keys(entries)
        listed = sorted(r[0] for r in entries.collect())
        key_list = sorted({r[0] for r in known_keys.select("key").distinct().collect()})
        art.write_document(known_output or output.parent / "known-words.json", {"schema_version": art.SCHEMA_VERSION, "fetched_at": art.utc_stamp(), "source": known_source, "total_words": len(listed), "words": listed, "total_match_keys": len(key_list), "match_keys": key_list})
    made = wordlist.build(wordlist.explode_words(rows, []), [], known_keys, min_count).orderBy(*wordlist.order([]))
    entries_out = [{"lemma": r["lemma"], "word_type": r["word_type"], "article": r["article"], "count": r["count"], "sentences": list(r["sentences"])} for r in made.collect()]
    result = {"schema_version": art.SCHEMA_VERSION, "generated_at": art.utc_stamp(), "known_words_source": known_source, "llm_model": payload.get("llm_model"), "min_count": min_count, "total_words": len(entries_out), "words": entries_out}
    art.write_document(output, result)
    return result


def build_tables(spark: SparkSession, paths: str | list[str], folder: str, known: list[str] | None = None, min_count: int = 1) -> None:
    """The word lists of any number of sentence-words artifacts, one for each file, as tables in a folder.

    words has the entries with the number of their sentences, examples the
    sentences as rows; neither passes through the driver, and no entry's
    examples stand in one value.
    """
    said = art.scan(spark, paths, "sentence_words").select("file", F.col("pos").alias("ord"), "record.text", "record.count", "record.words")
    found = wordlist.explode_words(said, ["file"])
    known_keys = None if known is None else keys(known_entries(spark, known))
    entries = wordlist.build(found, ["file"], known_keys, min_count, examples="count")
    entries.write.mode("overwrite").parquet(f"{folder}/words")
    listed = spark.read.schema(entries.schema).parquet(f"{folder}/words").select("file", "lemma_key", "word_type")
    wordlist.example_rows(found, ["file"], known_keys).join(listed, ["file", "lemma_key", "word_type"], "left_semi").write.mode("overwrite").parquet(f"{folder}/examples")
