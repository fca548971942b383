"""JSON artifacts: schemas, strict reading, atomic writing, stage cache."""

from __future__ import annotations

import datetime
import json
import logging
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput, Missing

SCHEMA_VERSION = 1
WORDS = "array<struct<lemma:string,word_type:string,article:string>>"
#: Schemas of the artifacts' record lists; never inferred.
RECORDS = {
    "speech": ("segments", "array<struct<id:int,start:double,end:double,text:string>>"),
    "chapters": ("chapters", "array<struct<index:int,href:string,title:string,chars:bigint,html:string>>"),
    "sentences": ("sentences", "array<string>"),
    "sentence_words": ("sentences", f"array<struct<text:string,count:bigint,words:{WORDS}>>"),
    "known_words": ("words", "array<string>"),
    "words": ("words", "array<struct<lemma:string,word_type:string,article:string,count:bigint,sentences:array<string>>>"),
}
log = logging.getLogger(__name__)


def utc_stamp() -> str:
    """Now as 2026-08-21T14:03:57Z."""
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_document(path: str | Path, payload: dict) -> None:
    """Write one JSON document so that readers see the old or the new one, never a part."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".tmp")
    part.write_text(json.dumps(payload, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(part, path)


def read_document(path: str | Path, version: int = SCHEMA_VERSION) -> dict:
    """One JSON document, an object of the expected version; the message of an error says what to do."""
    path, again = Path(path), "run its stage again with --force"
    if not path.exists():
        raise Missing(f"artifact not found: {path}; run the stage that makes it first")
    data = path.read_bytes()
    try:
        payload = json.loads(data.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise BadInput(f"{path} is not UTF-8 text ({e}); {again}") from e
    except ValueError as e:
        raise BadInput(f"{path} is not valid JSON ({e if data else 'it is empty'}); {again}") from e
    if not isinstance(payload, dict):
        raise BadInput(f"{path}: expected a JSON object but found {type(payload).__name__}; {again}")
    if payload.get("schema_version") != version:
        raise BadInput(f"{path}: schema_version {payload.get('schema_version')!r} instead of {version}; {again}")
    return payload


def record_list(payload: dict, key: str, path: str | Path) -> list:
    value = payload.get(key)
    if isinstance(value, list):
        return value
    found = "it is missing" if value is None else f"found a {type(value).__name__}"
    raise BadInput(f"{path}: expected a {key!r} list, {found}; run the stage again with --force")


def _word(w) -> tuple:
    if not isinstance(w, dict) or not {"lemma", "word_type"} <= w.keys() or w.keys() - {"lemma", "word_type", "article"}:
        raise BadInput(f"malformed word record {w!r}")
    return (w["lemma"], w["word_type"], w.get("article"))


def sentence_list(payload: dict, path: str | Path = "sentences") -> list[str]:
    sentences = record_list(payload, "sentences", path)
    for s in sentences:
        if not isinstance(s, str):
            raise BadInput(f"{path}: malformed sentence record, {s!r} is not a string; run the stage again with --force")
    return sentences


def sentence_word_rows(payload: dict, path: str | Path = "sentence-words") -> list[tuple]:
    """(ord, text, count, words) of a sentence-words document."""
    rows = []
    for i, s in enumerate(record_list(payload, "sentences", path)):
        try:
            rows.append((i, s["text"], int(s["count"]), [_word(w) for w in s["words"]]))
        except (KeyError, TypeError, ValueError) as e:
            raise BadInput(f"{path}: malformed sentence record ({type(e).__name__}: {e}); run the stage again with --force") from e
    return rows


def _fields(kind: str, header: str) -> str:
    key, schema = RECORDS[kind]
    return f"schema_version int, {header + ', ' if header else ''}{key} {schema}"


def _listed(docs: DataFrame, name: str, kind: str, extra: list[str]) -> DataFrame:
    """(name, extra, pos, record) of parsed artifacts; a wrong version or a missing list fails the query."""
    key, schema = RECORDS[kind]
    wrong = F.raise_error(F.concat(F.col(name).cast("string"), F.lit(": schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing"))))
    missing = F.raise_error(F.concat(F.col(name).cast("string"), F.lit(f": expected a {key!r} list")))
    listed = F.when(F.coalesce(F.col("schema_version"), F.lit(-1)) != SCHEMA_VERSION, wrong.cast(schema)).when(F.col(key).isNull(), missing.cast(schema)).otherwise(F.col(key))
    return docs.select(name, *extra, F.posexplode(listed).alias("pos", "record"))


def scan(spark: SparkSession, paths: str | list[str], kind: str, header: str = "") -> DataFrame:
    """Records of any number of artifacts, with file and position, distributed; wrong versions fail the query.

    header: further scalar columns in DDL, such as 'llm_model string'.
    """
    extra = [part.split()[0] for part in header.split(",") if part.strip()]
    docs = spark.read.schema(_fields(kind, header)).option("multiLine", True).option("mode", "FAILFAST").json(paths).withColumn("file", F.input_file_name())
    return _listed(docs, "file", kind, extra)


def records(docs: DataFrame, name: str, body: str, kind: str, header: str = "") -> DataFrame:
    """scan() of artifacts that are given as text in a column, name tells them apart."""
    extra = [part.split()[0] for part in header.split(",") if part.strip()]
    parsed = docs.select(name, F.from_json(body, _fields(kind, header), {"mode": "FAILFAST"}).alias("_d")).select(name, "_d.*")
    return _listed(parsed, name, kind, extra)


def cached(output: str | Path, force: bool) -> bool:
    """Whether a stage's output is there and may be used: a file, or a folder that was written to its end."""
    output = Path(output)
    if force or not (output.is_file() or (output / "_SUCCESS").exists()):
        return False
    log.info("using cached %s (--force makes it anew)", output)
    return True
