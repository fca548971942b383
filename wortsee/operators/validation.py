"""Validation of answers to requests: words of a sentence, verdict on a document."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Failed

ARTICLES = ("der", "die", "das")


class AnswerError(Failed):
    """A request failed, or its answer can't be used; the message is for the user."""


def word_answer(data, what: str = "answer") -> list[tuple[str, str, str | None]]:
    """(lemma, word_type, article) of an answer; of repeats of case-folded lemma and type the first stays."""
    words = data.get("words") if isinstance(data, dict) else None
    if not isinstance(words, list):
        raise ValueError(f'{what}: an object with a "words" array is expected, not {data!r}')
    kept: dict[tuple[str, str], tuple[str, str, str | None]] = {}
    for w in words:
        if not isinstance(w, dict):
            raise ValueError(f"{what}: word entry is not an object: {w!r}")
        lemma, kind, article = (w.get(k) for k in ("lemma", "word_type", "article"))
        if not isinstance(lemma, str) or not lemma.strip():
            raise ValueError(f"{what}: word entry without a lemma: {w!r}")
        if not isinstance(kind, str) or not kind:
            raise ValueError(f"{what}: word entry without a word_type: {w!r}")
        if article is not None and article not in ARTICLES:
            raise ValueError(f"{what}: unexpected article {article!r} in {w!r}")
        lemma = " ".join(lemma.split())
        kept.setdefault((lemma.casefold(), kind), (lemma, kind, article))
    return list(kept.values())


def chapter_answer(data, what: str = "answer") -> tuple[str, bool, list[str]]:
    if not isinstance(data, dict):
        raise ValueError(f"{what}: an object is expected, not {data!r}")
    kind, content, sentences = (data.get(k) for k in ("kind", "is_content", "sentences"))
    if not isinstance(kind, str) or not kind:
        raise ValueError(f"{what}: no kind in {data!r}")
    if not isinstance(content, bool):
        raise ValueError(f"{what}: no is_content flag in {data!r}")
    if not isinstance(sentences, list) or any(not isinstance(s, str) for s in sentences):
        raise ValueError(f'{what}: no "sentences" array of strings')
    return kind, content, [t for t in (" ".join(s.split()) for s in sentences) if t]


def completion(response: dict, what: str):
    """JSON of a chat completion, given as a dict; checks shape, length, refusal, emptiness, syntax in this order."""
    try:
        choice = response["choices"][0]
        message = choice["message"]
    except (KeyError, IndexError, TypeError) as e:
        raise AnswerError(f"unexpected response for {what}: {type(e).__name__}: {e}") from e
    if choice.get("finish_reason") == "length":
        raise AnswerError(f"the answer for {what} was cut off at the token limit and would be incomplete")
    if message.get("refusal"):
        raise AnswerError(f"the model refused {what}: {message['refusal']}")
    if not message.get("content"):
        raise AnswerError(f"the model returned no content for {what}")
    try:
        return json.loads(message["content"])
    except ValueError as e:
        raise AnswerError(f"no valid JSON for {what}: {e}. Response: {message['content'][:200]}") from e


def _checked(body: Column, check: Callable[[object], dict], fields: str) -> Column:
    """struct<fields, error> of answers as text: what the check makes of them, or its message. A null answer gives null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    given = StructType.fromDDL(fields + ", error string")
    kind = pa.struct(list(to_arrow_schema(given)))

    def one(text: str | None) -> dict | None:
        if text is None:
            return None
        try:
            return check(json.loads(text))
        except (ValueError, AnswerError) as e:
            return {"error": str(e)}

    @F.arrow_udf(given)
    def run(arr: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in arr.to_pylist()], kind)

    return run(body)


def word_answers(body: Column) -> Column:
    """word_answer() of a column of JSON answers: struct<words, error>."""
    names = ("lemma", "word_type", "article")
    return _checked(body, lambda data: {"words": [dict(zip(names, w)) for w in word_answer(data)]}, "words array<struct<lemma:string,word_type:string,article:string>>")


def chapter_answers(body: Column) -> Column:
    """chapter_answer() of a column of JSON answers: struct<kind, is_content, sentences, error>."""
    return _checked(body, lambda data: dict(zip(("kind", "is_content", "sentences"), chapter_answer(data))), "kind string, is_content boolean, sentences array<string>")


def completions(body: Column) -> Column:
    """completion() of a column of responses: struct<answer, error>, the answer as JSON text."""
    return _checked(body, lambda data: {"answer": json.dumps(completion(data, "it"), ensure_ascii=False)}, "answer string")
