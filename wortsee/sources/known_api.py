"""Known words from a REST interface; the transport is injected, so tests need no network."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import Failed
from ..operators.known import entries, from_response

URL_VARIABLE, TOKEN_VARIABLE = "KNOWN_WORDS_API_URL", "KNOWN_WORDS_API_TOKEN"
TIMEOUT_S = 30.0
SNIPPET = 200

#: (url, headers, timeout) -> (status, content type, body); raises OSError if nothing answers.
Transport = Callable[[str, dict, float], tuple[int, str, str]]


class KnownWordsError(Failed):
    """The interface can't be reached, or its answer is no word list; the message is for the user."""


def snippet(text: str | None) -> str:
    """One line of an answer's body, cut at SNIPPET characters."""
    line = " ".join((text or "").split())
    return "<empty body>" if not line else line if len(line) <= SNIPPET else line[:SNIPPET] + " ..."


def hint(status: int) -> str:
    if status in (401, 403):
        return f" Check {TOKEN_VARIABLE}: the token may be missing, wrong or expired."
    if status == 404:
        return f" Check {URL_VARIABLE}: it must be the whole path of the interface."
    return " The server itself failed; try again later." if status >= 500 else ""


def http_get(url: str, headers: dict, timeout: float) -> tuple[int, str, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.headers.get("content-type", ""), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("content-type", ""), e.read().decode("utf-8", "replace")


def fetch(url: str, token: str | None = None, timeout: float = TIMEOUT_S, transport: Transport = http_get) -> list[str]:
    """Words as the interface answers them."""
    try:
        status, kind, body = transport(url, {"Authorization": f"Bearer {token}"} if token else {}, timeout)
    except OSError as e:
        raise KnownWordsError(f"cannot reach the known-words API at {url} ({type(e).__name__}: {e}). Check {URL_VARIABLE} and the network.") from e
    if not 200 <= status < 300:
        raise KnownWordsError(f"the known-words API at {url} returned HTTP {status}.{hint(status)} Response: {snippet(body)}")
    try:
        data = json.loads(body)
    except ValueError as e:
        said = f" but {kind.partition(';')[0]}" if kind else ""
        raise KnownWordsError(f"the known-words API at {url} did not return JSON{said}; {URL_VARIABLE} may name a web page. Response: {snippet(body)}") from e
    try:
        return from_response(data)
    except ValueError as e:
        raise KnownWordsError(f"{url}: {e}") from e


def known_entries(spark: SparkSession, words: list[str]) -> DataFrame:
    return entries(spark.createDataFrame([(w,) for w in words], "word string"), "word")
