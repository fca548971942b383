"""Decoding and reading of XHTML documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

# Tags at which a paragraph ends, tags without prose, headings.
BLOCKS = frozenset("article aside blockquote body br caption dd div dl dt figcaption footer h1 h2 h3 h4 h5 h6 header hr li nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("head script style svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OPENS, CLOSES, SAYS = "opens", "closes", "says"

#: The encoding that an XML declaration names within the first bytes of a document.
_DECLARED = re.compile(rb"\A\s*<\?xml\b[^>]*?\bencoding\s*=\s*(?:\"([\w.:-]+)\"|'([\w.:-]+)')", re.I)
_DECLARED_WITHIN = 200


def readable_as(data: bytes, charset: str) -> bool:
    try:
        data.decode(charset)
    except (LookupError, ValueError):
        return False
    return True


def decode(data: bytes) -> str:
    """Text of a document: by its XML declaration, else UTF-8, else cp1252, else UTF-8 with replacements."""
    body = data.lstrip()
    declared = _DECLARED.match(body[:_DECLARED_WITHIN])
    named = next((n.decode("ascii", "ignore") for n in declared.groups() if n), "utf-8") if declared else "utf-8"
    charset = next((c for c in (named, "utf-8", "cp1252") if readable_as(data, c)), None)
    return data.decode(charset) if charset else data.decode("utf-8", "replace")


class _Events(HTMLParser):
    """Markup as a list of (what happens, tag or text)."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.said: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.said.append((OPENS, tag))
        self.handle_endtag = lambda tag: self.said.append((CLOSES, tag))
        self.handle_data = lambda text: self.said.append((SAYS, text))
        self.feed(markup)
        self.close()


def stretches(events: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(tag that opened it or "", text) of what stands between block tags; what hidden elements say is left out.

    Of nested hidden elements only the innermost can be closed, so one that is
    never closed hides the rest.
    """
    opened, parts, hidden = "", [], []
    for what, said in events:
        if what == SAYS:
            parts += [] if hidden else [said]
        elif said in HIDDEN:
            if what == OPENS:
                hidden.append(said)
            elif hidden and hidden[-1] == said:
                hidden.pop()
        elif said in BLOCKS:
            yield opened, "".join(parts)
            opened, parts = (said if what == OPENS else ""), []
    yield opened, "".join(parts)


def parse_document(markup: str) -> tuple[str | None, list[str]]:
    """Title and paragraphs of a document; tolerates broken markup. The title is the first text that a heading's tag opens."""
    said = [(tag, text) for tag, raw in stretches(_Events(markup).said) if (text := " ".join(raw.split()))]
    return next((text for tag, text in said if tag in HEADINGS), None), [text for _, text in said]
