"""Checkpoint files: JSON lines with a torn end, typed readers."""

from __future__ import annotations

import json
from pathlib import Path

from ..errors import BadInput
from ..operators.validation import chapter_answer, word_answer


def read_lines(path: str | Path) -> list[dict]:
    """Records of a checkpoint; blank lines are skipped, a bad last line is ignored, any other bad line is an error."""
    path = Path(path)
    lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
    records = []
    for number, line in enumerate(lines, 1):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
            if not isinstance(record, dict):
                raise BadInput(f"found a {type(record).__name__} instead of an object")
        except ValueError as e:
            if number < len(lines):
                raise BadInput(f"{path}:{number} is no checkpoint record ({e}); delete the file to begin the stage anew") from e
            break
        records.append(record)
    return records


def is_record(line: bytes) -> bool:
    """Whether a line is a whole JSON object."""
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _typed(path, make) -> dict:
    done, records = {}, read_lines(path)
    for number, record in enumerate(records, 1):
        try:
            key, value = make(record)
            done[key] = value
        except (KeyError, TypeError, ValueError) as e:
            if number < len(records):
                raise BadInput(f"{path}: no checkpoint record ({type(e).__name__}: {e}); delete the file to begin the stage anew") from e
    return done


def word_answers(path: str | Path) -> dict[str, list[tuple[str, str, str | None]]]:
    """Sentence -> words; a later record replaces an earlier one."""
    return _typed(path, lambda r: (r["text"], word_answer(r)))


def chapter_answers(path: str | Path) -> dict[tuple[int, str], tuple[str, bool, list[str]]]:
    """(index, href) -> kind, is_content and sentences."""
    return _typed(path, lambda r: ((int(r["index"]), str(r["href"])), chapter_answer(r)))
