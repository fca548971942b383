"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Pre-tokenisation works on code-point class arrays, without regex. The start of
the run that each position belongs to is an associative scan: the transition
function of a position either sets the start (class changes) or keeps it, and
the composition of such functions is a running maximum. It tells runs of one
sign from longer ones; the rules that look back or forward by a bounded number
of places (a blank joins the run after it, contractions) are shifted masks on
top of it. The slices that result are offsets into the untouched UTF-8 buffer,
so they are dictionary encoded without copying, and only distinct slices meet
the cached pair merging. token_ids_offsets() keeps the byte offset of each
token, from which any part of a text can be decoded by itself.

The vocabulary file is read on the driver and broadcast (under 1 MB).

Defined results: null and empty texts give an empty list; blank texts are
encoded as they are; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, code_points, table, text_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are scanned at once in a Python worker.
CHUNK_BYTES = 2 << 20
#: Distinct slices that a worker keeps merged; beyond it the cache starts anew.
CACHE_SLICES = 1_000_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Fixed value: code points with Unicode's White_Space property, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

_classes: np.ndarray | None = None
_coders: dict[str, "Coder"] = {}
_shipped: dict[tuple[str, str], Broadcast] = {}


def classes() -> np.ndarray:
    """Class of each code point by its general category, made once a worker."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        made = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        for a, b in WHITE_SPACE:
            made[a : b + 1] = SPACE
        _classes = made
    return _classes


def run_starts(change: np.ndarray) -> np.ndarray:
    """For each position the start of its run: the scan of set-or-keep transition functions."""
    at = np.arange(len(change), dtype=np.int32)
    at *= change
    return np.maximum.accumulate(at, out=at)


def slice_starts(cp: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a slice starts. row_start: mask of the first code point of each text."""
    n = len(cp)
    cls = classes()[cp]
    change = row_start.copy()
    change[1:] |= cls[1:] != cls[:-1]
    start = change.copy()
    last = np.empty(n, bool)  # last code point of its run
    last[:-1], last[-1] = change[1:], True
    row_end = np.empty(n, bool)
    row_end[:-1], row_end[-1] = row_start[1:], True
    # The last white space of a run before other text stands alone, or joins that text if it is a blank.
    tail = last & (cls == SPACE) & ~row_end
    start |= tail
    joined = np.zeros(n, bool)
    joined[1:] = (tail & (cp == 32))[:-1]
    start &= ~joined
    # Contractions: an apostrophe alone between texts, not after a blank, takes the letters of its ending along.
    begin = run_starts(change)
    quote = np.flatnonzero(cp == 39)
    quote = quote[(begin[quote] == quote) & last[quote] & ~joined[quote] & ~row_end[quote]]
    if len(quote):
        first = cp[quote + 1]
        # Not cut by the end of the text, for the next code point belongs to the same one (~row_end).
        one = np.isin(first, (115, 116, 109, 100))  # s t m d
        two_at = np.minimum(quote + 2, n - 1)
        second = np.where((quote + 2 < n) & ~row_start[two_at], cp[two_at], 0)
        two = ((first == 114) & (second == 101)) | ((first == 118) & (second == 101)) | ((first == 108) & (second == 108))  # re ve ll
        for which, length in ((one, 1), (two & ~one, 2)):
            at = quote[which]
            start[at + 1] = False
            after = at + 1 + length
            after = after[after < n]
            start[after] |= ~joined[after]
    return start


class Coder:
    """Pair merging over the ranks of a vocabulary file, with a cache of merged slices."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.cache: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merging with a heap and linked places: n log n for slices without end."""
        import heapq

        ranks, n = self.ranks, len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or part[i] != a or j >= n or part[j] != b:
                continue
            part[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [ranks[part[i]] for i in range(n) if alive[i]]

    def ids(self, slices: list[bytes]) -> list[list[int]]:
        cache = self.cache
        if len(cache) > CACHE_SLICES:
            cache.clear()
        out = []
        for s in slices:
            if (got := cache.get(s)) is None:
                got = cache[s] = self.merge(s)
            out.append(got)
        return out


def coder(path: str, shipped: Broadcast | None = None) -> Coder:
    """The coder of a vocabulary, made once a worker, from what was shipped if anything was."""
    if path not in _coders:
        _coders[path] = Coder(Path(path).read_bytes() if shipped is None else shipped.value)
    return _coders[path]


def shipped_vocabulary(path: str) -> Broadcast:
    """A vocabulary file as a broadcast, once for each session's context."""
    context = SparkSession.active().sparkContext
    key = (context.applicationId, path)
    if key not in _shipped:
        _shipped[key] = context.broadcast(Path(path).read_bytes())
    return _shipped[key]


def slices_of(data: np.ndarray, off: np.ndarray):
    """Byte offsets at which slices start, with the end of the data last."""
    cp, at = code_points(data)
    row_start = np.zeros(len(data) + 1, bool)
    row_start[off[:-1]] = True
    return np.append(at[slice_starts(cp, row_start[at])], len(data))


def encode(arr, path: str, count_only: bool = False, shipped: Broadcast | None = None):
    """Token ids (or their number) of each text of an Arrow string array."""
    off, data = text_buffers(arr)
    code = coder(path, shipped)
    ids_out, n_out = [], []
    for i, j in chunks(off, CHUNK_BYTES):
        part, rows = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if not len(part):
            n_out.append(np.zeros(j - i, np.int64))
            continue
        bounds = slices_of(part, rows)
        slices = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(part)])
        coded = slices.dictionary_encode()
        merged = code.ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        which = coded.indices.to_numpy(zero_copy_only=False)
        n_each = sizes[which]
        total = np.concatenate(([0], np.cumsum(n_each)))
        first = np.searchsorted(bounds, rows, "left")
        n_out.append(np.diff(total[first]))
        if not count_only:
            flat = np.fromiter((x for m in merged for x in m), np.int32, int(sizes.sum()))
            base = (np.cumsum(sizes) - sizes)[which]
            ids_out.append(flat[np.repeat(base - total[:-1], n_each) + np.arange(total[-1])])
    n = np.concatenate(n_out) if n_out else np.zeros(0, np.int64)
    if count_only:
        return pa.array(n.astype(np.int32))
    flat = np.concatenate(ids_out) if ids_out else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Column of token ids of a text column; null and empty texts give an empty list."""
    shipped = shipped_vocabulary(vocabulary)

    @F.arrow_udf("array<int>")
    def encode_ids(arr: pa.Array) -> pa.Array:
        return encode(arr, vocabulary, shipped=shipped)

    return encode_ids(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Column of the number of tokens of a text column; 0 for null and empty texts."""
    shipped = shipped_vocabulary(vocabulary)

    @F.arrow_udf("int")
    def count_ids(arr: pa.Array) -> pa.Array:
        return encode(arr, vocabulary, True, shipped)

    return count_ids(text)


def encode_with_offsets(arr, path: str, shipped: Broadcast | None = None):
    """Token ids of each text, and the byte of its UTF-8 form at which each token begins."""
    ids = encode(arr, path, shipped=shipped)
    code = coder(path, shipped)
    if getattr(code, "sizes", None) is None:
        code.sizes = np.zeros(max(code.ranks.values()) + 1, np.int64)
        for b, i in code.ranks.items():
            code.sizes[i] = len(b)
    flat, rows = ids.values.to_numpy(), ids.offsets.to_numpy()
    ends = np.concatenate(([0], np.cumsum(code.sizes[flat])))
    starts = ends[:-1] - np.repeat(ends[rows[:-1]], np.diff(rows))
    return pa.StructArray.from_arrays([ids, pa.ListArray.from_arrays(ids.offsets, pa.array(starts.astype(np.int32)))], ["ids", "offsets"])


def token_ids_offsets(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Column of (ids, offsets) of a text column: as token_ids(), with the byte offset of each token in the text."""
    shipped = shipped_vocabulary(vocabulary)

    @F.arrow_udf("struct<ids:array<int>,offsets:array<int>>")
    def encode_offsets(arr: pa.Array) -> pa.Array:
        return encode_with_offsets(arr, vocabulary, shipped)

    return encode_offsets(text)


def decode_ids(ids, path: str = VOCABULARY) -> str:
    """Text of a list of token ids."""
    back = getattr(coder(path), "back", None)
    if back is None:
        back = coder(path).back = {i: b for b, i in coder(path).ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))
