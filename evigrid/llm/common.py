"""What the operators of this subpackage share: a shared working folder, and text batches as byte arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evigrid.operators.sizing import clear_staged, input_bytes, shared_dir, staged, staged_paths

__all__ = ["clear_staged", "input_bytes", "shared_dir", "staged", "staged_paths"]

#: Bytes of an Arrow batch between Spark and a Python worker; a text operator needs a small multiple of it.
BATCH_BYTES = "2m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's Arrow batches are kept to BATCH_BYTES, unless the user has set their size. The size is read when
    a plan runs, which may be after the operator has returned, so the setting stays."""
    conf = df.sparkSession.conf
    if str(conf.get(_BATCH_KEY)).rstrip("b") == str(64 << 20):  # Spark's own value
        conf.set(_BATCH_KEY, BATCH_BYTES)
    return df


def buckets(df: DataFrame, each: int, least: int = 8) -> int:
    """Buckets of about `each` input bytes, so that a bucket stays as small when the input grows (2^20 of them at most,
    so that at 100 TB a bucket holds about 100 MB of input at least)."""
    return int(min(1 << 20, max(least, -(-input_bytes(df) // each))))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most most_rows rows and about most_bytes bytes of `column` (a longer text stands alone)."""
    try:
        for batch in batches:
            ends = text_offsets(batch.column(column))
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1
                stop = min(max(stop, at + 1), at + most_rows, batch.num_rows)
                yield batch.slice(at, stop - at)
                at = stop
    finally:
        trim()


def trim() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and a stage's peaks would stay with them."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


#: Texts over this many bytes are worked on in parts.
LONG = 4 << 20
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def parts(raw: np.ndarray, blanks: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of about LONG bytes of one text: cut at ASCII white space, so that no word is cut (a word
    that is longer than a part makes it as long), or else at any character."""
    at = 0
    while at < len(raw):
        stop = at + LONG
        while stop < len(raw):
            near = raw[stop : stop + 65536]
            found = np.flatnonzero(BLANK[near] if blanks else (near & 0xC0) != 0x80)
            if len(found):
                stop += int(found[0])
                break
            stop += len(near)
        yield at, min(stop, len(raw))
        at = stop


def text_offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null text is empty."""
    ends = text_offsets(col)
    if col.null_count:
        col = col.fill_null("")
        ends = text_offsets(col)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


class WordIds(dict[bytes, int]):
    """word -> number, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_codes(raw: np.ndarray, ends: np.ndarray, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, text of each word) of texts cut at ASCII white space; a long text is cut part by part."""
    codes, size = [np.zeros(0, np.int64)], np.zeros(len(ends) - 1, np.int64)
    number = ids.__getitem__
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for c, d in parts(raw[a:b], True) if b - a > LONG else [(0, b - a)]:
            words = raw[a + c : a + d].tobytes().split()
            codes.append(np.fromiter(map(number, words), np.int64, len(words)))
            size[k] += len(words)
    return np.concatenate(codes), np.repeat(np.arange(len(size)), size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words64(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLE = mix(words64(17, 256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        n2 = max(n, 1 << 18)
        up, down = np.full(n2, _BASE, np.uint64), np.full(n2, _BACK, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums of table[byte] * base^i up to each position: any substring's hash is a difference times base^-start."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end); equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def dealt(records: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The records of each bucket as one binary value."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    each, begin = np.unique(bucket, return_index=True)
    stop = np.append(begin[1:], len(bucket))[: len(begin)]
    return each.tolist(), [records[a:b].tobytes() for a, b in zip(begin, stop, strict=True)]


def gathered(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in column if x.is_valid)])
