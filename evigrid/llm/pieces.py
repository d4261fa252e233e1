"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are normalised and cut into units (spaces and what follows them); a batch's distinct new units are
concatenated and indexed by a suffix array, and every piece of the vocabulary is binary-searched in it for the range of
its occurrences. These are the edges (position, length, piece), brought into the order of their positions. Relaxing
takes the edges that the model's own rule takes: a BPE model joins two neighbours by the best-scored edge over both,
the leftmost of equals, until no edge is left (for this kind of model a shortest path over piece scores would not give
the tokenizer's result). Characters without a piece become byte pieces. Units are kept by each worker, so each is
matched once.

No piece holds a space after another character, so units are independent; a vocabulary that has such pieces is refused.

Defined results: null and empty texts have no ids; repeated rows are encoded each; ids out of the vocabulary, and null
ids, decode to nothing; bytes that are no UTF-8 decode to U+FFFD; U+2581 in a text decodes as a space, as in the
library; extra columns are dropped.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Units kept by each worker; longer ones than LONG are joined with a heap, one by one, and not kept.
CACHE_UNITS, LONG = 800_000, 400
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` symbols, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < depth:
        later = np.concatenate([rank[width:], np.zeros(min(width, len(rank)), np.int64)])[: len(rank)]
        rank = np.unique(rank << 32 | later, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return np.argsort(rank, kind="stable")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.score = np.array([model.get_score(i) for i in range(size)])
        own = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in own)):
            raise ValueError("the vocabulary has pieces that span words")
        self.ids = np.array(own, np.int64)
        self.size = np.array([len(self.pieces[i]) for i in own])
        self.longest = int(self.size.max())
        self.symbols = np.zeros((len(own), self.longest), np.int64)
        for k, i in enumerate(own):
            self.symbols[k, : self.size[k]] = [ord(c) + 1 for c in self.pieces[i]]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        plain = []
        for i in range(size):
            if model.is_byte(i):
                plain.append(bytes([int(self.pieces[i][3:5], 16)]))
            elif model.is_control(i):
                plain.append(b"")
            elif model.is_unknown(i):
                plain.append(" ⁇ ".encode())
            else:
                plain.append(self.pieces[i].replace(SPACE, " ").encode())
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_ends = np.concatenate([[0], np.cumsum([len(p) for p in plain])])
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def edges(self, text: np.ndarray) -> np.ndarray:
        """[position, length - 1] -> piece id of the occurrence there, or -1. text: code points + 1, 0 between units."""
        order = suffix_array(text, self.longest)
        padded = np.concatenate([text, np.zeros(self.longest, np.int64)])

        def search(right: bool) -> np.ndarray:
            low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(order), np.int64)
            while (low < high).any():
                mid = (low + high) // 2
                at = order[np.minimum(mid, len(order) - 1)]
                # compare the suffix's first symbols with the piece: -1, 0, 1
                state = np.zeros(len(self.ids), np.int64)
                for t in range(self.longest):
                    live = (state == 0) & (t < self.size)
                    if not live.any():
                        break
                    state[live] = np.sign(padded[at[live] + t] - self.symbols[live, t])
                below = (state < 0) | ((state == 0) if right else False)
                go = low < high
                low = np.where(go & below, mid + 1, low)
                high = np.where(go & ~below, mid, high)
            return low

        first, last = search(False), search(True)
        count = last - first
        piece = np.repeat(np.arange(len(self.ids)), count)
        where = order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        out = np.full((len(text) + 1, self.longest), -1, np.int32)
        by_place = np.argsort(where, kind="stable")
        out[where[by_place], self.size[piece[by_place]] - 1] = self.ids[piece[by_place]]
        return out

    def relax(self, text: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the pieces that remain, in order: in each round every unit takes its best edge."""
        start = np.flatnonzero(text)
        size = np.ones(len(start), np.int64)
        unit = np.cumsum(text == 0)[start]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(start):
            both = size[:-1] + size[1:]
            near = (unit[:-1] == unit[1:]) & (both <= self.longest)
            piece = np.full(len(start), -1, np.int64)
            piece[:-1][near] = edge[start[:-1][near], both[near] - 1]
            value = np.where(piece >= 0, self.score[piece], -np.inf)
            head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.maximum.reduceat(value, head)
            length = np.diff(np.append(head, len(start)))
            some = np.repeat(best > -np.inf, length)
            done.append((start[~some], size[~some]))
            hit = some & (value == np.repeat(best, length))
            if not hit.any():
                break
            at = np.flatnonzero(hit)
            at = at[np.r_[True, unit[at[1:]] != unit[at[:-1]]]]  # the leftmost of equals
            size[at] += size[at + 1]
            some[at + 1] = False
            start, size, unit = start[some], size[some], unit[some]
        start, size = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.argsort(start, kind="stable")
        return start[order], size[order]

    def relax_long(self, edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long unit at position 0, with a heap of candidate edges."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (both := size[a] + size[b]) <= self.longest and (p := int(edge[a, both - 1])) >= 0:
                heapq.heappush(heap, (-float(self.score[p]), a, both))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = after[a]
            if size[a] == 0 or b >= n or size[a] + size[b] != both:
                continue
            size[a], size[b], after[a] = both, 0, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        kept = [a for a in range(n) if size[a]]
        return np.array(kept, np.int64), np.array([size[a] for a in kept], np.int64)

    def spell(self, text: np.ndarray, edge: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece); pieces out of the vocabulary are spelt as bytes."""
        ids = edge[start, size - 1].astype(np.int64)
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, np.ones(len(ids), np.int64)
        bytes_of = {c: [self.byte.get(b, self.unknown) for b in chr(c - 1).encode("utf-8", "replace")] for c in np.unique(text[start[lost]]).tolist()}
        spelt = [bytes_of[c] for c in text[start[lost]].tolist()]
        count = np.ones(len(ids), np.int64)
        count[lost] = [len(s) for s in spelt]
        out = np.repeat(ids, count)
        out[out < 0] = [i for s in spelt for i in s]
        return out, count

    def learn(self, units: list[str]) -> None:
        joined = "\0".join(["", *units])
        marks = np.cumsum([0] + [len(u) + 1 for u in units[:-1]])
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        text[marks] = 0
        edge = self.edges(text)
        start, size = self.relax(text, edge)
        ids, count = self.spell(text, edge, start, size)
        unit = np.cumsum(text == 0)[start] - 1
        per = np.bincount(unit, count, len(units)).astype(np.int64)
        base = len(self.starts)
        self.at.update(zip(units, range(base, base + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(per) - per])
        self.sizes = np.concatenate([self.sizes, per])
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def long_unit(self, unit: str) -> np.ndarray:
        text = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        edge = self.edges(text)
        return self.spell(text, edge, *self.relax_long(edge, len(text)))[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        if len(self.at) > CACHE_UNITS:
            self.clear()
        units: list[str] = []
        per_text = []
        for t in texts:
            own = _UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else []
            units += own
            per_text.append(len(own))
        index = np.array(list(map(self.at.get, units, repeat(-1))), np.int64)
        missing = np.flatnonzero(index < 0)
        long_ids: dict[int, np.ndarray] = {}
        if len(missing):
            fresh = [u for u in dict.fromkeys(units[k] for k in missing.tolist()) if len(u) <= LONG]
            if fresh:
                self.learn(fresh)
            known = dict[str, np.ndarray]()
            for k in missing.tolist():
                if len(units[k]) <= LONG:
                    index[k] = self.at[units[k]]
                else:
                    long_ids[k] = known[units[k]] = known[units[k]] if units[k] in known else self.long_unit(units[k])
        size = np.where(index >= 0, self.sizes[index] if len(self.sizes) else 0, 0)
        for k, v in long_ids.items():
            size[k] = len(v)
        stop = np.cumsum(size)
        begin = np.where(index >= 0, self.starts[index] if len(self.starts) else 0, 0)
        if long_ids:
            ids = np.concatenate([long_ids[k] if k in long_ids else self.pool[begin[k] : begin[k] + size[k]] for k in range(len(units))])
        else:
            ids = self.pool[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        cuts = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], stop])[cuts]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        fine = (ids >= 0) & (ids < len(self.pieces))
        ids = np.where(fine, ids, 0)
        size = np.where(fine, self.plain_ends[ids + 1] - self.plain_ends[ids], 0)
        stop = np.cumsum(size)
        raw = self.plain[np.repeat(self.plain_ends[ids] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        cuts = np.concatenate([[0], stop])[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_kept: dict[str, Vocabulary] = {}  # by model, kept by a worker between its tasks


def vocabulary(path: str) -> Vocabulary:
    if path not in _kept:
        _kept[path] = Vocabulary(path)
    return _kept[path]


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in common.slices(batches, "text", 2 << 20):
            ids, ends = own.encode([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "ids"])

    return run


def _decode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("ids")
                flat = lists.flatten()
                ends = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists.to_numpy(zero_copy_only=False)])]).astype(np.int64)
                texts = own.decode(flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids, the model's pieces of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode(model or default_model()), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and decoded, the text that the ids stand for."""
    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decode(model or default_model()), f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
