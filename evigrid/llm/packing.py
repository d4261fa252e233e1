"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of packets: whole documents, or SEQUENCE tokens each of longer ones. In each round (a window
of WINDOW tokens while all queues last) a source earns its target share of the window as credit and sends packets while
its credit covers them; what is left is carried to the next round. A packet is thus sent in the first round r with
r * share * WINDOW >= tokens of its queue up to and including it, which needs no loop.

A queue's order is that of a hash. Documents are dealt into buckets by that order, so that a bucket holds about ROUNDS
rounds of every queue, whatever the sizes of the sources, and no source gathers in one task; the tokens that a queue has
before a bucket, which carry its deficit across buckets exactly, and the bucket's place in the one stream of tokens, are
prefix sums over (bucket, source) totals. Sequences are cut from that stream at every SEQUENCE tokens, across documents
and buckets, so only the last one of all can be short. A queue that has run out leaves its share to the others: rounds
are then shorter.

Defined results: a null text is empty and still yields its end id; a null source is a source of its own; repeated rows
and repeated ids are packed each; an empty table gives no pieces; extra columns are dropped.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
WINDOW = 64 * SEQUENCE
#: Rounds of a bucket, at least: about two million tokens.
ROUNDS = 16
#: More rounds a bucket, if there would be more buckets than this: their totals pass one task.
MOST_BUCKETS = 1 << 20
END_ID = 1
#: Distinct pieces kept encoded by each worker (about 40 bytes each); when full, the table starts afresh.
CACHE_PIECES = 400_000


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a word-level BPE whose pieces never cross word borders: each distinct piece of the splitting
    pattern is encoded once, by the tokenizer itself, and kept in sorted arrays by its 64-bit hash.

    Texts are cut as the tokenizer's own pattern cuts them: contractions, runs of letters, single numerals and runs of
    anything else but white space. Texts that hold a special token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def pieces(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each piece of the lower-cased code points."""
        kind = _KIND[np.minimum(points, len(_KIND) - 1)]
        if (high := np.flatnonzero(points >= len(_KIND))).size:
            kind[high] = [_kind_of(c) for c in points[high].tolist()]
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMERAL)
        cut = np.flatnonzero(edge)
        start, end = cut[:-1].copy(), cut[1:].copy()
        own = kind[start] != SPACE
        start, end = start[own], end[own]
        mark = np.flatnonzero((points[start] == 39) & (end - start == 1))
        mark = mark[mark + 1 < len(start)]
        mark = mark[(start[mark + 1] == end[mark]) & (kind[start[mark + 1]] == LETTER)]
        for k in mark.tolist():  # an apostrophe takes the letters of a contraction along
            two = bytes(min(c, 255) for c in points[start[k + 1] : min(end[k + 1], start[k + 1] + 2)].tolist())
            taken = 1 if two[:1] in (b"s", b"t", b"m", b"d") else 2 if two in (b"re", b"ve", b"ll") else 0
            end[k] += taken
            start[k + 1] += taken
        some = start < end
        return start[some], end[some]

    def learn(self, words: list[str], keys: np.ndarray) -> None:
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([" ".join(words[k : k + 2000]) for k in range(0, len(words), 2000)], add_special_tokens=False)])
        stop = np.flatnonzero(self.last[ids]) + 1
        if len(stop) != len(words):  # a piece that the tokenizer splits further
            each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            ids, stop = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
        if len(self.keys) > CACHE_PIECES:
            self.clear()
        size = np.diff(stop, prepend=0)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, len(self.pool) + stop - size)
        self.sizes = np.insert(self.sizes, at, size)
        self.pool = np.concatenate([self.pool, ids])

    def encode_one(self, raw: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() of one very long text, in parts cut at white space, which no piece crosses."""
        every = [self.encode([raw[a:b].tobytes().decode("utf-8", "replace")], end_id)[0] for a, b in common.parts(raw, True)]
        ids = np.concatenate([*(x[:-1] for x in every[:-1]), every[-1]])
        return ids, np.array([0, len(ids)])

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); end_id follows each text."""
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = ["" if k in odd else unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3").lower() for k, t in enumerate(texts)]
        joined = "\n".join(plain) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in plain])
        start, end = self.pieces(points)
        up, down = common.powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(common.mix(points.astype(np.uint64)) * up[:-1], out=sums[1:])
        distinct, first, inverse = np.unique(common.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        if not known.all():
            fresh = ~known if len(self.keys) <= CACHE_PIECES else np.ones(len(distinct), bool)
            self.learn([joined[a:b] for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)], distinct[fresh])
            at = np.searchsorted(self.keys, distinct)
        row = at[inverse]
        doc = np.searchsorted(ends, start, side="right")
        size = self.sizes[row]
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(self.starts[row] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        per_doc = np.bincount(doc, size, len(texts)).astype(np.int64)
        out = np.insert(ids, np.cumsum(per_doc), np.uint32(end_id))
        per_doc += 1
        for k in odd:
            own = np.array([*self.tokenizer.encode(texts[k], add_special_tokens=False).ids, end_id], np.uint32)
            before = int(per_doc[:k].sum())
            out = np.concatenate([out[:before], own, out[before + 1 :]])
            per_doc[k] = len(own)
        return out, np.concatenate([[0], np.cumsum(per_doc)])


SPACE, LETTER, NUMERAL, OTHER = range(4)


def _kind_of(c: int) -> int:
    x = chr(c)
    if x.isspace() and not 0x1C <= c <= 0x1F:
        return SPACE
    return {"L": LETTER, "N": NUMERAL}.get(unicodedata.category(x)[0], OTHER)


_KIND = np.array([_kind_of(c) for c in range(65536)], np.int8)
_encoders: dict[str, WordEncoder] = {}  # of the running task


def encoder_of(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _tokenise(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        small = encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        uid = TaskContext.get().partitionId() << 33
        try:
            for batch in common.slices(batches, "text"):
                raw, ends = common.text_bytes(batch.column("text"))
                long = batch.num_rows == 1 and len(raw) > common.LONG
                whole, raw = raw, raw.tobytes()
                ids, at = encoder.encode_one(whole, end_id) if long else encoder.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], end_id)
                data = ids.astype(np.uint16 if small else np.uint32)
                blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + batch.num_rows)), batch.column("id"), batch.column("source"), pa.array(np.diff(at)), blob], ["uid", "id", "source", "n", "ids"])
                uid += batch.num_rows
        finally:
            _encoders.clear()
            del encoder
            common.trim()

    return run


def _cut(wide: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, carry: pa.Table) -> pa.Table:
        """One bucket: order its packets by round, source and place in the queue, then cut the stream."""
        n = docs.column("n").to_numpy()
        per = -(-n // SEQUENCE)
        doc = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        size = np.minimum(SEQUENCE, n[doc] - nth * SEQUENCE)
        place = {s: k for k, s in enumerate(carry.column("source").to_pylist())}
        source = np.array([place[s] for s in docs.column("source").to_pylist()], np.int64)[doc]
        share, sent = carry.column("share").to_numpy()[source], carry.column("sent").to_numpy()[source]
        queue = np.lexsort((nth, docs.column("uid").to_numpy()[doc], docs.column("turn").to_numpy()[doc], source))
        total = np.cumsum(size[queue])
        first = np.r_[True, source[queue][1:] != source[queue][:-1]]
        before = np.maximum.accumulate(np.where(first, total - size[queue], 0))
        due = np.empty(len(doc))
        due[queue] = np.ceil((total - before + sent[queue]) / (np.maximum(share[queue], 1e-12) * WINDOW))
        rank = np.empty(len(doc), np.int64)
        rank[queue] = np.arange(len(doc))
        order = np.lexsort((rank, due))
        doc, from_, size = doc[order], nth[order] * SEQUENCE, size[order]
        begin = carry.column("begin")[0].as_py() + np.cumsum(size) - size
        pieces = (begin + size - 1) // SEQUENCE - begin // SEQUENCE + 1
        packet = np.repeat(np.arange(len(doc)), pieces)
        nth = np.arange(len(packet)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.where(nth == 0, begin[packet], (begin[packet] // SEQUENCE + nth) * SEQUENCE)
        upto = np.minimum((at // SEQUENCE + 1) * SEQUENCE, begin[packet] + size[packet])
        every = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[(e := common.text_offsets(c))[0] : e[-1]] for c in docs.column("ids").chunks]).view(np.uint32 if wide else np.uint16)
        base = (np.cumsum(n) - n)[doc] + from_
        ids = every[np.repeat(base - (np.cumsum(size) - size), size) + np.arange(len(every))].astype("<u4")
        cuts = np.r_[at, upto[-1:]] - begin[0]
        blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(ids)])
        own = pa.array(doc[packet])
        common.trim()
        return pa.table({"id": docs.column("id").take(own), "source": docs.column("source").take(own), "start": from_[packet] + at - begin[packet], "length": upto - at, "ids": blob, "doc_tokens": n[doc[packet]], "sequence_id": at // SEQUENCE, "offset": at % SEQUENCE})

    return run


def equal_targets(docs: DataFrame, *, source_col: str = "source", most: int = 64) -> dict[str, float]:
    """Equal shares for the `most` most frequent sources (a bounded table; null is no name); the others come last."""
    rows = docs.filter(F.col(source_col).isNotNull()).groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(most).collect()
    return {r["source"]: 1.0 / len(rows) for r in rows}


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, targets: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: id, source, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    targets: share of the tokens per source; the default is each source's own share of the corpus. All documents are
    packed: while all named sources last, every window has the target mixture; then those that are left go on in their
    proportion. Sources missing in targets come last, mixed as they are in the corpus.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.small_batches(docs).select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    tokens = common.staged(rows.mapInArrow(_tokenise(path, end_id), f"uid long, id {kind}, source string, n long, ids binary"), "packing-tokens")
    turn = F.xxhash64("uid", F.lit(3))
    place = F.pmod(turn, F.lit(1 << 40)) / float(1 << 40)  # of a document in its queue, as a share of it
    none = F.lit(None)
    targets = {s: t for s, t in (targets or {}).items() if t > 0}
    if targets:
        named = F.col("source").isin(*targets)
        given = sum(targets.values())
        sums = {r["source"]: r["n"] for r in tokens.groupBy(F.when(named, F.col("source")).alias("source")).agg(F.sum("n").alias("n")).collect()}
        rest = sums.pop(None, 0)
        stream = {s: n * given / targets[s] for s, n in sums.items()}  # tokens until the queue has run out
        each = max(ROUNDS * WINDOW, max([rest, *stream.values()]) / MOST_BUCKETS)
        spans = {s: max(1.0, n / each) for s, n in stream.items()}
        of_source = lambda values: F.when(named, F.create_map([F.lit(x) for s, v in values.items() for x in (s, v)])[F.col("source")]) if values else none.cast("double")
        last = int(max(spans.values(), default=0)) + 1
        bucket = F.coalesce(F.floor(place * of_source(spans)), last + F.floor(place * max(1.0, rest / each)))
        share = of_source({s: targets[s] / given for s in spans})
    else:
        total = tokens.agg(F.sum("n")).first()[0] or 0
        bucket, share = F.floor(place * max(1.0, total / max(ROUNDS * WINDOW, total / MOST_BUCKETS))), none.cast("double")
    tokens = tokens.withColumn("bucket", bucket.cast("int")).withColumn("turn", F.pmod(turn, F.lit(1 << 40)))
    cells = common.staged(tokens.groupBy("bucket", "source").agg(F.sum("n").alias("n")).withColumn("target", share), "packing-totals")
    # sources without a target share the rest as they do in the corpus
    own = cells.filter("target is null").groupBy("source").agg(F.sum("n").alias("own")).withColumn("own_share", F.col("own") / F.sum("own").over(Window.partitionBy(F.lit(0)))).select(F.col("source").alias("source2"), "own_share")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = cells.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    sent = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = (
        cells.withColumn("sent", sent).join(begin, "bucket").join(own, F.col("source").eqNullSafe(F.col("source2")), "left")
        .select("bucket", "source", F.coalesce("target", "own_share").alias("share"), "begin", "sent")
    )
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(path).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    out = tokens.groupBy("bucket").cogroup(carry.groupBy("bucket")).applyInArrow(_cut(wide), f"id {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
