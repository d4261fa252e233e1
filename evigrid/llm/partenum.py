"""N-gram Jaccard join by PartEnum signatures: exact, without all pairs.

Sets of similar size meet in a size band; there a Jaccard threshold is a bound k on the number of differing shingles.
The domain of shingles is cut, by hash, into n1 parts of PARTS second-level parts. Two sets with at most k differences
differ in at most one second-level part of some first-level part, so they agree on one of its PARTS subsets that leave
one part out: each subset's content, hashed, is a signature, and linked sets share one.

A signature of no shingle at all says little and would gather strangers. With `spare` further first-level parts, more
than `spare` parts agree, so a set with at most `spare` empty signatures may leave those out: of two sets that share
only empty ones, both have more than `spare` and then both keep them. No link is lost.

Equal sets are one class from the start. Signatures are dealt into buckets by their own hash, so a bucket's size follows
the number of buckets only. Signature groups give candidate pairs in two rounds: every member with one centre, then, as
all verified pairs have joined their components, members of different components with each other, block by block.
Candidates pass a bound from 128 part counts (their differences never exceed the true one) and are then verified on
the shingles of the whole texts. Result: the components, which are exact, and links between class representatives that
connect them; a link within a component that other links already imply is not verified, so links are not all of them.

Defined results: null, empty or wordless texts have no shingle, are linked with nothing and are their own component;
texts shorter than the shingle are one shingle of all their words; repeated rows fall into one class; a null id yields a
row with null id, and ids never split a class; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .quality import word_spans

PARTS = 3
COUNTS = 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den, over shingles of `words` words."""

    num: int = 85
    den: int = 100
    words: int = 4

    @lru_cache(maxsize=None)  # noqa: B019  few instances
    def bands(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least size, first-level parts, spare) of each band. Linked sets stand in one band or in neighbours."""
        low, parts, spare = [], [], []
        at = 1
        while at < 1 << 40:
            up = at * self.den // self.num
            k = (up + up * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            n1, extra = (k + 2) // 2, 0
            if n1 >= 8:
                expected = PARTS * n1 * math.exp(-(PARTS - 1) * at / (PARTS * n1))
                extra = math.ceil(expected + 3 * math.sqrt(expected))
            low.append(at)
            parts.append(0 if k == 0 else n1 + extra)
            spare.append(extra)
            at = up + 1
        return np.array(low), np.array(parts), np.array(spare)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, their upper 52 bits, offsets) of the distinct shingles of at most 4096 documents, sorted within each.
    A very long text is worked on in parts that share words - 1 words."""
    if len(ends) != 2 or len(raw) <= common.LONG:
        return _sets(raw, ends, words)
    every = [_sets(raw[a:b], np.array([0, b - a]), words) for a, b in _overlapping(raw, words)]
    full = np.unique(np.concatenate([x[0] for x in every]))
    return full, full >> np.uint64(12), np.array([0, len(full)])


def _sets(raw: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = len(ends) - 1
    raw = _LOWER[raw]
    start, end, doc = word_spans(raw, ends)
    w = common.span_hash(common.prefix_hash(raw), start, end)
    odd = common.words64(29, words + 1)
    n = max(0, len(w) - words + 1)
    full = np.zeros(n, np.uint64)
    for t in range(words):
        full += common.mix(w[t : t + n] * odd[t])
    inside = doc[:n] == doc[words - 1 :] if n else np.zeros(0, bool)
    keys, owner = [common.mix(full[inside])], [doc[:n][inside]]
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    for c in range(1, words):
        short = np.flatnonzero(count == c)
        value = np.full(len(short), odd[words] * np.uint64(c))
        for t in range(c):
            value += common.mix(w[first[short] + t] * odd[t])
        keys.append(common.mix(value))
        owner.append(short)
    key, who = np.concatenate(keys), np.concatenate(owner).astype(np.uint64)
    packed = who << np.uint64(52) | key >> np.uint64(12)
    order = np.argsort(packed, kind="stable")
    next_to = (packed[order[1:]] == packed[order[:-1]]) & (key[order[1:]] != key[order[:-1]])
    if next_to.any():  # two shingles that differ in their last 12 bits only
        order = np.lexsort((key, who))
    packed, key = packed[order], key[order]
    new = np.concatenate([[True], (packed[1:] != packed[:-1]) | (key[1:] != key[:-1])])[: len(key)]
    packed, key = packed[new], key[new]
    size = np.bincount((packed >> np.uint64(52)).astype(np.int64), minlength=docs)
    return key, packed & np.uint64((1 << 52) - 1), np.concatenate([[0], np.cumsum(size)])


def _overlapping(raw: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Parts of one text; each begins with the last words - 1 words of the one before, and has words of its own."""
    begin = 0
    for _, stop in common.parts(raw, True):
        own, _, _ = word_spans(raw[begin:stop], np.array([0, stop - begin]))
        if len(own) < (2 * words if stop < len(raw) else words if begin else 0):
            continue  # too few words: the next part takes them along, or there are no new ones
        yield begin, stop
        begin += int(own[1 - words]) if words > 1 and len(own) >= words else stop - begin


def part_counts(short: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shingles of each document in each of COUNTS parts of the domain, at most 255."""
    docs = len(at) - 1
    doc = np.repeat(np.arange(docs), np.diff(at))
    return np.minimum(np.bincount(doc * COUNTS + (short & np.uint64(COUNTS - 1)).astype(np.int64), minlength=docs * COUNTS), 255).reshape(docs, COUNTS).astype(np.uint8)


def signatures(full: np.ndarray, short: np.ndarray, at: np.ndarray, which: np.ndarray, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, signature) for the documents `which`: of the own band and of the one below."""
    low, parts, spare = threshold.bands()
    size = np.diff(at)
    sums = np.zeros(len(full) + 1, np.uint64)
    np.cumsum(common.mix(full ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    band = np.searchsorted(low, size, side="right") - 1
    odd = common.words64(31, PARTS + 1)
    for below in (0, 1):
        scheme = band - below
        doc = which[(size[which] > 0) & (scheme[which] >= 0)]
        doc = doc[parts[scheme[doc]] > 0]
        if not len(doc):
            continue
        n_slots = parts[scheme[doc]] * PARTS
        base = np.cumsum(n_slots) - n_slots
        total = int(n_slots.sum())
        element = np.repeat(at[doc] - (np.cumsum(size[doc]) - size[doc]), size[doc]) + np.arange(int(size[doc].sum()))
        slot = ((short[element] >> np.uint64(12)) * np.repeat(n_slots, size[doc]).astype(np.uint64) >> np.uint64(40)).astype(np.int64) + np.repeat(base, size[doc])
        held = np.bincount(slot, minlength=total)
        # the elements of a document are contiguous in `full`, so a slot's content is a difference of prefix sums
        upto = np.repeat(at[doc] - (np.cumsum(size[doc]) - size[doc]), n_slots) + np.cumsum(held)
        content = (sums[upto] - sums[upto - held]).reshape(-1, PARTS)
        held = held.reshape(-1, PARTS)
        owner = np.repeat(np.arange(len(doc)), n_slots // PARTS)
        part = np.arange(len(owner)) - (base // PARTS)[owner]
        place = scheme[doc][owner] * (1 << 20) + part
        empties = np.zeros(len(doc), np.int64)
        found = []
        for left_out in range(PARTS):
            rest = [p for p in range(PARTS) if p != left_out]
            value = odd[PARTS] * (place * PARTS + left_out).astype(np.uint64)
            for p in rest:
                value = value + common.mix(content[:, p] * odd[p])
            empty = held[:, rest].sum(1) == 0
            empties += np.bincount(owner[empty], minlength=len(doc))
            found.append((common.mix(value), empty))
        keep_empty = (empties > spare[scheme[doc]])[owner]
        for value, empty in found:
            kept = ~empty | keep_empty
            yield doc[owner[kept]], value[kept]


def _first_pass(threshold: Threshold, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["kind", "id", "uid", "key", "n", "fp", "counts", "bucket", "owners", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        met: set[bytes] = set()
        for batch in common.slices(batches, "text"):
            rows = batch.num_rows
            full, short, at = shingle_sets(*common.text_bytes(batch.column("text")), threshold.words)
            sums = np.zeros((2, len(full) + 1), np.uint64)
            np.cumsum(common.mix(full), out=sums[0, 1:])
            np.cumsum(common.mix(full ^ np.uint64(0x9E6C63D0676A9A99)), out=sums[1, 1:])
            fp = (sums[:, at[1:]] - sums[:, at[:-1]]).T.copy()
            prints = [x.tobytes() for x in fp]
            fresh = []
            for k, x in enumerate(prints):  # copies within a task sign once
                if x not in met:
                    met.add(x)
                    fresh.append(k)
            if len(met) > 2_000_000:
                met.clear()
            none = lambda t, n=rows: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), batch.column("id"), pa.array(np.arange(uid, uid + rows)), batch.column("key"), pa.array(np.diff(at)), pa.array(prints, pa.binary()), pa.array([x.tobytes() for x in part_counts(short, at)], pa.binary()), none(pa.int32()), none(pa.binary()), none(pa.binary())], names)
            parts = list(signatures(full, short, at, np.array(fresh, np.int64), threshold))
            if parts:
                doc, sig = (np.concatenate([p[k] for p in parts]) for k in range(2))
                bucket = ((sig >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((doc, bucket)) if rows > 65535 else np.argsort(bucket << 16 | doc, kind="stable")
                doc, sig, bucket = doc[order].astype(np.uint16), sig[order].astype(np.uint32), bucket[order]
                each, begin = np.unique(bucket, return_index=True)
                stop = np.append(begin[1:], len(bucket))[: len(begin)]
                m = len(each)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, batch.column("id").type), pa.array(np.full(m, uid)), none(pa.binary(), m), none(pa.int64(), m), none(pa.binary(), m), none(pa.binary(), m), pa.array(each.astype(np.int32)), pa.array([doc[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary()), pa.array([sig[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary())], names)
            uid += rows

    return run


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])


def _meet(n_groups: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket: documents that share a signature. Rows with kind 0 are the pairs (centre, member), each once, packed by
    groups of centres; rows with kind 1 are the distinct signature groups of three and more: a hash of the group, and up
    to MEMBERS of its members from the b-th on."""
    return lambda bucket: _groups_of(bucket, n_groups)


def _groups_of(group: pa.Table, n_groups: int) -> pa.Table:
    owners = np.concatenate([np.frombuffer(o.as_py(), np.uint16).astype(np.int64) + u for o, u in zip(group.column("owners"), group.column("uid").to_pylist(), strict=True)])
    sigs = np.concatenate([np.frombuffer(s.as_py(), np.uint32) for s in group.column("sigs")])
    nodes, node = np.unique(owners, return_inverse=True)
    turn = common.mix(nodes.astype(np.uint64))  # the same order in every bucket, so that centres agree
    rank = np.empty(len(nodes), np.int64)
    rank[np.argsort(turn, kind="stable")] = np.arange(len(nodes))
    packed = np.unique(sigs.astype(np.uint64) << np.uint64(32) | rank[node].astype(np.uint64))
    sig, member = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    by_rank = np.empty(len(nodes), np.int64)
    by_rank[rank] = nodes
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(sig)))
    begin, size = begin[size > 1], size[size > 1]
    index = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    centre, other = np.repeat(member[begin], size), member[index]
    pairs = np.unique(centre[centre != other] << 32 | other[centre != other])
    first, hashes = np.cumsum(size) - size, np.zeros(0, np.uint64)
    if len(size):
        hashes = common.mix(np.add.reduceat(common.mix(by_rank[other].astype(np.uint64) + np.uint64(7)), first) + size.astype(np.uint64))
    _, once = np.unique(hashes, return_index=True)
    once = once[size[once] > 2]
    lists: list[tuple[int, int, list[int]]] = []
    for k in once.tolist():
        own = by_rank[other[first[k] : first[k] + size[k]]]
        lists += [(int(hashes[k].astype(np.int64)), n, own[n : n + MEMBERS].tolist()) for n in range(0, len(own), MEMBERS)]
    found = np.empty(len(pairs), _PAIR)
    found["a"], found["b"] = by_rank[pairs >> 32], by_rank[pairs & 0xFFFFFFFF]
    groups, blobs = common.dealt(found, (common.mix(found["a"].astype(np.uint64)) % np.uint64(n_groups)).astype(np.int64))
    m, n = len(groups), len(lists)
    common.trim()
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [m, n]).astype(np.int32)),
        "a": pa.array([*groups, *(x[0] for x in lists)], pa.int64()),
        "b": pa.array([0] * m + [x[1] for x in lists], pa.int64()),
        "pairs": pa.array(blobs + [None] * n, pa.binary()),
        "members": pa.array([None] * m + [x[2] for x in lists], pa.list_(pa.int64())),
    })


def _unpacked(group: pa.Table) -> pa.Table:
    """The distinct pairs of one group of centres, from all buckets."""
    found = np.unique(common.gathered(group.column("pairs"), _PAIR))
    return pa.table({"a": found["a"], "b": found["b"]})


def may_link(n1: np.ndarray, n2: np.ndarray, c1: np.ndarray, c2: np.ndarray, threshold: Threshold) -> np.ndarray:
    """False where sizes, or part counts, already rule the similarity out: differences in the counts are differences in
    the sets, and intersection and union are half of (n1 + n2 -/+ differences)."""
    apart = np.abs(c1 - c2).sum(-1, dtype=np.int64)
    fine = threshold.den * (n1 + n2 - apart) >= threshold.num * (n1 + n2 + apart)
    return fine & (threshold.den * np.minimum(n1, n2) >= threshold.num * np.maximum(n1, n2))


def counts_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16)


def _likely(threshold: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = pa.array(may_link(batch.column("n1").to_numpy(), batch.column("n2").to_numpy(), counts_of(batch.column("c1")), counts_of(batch.column("c2")), threshold))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(fine), batch.column("b").filter(fine)], ["a", "b"])

    return run


def _verify(threshold: Threshold) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(centres: pa.Table, members: pa.Table) -> pa.Table:
        left: dict[int, np.ndarray] = {}
        for batch in common.slices(iter(centres.to_batches()), "text1"):
            full, _, at = shingle_sets(*common.text_bytes(batch.column("text1")), threshold.words)
            for k, a in enumerate(batch.column("a1").to_pylist()):
                left[a] = full[at[k] : at[k + 1]]
        linked_a, linked_b = [], []
        for batch in common.slices(iter(members.to_batches()), "text"):
            full, _, at = shingle_sets(*common.text_bytes(batch.column("text")), threshold.words)
            for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                x, y = left[a], full[at[k] : at[k + 1]]
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                both = int((y[np.minimum(place, len(y) - 1)] == x).sum()) if len(x) else 0
                if both and threshold.den * both >= threshold.num * (len(x) + len(y) - both):
                    linked_a.append(a)
                    linked_b.append(b)
        return pa.table({"a": pa.array(linked_a, pa.int64()), "b": pa.array(linked_b, pa.int64())})

    return run


#: A centre's members are verified in groups of about this many.
SPLIT = 512
#: Members of a signature group in one row, and in one block of the second round.
MEMBERS = 2048


class JaccardJoin:
    """The join of one table of texts with itself. After run(): `rows` (id, n, node), `links` (a, b: verified links
    between class representatives) and `parts` (node, component)."""

    def __init__(self, docs: DataFrame, threshold: Threshold, id_col: str, text_col: str):
        self.threshold = threshold
        self.kind = docs.schema[id_col].dataType.simpleString()
        text = F.col(text_col)
        self.texts = common.small_batches(docs).select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("key"), text.alias("text"))
        self.n_buckets = common.buckets(docs, 3 << 20, 16)

    def run(self) -> JaccardJoin:
        first = common.staged(self.texts.mapInArrow(_first_pass(self.threshold, self.n_buckets), f"kind int, id {self.kind}, uid long, key binary, n long, fp binary, counts binary, bucket int, owners binary, sigs binary"), "join-first")
        rows = first.filter("kind = 0").select("id", "uid", "key", "n", "fp")
        classes = common.staged(first.filter("kind = 0 and n > 0").groupBy("fp", "n").agg(F.min("uid").alias("node"), F.min_by("key", "uid").alias("key"), F.min_by("counts", "uid").alias("counts"), F.min("id").alias("least_id")), "join-classes")
        self.rows = rows.join(classes.select("fp", "n", "node"), ["fp", "n"], "left").select("id", "uid", "key", "n", "node")
        self.classes = classes
        node_of = common.staged(rows.filter("n > 0").join(classes.select("fp", "n", "node"), ["fp", "n"]).select("uid", "node"), "join-nodes")
        n_groups = max(8, self.n_buckets // 4)
        met = common.staged(first.filter("kind = 1").select("bucket", "uid", "owners", "sigs").groupBy("bucket").applyInArrow(_meet(n_groups), "kind int, a long, b long, pairs binary, members array<long>"), "join-met")
        pairs = met.filter("kind = 0").select("a", "pairs").groupBy("a").applyInArrow(_unpacked, "a long, b long")
        for c in ("a", "b"):
            pairs = pairs.join(node_of.select(F.col("uid").alias(c), F.col("node").alias(f"node_{c}")), c)
        pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        tried = common.staged(pairs.filter("a <> b").distinct(), "join-tried")
        links = common.staged(self.verified(tried), "join-links")
        parts = common.staged(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "join-parts")
        # second round: groups whose members the first round has left in several components
        groups = met.filter("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("part"), "members").dropDuplicates(["g", "part"])
        member = groups.select("g", F.explode("members").alias("uid")).join(node_of, "uid").select("g", "node").distinct().join(parts, "node", "left").select("g", "node", F.coalesce("component", "node").alias("component"))
        member = common.staged(member, "join-members")
        mixed = member.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks")).filter("x <> y").select("g", "blocks")
        member = member.join(mixed, "g").join(classes.select("node", "n", "counts"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        met_with = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "counts")
        more = met_with.withColumn("bucket", F.pmod(F.xxhash64("g", "i", "j"), F.lit(self.n_buckets))).groupBy("bucket").applyInArrow(_across(self.threshold), "a long, bs array<long>")
        more = more.groupBy(F.pmod(F.xxhash64("a"), F.lit(self.n_buckets))).applyInArrow(_distinct, "a long, b long").join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        later = common.staged(self.verified(common.staged(more, "join-more")), "join-links")
        self.links = links.union(later)
        if not later.isEmpty():
            parts = common.staged(components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "join-parts")
        self.parts = parts
        return self

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of nodes that are linked, by their whole texts."""
        for c, k in (("a", "1"), ("b", "2")):
            pairs = pairs.join(self.classes.select(F.col("node").alias(c), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}")), c)
        likely = common.staged(pairs.mapInArrow(_likely(self.threshold), "a long, b long"), "join-likely")
        if likely.isEmpty():
            return likely
        per = common.staged(likely.groupBy("a").agg((F.ceil(F.count("*") / SPLIT)).cast("int").alias("splits")), "join-splits")
        n_groups = common.buckets(self.texts, 8 << 20, 16)
        dealt = likely.join(per, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("splits"))).withColumn("group", F.pmod(F.xxhash64("a", "salt"), F.lit(n_groups)).cast("int"))
        needed = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
        wanted = needed.join(self.classes.select("node", "key"), "node")
        texts = common.staged(self.texts.select("key", "text").join(wanted, "key").dropDuplicates(["node"]), "join-texts")
        centres = dealt.select("a", "group").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select(F.col("a").alias("a1"), F.col("group").alias("group1"), F.col("text").alias("text1"))
        members = dealt.select("a", "b", "group").join(texts.select(F.col("node").alias("b"), "text"), "b")
        return centres.groupBy("group1").cogroup(members.groupBy("group")).applyInArrow(_verify(self.threshold), "a long, b long")


def _across(threshold: Threshold) -> Callable[[pa.Table], pa.Table]:
    """Pairs of a signature group's members that stand in different components and may be linked, a row per member.
    Members come in pairs (i, j) of blocks: with i = j all of the block meet, else those of one with those of the other."""

    def pairs(group: pa.Table) -> pa.Table:
        g, i, j, block, node, part, n = (group.column(c).to_numpy() for c in ("g", "i", "j", "block", "node", "component", "n"))
        counts = counts_of(group.column("counts"))
        order = np.lexsort((node, part, j, i, g))
        g, i, j, block, node, part, n, counts = g[order], i[order], j[order], block[order], node[order], part[order], n[order], counts[order]
        met = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        run = np.cumsum(np.r_[False, (met[1:] != met[:-1]) | (part[1:] != part[:-1])])
        later, stop = np.searchsorted(run, run, side="right"), np.searchsorted(met, met, side="right")
        found: dict[int, list[np.ndarray]] = {}
        for k in range(len(node)):
            if later[k] < stop[k]:
                to = slice(int(later[k]), int(stop[k]))
                fine = may_link(n[k], n[to], counts[k], counts[to], threshold) & ((block[to] != block[k]) | (i[k] == j[k]))
                if len(some := node[to][fine]):
                    found.setdefault(int(node[k]), []).append(some)
        common.trim()
        return pa.table({"a": pa.array(list(found), pa.int64()), "bs": pa.array([np.unique(np.concatenate(x)) for x in found.values()], pa.list_(pa.int64()))})

    return pairs


def _distinct(group: pa.Table) -> pa.Table:
    """Rows (a, bs) -> the distinct pairs (a, b)."""
    lists = group.column("bs").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    pairs = np.stack([np.repeat(group.column("a").to_numpy(), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()], 1)
    pairs = np.unique(pairs, axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def jaccard_join(docs: DataFrame, threshold: Threshold = Threshold(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008  frozen
    """One row per document: id, n_shingles, component_id (the least id of its component; its own without links)."""
    join = JaccardJoin(docs, threshold, id_col, text_col).run()
    # each class with its component; the component's least id over all its classes
    of_class = join.classes.select("node", "least_id").join(join.parts, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = of_class.join(least, "component").select("node", "component_id")
    out = join.rows.join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, threshold: Threshold, *, keep: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns `keep` of one row of each component: that of the least id (null ids last). Rows without shingles stay;
    of rows that are equal in id and text one stays."""
    join = JaccardJoin(docs, threshold, id_col, text_col).run()
    rows = join.rows.join(join.parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.struct(F.col("id").isNull().alias("last"), "id", "uid")
    chosen = rows.filter("n > 0").groupBy("component").agg(F.min_by("id", first).alias("id"), F.min_by("key", first).alias("key"))
    named = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id2"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key2"))
    empties = rows.filter("n = 0").select("id", "key").distinct()
    picked = common.staged(chosen.select("id", "key").union(empties), "join-kept")
    kept = named.join(picked, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left_semi")
    if not rows.groupBy("id", "key").count().filter("count > 1").isEmpty():  # equal rows: one stays
        kept = kept.dropDuplicates(["id2", "key2"])
    return kept.select(*[F.col("row")[c].alias(c) for c in keep])
