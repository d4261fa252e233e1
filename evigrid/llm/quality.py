"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal equations,
isotonic calibration.

One pass turns every whole text into a fixed vector of statistics. Random Fourier features of the standardised
vector approximate a Gaussian kernel. Each partition sums its part of the normal equations, so fitting moves
matrices of a fixed size, not rows. A fifth of the training rows is kept for the calibration by pool-adjacent-violators.

Defined results: null and empty texts have all-zero counts and get a score like any other; repeated rows are scored
each; a document with several labels counts with their mean; null labels and labels of unknown documents are ignored;
without any usable label every score is 0.5; with labels of one kind only, every score is that label; extra columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

N_FEATURES = 192
STATS = ("log_bytes", "log_words", "word_mean", "word_std", "upper", "digits", "shouts", "symbols", "pipes", "stops", "commas", "lines", "repeats", "distinct", "other_punct", "non_ascii", "clean_ends", "capitals")

_CLASS = np.zeros(256, np.int64)  # 0 other control, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 !, 7 symbol, 8 |, 9 ., 10 comma, 11 other punctuation, 12 non-ascii
_CLASS[33:127] = 11
_CLASS[128:] = 12
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\r\x0b\x0c"), (5, b"\n"), (6, b"!"), (7, b"#$%&*@^~=+<>{}\\_"), (8, b"|"), (9, b".?"), (10, b",;:")):
    _CLASS[list(_chars)] = _k
_SPACE = np.isin(_CLASS, (4, 5))


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes other than ASCII white space; runs end at document borders."""
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def statistics(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The STATS of each document, as float64 [document, statistic]. A very long text is counted in parts, which adds
    nothing to the counts but that a word is not compared with the last one of the part before."""
    if len(ends) != 2 or len(raw) <= common.LONG:
        sums, _ = _counts(raw, ends)
    else:
        every = [_counts(raw[a:b], np.array([0, b - a])) for a, b in common.parts(raw, True)]
        sums = np.sum([x[0] for x in every], axis=0)
        sums[:, -1] = len(np.unique(np.concatenate([x[1] for x in every])))
    count = sums[:, :13]
    words, total, squares, again, clean, capital, size, distinct = sums[:, 13:].T
    each, chars = np.maximum(words, 1), np.maximum(size, 1)
    mean = total / each
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    return np.stack([np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(squares / each - mean**2, 0)), count[:, 2] / letters, count[:, 3] / chars, count[:, 6] / each, count[:, 7] / each, count[:, 8] / each, count[:, 9] / each, count[:, 10] / each, count[:, 5] / each, again / each, distinct / each, count[:, 11] / chars, count[:, 12] / chars, clean / each, capital / each], axis=1)


def _counts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each document: 13 classes of bytes, words, their bytes, squares of these, repeated neighbours, clean ends,
    capitals, bytes, distinct words; keys of the distinct words)."""
    docs = len(ends) - 1
    doc_of = np.repeat(np.arange(docs), np.diff(ends))
    count = np.bincount(doc_of * 13 + _CLASS[raw], minlength=docs * 13).reshape(docs, 13).astype(float)
    start, end, doc = word_spans(raw, ends)
    size = (end - start).astype(float)
    key = common.span_hash(common.prefix_hash(raw), start, end) >> np.uint64(24) | (doc.astype(np.uint64) << np.uint64(40))
    again = np.bincount(doc[1:][key[1:] == key[:-1]], minlength=docs) if len(key) else np.zeros(docs)
    keys = np.unique(key)
    distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=docs)
    last = _CLASS[raw[end - 1]] if len(end) else np.zeros(0, np.int64)
    clean = np.bincount(doc, np.isin(last, (1, 2, 9, 10, 12)).astype(float), docs)
    capital = np.bincount(doc, (_CLASS[raw[start]] == 2).astype(float) if len(start) else None, docs)
    rest = [np.bincount(doc, minlength=docs), np.bincount(doc, size, docs), np.bincount(doc, size * size, docs), again, clean, capital, np.diff(ends), distinct]
    return np.hstack([count, np.stack(rest, axis=1).astype(float)]), keys


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        x = statistics(*common.text_bytes(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "x"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), len(STATS))


@dataclass(frozen=True)
class Kernel:
    """Standardisation and the random features; the last columns are the statistics themselves and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int = 7
    n: int = N_FEATURES

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        rng = np.random.Generator(np.random.PCG64(self.seed))
        w, b = rng.standard_normal((x.shape[1], self.n)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, self.n)
        return np.hstack([np.sqrt(2 / self.n) * np.cos(z @ w + b), z / np.sqrt(x.shape[1]), np.ones((len(x), 1))])


def _sums(kernel: Kernel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                a = kernel.features(_matrix(batch.column("x")))
                part = a.T @ np.hstack([a, np.asarray(batch.column("y"), float)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "part"])

    return run


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), float) for x in group.column("part"))
    return pa.table({"i": group.column("i")[:1], "part": pa.array([total.tobytes()], pa.binary())})


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.heights)


#: Raw scores are calibrated on a grid of this step, so the driver sees a bounded histogram.
GRID = 1 / 1024


def fit(rows: DataFrame, *, ridge: float = 1e-3) -> Model | None:
    """rows: x (statistics), y (0..1), and `calibrate`, true for the rows kept from the ridge fit. None without rows."""
    k = len(STATS)
    moments = rows.select([F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)] + [F.count("*").alias("n"), F.count_if(~F.col("calibrate")).alias("n_fit")]).first()
    if not moments["n"]:
        return None
    scale = np.array([moments[f"s{i}"] for i in range(k)])
    kernel = Kernel(np.array([moments[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0))
    own = rows.filter(~F.col("calibrate")) if moments["n_fit"] else rows
    parts = own.select("x", "y").mapInArrow(_sums(kernel), "i long, part binary")
    sums = np.stack([np.frombuffer(r["part"], float) for r in sorted(parts.groupBy("i").applyInArrow(_add, "i long, part binary").collect(), key=lambda r: r["i"])])
    n = moments["n_fit"] or moments["n"]
    weights = np.linalg.solve(sums[:, :-1] + ridge * n / 100 * np.eye(len(sums)), sums[:, -1])

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel.features(_matrix(batch.column("x"))) @ weights
            at = np.clip(np.rint(raw / GRID), -1024, 2048).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["at", "y"])

    held = rows.filter("calibrate") if moments["n_fit"] < moments["n"] else rows
    bins = held.select("x", "y").mapInArrow(raw_scores, "at long, y double").groupBy("at").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("at").collect()
    at, count, y = (np.array([b[c] for b in bins], float) for c in ("at", "n", "y"))
    smooth = isotonic(y, count)
    edges = np.flatnonzero(np.diff(smooth)) + 1  # interpolate between the centres of the pooled blocks
    blocks = np.split(np.arange(len(at)), edges)
    return Model(kernel, weights, np.array([np.average(at[b], weights=count[b]) for b in blocks]) * GRID, np.array([smooth[b[0]] for b in blocks]))


def crc_of(col: str) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the array of STATS, per row; staged, as fitting and scoring both read it."""
    kind = docs.schema[id_col].dataType.simpleString()
    return common.staged(common.small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_stats_of, f"id {kind}, x array<double>"), "quality-stats")


def learnt(stats: DataFrame, labels: DataFrame, *, id_col: str, label_col: str) -> Model | None:
    """The model of the labelled documents, without those whose crc32 of the id as text, modulo 3, is 1."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    train = stats.filter(crc_of("id") % 3 != 1).join(y, "id").select("x", "y", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("calibrate"))
    return fit(common.staged(train, "quality-train"))


def judged(docs: DataFrame, labels: DataFrame, *, keep: Sequence[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The columns `keep` of each document with score and predicted; learnt as in score_quality()."""
    model = learnt(document_statistics(docs, id_col=id_col, text_col=text_col), labels, id_col=id_col, label_col=label_col)
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            score = np.full(batch.num_rows, 0.5) if model is None else np.clip(model.score(statistics(*common.text_bytes(batch.column("text")))), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "score", "predicted")


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: id, held_out (crc32 of the id as text, modulo 3, is 1; such labels are never learnt), score, predicted."""
    stats = document_statistics(docs, id_col=id_col, text_col=text_col)
    model = learnt(stats, labels, id_col=id_col, label_col=label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if model is None else model.score(_matrix(batch.column("x")))
            score = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    out = stats.select("id", "x", F.coalesce(crc_of("id") % 3 == 1, F.lit(False)).alias("held_out")).mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
