"""Phrase collocation mining: counts of all phrases of up to three words in each language, and how strongly they bind.

Each task numbers the words of a block of its input by first use and keeps the block as these numbers. Word counts
summed over all blocks give the dictionary of frequent words; a word's number in it follows from the word's hash bucket
and its place there, so it is the same in every run, and a block gets the numbers of just its own words through a join.
Pieces break at every other word, since no phrase with a rare word is frequent. The key at each place is the numbers of
three words in a row in fixed-width bytes (zero where the piece ends after two): a block sorts its keys by radix, counts
runs of equal ones and sends each range of keys to its bucket; a bucket sorts what it got the same way and counts again.
Prefixes of two words and whole keys are the phrases of two and three words; what a bucket border cuts is summed after.

Bucket borders are quantiles of the keys of SAMPLE_BLOCKS blocks, SAMPLE of each; they only balance the work, every key is
counted. No key is sent more than once a block, so no word or phrase is a hot group.

Defined results: a null text is empty; a null language is `und`; repeated rows count each; an empty table has an empty
result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a block; blocks that the borders are taken from, and keys of each.
BLOCK, SAMPLE_BLOCKS, SAMPLE = 16 << 20, 64, 1 << 10
#: A word's number has 5 bytes; a key of 15 bytes is held in two words of 60 bits.
_ID, _HALF = np.uint64(40), np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)
#: Bytes that end a piece, all made one; A-Z to a-z; the tab is a space.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
_RECORD = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("n", "<i8")])


class _Block:
    """The texts of one language in one block, as numbers of words: 0 nothing, 1 the end of a piece."""

    def __init__(self):
        self.ids = common.WordIds()
        self.ids[b""], self.ids[b"\n"] = 0, 1
        self.codes: list[np.ndarray] = []

    def add(self, data: bytes) -> None:
        words = data.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.codes.append(codes[codes > 0])

    def row(self) -> tuple[list[str], list[int], bytes]:
        codes = np.concatenate(self.codes)
        count = np.bincount(codes, minlength=len(self.ids))[2:]
        return [w.decode("utf-8", "replace") for w in self.ids][2:], count.tolist(), codes.astype("<i4").tobytes()


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, lang, words, freq, codes: one row for each language of a block."""
    task, nth, held = TaskContext.get().partitionId(), 0, 0
    blocks: dict[str, _Block] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, block in sorted(blocks.items()):
            words, freq, codes = block.row()
            if words:
                columns = [pa.array([(task << 32) + nth]), pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([freq], pa.list_(pa.int64())), pa.array([codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "words", "freq", "codes"])
        blocks.clear()

    for batch in common.slices(batches, "text"):
        raw, ends = common.text_bytes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            block = blocks.setdefault(lang, _Block())
            short = [k for k, x in enumerate(langs) if x == lang and ends[k + 1] - ends[k] <= common.LONG]
            block.add(b"\n".join(raw[ends[k] : ends[k + 1]].tobytes() for k in short) + b"\n")
            for k in set(range(len(langs))) - set(short):
                if langs[k] == lang:  # cut at white space: the parts are one text
                    for c, d in common.parts(raw[ends[k] : ends[k + 1]], True):
                        block.add(raw[ends[k] + c : ends[k] + d].tobytes())
                    block.add(b"\n")
        held += len(raw)
        if held >= BLOCK:
            yield from flushed()
            nth, held = nth + 1, 0
    yield from flushed()


def counted(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distinct keys (hi, lo), ascending, with their sums of n: radix sort by 16 bits, lowest first, then run lengths.
    Digits that are the same in all keys are passed over."""
    order = np.arange(len(hi))
    for part in (lo, hi):
        for shift in range(0, 64, 16):
            digit = ((part >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])[: len(hi)])
    out = np.zeros(len(first), _RECORD)
    out["hi"], out["lo"] = hi[first], lo[first]
    out["n"] = np.add.reduceat(n, first) if len(first) else 0
    return out


def keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of every place where a phrase of two words starts. ids: 0 is a break."""
    x = np.concatenate([ids, np.zeros(2, ids.dtype)]).astype(np.uint64)
    at = np.flatnonzero((x[:-2] > 0) & (x[1:-1] > 0))
    a, b, c = x[at], x[at + 1], x[at + 2]
    return a << _HALF | b >> _HALF, (b & _LOW) << _ID | c


def words_of(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hi, lo = records["hi"], records["lo"]
    return hi >> _HALF, (hi & _LOW) << _HALF | lo >> _ID, lo & np.uint64((1 << 40) - 1)


def _block_keys(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """The distinct keys of a block's row, counted."""
    codes = np.frombuffer(batch.column("codes")[k].as_py(), "<i4")
    place, number = (np.array(batch.column(x)[k].values) for x in ("place", "number"))
    ids = np.zeros(int(max(codes.max(initial=1), place.max(initial=0) + 2)) + 1, np.int64)
    ids[place + 2] = number
    hi, lo = keys(ids[codes])
    return counted(hi, lo, np.ones(len(hi), np.int64))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            got = _block_keys(batch, k)
            got = got[np.linspace(0, len(got) - 1, min(SAMPLE, len(got))).astype(int)]
            yield pa.RecordBatch.from_arrays([pa.array(got["hi"].astype(np.int64)), pa.array(got["lo"].astype(np.int64))], ["hi", "lo"])


def bucket_of(borders: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The number of borders (hi, lo) that are at most each key; both are ascending, so each border is found in the keys."""
    left, right = np.searchsorted(hi, borders["hi"], "left"), np.searchsorted(hi, borders["hi"], "right")
    cut = np.array([a + np.searchsorted(lo[a:b], x) for a, b, x in zip(left, right, borders["lo"], strict=True)], np.int64)
    return np.searchsorted(cut, np.arange(len(hi)), side="right")


def _dealt(borders: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = _block_keys(batch, k)
                buckets, payload = common.dealt(got, bucket_of(borders, got["hi"], got["lo"]))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(payload, pa.binary())], ["bucket", "records"])
        common.trim()

    return run


def _summed(least: int):
    """A bucket's phrases: of three words with a count of at least `least`; of two words the same, but the first and the
    last of the bucket always, as other buckets can have more of them."""

    def run(table: pa.Table) -> pa.Table:
        got = common.gathered(table.column("records"), _RECORD)
        got = counted(got["hi"], got["lo"], got["n"])
        a, b, c = words_of(got)
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        two = np.add.reduceat(got["n"], first)
        keep = np.flatnonzero((two >= least) | (np.arange(len(two)) % max(1, len(two) - 1) == 0))
        three = np.flatnonzero((c > 0) & (got["n"] >= least))
        columns = [np.concatenate(x) for x in ([a[first[keep]], a[three]], [b[first[keep]], b[three]], [np.zeros(len(keep), np.uint64), c[three]], [two[keep], got["n"][three]])]
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], ["a", "b", "c", "f"])

    return run


def dictionary(blocks: DataFrame, least: int, words_each: int = 1 << 16) -> DataFrame:
    """lang, word, f, id of the words with f >= least. A word's number is made of its hash bucket and its place there."""
    one = blocks.select("lang", F.explode(F.arrays_zip("words", "freq")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.freq").alias("f"))
    frequent = common.staged(one.filter(F.col("f") >= least), "frequent")
    many = common.buckets(frequent, words_each * 16)
    own = Window.partitionBy("slot").orderBy("lang", "word")
    placed = frequent.withColumn("slot", F.pmod(F.xxhash64("lang", "word"), F.lit(many))).withColumn("id", (F.row_number().over(own) - 1).cast("long") * many + F.col("slot") + 1)
    return common.staged(placed.select("lang", "word", "f", "id"), "dictionary")


def counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals: lang, n; dictionary: lang, word, f, id; phrases: a, b, c, f with c = 0 for two words), all staged. Only
    words and phrases with a count of at least `least`."""
    rows = common.small_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = common.input_bytes(rows)
    blocks = rows.mapInArrow(_encoded, "block long, lang string, words array<string>, freq array<long>, codes binary")
    blocks = common.staged(blocks, "blocks")
    words = dictionary(blocks, least)
    total = common.staged(blocks.select("lang", F.aggregate("freq", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    used = blocks.select("block", "lang", F.posexplode("words").alias("place", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    used = used.groupBy("block", "lang").agg(F.collect_list(F.struct("place", "id")).alias("used")).select("block", "lang", F.col("used.place").alias("place"), F.col("used.id").alias("number"))
    numbered = common.staged(blocks.select("block", "lang", "codes").join(used, ["block", "lang"]).select("block", "codes", "place", "number"), "numbered")
    some = [r[0] for r in numbered.select("block").distinct().orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()]
    sample = np.array([tuple(r) for r in numbered.filter(F.col("block").isin(some)).mapInArrow(_sampled, "hi long, lo long").collect()], [("hi", "<u8"), ("lo", "<u8")])
    many = int(min(1 << 20, max(8, -(-size // (1 << 20)))))
    sample.sort()
    borders = np.unique(sample[(np.arange(1, many) * len(sample)) // many]) if len(sample) else sample
    dealt = numbered.mapInArrow(_dealt(borders), "bucket long, records binary")
    partial = dealt.groupBy("bucket").applyInArrow(_summed(least), "a long, b long, c long, f long")
    return total, words, common.staged(partial.groupBy("a", "b", "c").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, keep: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: phrases of two and three words with a count a >= least, by score
    (floor(1000000 a a / (l r)) of the cut that scores least), then a, then phrase; the first `keep` of each language, all
    if None. A phrase goes if a longer one that holds it has at least `share` percent of its count. Counts up to 10^15
    are exact."""
    total, words, phrases = counts(docs, text_col=text_col, lang_col=lang_col, least=least)
    one = words.select(F.col("id").alias("w"), F.col("f").alias("f1"))
    two = phrases.filter("c = 0").select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("f").alias("f2"))
    three = phrases.filter("c > 0")
    pair = lambda x, y: three.select(F.col(x).alias("a"), F.col(y).alias("b"), F.col("f").alias("longer"))
    inside = pair("a", "b").unionAll(pair("b", "c")).groupBy("a", "b").agg(F.max("longer").alias("longer"))
    two_kept = phrases.filter("c = 0").join(inside, ["a", "b"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("f") * share, F.lit(True))).drop("longer")

    def of(df: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(one.withColumnRenamed("f1", name), F.col(word) == F.col("w")).drop("w")

    def of_two(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
        return df.join(two.withColumnRenamed("f2", name), (F.col(x) == F.col("p")) & (F.col(y) == F.col("q"))).drop("p", "q")

    cut = lambda k, x, y: F.struct((F.expr(f"(1000000 * (cast(f as decimal(16,0)) * cast(f as decimal(16,0)))) div (cast({x} as decimal(19,0)) * cast({y} as decimal(19,0)))")).alias("score"), F.lit(k).alias("cut"), F.col(x).alias("l"), F.col(y).alias("r"))
    best2 = of(of(two_kept, "a", "fa"), "b", "fb").select("a", "b", "c", "f", cut(1, "fa", "fb").alias("best"))
    best3 = of_two(of_two(of(of(three, "a", "fa"), "c", "fc"), "a", "b", "fab"), "b", "c", "fbc").select("a", "b", "c", "f", F.least(cut(1, "fa", "fbc"), cut(2, "fab", "fc")).alias("best"))
    named = best2.unionAll(best3)
    for x in ("a", "b", "c"):  # a word after another, as text
        text = words.select(F.col("id").alias(x), F.col("word").alias(f"w{x}"), *(["lang"] if x == "a" else []))
        named = named.join(text, x, "left" if x == "c" else "inner")
    phrase = F.concat_ws(" ", "wa", "wb", "wc")
    ranked = named.select("lang", phrase.alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "best.score", "best.cut")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if keep is not None:  # first within salted parts of a language, each round in fewer of them
        parts = common.buckets(phrases, 1 << 20)
        while parts > 1:
            salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
            own = Window.partitionBy("lang", salt).orderBy(*order)
            ranked = ranked.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= keep)
            parts //= 64
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.filter(F.col("rank") <= keep) if keep is not None else ranked
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))
