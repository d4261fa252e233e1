"""Quality rules by tokeniser fertility.

Simple counts of words, symbols, repeated lines and repeated windows fail a text first (the base rules). Of the others,
public vocabularies tell how well a text looks like the text they were made for: characters per token, the share of
tokens that are bytes spelt out, and the entropy of the tokens. Each is compared with the texts of the same language
(where it is not given: of the same script) and of a like number of tokens: a text outside the band
[q1 - reach, q3 + reach] is rejected, where q1 and q3 are the exact quartiles over all texts of that group that pass the
base rules, and reach is the larger of `spread` times (q3 - q1) and a least width. The least width keeps a group whose
quartiles coincide, such as one that is mostly copies of one text, from rejecting everything else.

Every word is tokenised by itself, once in each slice of the input that holds it. Quartiles come from a histogram of the
measures in fixed steps, so a group of any size is a few thousand counts; no text is shuffled.

Defined results: a null text has no words, and fails the base rules like every text of fewer than `least_words` words; a
text without a language is in the group of its most frequent script (`script:none` without a letter); a group of one text
rejects nothing; repeated rows are judged each; an empty table has an empty result; extra columns are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .language import code_points

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: The measures, the steps in a unit of each, and the least reach of a band beyond its quartiles, in units.
MEASURES = {"chars_per_token": (100, 1.0), "fallback_share": (1000, 0.05), "entropy": (100, 1.0)}
#: Characters counted as symbols, and first code points of stretches of one script.
SYMBOLS = b"#*$%&|<>"
SCRIPTS = [
    (0x0, "none"), (0x41, "Latin"), (0x5B, "none"), (0x61, "Latin"), (0x7B, "none"), (0xC0, "Latin"), (0x250, "none"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"),
    (0x600, "Arabic"), (0x780, "none"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "none"), (0xB80, "Tamil"), (0xC00, "none"), (0xE00, "Thai"), (0xE80, "none"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "none"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "none"), (0x3040, "Kana"), (0x3100, "none"), (0x3400, "Han"), (0xA000, "none"), (0xAC00, "Hangul"), (0xD7A4, "none"), (0x20000, "Han"), (0x32000, "none"),
]
_WINDOW = 8


class Vocabulary:
    """Token ids of single words, and which ids spell a byte. Names that end in .model are read by sentencepiece, others
    as ranks of byte sequences."""

    def __init__(self, name: str):
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
            self.encode: Callable[[list[str]], list[list[int]]] = lambda words: model.encode(words, num_threads=1)
            self.is_byte = np.array([model.is_byte(k) for k in range(model.get_piece_size())])
        else:
            import tiktoken

            with open(public_tokenizers.path(name), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: list(map(coder.encode_ordinary, [" " + w for w in words]))
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.is_byte[[k for x, k in ranks.items() if len(x) == 1 and x[0] >= 128]] = True


def measures(vocabularies: Sequence[Vocabulary], words: list[bytes], codes: np.ndarray, doc: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each document over all vocabularies, [document, measure]: the means over the vocabularies).
    words: the distinct words; codes: a word for each place in the texts; doc: the document of each place."""
    n, texts = len(chars), [w.decode("utf-8", "replace") for w in words]
    tokens, out = np.zeros(n, np.int64), np.zeros((n, 3))
    for v in vocabularies:
        ids = v.encode(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((k for x in ids for k in x), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        per = size[codes]
        at = np.repeat(begin[codes] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        token, owner = flat[at], np.repeat(doc, per)
        many = np.bincount(owner, minlength=n)
        pairs, count = np.unique(owner * len(v.is_byte) + token, return_counts=True)
        total = np.maximum(many, 1)
        share = count / total[pairs // len(v.is_byte)]
        out[:, 0] += chars / total
        out[:, 1] += np.bincount(owner, v.is_byte[token], n) / total
        out[:, 2] -= np.bincount(pairs // len(v.is_byte), share * np.log2(share), n)
        tokens += many
    return tokens, out / max(1, len(vocabularies))


def repeated_words(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: words in 8-word windows that occur twice or more in it. Windows are told apart exactly: by numbers
    for pairs, pairs of pairs and so on."""
    if len(codes) < _WINDOW:
        return np.zeros(n, np.int64)
    step, window = 1, codes.astype(np.int64)
    while step < _WINDOW:
        window = np.unique(window[:-step] * (int(window.max()) + 1) + window[step:], return_inverse=True)[1].reshape(-1)
        step *= 2
    inside = np.flatnonzero(doc[: len(window)] == doc[_WINDOW - 1 :])
    _, which, times = np.unique(doc[inside] * (int(window.max()) + 1) + window[inside], return_inverse=True, return_counts=True)
    again = inside[times[which.reshape(-1)] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + _WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)


def scripts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The most frequent script of each text."""
    points, at = code_points(raw, ends)
    names = sorted({s for _, s in SCRIPTS} - {"none"})
    kinds = np.array([names.index(s) + 1 if s != "none" else 0 for _, s in SCRIPTS])
    n, kind = len(at) - 1, kinds[np.searchsorted([a for a, _ in SCRIPTS], points, side="right") - 1]
    owner = np.repeat(np.arange(n), np.diff(at))
    count = np.bincount(owner * (len(names) + 1) + kind, minlength=n * (len(names) + 1)).reshape(n, -1)[:, 1:]
    return np.where(count.any(axis=1), np.array(names, object)[count.argmax(axis=1)], "none")


_TOKEN = np.zeros(256, bool)
_TOKEN[list(SYMBOLS)] = True


def _measured(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = [Vocabulary(x) for x in names]
        for batch in common.slices(batches, "text"):
            raw, ends = common.text_bytes(batch.column("text"))
            n, ids = batch.num_rows, common.WordIds()
            codes, doc = common.word_codes(raw, ends, ids)
            data = raw.tobytes()
            lines = [[x for x in data[a:b].split(b"\n") if x and not x.isspace()] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            letters = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80) & ~common.BLANK[raw])])[ends]
            symbols = np.concatenate([[0], np.cumsum(_TOKEN[raw])])[ends]
            chars = np.diff(letters)
            tokens, values = measures(vocabularies, list(ids), codes, doc, chars)
            group = np.array(batch.column("lang").to_pylist(), object)
            if (blank := np.equal(group, None)).any():
                group[blank] = ["script:" + x for x in scripts(raw, ends)[blank]]
            columns = [
                batch.column("id"), pa.array(np.bincount(doc, minlength=n)), pa.array(chars), pa.array(np.diff(symbols)), pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                pa.array(repeated_words(codes, doc, n)), pa.array(group, pa.string()), pa.array(tokens), *(pa.array(values[:, k]) for k in range(3)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "group", "n_tokens", *MEASURES])

    return run


def bands(passed: DataFrame, spread: float = 3.0) -> DataFrame:
    """group, size, measure, low, high in steps: from the quartiles of each group's histogram."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"s_{m}").alias("value"), F.lit(int(steps * least)).alias("least")) for m, (steps, least) in MEASURES.items()]))
    counted = passed.select("group", "size", one.alias("m")).groupBy("group", "size", "m.measure", "m.value", "m.least").agg(F.count("*").alias("n"))
    own = Window.partitionBy("group", "size", "measure")
    below = counted.withColumn("upto", F.sum("n").over(own.orderBy("value"))).withColumn("all", F.sum("n").over(own))
    q = below.groupBy("group", "size", "measure").agg(F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("value"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("value"))).alias("q3"), F.first("least").alias("least"))
    reach = F.greatest(F.col("least"), F.ceil((F.col("q3") - F.col("q1")) * F.lit(spread)))
    return q.select("group", "size", "measure", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabularies: Sequence[str] = VOCABULARIES, spread: float = 3.0, least_words: int = 20, most_repeated: int = 30,
) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than least_words
    words, or over most_repeated percent of the words in repeated windows), kept, the three measures, group, and
    rejected_by (the measures outside their band)."""
    rows = common.small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    seen = rows.mapInArrow(_measured(tuple(vocabularies)), f"id {kind}, {counts}, group string, n_tokens long, {', '.join(f'{m} double' for m in MEASURES)}")
    steps = [F.round(F.col(m) * s).cast("int").alias(f"s_{m}") for m, (s, _) in MEASURES.items()]
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    seen = common.staged(seen.select("*", *steps, F.length(F.bin("n_tokens")).alias("size"), failed.alias("base_failed")), "fertility")
    limits = bands(seen.filter("not base_failed"), spread).groupBy("group", "size").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("band"))
    limits = common.staged(limits, "bands")  # small and of known size, so it is sent to the rows and not they to it
    out = seen.join(limits, ["group", "size"], "left")
    outside = F.array_compact(F.array(*[F.when(~F.col(f"s_{m}").between(F.col("band")[m]["low"], F.col("band")[m]["high"]), F.lit(m)) for m in MEASURES]))
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(outside))
    names = [x.split()[0] for x in counts.split(", ")]
    return out.select(F.col("id").alias(id_col), *names, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), *MEASURES, "group", "rejected_by")
