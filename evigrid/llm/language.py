"""Language ID by cross-parsing entropy.

The labelled text of each language becomes a suffix automaton. A document is parsed greedily into the longest phrases
that occur in that text. A phrase is told by its place in the reference, so it costs the logarithm of the reference's
length; the language with the least sum of these costs wins. References may thus differ in length: one short labelled
text makes a weak language, but leaves the others as they are. Parsing runs in step over many blocks of many documents:
one table lookup per symbol and language for all blocks at once.

Texts are lower-cased; every run of characters other than letters is one space. The most frequent letters of all
references are one symbol each; every other letter of a reference is spelt with the same number of digit symbols, so any
alphabet is matched, at a table width of SYMBOLS. Letters that no reference has match nothing. Blocks of BLOCK symbols
are parsed separately (which adds at most one phrase a block, for every language alike); the whole text is parsed.

Defined results: a null text, or one without a letter, is `und` with score 0; references without a letter are ignored;
ties go to the smaller language name; without any labelled row every text is `und`; repeated rows are judged each; extra
columns are dropped.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import crc_of

BLOCK = 512
#: Symbols: 0 is the space, 1 to LETTERS the most frequent letters, then DIGITS that spell the others, and one for letters
#: of no reference.
SYMBOLS, LETTERS, DIGITS = 64, 50, 12
#: Symbols of all references together, so that their tables stay below some 200 MB for any number of languages.
TOTAL_SYMBOLS = 480_000
_LOWER = np.arange(65536, dtype=np.uint32)
_LETTER = np.zeros(65536, bool)
for _c in range(65536):
    if not 0xD800 <= _c < 0xE000:
        _t = chr(_c).lower()
        _LETTER[_c] = chr(_c).isalpha()
        if len(_t) == 1 and ord(_t) < 65536:
            _LOWER[_c] = ord(_t)


def code_points(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 texts."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return points, heads[ends].astype(np.int64)


def letters_only(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters, and 32 for each run of anything else; offsets follow. Letters beyond the BMP stay."""
    high = points >= 65536
    low = np.where(high, 32, points)
    letter = _LETTER[low]
    if high.any():
        letter |= high & np.isin(points, [c for c in np.unique(points[high]).tolist() if chr(c).isalpha()])
    out = np.where(letter, np.where(high, points, _LOWER[low]), np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if len(keep):
        keep[ends[:-1][ends[:-1] < len(keep)]] |= True
    kept = np.zeros(len(keep) + 1, np.int32)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[ends].astype(np.int64)


class SuffixAutomaton:
    """Transitions of the minimal automaton of all substrings of one symbol sequence."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in symbols:
            new = len(self.next)
            self.next.append({})
            size.append(size[last] + 1)
            link.append(0)
            at = last
            while at != -1 and c not in self.next[at]:
                self.next[at][c] = new
                at = link[at]
            if at != -1:
                to = self.next[at][c]
                if size[to] == size[at] + 1:
                    link[new] = to
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[to]))
                    size.append(size[at] + 1)
                    link.append(link[to])
                    while at != -1 and self.next[at].get(c) == to:
                        self.next[at][c] = twin
                        at = link[at]
                    link[to] = link[new] = twin
            last = new

    def table(self) -> np.ndarray:
        """Flat int32 table: entry [state * SYMBOLS + symbol] is next state * SYMBOLS * 2, plus 1 where the phrase ends
        before the symbol and a new one starts with it."""
        root = np.ones(SYMBOLS, np.int32)  # a symbol that never occurs is a phrase of its own
        for c, to in self.next[0].items():
            root[c] = to * SYMBOLS * 2 + 1
        out = np.tile(root, (len(self.next), 1))
        for at, go in enumerate(self.next):
            if at:
                for c, to in go.items():
                    out[at, c] = to * SYMBOLS * 2
        return out.reshape(-1)


class Languages:
    def __init__(self, reference: dict[str, str], reference_chars: int = 24_000):
        """reference: language -> text. Each is cut to reference_chars symbols, fewer where there are very many languages."""
        clean = {}
        for name, text in reference.items():
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            points = letters_only(*code_points(raw, np.array([0, len(raw)])))[0]
            if (points != 32).any():
                clean[name] = points
        self.names = sorted(clean)
        most = min(reference_chars, TOTAL_SYMBOLS // max(1, len(clean)))
        by_count = [c for c, _ in Counter(np.concatenate([*(x[:most] for x in clean.values()), np.zeros(0, np.uint32)]).tolist()).most_common() if c != 32]
        self.spelt = np.array(sorted(by_count[LETTERS:]), np.uint32)
        self.digits = 1
        while DIGITS**self.digits < len(self.spelt):
            self.digits += 1
        self.symbol = np.full(65536, SYMBOLS - 1, np.uint8)
        self.symbol[32] = 0
        self.frequent = np.array(by_count[:LETTERS], np.uint32)
        low = self.frequent < 65536
        self.symbol[self.frequent[low]] = np.flatnonzero(low) + 1
        self.rank = np.full(65536, -1, np.int32)
        bmp = self.spelt < 65536
        self.rank[self.spelt[bmp]] = np.flatnonzero(bmp)
        coded = {name: self.symbols(x[:most], np.array([0, min(most, len(x))]))[0][:most] for name, x in clean.items()}
        self.cost = np.log2([max(2, len(coded[name])) for name in self.names])
        self.tables = [SuffixAutomaton(coded[name].tolist()).table() for name in self.names]

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, offsets) of texts of letters."""
        high = points >= 65536
        low = np.where(high, np.uint32(0xFFFF), points)
        out, at = self.symbol[low], self.rank[low]
        if high.any():
            for k in np.flatnonzero(self.frequent >= 65536).tolist():
                out[points == self.frequent[k]] = k + 1
            if len(self.spelt):
                own = np.minimum(np.searchsorted(self.spelt, points[high]), len(self.spelt) - 1)
                at[high] = np.where(self.spelt[own] == points[high], own, -1)
        spelt = np.flatnonzero(at >= 0)
        if not len(spelt):
            return out, ends
        width = np.ones(len(points), np.int64)
        width[spelt] = self.digits
        begin = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(out, width)
        rest = at[spelt]
        for k in range(self.digits):
            out[begin[spelt] + k] = LETTERS + 1 + rest % DIGITS
            rest = rest // DIGITS
        return out, begin[ends]

    def phrases(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases [document, language], symbols per document, has a letter). A very long text is parsed part by part."""
        if len(ends) != 2 or len(raw) <= common.LONG:
            return self._phrases(raw, ends)
        every = [self._phrases(raw[a:b], np.array([0, b - a])) for a, b in common.parts(raw, False)]
        return sum(x[0] for x in every), sum(x[1] for x in every), np.logical_or.reduce([x[2] for x in every])

    def _phrases(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, at = letters_only(*code_points(raw, ends))
        docs = len(at) - 1
        has = np.bincount(np.repeat(np.arange(docs), np.diff(at)), points != 32, docs) > 0
        sym, at = self.symbols(points, at)
        size = np.diff(at)
        per = -(-size // BLOCK)
        doc = np.repeat(np.arange(docs), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = at[:-1][doc] + nth * BLOCK
        left = np.minimum(BLOCK, at[1:][doc] - start)
        order = np.argsort(-left, kind="stable")
        start, left, doc = start[order], left[order], doc[order]
        active = [int(np.searchsorted(-left, -t, side="left")) for t in range(int(left[0]) if len(left) else 0)]
        columns = [sym[start[:n] + t].astype(np.int32) for t, n in enumerate(active)]
        out = np.zeros((docs, len(self.names)))
        for k, table in enumerate(self.tables):
            state, count = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
            for n, column in zip(active, columns, strict=True):
                got = table.take(state[:n] + column)
                count[:n] += got & 1
                state[:n] = got >> 1
            out[:, k] = np.bincount(doc, count, docs)
        return out, size, has


def reference_texts(docs: DataFrame, *, sample_rows: int = 400, reference_chars: int = 24_000, languages: int = 256) -> dict[str, str]:
    """Labelled text per language: the bounded sample that the languages are fitted on. At most sample_rows documents and
    about reference_chars characters of each of the `languages` most frequent labels. docs: id, text, lang, without the
    held-out rows. Rows are chosen by a hash of their id."""
    count = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not count:
        return {}
    share = F.create_map([F.lit(x) for name, n in count.items() for x in (name, min(1.0, sample_rows / n))])
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1 << 30))
    picked = docs.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")] * (1 << 30)).select("lang", "draw", F.left("text", F.lit(reference_chars)).alias("text"))
    out: dict[str, list[str]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        texts = out.setdefault(row["lang"], [])
        if sum(map(len, texts)) < reference_chars and row["text"] not in texts:
            texts.append(row["text"])
    return {name: unicodedata.normalize("NFC", "\n".join(texts)) for name, texts in out.items()}


def _identify(languages: Languages) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*languages.names, "und"], pa.string())
        for batch in common.slices(batches, "text"):
            phrases, size, has = languages.phrases(*common.text_bytes(batch.column("text")))
            n = len(languages.names)
            if not n:
                best, score, rate = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                has = np.zeros(batch.num_rows, bool)
            else:
                bits = phrases * languages.cost
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                second = np.partition(bits, 1, axis=1)[:, 1] if n > 1 else least * 2
                score = np.where(has, second / np.maximum(least + second, 1e-9), 0.0)
                rate = phrases[np.arange(len(best)), best] / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), names.take(pa.array(np.where(has, best, n))), pa.array(score.astype(float)), pa.array(rate.astype(float))], ["id", "lang_pred", "score", "phrase_rate"])

    return run


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 400, reference_chars: int = 24_000) -> DataFrame:
    """Per document: id, held_out (crc32 of the id as text, modulo 4, is 2; such rows are never learnt from), lang_pred,
    score (the second least cost over the sum of the two least: 0.5 is a tie, towards 1 is clear) and phrase_rate
    (phrases per symbol in the winning language)."""
    out = judged(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_rows=sample_rows, reference_chars=reference_chars, keep=(id_col,))
    held = F.coalesce(crc_of(id_col) % 4 == 2, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score", "phrase_rate")


def judged(docs: DataFrame, *, keep: Sequence[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 400, reference_chars: int = 24_000) -> DataFrame:
    """The columns `keep` of each document with lang_pred, score and phrase_rate; the languages are learnt as in identify()."""
    rows = common.small_batches(docs).select(F.struct(*keep).alias("id"), F.col(text_col).alias("text"))
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter((crc_of("id") % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = Languages(reference_texts(labelled, sample_rows=sample_rows, reference_chars=reference_chars), reference_chars)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_identify(languages), f"id {kind}, lang_pred string, score double, phrase_rate double")
    return out.select(*[F.col("id")[c].alias(c) for c in keep], "lang_pred", "score", "phrase_rate")
