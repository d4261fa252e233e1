"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And) over canonical URLs.

Every glob is a run of bits: bit k stands for "k tokens of the glob are matched". Literals and `?` move a bit up by
one, `*` keeps its bit alive on any byte. All globs are packed side by side into 64-bit words and step together, and
the URLs of an Arrow batch step together too, so the cost is bytes x words whatever the number of rules.

Defined results: a null URL, or one without `://`, has empty host and path and matches no rule; an empty path matches
no rule (a rule's path starts with `/`); repeated rows give repeated rows; an empty table gives an empty result; other
columns of the input are dropped, so their names cannot clash; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Between host and path in the canonical form; cannot be part of a rule.
SEP = "\x01"
ANY, STAR = -1, -2


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract, as (verdict, host, path).
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def glob_tokens(glob: str) -> list[int]:
    """A glob's tokens: byte values, ANY for `?`, STAR for `*`; a backslash makes the next character literal."""
    out: list[int] = []
    at = 0
    while at < len(glob):
        c = glob[at]
        if c == "\\" and at + 1 < len(glob):
            at += 1
            out += list(glob[at].encode())
        elif c in "*?":
            out.append(STAR if c == "*" else ANY)
        else:
            out += list(c.encode())
        at += 1
    return out


class ShiftAnd:
    """All globs in one multiword automaton; match() runs it over many strings in step."""

    def __init__(self, globs: Sequence[str]):
        runs = []
        width = 0
        for glob in globs:
            tokens = glob_tokens(glob)
            runs.append((width, tokens))
            width += 1 + sum(t != STAR for t in tokens)
        self.words = max(1, -(-width // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = np.zeros(len(globs), np.int64)

        def put(row: np.ndarray, bit: int) -> None:
            row[bit // 64] |= np.uint64(1 << (bit % 64))

        for k, (bit, tokens) in enumerate(runs):
            put(self.start, bit)
            for t in tokens:
                if t == STAR:
                    put(self.stay, bit)
                    continue
                bit += 1
                for c in range(256) if t == ANY else (t,):
                    put(self.step[c], bit)
            self.final[k] = bit

    def match(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Booleans [string, glob]: does the glob match the whole string? Longest strings come first, so that the
        strings still running are always a leading slice."""
        size = np.diff(ends)
        order = np.argsort(-size, kind="stable")
        start, left = ends[:-1][order], size[order]
        state = np.broadcast_to(self.start, (len(order), self.words)).copy()
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -t, side="left"))  # strings longer than t
            now = state[:n]
            up = now << one
            up[:, 1:] |= now[:, :-1] >> top
            state[:n] = (up & self.step[raw[start[:n] + t]]) | (now & self.stay)
        out = np.zeros((len(order), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(rule: Rule) -> tuple[str, str]:
    """A rule as globs over host + SEP + path: the host itself, and any of its subdomains."""
    tail = f"{escape(rule.host)}{SEP}{escape(rule.path)}*"
    return tail, f"*.{tail}"


def matcher(rules: Sequence[Rule], globs: Sequence[tuple[str, str]], default: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    every = [g for r in rules for g in rule_globs(r)] + [g for g, _ in globs]
    ranked = sorted(range(len(rules)), key=lambda k: (len(rules[k].name), -k))  # later ones win

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(every)
        names = pa.array([r.name for r in rules] + [None], pa.string())
        verdicts = pa.array([r.verdict for r in rules] + [v for _, v in globs] + [default], pa.string())
        for batch in common.slices(batches, "canonical"):
            hit = automaton.match(*common.text_bytes(batch.column("canonical")))
            rule = np.full(batch.num_rows, len(rules))
            for k in ranked:
                rule[hit[:, 2 * k] | hit[:, 2 * k + 1]] = k
            verdict = np.full(batch.num_rows, len(rules) + len(globs))
            for k in reversed(range(len(globs))):
                verdict[hit[:, 2 * len(rules) + k]] = len(rules) + k
            verdict = np.where(rule < len(rules), rule, verdict)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), names.take(pa.array(rule)), pc.take(verdicts, pa.array(verdict))], ["id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(df: DataFrame, rules: Sequence[Rule] = RULES, *, globs: Sequence[tuple[str, str]] = (), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, the longest fitting rule (or null) and the verdict.

    rules: by host (and all its subdomains) and path prefix; the longest `host + path` wins, the earlier of equals.
    globs: (glob, verdict) over the canonical `host + SEP + path`, for URLs that no rule fits; the first match counts.
    default: the verdict where nothing matches.
    """
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    canonical = (
        df.select(F.col(id_col).alias("id"), F.coalesce(rest, F.lit("")).alias("rest"))
        .select("id", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), upper, lower).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        .withColumn("canonical", F.concat("host", F.lit(SEP), "path"))
    )
    kind = df.schema[id_col].dataType.simpleString()
    out = canonical.mapInArrow(matcher(tuple(rules), tuple(globs), default), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
