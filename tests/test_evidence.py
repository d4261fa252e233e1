"""Packets, eligibility, worlds and commits against plain versions."""

from __future__ import annotations

import random

import pytest
from evigrid.operators import retrieval, sets, splitting
from evigrid.streaming import jobs
from pyspark.sql import functions as F

PIECES = ["온실가스", "감축", "2030년", "10%", "색인", "auditor", "sampling", "배출량은", "합니다", "MCM 검토", "1,234", "톤", "energy", "target", "시스템 도입", "12030", "x", "GRI 1"]


def test_eligibility_as_an_expression_equals_the_fold(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 5))), rng.choice(["paragraph", "table_cell"]), rng.sample(["온실가스", "2024년", "kg", "x"], rng.randint(0, 3)) if rng.random() < 0.5 else []) for _ in range(1500)]
    rows += [(t, "table_cell", c) for t in ("1,234", "12 톤", "-5", "1,234 x") for c in ([], ["온실가스 2024년", "톤"], ["온실가스"])]
    g = splitting.Grammar()
    df = spark.createDataFrame(rows, "t string, k string, c array<string>")
    got = [r[0] for r in df.select(splitting.selectable_text(F.col("t"), F.col("k"), F.col("c"))).collect()]
    assert got == [splitting.selectable(g, *r) for r in rows] and 0.1 < sum(got) / len(got) < 0.9


def test_worlds_of_unknown_facts(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, []), (3, None)], "k int, u array<string>")
    got = sorted((r["k"], r["world"], tuple(sorted((r["facts"] or {}).items()))) for r in sets.worlds(rows, "u").collect())
    assert got[:4] == [(1, w, (("a", bool(w & 1)), ("b", bool(w & 2)))) for w in range(4)] and (2, 0, ()) in got
    with pytest.raises(Exception, match="too many unknown facts"):
        sets.worlds(rows, "u", most=1).collect()


def test_packets_equal_a_plain_composition(spark):
    rng = random.Random(2)
    claims, fused, want = [], [], {}
    blocks = [(k, "t" if k % 9 else "u", f"h{k}", rng.randint(100, 2000), rng.randint(0, 200)) for k in range(40)]
    tables = [(k, k % 6) for k in range(40) if k % 4]
    elements = [("A", ["local_claim", "same_table"]), ("B", ["global_bound"])]
    by, root = {b[0]: b for b in blocks}, dict(tables)
    for c in range(60):
        own = rng.sample(range(40), rng.randint(1, 2))
        hits = {i: (round(rng.random(), 3), f"h{i}" if rng.random() < 0.9 else "old") for i in rng.sample(range(45), 9)}
        claims += [(c, i, n, c % 7 > 0, "t") for n, i in enumerate(own)]
        fused += [(c, i, s, h) for i, (s, h) in hits.items()]
        order = [*own, *sorted((i for i in hits if i not in own), key=lambda i: (-hits[i][0], i))][:8]
        used = count = 0
        out, bad = [], []
        for rank, i in enumerate(order, 1):
            told = hits.get(i, (0, by[i][2] if i in by else None))[1]
            if i not in by or by[i][1] != "t" or told != by[i][2]:
                bad.append(i)
                continue
            scope = "local_claim" if i in own else "same_table" if i in root and root[i] in {root[x] for x in own if x in root} else "global_bound"
            state = "omitted"
            for cost, name in ((by[i][3], "admitted"), (by[i][3] - by[i][4], "admitted_without_context")):
                if count < 8 and cost <= 1600 and used + cost <= 5000:
                    used, count, state = used + cost, count + 1, name
                    break
            out.append((rank, i, scope, ["B"] if scope == "global_bound" else ["A"], state))
        want[c] = (c % 7 == 0, out, sorted(bad))
    made = retrieval.packets(
        spark.createDataFrame(claims, "claim long, source_id long, place int, verified boolean, tenant string"), spark.createDataFrame(fused, "query_id long, id long, score double, hash string"), spark.createDataFrame(blocks, "source_id long, tenant string, text_hash string, tokens long, shared long"),
        spark.createDataFrame(tables, "source_id long, root int"), spark.createDataFrame(elements, "element string, scopes array<string>"), ["tenant"], k=8, total=5000,
    )
    got = {r["claim"]: (r["blocked"], [tuple(x) for x in r["candidates"]], r["rejected"]) for r in made.collect()}
    assert got == want


def test_a_commit_brings_its_next_job_and_event(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, "parse", 1, "old", 5), (1, 7, "parse", 2, "new", 6), (2, 7, "report", 1, "last", 6)], "job long, run long, kind string, token long, payload string, at long")
    for _ in range(2):  # a replayed batch changes nothing
        jobs.commit_with_next(rows, 3, str(tmp_path), {"parse": "extract"})
        got = sorted((r["job"], r["record"], r["kind"], r["payload"], r["token"]) for r in spark.read.parquet(str(tmp_path)).collect())
        assert got == [(1, "artifact", "parse", "new", 2), (1, "event", "committed:parse", "1", 2), (1, "job", "extract", None, 2), (2, "artifact", "report", "last", 1), (2, "event", "committed:report", "2", 1)]
