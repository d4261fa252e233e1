"""Tokeniser fertility, phrase mining and periodic runs against plain Python on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from evigrid.llm import common, fertility, periodic, phrases, queries
from hypothesis import given, settings
from hypothesis import strategies as st

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, id string, block string, f long, w string, group string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t", "a", "one two", "A,b;C d.e!f g?h:i", "x y z x y z", "tab\tand\x0bvt\x0cff\rcr", "\x1c\x1d a", "É é É é", "中文 " * 40, "😀 " * 30, "z" * 3000, "- - - -"]


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", "i", "b", 1, "w", "g") for k, t, lang in rows], DOCS)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- tokeniser fertility ---------------------------------------------------------------------------------------------


def base(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def plain_measures(text, model):
    tokens = [t for w in WORD.findall(text) for t in model.encode(w)]
    count = Counter(tokens)
    entropy = -sum(n / len(tokens) * math.log2(n / len(tokens)) for n in count.values())
    return sum(map(len, WORD.findall(text))) / len(tokens), sum(map(model.is_byte, tokens)) / len(tokens), entropy, len(tokens)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_columns_equal_plain_counts(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    got = queries.op11_fertility(spark, DATA).collect()
    assert len(got) == len(texts) and all(not (r["base_failed"] and r["kept"]) for r in got)
    for r in got:
        assert tuple(r[c] for c in NAMES) == base(texts[r["doc_id"]])


def test_base_columns_of_odd_texts(spark):
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate([*ODD, "a b c d e f g h " * 9, "line x\n" * 30 + "y\nline x"])]
    rows += [rows[-1], (None, "null id", None)]
    got = sorted((tuple(r[c] for c in ("doc_id", *NAMES)) for r in fertility.judge(table(spark, rows)).collect()), key=str)
    assert got == sorted([(k, *base(t)) for k, t, _ in rows], key=str)
    assert fertility.judge(table(spark, [])).count() == 0


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "LONG", 64)
    rng = random.Random(2)
    text = " ".join(rng.choice(["aa", "bb", "c\nd", "été"]) for _ in range(400))
    codes, doc = common.word_codes(np.frombuffer(text.encode() * 2, np.uint8), np.array([0, len(text.encode()), 2 * len(text.encode())]), common.WordIds())
    words = text.split()
    assert len(codes) == len((text + text).split()) + 1 and doc.tolist().count(0) == len(words)
    first = {}
    assert codes[: len(words)].tolist() == [first.setdefault(w, len(first)) for w in words]


def test_verdict_equals_plain_bands(spark):
    """The whole method again with plain loops: measures, quartiles of each group, bands."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents(spark).limit(120).collect()
    rng = random.Random(5)
    odd = [(10_000 + k, " ".join("".join(rng.choice("àéîõü€¥Ω日") for _ in range(6)) for _ in range(120)), "en") for k in range(3)]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs] + odd
    got = {r["doc_id"]: r for r in fertility.judge(table(spark, rows), vocabularies=("piece_bpe_32k.model",)).collect()}
    steps = {}
    for k, t, lang in rows:
        if not base(t)[-1]:
            *m, n = plain_measures(t, model)
            assert np.allclose([got[k][x] for x in fertility.MEASURES], m)
            steps[k] = (lang, n.bit_length(), [math.floor(x * s + 0.5) for x, (s, _) in zip(m, fertility.MEASURES.values(), strict=True)])
    for k, (lang, size, own) in steps.items():
        out = []
        for i, (name, (s, least)) in enumerate(fertility.MEASURES.items()):
            every = sorted(x[2][i] for x in steps.values() if x[:2] == (lang, size))
            q1, q3 = every[-(-len(every) // 4) - 1], every[-(-3 * len(every) // 4) - 1]
            reach = max(int(s * least), math.ceil(3 * (q3 - q1)))
            if not q1 - reach <= own[i] <= q3 + reach:
                out.append(name)
        assert got[k]["rejected_by"] == out and got[k]["kept"] == (not out)
    assert not any(got[k]["kept"] for k, _, _ in odd)


def test_a_group_of_copies_rejects_no_clean_text(spark):
    clean = [r["text"] for r in documents(spark).filter("lang = 'en'").collect()]
    clean = [t for t in clean if 100 < len(WORD.findall(t)) and not base(t)[-1] and "$$$" not in t][:20]
    rows = [(k, clean[0], None) for k in range(60)] + [(100 + k, t, None) for k, t in enumerate(clean)]
    got = fertility.judge(table(spark, rows)).collect()
    assert all(r["kept"] and r["group"] == "script:Latin" for r in got)


# --- phrases ---------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least=10, share=50, keep=2000):
    f, n = {}, Counter()
    for _, text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(x) > len(p) and any(x[i : i + len(p)] == p for i in range(len(x))) and 100 * cands[x] >= share * a for x in cands):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:keep])]
    return sorted(out)


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in phrases.mine(table(spark, rows), **more).drop("cut").collect())


def test_phrases_equal_plain_counts(spark, monkeypatch):
    rng = random.Random(7)
    words = ["the", "The", "of", "a", "é", "x,y", "b.", "\tq", "z\n", "rare", "\x01c", "ab", "a-b"]
    rows = [(k, " ".join(rng.choice(words[: rng.randint(3, 13)]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for k in range(60)]
    rows += [(k, t, "en") for k, t in enumerate(ODD)] + [(5, "New York City " * 15, "en"), (5, "New York City " * 15, "en")]
    want = plain_phrases(rows)
    assert len(want) > 40 and mined(spark, rows) == want
    assert mined(spark, rows, keep=7) == plain_phrases(rows, keep=7)
    assert mined(spark, rows, least=3, share=80) == plain_phrases(rows, least=3, share=80)
    monkeypatch.setattr(common, "LONG", 20)  # texts in parts, one text longer than that
    assert mined(spark, [(1, " ".join(x[1] or "" for x in rows), "en")]) == plain_phrases([(1, " ".join(x[1] or "" for x in rows), "en")])


def test_phrases_of_nothing_and_of_a_hot_pair(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, None, None), (2, "a b", "en")]) == []
    rows = [(k, f"hot pair w{k % 90}, hot pair hot pair", "en" if k % 3 else "xx") for k in range(400)]
    assert mined(spark, rows) == plain_phrases(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**60 - 1), st.integers(0, 3), st.integers(1, 9)), max_size=200), st.integers(0, 6))
def test_radix_counts_and_borders(records, cuts):
    hi, lo, n = (np.array([r[k] for r in records], t) for k, t in ((0, np.uint64), (1, np.uint64), (2, np.int64)))
    want = Counter()
    for a, b, c in records:
        want[a, b] += c
    got = phrases.counted(hi, lo, n)
    assert [((int(a), int(b)), int(c)) for a, b, c in got] == sorted(want.items())
    borders = got[:: cuts + 1][["hi", "lo"]] if len(got) else np.zeros(0, [("hi", "<u8"), ("lo", "<u8")])
    keys = [(int(a), int(b)) for a, b, _ in got]
    assert phrases.bucket_of(borders, got["hi"], got["lo"]).tolist() == [sum((int(x["hi"]), int(x["lo"])) <= key for x in borders) for key in keys]


def test_keys_hold_three_numbers_of_five_bytes():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 40, 500)
    ids[rng.integers(0, 500, 60)] = 0
    hi, lo = phrases.keys(ids)
    got = np.zeros(len(hi), phrases._RECORD)
    got["hi"], got["lo"] = hi, lo
    a, b, c = phrases.words_of(got)
    x = [*ids.tolist(), 0, 0]
    assert list(zip(a.tolist(), b.tolist(), c.tolist(), strict=True)) == [(x[i], x[i + 1], x[i + 2]) for i in range(500) if x[i] and x[i + 1]]


# --- periodic runs ---------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
            i = j
    return sorted(out)


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_all_documents_equal_plain_search(spark):
    docs = documents(spark).collect()
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect())
    want = sorted(plain_digest(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 15_000)
    long = {r["doc_id"] for r in docs if len(r["text"] or "") >= 15_000}
    assert [r for r in got if r[0] not in long] == want and len(got) == len(docs)
    assert sum(r[1] > 0 for r in want) > 5


def test_runs_of_odd_texts(spark, tmp_path):
    rows = [(k, t, "en") for k, t in enumerate([*ODD, "a " * 50, "a b " * 6, "a b c " * 4 + "a", "x y z " * 3])]
    rows += [rows[-1], (None, "a " * 20, "en")]
    table(spark, rows).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_digest(k, t) for k, t, _ in rows), key=str)
    assert periodic.find_runs(table(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 260), st.sampled_from([1, 2, 3, 40]), st.integers(0, 3))
def test_runs_equal_plain_search(seed, n, letters, planted):
    rng = random.Random(seed)
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(planted if n > 20 else 0):
        a = rng.randrange(n)
        p, e = rng.randint(1, max(1, n // 3)), rng.randint(a, n)
        for i in range(a, e):
            words[i] = words[a + (i - a) % p]
    assert [tuple(x) for x in periodic.runs(np.array(words, np.int64)).tolist()] == plain_runs(words)


@pytest.mark.parametrize("words, n_runs", [([0] * 300_000, 1), ([0, 1, 2] * 100_000, 1), (list(range(60_000)) * 5, 1)])
def test_long_texts_of_one_run(words, n_runs):
    got = periodic.runs(np.array(words, np.int64))
    assert len(got) == n_runs and got[0][0] == 0 and got[0][1] == len(words)
