"""Exact search, fill-in-middle and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsift.llm import infill, periodic, queries, topk
from panelsift.llm.common import read_table


# --- exact top-k ------------------------------------------------------------------


def nearest(rows, asks, k, scale=256.0):
    """Every row against every query, as integers of any size."""
    fit = []
    for key, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) and abs(scale * x) < 1e100 for x in v):
            fit.append((key, [int(np.floor(float(x) * scale)) for x in v]))
    out = []
    for i, (key, q) in enumerate(fit):
        if key is None or not asks(key):
            continue
        found = []
        for j, (other, v) in enumerate(fit):
            if i != j:
                score = sum(a * b for a, b in zip(q, v, strict=False))
                score = min(max(score, -(2**63)), 2**63 - 1)
                found.append((-score, other is None, other or 0, other))
        for rank, (score, _, _, other) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out.append((key, rank, other, -score))
    return sorted(out, key=repr)


def answered(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=repr)


SCHEMA = "vec_id bigint, embedding array<double>, score string, rank int, v int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, 2) for k, v in rows], SCHEMA)


@pytest.mark.parametrize("small", [False, True])
def test_search_agrees_with_brute_force(spark, monkeypatch, small):
    if small:  # many cells, several shards a cell, several blocks of queries
        monkeypatch.setattr(topk, "SHARD_BYTES", 8 * 6 * 30)
        monkeypatch.setattr(topk, "PIVOTS", 5)
        monkeypatch.setattr(topk, "LEAF", 4)
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # one vector on many rows
    rows += [(i, [0.5] * 6) for i in range(0, 30, 7)]  # repeated ids
    rows += [rows[0], rows[0], (None, [0.25] * 6), (None, [9.0] * 6)]
    rows += [(7, None), (14, [None] * 6), (21, [float("nan")] + [1.0] * 5), (28, [float("inf")] + [1.0] * 5)]
    rows += [(35, []), (42, [1.0, 2.0]), (49, [0.1] * 9)]
    want = nearest(rows, lambda x: x % 7 == 0, 5)
    assert answered(topk.top_k(table(spark, rows), F.col("vec_id") % 7 == 0)) == want


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1.0]), (2, [1e18, 3.0]), (3, [1e200, 1.0]), (4, [-0.0, 1e-9])]
    assert answered(topk.top_k(table(spark, rows), F.col("vec_id") % 2 == 0)) == nearest(rows, lambda x: x % 2 == 0, 5)
    one = [(0, [1.0])]
    assert answered(topk.top_k(table(spark, one), F.lit(True))) == []
    assert answered(topk.top_k(table(spark, []), F.lit(True))) == []
    assert answered(topk.top_k(table(spark, [(0, None)]), F.lit(True))) == []
    assert answered(topk.top_k(table(spark, [(0, [1.0]), (1, [2.0])]), F.lit(False))) == []


def test_bounds_prune_whole_shards():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 8)) * 1000
    rows = np.floor(np.concatenate([c + rnd.normal(size=(300, 8)) for c in centres]))
    tree = topk.BallTree(rows, np.arange(len(rows)))
    seen = 0
    plain = topk.scores

    def counting(block, q, exact):
        nonlocal seen
        seen += len(block)
        return plain(block, q, exact)

    topk.scores, kept = counting, topk.scores
    try:
        q = rows[17]
        best = tree.search(q, 5, None)
        first = seen
        assert [x[:2] for x in best] == sorted((-int(s), i) for i, s in enumerate(rows @ q))[:5]
        seen = 0
        assert tree.search(q, 5, (-best[-1][0], best[-1][1])) == best
        assert seen <= first < len(rows) / 5
        seen = 0
        assert tree.search(q, 5, (-best[0][0] + 10**9, 0)) == [] and seen == 0
    finally:
        topk.scores = kept


# --- fill-in-middle ---------------------------------------------------------------

ODD = [
    None, "", "\n", "\n\n\n", "one", "a\nb", "a\nb\n", "x <P> y\nz", "<M>", "< P>\n<s>\n<", "😀\nß\n日本\n",
    "line\r\nline\r\n", "\x00\n\x00", "word\n" * 5000, "x" * 20000 + "\n" + "y\n" * 300, "a\nb", "P>\n<S\n>",
]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(ODD)] + [(3, "again\nand\nagain", "x", 1, "y"), (None, "no\nid\n", "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int, output string")


def rearranged(key, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rearranged_texts_agree_with_the_rule(odd):
    made = infill.fill_in_middle(odd)
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    given = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted((rearranged(*x) for x in given), key=repr)
    texts = {}
    for k, t in given:
        texts.setdefault(k, set()).add(t or "")
    assert all(r.back in texts[r.doc_id] for r in rows)
    assert {"psm", "spm", "plain"} == {r.form for r in rows}


def test_rate_and_empty_table(odd):
    assert {r.form for r in infill.fill_in_middle(odd, rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(odd, suffix_first=100).collect()} == {"plain", "spm"}
    assert infill.fill_in_middle(odd.limit(0)).collect() == []


def test_rank_index_is_exact_within_its_error():
    rnd = random.Random(3)
    for case in range(60):
        sizes = [rnd.choice([1, 5, 80, 3000]) if case % 2 else 40 + rnd.randint(0, 5) for _ in range(rnd.randint(0, 400))]
        offsets = [0]
        for s in sizes:
            offsets.append(offsets[-1] + s)
        for error in (0, 8, 100):
            index = infill.RankIndex(offsets, error)
            assert [index.offset(i) for i in range(len(offsets))] == offsets
            assert np.abs(index.residuals).max() <= error + 1
            assert [index.predict(i) + int(index.residuals[i]) for i in range(len(offsets))] == offsets
    even = infill.RankIndex(list(range(0, 40_000, 40)))
    assert len(even.starts) == 1


def test_fill_in_middle_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, folder).collect()}
    for d in read_table(spark, folder, "documents").collect():
        *head, output = rearranged(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert [r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars] == head
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# --- periodic runs ----------------------------------------------------------------


def all_runs(words, least=12):
    """Every stretch by every period, longest stretches without a smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_agree_with_brute_force():
    rnd = random.Random(4)
    cases = ["", "a", "a" * 11, "a" * 12, "ab" * 6, "a" * 500, "ab" * 200 + "b" + "ab" * 200, fibonacci(700)]
    cases += ["a" * 150 + "b" + "a" * 150, ("a" * 40 + "b") * 12, ("abc" * 30 + "d") * 9, "ab" * 60 + "aab" * 50]
    for _ in range(400):
        letters = "ab" if rnd.random() < 0.4 else "abcdefghij"
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120)))
        for _ in range(rnd.randint(0, 4)):
            at, size, times = rnd.randint(0, len(text)), rnd.randint(1, 40), rnd.randint(2, 9)
            piece = "".join(rnd.choice(letters) for _ in range(size))
            text = text[:at] + (piece * times)[: rnd.randint(size, size * times)] + text[at:]
        cases.append(text)
    for text in cases:
        codes = np.array([ord(c) for c in text], np.int64)
        for least in (12, 13, 5):
            assert periodic.find_runs(codes, least) == all_runs(text, least), (text, least)


def test_long_periods_and_long_documents():
    rnd = np.random.default_rng(5)
    piece = rnd.integers(0, 50, 1300)
    codes = np.concatenate([rnd.integers(0, 50, 37), piece, piece, piece[:401], rnd.integers(50, 60, 90)])
    (run,) = periodic.find_runs(codes)
    assert run[2] == 1300 and run[0] <= 37 and run[1] >= 3001
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    mixed = np.tile(np.repeat(np.arange(2), [70, 1]), 3000)
    assert periodic.find_runs(mixed)[0][0] == 0


def brute(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_query_agrees_with_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    line = "the quick brown fox jumps over the lazy dog again"
    texts = [None, "", " \n", "one", line, (line + "\n") * 4, "no " * 2000, "a b " * 30, "x\x1cy " * 20, "日本 語 " * 9]
    texts += [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randint(1, 200))) for _ in range(120)]
    rows = [(i, t, "z", 5) for i, t in enumerate(texts)] + [(3, "again " * 13, "z", 5), (None, "null id " * 13, "z", 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert periodic.periodic_runs(frame.limit(0)).collect() == []
    real = read_table(spark, "/root/testdata/sf0.001", "documents").where(F.length("text") < 12000).collect()
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert all(brute(d.doc_id, d.text) in got for d in real)
