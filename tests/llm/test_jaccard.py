"""The PartEnum join against all pairs, on few texts with many near copies."""

import random
from collections import defaultdict

import pytest

from panelsift.llm import jaccard

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = (text or "").translate(ASCII_LOWER).encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    boss = {d: d for d, _ in sets}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                boss[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets}


def near_copies(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for size in (5, 9, 30, 60, 150, 400):
        for copies in (1, 2, 40):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            for _ in range(copies):
                text = list(base)
                for _ in range(rnd.randint(0, max(1, size // 25))):
                    text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
                if rnd.random() < 0.3:
                    text += passage  # a passage that many texts share
                rows.append(" ".join(text))
    rows += [None, "", "  \n", "one two", "One TWO", "a b c d", "a b c d e", rows[7], rows[7]]
    rnd.shuffle(rows)
    return list(enumerate(rows, start=3))


@pytest.mark.parametrize("common_in", [1, 3, 10**9])
def test_components_are_those_of_all_pairs(spark, frame, monkeypatch, common_in):
    # also where every shingle, and where none, counts as common
    monkeypatch.setattr(jaccard, "COMMON_IN", common_in)
    monkeypatch.setattr(jaccard, "LARGE", 8)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    rows = near_copies()
    docs = frame("doc_id bigint, text string, n_shingles int, cls string, id int", [(d, t, 1, "x", 2) for d, t in rows])
    found = {tuple(r) for r in jaccard.groups(docs).collect()}
    assert found == brute_force(rows)


def test_empty_table_and_null_keys(spark, frame):
    assert jaccard.groups(frame("doc_id bigint, text string", [])).collect() == []
    rows = jaccard.groups(frame("doc_id bigint, text string", [(None, None), (4, None), (4, None)])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.doc_id) == [(False, 4), (False, 4)]
    assert len(rows) == 3


def test_instances_cover_every_linked_pair_of_sizes():
    for a in range(1, 400):
        for b in range(a, a * 100 // 80 + 1):
            common = set(jaccard.instances(a)) & set(jaccard.instances(b))
            assert common, (a, b)
            most = (a + b) * 20 // 180
            assert any(jaccard.differences(i) >= most for i in common), (a, b)


def test_links_of_a_group_are_found_from_any_start(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a bigint, b bigint")
    got = defaultdict(set)
    for r in jaccard.components(links).distinct().collect():
        got[r.comp].add(r.cls)
    assert got == {1: set(range(1, 31)), 100: {100, 101}}


def test_buckets_without_a_plausible_pair_are_searched_once(spark, frame, monkeypatch):
    # texts that share a passage and nothing else, beside a group that links
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [f"{passage} " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(25)) for _ in range(30)]
    base = [f"b{i}" for i in range(200)]
    rows += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 200, 20)]
    rows = list(enumerate(rows))
    searched, plain = [], jaccard.across

    def counting(live, sketches, forest=False):
        searched.append((forest, live.count()))
        return plain(live, sketches, forest)

    monkeypatch.setattr(jaccard, "across", counting)
    monkeypatch.setattr(jaccard, "COMMON_IN", 10**9)
    found = {tuple(r) for r in jaccard.groups(frame("doc_id bigint, text string", rows)).collect()}
    assert found == brute_force(rows)
    assert searched[0][0] and searched[0][1] > 30
    assert sum(n for forest, n in searched if not forest) < searched[0][1] // 4
