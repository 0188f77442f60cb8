"""Sharding, language scores and token counts against plain versions over whole small tables."""

import bisect
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from panelsift.llm import language, pieces, sharding, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def ring_in_one_list(rows, shards, nodes, bound):
    """(key, text) -> shard and slot, moving one unit of size at a time around the ring."""
    points = sorted(
        (xxhash.xxh64_intdigest(f"shard {s} node {v}") - 2**63, s) for s in range(shards) for v in range(nodes)
    )
    edges = [p for p, _ in points]
    order = sorted(
        (signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), k is not None, k or 0, len((t or "").encode()) + 16, k)
        for k, t in rows
    )
    arcs = [[] for _ in points]
    for i, (place, *_, size, _) in enumerate(order):
        arcs[bisect.bisect_left(edges, place) % len(points)] += [(i, u) for u in range(size)]
    cap = math.ceil(int(sum(map(len, arcs)) * bound) / shards)
    room, shard_of, over = [cap] * shards, {}, []
    for a, units in enumerate(arcs):
        s = points[a][1]
        take = min(room[s], len(units))
        room[s] -= take
        shard_of.update(dict.fromkeys(units[:take], s))
        over.append(units[take:])
    for a, units in enumerate(over):
        at = a
        while units:
            at = (at + 1) % len(points)
            s = points[at][1]
            take = min(room[s], len(units))
            room[s] -= take
            shard_of.update(dict.fromkeys(units[:take], s))
            units = units[take:]
    filled, out = [0] * shards, []
    for i, (*_, size, key) in enumerate(order):
        s = shard_of[i, size // 2]
        out.append((key, size, s, filled[s]))
        filled[s] += 1
    return out


@pytest.mark.parametrize("shards, nodes, bound", [(4, 8, 1.0), (7, 20, 1.05), (5, 3, 2.0)])
def test_ring_equals_the_ring_in_one_list(spark, shards, nodes, bound):
    rnd = random.Random(shards)
    rows = [(i, "hot text" if i % 3 == 0 else rnd.choice("aéß日") * rnd.randint(0, 60) + str(i)) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "z" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sharding.assign(docs, shards, nodes, bound).collect()
    plain = ring_in_one_list(rows, shards, nodes, bound)
    assert sorted((r.doc_id, r["size"], r.shard, r.slot) for r in got) == sorted(plain)


def plain_grams(text):
    letters, last = [32], False
    for ch in text.lower():
        if ch.isalpha() or last:
            letters.append(ord(ch) if ch.isalpha() else 32)
        last = ch.isalpha()
    if len(letters) < 2:
        return []
    out = []
    for n in language.SIZES:
        for i in range(len(letters) - n + 1):
            h = letters[i]
            for j in range(2, n + 1):
                h = (h * 0x9E3779B1 ^ (letters[i + j - 1] + j)) % 2**32
            out.append(h * 0x85EBCA6B % 2**32 >> 32 - language.BITS)
    return out


def test_language_scores_equal_the_plain_average(spark):
    words = {"en": "the cat sat on a mat", "de": "die Katze saß über der Straße", "el": "η γάτα κάθισε εδώ"}
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(words[k].split(), k=9)) + rnd.choice(["", "! 12", "😀"]), k) for i in range(120) for k in [rnd.choice(list(words))]]
    rows += [(900, None, "en"), (901, " 12 \n", "de"), (902, "", None), (903, "katze " * 3000, "de"), (904, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(found) == len(rows)
    for key, text, _ in rows:
        grams = plain_grams(text or "")
        if not grams:
            assert (found[key].lang_pred, found[key].score) == ("und", 0.0)
            continue
        z = np.mean([model.scores[g].astype(float) for g in grams], axis=0) + model.bias
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        assert found[key].lang_pred == model.labels[int(p.argmax())]
        assert found[key].score == pytest.approx(p.max(), abs=1e-5)


def test_counts_stay_right_when_states_and_words_start_anew(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_WORD_BYTES", 2000)
    machine = token_counts.Transducer(pieces.load(MODEL))
    rnd = random.Random(8)
    for alphabet in ("etaoinshr", "日本語の文", "ab0+/=éß"):
        for _ in range(30):
            t = "  ".join("".join(rnd.choices(alphabet, k=rnd.choice([3, 70, 400]))) for _ in range(4))
            assert token_counts.count_tokens(t, machine) == len(library.encode(t))
            assert len(machine.states) <= 60 and machine.held <= 2000 + 400


def test_unbroken_texts_are_not_remembered():
    machine = token_counts.Transducer(pieces.load(MODEL))
    rnd = random.Random(9)
    text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=300_000))
    assert token_counts.count_tokens("  " + text, machine) == len(
        sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("  " + text)
    )
    assert machine.words == {}
    assert len(machine.states) <= token_counts.MAX_STATES + 1 and machine.compiled <= token_counts.MAX_ARCS + 1
