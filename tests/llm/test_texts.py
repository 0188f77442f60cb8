"""The other text operators: edge rows, and brute force or round trips where SQL is silent."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.models import BPE

from panelsift.llm import decontaminate, language, pieces, pii, quality, sharding, shingles, token_counts, token_files, toxicity, viterbi

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "a", "the  the   the", " leading", "trailing ", "a\n \nb", "tab\t x", "▁▁x", "日本語 テキスト",
    "😀 x\x00y", "word " * 3000, "x" * 5000, "Hello, World! <s> <|endoftext|> </s> end", "Hello, World!", "Hello, World!",
]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", 1, "clash") for i, t in enumerate(ODD)] + [(3, "again", None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_tokens int, shard string")


def texts(n, seed=1, alphabet="aaeetthis  \n.,▁éß日0123😀"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def test_counting_and_encoding_agree_with_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.load(MODEL)
    machine, encoder, decoder = token_counts.Transducer(model), viterbi.Encoder(model), viterbi.Decoder(model)
    for t in texts(400) + [x or "" for x in ODD]:
        ids = library.encode(t)
        for chunk in (1, 3, 1 << 16):
            assert token_counts.count_tokens(t, machine, chunk) == len(ids)
        assert encoder.encode(t).tolist() == ids
        assert decoder.decode(np.array(ids)) == model.decode(ids) == t.replace("▁", " ")


def test_blocks_do_not_change_ids(monkeypatch):
    model = pieces.load(MODEL)
    whole = [viterbi.Encoder(model).encode(t).tolist() for t in texts(200, 2)]
    monkeypatch.setattr(viterbi, "BLOCK", 4)
    assert [viterbi.Encoder(model).encode(t).tolist() for t in texts(200, 2)] == whole


def test_lattice_keeps_a_bounded_window():
    lattice = viterbi.StreamingViterbi(pieces.load(MODEL))
    for _ in range(200):
        lattice.feed("▁international" * 3)
        assert len(lattice.back) <= lattice.window + 1


def test_coding_of_a_table(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = viterbi.encode_documents(odd, MODEL).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        if r.doc_id != 3:
            text = ODD[r.doc_id] or ""
            assert r.ids == library.encode(text)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            assert r.lossless == ("▁" not in text)
    counts = token_counts.token_counts(odd, MODEL, limit=100).collect()
    assert sorted(r.n_tokens for r in counts) == sorted(r.n_ids for r in rows)
    assert {r.over_limit for r in counts if r.n_tokens > 100} == {True}


def test_token_files_round_trip(odd):
    library = Tokenizer.from_file(BYTES)
    rows = token_files.token_files(odd, BYTES).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([*range(len(ODD)), 3])
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id != 3:
            ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids + [0]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_segments_encode_as_whole_texts():
    library = Tokenizer.from_file(BYTES)
    encoder = token_files.SegmentEncoder(BYTES, 0)
    many = texts(2000, 3, "ab  \n\t'sé0.  <|") + ["a <|endoftext|> b", "x<|endoftext|>y z"]
    for t, ids in zip(many, encoder.encode(many)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids + [0], t


def test_damaged_frame_is_noticed_and_others_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        writer = token_files.FileWriter(f)
        for k in range(10):
            writer.add(k * 5, np.arange(k, dtype="<u4").tobytes())
        writer.close()
    reader = token_files.FileReader(pa.OSFile(str(path)))
    assert len(reader.entries) > 3
    assert reader.of_key(45) == [np.arange(9, dtype="<u4").tobytes()]
    content = bytearray(path.read_bytes())
    content[int(reader.offsets[1]) - 1] ^= 0xFF
    path.write_bytes(content)
    reader = token_files.FileReader(pa.OSFile(str(path)))
    assert reader.of_key(45) == [np.arange(9, dtype="<u4").tobytes()]
    with pytest.raises(Exception):
        reader.frame(0)


def test_sharding_is_balanced_gapless_and_keeps_most_rows_when_it_grows(spark):
    rnd = random.Random(4)
    rows = [(i, "hot text" if i % 3 == 0 else "x" * rnd.randint(0, 300) + str(i)) for i in range(6000)] + [(None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before, after = (sharding.assign(docs, n).toPandas() for n in (10, 11))
    for got, n in ((before, 10), (after, 11)):
        assert len(got) == len(rows) and set(got["shard"]) <= set(range(n))
        size = got.groupby("shard")["size"].sum()
        assert size.max() - size.min() < 0.06 * size.mean()
        assert all(sorted(s) == list(range(len(s))) for s in got.groupby("shard")["slot"].apply(list))
    both = before.dropna(subset="doc_id").merge(after.dropna(subset="doc_id"), on="doc_id")
    assert (both.shard_x != both.shard_y).mean() < 0.35
    assert sharding.assign(docs.limit(0), 10).collect() == []


def test_quality_of_odd_rows(odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD) + 1 and rows[0].asDict().keys() >= {"shard", "n_tokens", "quality"}
    for r in rows:
        words = (r.text or "").encode().split()
        assert r.quality.n_words == len(words)
        assert r.quality.kept is False  # too short, or the same word throughout


def test_decontamination_of_odd_rows(spark, odd):
    item = " ".join(f"q{i}" for i in range(30))
    docs = odd.select("doc_id", "text").union(
        spark.createDataFrame([(70, "x " * 400 + item.upper() + " y" * 400), (71, item[:60])], "doc_id bigint, text string")
    )
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b"), (5, item)], "item_id bigint, text string")
    found = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found) == [(70, 1, 26, 26), (70, 5, 26, 26)]
    assert decontaminate.clean(docs, items).count() == docs.count() - 1
    assert decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.leaks(docs.limit(0), items).collect() == []


def test_shingle_hashes_do_not_depend_on_neighbours():
    many = ["A b c d e f", "", None, "a B c\td\ne f", "a b c d e", "one two", "x y z w v u t"]
    alone = [next(shingles.shingle_sets(pa.array([t], pa.string()))) for t in many]
    for a, b in zip(shingles.shingle_sets(pa.array(many, pa.string())), alone):
        assert a.tolist() == b.tolist()
    assert [len(s) for s in alone] == [2, 0, 0, 2, 1, 1, 3]
    assert alone[0].tolist() == alone[3].tolist()


def test_personal_data_spans_point_into_the_source(odd):
    text = "ä mail jоhn [at] mаil3 (dot) example [dot] com or +1 (499) 555-6503, 4​225039295678253, 10.0.0.256"
    base, every = pii.find(text)
    assert [text[a:b] for a, b in every["email"]] == ["jоhn [at] mаil3 (dot) example [dot] com"]
    assert [text[a:b] for a, b in every["phone"]] == ["+1 (499) 555-6503"] and base["ip"] == []
    assert [text[a:b] for a, b in every["card"]] == ["4​225039295678253"] and base["card"] == []
    assert pii.mask("to a@b.co, now") == "to [EMAIL], now"
    spoken = "call plus one four nine nine five five five six five oh three please"
    assert pii.mask(spoken) == "call [PHONE] please"
    assert pii.personal_data(odd).count() == len(ODD) + 1
    assert pii.redact(odd).columns == odd.columns


def test_language_and_toxicity_learn_from_few_rows(spark):
    rnd = random.Random(1)
    words = {"en": "the house and this with".split(), "de": "der und nicht schön über".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(60)), k) for i in range(150) for k in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", None)], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert all(found[i].lang_pred == k for i, _, k in rows)
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[901].score == 0
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in found}
    assert all(found[i].held_out == h for i, h in held.items())
    assert language.identify(docs, language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    mean = [(i, t + (" gruntle" if i % 3 == 0 else ""), 0) for i, t, _ in rows]
    bad = spark.createDataFrame(mean, "doc_id bigint, text string, lang int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in mean], "doc_id bigint, toxic int")
    scored = toxicity.score(bad, toxicity.fit(bad, labels)).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in scored)
    assert toxicity.score(bad, toxicity.fit(bad, labels.limit(0))).where("predicted = 1").count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):  # none, one class
        model = toxicity.fit(bad, some)
        assert all(0 <= r.score <= 1 for r in toxicity.score(bad, model).collect())
        assert toxicity.score(bad.limit(0), model).collect() == []


def test_toxicity_sample_is_the_least_hashes_of_each_label(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 7)
    rows = [(i, f"text {i % 60} " + "you idiot " * (i % 3 == 0), "x", 3) for i in range(200)] + [(500, None, "x", 1), (None, "y", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, h int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(500, 1), (None, 1)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda found, given: seen.append((found, given)))
    toxicity.fit(docs, labels)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    usable = [(t, i % 3 == 0) for i, t, *_ in rows[:200] if zlib.crc32(str(i).encode()) % 3 != 1]
    expected = []
    for value, most in ((True, 5), (False, 7)):
        own = sorted({t for t, y in usable if y is value}, key=hashes.get)[:most]
        expected += [(toxicity.signs(t), int(value)) for t in own]
    assert list(zip(*seen[0])) == expected


def test_toxicity_voters_of_both_polarities():
    calm, rude = "the house by the sea", "you are a stupid idiot, idiot"
    assert toxicity.signs(rude)[1] == {"#two", "#again", "#address"}
    assert toxicity.signs("WHAT!! a day")[1] == {"#shout"} and toxicity.signs(calm)[1] == set()
    texts = [toxicity.signs(f"{calm} {i}") for i in range(300)] + [toxicity.signs(rude)] * 40
    model = toxicity.train(texts, [0] * 300 + [1] * 40)
    weight = dict(zip(model.voters.names, model.weights))
    assert weight[toxicity.NONE] < 0 < min(weight["#two"], weight["idiot"])
    assert model.score(calm) < 0.3 and model.score("") < 0.3 and model.score(rude) >= toxicity.THRESHOLD
    assert model.score((calm + " ") * 100_000 + rude) >= toxicity.THRESHOLD


def test_as_many_words_are_remembered_as_real_text_has():
    encoder = viterbi.Encoder(pieces.load(MODEL))
    words = [f"w{i:x}" for i in range(160_000)]
    first = encoder.encode(" ".join(words))
    assert all(w in encoder.items for w in (" " + words[1], " " + words[-2]))
    assert np.array_equal(encoder.encode(" ".join(words[:2])), first[: len(encoder.encode(" ".join(words[:2])))])


def test_neighbours_are_judged_without_merging_each_pair(monkeypatch):
    model = pieces.PieceModel(MODEL)
    some = random.Random(4).sample(sorted(model.ends.values()), 150) + [model.id[x] for x in ("e", "t", "th", "he", "▁the")]
    plain = {(a, b): model.merge(model.text[a] + model.text[b]) == [model.text[a], model.text[b]] for a in some for b in some}
    merged, merge = [], model.merge
    monkeypatch.setattr(model, "merge", lambda *a: merged.append(1) or merge(*a))
    assert {(a, b): model.apart(a, b) for a in some for b in some} == plain
    assert set(plain.values()) == {True, False} and len(merged) <= 2 * len(some)


def test_a_walk_keeps_nothing_of_a_word_but_neighbours():
    walker = viterbi.Walker(pieces.load(MODEL))
    whole = (len(walker.kids), len(walker.longer))
    rnd = random.Random(6)
    words = ["▁" + "".join(rnd.choice("étsanrio.,\n日😀") for _ in range(12)) for _ in range(500)]
    lattice = [viterbi.StreamingViterbi(walker.model) for _ in words]
    assert [walker.ids(w) for w in words] == [x.feed(w) + x.finish() for x, w in zip(lattice, words, strict=True)]
    assert (len(walker.kids), len(walker.longer)) == whole


def test_new_words_of_a_text_are_encoded_in_one_go():
    encoder, library = token_files.SegmentEncoder(BYTES, 0), Tokenizer.from_file(BYTES)
    given, plain = [], encoder._ids

    def counting(some):
        given.extend(some)
        return plain(some)

    encoder._ids = counting
    text = "first " + " ".join(f"wörd{i}, x{i}é" for i in range(500)) + " a\n b <|endoftext|> Ġ Ġx 'll \x1c y"
    (ids,) = encoder.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    assert len(given) < 10  # the beginning, the joined words and what may not be joined


def test_known_words_are_not_encoded_again_beside_marks_and_line_ends(monkeypatch):
    encoder, library = token_files.SegmentEncoder(BYTES, 0), Tokenizer.from_file(BYTES)
    words = [f"{a}{b}{c}" for a in ("Été", "the", "x1") for b in "abcdé" for c in "vwxyzß"]
    encoder.encode(["\n".join(words), " ".join(words), ", ."])
    given, plain = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda some: given.extend(some) or plain(some))
    for text in (", ".join(words), ".\n".join(words), "   ".join(words), "\n\n".join(words)):
        (ids,) = encoder.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    assert sum(map(len, given)) < 10  # marks and blanks


def test_cuts_beside_every_kind_of_white_space_and_letter():
    odd = [*"abÉß×÷ªº09²'\n\n  ,.;:!?\t\r\0\x1c\x7f", *"\x85\xa0\u1680\u2000\u200a\u200b\u2028\u202f\u205f\u2060\u3000"]
    odd += ["あ", "\u0301", "ж", "”", "…", "😀", "<|endoftext|>", "<|", "'ll", "Ġ", "Ċ"]
    encoder, library = token_files.SegmentEncoder(BYTES, 0), Tokenizer.from_file(BYTES)
    many = texts(3000, 8, odd) + [x + y + z for x in odd for y in (*" \n,", "  ", "\n\n", " \n") for z in odd]
    for t, ids in zip(many, encoder.encode(many), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids + [0], t


def test_a_tokenizer_whose_pieces_span_blanks_gets_whole_texts(tmp_path):
    pairs = Tokenizer(BPE({"a": 0, " ": 1, "a ": 2, "a a": 3, ",": 4, "a,": 5, "\n": 6}, [("a", " "), ("a ", "a"), ("a", ",")]))
    pairs.save(path := str(tmp_path / "pairs.json"))
    encoder, many = token_files.SegmentEncoder(path, 9), ["a a", "a, a a\na", "", "a a a a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(many)] == [pairs.encode(t).ids + [9] for t in many]
