"""The labelled sample of the language model: copies count once, each language has its share."""

import random
import zlib

from pyspark.sql import functions as F

from panelsift.llm import language


def test_copies_and_large_languages_leave_no_language_out(spark):
    rnd = random.Random(1)
    words = {"en": "the house and this with".split(), "de": "der und nicht schön über".split(), "fr": "le une avec être très".split()}
    free = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = [(" ".join(rnd.choice(words[k]) for _ in range(40)), k) for k, n in (("en", 120), ("de", 120), ("fr", 6)) for _ in range(n)]
    hashed = spark.createDataFrame(texts, "text string, lang string").select("text", "lang", F.xxhash64("text").alias("h"))
    first = hashed.orderBy("h").first()
    rows = [*texts, *[(first.text, first.lang)] * 300]
    docs = spark.createDataFrame([(i, *r) for i, r in zip(free, rows)], "doc_id bigint, text string, lang string")
    model = language.fit(docs, rows=60)
    assert model.labels == ["de", "en", "fr"]
    right = [r.lang_pred == r.lang for r in language.identify(docs, model).join(docs, "doc_id").collect()]
    assert sum(right) >= 0.95 * len(right)


def test_a_language_is_bounded_by_its_texts_of_least_hash(spark, monkeypatch):
    rows = [(i, f"{k} text {i}", k) for i in range(400) for k in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append(sorted(zip(langs, texts))))
    language.fit(docs.union(docs).repartition(7), rows=20)
    h = docs.where("crc32(cast(doc_id as string)) % 3 <> 1").select("lang", "text", F.xxhash64("text").alias("h"))
    least = [(r.lang, r.text) for k in ("en", "de") for r in h.where(F.col("lang") == k).orderBy("h").limit(20).collect()]
    assert seen == [sorted(least)]
