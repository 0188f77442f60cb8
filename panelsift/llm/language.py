"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is its character 2- to 4-grams over lower-cased letters with one blank between
words; each is hashed to a row of an embedding table, rows are averaged, and a linear
layer gives class scores. Table and layer are trained by stochastic gradient descent in
numpy. A temperature fitted on rows kept aside calibrates the probabilities; below the
confidence that keeps a given share of right answers a text is marked rejected.

Average and layer are both linear, so for use their product is taken once: a table of
class scores per hash, of which a whole text needs the mean.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.llm.common import held_out, map_texts, texts_of

BITS = 18
WIDTH = 16
SIZES = (2, 3, 4)
#: Most distinct labelled texts of a language the model is fitted on, chosen by a hash of
#: the text, and of all languages: more than six share these alike. Copies count once.
LANGUAGE_ROWS = 4000
ALL_ROWS = 24000
EPOCHS = 6
#: N-grams of a labelled row kept for training.
ROW_GRAMS = 3000
#: Share of right answers that the rejection threshold must not turn away.
KEEP_RIGHT = 0.99
UNKNOWN = "und"
BLOCK_CHARS = 1 << 20

_FACTOR = np.uint32(0x9E3779B1)


def _codes(text: str) -> np.ndarray:
    """Code points of the letters, lower-cased, other characters as single blanks."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(c)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator behind each word
    return np.where(letter, c, np.uint32(32))[keep]


_table = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x10000)), bool)


def _letters(c: np.ndarray) -> np.ndarray:
    low = c < 0x10000
    out = np.zeros(len(c), bool)
    out[low] = _table[c[low]]
    for i in np.nonzero(~low)[0]:
        out[i] = chr(c[i]).isalpha()
    return out


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a whole text; empty if it has no letter."""
    c = np.concatenate([[np.uint32(32)], _codes(text)]).astype(np.uint32)
    if len(c) < 2:
        return np.zeros(0, np.uint32)
    out, h = [], c.copy()
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = (h[:-1] * _FACTOR) ^ (c[n - 1 :] + np.uint32(n))
        if n in SIZES:
            out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


class LanguageModel:
    def __init__(self, labels: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, reject: float):
        self.labels, self.scores, self.bias = labels, scores, bias
        self.temperature, self.reject = temperature, reject

    def probabilities(self, text: str) -> np.ndarray | None:
        """Class probabilities of a whole text, read in blocks; None without a letter."""
        total, n = np.zeros(len(self.labels)), 0
        for k in range(0, len(text), BLOCK_CHARS):
            g = grams(text[k : k + BLOCK_CHARS])
            if len(g):
                total += self.scores[g].sum(axis=0, dtype=np.float64)
                n += len(g)
        if not n:
            return None
        z = (total / n + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
    """Fit on labelled texts; the order of the rows does not matter beyond rounding."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:  # of a long text, n-grams drawn from all of it
        g = grams(t)
        rows.append(g if len(g) <= ROW_GRAMS else rng.choice(g, ROW_GRAMS, replace=False))
    use = np.array([len(r) > 0 for r in rows])
    order = rng.permutation(np.nonzero(use)[0])
    aside, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(fit):
        fit = aside
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            g = rows[i]
            if len(g) > 400:
                g = rng.choice(g, 400)
            mean = table[g].mean(axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            np.subtract.at(table, g, (rate * 20 / len(g)) * back)
    scores = table @ layer
    model = LanguageModel(labels, scores, bias.astype(np.float64), 1.0, 0.0)
    # calibration: the temperature of least log loss on rows kept aside, then the threshold
    kept = aside if len(aside) else fit
    z = np.array([scores[rows[i]].mean(axis=0) + bias for i in kept], np.float64).reshape(len(kept), -1)
    if len(kept):
        best = None
        for temperature in np.geomspace(0.05, 20, 61):
            s = z / temperature
            s -= s.max(axis=1, keepdims=True)
            logp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
            loss = -logp[np.arange(len(kept)), y[kept]].mean()
            if best is None or loss < best[0]:
                best = loss, float(temperature), np.exp(logp)
        model.temperature = best[1]
        right = best[2].argmax(axis=1) == y[kept]
        if right.any():
            model.reject = float(np.quantile(best[2].max(axis=1)[right], 1 - KEEP_RIGHT))
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = LANGUAGE_ROWS) -> LanguageModel | None:
    """Fit on at most ``rows`` distinct texts of each language outside the held-out fold; None if there are none."""
    usable = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")
    )
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    most = max(1, min(rows, ALL_ROWS // len(sizes)))
    # hashes are uniform: below a language's cut lie its ``most`` least ones, almost surely
    room = most + 6 * math.sqrt(most) + 30
    cuts = [(k, min(int(2**64 * min(room / n, 1.0)), 2**64 - 1) - 2**63) for k, n in sizes.items()]
    below = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    sample = usable.join(below, "lang").where("h <= cut").select("lang", "text", "h").distinct().collect()
    sample.sort(key=lambda r: (r.h, r.lang, r.text))
    left, kept = dict.fromkeys(sizes, most), []
    for r in sample:
        if left[r.lang]:
            left[r.lang] -= 1
            kept.append(r)
    return train([r.text for r in kept], [r.lang for r in kept])


def identify(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, lang_pred, score, rejected.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learned; score is the calibrated probability of the prediction. Equal texts get equal
    answers; other columns, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def work(batch: pa.RecordBatch):
            langs, scores, rejected = [], [], []
            for t in texts_of(batch, text):
                p = own.probabilities(t) if own is not None else None
                if p is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                else:
                    i = int(p.argmax())
                    langs.append(own.labels[i])
                    scores.append(float(min(p[i], 1.0)))
                    rejected.append(bool(p[i] < own.reject))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [key, "held_out", "lang_pred", "score", "rejected"],
            )

        return work

    kind = dict(docs.dtypes)[key]
    rows = docs.select(key, text, held_out(F.col(key)).alias("held_out"))
    return map_texts(rows, make, f"`{key}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
