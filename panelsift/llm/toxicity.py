"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon entries (a word occurs), stems (a word starts with one), both proposed
from labelled rows and a seed list, patterns of a whole text, and one that fires where no
term does; a voter that does not fire abstains. The label model sees votes only: it
estimates by expectation maximisation how often each voter fires in either class, which
also says for which class it speaks, and from the correlations within each class how much
evidence voters share, so that ten spellings of one stem do not count as ten. Its posteriors, not the labels, train a logistic
classifier by gradient descent; that scores every whole text.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsift.llm.common import held_out, map_texts, stored, texts_of

#: Most labelled rows read for proposing and fitting, toxic ones and others, by text hash.
SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 4000
MAX_VOTERS = 400
#: How many times commoner in toxic rows a term must be to become a voter.
LIFT = 40
#: Log odds of every row where no labelled row is usable.
NO_LABELS = -4.0
#: The voter that fires where no term does, and the pattern voters.
NONE = "#none"
PATTERNS = (NONE, "#address", "#again", "#two", "#shout")
STEMS = (4, 5, 6)
THRESHOLD = 0.7
MAX_WORDS = 400_000
SEED_WORDS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown "
    "dumb filth vermin garbage imbecile degenerate"
).split()

#: Forms of address; an insult close behind one is a pattern of its own.
ADDRESS = frozenset("you your youre ya u du dein ihr sie tu toi vous tú usted eres".split())

WORD = re.compile(r"[^\W\d_]+")
_SEEDS = frozenset(SEED_WORDS)
_SHOUT = re.compile(r"!{2,}|(?:\b[A-ZÀ-ÖØ-ÞА-Я]{3,}\b\W+){4}")
Signs = tuple[frozenset[str], frozenset[str]]


def signs(text: str) -> Signs:
    """What voters look at: the distinct lower-case words of a whole text, and its patterns.

    Patterns: an insult behind a form of address, the same insult again, two different
    ones, shouting. Whether a pattern speaks for or against toxicity is estimated.
    """
    words = WORD.findall(text.lower())
    marks = set()
    distinct = frozenset(words)
    insults = distinct & _SEEDS
    if insults:
        at = [i for i, w in enumerate(words) if w in _SEEDS]
        if len(insults) > 1:
            marks.add("#two")
        if len(at) > len(insults):
            marks.add("#again")
        if any(not ADDRESS.isdisjoint(words[max(i - 3, 0) : i]) for i in at):
            marks.add("#address")
    if _SHOUT.search(text):
        marks.add("#shout")
    return distinct, frozenset(marks)


def terms(word: str) -> list[str]:
    """The word itself and its stems, as voter names."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Voters:
    """Names of voters and their votes on the signs of a text."""

    def __init__(self, names: list[str]):
        self.names = names
        self.number = {t: i for i, t in enumerate(names)}
        self._seen: dict[str, tuple[int, ...]] = {}

    def fire(self, found: Signs) -> list[int]:
        """Numbers of the voters that fire, sorted; ``NONE`` where no term does."""
        seen, number, hits = self._seen, self.number, set()
        words, marks = found
        for word in words:
            own = seen.get(word)
            if own is None:
                if len(seen) > MAX_WORDS:
                    seen.clear()
                own = seen[word] = tuple(number[t] for t in terms(word) if t in number)
            if own:
                hits.update(own)
        if not hits:
            hits.add(number[NONE])
        hits.update(number[m] for m in marks)
        return sorted(hits)


def propose(texts: list[Signs], toxic: np.ndarray) -> Voters:
    """Voters from labelled texts: terms that explain toxic rows, their spellings, seeds.

    Terms far commoner in toxic rows are taken by how many rows they explain that no
    earlier one does, so that a passage copied into many toxic rows does not propose its
    every word. Words that begin with a chosen stem become voters of their own.
    """
    own = [[sys.intern(x) for w in words for x in terms(w)] for (words, _), y in zip(texts, toxic) if y]
    inside = Counter(x for row in own for x in set(row))
    few = max(2, len(own) // 500)
    inside = {t: k for t, k in inside.items() if k >= few}
    outside: Counter = Counter()
    for (words, _), y in zip(texts, toxic):
        if not y:
            outside.update({x for w in words for x in terms(w)} & inside.keys())
    n1, n0 = max(len(own), 1), max(int((~toxic).sum()), 1)
    rows: dict[str, set[int]] = {
        t: set() for t, k in inside.items() if (k + 0.5) / (n1 + 1) > LIFT * (outside[t] + 0.5) / (n0 + 1)
    }
    for i, row in enumerate(own):
        for t in row:
            if t in rows:
                rows[t].add(i)
    chosen: list[str] = []
    queue = [(-len(r), t) for t, r in rows.items()]
    heapq.heapify(queue)
    covered: set[int] = set()
    while queue and len(chosen) < MAX_VOTERS:
        gain, t = heapq.heappop(queue)
        now = len(rows[t] - covered)
        if now < few:
            continue
        if now < -gain:  # less than it once explained: try again in its place
            heapq.heappush(queue, (-now, t))
            continue
        chosen.append(t)
        covered |= rows[t]
    stems = tuple(t[:-1] for t in chosen if t.endswith("*"))
    spelled = [t for t in rows if stems and not t.endswith("*") and t.startswith(stems)]
    spelled.sort(key=lambda t: (-len(rows[t]), t))
    return Voters(sorted({*chosen, *spelled[:MAX_VOTERS], *SEED_WORDS}) + list(PATTERNS))


class LabelModel:
    """Class prior, firing rates per class, and how far voters share their evidence."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 15):
        votes = votes.astype(np.float32)
        p = start.astype(np.float64)
        self.shared = np.eye(votes.shape[1], dtype=np.float32)
        for k in range(rounds):
            self.prior = float(np.clip(p.mean(), 0.01, 0.99))
            self.rate1 = (p @ votes + 0.05) / (p.sum() + 1)
            self.rate0 = ((1 - p) @ votes + 0.05) / ((1 - p).sum() + 1)
            if k in (0, 5):
                self.shared = self._correlations(votes, p)
            p = self.posterior(votes)

    @staticmethod
    def _correlations(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Positive correlations of voters within a class, the greater of both classes."""
        found = np.zeros((votes.shape[1], votes.shape[1]))
        for weight in (p, 1 - p):
            total = max(weight.sum(), 1e-9)
            mean = (weight @ votes) / total
            spread = np.sqrt(np.clip(mean * (1 - mean), 1e-6, None))
            rows = votes * np.sqrt(weight)[:, None].astype(np.float32)
            corr = (rows.T @ rows / total - np.outer(mean, mean)) / np.outer(spread, spread)
            found = np.maximum(found, np.where(corr < 0.1, 0, np.clip(corr, 0, 1)))
        np.fill_diagonal(found, 1)
        return found.astype(np.float32)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic. Evidence of voters that fire together is shared out as far
        as they are correlated; a voter commoner in the clean class speaks against."""
        lift = np.log(np.clip(self.rate1, 1e-6, 1) / np.clip(self.rate0, 1e-6, 1))
        among = np.clip(votes @ self.shared, 1, None)
        z = np.log(self.prior / (1 - self.prior)) + (votes / among) @ lift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class ToxicityModel:
    def __init__(self, voters: Voters, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.voters.fire(signs(text))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[Signs], toxic: list[int]) -> ToxicityModel:
    """Propose voters, fit the label model on their votes, the classifier on its posteriors.

    Without labelled texts nothing is learned: every text scores as one that no voter marks.
    """
    y = np.array(toxic, bool)
    voters = propose(texts, y)
    if not texts:
        return ToxicityModel(voters, np.zeros(len(voters.names)), NO_LABELS)
    votes = np.zeros((len(texts), len(voters.names)), np.uint8)
    for i, t in enumerate(texts):
        votes[i, voters.fire(t)] = 1
    start = np.where(votes[:, voters.number[NONE]] == 0, 0.9, 0.05)
    soft = LabelModel(votes, start).posterior(votes.astype(np.float32))
    x = votes.astype(np.float32)
    w, b = np.zeros(x.shape[1]), float(np.log(max(soft.mean(), 1e-3) / max(1 - soft.mean(), 1e-3)))
    square, square_b = np.full(x.shape[1], 1e-6), 1e-6
    for _ in range(300):  # full-batch logistic regression with adaptive steps
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = x.T @ (p - soft) / len(x) + 1e-5 * w
        gb = float((p - soft).mean())
        square += g * g
        square_b += gb * gb
        w -= 0.5 * g / np.sqrt(square)
        b -= 0.5 * gb / np.sqrt(square_b)
    return ToxicityModel(voters, w, b)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    wanted = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    marked = (
        labels.where(F.col(label).isin(*wanted) & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("h"))
    known = stored(hashed.join(marked, "key").groupBy("label", "h").agg(F.min("key").alias("key")), "toxicity")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    # hashes are uniform: below a label's cut lie its least ones, almost surely
    below = F.lit(False)
    for value, n in sizes.items():
        room = wanted[value] + 6 * math.sqrt(wanted[value]) + 30
        cut = min(int(2**64 * min(room / n, 1.0)), 2**64 - 1) - 2**63
        below |= (F.col("label") == value) & (F.col("h") <= cut)
    near = sorted(known.where(below).collect(), key=lambda r: r.h)
    chosen = [r for value, most in wanted.items() for r in [r for r in near if r.label == value][:most]]
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, known.schema))
    read = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(picked, "key")
        .where(F.xxhash64("text") == F.col("h"))
    )
    rows = {(r.label, r.h): r for r in map_texts(read, _signs, "label int, h long, words string, marks string").collect()}
    given = [rows.pop((r.label, r.h)) for r in chosen if (r.label, r.h) in rows]
    # one string object a word, however many texts have it
    found = [(frozenset(map(sys.intern, r.words.split())), frozenset(r.marks.split())) for r in given]
    return train(found, [r.label for r in given])


def _signs():
    def work(batch: pa.RecordBatch):
        found = [signs(t) for t in texts_of(batch)]
        words, marks = (pa.array([" ".join(sorted(x[i])) for x in found], pa.string()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("h"), words, marks], ["label", "h", "words", "marks"]
        )

    return work


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score, predicted.

    Null and empty texts score as texts on which no voter fires. Equal texts get equal
    scores; other columns, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.voters.names, model.weights, model.bias))

    def make():
        names, weights, bias = sent.value
        own = ToxicityModel(Voters(names), weights, bias)

        def work(batch: pa.RecordBatch):
            scores = [own.score(t) for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                ],
                [key, "held_out", "score", "predicted"],
            )

        return work

    kind = dict(docs.dtypes)[key]
    rows = docs.select(key, text, held_out(F.col(key)).alias("held_out"))
    return map_texts(rows, make, f"`{key}` {kind}, held_out boolean, score double, predicted int")
