"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

*Token scores.* For words and their prefixes, training counts documents by class. A token's log-odds
against the base rate come from a Beta (two-class Dirichlet) posterior whose prior is the posterior of
the next shorter prefix, so an unseen form of a known stem still scores; a standard error is taken off,
and every other token costs a fixed amount (``drift``).

*Segments.* A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of the whole text: a segment on
its list links to the nearest one that begins lower, so no step looks twice at what it has passed. Inside a
segment a word that comes again adds less each time, a half, a third and so on; segments with the same text count once.

*Calibration.* Scores of the best segment in clean text follow an extreme-value law: a segment of score
S in n words has the expectation E = K n exp(-lambda S). lambda solves the usual equation on the token
scores of clean training text, K is fitted to its maxima; training rows are scored without their own
counts. The segments of different texts are judged together by their sum statistic P, for that number r of
them, the best first, that is least likely; as r is chosen, P is divided by its prior 0.5^r. The
score is a logistic function of ln(1 - ln P).

Training takes a bounded sample: at most ``most`` labelled documents, chosen by a hash of the id, with at most
``most_bytes`` bytes of text together (one that is longer by itself isn't taken), and all of their telling tokens. So
the model is bounded in bytes: its tokens are words of these documents, and at most three prefixes of each. Scoring covers every row and whole texts; only the text is an input.

Defined cases: null and empty texts have no segment and get the lowest score; without labelled rows of
both classes every score is the share of toxic ones (0 with no labels); equal texts get equal scores;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from codeweave.llm.common import batch_of, discard, held_out, materialize, task
from codeweave.llm.labelled import logistic, probability, training_rows, within_bytes

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
#: A word that training hasn't seen takes its prefix's log-odds only where the prefix is toxic in this share.
STEM_SHARE = 0.95
MEMO_ENTRIES = 400_000
#: Each further segment that is judged together with the best one is this much less expected (the usual value for segments without gaps).
DECAY = 0.5


def features_of(word: str) -> list[str]:
    """Shorter prefixes first, marked; the word last."""
    return [*(f"{word[:k]}*" for k in PREFIXES if len(word) > k), word]


@dataclass(frozen=True)
class Model:
    counts: dict[str, tuple[int, int]]  # clean and toxic training documents with a token
    clean: int
    toxic: int
    weight: float = 4.0  # of the prior, in documents
    drift: float = 0.5
    least: float = 1.0  # weaker log-odds count as none
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, ...] = (0.0, 0.0)

    def word_score(self, word: str, own: int | None = None) -> float:
        """Log-odds less a standard error and the drift; ``own``: the class of a training row that is not to count."""
        base = self.toxic / (self.clean + self.toxic)
        share, last, known = base, None, None
        for f in features_of(word):
            known = self.counts.get(f)
            if known is None:
                continue
            n0, n1 = known[0] - (own == 0), known[1] - (own == 1)
            a1, a0 = n1 + self.weight * share, n0 + self.weight * (1 - share)
            share, last = a1 / (a1 + a0), (a1, a0)
        if last is None or (known is None and share < STEM_SHARE):
            return -self.drift
        odds = math.log(share / (1 - share)) - math.log(base / (1 - base)) - math.sqrt(1 / (last[0] + 0.5) + 1 / (last[1] + 0.5))
        return odds - self.drift if odds >= self.least else -self.drift

    def log_expectation(self, score: float, n: int) -> float:
        """ln of the number of segments with this score or more that n clean words have by chance."""
        return math.log(self.scale * max(n, 1)) - self.rate * score

    def strength(self, scores: list[float], n: int) -> float:
        """How unlikely in clean text the best r of these segment scores (largest first) are together, for the best r.

        With t the sum of the r normalised scores, P = exp(-t) t^(r-1) / (r! (r-1)!), the sum statistic of
        Karlin and Altschul, divided by the prior of r.
        """
        t, best = 0.0, 0.0
        for r, s in enumerate(scores, 1):
            u = -self.log_expectation(s, n)
            if u <= 0:
                break
            t += u
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) + math.log(1 - DECAY) + (r - 1) * math.log(DECAY))
        return math.log1p(best)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), in order; linear in the number of scores."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    upto = np.concatenate(([0.0], np.cumsum(scores, dtype=float)))
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last + 1, nearest one that begins lower
    left = upto[positive].tolist()
    right = upto[positive + 1].tolist()
    for before, after, at in zip(left, right, positive.tolist()):
        first, end, j = at, at + 1, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= after:
                kept.append((before, after, first, end, j))
                break
            before, _, first, _, link = kept[j]
            del kept[j:]
            j = link
    return [(f, e, a - b) for b, a, f, e, _ in kept]


def without_repeats(words: list[str], scores: np.ndarray, drift: float) -> np.ndarray:
    """Scores of a segment's words: the n-th time that a word comes, it adds an n-th of what it adds first, and costs what any word does."""
    scores, seen = scores.copy(), {}
    for i in np.flatnonzero(scores > 0).tolist():
        seen[words[i]] = times = seen.get(words[i], 0) + 1
        scores[i] = (scores[i] + drift) / times - drift
    return scores


def top_scores(words: list[str], scores: np.ndarray, drift: float) -> list[float]:
    """The scores of segments with different texts, largest first: a repeated line counts once.

    Segments are those of the unaltered scores; a word's repeats are discounted inside one segment only, so what
    a passage scores doesn't depend on the text before it.
    """
    found = {}
    for f, e, s in maximal_segments(scores):
        inside = words[f:e]
        if len(inside) == len(set(inside)):
            found[tuple(inside)] = s
            continue
        for a, b, part in maximal_segments(without_repeats(inside, scores[f:e], drift)):
            found[tuple(inside[a:b])] = part
    return sorted(found.values(), reverse=True)


class Scorer:
    """A worker's memo of word scores."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def scores(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), float, len(words))
        except KeyError:
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            one = self.model.word_score
            for w in words:
                if w not in memo:
                    memo[w] = one(w)
            return np.fromiter(map(memo.__getitem__, words), float, len(words))


def _counts(rows: DataFrame) -> DataFrame:
    """(token, clean, toxic): documents of each class with the token."""
    schema = pa.schema([("token", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])

    @task("toxicity")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                for f in {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}:
                    found.setdefault(f, [0, 0])[y == 1] += 1
            yield batch_of(schema, list(found), [c[0] for c in found.values()], [c[1] for c in found.values()])

    return rows.select("text", "y").mapInArrow(work, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1."""
    p = weights / weights.sum()
    low, high = 1e-6, 1.0
    if scores.max() <= 0:
        return 1.0
    with np.errstate(over="ignore"):
        while (p * np.exp(high * scores)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, most_bytes: int = 1 << 27) -> Model:
    written = materialize(training_rows(docs, labels, "toxic", most))
    rows = within_bytes(written, most_bytes)
    totals = {bool(r["toxic"]): r["n"] for r in rows.groupBy((F.col("y") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(False, 0), totals.get(True, 0)
    if not clean or not toxic:
        share = min(max(toxic / max(1, clean + toxic), 1e-6), 1 - 1e-6)
        return Model({}, max(clean, 1), max(toxic, 1), weights=(math.log(share / (1 - share)), 0.0))
    telling = _counts(rows).where((F.col("toxic") >= 2) & (F.col("toxic") * clean > 1.5 * F.col("clean") * toxic))
    kept = telling.toArrow()
    counts = dict(zip(kept.column("token").to_pylist(), zip(kept.column("clean").to_pylist(), kept.column("toxic").to_pylist())))
    plain = Model(counts, clean, toxic)

    # every training row, scored without its own counts: its segment maximum, length and token scores
    @task("toxicity")
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("tops", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("times", pa.list_(pa.int64()))])
        for b in batches:
            out = []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = WORD.findall(text.lower())
                own = {w: plain.word_score(w, int(y == 1)) for w in set(words)}
                s = np.fromiter(map(own.__getitem__, words), float, len(words))
                values, times = np.unique(np.round(s, 1), return_counts=True)
                out.append((y, len(words), top_scores(words, s, plain.drift), values.tolist(), times.tolist()))
            yield batch_of(schema, *(zip(*out) if out else ([],) * 5))

    seen = rows.select("text", "y").mapInArrow(measure, "y int, n long, tops array<double>, values array<double>, times array<long>").toArrow()
    y = seen.column("y").to_numpy() == 1
    n, tops = np.maximum(seen.column("n").to_numpy(), 1), seen.column("tops").to_pylist()
    best = np.array([max(t, default=0.0) for t in tops])
    tally: dict[float, int] = {}
    for is_toxic, values, times in zip(y.tolist(), seen.column("values").to_pylist(), seen.column("times").to_pylist()):
        if not is_toxic:
            for v, t in zip(values, times):
                tally[v] = tally.get(v, 0) + t
    rate = _rate(np.array(sorted(tally)), np.array([tally[k] for k in sorted(tally)], float)) if tally else 1.0
    scale = max(float((~y).sum() / (n[~y] * np.exp(-rate * best[~y])).sum()), 1e-9)
    law = Model(counts, clean, toxic, rate=rate, scale=scale)
    x = np.array([law.strength(t, k) for t, k in zip(tops, n.tolist())])
    discard(docs.sparkSession, written)
    order = np.lexsort((y, x))
    w = logistic(x[order, None], y[order].astype(float), ridge=1e-6)
    return Model(counts, clean, toxic, rate=rate, scale=scale, weights=(float(w[0]), float(max(w[1], 0.0))))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    @task("toxicity")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            x = []
            for text in b.column("text"):
                words = WORD.findall((text.as_py() or "").lower())
                x.append(model.strength(top_scores(words, scorer.scores(words), model.drift), len(words)))
            yield batch_of(schema, b.column("doc_id"), probability(np.array(model.weights), np.array(x, float)[:, None]))

    out = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def passages(docs: DataFrame, model: Model, expectation: float = 0.01) -> DataFrame:
    """Every significant passage: doc_id, first and last+1 character, its score and its expectation in clean text."""
    schema = pa.schema([("doc_id", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("segment_score", pa.float64()), ("expectation", pa.float64())])

    @task("toxicity")
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = list(WORD.finditer((text or "").lower()))
                for f, e, s in maximal_segments(scorer.scores([m[0] for m in found])):
                    if (expected := model.log_expectation(s, len(found))) <= math.log(expectation):
                        out.append((doc, found[f].start(), found[e - 1].end(), s, math.exp(expected)))
            yield batch_of(schema, *(zip(*out) if out else ([],) * 5))

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, char_start long, char_end long, segment_score double, expectation double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more: a filter on the scan, no shuffle."""

    def strength(batches):  # noqa: ANN001, ANN202
        scorer = Scorer(model)
        for texts in batches:
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                words = WORD.findall(text.as_py().lower())
                out[i] = model.strength(top_scores(words, scorer.scores(words), model.drift), len(words))
            yield pa.array(probability(np.array(model.weights), out[:, None]))

    strength = F.arrow_udf(task("toxicity")(strength), "double", ArrowUDFType.SCALAR_ITER)
    return docs.where(strength(F.coalesce("text", F.lit(""))) < threshold)
