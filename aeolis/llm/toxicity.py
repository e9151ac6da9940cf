"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolis.llm.common import bound_batches, fold, stage, text_slices, without

#: Bound of the labelled sample that the model is fitted on: about so many documents of each class, chosen by a hash of the id.
SAMPLE = 4000
#: Least |z| of a feature, pseudo-documents of the prior, what every token costs, largest expected chance passages per document.
LEAST_Z, PRIOR, COST, CHANCE = 3.0, 50.0, 1.0, 0.01
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word and its beginnings: words not met before are judged by how they begin."""
    return [word, *(f"{word[:n]}*" for n in (5, 4) if len(word) > n)]


@dataclass
class Model:
    """odds: feature -> log-odds, cautiously. rate, place: Gumbel law of chance passages. slope, base: to a probability."""

    odds: dict[str, float]
    rate: float = 1.0
    place: float = 0.0
    slope: float = 1.0
    base: float = 0.0

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        return next((self.odds[f] for f in features(word) if f in self.odds), 0.0) - COST

    def tokens(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if len(self.known) > 500_000:
            self.known = {}
        for w in [w for w in set(words) if w not in self.known]:
            self.known[w] = self.word(w)
        scores = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        met: Counter = Counter()
        for i in np.flatnonzero(scores > 0).tolist():  # a word's n-th occurrence counts 1 / n: repeated lines prove little
            met[words[i]] += 1
            scores[i] = (scores[i] + COST) / met[words[i]] - COST
        return scores

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """(begin, end, evidence) of the significant passages; evidence is minus the log of the expected chance passages as good."""
        n = max(1, len(scores))
        found = [(b, e, self.rate * s - math.log(n) - self.place) for b, e, s in segments(scores)]
        return [p for p in found if p[2] >= -math.log(CHANCE)]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, self.slope * math.asinh(evidence) + self.base))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, sum) in linear time: no segment of another such one scores more.

    Only runs of positive tokens are visited; a run is kept, or joined with the earlier ones whose loss in between it makes up for.
    """
    positive = np.flatnonzero(np.diff(np.concatenate([[False], scores > 0, [False]]).astype(np.int8)))
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float]] = []
    for begin, end in zip(positive[::2].tolist(), positive[1::2].tolist(), strict=True):
        low, high = float(total[begin]), float(total[end])
        at = len(kept) - 1
        while at >= 0:
            if kept[at][2] >= low:
                at -= 1
            elif kept[at][3] >= high:
                break
            else:
                begin, low = kept[at][0], kept[at][2]
                del kept[at:]
                at = len(kept) - 1
        kept.append((begin, end, low, high))
    return [(b, e, h - lo) for b, e, lo, h in kept]


def log_odds(counts: dict[str, tuple[int, int]], docs: tuple[int, int]) -> dict[str, float]:
    """Log-odds of the features under a Dirichlet prior shaped like the whole sample, less one deviation; 0 if insignificant.

    ``counts``: documents of either class that hold the feature. The prior has PRIOR pseudo-documents in each class.
    """
    out, (clean, toxic) = {}, docs
    for f, (a, b) in counts.items():
        prior = PRIOR * (a + b + 1) / (clean + toxic + 2)
        t, c = b + prior, a + prior
        odds = math.log(t / (toxic + PRIOR - t)) - math.log(c / (clean + PRIOR - c))
        spread = math.sqrt(1 / t + 1 / c)
        if abs(odds) / spread >= LEAST_Z:
            out[f] = odds - math.copysign(spread, odds)
        elif a + b >= 20:  # often enough to be known as neutral; what is rarer is judged by its beginning
            out[f] = 0.0
    return out


def _rate(scores: np.ndarray) -> float:
    """The positive root of mean(exp(x * score)) = 1 over tokens of clean texts (mean score negative); 4 if chance never scores."""
    low, high = 0.0, 4.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if float(np.mean(np.exp(np.minimum(700, mid * scores)))) <= 1 else (low, mid)
    return max(0.05, low)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on labelled documents outside the held-out fold: two thirds for the log-odds, one third for the calibration.

    None without both classes. Rows without id or label take no part; of repeated labels of an id the highest counts.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    known = stage(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = stage(known.where(place < share).select(F.col("doc_id").alias("of"), "toxic"), "toxic-chosen")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("of"))
    # Copies would count a chance word many times: of texts that share the three least hashes of their words, one is fitted on.
    sketch = F.slice(F.array_sort(F.array_distinct(F.transform(F.split(F.lower("text"), r"\\W+"), lambda w: F.crc32(w.cast("binary"))))), 1, 3)
    texts = texts.groupBy(sketch.cast("string").alias("sketch"), F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text"))
    texts = stage(texts.withColumn("fit", F.pmod(F.xxhash64("sketch"), F.lit(3)) < 2), "toxic-sample")

    def count(batches):
        held: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                held[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
        names = list(held[0].keys() | held[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([h[f] for f in names], pa.int64()) for h in held)], ["f", "clean", "toxic"])

    counted = texts.where("fit").select("text", "toxic").mapInArrow(count, "f string, clean long, toxic long")
    counted = counted.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 5")
    docs_of = {r["toxic"]: r["n"] for r in texts.where("fit").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = counted.toArrow()  # features of the bounded sample
    counts = dict(zip(rows["f"].to_pylist(), zip(rows["clean"].to_pylist(), rows["toxic"].to_pylist(), strict=True), strict=True))
    model = Model(log_odds(counts, (docs_of.get(0, 0), docs_of.get(1, 0))))

    def measure(batches):
        own = Model(model.odds)
        for b in batches:
            out = []
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                s = own.tokens(text)
                out.append((toxic, len(s), [x[2] for x in segments(s)], s[:: max(1, len(s) // 200)].tolist()))
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["toxic", "n", "segments", "some"])

    rest = texts.where("not fit").select("text", "toxic").mapInArrow(measure, "toxic int, n long, segments array<double>, some array<double>")
    return calibrate(model, [(r["toxic"], r["n"], r["segments"], r["some"]) for r in rest.collect()])  # bounded by the sample


def calibrate(model: Model, rows: list[tuple[int, int, list[float], list[float]]]) -> Model:
    """Gumbel law of the best passage of clean texts, then a logistic curve over the evidence of all calibration texts."""
    clean = [r for r in rows if r[0] == 0]
    tokens = np.concatenate([r[3] for r in clean] or [[]])
    if len(tokens):
        model.rate = _rate(tokens)
        best = np.array([model.rate * max(r[2], default=0.0) - math.log(max(1, r[1])) for r in clean])
        model.place = float(best.mean() - 0.5772156649 * best.std() * math.sqrt(6) / math.pi)
    x = np.arcsinh([aggregate(model, n, s) for _, n, s, _ in rows])
    y = np.array([t for t, *_ in rows], float)
    if len(x):
        mean, spread = x.mean(), max(x.std(), 1e-9)
        z, w = (x - mean) / spread, np.zeros(2)
        design = np.stack([z, np.ones_like(z)], axis=1)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(50):  # Newton steps of a lightly damped logistic regression with balanced classes
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (weight * (p - y)) + 0.5 * w
            w -= np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2), grad)
        model.slope, model.base = float(w[0] / spread), float(w[1] - w[0] * mean / spread)
    return model


def aggregate(model: Model, n: int, sums: list[float]) -> float:
    """Evidence of a text: minus the log of the odds that chance gives its r best passages, for the r that is best.

    The sum of r normalised passages, T, exceeds a value by chance with odds exp(-T) T^(r-1) / (r! (r-1)!).
    """
    x = sorted((model.rate * s - math.log(max(1, n)) - model.place for s in sums), reverse=True)
    if not x or x[0] <= 0:
        return min(0.0, x[0] if x else -math.log(max(1, n)) - model.place)
    best, total = 0.0, 0.0
    for r, one in enumerate(x, 1):
        total += one
        if total <= 0:
            break
        best = max(best, total + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(max(total, 1.0)))
    return best


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from ``threshold``) and passages (begin and end in words, evidence).

    Only the text is read. NULL and empty texts have no passage and get the score of no evidence; without a model the score is 0.
    Other columns are kept, except those of these names. Rows, repeated or not, are scored one by one.
    """
    bound_batches(docs.sparkSession)
    base = without(docs, ["score", "predicted", "passages"])
    kept = base.columns
    fields = base.schema.fields
    text = next((f for f in kept if f.lower() == "text"), None)

    def run(batches):
        own = Model(model.odds, model.rate, model.place, model.slope, model.base) if model else None
        for b in text_slices(batches, text):
            scores, found = [], []
            for t in b[text].to_pylist():
                if own is None:
                    scores.append(0.0)
                    found.append([])
                    continue
                s = own.tokens(t or "")
                parts = segments(s)
                scores.append(own.probability(aggregate(own, len(s), [p[2] for p in parts])))
                found.append([{"begin": i, "end": j, "evidence": e} for i, j, e in own.passages(s)])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(found, kind)],
                names=[*kept, "score", "predicted", "passages"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return base.mapInArrow(run, schema + ", score double, predicted int, passages array<struct<begin:long,end:long,evidence:double>>")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (a document without id is never held out)."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    return score(rows, model).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
