"""Mixing to target weights by soft membership.

A classifier fitted on labelled documents gives each document posteriors over domains: ``good``, ``low`` (quality 0) and ``toxic``. It is fitted
on ``SAMPLE`` labelled documents at most, those with the least hashes of their doc_id: half of them give the words that tell a domain from the
others, the other half the weights of a multinomial logistic regression over shares of these words and a few counts. Each document gets a rate r
within 0 and ``most`` (none: unbounded), the number of times it should be seen. The rates solve the least squares problem that the expected
tokens of each domain, sum of r * tokens * posterior over the documents, match the targets, by projected gradient steps from r = 1: each step
subtracts the posteriors' product with the scaled residual and projects onto the bounds. The scale is the inverse Gram matrix of the free
documents, gathered in the same pass as the totals. Rates are functions of a document's posteriors and of the steps so far; nothing but
domain totals and this small matrix goes to the driver.

Nulls count as empty texts, with 0 tokens. Repeated rows each have their rate. Without labelled documents, or with one domain only, all posteriors are
1 for ``good``. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

DOMAINS = ("good", "low", "toxic")
SAMPLE = 20_000
#: Words of the classifier for each domain, and how many documents must have one.
TELLING = 200
LEAST_DOCUMENTS = 5
STEPS = 30
WEIGHTS = {"good": 0.97, "low": 0.025, "toxic": 0.005}
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_CAPITALS = re.compile(r"[A-Z]")


def features(text: str, lexicon: dict[str, int]) -> list[float]:
    words = _LETTERS.findall(text.lower())
    n, tokens = max(1, len(words)), text.split()
    hits = [0] * len(DOMAINS)
    found = [w for w in words if w in lexicon]
    for w in set(found):
        hits[lexicon[w]] += 1
    runs = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    return [
        *(min(h, 10) for h in hits),
        *(h > 0 for h in hits),
        len(found) / n,
        len(_SYMBOLS.findall(text)) / n,
        len(_CAPITALS.findall(text)) / max(1, len(text)),
        text.count("!") / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / n,
        runs / n,
        np.log1p(n),
        len(text) / max(1, len(tokens)) / 10,
        1 - len(set(lines)) / len(lines),
    ]


class Classifier:
    """Multinomial logistic regression over ``features``, standardised."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.weights = lexicon, None

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 400) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        want = np.eye(len(DOMAINS))[y]
        w = np.zeros((x.shape[1], len(DOMAINS)))
        speed = np.zeros_like(w)
        for _ in range(rounds):
            slope = x.T @ (self._soft(x @ w) - want) / len(x) + 1e-4 * w
            speed = 0.9 * speed - 0.3 * slope
            w += speed
        self.weights = w

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.tile(np.eye(len(DOMAINS))[0], (len(texts), 1))
        x = (np.array([features(t, self.lexicon) for t in texts]) - self.mean) / self.scale
        return self._soft(np.hstack([np.clip(x, -8, 8), np.ones((len(texts), 1))]) @ self.weights)


def fitted(docs: DataFrame, labels: DataFrame) -> Classifier:
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(domain).alias("domain"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    # one text of each doc_id, so SAMPLE rows at most
    rows = staged(docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain", "half").agg(F.min("text").alias("text")), "labelled")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    n = rows.where("half = 0").groupBy("domain").count().collect()
    size = np.array([next((r["count"] for r in n if r.domain == d), 0) for d in range(len(DOMAINS))], float)
    counts = rows.where("half = 0").select("domain", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{d}") for d in range(len(DOMAINS))])
    lexicon: dict[str, int] = {}
    for d in reversed(range(len(DOMAINS))):
        if 0 < size[d] < size.sum():
            rest = " + ".join(f"n{e}" for e in range(len(DOMAINS)) if e != d)
            odds = F.log((F.col(f"n{d}") + 0.5) / (size[d] + 1)) - F.log((F.expr(rest) + 0.5) / (size.sum() - size[d] + 1))
            best = counts.where(F.col(f"n{d}") >= LEAST_DOCUMENTS).withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt(f"n{d}")), "word").limit(TELLING)
            for r in best.select("word").collect():
                lexicon.setdefault(r.word, d)
    out = Classifier(lexicon)

    def run(batches):
        for batch in batches:
            made = pa.array([features(text, lexicon) for text in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["domain", "x"])

    train = rows.where("half = 1").select("domain", "text").mapInArrow(run, "domain int, x array<double>").orderBy("domain", "x").collect()
    if len({r.domain for r in train}) > 1:
        out.fit(np.array([r.x for r in train]), np.array([r.domain for r in train]))
    return out


def replayed(tokens: np.ndarray, posteriors: np.ndarray, steps: list[np.ndarray], most: float | None) -> np.ndarray:
    r = np.ones(len(tokens))
    for s in steps:
        r = np.clip(r - posteriors @ s, 0, most)
    return r


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("n_tokens").to_numpy().astype(float), np.stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS], axis=1)


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, most: float | None = None, keep: str | None = None) -> DataFrame:
    """Each document's ``version`` (a hash of its text), tokens, posteriors and rate. The tokens in total stay as they are, or are what leaves domain ``keep`` as it is."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.coalesce(text, F.lit("")).alias("text"))
    model = fitted(docs, labels)
    k = len(DOMAINS)
    kinds = ", ".join(f"p_{d} double" for d in DOMAINS)

    def classify(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if texts:
                p = model.posteriors(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array([len(t.split()) for t in texts], pa.int64()), *[pa.array(p[:, i]) for i in range(k)]], names=["doc_id", "version", "n_tokens", *[f"p_{d}" for d in DOMAINS]])

    rows = staged(docs.mapInArrow(classify, f"doc_id long, version long, n_tokens long, {kinds}"), "posteriors")

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            sums = np.zeros(k + k * k)
            for batch in batches:
                n, p = _columns(batch)
                r = replayed(n, p, steps, most)
                free = n * ((r > 0) if most is None else (r > 0) & (r < most)) if steps else n
                sums += np.concatenate([p.T @ (n * r), (p.T @ (free[:, None] * p)).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

        got = rows.mapInArrow(run, "sums array<double>").agg(*[F.sum(F.col("sums")[i]) for i in range(k + k * k)]).first()
        got = np.array([x or 0.0 for x in got])
        return got[:k], got[k:].reshape(k, k)

    share = np.array([weights[d] for d in DOMAINS]) / sum(weights.values())
    now, gram = totals([])
    whole = now.sum() if keep is None else now[DOMAINS.index(keep)] / share[DOMAINS.index(keep)]
    target, steps = share * whole, []
    miss = float("inf")
    for _ in range(STEPS):
        off = now - target
        if whole <= 0 or np.abs(off).max() <= 1e-4 * whole:
            break
        if np.linalg.norm(off) > miss * 1.0001:  # too far: half the step
            steps[-1] = steps[-1] / 2
        else:
            gained = miss - np.linalg.norm(off) if steps else float("inf")
            if gained < 1e-5 * whole:
                break
            miss = np.linalg.norm(off)
            steps.append(np.linalg.solve(gram + np.eye(k) * (1e-3 * max(1.0, np.trace(gram) / k)), off))
        now, gram = totals(steps)
    final = [s.copy() for s in steps]

    def rated(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replayed(*_columns(batch), final, most))], names=[*batch.schema.names, "rate"])

    return rows.mapInArrow(rated, f"doc_id long, version long, n_tokens long, {kinds}, rate double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("version")
