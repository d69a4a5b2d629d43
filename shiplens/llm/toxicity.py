"""Operator 3: toxic passages as maximum-scoring segments of token log-odds.

A token scores the log-odds of its strongest feature (the word, or its first
six or four letters, so inflected and compounded forms count) between toxic and
clean labelled documents, smoothed by a Dirichlet prior; features whose log-odds
are not significant score a small negative constant. A linear-time scan finds
all maximal-scoring segments of a document. Segment scores are calibrated by
extreme-value theory: with lambda from the score distribution of clean tokens,
the expected number of segments as good by chance in a text of n tokens is
n * exp(-lambda * score); segments that stay under the significance level are
the toxic passages. A document's evidence is the sum of their excess over
chance; a logistic curve, fitted on the labelled documents, maps it to 0..1.

The model is fitted on a bounded sample of the labelled documents, at most
``sample`` per class with the smallest hashes; exact copies count once. Only
documents whose crc32(doc_id) mod 3 is not 1 are learnt from. Every document is
scored whole, in one pass without a shuffle.

Edge cases: null or empty text has no token and gets the curve's lowest score;
without labels of both classes every score is 0; null labels are skipped, and a
document labelled both ways counts as toxic; repeated rows are scored alike;
null ``doc_id`` is scored, never learnt from; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (6, 4)


def features(word: str) -> list[str]:
    """A word's features, most specific first; a prefix carries its length."""
    return [word] + [f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n]


@dataclass
class Model:
    """Significant features and the calibration; its size is bounded by the sample."""

    weight: dict[str, float] = field(default_factory=dict)
    other: float = -0.05  # any other token
    lam: float = 1.0
    level: float = 0.05
    curve: tuple[float, float] | None = None  # intercept and slope

    def token_score(self, word: str) -> float:
        return max((self.weight.get(f, self.other) for f in features(word)), default=self.other)

    def segments(self, scores: list[tuple[int, float]], n: int) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (first token, last token, score) of a
        text of ``n`` tokens; ``scores`` lists its positive tokens. Others score
        ``other``, so runs of them are taken as one step: linear time in all.
        """
        # first, last, sum before, sum after, nearest earlier entry with a smaller sum before
        stack: list[tuple[int, int, float, float, int]] = []
        total, at = 0.0, 0
        for i, w in scores:
            total += self.other * (i - at)
            at = i + 1
            first, low, high = i, total, total + w
            total = high
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= low:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= high:
                    break
                first, low = stack[j][0], stack[j][2]
                del stack[j:]
            stack.append((first, i, low, high, j))
        return [(a, b, high - low) for a, b, low, high, _ in stack]

    def passages(self, text: str, memo: dict[str, float]) -> tuple[list, int]:
        """Significant segments (first token, last token, nats over chance), and the number of tokens."""
        words = TOKEN.findall(text.lower())
        found = []
        for i, w in enumerate(words):
            s = memo.get(w)
            if s is None:
                s = self.token_score(w)
                if len(memo) < 300_000:
                    memo[w] = s
            if s > 0:
                found.append((i, s))
        if not found:
            return [], len(words)
        chance = math.log(len(words) / self.level)
        return [(a, b, self.lam * s - chance) for a, b, s in self.segments(found, len(words))
                if self.lam * s > chance], len(words)

    def score(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.curve[0] + self.curve[1] * math.log1p(evidence)))))


def _remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 3


def held_out():
    return F.coalesce(_remainder() == 1, F.lit(False))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Logistic regression of y on x, with a ridge on the slope (Newton's method)."""
    design = np.column_stack((np.ones_like(x), x))
    w, penalty = np.zeros(2), np.diag([1e-3, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty,
                               design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, min_docs: int = 4, min_z: float = 2.5,
        min_odds: float = 2.0, prior: float = 0.5) -> Model:
    """The model from labelled documents that are not held out."""
    known = (labels.where("doc_id is not null and toxic is not null").where(_remainder() != 1)
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    draw = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    chosen = [known.where(c).orderBy(draw, "doc_id").limit(sample) for c in ("toxic = 1", "toxic = 0")]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows of 12 bytes
    texts = (docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).join(picked, "doc_id")
             .groupBy(F.xxhash64("text").alias("copy")).agg(F.min_by("text", "doc_id").alias("text"),
                                                            F.max("toxic").alias("toxic")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = TOKEN.findall(text)
                for f in {f for w in set(words) for f in features(w)}:
                    n = found.setdefault(f, [0, 0])
                    n[toxic] += 1
            n_clean = sum(len(TOKEN.findall(t)) for t, y in zip(batch["text"], batch["toxic"]) if not y)
            rows = [(f, a, b) for f, (a, b) in found.items()]
            rows += [("\tdocs", int((batch["toxic"] == 0).sum()), int((batch["toxic"] == 1).sum())),
                     ("\ttokens", n_clean, 0)]
            yield pd.DataFrame(rows, columns=["feature", "clean", "toxic"])

    counts = (texts.mapInPandas(count, "feature string, clean bigint, toxic bigint").groupBy("feature")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .where(f"toxic >= {min_docs} or feature like '\t%'").toPandas())  # bounded by the sample
    counts = counts.set_index("feature")
    sizes = counts.loc["\tdocs"] if "\tdocs" in counts.index else {"clean": 0, "toxic": 0}
    model = Model()
    if not sizes["clean"] or not sizes["toxic"]:
        return model
    tokens = float(counts.loc["\ttokens", "clean"])
    c = counts[~counts.index.str.startswith("\t")]
    # Dirichlet prior on both classes: pseudo-documents with and without the feature.
    t1, c1 = c["toxic"] + prior, c["clean"] + prior
    t0, c0 = sizes["toxic"] - c["toxic"] + prior, sizes["clean"] - c["clean"] + prior
    odds = np.log(t1 / t0) - np.log(c1 / c0)
    keep = (odds >= min_odds) & (odds / np.sqrt(1 / t1 + 1 / c1) >= min_z)
    model.weight = odds[keep].to_dict()
    if not model.weight:
        return model
    # Lambda: the positive root of sum(p * exp(lambda * score)) = 1 over clean tokens; each
    # feature's share of them is at most its clean documents' (one pseudo-token in all besides).
    share = (c["clean"][keep].sum() + 1.0) / (tokens + 1.0)
    best = float(odds[keep].mean())
    model.other = -max(0.05, 2 * share * best)  # clean text must drift down
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        if share * math.exp(min(700.0, mid * best)) + (1 - share) * math.exp(mid * model.other) > 1:
            high = mid
        else:
            low = mid
    model.lam = low

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for batch in batches:
            x = [sum(s for _, _, s in model.passages(t, memo)[0]) for t in batch["text"]]
            yield pd.DataFrame({"x": x, "y": batch["toxic"]})

    seen = texts.select("text", "toxic").mapInPandas(evidence, "x double, y int").toPandas()  # the sample
    model.curve = _fit_curve(np.log1p(seen["x"].to_numpy(float)), seen["y"].to_numpy(float))
    return model


_SCORED = ("doc_id bigint, score double, n_tokens bigint, "
           "passages array<struct<start:int,end:int,nats:double>>")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``score``, ``n_tokens`` and the toxic
    ``passages`` (code points, end exclusive, nats over chance)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found, n = model.passages(text, memo)
                spans = []
                if found:
                    lower = text.lower()
                    at = [m.span() for m in TOKEN.finditer(lower)]
                    spans = [(at[a][0], at[b][1], s) for a, b, s in found]
                rows.append((None if pd.isna(doc) else doc, model.score(sum(s for _, _, s in found)), n, spans))
            out = pd.DataFrame(rows, columns=["doc_id", "score", "n_tokens", "passages"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, _SCORED)


def digest(scored: DataFrame, cut: float = 0.7) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"), "n_tokens", "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """``docs``, all columns, without the documents scored at ``cut`` or more.
    The score is computed beside the row, so nothing is joined by id."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array(
                [model.score(sum(s for _, _, s in model.passages(t or "", memo)[0])) < cut for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
