"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

features() describes a text by shares that do not depend on its language. learn() draws a bounded sample of labelled rows,
pairs preferred (label 1) with other (label 0) documents, and fits weights by the logistic loss on feature differences
(Newton steps with a ridge). The cutoff is a quantile of the sample's latent scores: the one at the sample's share of label
0, moved within SEARCH of it to where the two classes' errors balance best. score() maps the latent score through a logistic
whose value at the cutoff is THRESHOLD, so that `score >= THRESHOLD` is the quantile rule.

Bounds: at most SAMPLE labelled documents (the smallest salted hashes of doc_id, the same at each run) and PAIRS pairs.
Defined cases: null text counts as empty and is scored like any other; without labels of both kinds every score is
THRESHOLD (nothing is rejected); documents with null ids are scored but never learned from; several label rows of one
document count as their maximum; equal texts have equal scores. Scoring is one pass, no shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import lean
from .rules import counts_of

THRESHOLD, SAMPLE, PAIRS, SEARCH, RIDGE = 0.7, 20_000, 200_000, 0.05, 1e-3
NAMES = (
    "symbols", "marks", "upper", "dup_lines", "repeats", "top_word", "distinct", "word_length", "long_words", "digits", "punctuation", "log_words",
    "short", "stops", "blanks", "line_words",
)
_DIGITS, _PUNCTUATION = b"0123456789", b".,;:!?\"'()[]{}"


def features_of(raw: bytes) -> list[float]:
    """NAMES for one text's UTF-8 bytes; all but the two logarithms are shares, 0 for an empty text."""
    n, chars, symbols, dup, repeat, lines, upper, letters, marks = counts_of(raw)
    if not n:
        return [0.0] * len(NAMES)
    words = raw.split()
    kinds = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    size = len(raw)
    most = max(kinds.values())
    return [
        math.sqrt(symbols / chars), math.sqrt(min(1.0, marks / n)), math.sqrt(upper / max(1, letters)), dup / max(1, lines), repeat / n, math.sqrt(most / n), len(kinds) / n,
        math.log(chars / n), float((sizes > 20).mean()), math.sqrt((size - len(raw.translate(None, _DIGITS))) / size), math.sqrt((size - len(raw.translate(None, _PUNCTUATION))) / size),
        math.log1p(n), float(n < 20), float((sizes <= 3).mean()), (size - len(raw.translate(None, b" \t\r\n"))) / size, math.log1p(n / max(1, lines)),
    ]


@dataclass(frozen=True)
class Model:
    """Latent score: standardised features times weights; slope and cutoff turn it into a score."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cutoff: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - np.array(self.mean)) / np.array(self.scale)).clip(-8, 8) @ np.array(self.weights)
        t = np.clip(self.slope * (z - self.cutoff) + math.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)
        # t >= log-odds must give a score >= THRESHOLD in spite of rounding
        s = 1 / (1 + np.exp(-t))
        return np.where(z >= self.cutoff, np.maximum(s, THRESHOLD), np.minimum(s, np.nextafter(THRESHOLD, 0)))


NOTHING = Model((0.0,) * len(NAMES), (1.0,) * len(NAMES), (0.0,) * len(NAMES), 0.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Weights from pairs of a row with y = 1 and a row with y = 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return NOTHING
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w)), d.T @ (1 - p) / pairs - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    latent = z @ w
    share = len(bad) / len(y)
    levels = np.unique(np.clip(np.linspace(share - SEARCH, share + SEARCH, 201), 0.0, 1.0))
    cuts = np.quantile(latent, levels)
    lost, let = np.array([(latent[good] < c).mean() for c in cuts]), np.array([(latent[bad] >= c).mean() for c in cuts])
    best = np.flatnonzero(lost + let <= (lost + let).min() + 1e-12)
    cutoff = float(cuts[best[len(best) // 2]])
    return Model(tuple(mean), tuple(scale), tuple(w), cutoff, 1.0)


def _features(docs: DataFrame, keep: list[str]) -> DataFrame:
    schema = docs.select(*keep).schema.add("features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features_of(t or b"") for t in b.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.list_(pa.float64()))], [*keep, "features"])

    return docs.select("text", *keep).mapInArrow(lean(run), schema)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled rows; labels: doc_id, label (1 preferred, 0 not)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = labels.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(sample)  # bounded, so it is broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # rows of one document that repeat count once, so that the bound holds: the one with the least features stands
    described = _features(texts, ["doc_id", "label"]).groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("r"))
    rows = described.orderBy("doc_id").select("r.features", "r.label").collect()
    if not rows:
        return NOTHING
    return fit(np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if not said) and score; a column of that name is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features_of(t or b"") for t in b.column(0).cast(pa.large_binary()).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(x), pa.float64())], [*keep, "score"])

    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(lean(run), schema)
