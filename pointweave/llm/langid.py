"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of DIM entries +1 or -1 (blanks and other characters share one). A trigram's vector
binds its letters by multiplying them, the first shifted by two places and the second by one. A document bundles, that is
adds, its trigram vectors; a language's prototype bundles those of its learning documents, each at length one. A document
is given the language whose prototype has the largest cosine with it; the least in code point order wins a tie.

Letters up to U+017F are taken without case, each base letter as a class of its own; later code points are taken as they are, capital
and small ones apart, and share classes by a fixed hash. Runs of
other characters count as one blank; a text begins and ends with a blank. score is the best cosine's share after a softmax
over the languages at TEMPERATURE, so it lies between 0 and 1.

Defined cases: null texts and texts without a letter give `und` and score 0; without learning rows every document is `und`;
null languages are not learned; equal texts get equal results. Prototypes are sums over all learning rows: each task sends
one vector per language. One pass for learning, one for predicting, no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mix64, seeded

DIM, CLASSES, TEMPERATURE, UNKNOWN = 256, 64, 0.05, "und"
CHUNK = 1 << 18


def _classes() -> np.ndarray:
    """Letter class of each code point; 0: not a letter."""
    points = np.arange(0x110000)
    out = (mix64(points.astype(np.uint64)) % np.uint64(CLASSES - 30) + np.uint64(30)).astype(np.uint8)
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    for i in range(0x180):
        low = chr(i).lower()[0]
        if "a" <= low <= "z":
            out[i] = 1 + ord(low) - 97
        else:
            out[i] = out[ord(low)]
    out[~alpha] = 0
    return out


def vectors(dim: int = DIM) -> np.ndarray:
    """CLASSES ** 3 by dim, int8: the trigram vectors, made from the letter vectors by shifts and products."""
    bits = seeded(CLASSES * dim, 12345).reshape(CLASSES, dim)
    letter = np.where(bits >> np.uint64(63), 1, -1).astype(np.int8)
    two = (np.roll(letter, 2, axis=1)[:, None, :] * np.roll(letter, 1, axis=1)[None, :, :]).reshape(-1, dim)
    return (two[:, None, :] * letter[None, :, :]).reshape(-1, dim)


class Encoder:
    """Bundles texts; made once in a task, as its tables take about 70 MB."""

    _own: dict[int, Encoder] = {}

    def __init__(self, dim: int):
        self.dim, self.classes, self.vectors = dim, _classes(), vectors(dim)

    @classmethod
    def get(cls, dim: int = DIM) -> Encoder:
        if dim not in cls._own:
            cls._own[dim] = cls(dim)
        return cls._own[dim]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the text's trigram vectors; None without a letter."""
        c = self.classes[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
        if not c.any():
            return None
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = np.concatenate([[0], c[keep], [0]]).astype(np.uint32)
        t = (c[:-2] * np.uint32(CLASSES) + c[1:-1]) * np.uint32(CLASSES) + c[2:]
        out = np.zeros(self.dim, np.float64)
        for i in range(0, len(t), CHUNK):
            part = np.sort(t[i : i + CHUNK])
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            out += np.diff(at, append=len(part)).astype(np.float32) @ self.vectors[part[at]].astype(np.float32)
        return out


def learn(docs: DataFrame, among: Column, dim: int = DIM) -> dict[str, np.ndarray]:
    """The prototypes of the languages of the rows that `among` selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            encoder = Encoder.get(dim)
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = encoder.bundle(text)
                if v is not None and (n := np.linalg.norm(v)):
                    # whole numbers add up alike in any order
                    sums[lang] = sums.get(lang, np.zeros(dim, np.int64)) + np.rint(v / n * (1 << 20)).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = docs.where(among & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(run, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([x["x"] for x in r["v"]], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str] | None = None, dim: int = DIM) -> DataFrame:
    """The kept columns (all, if not said), lang_pred and score; columns with those names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = sorted(prototypes)
    unit = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = Encoder.get(dim)
            langs, scores = [], []
            for text in b.column(0).to_pylist():
                v = encoder.bundle(text) if names else None
                n = 0.0 if v is None else np.linalg.norm(v)
                if not n:
                    langs.append(UNKNOWN if v is None else names[0])
                    scores.append(0.0)
                    continue
                cosines = unit @ (v / n)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(float(1 / np.exp((cosines - cosines[best]) / TEMPERATURE).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, schema)
