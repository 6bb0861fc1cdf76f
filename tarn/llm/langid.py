"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of 1 to 3 characters present in
both (hashed to BUCKETS), over the root of the product of how many each has.
Landmark texts give the Nyström features, and ridge regression with one target
for each language against the rest is fitted on them. A batch of texts is a
matrix of presences: one product with the landmarks and one with the weights
score it.

Training takes a bounded sample: at most PER_LANGUAGE labelled texts of each
language, those of least hash, of which the first LANDMARKS are landmarks; with
many languages fewer of each, SAMPLED texts and MOST_LANDMARKS landmarks in all.
Only their presences, at most BUCKETS numbers a text, come to the driver, and the
model goes to the workers as a broadcast of at most MOST_LANDMARKS * BUCKETS
numbers, at any size of input.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text when nothing could be learned, as from an empty table; ties go to
the language that sorts first; repeated rows are one text of the sample and get
one prediction; texts of any length are read whole; other columns come back
unchanged, but those named lang_pred and score (in any case) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, arrow_map, rows_of

PER_LANGUAGE = 300
LANDMARKS = 40
SAMPLED = 12_000
MOST_LANDMARKS = 400
BUCKETS = 1 << 17
RIDGE = 1e-2
ROWS = 256


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def buckets(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text, repeats included."""
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
    h = np.concatenate([one, two, three])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(47)).astype(np.int64)


@dataclass
class Model:
    """Columns of the buckets that landmarks have, the landmarks' presences, and weights."""

    names: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    size: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[str | np.ndarray]) -> np.ndarray:
        """Kernel values of texts, or of their buckets, with the landmarks."""
        x = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        n = np.ones(len(texts), np.float32)
        seen = np.zeros(BUCKETS, bool)
        for i, t in enumerate(texts):
            found = t if isinstance(t, np.ndarray) else buckets(t)
            seen[found] = True
            n[i] = max(1, np.count_nonzero(seen))
            seen[found] = False
            at = self.column[found]
            x[i, at[at >= 0]] = 1
        return (x @ self.landmarks.T) / np.sqrt(np.outer(n, self.size))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.names else []
        for lo in range(0, len(known), ROWS):
            part = known[lo : lo + ROWS]
            s = self.kernel([texts[i] for i in part]).astype(np.float64) @ self.weights
            e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
            p = e / e.sum(axis=1, keepdims=True)
            for i, k in zip(part, s.argmax(axis=1), strict=True):
                names[i] = self.names[k]
            for i, v in zip(part, p.max(axis=1), strict=True):
                scores[i] = float(v)
        return names, scores


def fit(samples: dict[str, list[str | np.ndarray]]) -> Model:
    """A model of labelled texts, or of their buckets; languages in sorted order."""
    names = sorted(k for k, v in samples.items() if v)
    if not names:
        return Model([], np.full(BUCKETS, -1), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0)))
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(names)))
    if len(names) > MOST_LANDMARKS:
        raise ValueError(f"{len(names)} languages; a model has at most {MOST_LANDMARKS} landmarks")
    chosen = [t for k in names for t in samples[k][:each]]
    found = [np.unique(t if isinstance(t, np.ndarray) else buckets(t)) for t in chosen]
    union = np.unique(np.concatenate(found))
    column = np.full(BUCKETS, -1)
    column[union] = np.arange(len(union))
    landmarks = np.zeros((len(chosen), len(union)), np.float32)
    for i, b in enumerate(found):
        landmarks[i, column[b]] = 1
    model = Model(names, column, landmarks, np.array([max(1, len(b)) for b in found], np.float32), np.zeros((0, 0)))
    texts = [t for k in names for t in samples[k]]
    target = np.array([[1.0 if k == own else -1.0 for own in names] for k in names for _ in samples[k]])
    value, vector = np.linalg.eigh(model.kernel(chosen).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))
    phi = model.kernel(texts).astype(np.float64) @ root
    ridge = np.linalg.solve(phi.T @ phi + RIDGE * len(texts) * np.eye(phi.shape[1]) / len(names), phi.T @ target)
    model.weights = root @ ridge
    return model


PRESENT = "lang string, low long, rank long, buckets array<int>"


def sample(df: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang") -> dict[str, list[np.ndarray]]:
    """Buckets of at most per_language different texts of each language, those of least hash."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    # Different texts count, so that copies of one text do not crowd out the rest.
    counts = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    if not counts:
        return {}
    per_language = max(1, min(per_language, SAMPLED // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * per_language + 50) / n)))])
    rank = F.xxhash64("text")
    near = rows.filter(F.pmod(rank, F.lit(1 << 30)) <= share[F.col("lang")] * (1 << 30))
    # Copies fall together before they are gathered, so a hot text counts once.
    once = near.groupBy("lang", F.pmod(rank, F.lit(1 << 30)).alias("low"), rank.alias("rank")).agg(F.first("text").alias("text"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = batch.column(3).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            found = pa.array([np.unique(buckets(texts[i])).astype(np.int32) for i in keep], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in range(3)), found], names=["lang", "low", "rank", "buckets"])

    found: dict[str, list] = {}
    for r in arrow_map(once, present, PRESENT).toLocalIterator():
        found.setdefault(r.lang, []).append((r.low, r.rank, np.array(r.buckets, np.int64)))
    return {k: [b for _, _, b in sorted(v, key=lambda x: x[:2])[:per_language]] for k, v in found.items()}


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list[list]:
        return [*held.value.predict(texts)]

    return add_columns(df, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


