"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs that skip one word.
Training takes a bounded sample of the labelled rows, drawn by a hash of the id: FTRL-proximal
is sequential, so one task runs it, with per-coordinate rates and L1, over at most
``SAMPLE_ROWS`` rows whatever the corpus. The weights that are not zero, a few hundred and by
construction at most ``BUCKETS``, are broadcast for scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, field_of, small_batches

BUCKETS = 1 << 20
#: Most labelled rows (in expectation) that a fit reads; the sample is by hash of the id.
SAMPLE_ROWS = 16_000
#: Passes over the sample, and the weight of a toxic row, which are few, in the gradient.
EPOCHS, TOXIC_WEIGHT = 3, 3.0
ALPHA, BETA, L1, L2 = 4.0, 1.0, 16.0, 0.0
THRESHOLD = 0.7
CACHE = 100_000
BIAS = BUCKETS

#: ASCII letters in lower case, other bytes of words as they are, all else a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def feature_ids(text: bytes | None, hashes: dict) -> np.ndarray:
    """Buckets of all words, pairs and skip-pairs of a text, repeats included."""
    words = text.translate(_WORD_BYTES).split() if text else []
    h = np.array([hashes[w] for w in words], np.uint64)
    if len(h) < 2:
        grams = [h]
    else:
        grams = [h, (h[:-1] * _PRIME) ^ (h[1:] + np.uint64(1)), (h[:-2] * _PRIME) ^ (h[2:] + np.uint64(2))]
    mixed = np.concatenate(grams) * _PRIME
    return (mixed >> np.uint64(44)).astype(np.int32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Dense weights after EPOCHS passes over (distinct buckets, label) rows."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, label = rows[i]
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            gap = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            if label:
                gap *= TOXIC_WEIGHT
            after = ni + gap * gap
            z[at] = zi + gap - (np.sqrt(after) - np.sqrt(ni)) / ALPHA * w
            n[at] = after
    return _weights(z, n)


def _features(batches):
    """Distinct buckets of each text instead of the text."""
    hashes = _Hashes()
    for batch in batches:
        found = [np.unique(feature_ids(t, hashes)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        buckets = pa.array(found, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), buckets], names=["order", "toxic", "buckets"])


def _fit_sample(table: pa.Table) -> pa.Table:
    table = table.sort_by([("order", "ascending"), ("toxic", "ascending")])
    rows = [
        (np.append(np.asarray(b, np.int32), np.int32(BIAS)), y)
        for b, y in zip((x.values.to_numpy() for x in table.column("buckets")), table.column("toxic").to_pylist())
    ]
    w = ftrl(rows)
    at = np.flatnonzero(w)
    return pa.table({"bucket": pa.array(at, pa.int32()), "weight": pa.array(w[at], pa.float64())})


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Sparse weights ``bucket, weight`` from labelled rows; null labels and texts are left out."""
    small_batches(train.sparkSession)
    rows = train.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    found = rows.count()
    kept = min(1.0, SAMPLE_ROWS / max(found, 1))
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1 << 30))
    sample = rows.where(spot < int(kept * (1 << 30))).select(
        F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("toxic"), F.xxhash64(F.col(id_col)).alias("order")
    )
    # the one task that fits gets integers, at most SAMPLE_ROWS rows (in expectation) of at most BUCKETS
    features = sample.mapInArrow(_features, "order bigint, toxic int, buckets array<int>")
    return features.groupBy(F.lit(0).alias("sample")).applyInArrow(_fit_sample, "bucket int, weight double")


def _score(weights, text_col):
    def run(batches):
        at, value = weights.value
        dense = np.zeros(BUCKETS + 1)
        dense[at] = value
        live = dense != 0
        bias, hashes = dense[BIAS], _Hashes()
        for batch in batches:
            out = []
            for text in field_of(batch, text_col).cast(pa.binary()).to_pylist():
                ids = feature_ids(text, hashes)
                total = bias + dense[np.unique(ids[live[ids]])].sum()
                out.append(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, weights: DataFrame, text_col: str | tuple[str, ...] = "text") -> DataFrame:
    """``docs`` with a column ``score`` in 0 to 1, higher for label 1.

    ``text_col`` is a column, or the path of a field in one. Null and empty texts hold the
    bias alone. A column ``score`` that is there already is replaced; repeated rows score
    alike; an empty table gives an empty result; without any labelled row every score is 0.5.
    """
    small_batches(docs.sparkSession)
    rows = weights.collect()  # at most BUCKETS + 1 rows, whatever the corpus
    table = docs.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)))
    packed = as_row(docs, "score")
    schema = packed.select("row").schema.add("score", "double")
    return packed.mapInArrow(_score(table, text_col), schema).select("row.*", "score")
