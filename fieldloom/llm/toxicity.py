"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A bounded sample of labelled rows is fitted: the n-grams that a text has (hashed, present or not) count by label, their
smoothed log-count ratios scale the features, and a logistic regression on the scaled features is trained on them.
Whole texts are scored; only the fixed weight vector goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, bounded_batches, written

SIZES = (3, 4, 5)
#: Bits of a hashed n-gram: the weight vector has 2 ** BITS entries.
BITS = 19
#: Tasks that count the sample's n-grams; each sends its counts to the driver.
SAMPLE_TASKS = 4
_A = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Distinct hashed character n-grams of a text, in lower case, of all sizes."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        found = []
        h, shift = c, np.uint64(64 - BITS)
        for n in range(2, max(SIZES) + 1):
            if len(c) < n:
                break
            h = h[:-1] * _A + c[n - 1 :]
            if n in SIZES:
                found.append(((h ^ (h >> np.uint64(29))) * _A >> shift).astype(np.int32))
        if not found:
            return np.empty(0, np.int32)
        at = np.concatenate(found)
        self.seen[at] = True
        out = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[at] = False
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features].sum(dtype=np.float64), -40, 40))))


@dataclass
class Selection:
    """The n-grams that take part, and their log-count ratios."""

    grams: np.ndarray
    ratios: np.ndarray


def select(pos: np.ndarray, neg: np.ndarray, p: int, n: int, evidence: float = 3.0) -> Selection:
    """From document counts by n-gram in p rows of label 1 and n of label 0: those whose shares differ by `evidence` standard errors."""
    ratio = np.log((pos + 1) / (p + 2)) - np.log((neg + 1) / (n + 2))
    share = (pos + neg + 1) / (p + n + 2)
    z = np.abs(pos / p - neg / n) / np.sqrt(share * (1 - share) * (1 / p + 1 / n) + 1e-12)
    keep = np.flatnonzero(z >= evidence)
    return Selection(keep.astype(np.int32), ratio[keep])


def fit(rows: list[np.ndarray], labels: np.ndarray, chosen: Selection, odds: float, penalty: float = 0.3, steps: int = 400) -> Model:
    """Logistic regression on the chosen n-grams scaled by their ratios. rows: places in the selection; labels weigh as
    much as each other, and the odds of label 1 among all training rows go into the bias."""
    y, m, p = labels.astype(np.float64), len(labels), float(labels.sum())
    col = np.concatenate(rows)
    row = np.repeat(np.arange(m), [len(r) for r in rows])
    k, scale = len(chosen.grams), chosen.ratios
    weigh = np.where(y == 1, 0.5 / p, 0.5 / (m - p))
    norm = np.bincount(row, scale[col] ** 2, m)
    rate = 1.0 / (0.25 * float((weigh * (norm + 1)).sum()) + penalty / m)
    w, b, vw, vb = np.zeros(k), 0.0, np.zeros(k), 0.0
    for t in range(steps):  # accelerated gradient steps on the mean loss
        margin = vb + np.bincount(row, (vw * scale)[col], m)
        pull = weigh * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        grad = np.bincount(col, pull[row], k) * scale + penalty / m * vw
        nw, nb = vw - rate * grad, vb - rate * pull.sum()
        ahead = t / (t + 3)
        vw, vb, w, b = nw + ahead * (nw - w), nb + ahead * (nb - b), nw, nb
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen.grams] = (w * scale).astype(np.float32)
    return Model(weights, b + float(np.log(odds)))


def remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: document counts of the n-grams by label, where there are any."""
    features, counts = Features(), {0: np.zeros(1 << BITS, np.int32), 1: np.zeros(1 << BITS, np.int32)}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label][features(text or "")] += 1
    for label, c in counts.items():
        at = np.flatnonzero(c).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([c[at].tobytes()], pa.binary())], ["label", "grams", "n"])


def _chosen_features(grams: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, place = Features(), np.full(1 << BITS, -1, np.int32)
        place[grams] = np.arange(len(grams), dtype=np.int32)
        for batch in batches:
            found = [place[features(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[f >= 0].tobytes() for f in found], pa.binary())], ["label", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fitted on the labelled rows whose crc32(id) mod 4 isn't 2: of each label the `sample` rows with the least id hash.

    Ids with both labels count as label 1; labels that are neither 0 nor 1 and null ids are left out.
    """
    usable = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
        .where(remainder("id") != 2).groupBy("id").agg(F.max("label").alias("label"))
    )
    n = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    chosen = usable.where("label = 1").orderBy(*order).limit(sample).unionByName(usable.where("label = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # two samples at most are broadcast: the bound is the parameter
    # a repeated id counts once, so that the sample stays bounded
    rows = written(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("label", "text").repartition(SAMPLE_TASKS), "toxic-sample")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, m = size.get(1, 0), size.get(0, 0)
    if not p or not m:  # nothing to tell the labels apart by
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    counts = np.zeros((2, 1 << BITS), np.int64)
    for r in rows.mapInArrow(_count, "label int, grams binary, n binary").toArrow().to_pylist():
        counts[r["label"]][np.frombuffer(r["grams"], np.int32)] += np.frombuffer(r["n"], np.int32)
    chosen_grams = select(counts[1], counts[0], p, m)
    table = rows.mapInArrow(_chosen_features(chosen_grams.grams), "label int, features binary").toArrow()
    found = [np.frombuffer(x.as_py(), np.int32) for x in table.column("features")]
    return fit(found, table.column("label").to_numpy(), chosen_grams, n.get(1, 0) / n[0])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = [model.score(features(t or "")) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts have the score of no features; null ids
    are held out by no rule (held_out false)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(_scorer(model), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(remainder("doc_id") == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows that score the threshold or more."""
    bounded_batches(docs.sparkSession)
    rows = as_rows(docs)
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.select("row", F.col("row")[text_col].alias("text")).mapInArrow(_scorer(model), f"row {kind}, score double")
    return scored.where(F.col("score") < threshold).select("row.*")
