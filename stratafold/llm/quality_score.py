"""Quality classifier: regularised quadratic discriminant over document statistics.

The statistics of every text are computed once and settled in the shared folder;
class counts, sums and Gram matrices come from one distributed aggregation over
all labelled rows whose crc32(doc_id) modulo 5 is not 0. Each class covariance is
shrunk towards its diagonal, its Cholesky factor is computed once on the driver,
and a score is the logistic of the difference of log densities and priors.

Null texts count as empty ones. Rows with a null id are scored and not held out
as far as a remainder is unknown (``held_out`` false), and never train. Several
labels of one id count each. If a class has no labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import kernels as K
from stratafold.llm.doc_stats import Stats

THRESHOLD = 0.3
SHRINKAGE = 0.1
FLOOR = 1e-4
FOLDS = 5


def _statistics(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                x = Stats(block).document_features()
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), flat], ["doc_id", "x"])

    found = K.map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, x array<double>")
    return found.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)))


class Discriminant:
    """Means, inverse Cholesky factors and log priors of the two classes."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        self.known = len(sums) == 2
        self.parts = {}
        total = sum(n for n, _, _ in sums.values())
        for label, (n, s, gram) in sums.items() if self.known else ():
            mean = s / n
            cov = gram / n - np.outer(mean, mean)
            cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + FLOOR * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.parts[label] = (mean, np.linalg.inv(factor), np.log(n / total) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1."""
        if not self.known:
            return np.full(len(x), 0.5)
        log = {k: c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for k, (mean, inverse, c) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(statistics: DataFrame, labels: DataFrame) -> Discriminant:
    """Class sums over all training rows; only 2 rows reach the driver."""
    labelled = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = statistics.where("not held_out").join(labelled, "doc_id")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(batch.schema.get_field_index("label")).to_numpy()
            x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(batch.num_rows, -1)
            for k in np.unique(label):
                own = x[label == k]
                was = total.setdefault(int(k), [0.0, 0.0, 0.0])
                total[int(k)] = [was[0] + len(own), was[1] + own.sum(0), was[2] + own.T @ own]
        for k, (n, s, gram) in total.items():
            flat = np.concatenate([[n], s, gram.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.float64()))], ["label", "sums"])

    partial = K.map_arrow(rows.select("label", "x"), sums, "label int, sums array<double>")
    got = partial.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for label in {r.label for r in got}:
        flat = np.array([r.v for r in sorted((r for r in got if r.label == label), key=lambda r: r.i)])
        d = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2)
        out[label] = (flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d))
    return Discriminant(out)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    statistics = K.settled(_statistics(docs))
    model = fit(statistics, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return K.map_arrow(statistics.select("doc_id", "x", "held_out"), rows, "doc_id long, held_out boolean, score double, predicted int")
