"""Quality scores by similarity-weighted votes of labelled neighbours in a latent semantic space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import others, pick, steps, utf8
from .features import VECTORS, bounded_sample, quality_vectors
from .language_id import held_out

MADE = ("score", "predicted")


@dataclass
class VotingModel:
    dims: int
    idf: np.ndarray
    basis: np.ndarray  # (dims, rank)
    mean: np.ndarray  # (rank,)
    vectors: np.ndarray  # (rank, labelled), unit columns
    labels: np.ndarray
    neighbours: int
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        x = x * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.basis - self.mean
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, data: np.ndarray, offsets: np.ndarray, block: int = 256) -> np.ndarray:
        z = self.latent(quality_vectors(data, offsets, self.dims))
        out = np.full(len(z), self.prior)
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(z), block):
            near = z[a : a + block] @ self.vectors
            top = np.argpartition(near, len(self.labels) - k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(near, top, 1), 0) ** 4 + 1e-9
            out[a : a + block] = (w * self.labels[top]).sum(1) / w.sum(1)
        out[np.diff(offsets) == 0] = self.prior
        return np.clip(out, 0.0, 1.0)


def fit(df: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", key: str = "doc_id", per_label: int = 1200, dims: int = 4096, rank: int = 48, neighbours: int = 25, seed: int = 3) -> VotingModel | None:
    """Learns from the whole texts of a bounded sample of labelled documents: per_label of each label, chosen by a hash of key.

    The sample's keys (at most about twice per_label) are broadcast to find their texts. Labels other than 0 and 1 and keys with
    both labels are left out. None if no labelled document is found.
    """
    own = labels.where(pick(labels, label, "double").isin(0, 1) & pick(labels, key).isNotNull()).groupBy(pick(labels, key).alias("k")).agg(F.min(pick(labels, label, "int")).alias("y"), F.max(pick(labels, label, "int")).alias("z")).where("y = z").select("k", "y")
    chosen = bounded_sample(own, F.col("y"), F.col("k"), per_label)
    found = df.select(pick(df, key).alias("__k"), pick(df, text, "string").alias("t")).join(F.broadcast(chosen), F.col("__k").cast("string") == F.col("k").cast("string")).select("t", "y", "__u")

    def vectors(it):
        for rb in it:
            offsets, data = utf8(rb.column(0))
            out = [quality_vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], dims).astype(np.float16) for a, b in steps(offsets, rows=VECTORS)]
            yield pa.RecordBatch.from_arrays([rb.column(1), rb.column(2), pa.array([v.tobytes() for m in out for v in m], pa.binary())], names=["y", "u", "v"])

    got = sorted(found.mapInArrow(vectors, "y int, u double, v binary").collect(), key=lambda r: (r["y"], r["u"], r["v"]))
    kept = [r for y in (0, 1) for r in [r for r in got if r["y"] == y][:per_label]]
    if not kept:
        return None
    x = np.stack([np.frombuffer(r["v"], np.float16) for r in kept]).astype(np.float32)
    y = np.array([r["y"] for r in kept], np.float64)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2).astype(np.float32)
    unit = x * idf
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    rank = min(rank, min(unit.shape))
    span = np.random.default_rng(seed).standard_normal((dims, min(rank + 16, dims))).astype(np.float32)
    for _ in range(4):  # power iterations of a randomised singular value decomposition
        span, _ = np.linalg.qr(unit.T @ (unit @ span))
    _, _, vt = np.linalg.svd(unit @ span, full_matrices=False)
    basis = (span @ vt[:rank].T).astype(np.float32)
    mean = (unit @ basis).mean(0)
    model = VotingModel(dims, idf, basis, mean, np.zeros((rank, 0), np.float32), y, neighbours, float(y.mean()))
    model.vectors = np.ascontiguousarray(model.latent(x).T)
    return model


def score(df: DataFrame, model: VotingModel | None, *, text: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Each whole text is compared with all labelled vectors, in blocks, and its nearest ones vote with their cosine's fourth
    power. Null and empty texts get the share of label 1 in the sample; without a model all get 0.5. Repeated rows get equal
    results, an empty table gives an empty one, input columns called like a result are replaced. The model, whose size
    depends on fit's parameters alone, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = others(df, *MADE)
    dressed = df.select(pick(df, text, "string").alias("__t"), F.struct(*keep).alias("__row") if keep else F.struct(F.lit(0)).alias("__row"))

    def run(it):
        m = shared.value
        for rb in it:
            offsets, data = utf8(rb.column(0))
            s = np.full(len(rb), 0.5)
            for a, b in steps(offsets, rows=VECTORS):
                if m is not None:
                    s[a:b] = m.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([rb.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["__row", *MADE])

    out = dressed.mapInArrow(run, StructType([dressed.schema["__row"], *StructType.fromDDL("score double, predicted int").fields]))
    return out.select(*([f"__row.`{f}`" for f in dressed.schema["__row"].dataType.names] if keep else []), *MADE)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, labels.where(~out & F.col("doc_id").isNotNull()))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
