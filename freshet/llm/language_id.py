"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import others, pick, steps, utf8
from .features import VECTORS, bounded_sample, language_vectors

MADE = ("lang_pred", "score")


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of an L2-loss linear SVM by dual coordinate descent; y is -1 or 1, classes weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float32)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    diag = share * 2 / (2 * c)
    norm = (x * x).sum(1) + diag
    w, alpha, rng = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + diag[i] * alpha[i]
            a = max(alpha[i] - g / norm[i], 0.0)
            if a != alpha[i]:
                w += np.float32((a - alpha[i]) * y[i]) * x[i]
                alpha[i] = a
    return w


def families_of(centroids: np.ndarray, most: int = 2) -> list[int]:
    """Merges the closest groups of languages (average cosine) until most are left: the family number of each language."""
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    groups, near = [[i] for i in range(len(unit))], unit @ unit.T
    while len(groups) > most:
        pairs = [(near[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs)
        groups[i] += groups.pop(j)
    return [next(g for g, members in enumerate(groups) if i in members) for i in range(len(unit))]


@dataclass
class LanguageModel:
    langs: list[str]
    dims: int
    mean: np.ndarray
    family: list[int] = field(default_factory=list)
    duels: list[tuple] = field(default_factory=list)  # (level, a, b, weights): positive says a; level -1 is between families

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): a family's share of its duels' votes times the language's share of those within it."""
        n = len(offsets) - 1
        out = np.ones((n, len(self.langs)))
        if not self.duels:
            return out
        x = language_vectors(data, offsets, self.dims) - self.mean
        margins = x @ np.stack([w[:-1] for *_, w in self.duels]).T + np.array([w[-1] for *_, w in self.duels])
        wins = 1 / (1 + np.exp(-4 * np.clip(margins, -50, 50)))
        families = max(self.family) + 1

        def shares(level: int, members: list[int]) -> np.ndarray:
            s = np.ones((n, len(members)))
            for k, (at, a, b, _) in enumerate(self.duels):
                if at == level:
                    s[:, members.index(a)] *= wins[:, k]
                    s[:, members.index(b)] *= 1 - wins[:, k]
            return s / np.maximum(s.sum(1, keepdims=True), 1e-300)

        top = shares(-1, list(range(families)))
        for f in range(families):
            members = [i for i, g in enumerate(self.family) if g == f]
            out[:, members] = shares(f, members) * top[:, [f]] if len(members) > 1 else top[:, [f]]
        return out


def fit(df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 500, dims: int = 4096, families: int = 2) -> LanguageModel:
    """Learns from the whole texts of a bounded sample of df's labelled rows (per_language of each language, by a hash of key)."""
    l, t = pick(df, lang, "string"), pick(df, text, "string")
    rows = bounded_sample(df.where(l.isNotNull() & t.isNotNull()), l, pick(df, key), per_language).select(t.alias("t"), l.alias("l"), "__u")

    def vectors(it):
        for rb in it:
            offsets, data = utf8(rb.column(0))
            out = [language_vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], dims).astype(np.float16) for a, b in steps(offsets, rows=VECTORS)]
            yield pa.RecordBatch.from_arrays([rb.column(1), rb.column(2), pa.array([v.tobytes() for m in out for v in m], pa.binary())], names=["l", "u", "v"])

    got = sorted(rows.mapInArrow(vectors, "l string, u double, v binary").collect(), key=lambda r: (r["l"], r["u"], r["v"]))
    langs = sorted({r["l"] for r in got})
    kept = [r for name in langs for r in [r for r in got if r["l"] == name][:per_language]]
    if len(langs) < 2:
        return LanguageModel(langs, dims, np.zeros(dims, np.float32), [0] * len(langs))
    x = np.stack([np.frombuffer(r["v"], np.float16) for r in kept]).astype(np.float32)
    y = np.array([langs.index(r["l"]) for r in kept])
    centroids = np.stack([x[y == i].mean(0) for i in range(len(langs))])
    mean = centroids.mean(0)
    x, family = x - mean, families_of(centroids - mean, max(1, min(families, len(langs) - 1)))
    model = LanguageModel(langs, dims, mean, family)
    of = np.array(family)[y]
    for a in range(max(family) + 1):
        for b in range(a + 1, max(family) + 1):
            m = (of == a) | (of == b)
            model.duels.append((-1, a, b, linear_svm(x[m], np.where(of[m] == a, 1.0, -1.0))))
        inside = [i for i, g in enumerate(family) if g == a]
        for p, i in enumerate(inside):
            for j in inside[p + 1 :]:
                m = (y == i) | (y == j)
                model.duels.append((a, i, j, linear_svm(x[m], np.where(y[m] == i, 1.0, -1.0))))
    return model


def identify(df: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """df with lang_pred (a learned language; und for texts that are null or have no letter) and score (0 to 1; 0 for und).

    Whole texts are read. Without any labelled row nothing is learned and all is und; with a single language, each text with
    a letter is that. Repeated rows get equal results, an empty table gives an empty one, input columns called like a result
    are replaced. The model's size does not depend on the input, and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = others(df, *MADE)
    dressed = df.select(pick(df, text, "string").alias("__t"), F.struct(*keep).alias("__row") if keep else F.struct(F.lit(0)).alias("__row"), F.coalesce(pick(df, text, "string").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))

    def run(it):
        m = shared.value
        for rb in it:
            offsets, data = utf8(rb.column(0))
            best, score = np.zeros(len(rb), np.int64), np.zeros(len(rb))
            for a, b in steps(offsets, rows=VECTORS):
                if m.langs:
                    s = m.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best[a:b], score[a:b] = s.argmax(1), np.clip(s.max(1), 0, 1)
            known = rb.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
            yield pa.RecordBatch.from_arrays([rb.column(1), pa.array([m.langs[i] if k else "und" for i, k in zip(best, known)], pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], names=["__row", *MADE])

    out = dressed.mapInArrow(run, StructType([dressed.schema["__row"], *StructType.fromDDL("lang_pred string, score double").fields]))
    return out.select(*([f"__row.`{f}`" for f in dressed.schema["__row"].dataType.names] if keep else []), *MADE)


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"))
    model = fit(docs.where(~out & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
