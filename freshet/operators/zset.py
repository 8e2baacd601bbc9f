"""Weighted rows: a DataFrame with a bigint column __weight, +1 for an insertion and -1 for a deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "__weight"


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != W]


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df if W in df.columns else df.withColumn(W, F.lit(weight).cast("bigint"))


def normalise(z: DataFrame) -> DataFrame:
    """Equal rows' weights added; rows of weight zero go. NULLs are equal to one another here."""
    return z.groupBy(*[f"`{c}`" for c in columns(z)]).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(plus(a, negate(b)))


def distinct(z: DataFrame) -> DataFrame:
    """Rows of positive weight, each once."""
    return normalise(z).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("bigint"))


def expand(z: DataFrame) -> DataFrame:
    """The bag that a Z-set stands for; rows of weight below zero (deleted before they were inserted) are not in it."""
    return normalise(z).where(F.col(W) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(W)))).drop("__copy", W)


def positive(z: DataFrame) -> DataFrame:
    """The Z-set without its rows of weight below zero."""
    return z.where(F.col(W) > 0)


def join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Weights multiply; NULL keys never match."""
    right = b.withColumnRenamed(W, "__w")
    return a.join(right, on).withColumn(W, F.col(W) * F.col("__w")).drop("__w")


def join_delta(old_a: DataFrame, da: DataFrame, new_b: DataFrame, db: DataFrame, on: list[str]) -> DataFrame:
    """The change of a join: the change of a against all of b now, and a before against the change of b."""
    first = join(da, new_b, on)
    return normalise(first.unionByName(join(old_a, db, on).select(*first.columns)))


def distinct_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The change of distinct rows: only rows that delta touches are looked up."""
    keys = columns(delta)
    touched = normalise(delta).withColumnRenamed(W, "__d")
    same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys]
    both = touched.alias("t").join(normalise(old).alias("o"), same, "left").select(*[F.col(f"t.`{k}`") for k in keys], F.coalesce(F.col(f"o.{W}"), F.lit(0)).alias("__o"), "__d")
    change = (F.col("__o") + F.col("__d") > 0).cast("bigint") - (F.col("__o") > 0).cast("bigint")
    return both.withColumn(W, change).where(F.col(W) != 0).select(*[f"`{k}`" for k in keys], W)


def sums_delta(old: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The change of COUNT(*) and SUM(value) by keys: touched groups lose their old row and get their new one. old and delta are Z-sets of rows."""
    touched = delta.select(*keys).distinct()
    reach = lambda z: z.join(touched, [z[k].eqNullSafe(touched[k]) for k in keys], "left_semi")

    def totals(z: DataFrame) -> DataFrame:
        some = F.sum(F.when(F.col(value).isNotNull(), F.col(W)).otherwise(0))
        rows = z.groupBy(*keys).agg(F.sum(W).alias("n"), F.when(some != 0, F.sum(F.col(value) * F.col(W))).alias("total"))
        return rows.where("n <> 0").withColumn(W, F.lit(1).cast("bigint"))

    before = reach(old)
    return minus(totals(before.unionByName(delta)), totals(before))


def index_by(z: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """(key, value) structs with their weight: the rows keyed by some columns; values are all others unless given."""
    values = [c for c in columns(z) if c not in keys] if values is None else values
    named = lambda cs: F.struct(*[F.col(f"`{c}`") for c in cs]) if cs else F.struct(F.lit(True).alias("any"))
    return z.select(named(keys).alias("key"), named(values).alias("value"), W)


def group_project(indexed: DataFrame, make: dict[str, Column]) -> DataFrame:
    """Plain rows of an indexed Z-set: each column from key and value; equal rows' weights are added."""
    return normalise(indexed.select(*[c.alias(n) for n, c in make.items()], W))
