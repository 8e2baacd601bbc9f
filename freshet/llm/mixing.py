"""Mixing sources to target weights by Pareto order sampling of unequal probabilities (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, others, pick

MADE = ("size", "source_size", "target", "copies", "taken")


def random_of(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """A row's random number in (0, 1), from an MD5 of its id and text, and that MD5; both are the same in every run."""
    md5 = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(md5, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48)), md5


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> also target: share of all sizes dealt by weight, stopped at cap times a source's own size.

    Weights repeat over the sources in code point order, null last. What a stopped source can't take is dealt again by
    weight until none is above: the common level is the least k for which the k sources that stop first leave a level
    that the next one can hold. One row per source passes through one task here; no document does.
    """
    everything = Window.partitionBy()
    n = len(weights)
    ranked = sizes.withColumn("__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn(
        "__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % n + 1).cast("int"))
    )
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(cap))).withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    ranked = ranked.withColumn("__k", F.row_number().over(by_ratio)).withColumn("__level", level)
    holds = F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct("__k", "__level"))
    ranked = ranked.withColumn("__level", F.min(holds).over(everything)["__level"])
    reach = F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap"))
    return ranked.select("source", "source_size", F.least("__cap", reach).alias("target"))


def mix_sources(df: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = (1, 2, 3), share: float = 1.0, cap: float = 3.0, half: int = 200, per_bucket: int = 50_000) -> DataFrame:
    """Decides how often the mix takes each document: df with size, source_size, target, copies and taken (= copies * size).

    A source whose target is r times its size takes floor(r) whole copies of each document for certain. The rest is a sample of
    fixed size with unequal probabilities: longer documents are likelier. With x = 1000 * size div (size + half) of a document and
    m its mean over the source's words, the inclusion probability is p = f + min(f, 1 - f) * (x - m) / max(m, 1000 - m), f being
    r - floor(r): all p lie in [0, 1], and the words expected are f of the source's. half = None makes all p equal f.
    Documents are ranked by Pareto's q = (u / (1 - u)) / (p / (1 - p)), and the first ones are taken while their words fit
    what is left of the target: the sample's size is fixed in words, to within one document. q is cut into buckets of about
    per_bucket documents, so that a hot source is never sorted in one task; only the bucket in which the sample ends is ordered.

    Sizes count [^\\x20\\x09-\\x0D]+. Null or empty texts have size 0 and take 0 words; a null source is a source of its own;
    rows equal in id and text tie and are taken or left together; an empty table gives an empty one. Input columns called
    like a result are replaced, all others stay whatever their names. Runs agree: u comes from id and text, and the sums
    behind p are of whole numbers.
    """
    scratch = Scratch(df.sparkSession)
    t, s = pick(df, text, "string"), pick(df, source, "string")
    u, md5 = random_of(pick(df, doc_id), t)
    size = F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("bigint")
    kept = others(df, *MADE)
    rows = df.select(F.struct(*kept).alias("row") if kept else F.struct(F.lit(0)).alias("row"), s.alias("source"), size.alias("size"), u.alias("u"), md5.alias("md5"))
    slim = scratch.save(rows.drop("row"), "slim")
    x = F.lit(0) if half is None else F.call_function("div", F.col("size") * 1000, F.col("size") + half)
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * x).alias("weighed"), F.count("*").alias("documents"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap).withColumnRenamed("source", "s")
    targets = sizes.drop("source_size").join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = targets.withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = targets.withColumn("certain", F.floor("r").cast("bigint")).withColumn("f", F.col("r") - F.col("certain")).withColumn("left_words", F.col("target") - F.col("certain") * F.col("source_size"))
    targets = targets.withColumn("m", F.when(F.col("source_size") > 0, F.col("weighed") / F.col("source_size")).otherwise(0.0)).withColumn("buckets", F.greatest(F.lit(64), F.ceil(F.col("documents") / per_bucket)))
    targets = scratch.save(targets.select(F.col("source").alias("of"), "source_size", "target", "certain", "f", "m", "left_words", "buckets"), "targets")

    def ranked(df: DataFrame) -> DataFrame:
        p = F.col("f") + F.least(F.col("f"), 1 - F.col("f")) * ((x - F.col("m")) / F.greatest(F.col("m"), 1000 - F.col("m")))
        out = df.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("p", p)
        q = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
        return out.withColumn("q", q).withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * F.col("buckets")))

    drawn = ranked(slim).where("q IS NOT NULL")
    sums = drawn.groupBy("of", "bucket", "left_words").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("of").orderBy("bucket")))
    ends = sums.where("upto > left_words").groupBy("of").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("end")).withColumnRenamed("of", "ends_of")
    ends = scratch.save(ends, "ends")
    last = drawn.join(ends, F.col("of").eqNullSafe(F.col("ends_of")) & (F.col("bucket") == F.col("end.bucket")))
    run = F.sum("size").over(Window.partitionBy("of").orderBy("q", "md5").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("fits", F.col("end.before") + run <= F.col("left_words")).where("fits").groupBy(F.col("of").alias("cut_of")).agg(F.max(F.struct("q", "md5")).alias("cut"))
    plan = targets.join(ends, F.col("of").eqNullSafe(F.col("ends_of")), "left").join(last, F.col("of").eqNullSafe(F.col("cut_of")), "left")
    targets = scratch.save(plan.select(*targets.columns, F.col("end.bucket").alias("last_bucket"), "cut"), "plan")

    more = F.when(F.col("q").isNotNull(), F.col("last_bucket").isNull() | (F.col("bucket") < F.col("last_bucket")) | F.coalesce(F.struct("q", "md5") <= F.col("cut"), F.lit(False))).otherwise(False)
    copies = F.col("certain") + more.cast("bigint")
    out = ranked(rows).select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return out.select(*([f"row.`{c}`" for c in rows.schema["row"].dataType.names] if kept else []), "size", "source_size", "target", "copies", "taken")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) AS i, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY cap / w, i) AS k FROM w),
v AS (SELECT min_by(level, k) AS level FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, least(cap, v.level * w) AS target FROM l, v),
r AS (SELECT t.*, CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END AS certain,
             CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS r,
             CASE WHEN t.source_size > 0 THEN y.weighed / t.source_size ELSE 0 END AS m
      FROM t JOIN (SELECT source, CAST(sum(size * (size * 1000 // (size + 200))) AS BIGINT) AS weighed FROM d GROUP BY source) y ON t.source IS NOT DISTINCT FROM y.source),
f AS (SELECT d.*, r.source_size, r.target, r.certain, r.m, r.r - r.certain AS f, target - certain * source_size AS rest,
             (CAST(CAST('0x' || substr(h, 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, f + least(f, 1 - f) * ((size * 1000 // (size + 200) - m) / greatest(m, 1000 - m)) AS p FROM f),
o AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM q),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN q IS NOT NULL AND run <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
