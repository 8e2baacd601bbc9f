"""Bottom-k sketches of word shingles as document fingerprints (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from .common import SPACE, Scratch, let, pick, small

K, BITS, WIDTH = 128, 48, 5
DIGITS = BITS // 4


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest of the different 48-bit hashes of text's word shingles, ascending.

    Words are cut at ASCII white space and lower-cased; with fewer than width words the whole sequence is one shingle;
    null, empty or blank texts have an empty sketch.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        ends = F.slice(h, width, F.greatest(n - (width - 1), F.lit(0)))
        many = F.transform(ends, lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(width - 1)], x))
        one = F.array(F.xxhash64(F.lit(0), *[F.get(h, F.lit(j)) for j in range(width - 1)]))
        return F.when(n >= width, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), shingles)
    kept = F.transform(hashes, lambda x: F.shiftrightunsigned(x, 64 - BITS))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, k)


def pack(s: Column) -> Column:
    """A sketch as text: 12 hex digits for each hash, in ascending order."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def unpack(fingerprint: Column) -> Column:
    n = (F.length(fingerprint) / DIGITS).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(fingerprint, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("bigint"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' united shingles, exactly as if they had been sketched as one."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the united sketch that both have; 1 if both are empty, exact for sets up to k."""
    shared = lambda m: F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(merge(a, b, k), shared)).cast("double")


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact if the sketch isn't full."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / F.element_at(s, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the united count, over a's count; null if a is empty."""
    inside = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), inside))


def merge_groups(df: DataFrame, by: list[str], sketch_column: str, k: int = K) -> DataFrame:
    """The united sketch of each group of rows: hashes are counted once per group by partial aggregates and the k least kept by rank, so no group meets in one task before it is down to k rows a task."""
    hashes = df.select(*by, F.explode(sketch_column).alias("__h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__h"))
    return hashes.withColumn("__r", rank).where(F.col("__r") <= k).groupBy(*by).agg(F.array_sort(F.collect_list("__h")).alias(sketch_column))


def _place(id_: Column, kind: DataType) -> Column:
    """A number that grows with the id (for strings with their first six bytes), by which ids are dealt into ranges."""
    if isinstance(kind, NumericType):
        return id_.cast("double")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_micros(id_.cast("timestamp")).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.encode(id_.cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", per_bucket: int = 4000, coarse: int = 256) -> DataFrame:
    """(doc_id, text, next_id, next_text): the next document by descending doc_id; after the last, the first again.

    Null ids come last, equal ids in the order of their texts' hashes (rows equal in both in any order: their results are equal
    but for who follows whom); of a single row, it is its own next. Rows are dealt into ranges of about per_bucket rows: up to
    coarse ranges of ids have bounds from approximate quantiles, and each is cut into as many even parts as the table's size
    asks for; rows without an id are dealt by the hash that orders them. So the texts are shuffled once and no range grows
    with the table. The largest row of each range is also sent to the range above it, where it follows the smallest.
    """
    t = F.coalesce(pick(df, text, "string"), F.lit(""))
    own = pick(df, doc_id)
    d = df.select(own.alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("__h"))
    d = d.withColumn("__p", _place(F.col("doc_id"), d.schema["doc_id"].dataType))
    n, known, low, high = d.agg(F.count("*"), F.count("__p"), F.min("__p"), F.max("__p")).first()
    many = max(1, min(coarse, known // per_bucket))
    cuts = sorted(set(d.stat.approxQuantile("__p", [i / many for i in range(1, many)], 0.2 / many))) if many > 1 else []
    edges = [low, *cuts, high] if known else []
    parts, unknown = max(1, -(-known // per_bucket // many)), max(1, (n - known) // per_bucket)
    spot = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("__p"))) if cuts else F.lit(0)
    bounds = F.array(*map(F.lit, edges)) if edges else F.array(F.lit(0.0), F.lit(0.0))
    # spot s holds (edges[s], edges[s + 1]]
    inner = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("__p") - F.get(bounds, F.col("__s"))) / F.greatest(F.get(bounds, F.col("__s") + 1) - F.get(bounds, F.col("__s")), F.lit(1e-9)) * parts)))
    lost = F.floor((F.shiftright("__h", 32).cast("double") / float(1 << 32) + 0.5) * unknown)
    d = d.withColumn("__s", spot).withColumn("__b", F.when(F.col("__p").isNull(), lost - unknown).otherwise(F.col("__s") * parts + inner).cast("bigint")).drop("__s", "__p")
    place = F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("__h").alias("c"))
    tops = d.groupBy("__b").agg(F.max(place).alias("__top"))
    everything = Window.orderBy("__b")
    goes = F.coalesce(F.lead("__b").over(everything), F.first("__b").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    scratch = Scratch(df.sparkSession)
    tops = scratch.save(tops.select(F.col("__b"), "__top", goes.alias("__to")), "tops")  # a row for each range
    d = d.join(small(tops, scratch, "tops"), "__b")
    here, there = F.struct(F.col("__b").alias("b"), F.lit(0).alias("extra")), F.struct(F.col("__to").alias("b"), F.lit(1).alias("extra"))
    sent = F.when(place == F.col("__top"), F.array(here, there)).otherwise(F.array(here))
    d = d.select("doc_id", "text", "__h", F.explode(sent).alias("s")).select("doc_id", "text", "__h", F.col("s.b").alias("__b"), F.col("s.extra").alias("__extra"))
    return d.withColumn("next_id", F.lead("doc_id").over(following())).withColumn("next_text", F.lead("text").over(following()))


def following() -> WindowSpec:
    """A range's rows by descending id, then the one that the range below sent."""
    return Window.partitionBy("__b").orderBy("__extra", F.col("doc_id").desc_nulls_last(), F.col("__h").desc())


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per_bucket: int = 4000) -> DataFrame:
    """Each text's fingerprint beside that of its edited text, and how like it is to that and to the next document's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    (with_next tells which). Null texts are empty, and two empty texts are alike (1); an empty table gives an empty one.
    """
    d = with_next(df, doc_id, text, per_bucket).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    d = d.withColumn("edited", edited).drop("next_text").withColumn("s", sketch(F.col("text")))
    d = d.withColumn("next_s", F.lead("s").over(following())).where("__extra = 0").withColumn("e", sketch(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), pack(F.col("s")).alias("fingerprint"), pack(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e")).alias("near_edited"), resemblance(F.col("s"), F.col("next_s")).alias("near_next"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
