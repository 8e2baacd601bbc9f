"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, arrow_rows, others, pick, small, trim

MADE = ("text", "n_lines", "n_dropped")
#: Texts whose lines Python holds at a time.
BATCH = 1000
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(_STRIP).lower()  # of bytes, so ASCII only


def _halves(digest: int) -> tuple[int, int]:
    return ((digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63))


def _hash(data: bytes) -> tuple[int, int]:
    return _halves(xxhash.xxh3_128_intdigest(data))


class LineRuns:
    """A store of sorted runs of (line hash, documents) in levels, each level's runs fanout times those below.

    add(batch) drops from the batch, by a merge anti-join, the lines that are settled (already in min_docs documents), adds
    what is left as a sorted run of level 0, and compacts every level that has fanout runs into one run of the next;
    lines that reach min_docs there move to the settled runs, which become one when there are more than fanout of them. Counts
    add up because a document lies in one batch only.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, min_docs: int, fanout: int = 2):
        self.spark, self.scratch, self.min_docs, self.fanout = spark, scratch, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self.made = 0

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[self.scratch.path(n) for n in names])

    def _run(self, df: DataFrame) -> str:
        self.made += 1
        name = f"run-{self.made}"
        self.scratch.save(df.sortWithinPartitions("h1", "h2"), name)
        return name

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2), a row for each document and different line in it."""
        new = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        if self.settled:
            new = new.join(self._read(self.settled).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._run(new))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        names = self.levels[level]
        whole = self._read(names).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = self._run(whole)
        done = self._read([merged]).where(F.col("docs") >= self.min_docs)
        self.settled.append(self._run(done.select("h1", "h2")))
        if len(self.settled) > self.fanout:  # no line is in two of them
            old, self.settled = self.settled, [self._run(self._read(self.settled))]
            for n in old:
                self.scratch.drop(n)
        self.levels[level + 1].append(self._run(self._read([merged]).where(F.col("docs") < self.min_docs)))
        self.levels[level] = []
        for n in [*names, merged]:
            self.scratch.drop(n)

    def frequent(self) -> DataFrame:
        """The hashes of all lines found in min_docs documents or more."""
        rest = [n for names in self.levels for n in names]
        out = self._read(rest).groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= self.min_docs).select("h1", "h2") if rest else None
        if self.settled:
            old = self._read(self.settled)
            out = old if out is None else out.unionByName(old)
        return out if out is not None else self.spark.createDataFrame([], "h1 long, h2 long")


def _parts(it):
    """The batches, cut to BATCH rows."""
    for rb in it:
        for a in range(0, max(1, len(rb)), BATCH):
            yield rb.slice(a, BATCH)
            trim()


def _listing(batches: int, min_chars: int):
    def run(it):
        batch = TaskContext.get().partitionId() % batches
        for rb in _parts(it):
            h1, h2, t1, t2 = [], [], [], []
            for t, a, b in zip(rb.column(0), rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                keys = {k for k in map(line_key, (t.as_py() or "").encode().split(b"\n")) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)}
                for x, y in map(_hash, keys):
                    h1.append(x), h2.append(y), t1.append(a), t2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(h1), pa.int32()), *[pa.array(x, pa.int64()) for x in (h1, h2, t1, t2)]], names=["batch", "h1", "h2", "t1", "t2"])

    return run


def _dropping(it):
    for rb in _parts(it):
        texts, drops, kept, lines, dropped = rb.column(0), rb.column(1), [], [], []
        for t, d in zip(texts, drops):
            rows = (t.as_py() or "").encode().split(b"\n")
            if d.is_valid and len(d):
                gone = {(x["h1"], x["h2"]) for x in d.as_py()}
                stay = [r for r in rows if not (k := line_key(r)) or _hash(k) not in gone]
            else:
                stay = rows
            kept.append(b"\n".join(stay).decode()), lines.append(len(rows)), dropped.append(len(rows) - len(stay))
        yield pa.RecordBatch.from_arrays([*rb.columns[2:], pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*rb.schema.names[2:], *MADE])


def dedup_lines(df: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops every line whose key (line_key) of min_chars code points or more is in min_docs documents or more, in all of them.

    Returns df with text as what is left, joined by newlines, n_lines before and n_dropped. A text is split at \\n only; null
    or empty texts are one empty line; empty keys are never dropped; a row counts as a document, so repeated rows count each;
    an empty table gives an empty one. Input columns called like a result are replaced.

    Keys are 128-bit hashes. Documents are listed once, in batches, and the batches go through LineRuns. A document's own
    list of dropped keys meets it by the hash of its text, as the decision depends on the text alone; AQE splits a hot text.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    t = pick(df, text, "string")
    of_text = [F.xxhash64(F.coalesce(t, F.lit(""))), F.xxhash64(F.lit(1), F.coalesce(t, F.lit("")))]
    listed = df.select(t.alias("t"), of_text[0].alias("t1"), of_text[1].alias("t2")).mapInArrow(_listing(batches, min_chars), "batch int, h1 long, h2 long, t1 long, t2 long")
    with arrow_rows(spark, BATCH):
        listed = scratch.save(listed, "lines", "batch")
    runs = LineRuns(spark, scratch, min_docs, fanout)
    for b in range(batches):
        runs.add(listed.where(F.col("batch") == b).select("h1", "h2"))
    frequent = scratch.save(runs.frequent(), "frequent")
    hits = listed.join(small(frequent, scratch, "frequent"), ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("__drop"))
    hits = scratch.save(hits, "hits")
    keep = others(df, *MADE)
    dressed = df.select(t.alias("__t"), F.struct(*keep).alias("__row") if keep else F.struct(F.lit(0)).alias("__row"), of_text[0].alias("t1"), of_text[1].alias("t2"))
    joined = dressed.join(small(hits, scratch, "hits"), ["t1", "t2"], "left").select("__t", "__drop", "__row")
    out = joined.mapInArrow(_dropping, StructType([joined.schema["__row"], *StructType.fromDDL("text string, n_lines long, n_dropped long").fields]))
    return out.select(*([f"__row.`{f}`" for f in joined.schema["__row"].dataType.names] if keep else []), *MADE)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
