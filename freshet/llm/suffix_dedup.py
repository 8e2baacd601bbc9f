"""Exact substring dedup by prefix doubling over ranked text positions.

Positions are ranked by the strings of growing length that start there. A string's rank is a 64-bit name made from the ranks
of its two halves (the names at the position and at an offset from it), so equal strings have equal ranks in every document.
No sort makes the ranks: each round's tasks read the texts again and work out the names up to its length, Spark deals
packets of (rank, document) pairs by bucket, a range of ranks each, and numpy sorts the pairs within. Positions
whose rank is unique to one document leave; the others are ranked again at the next length, until the strings are as long as
the threshold.

Only some positions are ranked below the full length: of the strings of a round's length inside a 50-byte window, the one
with the least name stands for the window. Equal windows have equal representatives, so a window whose representative no
other document has is unique, and one rank a round stands for many windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .common import Scratch, arrow_rows, mix, others, pick, steps, trim, utf8

MADE = ("text", "n_bytes", "n_removed", "n_spans", "kept")
LAST = (1 << 63) - 1  # stands for a null id: none is smaller than it alone
U = np.uint64
#: Bytes of text ranked at a time (the arrays stay in the processor's cache), and texts that Python holds at a time.
STEP, BATCH = 192 << 10, 4000
#: Entries in a row that is shuffled.
PACKET = 4096


def _pair(names: np.ndarray, offset: int, n: int) -> np.ndarray:
    """The rank of the string that the ranks at i and at i + offset cover."""
    out = names[:n] * U(0x9E3779B97F4A7C15)
    out += names[offset : offset + n]
    out ^= out >> U(29)  # one to one
    return out


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least (or greatest) of x[i : i + w] for each i."""
    f, done = (np.minimum if least else np.maximum), 1
    while done < w:
        step = min(done, w - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


class Ranks:
    """Names of the strings of one run of texts at a round's lengths."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length, n = data, offsets, length, len(data)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = np.arange(n) + length <= offsets[1:][self.row] if n else np.zeros(0, bool)
        self.windows = np.flatnonzero(inside)
        eight = np.zeros(max(0, n - 7), U)
        if n >= 8:
            eight = mix(np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data).tobytes(), 0, (1,)).copy())
        self.names = {8: eight}

    def named(self, k: int) -> np.ndarray:
        if k not in self.names:
            half = max((h for h in self.names if h < k), default=8)
            while half * 2 < k:
                self.named(half * 2)
                half *= 2
            self.names[k] = _pair(self.names[half], k - half, max(0, len(self.data) - k + 1))
        return self.names[k]

    def representatives(self, k: int) -> np.ndarray:
        """For each window (in the order of windows), the least name of the strings of length k in it."""
        x = self.named(k)
        if not len(self.windows):
            return np.zeros(0, U)
        return _sliding(x, self.length - k + 1, True)[self.windows]


def _runs(values: np.ndarray, windows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where a new run begins: of windows one behind the other in a row with the same value."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (windows[1:] != windows[:-1] + 1) | (rows[1:] != rows[:-1])))


def _segments(ranks: Ranks, k: int, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(representative, name of the whole stretch, row, first window, windows) of the runs of chosen windows that have one representative."""
    rep = ranks.representatives(k)[chosen]
    win, row = ranks.windows[chosen], ranks.row[ranks.windows[chosen]]
    begin = _runs(rep, win, row)
    count = np.diff(np.append(begin, len(rep)))
    full = ranks.named(ranks.length)
    total = np.append(np.zeros(1, U), np.cumsum(mix(full[win] + (np.arange(len(win), dtype=U) - np.repeat(begin, count).astype(U)) * U(0xD6E8FEB86659FD93))))
    name = mix(total[begin + count] - total[begin] + count.astype(U))
    return rep[begin], name, row[begin], win[begin], count


def _first_of_copies(ids: np.ndarray) -> np.ndarray:
    """Of texts with one key, the first row."""
    return np.unique(ids, return_index=True)[1]


class _Rounds:
    """The Python sides of the rounds, over batches of (text, key, ...)."""

    def __init__(self, length: int, buckets: int):
        self.length, self.buckets = length, buckets

    def ranked(self, rb: pa.RecordBatch):
        """Runs of a batch's different texts: (ranks, their rows in the batch)."""
        key = rb.column(1).to_numpy()
        first = np.sort(_first_of_copies(key))
        offsets, data = utf8(rb.column(0).take(pa.array(first)))
        for a, b in steps(offsets, STEP):
            yield Ranks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.length), first[a:b]
        trim()

    def packed(self, columns: list[np.ndarray]):
        """Rows (bucket, columns as bytes) of entries, dealt by their first column, sorted. Representatives are least names, so it is their hash that is cut into even ranges."""
        step = U(((1 << 64) - 1) // self.buckets + 1)
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        bucket = (mix(columns[0]) // step).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        rows = [(i, *[c[v : min(v + PACKET, y)].tobytes() for c in columns]) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:])) for v in range(x, y, PACKET)]
        for a in range(0, len(rows), 64):
            part = rows[a : a + 64]
            arrays = [pa.array([r[0] for r in part], pa.int32()), *[pa.array([r[i] for r in part], pa.binary()) for i in range(1, len(columns) + 1)]]
            yield arrays

    @staticmethod
    def gathered(it, kinds: list):
        """The entries of each bucket in turn, sorted by their first column."""
        held, at = [], -1

        def flush():
            columns = [np.concatenate([np.frombuffer(h[i], kind) for h in held]) for i, kind in enumerate(kinds)]
            order = np.argsort(columns[0], kind="stable")
            return [c[order] for c in columns]

        for rb in it:
            for bucket, *blobs in zip(*[c.to_pylist() for c in rb.columns]):
                if bucket != at and held:
                    yield flush()
                    held = []
                at = bucket
                held.append(blobs)
        if held:
            yield flush()
        trim()


def _starts(sorted_names: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_names[1:] != sorted_names[:-1])) if len(sorted_names) else np.zeros(0, np.int64)


def _spread(starts: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


def _listed(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("key").agg(F.collect_list(column).alias(column))


def _packets(df: DataFrame, rounds: _Rounds, make, gather, kinds: list, schema: str, scratch: Scratch, name: str) -> DataFrame:
    """One round: make's entries are dealt by rank, sorted and judged by gather, whose rows are saved; make's local rows go along."""
    fields = [f"c{i} binary" for i in range(len(kinds))]
    dealt = df.mapInArrow(make, ", ".join(["bucket int", *fields]))
    out = dealt.repartition(rounds.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, schema)
    return scratch.save(out, name)


def removed_spans(covered: np.ndarray, length: int, size: int) -> np.ndarray:
    """Maximal runs (start, stop) of the bytes in windows of the given starts."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, covered, 1)
    np.add.at(mark, covered + length, -1)
    on = np.concatenate([[0], (np.cumsum(mark)[:size] > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(on)).reshape(-1, 2)


def dedup_substrings(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = 50) -> DataFrame:
    """Removes from each text every byte of a string of length bytes that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes, matches stay within documents, and all is judged on the input. Returns df with text replaced by
    the bytes that stay (binary, as a cut may split a character), n_bytes, n_removed and n_spans (maximal removed runs).
    Null texts are empty; texts shorter than length lose nothing; a null doc_id is larger than all others; documents that
    share a doc_id take nothing from one another; an empty table gives an empty one; input columns called like a result
    are replaced.

    Exact copies are told by a hash of the text: all but those with the least doc_id go as a whole. The rounds rank strings
    of 24, 40 and length bytes (see the module). In the second, windows in a row with one representative form a stretch:
    where all stretches of a representative are alike, the least doc_id keeps it and the others lose it, and only where they
    differ (at the ends of what two documents share) single windows are ranked in the third. What a batch of texts has
    itself is settled before the shuffle, so a rank leaves a task once however many of its texts have it.
    """
    if length < 48:
        raise ValueError("length must be 48 or more")
    with arrow_rows(df.sparkSession, BATCH):
        return _dedup(df, text, doc_id, length)


def _with_ranks(df: DataFrame, doc_id: str, scratch: Scratch) -> DataFrame:
    """df with __id, a bigint in the order of its ids, LAST for nulls: integers themselves, other ids by their place among all different ones (sorted in ranges, numbered by range and row)."""
    own = pick(df, doc_id)
    if isinstance(df.select(own.alias("id")).schema["id"].dataType, IntegralType):
        return df.withColumn("__id", F.coalesce(own.cast("bigint"), F.lit(LAST)))
    ids = df.select(own.alias("__own")).where(F.col("__own").isNotNull()).distinct().repartitionByRange("__own").sortWithinPartitions("__own")
    ids = scratch.save(ids.withColumn("__rank", F.monotonically_increasing_id()), "ids")
    out = df.withColumn("__same", own).join(ids, F.col("__same") == F.col("__own"), "left")
    return out.withColumn("__id", F.coalesce("__rank", F.lit(LAST))).drop("__same", "__own", "__rank")


def _dedup(df: DataFrame, text: str, doc_id: str, length: int) -> DataFrame:
    scratch = Scratch(df.sparkSession)
    keep = others(df, *MADE)
    df = _with_ranks(df, doc_id, scratch)
    t = F.coalesce(pick(df, text, "string"), F.lit(""))
    key = F.xxhash64(t, F.octet_length(t))
    docs = df.select(t.alias("t"), key.alias("key"), F.col("__id").alias("id"))
    sums = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rounds = _Rounds(length, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sums // (24 << 20) + 1))
    owners = scratch.save(docs.where(F.octet_length("t") >= length).groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "owners")
    k1, k2 = 24, 40

    # Round 1: which representatives of 24 bytes two different texts or more have.
    def first_make(it):
        for rb in it:
            key = rb.column(1).to_numpy()
            names, texts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for ranks, rows in rounds.ranked(rb):
                rep, row = ranks.representatives(k1), ranks.row[ranks.windows]
                begin = _runs(rep, ranks.windows, row)
                rep, row = rep[begin], row[begin]
                order = np.lexsort((rep, row))
                rep, row = rep[order], row[order]
                fresh = np.append(True, (rep[1:] != rep[:-1]) | (row[1:] != row[:-1]))[: len(rep)]
                names.append(rep[fresh]), texts.append(key[rows[row[fresh]]])
            names, texts = np.concatenate(names), np.concatenate(texts)
            for arrays in rounds.packed([names, texts]):
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "c0", "c1"])

    def first_gather(it):
        for name, text in rounds.gathered(it, [U, np.int64]):
            order = np.lexsort((text, name))
            name, text = name[order], text[order]
            fresh = np.append(True, (name[1:] != name[:-1]) | (text[1:] != text[:-1]))
            name, text = name[fresh], text[fresh]
            starts = _starts(name)
            shared = _spread(starts, len(name), np.diff(np.append(starts, len(name))) > 1)
            yield pa.RecordBatch.from_arrays([pa.array(text[shared]), pa.array((name[shared] & U(0xFFFF)).astype(np.uint16).view(np.int16))], names=["key", "tag"])

    tags = _packets(docs.select("t", "key"), rounds, first_make, first_gather, [U, np.int64], "key long, tag short", scratch, "round-1")
    tags = scratch.save(_listed(tags, "tag").join(owners, "key").select("key", "tag", "least"), "tags")

    # Round 2: stretches of windows; settled where all of a representative's are alike.
    def second_make(it):
        for rb in it:
            key, least = rb.column(1).to_numpy(), rb.column(3).to_numpy()
            parts = [[] for _ in range(4)]
            for ranks, rows in rounds.ranked(rb):
                keep = _tagged(ranks, k1, [rb.column(2)[int(r)] for r in rows])
                rep, name, row, _, _ = _segments(ranks, k2, keep)
                for p, x in zip(parts, (rep, name, key[rows[row]], least[rows[row]])):
                    p.append(x)
            rep, name, text, own = (np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, (U, U, np.int64, np.int64)))
            order = np.lexsort((text, own, name, rep))
            rep, name, text, own = rep[order], name[order], text[order], own[order]
            same = np.append(False, (rep[1:] == rep[:-1]) & (name[1:] == name[:-1]) & (text[1:] == text[:-1]))[: len(rep)]
            rep, name, text, own = rep[~same], name[~same], text[~same], own[~same]
            starts = np.flatnonzero(np.append(True, (rep[1:] != rep[:-1]) | (name[1:] != name[:-1]))) if len(rep) else np.zeros(0, np.int64)
            lose = own > _spread(starts, len(rep), own[starts]) if len(rep) else np.zeros(0, bool)
            # what a smaller id of this batch has is lost whatever others have; it is sent by the range of its own text's key
            for arrays in rounds.packed([np.concatenate([rep[~lose], mix(text[lose].view(U))]), np.concatenate([name[~lose], name[lose]]), np.concatenate([text[~lose], text[lose]]), np.concatenate([own[~lose], np.full(lose.sum(), -LAST)])]):
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "c0", "c1", "c2", "c3"])

    def second_gather(it):
        for rep, name, text, own in rounds.gathered(it, [U, U, np.int64, np.int64]):
            lost = own == -LAST
            out_key, out_name, out_state = [text[lost]], [name[lost]], [np.zeros(lost.sum(), np.int8)]
            rep, name, text, own = rep[~lost], name[~lost], text[~lost], own[~lost]
            order = np.lexsort((text, own, name, rep))
            rep, name, text, own = rep[order], name[order], text[order], own[order]
            if len(rep):
                same = np.append(False, (rep[1:] == rep[:-1]) & (name[1:] == name[:-1]) & (text[1:] == text[:-1]))
                rep, name, text, own = rep[~same], name[~same], text[~same], own[~same]
                g = np.flatnonzero(np.append(True, (rep[1:] != rep[:-1]) | (name[1:] != name[:-1])))
                lose = own > _spread(g, len(rep), own[g])
                r = _starts(rep)
                kinds = np.add.reduceat(np.append(True, (rep[1:] != rep[:-1]) | (name[1:] != name[:-1])).astype(np.int64), r)
                differ = _spread(r, len(rep), kinds > 1) & ~lose
                for where, state in ((lose, 0), (differ, 1)):
                    out_key.append(text[where]), out_name.append(name[where]), out_state.append(np.full(where.sum(), state, np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_key, out_name, out_state)], names=["key", "name", "state"]).set_column(1, "name", pa.array(np.concatenate(out_name).view(np.int64)))

    tagged = docs.select("t", "key").join(tags, "key").select("t", "key", "tag", "least")
    states = _packets(tagged, rounds, second_make, second_gather, [U, U, np.int64, np.int64], "key long, name long, state byte", scratch, "round-2")
    states = states.groupBy("key").agg(F.collect_set(F.when(F.col("state") == 0, F.col("name"))).alias("lost"), F.collect_set(F.when(F.col("state") == 1, F.col("name"))).alias("open"))
    states = scratch.save(tags.join(states, "key").select("key", "tag", "least", "lost", "open"), "states")

    # Round 3: single windows of the stretches that are still open.
    def third_make(it):
        for rb in it:
            key, least = rb.column(1).to_numpy(), rb.column(3).to_numpy()
            parts = [[] for _ in range(4)]
            for ranks, rows in rounds.ranked(rb):
                keep = _tagged(ranks, k1, [rb.column(2)[int(r)] for r in rows])
                _, name, row, win, count = _segments(ranks, k2, keep)
                open_ = _among(name, row, [rb.column(4)[int(r)] for r in rows])
                at = _expand(win[open_], count[open_])
                full, r = ranks.named(length)[at], ranks.row[at]
                for p, x in zip(parts, (full, at - ranks.offsets[r], key[rows[r]], least[rows[r]])):
                    p.append(x)
            name, pos, text, own = (np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, (U, np.int64, np.int64, np.int64)))
            order = np.lexsort((own, name))
            name, pos, text, own = name[order], pos[order], text[order], own[order]
            g = _starts(name)
            lose = own > _spread(g, len(name), own[g]) if len(name) else np.zeros(0, bool)
            for arrays in rounds.packed([np.concatenate([name[~lose], mix(text[lose].view(U))]), np.concatenate([pos[~lose], pos[lose]]), np.concatenate([text[~lose], text[lose]]), np.concatenate([own[~lose], np.full(lose.sum(), -LAST)])]):
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "c0", "c1", "c2", "c3"])

    def third_gather(it):
        for name, pos, text, own in rounds.gathered(it, [U, np.int64, np.int64, np.int64]):
            lost = own == -LAST
            k, p = [text[lost]], [pos[lost]]
            name, pos, text, own = name[~lost], pos[~lost], text[~lost], own[~lost]
            order = np.lexsort((own, name))
            name, pos, text, own = name[order], pos[order], text[order], own[order]
            g = _starts(name)
            if len(name):
                lose = own > _spread(g, len(name), own[g])
                k.append(text[lose]), p.append(pos[lose])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)), pa.array(np.concatenate(p))], names=["key", "pos"])

    opened = scratch.save(states.where(F.size("open") > 0).select("key", "tag", "least", "open"), "opened")
    opened = docs.select("t", "key").join(opened, "key").select("t", "key", "tag", "least", "open")
    places = _packets(opened, rounds, third_make, third_gather, [U, np.int64, np.int64, np.int64], "key long, pos long", scratch, "round-3")
    verdict = owners.where("copies > 1").select("key", "least").join(states.where(F.size("lost") > 0).select("key", "tag", "lost"), "key", "full").join(places.groupBy("key").agg(F.collect_set("pos").alias("pos")), "key", "full")
    verdict = scratch.save(verdict.select("key", "least", F.when(F.size("lost") > 0, F.col("tag")).alias("tag"), "lost", "pos"), "verdict")

    dressed = df.select(t.alias("t"), key.alias("key"), F.col("__id").alias("id"), F.struct(*keep).alias("row") if keep else F.struct(F.lit(0)).alias("row"))
    dressed = dressed.join(verdict, "key", "left").select("t", "key", "tag", "lost", "pos", "least", "id", "row")

    def finish(it):
        for rb in it:
            offsets, data = utf8(rb.column(0))
            least, own = rb.column(5).to_pylist(), rb.column(6).to_pylist()
            long = np.diff(offsets) >= length
            copy = np.array([l is not None and i > l for l, i in zip(least, own)], bool) & long
            look = np.flatnonzero(long & ~copy & np.array([x.is_valid and len(x) > 0 for x in rb.column(3)], bool))
            covered: dict[int, list] = {int(i): [np.asarray(rb.column(4)[int(i)].as_py(), np.int64)] for i in np.flatnonzero(long & ~copy & np.array([x.is_valid for x in rb.column(4)], bool))}
            if len(look):
                o, d = utf8(rb.column(0).take(pa.array(look)))
                for a, b in steps(o, STEP):
                    ranks = Ranks(d[o[a] : o[b]], o[a : b + 1] - o[a], length)
                    rows = look[a:b].tolist()
                    _, name, row, win, count = _segments(ranks, k2, _tagged(ranks, k1, [rb.column(2)[i] for i in rows]))
                    lost = _among(name, row, [rb.column(3)[i] for i in rows])
                    at = _expand(win[lost], count[lost])
                    r = ranks.row[at]
                    cuts = np.searchsorted(r, np.arange(len(rows) + 1))
                    for i, x, y in zip(rows, cuts[:-1], cuts[1:]):
                        covered.setdefault(i, []).append(at[x:y] - ranks.offsets[r[x:y]])
            kept, gone, spans = [], [], []
            for i in range(len(rb)):
                mine = data[offsets[i] : offsets[i + 1]]
                here = [(0, len(mine))] if copy[i] else removed_spans(np.concatenate(covered[i]), length, len(mine)).tolist() if i in covered else []
                at, out = 0, []
                for a, b in here:
                    out.append(mine[at:a].tobytes())
                    at = b
                kept.append(b"".join([*out, mine[at:].tobytes()])), gone.append(sum(b - a for a, b in here)), spans.append(len(here))
            arrays = [rb.column(7), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (np.diff(offsets), gone, spans)], pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "text", "n_bytes", "n_removed", "n_spans", "kept"])

    out = dressed.mapInArrow(finish, StructType([dressed.schema["row"], *StructType.fromDDL("text binary, n_bytes long, n_removed long, n_spans long, kept string").fields]))
    return out.select(*([F.col(f"row.`{c}`") for c in dressed.schema["row"].dataType.names] if keep else []), "text", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def _tagged(ranks: Ranks, k: int, tags: list) -> np.ndarray:
    """Which windows have a representative whose 16-bit tag is in their row's list: all that another text may have."""
    rep, row = ranks.representatives(k), ranks.row[ranks.windows]
    begin = _runs(rep, ranks.windows, row)
    lists = [np.asarray(t.values.to_numpy(zero_copy_only=False), np.int16).view(np.uint16).astype(np.int64) + (i << 16) for i, t in enumerate(tags) if t.is_valid and len(t)]
    if not lists or not len(begin):
        return np.zeros(len(rep), bool)
    known, mine = np.sort(np.concatenate(lists)), (rep[begin] & U(0xFFFF)).astype(np.int64) + (row[begin] << 16)
    found = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
    return np.repeat(found, np.diff(np.append(begin, len(rep))))


def _among(name: np.ndarray, row: np.ndarray, lists: list) -> np.ndarray:
    """Which stretches are named in their row's list."""
    out = np.zeros(len(name), bool)
    cuts = np.searchsorted(row, np.arange(len(lists) + 1))
    for i, x in enumerate(lists):
        if x.is_valid and len(x) and cuts[i + 1] > cuts[i]:
            out[cuts[i] : cuts[i + 1]] = np.isin(name[cuts[i] : cuts[i + 1]], x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(U))
    return out


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
