"""Benchmark decontamination: q-gram lemma filtering over diagonal bands, then banded alignment."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import Scratch, aliased, arrow_rows, mix, others, pick, small, steps, text_key, trim, utf8

#: ASCII letters and digits stay (letters in lower case), as do bytes of other characters (folded before); all else parts words.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_PLAIN[65:91] = np.arange(97, 123)


#: Texts, and bytes of them, that Python holds at a time where leaks are saved.
BATCH, BATCH_BYTES = 2000, 8 << 20
#: Characters from here on neither fold nor combine (beyond the last compatibility ideographs).
_FOLDS = 0x30000


def folded(text: str) -> str:
    """text with case folded in all scripts, in composed form."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character: whether it may merge with those before it, how many bytes it folds to (0 where it stays), and these bytes."""
    joins, size, out = np.zeros(_FOLDS, bool), np.zeros(_FOLDS, np.int64), np.zeros((_FOLDS, 12), np.uint8)
    joins[0x1161:0x1176] = joins[0x11A8:0x11C3] = True  # Hangul vowels and finals
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, _FOLDS)):  # without ideographs and whole Hangul
        char = chr(c)
        parts = unicodedata.decomposition(char)
        if parts and parts[0] != "<" and " " in parts:
            joins[int(parts.split()[1], 16)] = True
        joins[c] |= unicodedata.combining(char) > 0
        if (low := folded(char)) != char:
            raw = low.encode()
            size[c], out[c, : len(raw)] = len(raw), list(raw)
    return joins, size, out


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The rows' bytes with case folded and characters composed outside ASCII, and the first byte and the end of what each came from; None if all stays."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return None
    joins, size, out = _folds()
    long = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    b0, b1, b2, b3 = (long[lead + i] for i in range(4))
    code = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
    width = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
    code = np.where(code < _FOLDS, code, 0)
    changed = np.flatnonzero(size[code])
    single = lead[changed], width[changed], size[code[changed]], out[code[changed]]
    marks = np.flatnonzero(joins[code])
    if len(marks):  # with what they follow, they are folded as one
        begin, end = lead[marks], lead[marks] + width[marks]
        base = begin - 1
        for _ in range(3):
            base = np.where((base > 0) & (data[base] & 0xC0 == 0x80), base - 1, base)
        begin = np.where(np.isin(begin, offsets), begin, np.maximum(base, 0))
        first = np.flatnonzero(np.append(True, begin[1:] >= end[:-1]))
        begin, end = begin[first], np.append(end[first[1:] - 1], end[-1])
        raw = [folded(data[a:z].tobytes().decode(errors="replace")).encode() for a, z in zip(begin.tolist(), end.tolist())]
        k = np.searchsorted(begin, single[0], side="right") - 1
        apart = (k < 0) | (single[0] >= end[k])
        sizes = np.array([len(r) for r in raw])
        table = np.zeros((len(raw), max(12, sizes.max())), np.uint8)
        for i, r in enumerate(raw):
            table[i, : len(r)] = list(r)
        wide = np.zeros((int(apart.sum()), table.shape[1]), np.uint8)
        wide[:, :12] = single[3][apart]
        single = np.append(single[0][apart], begin), np.append(single[1][apart], end - begin), np.append(single[2][apart], sizes), np.concatenate([wide, table])
    at, old, new, table = single
    if not len(at):
        return None
    if (old == new).all():
        low, far = data.copy(), np.arange(len(data))
        for i in range(int(new.max())):
            low[at[new > i] + i] = table[new > i, i]
        return low, far, far + 1
    count = np.ones(len(data), np.int64)
    for i in range(1, int(old.max())):
        count[at[old > i] + i] = 0
    count[at] = new
    first = np.repeat(np.arange(len(data)), count)
    low, last, place = data[first], first + 1, (np.cumsum(count) - count)[at]
    for i in range(int(new.max())):
        has = new > i
        low[place[has] + i], last[place[has] + i] = table[has, i], at[has] + old[has]
    return low, first, last


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Case-folded words parted by one space, the rows' new offsets, and the first byte and the end of what each byte stands for."""
    low, first, last = fold(data, offsets) or (data, None, None)
    low = _PLAIN[low]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    at = np.flatnonzero(keep)
    first, last = (at, at + 1) if first is None else (first[at], last[at])
    return low[at], np.searchsorted(first, offsets), first, last


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (8 at most) from each place on, as one number."""
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = (out << np.uint64(8)) | data[i : n + i]
    return out


def banded_edits(pieces: np.ndarray, text: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, budget: int) -> list[tuple[int, int, int] | None]:
    """For each of the pieces (rows, equally long), the least edits that turn it into some part of text[first:last] whose path keeps to the width diagonals from low on (place in text minus place in piece).

    (edits, start, stop) of the first best part, None if it takes more than budget edits.
    """
    (many, m), far, lane = pieces.shape, 1 << 20, np.arange(width, dtype=np.int32)
    column = low[:, None] + np.arange(width + m)
    read = np.where((column >= first[:, None]) & (column < last[:, None]), text[np.clip(column, 0, len(text) - 1)].astype(np.int16), np.int16(256))
    inside = (column >= first[:, None]) & (column <= last[:, None])
    out: list[tuple[int, int, int] | None] = [None] * many
    alive = np.arange(many)
    cost = np.where(inside[:, :width], 0, far).astype(np.int32)
    start = np.tile(lane, (many, 1))
    for i in range(m):
        here = read[:, i : i + width]
        same = cost + np.where(here == 256, far, here != pieces[:, i, None])
        drop = np.full_like(cost, far)  # a byte of the piece that the text lacks
        drop[:, :-1] = cost[:, 1:] + 1
        begin = start.copy()
        begin[:, :-1] = np.where(same <= drop, start, np.roll(start, -1, 1))[:, :-1]
        run = np.minimum(same, drop) - lane  # bytes of the text that the piece lacks
        least = np.minimum.accumulate(run, 1)
        source = np.maximum.accumulate(np.where(run == least, lane, 0), 1)
        cost, start = np.where(inside[:, i + 1 : i + 1 + width], least + lane, far).astype(np.int32), np.take_along_axis(begin, source, 1)
        able = cost.min(1) <= budget
        if not able.any():
            return out
        if not able.all():
            pieces, read, inside, cost, start, alive = (x[able] for x in (pieces, read, inside, cost, start, alive))
    for c, k in zip(range(len(alive)), cost.argmin(1).tolist()):
        begins = int(low[alive[c]])
        out[alive[c]] = int(cost[c, k]), begins + int(start[c, k]), begins + k + m
    return out


@dataclass
class GramIndex:
    """The pieces of a block of benchmark items and the places of their rarest q-grams.

    A piece of m bytes may take e = floor(rate * m) edits, each of which spoils q of its q-grams at most. So of any s of its
    q-grams, s - q * e stay, on diagonals that lie within e of another. Only the s = q * e + least rarest ones are looked up.
    As the pieces of an item overlap, a text's q-grams are first counted on the diagonals of whole items, where each stands once.
    """

    q: int
    items: np.ndarray
    numbers: np.ndarray
    pieces: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    codes: np.ndarray  # sorted
    first: np.ndarray  # into piece_of, offset_of; one more than codes
    piece_of: np.ndarray
    offset_of: np.ndarray
    whole_first: np.ndarray  # into whole_of, whole_at; one more than codes
    whole_of: np.ndarray  # the item's place among all items
    whole_at: np.ndarray
    whole_width: np.ndarray
    whole_needed: np.ndarray
    sieve: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int, rate: float, piece: int, shortest: int, least: int) -> GramIndex:
        cut, items, numbers, wholes, begins = [], [], [], [], []
        for whole, (item, text) in enumerate(rows):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            p, _, _, _ = plain(raw, np.array([0, len(raw)]))
            p = p[int(len(p) > 0 and p[0] == 32) : len(p) - int(len(p) > 1 and p[-1] == 32)]
            if len(p) < max(q, shortest):
                continue
            parts = [(0, len(p))] if len(p) < piece * 3 // 2 else []
            if len(p) > piece:
                parts += [(s, s + piece) for s in (*range(0, len(p) - piece, max(1, piece // 10)), len(p) - piece)]
            for k, (a, z) in enumerate(parts):
                cut.append(p[a:z]), items.append(item), numbers.append(k), wholes.append(whole), begins.append(a)
        budgets = np.array([min(int(rate * len(p)), (len(p) - q + 1 - 1) // q) for p in cut], np.int64)
        all_codes = [grams(p, q) for p in cut]
        flat = np.concatenate(all_codes) if cut else np.zeros(0, np.uint64)
        values, counts = np.unique(flat, return_counts=True)
        codes, piece_of, offset_of, needed = [], [], [], []
        for i, c in enumerate(all_codes):
            rare = np.argsort(counts[np.searchsorted(values, c)], kind="stable")[: q * budgets[i] + least]
            needed.append(max(1, len(rare) - q * budgets[i]))
            codes.append(c[rare]), piece_of.append(np.full(len(rare), i)), offset_of.append(rare)
        codes, piece_of, offset_of = (np.concatenate(x) if cut else np.zeros(0, np.int64) for x in (codes, piece_of, offset_of))
        order = np.argsort(codes, kind="stable")
        unique, first = np.unique(codes[order], return_index=True)
        wholes, begins, needed = np.array(wholes, np.int64), np.array(begins, np.int64), np.array(needed, np.int64)
        width, fewest = np.zeros(len(rows), np.int64), np.full(len(rows), 1 << 40)
        np.maximum.at(width, wholes, 2 * (budgets + 1))  # as wide as two bands of any of its pieces
        np.minimum.at(fewest, wholes, needed)
        known = np.repeat(np.arange(len(unique)), np.diff(np.append(first, len(codes))))
        once = np.unique(np.stack([known, wholes[piece_of[order]], begins[piece_of[order]] + offset_of[order]], 1), axis=0) if cut else np.zeros((0, 3), np.int64)
        whole_first = np.searchsorted(once[:, 0], np.arange(len(unique) + 1))
        sieve = np.zeros(1 << 20, bool)
        sieve[(mix(unique.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)] = True
        return cls(q, np.array(items), np.array(numbers), cut, budgets, needed, unique.astype(np.uint64), np.append(first, len(codes)), piece_of[order], offset_of[order], whole_first, once[:, 1], once[:, 2], width, fewest, sieve)

    def near(self, at: np.ndarray, k: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which q-grams (place, code, row) have as many others near their diagonal of some item as its least demanding piece needs."""
        n = self.whole_first[k + 1] - self.whole_first[k]
        entry = np.repeat(self.whole_first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        came, item = np.repeat(np.arange(len(at)), n), self.whole_of[entry]
        band = np.floor_divide(at[came] - self.whole_at[entry], self.whole_width[item])
        if not len(band):
            return came
        least = int(band.min()) - 1
        key = (row[came] * len(self.whole_width) + item) * (int(band.max()) - least + 1) + (band - least)
        both, place, count = np.unique(np.concatenate([key, key - 1]), return_inverse=True, return_counts=True)
        place = place.reshape(2, -1)
        return np.unique(came[(np.maximum(count[place[0]], count[place[1]])) >= self.whole_needed[item]])

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, piece, start, stop, edits) of the pieces found, in bytes of the row's text; the best place of each piece in a row."""
        text, ends, came, gone = plain(data, offsets)
        codes = grams(text, self.q)
        if not len(codes) or not len(self.codes):
            return []
        at = np.flatnonzero(self.sieve[(mix(codes) >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        sure = self.codes[k] == codes[at]
        at, k = at[sure], k[sure]
        row = np.searchsorted(ends, at, side="right") - 1
        whole = at + self.q <= ends[row + 1]
        at, k, row = at[whole], k[whole], row[whole]
        near = self.near(at, k, row)
        at, k, row = at[near], k[near], row[near]
        n = self.first[k + 1] - self.first[k]
        entry = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        piece, diagonal, row = self.piece_of[entry], np.repeat(at, n) - self.offset_of[entry], np.repeat(row, n)
        width = self.budgets[piece] + 1
        band = np.floor_divide(diagonal, width)  # bands of two widths, each half in common with the next
        if not len(band):
            return []
        least = int(band.min()) - 1
        spread, many = int(band.max()) - least + 1, len(self.pieces)
        key = (row * many + piece) * spread + (band - least)
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        key = np.stack([key // spread // many, key // spread % many, key % spread + least], 1)
        best: dict[tuple[int, int], tuple] = {}
        rest: dict[tuple[int, int], list] = {}
        for r, p, b in key[count >= self.needed[key[:, 1]]].tolist():
            e, w, m = int(self.budgets[p]), int(self.budgets[p]) + 1, self.pieces[p]
            lo, hi = b * w - e, (b + 2) * w - 1 + e
            a, z = max(int(ends[r]), lo), min(int(ends[r + 1]), hi + len(m) + 1)
            if z <= a or best.get((r, p), (1,))[0] == 0:
                continue
            same = text[a:z].tobytes().find(m.tobytes())
            if same >= 0:
                best[r, p] = (0, a + same, a + same + len(m))
            else:
                rest.setdefault((len(m), e), []).append((r, p, lo, a, z))
        for (_, e), group in rest.items():
            group = [g for g in group if best.get(g[:2], (1,))[0]]
            for i in range(0, len(group), 512):
                some = group[i : i + 512]
                low, a, z = (np.array(x, np.int64) for x in list(zip(*some))[2:])
                for (r, p, *_), got in zip(some, banded_edits(np.stack([self.pieces[g[1]] for g in some]), text, low, a, z, 4 * e + 2, e)):
                    if got and got < best.get((r, p), (1 << 20,)):
                        best[r, p] = got
        best = {(r, p): (e, int(came[s] - offsets[r]), int(gone[t - 1] - offsets[r])) for (r, p), (e, s, t) in best.items()}
        return [(r, int(self.items[p]), int(self.numbers[p]), s, t, e) for (r, p), (e, s, t) in sorted(best.items())]


def find_leaks(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id", q: int = 8, rate: float = 0.08, piece: int = 100, shortest: int = 24, least: int = 16, block_bytes: int = 4 << 20, keys_alone: bool = False) -> DataFrame:
    """df with leaks: an array of (item_id, piece, start, stop, edits) for the benchmark pieces found in each whole text.

    Texts are compared as words parted by single spaces (other ASCII characters part words), case folded in all scripts and
    characters composed (NFC); start and stop are bytes of the text as it came. Items longer than
    piece bytes are cut into pieces of that length, one begun every tenth of it; those under 1.5 * piece bytes (or no longer than
    one piece) are also looked for whole. A piece is found where rate of its bytes in edits suffice. So where only part of an item
    leaked, any piece bytes of it lie within a twentieth of piece of one (5 of the 8 edits that 100 bytes may take, so 3 more
    are borne wherever the part begins), and from 1.1 * piece bytes on they hold a whole one. Shorter parts may be missed, as
    may parts of items no longer than a piece that lack more than rate of it.

    Items that are null or have fewer than shortest such bytes are too short to tell a leak and are left out. Item ids may be of
    any type, null or repeated (then leaks name them so). Null and empty texts have no leaks; repeated rows get equal results; an
    empty table or benchmark gives no leaks; an input column called leaks is replaced, all others stay whatever their names.

    Items are broadcast in blocks of about block_bytes. One block is searched on the way of the rows. Of several, each is a
    job of its own over the texts, that saves what it found by the texts' keys, and the rows meet it at the end: a task holds
    one block's index at a time, however large the benchmark is. With keys_alone, the result is only the keys (__k1, __k2) of
    the texts that have leaks, saved: Python then gets nothing but texts and keys, some megabytes at a time.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    it = pick(benchmark, item_text, "string")
    bench = benchmark.where(it.isNotNull()).select(pick(benchmark, item_id).alias("i"), it.alias("t"))
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    id_type = bench.schema["i"].dataType
    hit = StructType([StructField("item_id", id_type), *StructType.fromDDL("piece int, start long, stop long, edits int").fields])
    kind = to_arrow_type(ArrayType(hit))
    keep = others(df, "leaks")
    t = pick(df, text, "string")
    k1, k2 = text_key(t)
    rows = df.select(t.alias("__t"), (F.struct(*keep) if keep else F.struct(F.lit(0))).alias("__row"), k1.alias("__k1"), k2.alias("__k2"))

    def searched(texts: DataFrame, carried: list[str], block: int, hits_alone: bool) -> DataFrame:
        """The texts' leaks of one block's items, with the carried columns."""
        items = sorted((tuple(r) for r in bench.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect()), key=lambda r: (str(r[0]), r[1]))
        ids = [i for i, _ in items]
        shared = spark.sparkContext.broadcast(GramIndex.build([(k, x) for k, (_, x) in enumerate(items)], q, rate, piece, shortest, least))

        def run(batches):
            index = shared.value
            for rb in batches:
                offsets, data = utf8(rb.column(0))
                found: list[list] = [[] for _ in range(len(rb))]
                for a, z in steps(offsets):
                    for r, item, k, s, t, e in index.search(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]):
                        found[a + r].append({"item_id": ids[item], "piece": k, "start": s, "stop": t, "edits": e})
                out = pa.RecordBatch.from_arrays([*rb.columns[1:], pa.array(found, kind)], names=[*carried, "leaks"])
                yield out.filter(pa.array([bool(x) for x in found], pa.bool_())) if hits_alone else out
                del rb, offsets, data, found, out
                trim()

        return texts.select("__t", *carried).mapInArrow(run, StructType([*[texts.schema[c] for c in carried], StructField("leaks", ArrayType(hit))]))

    if blocks == 1 and not keys_alone:
        out = searched(rows, ["__row"], 0, False)
    else:
        with arrow_rows(spark, BATCH, BATCH_BYTES):
            parts = [scratch.save(searched(rows, ["__k1", "__k2"], b, True), f"leaks-{b}") for b in range(blocks)]
        if keys_alone:
            return functools.reduce(DataFrame.unionByName, parts).select("__k1", "__k2").distinct()
        found = functools.reduce(DataFrame.unionByName, parts).select("__k1", "__k2", F.explode("leaks").alias("leak")).groupBy("__k1", "__k2").agg(F.collect_set("leak").alias("leaks"))
        found = scratch.save(found, "leaks")
        out = rows.join(small(found, scratch, "leaks"), ["__k1", "__k2"], "left").select("__row", F.coalesce("leaks", F.array().cast(ArrayType(hit))).alias("leaks"))
    return out.select(*([f"__row.`{f}`" for f in out.schema["__row"].dataType.names] if keep else []), "leaks")


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of df in which find_leaks finds nothing, with all their columns; null and empty texts stay, as do repeated rows."""
    name, scratch = options.pop("text", "text"), Scratch(df.sparkSession)
    if name not in df.columns:
        return df
    renamed, back = aliased(df)
    text = f"__c{df.columns.index(name)}"
    leaky = scratch.save(find_leaks(renamed, benchmark, text=text, **options, keys_alone=True), "leaky")
    k1, k2 = text_key(pick(renamed, text, "string"))
    return renamed.withColumns({"__k1": k1, "__k2": k2}).join(small(leaky, scratch, "leaky"), ["__k1", "__k2"], "left_anti").select(*back.values())


def op1(spark, sf_dir: str) -> DataFrame:
    """A row for each document and leaked item: its pieces found, first and last byte, and fewest edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("l")).groupBy("doc_id", "l.item_id").agg(F.count("*").alias("n_pieces"), F.min("l.start").alias("start"), F.max("l.stop").alias("stop"), F.min("l.edits").alias("edits"))
