"""Exact n-gram Jaccard self-join by PartEnum signatures.

Sets of nearly equal size that are similar enough differ in k elements at most (labels_of). The domain is dealt into n1
partitions by hash, and each of these into PARTS smaller ones. In some of the n1, the two sets differ in SPOILT = 1 smaller
partition at most, so they agree in some PARTS - SPOILT smaller ones of it. Each set signs with every such choice: the hash of
its elements in them. Sets that share no signature can't be similar enough.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, mix, pick, shingles_of, small, steps, text_key, trim, utf8
from .graph import components

RATIO = 2.0  # of a size band's ends
SLACK = 1.2  # partitions over the least number
#: Smaller partitions of each partition, and how many of them may differ. A signature covers all but SPOILT of them.
PARTS, SPOILT = 3, 1
MADE = ("n_shingles", "component_id")
#: Groups of one signature up to this size give all their pairs, larger ones a star at first.
GROUP = 64
#: Members of a family that meet a block of its strays at a time.
BLOCK = 512
#: Texts, or pairs of sets, that Python holds at a time.
BATCH = 2000
#: Bytes of a batch that Python gets, where its rows are large.
BATCH_BYTES = 8 << 20
#: Entries in a row that is shuffled.
PACKET = 1 << 15
#: Entries of a bucket that are sorted at a time, about.
SPAN = 1 << 17
#: Bits of a signature beside those that its bucket stands for.
BITS = 40
#: 64-bit words of a set's parity sketch.
SKETCH = 16


def text_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, r = shingles_of(data, offsets, width)
    cuts = np.searchsorted(r, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """The sets' own 64-bit hashes, below 0 never, so that they can stand in a bigint; -1 for an empty set."""
    if len(sets) > 256:
        return np.concatenate([nodes_of(sets[a : a + 256]) for a in range(0, len(sets), 256)])
    count = np.array([len(s) for s in sets], np.int64)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(np.concatenate(sets)) if len(sets) else np.zeros(0, np.uint64)))
    ends = np.cumsum(count)
    total = sums[ends] - sums[ends - count]
    return np.where(count > 0, (mix(total + count.astype(np.uint64)) >> np.uint64(1)).astype(np.int64), -1)


@functools.lru_cache(1 << 16)
def labels_of(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(label, most differences k, partitions n1) of the size bands in which a set of n takes part.

    Band j holds sizes from RATIO**j up to RATIO**(j + 1). Two sets of one band meet under label 2 * j. Sets of bands j and
    j + 1 can only be similar if both lie near the bound between them; they meet under 2 * j + 1. A pair with sizes n and m
    that is similar enough differs in (n + m) * (100 - percent) / (100 + percent) elements at most; n1 is so large that some
    partition has no more than SPOILT of k differences.
    """
    rate = (100 - percent) / (100 + percent)
    j = int(np.floor(np.log(n) / np.log(RATIO) + 1e-9))
    low, high = RATIO**j, RATIO ** (j + 1)
    out = [(2 * j, int(rate * 2 * high))]
    if n * 100 >= high * percent:
        out.append((2 * j + 1, int(rate * (high + high * 100 / percent))))
    if j and n * percent <= low * 100:
        out.append((2 * j - 1, int(rate * (low + low * 100 / percent))))
    return [(label, k, int(SLACK * (k // (SPOILT + 1) + 1)) + (k > 0)) for label, k in out]


class Frequent:
    """Frequent elements (sorted) and how frequent each is: left out of signatures, last in prefixes."""

    def __init__(self, elements: np.ndarray, counts: np.ndarray):
        order = np.argsort(elements)
        self.elements, self.counts = elements[order], counts[order]

    def of(self, elements: np.ndarray) -> np.ndarray:
        """The counts of these elements, 0 for those that are not frequent."""
        if not len(self.elements):
            return np.zeros(len(elements), np.int64)
        at = np.minimum(np.searchsorted(self.elements, elements), len(self.elements) - 1)
        return np.where(self.elements[at] == elements, self.counts[at], 0)


def signatures(sets: list[np.ndarray], percent: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """The signatures of filled sets, the set of each, and for each set (label, sure): in how many of that label's partitions all its choices hold elements.

    Frequent elements are left out, which can only take differences away. Of n1 partitions, k differences spoil k / (SPOILT + 1)
    at most (more than SPOILT in each), so a set that fills more shares a signature that is not empty with every similar
    set. A set that doesn't (few elements are left) also signs with its prefix: the first elements in the order of rarity, then
    hash, of which two similar sets always share one; if it happens to both of a pair, they meet there, and if to one only,
    the other's guarantee holds.
    """
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    size = np.array([len(s) for s in sets], np.int64)
    whole, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    often = frequent.of(whole)
    left, row = whole[often == 0], row[often == 0]
    count = np.bincount(row, minlength=len(sets))
    first = np.cumsum(count) - count
    bands = [(i, *b) for i, n in enumerate(size.tolist()) for b in labels_of(n, percent)]
    of, label, most, parts = (np.array(x, np.int64) for x in zip(*bands))
    n = count[of]
    lane = np.repeat(np.arange(len(of)), n)
    at = np.repeat(first[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    scattered = mix(left[at] + label.astype(np.uint64)[lane])
    begins = np.cumsum(parts) - parts
    cell = (begins[lane] + ((scattered >> np.uint64(8)) % parts.astype(np.uint64)[lane]).astype(np.int64)) * PARTS + (scattered & np.uint64(0xFF)).astype(np.int64) % PARTS
    total, filled = np.zeros(int(parts.sum()) * PARTS, np.uint64), np.zeros(int(parts.sum()) * PARTS, bool)
    np.add.at(total, cell, mix(left)[at])
    filled[cell] = True
    total, filled = total.reshape(-1, PARTS), filled.reshape(-1, PARTS)
    band = np.repeat(np.arange(len(of)), parts)
    own = mix((label[band] << 32 | np.arange(len(band)) - begins[band]).astype(np.uint64))
    total = np.where(filled, mix(total + np.arange(PARTS, dtype=np.uint64) * np.uint64(0x5BF03635)), 0)
    sigs, owners, every = [], [], np.ones(len(band), bool)
    for spoilt in range(PARTS):  # the choices: all smaller partitions but one
        choice = [i for i in range(PARTS) if i != spoilt]
        has = filled[:, choice].any(1)
        every &= has
        sigs.append(mix(total[:, choice].sum(1)[has] + own[has] + np.uint64(spoilt)))
        owners.append(of[band[has]])
    sure_of = np.bincount(band[every], minlength=len(of))
    sure: list[list[tuple[int, int]]] = [[] for _ in sets]
    for i, b, f in zip(of.tolist(), label.tolist(), sure_of.tolist()):
        sure[i].append((b, f))
    rate = (100 - percent) / (100 + percent)
    widest = (rate * (size + size * 100 / percent)).astype(np.int64)
    unsure = np.unique(of[sure_of <= np.minimum(most, widest[of]) // (SPOILT + 1)])
    heads, begin = [], np.cumsum(size) - size
    for i in unsure.tolist():
        mine, its = sets[i], often[begin[i] : begin[i] + size[i]]
        heads.append(mine[np.lexsort((mine, its))[: len(mine) - -(-len(mine) * percent // 100) + 1]])
    extra = mix(np.concatenate(heads) ^ np.uint64(0x5BF0)) if heads else np.zeros(0, np.uint64)
    return np.concatenate([*sigs, extra]), np.concatenate([*owners, np.repeat(unsure, [len(h) for h in heads])]), sure


def parities(sets: list[np.ndarray], words: int = SKETCH) -> np.ndarray:
    """(sets, words) of 64 bits each, in which every element turns one bit: where two sets' bits differ in k places, the sets differ in k elements at least."""
    bits = words * 64
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (mix(np.concatenate(sets) ^ np.uint64(0x51ED)) & np.uint64(bits - 1)).astype(np.int64) if sets else np.zeros(0, np.int64)
    odd = (np.bincount(owner * bits + at, minlength=len(sets) * bits) & 1).astype(np.uint8).reshape(len(sets), bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _batches(it, width: int):
    """(batch, its rows' sets) with each text read whole, some megabytes at a time."""
    for rb in it:
        offsets, data = utf8(rb.column(0))
        sets: list[np.ndarray] = []
        for a, b in steps(offsets):
            sets += text_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        yield rb, sets
        del sets, data
        trim()


def _frequent(docs: DataFrame, width: int, share: int = 8, least: int = 3, most: int = 1 << 20) -> Frequent:
    """Shingles that a hash sample of 1/share of the texts often has, the most frequent ones if there are over most.

    What this list holds changes how many candidates there are, never which links are found.
    """

    def count(it):
        for _, sets in _batches(it, width):
            h, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    sample = docs.where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0).select("t")
    rows = sample.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    got = rows.orderBy(F.desc("c"), "h").limit(most).toArrow()
    h, c = (got.column(i).to_numpy() for i in (0, 1))
    return Frequent(h.view(np.uint64).copy() if len(h) else np.zeros(0, np.uint64), np.array(c, np.int64))


def packets(rb: pa.RecordBatch, sets: list[np.ndarray], percent: int, frequent: Frequent, buckets: int) -> list[tuple]:
    """The rows (bucket, kind, blobs) that a batch of texts (t, k1, k2) with these sets sends: see candidate_groups. Kind 0 is in the order of signatures."""
    nodes = nodes_of(sets)
    fresh = np.unique(nodes, return_index=True)[1]
    fresh = fresh[nodes[fresh] >= 0]
    known = np.sort(nodes[fresh])
    sigs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    for a in range(0, len(fresh), 256):
        part = fresh[a : a + 256]
        g, o, _ = signatures([sets[i] for i in part], percent, frequent)
        sigs.append((g >> np.uint64(BITS)) % np.uint64(buckets) << np.uint64(BITS) | g & np.uint64((1 << BITS) - 1))  # in the order of buckets
        places.append(np.searchsorted(known, nodes[part]).astype(np.uint16)[o])
        del g, o
    sig, place = np.concatenate(sigs), np.concatenate(places)
    del sigs, places
    order = np.argsort(sig)
    sig, place = sig[order], place[order]
    del order
    first = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
    several = ~first | np.append(~first[1:], False)[: len(sig)]
    rest, spots = sig[several], known[place[several]]
    s, n = sig[first], place[first]
    del sig, place, first, several
    edges = np.searchsorted(s, np.arange(buckets + 1).astype(np.uint64) << np.uint64(BITS))
    rows = []
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
        for v in range(x, y, PACKET):
            part = s[v : min(v + PACKET, y)]
            here, spot = np.unique(n[v : min(v + PACKET, y)], return_inverse=True)
            rows.append((k, 0, part.astype(np.uint32).tobytes(), (part >> np.uint64(32)).astype(np.uint8).tobytes(), spot.astype(np.uint16).tobytes(), known[here].tobytes()))
    rows += [(int(rest[v] % np.uint64(buckets)), 1, rest[v : v + PACKET].tobytes(), spots[v : v + PACKET].tobytes(), None, None) for v in range(0, len(rest), PACKET)]
    size = np.array([len(x) for x in sets], np.int64)
    k1, k2 = (rb.column(i).to_numpy() for i in (1, 2))
    rows += [(int(k1[v] % buckets), 2, k1[v : v + PACKET].tobytes(), nodes[v : v + PACKET].tobytes(), k2[v : v + PACKET].tobytes(), size[v : v + PACKET].tobytes()) for v in range(0, len(k1), PACKET)]
    return rows


def common(bucket: int, held: list[list[bytes]]):
    """(sig, node) of the signatures that several sets of a bucket's packets share: a range of signatures at a time, of some SPAN entries."""
    total = sum(len(h[1]) for h in held)
    ranges = min(256, 1 << (total // SPAN).bit_length())
    begins = np.arange(0, 256, 256 // ranges).astype(np.uint8)
    cuts = [np.append(np.searchsorted(np.frombuffer(h[1], np.uint8), begins), len(h[1])) for h in held]  # a packet is in the order of signatures
    for r in range(ranges):
        low, high, place = ([np.frombuffer(h[i], kind)[c[r] : c[r + 1]] for h, c in zip(held, cuts)] for i, kind in enumerate((np.uint32, np.uint8, np.uint16)))
        sig = np.uint64(bucket << BITS) | np.concatenate(high).astype(np.uint64) << np.uint64(32) | np.concatenate(low)
        node = np.concatenate([np.frombuffer(h[3], np.int64)[p] for h, p in zip(held, place)])
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))[: len(sig)]
        sig, node = sig[fresh], node[fresh]
        same = np.append(False, sig[1:] == sig[:-1])[: len(sig)]
        keep = same | np.append(same[1:], False)[: len(sig)]
        if keep.any():
            yield sig[keep], node[keep]


def candidate_groups(docs: DataFrame, width: int, percent: int, frequent: Frequent, buckets: int) -> DataFrame:
    """docs (t, k1, k2) -> rows (sig, node): all signatures that two different sets or more share, and those sets; and rows (node, k1, k2, n): each text's set and its size (no node if it is empty).

    A task sorts the signatures of each batch of texts and sends one set for each, packed by bucket: BITS bits of it (its
    bucket stands for others; a chance match is one more candidate) and the set's place in the packet's list. A signature
    that several sets of the batch share goes out with all of them on its own, dealt by batch, so that a hot signature
    reaches its bucket once for each batch however many texts have it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(it):
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        for rb, sets in _batches(it, width):
            rows = packets(rb, sets, percent, shared.value, buckets)
            del rb, sets
            for a in range(0, max(1, len(rows)), 16):
                part = rows[a : a + 16]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], names=["bucket", "kind", "c0", "c1", "c2", "c3"])
            del rows, part
            trim()

    def batch(sig=None, node=None, k1=None, k2=None, n=None):
        count = len(node)
        columns = [pa.nulls(count, pa.int64()) if c is None else pa.array(c.view(np.int64)) for c in (sig, node, k1, k2, n)]
        return pa.RecordBatch.from_arrays(columns, names=["sig", "node", "k1", "k2", "n"])

    def gather(it):
        at, held = -1, []
        for rb in it:
            for i in range(rb.num_rows):
                bucket, kind, *blobs = (c[i].as_py() for c in rb.columns)
                if kind == 2:
                    k1, node, k2, n = (np.frombuffer(x, np.int64) for x in blobs)
                    yield batch(None, node, k1, k2, n)
                elif kind == 1:
                    yield batch(np.frombuffer(blobs[0], np.uint64), np.frombuffer(blobs[1], np.int64))
                else:
                    if bucket != at and held:
                        yield from (batch(*x) for x in common(at, held))
                        held = []
                        trim()
                    at = bucket
                    held.append(blobs)
        if held:
            yield from (batch(*x) for x in common(at, held))
        held = []
        trim()

    packed = docs.mapInArrow(sign, "bucket int, kind int, c0 binary, c1 binary, c2 binary, c3 binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "sig long, node long, k1 long, k2 long, n long")


def _meet(percent: int, it):
    """Rows (strays, others) of a family's members -> (a, b): the pairs of different components that sizes, the triangle inequality of distances and parity sketches let be similar enough."""
    most = (100 - percent) / 100 + 1e-9

    def members(packs: pa.ListArray, i: int) -> dict[str, np.ndarray]:
        m = packs[i].values
        out = {name: m.field(name).to_numpy(zero_copy_only=False) for name in ("node", "root", "n", "low", "high", "stray")}
        return out | {"sketch": m.field("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)}

    for rb in it:
        got = [np.zeros((2, 0), np.int64)]
        for i in range(rb.num_rows):
            x, y = members(rb.column(0), i), members(rb.column(1), i)
            for k in range(len(x["node"])):
                node, n = x["node"][k], x["n"][k]
                ok = (y["root"] != x["root"][k]) & (~y["stray"] | (y["node"] > node)) & (np.minimum(y["n"], n) * 100 >= np.maximum(y["n"], n) * percent)
                at = np.flatnonzero(ok & (x["low"][k] - y["high"] <= most) & (y["low"] - x["high"][k] <= most))
                apart = np.bitwise_count(y["sketch"][at] ^ x["sketch"][k]).sum(1, dtype=np.int64)
                b = y["node"][at[apart * (100 + percent) <= (y["n"][at] + n) * (100 - percent)]]
                got.append(np.stack([np.minimum(b, node), np.maximum(b, node)]))
        a, b = np.concatenate(got, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links_of(df: DataFrame, *, text: str = "text", percent: int = 75, width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """(texts, links, components): texts has each different text's key (__k1, __k2), its __node (null without words) and n_shingles; links (a, b) join the nodes found similar.

    Every two different sets whose Jaccard similarity is percent or more are linked directly or, in a large group of one
    signature, through sets that are: no component loses a link.
    """
    with arrow_rows(df.sparkSession, BATCH, BATCH_BYTES):
        return _links_of(df, text, percent, width)


def _links_of(df: DataFrame, text: str, percent: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    t = pick(df, text, "string")
    k1, k2 = text_key(t)
    docs = df.select(t.alias("t"), k1.alias("k1"), k2.alias("k2"))
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size * 2 // (16 << 20) + 1)
    frequent = _frequent(docs, width)
    signed = scratch.save(candidate_groups(docs, width, percent, frequent, buckets), "signed")
    groups = scratch.save(signed.where(F.col("sig").isNotNull()).select("sig", "node").distinct(), "groups")
    texts = signed.where(F.col("sig").isNull()).select("node", "k1", "k2", "n").distinct()
    texts = scratch.save(texts.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.when(F.col("node") >= 0, F.col("node")).alias("__node"), F.col("n").alias("n_shingles")), "texts")
    scratch.drop("signed")

    def describe(it):
        """Each set that is in a group: its size and what it is sure to share."""
        known = shared.value
        for _, sets in _batches(it, width):
            seen = {n: s for n, s in zip(nodes_of(sets).tolist(), sets) if n >= 0}
            nodes, held = list(seen), list(seen.values())
            for a in range(0, max(1, len(held)), 256):
                some = held[a : a + 256]
                columns = [pa.array(nodes[a : a + 256], pa.int64()), pa.array([len(s) for s in some], pa.int64()), pa.array(signatures(some, percent, known)[2], pa.map_(pa.int32(), pa.int32())), pa.array([s.tobytes() for s in some], pa.binary()), pa.array(parities(some).tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sure", "elements", "sketch"])

    shared = spark.sparkContext.broadcast(frequent)
    big = scratch.save(groups.groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("sig"), "big")
    big = small(big, scratch, "big")
    few = groups.join(big, "sig", "left_anti")
    pairs = few.join(few.select("sig", F.col("node").alias("b")), "sig").where("node < b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"))
    pairs = scratch.save(pairs, "pairs")
    large = scratch.save(groups.join(big, "sig", "left_semi"), "large")
    # the centre of a large group is the member of most large groups: of edited copies that is what they were made from
    reach = large.groupBy("node").agg(F.count("*").alias("k"))
    centres = large.join(reach, "node").groupBy("sig").agg(F.max_by("node", F.struct("k", "node")).alias("first"))
    large = scratch.save(large.join(centres, "sig"), "large-centred")
    star = large.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    hot = scratch.save(large.select("node").distinct(), "hot")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot).distinct()
    wanted = texts.join(wanted, F.col("__node") == F.col("node"), "left_semi").select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    wanted = scratch.save(wanted, "wanted")
    sets = docs.join(small(wanted, scratch, "wanted"), ["k1", "k2"], "left_semi").select("t").mapInArrow(describe, "node long, n long, sure map<int,int>, elements binary, sketch array<long>")
    sets = scratch.save(sets, "sets")
    facts = scratch.save(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("sure").alias("sure")), "facts")
    facts = small(facts, scratch, "facts")
    is_hot = hot.withColumn("hot", F.lit(True))

    def side(name: str) -> DataFrame:
        return facts.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sure").alias(f"sure_{name}"))

    def fits(pairs: DataFrame) -> DataFrame:
        low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        return pairs.join(side("a"), "a").join(side("b"), "b").where(low * 100 >= high * percent)

    def agree(f: Column, d: Column) -> Column:
        """How many signatures two sets share at least that differ in d elements, if one's f partitions are sure: a difference leaves one of a partition's PARTS choices, a second one in it none."""
        return F.when(d <= f, PARTS * f - (PARTS - 1) * d).otherwise(F.greatest(F.lit(0), 2 * f - d)).cast("bigint")

    differ = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    both = F.map_keys(F.map_filter("sure_a", lambda k, v: F.map_contains_key(F.col("sure_b"), k)))
    least = F.aggregate(both, F.lit(0).cast("bigint"), lambda sum_, k: sum_ + agree(F.greatest(F.col("sure_a")[k], F.col("sure_b")[k]), differ))
    counted = fits(pairs).where(F.col("shared") >= least)
    passed = fits(pairs).join(small(is_hot, scratch, "hot").withColumnRenamed("node", "a"), "a", "left_semi").join(small(is_hot, scratch, "hot").withColumnRenamed("node", "b"), "b", "left_semi")
    stars = scratch.save(fits(star).select("a", "b").distinct(), "stars")  # all measured: how far strays are from their centre
    others = scratch.save(counted.select("a", "b", "n_a", "n_b").union(passed.select("a", "b", "n_a", "n_b")).distinct(), "others")
    sketches = sets.groupBy("node").agg(F.first("sketch").alias("sketch"))
    for x in ("a", "b"):
        others = others.join(sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")), x)
    apart = sum(F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH))
    others = others.where(apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    first = scratch.save(others.select("a", "b").union(stars).distinct(), "first")

    def verify(it):
        for rb in it:
            ok, far = [], []
            for x, y in zip(rb.column(2), rb.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                union = len(np.unique(np.concatenate([p, q])))
                ok.append(100 * (len(p) + len(q) - union) >= percent * union)
                far.append(1 - (len(p) + len(q) - union) / union)
            yield pa.RecordBatch.from_arrays([*rb.columns[:2], pa.array(ok, pa.bool_()), pa.array(far, pa.float64())], names=["a", "b", "ok", "far"])
            trim()

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b), a scratch table, as measured on their sets; sets of no pair stay where they are."""
        needed = scratch.save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{name}-nodes")
        one = sets.select("node", "elements").join(small(needed, scratch, f"{name}-nodes"), "node", "left_semi").dropDuplicates(["node"])
        with_sets = pairs.join(one.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(one.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
        return scratch.save(with_sets.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, ok boolean, far double"), name)

    measured = checked(first, "links")
    links = measured.where("ok").select("a", "b")
    found = scratch.save(components(links, scratch, "cc-first"), "components")
    if hot.limit(1).count():
        # Large groups: a star has joined most of what belongs together. A pair in different components still needs a look
        # only if all that it is sure to share may lie in large groups, if its sizes fit, and if the distances to the
        # star's centre (by the triangle inequality of Jaccard distance) and the parity sketches let it be near enough.
        widest = F.floor((F.col("n") + F.col("n") * 100 / percent) * (100 - percent) / (100 + percent))
        need = F.greatest(F.lit(1), F.array_min(F.transform(F.map_values("sure"), lambda f: agree(f, widest))))
        may = large.groupBy("node").agg(F.count("*").alias("k")).join(facts, "node").where(F.col("k") >= need).select("node", "n")
        may = scratch.save(may.join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")), "may")
        # A family is what has one centre: its members meet once, however many signatures they share. Those of its largest
        # component need no look at one another: only the strays meet all others, in blocks of numpy rows.
        family = large.select("first", "node").distinct().join(may, "node")
        kinds = family.groupBy("first", "root").agg(F.count("*").alias("c"))
        open_ = kinds.groupBy("first").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
        open_ = scratch.save(open_, "open")
        if open_.limit(1).count():
            centre = facts.select(F.col("node").alias("first"), F.col("n").alias("n_first"))
            family = family.join(small(open_, scratch, "open"), "first").join(centre, "first").join(measured.select(F.col("a").alias("first"), F.col("b").alias("node"), "far"), ["first", "node"], "left").join(sketches, "node")
            at_least = 1 - F.least("n", "n_first") / F.greatest("n", "n_first")
            far = F.when(F.col("node") == F.col("first"), 0.0).otherwise(F.col("far"))
            member = F.struct("node", "root", "n", F.coalesce(far, at_least).alias("low"), F.coalesce(far, F.lit(1.0)).alias("high"), (F.col("root") != F.col("main")).alias("stray"), "sketch")
            block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
            packs = scratch.save(family.select("first", "blocks", block.alias("block"), member.alias("m")).groupBy("first", "blocks", "block").agg(F.collect_list("m").alias("others")), "packs")
            strays = packs.select("first", F.filter("others", lambda m: m["stray"]).alias("strays"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where(F.size("strays") > 0)
            with arrow_rows(spark, 16):
                rest = scratch.save(strays.join(packs.select("first", "block", "others"), ["first", "block"]).select("strays", "others").mapInArrow(functools.partial(_meet, percent), "a long, b long"), "met")
            rest = scratch.save(rest.distinct().join(first, ["a", "b"], "left_anti"), "rest")
            more = checked(rest, "more").where("ok").select("a", "b")
            if more.limit(1).count():
                links = links.union(more)
                found = scratch.save(components(links, scratch, "cc-more"), "components-more")

    return texts, links, found, scratch


def _roots(df: DataFrame, text: str, doc_id: str, options: dict) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Scratch]:
    """(keyed, ids, texts, roots): df's rows (as __row) with their text's key and id, the same without the rows' columns, each text's node and size, and each node's root."""
    texts, _, found, scratch = links_of(df, text=text, **options)
    k1, k2 = text_key(pick(df, text, "string"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select((F.struct(*kept) if kept else F.struct(F.lit(0))).alias("__row"), k1.alias("__k1"), k2.alias("__k2"), pick(df, doc_id).alias("__id"))
    nodes = texts.where(F.col("__node").isNotNull()).select("__node").distinct()
    roots = nodes.join(found.withColumnRenamed("node", "__node"), "__node", "left").withColumn("root", F.coalesce("root", "__node"))
    roots = scratch.save(texts.join(roots, "__node", "left"), "roots")
    return keyed, keyed.select("__k1", "__k2", "__id"), texts, roots, scratch


def jaccard_components(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """df with n_shingles (its set's size) and component_id (the smallest doc_id that links reach, itself included).

    Options are percent (75) and width (5). Words are [^\\x20\\x09-\\x0D]+ of the whole text in ASCII lower case; a set is the distinct
    shingles of width words (all words at once if there are fewer), and two sets link when 100 * common >= percent * united. Null,
    empty or blank texts have no shingle and no link. Equal sets are one class from the start. Null doc_ids count in a component
    only if it has no other; repeated rows are all kept; an empty table gives an empty one; input columns called like a result are
    replaced. Sets are told apart by 64-bit hashes; links between different sets are decided on the sets themselves.
    """
    keyed, ids, _, roots, scratch = _roots(df, text, doc_id, options)
    least = ids.join(small(roots, scratch, "roots"), ["__k1", "__k2"]).where(F.col("root").isNotNull()).groupBy("root").agg(F.min("__id").alias("component_id"))
    verdicts = scratch.save(roots.join(least, "root", "left").select("__k1", "__k2", "n_shingles", "component_id"), "verdicts")
    out = keyed.join(small(verdicts, scratch, "verdicts"), ["__k1", "__k2"], "left")
    kept = [F.col(f"__row.`{c}`") for c in df.columns if c.lower() not in MADE]
    return out.select(*kept, "n_shingles", F.coalesce("component_id", "__id").alias("component_id"))


def keep_one(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """df with one row of each component: the one with the smallest doc_id (nulls last), of rows that share it the one whose text hashes lowest.

    Rows that are equal in both keep the one whose other columns hash lowest. Texts without words are in no component, so all
    their rows stay; so do all columns, whatever their names. Which row stays is settled on ids and text keys, and the rows meet
    what is settled once; only tied rows are compared whole, by a partial aggregate.
    """
    keyed, ids, texts, roots, scratch = _roots(df, text, doc_id, options)
    key = F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    slim = ids.join(small(roots, scratch, "roots"), ["__k1", "__k2"]).where(F.col("root").isNotNull()).select("root", key.alias("key"))
    least = slim.groupBy("root", "key").agg(F.count("*").alias("c")).groupBy("root").agg(F.min(F.struct("key", "c")).alias("m"))
    winners = least.select(F.col("m.key.k1").alias("__k1"), F.col("m.key.k2").alias("__k2"), F.col("m.key.id").alias("__first"), F.lit(False).alias("__any"), F.when(F.col("m.c") > 1, F.col("root")).alias("__tied"))
    blank = texts.where(F.col("__node").isNull()).select("__k1", "__k2", F.lit(None).cast(winners.schema["__first"].dataType).alias("__first"), F.lit(True).alias("__any"), F.lit(None).cast("bigint").alias("__tied"))
    winners = scratch.save(winners.unionByName(blank), "winners")
    got = keyed.select("__row", "__k1", "__k2", "__id").join(small(winners, scratch, "winners"), ["__k1", "__k2"]).where(F.col("__any") | F.col("__id").eqNullSafe(F.col("__first")))
    out = got.where(F.col("__tied").isNull()).select("__row")
    if winners.where(F.col("__tied").isNotNull()).limit(1).count():
        tied = got.where(F.col("__tied").isNotNull()).groupBy("__tied").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
        out = out.unionByName(tied.select("__row"))
    return out.select(*[F.col(f"__row.`{c}`") for c in df.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
