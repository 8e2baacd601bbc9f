"""The pipeline's stages against brute force, each on its own input, and the whole run against the chain of them."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

draw = random.Random(8)
SOUNDS = {"en": "the and with that ing tion er on".split(), "de": "der und nicht sch ein ich en ge".split(), "fr": "le et dans que ment tion eau ou".split()}
ITEMS = [" ".join(f"{draw.choice('bcdfgh')}{k}question{i}" for k in range(12)) for i in range(4)]


def prose(lang, n):
    return " ".join("".join(draw.choices(SOUNDS[lang], k=2)) for _ in range(n))


def make():
    rows, truth = [], {}
    for i in range(60):
        lang = list(SOUNDS)[i % 3]
        text = prose(lang, 40)
        if i % 4 == 0:
            text += "\nAll rights reserved.\n" + prose(lang, 20)
        if i % 10 == 3:
            text += " " + ITEMS[i % 4]
        rows.append((i, text, lang, f"s{i % 4}" if i % 7 else None))
    rows += [(60 + k, rows[k][1], rows[k][2], "s1") for k in (1, 2, 5)]  # copies
    rows += [(70 + k, rows[k][1] + " end", rows[k][2], "s2") for k in (1, 6)]  # near copies
    rows += [(80, "12 34 --- 56", "en", "s1"), (81, None, None, None), (82, "", "en", "s0"), (83, " \n ", "en", "s0"), (84, "All rights reserved.", "en", "s0"), (None, prose("en", 30), "en", "s3"), (None, prose("en", 31), None, "s3")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


ROWS = make()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame([*enumerate(ITEMS), (None, None), (9, "short")], "item_id long, text string").write.parquet(f"file://{root}/benchmark.parquet")
    return f"file://{root}"


def odd(spark, rows=None):
    """The documents with extra columns that have the operators' own names, one with a dot."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    for name in ("lang_pred", "score", "n_dropped", "n_shingles", "component_id", "leaks", "u", "md5", "p", "q", "cut", "bucket", "row", "a.b", "__t", "t1"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def after_language(rows):
    return [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]


def after_lines(rows):
    keys = lambda t: [x.strip(" \t\n\v\f\r").lower() for x in (t or "").split("\n")]
    count = collections.Counter(k for r in rows for k in set(keys(r[1])) if k)
    out = []
    for r in rows:
        kept = [x for x, k in zip((r[1] or "").split("\n"), keys(r[1])) if count[k] < 10]
        text = r[1] if len(kept) == len(keys(r[1])) else "\n".join(kept)
        out.append((r[0], text, r[2], r[3], len(text) if text is not None else None))
    return out


def after_copies(rows):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            k = find(i)
            if k not in best or (r[0] is None, r[0] or 0) < (rows[best[k]][0] is None, rows[best[k]][0] or 0):
                best[k] = i
    return [r for i, r in enumerate(rows) if not sets[i] or i in best.values()]


def after_leaks(rows):
    return [r for r in rows if not any(item in (r[1] or "") for item in ITEMS)]


def key(r):
    return tuple((x is not None, x) for x in r[:5])


BRUTE = {"language ID": after_language, "line dedup": after_lines, "n-gram Jaccard join": after_copies, "benchmark decontamination": after_leaks}


@pytest.mark.parametrize("name", BRUTE)
def test_stage(spark, sf, name):
    stage = dict(pipeline.STAGES)[name]
    df = odd(spark)
    out = stage(spark, df, sf)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    assert sorted(map(key, got)) == sorted(map(key, BRUTE[name](ROWS)))
    assert all(r[c] == f"own {c}" for r in got for c in df.columns[5:])
    assert stage(spark, df.limit(0), sf).count() == 0


def test_mix(spark, sf):
    df = odd(spark).drop("row")
    out = pipeline.mix(spark, df, sf)
    assert out.columns == [*df.columns, "size", "copies", "taken"]
    got = out.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[3]] += words(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight, left, target = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, float(sum(sizes.values())), {}
    open_ = set(names)
    while open_:  # deal what is left by weight; who would pass the cap stops at it
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r["size"] == words(r.text) and r.taken == r.copies * r["size"] and 0 < r.copies <= 3 for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(words(r[1]) for r in ROWS if r[3] == s)
    assert pipeline.mix(spark, df.limit(0), sf).count() == 0


def test_run(spark, sf):
    want = ROWS
    for step in BRUTE.values():
        want = step(want)
    got = pipeline.run(spark, sf).collect()
    again = pipeline.run(spark, sf).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    want = {key(r) for r in want if r[1]}
    assert {key(r) for r in got} <= want and len(got) > 0.5 * len({k for k in want})
    assert [name for name, _ in pipeline.STAGES] == [*BRUTE, "mixing sources to target weights"]
