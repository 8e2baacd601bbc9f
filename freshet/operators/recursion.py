"""WITH RECURSIVE with set semantics: semi-naive rounds on the driver, each round's new rows in the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.text import closing, split, tokens, trimmed
from ..sources.tables import remove, shared_dir


def fixpoint(base: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = 10_000) -> DataFrame:
    """The least set that holds base and step of itself. step gets the rows that the last round added, and all rows so far.

    A round is one job: it writes what is new, by an anti-join of what the step found with all rows, and counts it on the way.
    Rows are dealt by their own hash, so that equal ones meet; NULLs equal one another. The rounds' files are removed
    when the session ends.
    """
    spark, root = base.sparkSession, f"{shared_dir(base.sparkSession)}/freshet-rec-{uuid.uuid4().hex}"
    atexit.register(remove, spark, root)
    schema, names = base.schema, base.columns

    def save(df: DataFrame, i: int) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/{i}")
        return seen.get["n"]

    def read(*rounds: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{root}/{i}" for i in rounds])

    if not save(base.distinct(), 0):
        return read(0)
    for i in range(1, most_rounds + 1):
        have = read(*range(i)).alias("have")
        found = step(read(i - 1), read(*range(i)))
        found = found.select(*[F.col(f"`{c}`").cast(f.dataType).alias(n) for c, f, n in zip(found.columns, schema, names)]).distinct().alias("found")
        same = reduce(lambda x, y: x & y, [F.col(f"found.`{c}`").eqNullSafe(F.col(f"have.`{c}`")) for c in names])
        if not save(found.join(have, same, "left_anti"), i):
            return read(*range(i))
    raise RuntimeError("the recursion did not settle")


def naive(base: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 10_000) -> DataFrame:
    """The same set with step over all rows in every round: for steps whose rows don't follow from single rows alone."""
    return fixpoint(base, lambda new, every: step(every), most_rounds)


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) that edges (src, dst) lead from and to, in rounds that double the paths' length: their number is the logarithm of the longest."""

    def longer(new: DataFrame, every: DataFrame) -> DataFrame:
        def joined(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.alias("a").join(b.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))

        return joined(new, every).union(joined(every, new))

    return fixpoint(edges.select("src", "dst"), longer)


def _mentions(toks: list[str], name: str) -> list[int]:
    return [i for i, t in enumerate(toks) if t.strip("`").lower() == name.lower() and (i == 0 or toks[i - 1] != ".")]


def _sources(toks: list[str], name: str) -> list[int]:
    """Where name is read from: after FROM, JOIN or a comma of a FROM list, not before a dot."""
    out = []
    for i in _mentions(toks, name):
        before = next((t.upper() for t in reversed(toks[:i]) if t != " "), "")
        if before in ("FROM", "JOIN", ",") and toks[i + 1 : i + 2] != ["."]:
            out.append(i)
    return out


def _terms(body: list[str]) -> list[list[str]]:
    """The parts of a body between its outermost UNIONs (ALL or not: a recursion's rows are a set)."""
    terms, depth, skip = [[]], 0, False
    for t in body:
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.upper() == "UNION":
            terms.append([])
            skip = True
        elif skip and t.upper() in ("ALL", "DISTINCT"):
            skip = False
        else:
            skip = skip and t == " "
            terms[-1].append(t)
    return [trimmed(t) for t in terms]


def run(spark: SparkSession, sql: str, settle: Callable[[SparkSession, str], str] = lambda spark, sql: sql) -> DataFrame:
    """A query's rows. WITH RECURSIVE is worked out to its fixpoint; settle may rewrite each part before it is run.

    Of a part that reads the recursive table once, only the last round's rows are put in; of one that reads it more than once, they
    are put in each place in turn, with all rows in the others.
    """
    toks = tokens(sql)
    words = [i for i, t in enumerate(toks) if t != " "]
    if [toks[i].upper() for i in words[:2]] != ["WITH", "RECURSIVE"]:
        return spark.sql(settle(spark, sql))
    made: list[str] = []

    def view(df: DataFrame, name: str) -> str:
        made.append(f"__rec_{uuid.uuid4().hex}_{name}")
        df.createOrReplaceTempView(made[-1])
        return made[-1]

    def ask(part: list[str]) -> DataFrame:
        return spark.sql(settle(spark, "".join(part)))

    try:
        rest, known = toks[words[1] + 1 :], {}

        def renamed(part: list[str], names: dict[str, str]) -> list[str]:
            part = list(part)
            for name, new in names.items():
                for i in _sources(part, name):
                    aliased = next((t for t in part[i + 1 :] if t != " "), "")
                    bare = aliased.upper() in ("", ")", ",", "WHERE", "JOIN", "ON", "GROUP", "ORDER", "UNION", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "HAVING", "LIMIT", "USING", "INTERSECT", "EXCEPT")
                    part[i] = f"{new} AS {name}" if bare else new
            return part

        while True:
            rest = trimmed(rest)
            name, columns, at = rest[0].strip("`"), None, 1
            while rest[at] == " ":
                at += 1
            if rest[at] == "(":
                end = closing(rest, at)
                columns = [c[0].strip("`") for c in split(rest[at + 1 : end])]
                at = end + 1
            at = next(i for i in range(at, len(rest)) if rest[i] == "(")
            end = closing(rest, at)
            body, rest = trimmed(rest[at + 1 : end]), trimmed(rest[end + 1 :])
            terms = _terms(body)
            steps = [t for t in terms if _sources(t, name)]
            if not steps:
                out = ask(renamed(body, known))
                out = out.toDF(*columns) if columns else out
            else:
                starts = [ask(renamed(t, known)) for t in terms if not _sources(t, name)]
                if not starts:
                    raise ValueError(f"{name} has no part to begin with")
                base = reduce(DataFrame.union, starts)
                base = base.toDF(*columns) if columns else base

                def step(new: DataFrame, every: DataFrame, steps=steps, name=name) -> DataFrame:
                    few, all_ = view(new, name), view(every, name)
                    parts = []
                    for t in steps:
                        spots = _sources(t, name)
                        for spot in spots:
                            part = [f"__spot{i == spot:d}" if i in spots else x for i, x in enumerate(t)]
                            parts.append(ask(renamed(renamed(part, {"__spot1": few, "__spot0": all_}), known)) if len(spots) > 1 else ask(renamed(renamed(t, {name: few}), known)))
                    return reduce(DataFrame.union, parts)

                out = fixpoint(base, step)
            known[name] = view(out, name)
            if rest[:1] != [","]:
                return ask(renamed(rest, known))
            rest = rest[1:]
    finally:
        for name in made:
            spark.catalog.dropTempView(name)
