"""Ranks over all rows: the windows without PARTITION BY that Spark would sort in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

#: Keys fall into this number of ranges, and each into as many again, which are found by halves.
_WIDE = 32
_STEPS = (16, 8, 4, 2, 1)
#: A function's value of: rows up to the key and before it, keys up to it, all rows and all keys.
_VALUES = {
    "Rank": lambda upto, before, key, rows, keys: (before + 1).cast("int"),
    "DenseRank": lambda upto, before, key, rows, keys: key.cast("int"),
    "PercentRank": lambda upto, before, key, rows, keys: F.when(rows > 1, before.cast("double") / (rows - 1).cast("double")).otherwise(F.lit(0.0)),
    "CumeDist": lambda upto, before, key, rows, keys: upto.cast("double") / rows.cast("double"),
}
#: Nodes that give the same rows each time, if what is below them does; and aggregates that do not hang on their rows' order.
_STEADY = frozenset("Project Filter SubqueryAlias View Generate Join ResolvedHint Union Distinct Intersect Except Sort Aggregate Expand".split())
_EXACT = frozenset("Count Min Max BitAndAgg BitOrAgg BitXorAgg".split())


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _seq(spark: SparkSession, items: list):
    return spark._jvm.PythonUtils.toSeq(items)


def _frame(spark: SparkSession, plan) -> DataFrame:
    return ClassicDataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _column(spark: SparkSession, expression) -> Column:
    return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _steady(plan) -> bool:
    """Whether reading the plan's rows twice gives the same rows, to the last bit."""
    open_ = [plan]
    while open_:
        node = open_.pop()
        kids, kind = _list(node.children()), node.nodeName().split()[0]
        if kind == "CTERelationRef" or kids and kind not in _STEADY or not node.deterministic() or node.subqueries().size():
            return False
        inner = _list(node.expressions()) if kind == "Aggregate" else []
        while inner:
            e = inner.pop()
            if e.nodeName().startswith("Python"):
                return False
            if e.nodeName() == "AggregateExpression":
                f = e.aggregateFunction()
                if f.nodeName() not in _EXACT and not (f.nodeName() == "Sum" and f.dataType().sql().split("(")[0] in ("BIGINT", "DECIMAL")):
                    return False
            inner += _list(e.children())
        open_ += kids
    return True


def _less(a: list[Column], b: list[Column], order: list[tuple[bool, bool]]) -> Column:
    """Whether key a sorts before key b; order holds (ascending, NULLs first) of each column."""

    def one(x: Column, y: Column, up: bool, first: bool) -> Column:
        return F.when(x.isNull(), y.isNotNull() & F.lit(first)).when(y.isNull(), F.lit(not first)).otherwise(x < y if up else x > y)

    parts = [reduce(lambda p, q: p & q, [x.eqNullSafe(y) for x, y in zip(a[:i], b[:i])] + [one(a[i], b[i], *order[i])]) for i in range(len(order))]
    return reduce(lambda p, q: p | q, parts)


def key_places(keys: DataFrame, order: list[tuple[bool, bool]]) -> DataFrame:
    """keys (k0, k1, ..., n), each key once with its number of rows -> the k, and upto, before, key, rows and keys as _VALUES take them.

    The keys fall into ranges at bounds that are the keys of the least hashes, so the same each time they are worked out. A range is
    sorted by itself; only two sums of each of the 1024 ranges meet in one task.
    """
    names = [f"k{i}" for i in range(len(order))]

    def fields(s: Column) -> list[Column]:
        return [s[n] for n in names]

    some = keys.select(*names).orderBy(F.xxhash64(*names), *names).limit(_WIDE * _WIDE - 1)
    by_order = lambda x, y: F.when(_less(fields(x), fields(y), order), -1).when(_less(fields(y), fields(x), order), 1).otherwise(0)
    bounds = some.agg(F.array_sort(F.collect_list(F.struct(*names)), by_order).alias("all"))
    coarse = bounds.select(F.filter("all", lambda x, i: i % _WIDE == _WIDE - 1).alias("among"))
    fine = bounds.select("all", F.explode(F.sequence(F.lit(0), F.lit(_WIDE - 1))).alias("part")).select("part", F.slice("all", F.col("part") * _WIDE + 1, _WIDE - 1).alias("among"))

    def search() -> Column:
        """How many of the bounds in among are not after the key: by halves."""
        mine, at = [F.col(n) for n in names], lambda lo, step: F.get("among", lo + step - 1)
        return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda lo, step: F.when(at(lo, step).isNotNull() & ~_less(mine, fields(at(lo, step)), order), lo + step).otherwise(lo))

    ranged = keys.crossJoin(F.broadcast(coarse)).select(*names, "n", search().alias("part"))
    ranged = ranged.join(F.broadcast(fine), "part").select(*names, "n", (F.col("part") * _WIDE + search()).alias("b"))
    up_to_range, everything = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    sums = ranged.groupBy("b").agg(F.sum("n").alias("bn"), F.count(F.lit(1)).alias("bk"))
    sums = sums.select(F.col("b").alias("range"), *[(F.sum(c).over(up_to_range) - F.col(c)).alias(f"{c}_before") for c in ("bn", "bk")], F.sum("bn").over(everything).alias("rows"), F.sum("bk").over(everything).alias("keys"))
    sorts = [getattr(F.col(n), f"{'asc' if up else 'desc'}_nulls_{'first' if first else 'last'}")() for n, (up, first) in zip(names, order)]
    inside = Window.partitionBy("b").orderBy(*sorts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select(*names, "n", "b", F.sum("n").over(inside).alias("within"), F.row_number().over(inside).alias("i"))
    upto = F.col("bn_before") + F.col("within")
    return placed.join(F.broadcast(sums), F.col("b") == F.col("range")).select(*names, upto.alias("upto"), (upto - F.col("n")).alias("before"), (F.col("bk_before") + F.col("i")).alias("key"), "rows", "keys")


def _ranked(spark: SparkSession, base, rest, windows: list):
    """The plan rest, which has the rows of base, with the columns of these windows."""
    groups: dict[tuple, list] = {}
    for w in windows:
        parts = [(o.child(), o.direction().sql() == "ASC", o.nullOrdering().sql() == "NULLS FIRST") for o in _list(w.orderSpec())]
        back = not parts[0][1]  # an order and its reverse share the keys' places
        order = tuple((up != back, first != back) for _, up, first in parts)
        groups.setdefault((tuple(e.canonicalized().toString() for e, _, _ in parts), order), []).append(([e for e, _, _ in parts], back, w))
    rows, made = _frame(spark, rest), []
    output = _list(rest.output())
    for g, ((_, order), members) in enumerate(groups.items()):
        on = [_column(spark, e) for e in members[0][0]]
        keys = _frame(spark, base).select(*[c.alias(f"k{i}") for i, c in enumerate(on)])
        keys = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n"))
        upto, before, key, all_rows, all_keys = [F.col(c) for c in ("upto", "before", "key", "rows", "keys")]
        forth, reverse = (upto, before, key, all_rows, all_keys), (all_rows - before, all_rows - upto, all_keys - key + 1, all_rows, all_keys)
        columns = [(f"__place{g}_{m}_{j}", alias, (reverse if back else forth)) for m, (_, back, w) in enumerate(members) for j, alias in enumerate(_list(w.windowExpressions()))]
        places = key_places(keys, list(order)).select(*[F.col(f"k{i}").alias(f"__key{g}_{i}") for i in range(len(order))], *[F.coalesce(_VALUES[alias.child().windowFunction().nodeName()](*values), F.lit(0)).alias(name) for name, alias, values in columns])  # never NULL, which Spark is to know
        rows = rows.join(places, reduce(lambda p, q: p & q, [c.eqNullSafe(places[f"__key{g}_{i}"]) for i, c in enumerate(on)]))
        made += [(name, alias) for name, alias, _ in columns]
    plan = rows._jdf.queryExecution().analyzed()
    found = {a.name(): a for a in _list(plan.output()) if a.name().startswith("__place")}
    return spark._jvm.org.apache.spark.sql.catalyst.plans.logical.Project(_seq(spark, output + [alias.withNewChildren(_seq(spark, [found[name]])) for name, alias in made]), plan)


def _spread(spark: SparkSession, node):
    """The plan with such windows replaced, or None if it has none."""
    chain, base = [], node
    while base.nodeName() == "Window":
        chain.append(base)
        base = base.child()
    fit = [
        w.partitionSpec().isEmpty()
        and not w.orderSpec().isEmpty()
        and all(a.nodeName() == "Alias" and a.child().nodeName() == "WindowExpression" and a.child().windowFunction().nodeName() in _VALUES for a in _list(w.windowExpressions()))
        and all(o.deterministic() and o.references().subsetOf(base.outputSet()) and "COLLATE" not in o.dataType().sql() for o in _list(w.orderSpec()))
        for w in chain
    ]
    if any(fit) and _steady(base):
        base = _spread(spark, base) or base
        rest = base
        for w, f in reversed(list(zip(chain, fit))):
            rest = rest if f else w.withNewChildren(_seq(spark, [rest]))
        return _ranked(spark, base, rest, [w for w, f in zip(chain, fit) if f])
    kids = _list(node.children())
    new = [_spread(spark, k) for k in kids]
    return node.withNewChildren(_seq(spark, [n or k for n, k in zip(new, kids)])) if any(n is not None for n in new) else None


def spread(df: DataFrame) -> DataFrame:
    """The same rows, with RANK, DENSE_RANK, PERCENT_RANK and CUME_DIST over all rows worked out by ranges of keys.

    A window's rows are read twice, once for the number of rows of each key. So the window stays as it is if its rows need not be
    the same both times (LIMIT, sums of doubles, subqueries in expressions), and if it asks for other functions besides.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    if plan.isStreaming():
        return df
    if "CTERelationRef" in plan.toString():
        plan = spark._jvm.org.apache.spark.sql.catalyst.optimizer.InlineCTE(True, False).apply(plan)
    new = _spread(spark, plan)
    return df if new is None else _frame(spark, new)
