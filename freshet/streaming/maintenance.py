"""How a view's change is found: from the changes alone where the view is linear in each table, from touched keys where the view says so."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import zset

#: Nodes through which a sum of bags goes term by term (a join in each of its sides).
TERMWISE = {"Project", "Filter", "SubqueryAlias", "View", "Generate", "Join", "ResolvedHint"}


def tables_of(df: DataFrame, tables: set[str]) -> Counter | None:
    """How often df's analysed plan reads each table if it is linear in each of them, else None."""
    found, open_ = Counter(), [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        kind = node.nodeName().split()[0]
        if kind not in TERMWISE or not node.deterministic() or node.subqueries().size():
            return None
        if kind == "Join" and node.joinType().toString() not in ("Inner", "Cross"):
            return None
        if kind == "View" and node.desc().identifier().table() in tables:
            found[node.desc().identifier().table()] += 1
            continue
        children = node.children()
        if not children.size():
            return None  # rows of the view's own
        open_ += [children.apply(i) for i in range(children.size())]
    return found if found and max(found.values()) == 1 else None


def linear_delta(used: list[str], old: Callable, change: Callable, new: Callable, view: Callable) -> DataFrame:
    """The change of a view that is linear in each of its tables: one table's change at a time, those before it new, those after it old.

    old, change and new give a table's Z-set; view gives the view's rows over bags of the tables. Insertions and deletions
    go through the view apart, as bags, so that the view needs no weight column.
    """
    out = None
    for i, name in enumerate(used):
        others = {n: zset.expand(new(n) if j < i else old(n)) for j, n in enumerate(used) if j != i}
        for sign in (1, -1):
            part = change(name).where(F.col(zset.W) * sign > 0).withColumn(zset.W, F.col(zset.W) * sign)
            rows = zset.weighted(view(others | {name: zset.expand(part)}), sign)
            out = rows if out is None else zset.plus(out, rows)
    return zset.normalise(out)


def keyed_delta(keys: dict[str, list[str]], old: Callable, change: Callable, new: Callable, view: Callable) -> DataFrame:
    """The change of a view that falls apart by key: the view over the touched keys' rows now, less the same before."""
    named = {n: [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(cols)] for n, cols in keys.items()}
    touched = None
    for name, cols in named.items():
        some = change(name).select(*cols)
        touched = some if touched is None else touched.union(some)
    touched = touched.distinct()

    def part(state: Callable) -> dict[str, DataFrame]:
        def reach(name: str) -> DataFrame:
            z = state(name)
            on = [z[f"`{c}`"].eqNullSafe(touched[f"__k{i}"]) for i, c in enumerate(keys[name])]
            return zset.expand(z.join(touched, on, "left_semi"))

        return {name: reach(name) for name in keys}

    return zset.minus(zset.weighted(view(part(new))), zset.weighted(view(part(old))))


#: A key: columns (table, column) that are equal in all rows that go into one part of the view.
Key = frozenset


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _origin(e, known: dict) -> Key:
    """The tables' columns whose value a plain attribute (or an alias of one) has."""
    while e.nodeName() == "Alias":
        e = e.child()
    return known.get(e.exprId().id(), Key()) if e.nodeName() == "AttributeReference" else Key()


def _narrowed(before: list[Key] | None, here: list[Key]) -> list[Key]:
    """The keys by which an operator falls apart that does so by here, over rows that do so by before (None: by anything)."""
    here = [k for k in here if k]
    return here if before is None else [a | b for a in before for b in here if a & b]


def _equalities(condition, known: dict) -> list[tuple]:
    """Pairs of attributes that a condition's conjuncts set equal."""
    out, open_ = [], [condition]
    while open_:
        e = open_.pop()
        kids = _seq(e.children())
        if e.nodeName() == "And":
            open_ += kids
        elif e.nodeName() == "EqualTo" and all(k.nodeName() == "AttributeReference" for k in kids):
            out.append(tuple(k.exprId().id() for k in kids))
    return out


def _parts(node, tables: set[str]) -> tuple[dict, list[Key] | None] | None:
    """(origin of each attribute, keys by which the rows fall apart: None if they do by anything); None if nothing is known of the node."""
    kind = node.nodeName().split()[0]
    if not node.deterministic() or node.subqueries().size():
        return None
    if kind == "View" and node.desc().identifier().table() in tables:
        name = node.desc().identifier().table()
        return {a.exprId().id(): Key([(name, a.name())]) for a in _seq(node.output())}, None
    below = [_parts(c, tables) for c in _seq(node.children())]
    if not below or None in below:
        return None
    known, keys = below[0]
    if kind in ("SubqueryAlias", "View", "Filter", "Generate", "ResolvedHint"):
        return known, keys
    if kind in ("Project", "Aggregate"):
        made = _seq(node.projectList() if kind == "Project" else node.aggregateExpressions())
        if kind == "Aggregate":
            keys = _narrowed(keys, [_origin(e, known) for e in _seq(node.groupingExpressions())])
        return {e.exprId().id(): _origin(e, known) for e in made}, keys
    if kind == "Distinct":
        return known, _narrowed(keys, list(known.values()))
    if kind == "Window":
        return known, _narrowed(keys, [_origin(e, known) for e in _seq(node.partitionSpec())])
    if kind == "Join":
        inner = node.joinType().toString() in ("Inner", "Cross")
        right, keys_right = below[1]
        both, pairs = known | right, _equalities(node.condition().get(), known | right) if node.condition().isDefined() else []
        if not inner:
            how = node.joinType().toString()
            here = [both.get(a, Key()) | both.get(b, Key()) for a, b in pairs if (a in known) != (b in known) and both.get(a) and both.get(b)]
            keys, keys_right = _narrowed(keys, here), None if keys_right is None else _narrowed(keys_right, here)
            # a side that may be NULL has no origin any more: its NULLs come from all parts
            gone = (known if how in ("RightOuter", "FullOuter") else {}) | (right if how in ("LeftOuter", "FullOuter") else {})
            both |= dict.fromkeys(gone, Key())
        elif pairs:
            for a, b in pairs:
                both[a] = both[b] = both.get(a, Key()) | both.get(b, Key())
            grown = {c: both[a] for a, _ in pairs for c in both[a]}
            keys, keys_right = ([k.union(*[grown[c] for c in k if c in grown]) for k in ks] if ks is not None else None for ks in (keys, keys_right))
        keys = keys if keys_right is None else keys_right if keys is None else _narrowed(keys, keys_right)
        return both, keys
    return None


def keys_of(df: DataFrame, tables: set[str]) -> dict[str, list[str]] | None:
    """The columns by which df's analysed plan falls apart, for the tables that have one: grouping columns, partitions of windows, columns of DISTINCT, equal columns of outer and semi joins, followed to the tables."""
    read: Counter = Counter()
    open_ = [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        if node.nodeName().split()[0] == "View" and node.desc().identifier().table() in tables:
            read[node.desc().identifier().table()] += 1
        else:
            open_ += _seq(node.children())
    got = _parts(df._jdf.queryExecution().analyzed(), tables) if read and max(read.values()) == 1 else None
    keys = [k for k in (got[1] or [] if got else []) if len({t for t, _ in k})]
    if not keys:
        return None
    covered = max(({t for t, _ in k} for k in keys), key=lambda ts: (len(ts), sorted(ts)))
    chosen = list(dict.fromkeys(k for k in keys if covered <= {t for t, _ in k}))
    return {t: [min(c for u, c in k if u == t) for k in chosen] for t in sorted(covered)}
