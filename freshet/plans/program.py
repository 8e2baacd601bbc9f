"""Programs as text: CREATE TABLE and CREATE VIEW statements, read into an Engine, with the dialect's expressions put into Spark's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import register
from ..operators import ranking, recursion
from ..streaming.engine import Engine
from .text import closing, split, tokens, trimmed

#: SQL type names and the Spark types that stand for them (fixed values).
TYPES = {
    "INT": "int", "INTEGER": "int", "TINYINT": "int", "SMALLINT": "int", "BIGINT": "bigint", "REAL": "float", "DOUBLE": "double", "FLOAT": "double",
    "DECIMAL": "decimal", "NUMERIC": "decimal", "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "BOOLEAN": "boolean", "BOOL": "boolean",
    "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp_ntz",
}
#: Microseconds of the interval units of fixed length (fixed values).
MICROS = {"SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}


def micros(toks: list[str]) -> int:
    """INTERVAL 'n' unit in microseconds."""
    _, n, unit = [t for t in toks if t != " "]
    return int(float(n.strip("'")) * MICROS[unit.upper().removesuffix("S")])


def _us(t: str) -> str:
    return f"unix_micros(CAST({t} AS TIMESTAMP))"


def _tumble(t: str, size: int, shift: int = 0) -> str:
    return f"CAST(timestamp_micros({_us(t)} - pmod({_us(t)}, {size}L) + {shift}L) AS TIMESTAMP_NTZ)"


def _diff(unit: str, a: str, b: str) -> str:
    """Bounds of unit crossed from a to b."""
    months = {"YEAR": "year({0})", "QUARTER": "(year({0}) * 4 + quarter({0}))", "MONTH": "(year({0}) * 12 + month({0}))"}
    if unit in months:
        return f"CAST({months[unit].format(b)} - {months[unit].format(a)} AS BIGINT)"
    if unit in ("DAY", "WEEK"):
        days = 7 if unit == "WEEK" else 1  # 1970-01-05 was a Monday
        return f"CAST(floor((unix_date(CAST({b} AS DATE)) - 4) / {days}) - floor((unix_date(CAST({a} AS DATE)) - 4) / {days}) AS BIGINT)"
    return f"CAST(floor({_us(b)} / {MICROS[unit]}) - floor({_us(a)} / {MICROS[unit]}) AS BIGINT)"


def _said(token: str) -> str | None:
    """What a string literal of the dialect says (a backslash is one); None if it is none."""
    return token[1:-1].replace("''", "'") if len(token) > 1 and token[0] == token[-1] == "'" else None


def _text(literal: str) -> str | None:
    """What a string literal of Spark's says; None if it is none."""
    literal = literal.strip()
    return re.sub(r"(?s)\\(.)", r"\1", literal[1:-1]) if re.fullmatch(r"(?s)'(?:[^'\\]|\\.)*'", literal) else None


def _literal(text: str) -> str:
    """text as a string literal of Spark's."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replacement(r: str, shift: int) -> str:
    """A replacement (\\1 to \\9 groups, \\& the match, all else literal) in Spark's words, its groups shift further on."""
    text = _text(r)
    if text is None:
        raise ValueError("the replacement of REGEXP_REPLACE must be a literal")
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            c = text[i]
            out.append(f"${int(c) + shift}" if c in "123456789" else f"${shift}" if c == "&" else "\\\\" if c == "\\" else c)
        else:
            out.append("\\" + c if c in "$\\" else c)
        i += 1
    return _literal("".join(out))


def _shifted(p: str, by: int) -> str:
    """A pattern whose own back references are by groups further on."""
    text = _text(p)
    if text is None:
        return p
    return _literal(re.sub(r"\\(.)", lambda m: f"\\{int(m[1]) + by}" if m[1] in "123456789" else m[0], text))


def _regexp_replace(*a: str) -> str:
    flags = a[3].strip("'") if len(a) > 3 else ""
    inline = "".join(sorted(set(flags) & set("ims")))
    every = "g" in flags
    p = a[1] if every else _shifted(a[1], 2)
    p = f"concat('(?{inline})', {p})" if inline else p
    return f"regexp_replace({a[0]}, {p}, {_replacement(a[2], 0)})" if every else f"fx_regexp_replace({a[0]}, {p}, {_replacement(a[2], 2)})"


def similar(pattern: str, escape: str = "") -> str:
    """A SIMILAR TO pattern as a regular expression of the whole string: %, _, brackets and | * + ? ( ) { } have a meaning, all else is literal."""
    out, i, bracket = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                raise ValueError("a pattern can't end with its escape character")
            out.append(re.escape(pattern[i]))
        elif bracket:
            out.append("\\\\" if c == "\\" else c)
            bracket = c != "]"
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        elif c in "[|*+?(){}":
            out.append(c)
            bracket = c == "["
        else:
            out.append(re.escape(c))
        i += 1
    if bracket:
        raise ValueError("a bracket of the pattern is not closed")
    return f"^(?s:{''.join(out)})$"


def _rounded(name: str) -> Callable[..., str]:
    """FLOOR and CEIL keep their argument's type; doubles beyond 2**53 are whole anyway."""
    return lambda x: f"(CASE WHEN abs({x}) < 9007199254740992 THEN {name}({x}) ELSE {x} END)"


def _extract(field: str, t: str) -> str:
    field = field.strip("'").upper()
    special = {"DOW": "fx_dow({0})", "EPOCH": "fx_epoch({0})", "SECOND": "CAST(extract(SECOND FROM {0}) AS DOUBLE)"}
    return special.get(field, f"CAST(extract({field} FROM {{0}}) AS BIGINT)").format(t)


def _trim(side: str) -> Callable[..., str]:
    return lambda s, chars="' '": f"TRIM({side} {chars} FROM {s})"


#: Functions whose name, arguments or meaning differ from Spark's.
CALLS: dict[str, Callable[..., str]] = {
    "CONCAT": lambda *a: f"concat_ws('', {', '.join(a)})",
    "SUBSTRING": lambda s, a, n=None: f"substring({s}, greatest({a}, 1))" if n is None else f"fx_substring({s}, {a}, {n})",
    "SPLIT_INDEX": lambda *a: f"fx_split_index({', '.join(a)})",
    "SPLIT_PART": lambda *a: f"fx_split_part({', '.join(a)})",
    "STRPOS": lambda *a: f"fx_strpos({', '.join(a)})",
    "REGEXP_REPLACE": _regexp_replace,
    "REGEXP_LIKE": lambda s, p, flags="''": f"regexp_like({s}, " + (f"concat('(?{flags[1:-1]})', {p}))" if flags[1:-1] else f"{p})"),
    "REGEXP_SUBSTR": lambda s, p, flags="''": f"regexp_substr({s}, " + (f"concat('(?{flags[1:-1]})', {p}))" if flags[1:-1] else f"{p})"),
    "LOG": lambda *a: f"fx_log({a[0]})" if len(a) == 1 else f"(fx_ln({a[1]}) / fx_ln({a[0]}))",
    "LOG10": lambda x: f"fx_log({x})",
    "LN": lambda x: f"fx_ln({x})",
    "UPPER": lambda x: f"fx_upper({x})",
    "FLOOR": _rounded("floor"),
    "CEIL": _rounded("ceil"),
    "CEILING": _rounded("ceil"),
    "SIGN": lambda x: f"fx_sign({x})",
    "IIF": lambda *a: f"if({', '.join(a)})",
    "DATE_PART": _extract,
    "DATEADD": lambda u, n, t: f"timestampadd({u.strip(chr(39)).upper()}, {n}, {t})",
    "DATEDIFF": lambda u, a, b: _diff(u.strip("'").upper(), a, b),
    "LTRIM": _trim("LEADING"),
    "RTRIM": _trim("TRAILING"),
    "NOW": lambda *a: "CAST(timestamp_micros(:now) AS TIMESTAMP_NTZ)",
}
CALLS["SUBSTR"] = CALLS["SUBSTRING"]


def _call(name: str, inner: list[str]) -> str | None:
    """The call in Spark's words; None if Spark means the same by it."""
    parts = split(inner)
    if name in ("TUMBLE", "TUMBLE_START", "TUMBLE_END"):
        size = micros(parts[1])
        return _tumble(translate(parts[0]), size, size if name == "TUMBLE_END" else 0)
    if name == "EXTRACT":
        words = [t for t in inner if t != " "]
        return _extract(words[0], translate(inner[next(i for i, t in enumerate(inner) if t.upper() == "FROM") + 1 :]).strip())
    if name == "TRIM" and len(parts) == 2:
        return _trim("BOTH")(*map(translate, parts))
    if name == "TABLE" and inner and trimmed(inner)[0].upper() in ("HOP", "TUMBLE"):
        body = trimmed(inner)
        table, column, *sizes = split(trimmed(body[1:])[1:-1])
        source = translate(table[1:] if table[0].upper() == "TABLE" else table).strip()
        column = translate(trimmed(column[1:])[1:-1])
        length = ", ".join(f"'{n} microseconds'" for n in reversed([micros(s) for s in sizes]))
        return f"(SELECT * EXCEPT (__w), __w.start AS window_start, __w.end AS window_end FROM (SELECT *, window({column}, {length}) AS __w FROM {source}))"
    if name in CALLS and not (name in ("SUBSTRING", "SUBSTR") and any(t.upper() == "FROM" for t in inner)):
        return CALLS[name](*[translate(p) for p in parts if p])
    return None


#: Words at which a list of ORDER BY ends (fixed values).
_ORDER_ENDS = frozenset("LIMIT OFFSET FETCH ROWS RANGE GROUPS UNION INTERSECT EXCEPT".split())
#: NULLs are the largest values, unless a program says otherwise.
NULLS_HIGH = True


def _order(toks: list[str], i: int) -> tuple[str, int]:
    """The sort list from i on with the place of NULLs spelled out, and where it ends."""
    end, depth = i, 0
    while end < len(toks) and not (depth == 0 and (toks[end] in (")", ";") or toks[end].upper() in _ORDER_ENDS)):
        depth += (toks[end] == "(") - (toks[end] == ")")
        end += 1
    keys = []
    for part in split(toks[i:end]):
        words = [t.upper() for t in part if t != " "]
        down = "DESC" in words
        keys.append(translate(part) + ("" if "NULLS" in words else " NULLS FIRST" if down == NULLS_HIGH else " NULLS LAST"))
    return " " + ", ".join(keys) + " ", end


def _over(name: str, inner: list[str]) -> str:
    """A window's definition; FIRST_VALUE and LAST_VALUE see the whole partition, ROW_NUMBER breaks ties."""
    words = {t.upper() for t in inner}
    if name in ("FIRST_VALUE", "LAST_VALUE") and "ORDER" in words and not words & {"ROWS", "RANGE"}:
        return f"({translate(inner)} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    # rows that tie are numbered by all their columns, so that every run numbers them alike
    return f"({translate(inner)}, struct(*))" if name == "ROW_NUMBER" and "ORDER" in words else f"({translate(inner)})"


def _operand(out: list[str]) -> int:
    """Where the operand begins that out ends with: a name with dots, a literal, a call or a bracket (already put into Spark's words, one piece each)."""
    i = len(out)
    while i and out[i - 1] == " ":
        i -= 1
    i -= 1
    while i > 1 and out[i - 1] == ".":
        i -= 2
    return max(i, 0)


def _fetch(toks: list[str]) -> list[str]:
    """[OFFSET m ROWS] FETCH FIRST n ROWS ONLY as LIMIT n [OFFSET m]."""
    words = [(i, t.upper()) for i, t in enumerate(toks) if t != " "]
    for k, (i, t) in enumerate(words):
        if t == "FETCH" and k + 1 < len(words) and words[k + 1][1] in ("FIRST", "NEXT"):
            n = words[k + 2][1] if words[k + 2][1].isdigit() else "1"
            last = next(j for j, w in words[k:] if w == "ONLY")
            before, offset = toks[:i], []
            at = next((j for j in range(i - 1, -1, -1) if toks[j].upper() == "OFFSET"), None)
            if at is not None and not {")", "SELECT"} & {x.upper() for x in toks[at:i]}:
                offset = [" ", "OFFSET", " ", next(x for x in toks[at + 1 :] if x != " ")]
                before = toks[:at]
            return _fetch([*before, " ", "LIMIT", " ", n, *offset, *toks[last + 1 :]])
        if t == "OFFSET" and k + 2 < len(words) and words[k + 2][1] in ("ROW", "ROWS") and (k + 3 == len(words) or words[k + 3][1] != "FETCH"):
            return _fetch(toks[: words[k + 2][0]] + toks[words[k + 2][0] + 1 :])
    return toks


def translate(toks: list[str] | str, nulls: bool = True) -> str:
    """A query or expression of the dialect as Spark SQL, but for what hangs on types (see settle)."""
    toks = _fetch(tokens(toks) if isinstance(toks, str) else toks)
    out, i, called, clause = [], 0, "", ""
    while i < len(toks):
        t, word = toks[i], toks[i].upper()
        nxt = i + 1 + (i + 1 < len(toks) and toks[i + 1] == " ")
        after = toks[nxt].upper() if nxt < len(toks) else ""
        if word in ("SELECT", "FROM", "WHERE", "HAVING", "GROUP", "ON"):
            clause = word
        if t[0] == '"':
            out.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif word in ("VARCHAR", "CHAR", "TEXT") and after != "(" and next((x.upper() for x in reversed(toks[:i]) if x != " "), "") == "AS":
            out.append("STRING")
        elif word == "PRECISION" and next((x.upper() for x in reversed(toks[:i]) if x != " "), "") == "DOUBLE":
            pass
        elif word in ("CURRENT_TIMESTAMP", "CURRENT_DATE"):
            out.append(CALLS["NOW"]() if word != "CURRENT_DATE" else f"CAST({CALLS['NOW']()} AS DATE)")
        elif word == "ORDER" and after == "BY" and nulls:
            keys, i = _order(toks, nxt + 1)
            out.append("ORDER BY" + keys)
            continue
        elif word == "SIMILAR" and after == "TO":
            at = next(j for j in range(nxt + 1, len(toks)) if toks[j] != " ")
            more = [j for j in range(at + 1, len(toks)) if toks[j] != " "][:2]
            escaped = len(more) == 2 and toks[more[0]].upper() == "ESCAPE"
            if _said(toks[at]) is None:
                raise ValueError("the pattern of SIMILAR TO must be a literal")
            out.append("RLIKE " + _literal(similar(_said(toks[at]), _said(toks[more[1]]) if escaped else "")))
            i = more[1] if escaped else at
        elif t[0] == "'":
            out.append(_literal(_said(t)) if "\\" in t or "''" in t else t)
        elif word == "IN" and after == "(" and clause == "SELECT" and next((x for x in toks[nxt + 1 :] if x != " "), "").upper() in ("SELECT", "WITH"):
            # Spark says FALSE where a NULL leaves it open
            end = closing(toks, nxt)
            inner = translate(toks[nxt + 1 : end])
            negated = [x.upper() for x in out if x != " "][-1:] == ["NOT"]
            if negated:
                del out[max(k for k, x in enumerate(out) if x.upper() == "NOT") :]
            at = _operand(out)
            x = "".join(out[at:]).strip()
            yes, no = ("FALSE", "TRUE") if negated else ("TRUE", "FALSE")
            out[at:] = [f"(CASE WHEN {x} IN ({inner}) THEN {yes} WHEN NOT EXISTS ({inner}) THEN {no} WHEN {x} IS NULL OR EXISTS (SELECT 1 FROM ({inner}) AS __s(__x) WHERE __x IS NULL) THEN NULL ELSE {no} END)"]
            i = end
        elif t[0].isalpha() and after == "(":
            end = closing(toks, nxt)
            inner = toks[nxt + 1 : end]
            made = _call(word, inner)
            if word == "OVER":
                out.append(t + " " + _over(called, inner))
            else:
                out.append(made if made is not None else "".join(toks[i:nxt]) + "(" + translate(inner, word != "GROUP") + ")")
                called = word
            i = end
        elif t == "(":
            end = closing(toks, i)
            out.append("(" + translate(toks[i + 1 : end]) + ")")
            i = end
        else:
            out.append(t)
        i += 1
    return "".join(out)


def _nodes(plan):
    """All expressions of a plan and of its subqueries."""
    open_ = [plan]
    while open_:
        node = open_.pop()
        for group in (node.children(), node.innerChildren() if node.nodeName() == "WithCTE" else None, node.subqueries()):
            open_ += [group.apply(k) for k in range(group.size())] if group is not None else []
        if node.nodeName() == "WithCTE":
            open_ += [node.cteDefs().apply(k) for k in range(node.cteDefs().size())]
        exprs = node.expressions()
        inner = [exprs.apply(k) for k in range(exprs.size())]
        while inner:
            e = inner.pop()
            yield e
            kids = e.children()
            inner += [kids.apply(k) for k in range(kids.size())]


def _bare(e, written):
    """An expression without the casts that types alone have put around it; those that the query asks for bear the tag written."""
    while e.nodeName().lower() == "cast" and not e.getTagValue(written).isDefined():
        e = e.child()
    return e


_WHOLE = frozenset(("tinyint", "smallint", "int", "bigint"))


def settle(spark: SparkSession, sql: str) -> str:
    """sql with what hangs on types put right, as Spark's own analysis of it finds them: the division of whole numbers is whole, DATE_TRUNC and DATEADD keep the type of their argument."""
    if re.search(r"\b(LIMIT|OFFSET)\b", sql, re.I) and not re.search(r"\bRECURSIVE\b", sql, re.I):
        sql = ordered(spark, sql)
    if not re.search(r"/|date_trunc|timestampadd", sql, re.I):
        return sql
    kinds = {"Divide", "TruncTimestamp", "TimestampAdd"}
    while edits := _edits(spark, sql, kinds):
        kinds = {"Divide"}  # an outer division's type hangs on those inside it
        for at, gone, new in sorted(edits, key=lambda x: x[0], reverse=True):
            sql = sql[:at] + new + sql[at + gone :]
    return sql


def _edits(spark: SparkSession, sql: str, kinds: set[str]) -> set[tuple[int, int, str]]:
    """(place, characters to take out, text to put in) of what settle changes."""
    edits: set[tuple[int, int, str]] = set()
    written = spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    for e in _nodes(spark.sql(sql)._jdf.queryExecution().analyzed()):
        name = e.nodeName()
        if name not in kinds:
            continue
        at = e.origin()
        if at.startIndex().isEmpty() or at.sqlText().isEmpty() or at.sqlText().get() != sql:
            continue
        start, stop = at.startIndex().get(), at.stopIndex().get() + 1
        if name == "Divide":
            a, b = _bare(e.left(), written), _bare(e.right(), written)
            if a.dataType().sql().lower() in _WHOLE and b.dataType().sql().lower() in _WHOLE:
                from_ = e.left().origin() if e.left().origin().stopIndex().isDefined() else a.origin()
                sign = sql.rindex("/", start, stop) if from_.stopIndex().isEmpty() or from_.stopIndex().get() + 1 >= stop else sql.index("/", from_.stopIndex().get() + 1)
                edits.add((sign, 1, " DIV "))
        else:
            kind = _bare(e.timestamp(), written).dataType().sql().upper()
            units = "" if name == "TruncTimestamp" else e.unit().upper()
            if kind in ("DATE", "TIMESTAMP_NTZ") and e.dataType().sql().upper() != kind and units not in ("HOUR", "MINUTE", "SECOND"):
                edits |= {(start, 0, "CAST("), (stop, 0, f" AS {kind})")}
    return edits


def ordered(spark: SparkSession, sql: str) -> str:
    """sql with the rows that LIMIT takes told apart by all their columns, where its ORDER BY leaves ties or is missing."""
    toks, depth, at = tokens(sql), 0, {}
    for i, t in enumerate(toks):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.upper() in ("ORDER", "LIMIT", "OFFSET"):
            at[t.upper()] = i
    cut = min((at[w] for w in ("LIMIT", "OFFSET") if w in at), default=None)
    if cut is None or ("LIMIT" in at and next((t for t in toks[at["LIMIT"] + 1 :] if t != " "), "").upper() == "ALL"):
        return sql
    many = len(spark.sql("".join(toks[: at.get("ORDER", cut)])).columns)
    return "".join(toks[:cut]) + (", " if "ORDER" in at else " ORDER BY ") + ", ".join(str(k + 1) for k in range(many)) + " " + "".join(toks[cut:])


def query(spark: SparkSession, sql: str) -> DataFrame:
    """A query of the dialect over the session's views."""
    register(spark)
    return ranking.spread(recursion.run(spark, translate(sql), settle))


def _columns(parts: list[list[str]], path: str = "") -> list[tuple[str, str, list[str]]]:
    """(dotted name, Spark type, attributes) of each column; ROW columns give one for each field."""
    out = []
    for p in parts:
        words = [t for t in p if t != " "]
        name, kind, rest = path + words[0].strip('"'), words[1].upper(), words[2:]
        if kind == "ROW":
            end = closing(rest, 0)
            out += _columns(split(rest[1:end]), f"{name}.")
            continue
        made = TYPES.get(kind)
        if made is None:
            raise ValueError(f"unknown type {words[1]}")
        if rest and rest[0] == "(":
            end = closing(rest, 0)
            made, rest = (made + "".join(rest[: end + 1]) if made == "decimal" else made), rest[end + 1 :]
        elif made == "decimal":
            made = "decimal(38,0)"
        out.append((name, made, [w.upper() for w in rest]))
    return out


def load(engine: Engine, text: str, keys: dict[str, dict[str, list[str]]] | None = None) -> list[str]:
    """Reads CREATE TABLE and CREATE VIEW statements into the engine, in order; the views' names.

    A column may say NOT NULL, PRIMARY KEY (not enforced) and LATENESS n; a table WITH ('append_only' = 'true').
    """
    register(engine.spark)
    engine.settle = settle
    views = []
    for toks in split(tokens(text), ";"):
        words = [t.upper() for t in toks if t != " "]
        if not words:
            continue
        name = [t for t in toks if t != " "][2].strip('"')
        if words[:2] == ["CREATE", "TABLE"]:
            first = toks.index("(")
            end = closing(toks, first)
            columns = _columns(split(toks[first + 1 : end]))
            late = [(c, int(rest[rest.index("LATENESS") + 1])) for c, _, rest in columns if "LATENESS" in rest]
            if len(late) > 1:
                raise ValueError("one column of a table can have lateness")
            options = [t for t in toks[end + 1 :] if t != " "]
            given = dict(zip(options[2::4], options[4::4]))
            if set(given) - {"'append_only'"}:
                raise ValueError(f"unknown properties: {sorted(given)}")
            schema = ", ".join(f"`{c}` {kind}" for c, kind, _ in columns)
            engine.table(name, schema, late[0] if late else None, given.get("'append_only'") == "'true'")
        elif words[:2] == ["CREATE", "VIEW"]:
            engine.view(name, translate(toks[next(i for i, t in enumerate(toks) if t.upper() == "AS") + 1 :]).strip(), (keys or {}).get(name))
            views.append(name)
        else:
            raise ValueError(f"not a table or view: {' '.join(words[:3])}")
    return views
