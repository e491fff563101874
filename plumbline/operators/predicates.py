"""Predicates: symmetric ranges, SIMILAR TO, row comparison, quantified comparison over arrays and subqueries."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def enum_rank(x: Column, labels: Sequence[str]) -> Column:
    """The place of an enum's value in the order of its declaration, from 1: what ORDER BY, < and MIN go by. Null for null and for no label."""
    place = F.array_position(F.array(*map(F.lit, labels)), x)
    return F.when(place > 0, place)


def enum_range(labels: Sequence[str], first: str | None = None, last: str | None = None) -> Column:
    """enum_range(first, last): the labels between the two in their order; all without bounds."""
    a = labels.index(first) if first is not None else 0
    b = labels.index(last) + 1 if last is not None else len(labels)
    return F.array(*map(F.lit, labels[a:b])) if labels[a:b] else F.array().cast("array<string>")


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    """x between the smaller and the larger of a and b; null if any of the three is."""
    either = x.between(a, b) | x.between(b, a)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(either)


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """A regular expression for the whole string from a SIMILAR TO pattern: % and _ as in LIKE; | * + ? {m,n} ( ) [ ] as in expressions; all else literal."""
    out, i, in_set = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif in_set:
            out.append("\\" + c if c in "\\&" else c)
            in_set = c != "]"
        elif c == "[":
            in_set = True
            out.append(c)
        elif c == "(":
            out.append("(?:")
        else:
            out.append({"%": ".*", "_": "."}.get(c, c if c in "|*+?{},)0123456789" or c.isalnum() or c.isspace() else "\\" + c))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(x: Column, pattern: str, escape: str = "\\") -> Column:
    return x.rlike(similar_pattern(pattern, escape))


def row_compare(left: Sequence[Column], op: str, right: Sequence[Column]) -> Column:
    """(a, b, ...) op (x, y, ...) by SQL's rules: = and <> over all fields; the others by the first field that differs, null where a null comes before that decides."""
    if len(left) != len(right) or not left:
        raise ValueError("rows of one length are compared")
    pairs = list(zip(left, right, strict=True))
    if op in ("=", "<>"):
        same = reduce(operator.and_, (a == b for a, b in pairs))
        return same if op == "=" else ~same
    strict, last = _COMPARE[op[0]], _COMPARE[op]
    a, b = pairs[-1]
    out = last(a, b)
    for a, b in reversed(pairs[:-1]):
        out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(strict(a, b), True).when(a == b, out).otherwise(False)
    return out


def any_of(x: Column, op: str, array: Column) -> Column:
    """x op ANY (array): true if it holds for an element, null if it holds for none but some comparison is null."""
    return F.exists(array, lambda e: _COMPARE[op](x, e))


def all_of(x: Column, op: str, array: Column) -> Column:
    """x op ALL (array)."""
    return F.forall(array, lambda e: _COMPARE[op](x, e))


def compare_subquery(df: DataFrame, x: Column, op: str, quantifier: str, sub: DataFrame, name: str = "matches") -> DataFrame:
    """df with `name`: x op ANY/ALL (sub), sub of one column. One aggregate of sub (least, greatest, counts) decides every row; it is one row and is broadcast.

    = ANY and <> ALL are semi and anti joins by nature: use `left_semi` or NOT IN; here they take sub's distinct values.
    """
    quantifier = quantifier.upper()
    (column,) = sub.columns
    v = F.col(column)
    stats = sub.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(v).alias("_v"))
    if op in ("=", "<>"):
        known = sub.filter(v.isNotNull()).select(v.alias("_value")).distinct().withColumn("_hit", F.lit(True))
        joined = df.join(known, x == F.col("_value"), "left").crossJoin(F.broadcast(stats))
        hit = F.col("_hit").isNotNull()
        lone = (F.col("_lo") == F.col("_hi")) & (x == F.col("_lo"))
        if op == "=" and quantifier == "ANY":
            told, nulls = hit, ~hit
        elif op == "<>" and quantifier == "ALL":
            told, nulls = ~hit, ~hit
        elif op == "=":
            told, nulls = lone, lone
        else:
            told, nulls = ~lone, lone
        empty = F.lit(quantifier == "ALL")
        out = F.when(F.col("_n") == 0, empty).when(x.isNull(), F.lit(None).cast("boolean")).when(F.col("_v") == 0, F.lit(None).cast("boolean"))
        out = out.when((F.col("_v") < F.col("_n")) & nulls, F.lit(None).cast("boolean")).otherwise(told)
        return joined.withColumn(name, out).drop("_lo", "_hi", "_n", "_v", "_value", "_hit")
    bound = {("<", "ANY"): "_hi", ("<=", "ANY"): "_hi", (">", "ANY"): "_lo", (">=", "ANY"): "_lo"}.get((op, quantifier)) or ("_lo" if op[0] == "<" else "_hi")
    told = _COMPARE[op](x, F.col(bound))
    open_end = told if quantifier == "ANY" else ~told  # decided in spite of nulls
    out = F.when(F.col("_n") == 0, F.lit(quantifier == "ALL")).when((F.col("_v") < F.col("_n")) & ~F.coalesce(open_end, F.lit(False)), F.lit(None).cast("boolean")).otherwise(told)
    return df.crossJoin(F.broadcast(stats)).withColumn(name, out).drop("_lo", "_hi", "_n", "_v")
