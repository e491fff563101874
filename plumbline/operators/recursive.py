"""Recursive queries that Spark's WITH RECURSIVE doesn't cover: UNION (distinct), SEARCH and CYCLE."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import shared_dir


class _Turns:
    """The rows of each turn as a directory of one table: the next turn's plan reads two paths, however many turns there were, and a lost executor costs one turn at most."""

    def __init__(self, spark: SparkSession, schema: T.StructType) -> None:
        self.spark, self.schema, self.root, self.turn = spark, schema, f"{shared_dir(spark)}/recursive-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Writes a turn; its rows and their number, counted while they are written."""
        seen = Observation()
        path = f"{self.root}/_turn={self.turn}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.turn += 1
        return self.spark.read.schema(self.schema).parquet(path), seen.get["n"]

    def every(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/_turn={i}" for i in range(self.turn)])


_NAMED = re.compile(r"(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)(\w+)\s*(?:\([^()]*\)\s*)?AS\s+(?:(?:NOT\s+)?MATERIALIZED\s+)?\(", re.I)


class MutualRecursion(ValueError):
    pass


def check_mutual(text: str) -> None:
    """Raises MutualRecursion if common table expressions of a WITH RECURSIVE refer to each other in a circle; one that refers to itself is fine."""
    bodies: dict[str, str] = {}
    for m in _NAMED.finditer(text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += (text[at] == "(") - (text[at] == ")")
            at += 1
        bodies[m[1].lower()] = re.sub(r"'(?:[^']|'')*'", "''", text[m.end() : at])
    refers = {n: {o for o in bodies if o != n and re.search(rf"\b{re.escape(o)}\b", b, re.I)} for n, b in bodies.items()}

    def reach(name: str, seen: tuple[str, ...]) -> None:
        for other in refers[name]:
            if other == seen[0]:
                raise MutualRecursion(" -> ".join((*seen, other)))
            if other not in seen:
                reach(other, (*seen, other))

    for name in bodies:
        reach(name, (name,))


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """WITH RECURSIVE r AS (base UNION step(r)): semi-naive, each turn joins only the rows that the last one found; ends when none are new."""
    first = base.distinct()
    turns = _Turns(base.sparkSession, first.schema)
    new, n = turns.add(first)
    for _ in range(most):
        if not n:
            return turns.every()
        every = turns.every().alias("every")
        grown = step(new).toDF(*base.columns).distinct().alias("grown")
        known = reduce(and_, (F.col(f"grown.{c}").eqNullSafe(F.col(f"every.{c}")) for c in base.columns))  # UNION takes nulls as equal
        new, n = turns.add(grown.join(every, known, "left_anti"))
    raise RecursionError(f"no fixpoint after {most} turns")


def search_cycle(base: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, cycle: str = "is_cycle", depth: str = "depth", path: str = "path", most: int = 100) -> DataFrame:
    """WITH RECURSIVE ... UNION ALL with SEARCH and CYCLE: every row carries the keys on its path; a row whose key is on it already is marked and goes no further.

    `step` takes the rows of the last turn and returns rows with base's columns and the parent's `path`. Order by `path` for
    depth first, by `depth` for breadth first.
    """
    first = base.withColumn(path, F.array(F.col(key))).withColumn(depth, F.lit(0)).withColumn(cycle, F.lit(False))
    turns = _Turns(base.sparkSession, first.schema)
    new, n = turns.add(first)
    for turn in range(1, most):
        if not n:
            return turns.every()
        grown = step(new.filter(~F.col(cycle)))
        grown = grown.withColumn(cycle, F.array_contains(path, F.col(key))).withColumn(path, F.array_append(path, F.col(key))).withColumn(depth, F.lit(turn))
        new, n = turns.add(grown.select(*first.columns))
    raise RecursionError(f"rows after {most} turns")


def connect_by(edges: DataFrame, parent: str, child: str, start: DataFrame) -> DataFrame:
    """tablefunc's connectby: (key, parent, depth, path, is_cycle) below the start keys (one column)."""
    (key,) = start.columns
    base = start.select(F.col(key).alias("node"), F.lit(None).cast(edges.schema[parent].dataType).alias("up"))

    def step(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("node").alias("_from"), "path").join(edges.select(F.col(parent).alias("_from"), F.col(child).alias("node")), "_from").select("node", F.col("_from").alias("up"), "path")

    return search_cycle(base, step, "node")
