"""Writes through simple views: columns mapped to the base table, the view's filter kept or checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import dml


class CheckOption(ValueError):
    """A row that the view wouldn't show."""


@dataclass(frozen=True)
class View:
    """columns: view column -> base column; where: its filter over base columns; check: WITH CHECK OPTION."""

    columns: dict[str, str]
    where: str | None = None
    check: bool = False

    def read(self, base: DataFrame) -> DataFrame:
        rows = base.filter(self.where) if self.where else base
        return rows.select(*[F.col(b).alias(v) for v, b in self.columns.items()])

    def _checked(self, rows: DataFrame) -> DataFrame:
        if self.check and self.where and rows.filter(~F.coalesce(F.expr(self.where), F.lit(False))).limit(1).count():
            raise CheckOption(self.where)
        return rows

    def insert(self, base: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> dml.Write:
        named = rows.select(*[F.col(v).alias(b) for v, b in self.columns.items() if v in rows.columns])
        write = dml.insert(base, named, defaults)
        self._checked(write.returning)
        return write

    def update(self, base: DataFrame, assign: dict[str, Column], where: Column | None = None) -> dml.Write:
        """`assign` and `where` over base columns' names; only rows that the view shows change."""
        seen = F.expr(self.where) if self.where else F.lit(True)
        write = dml.update(base, {self.columns[v]: e for v, e in assign.items()}, seen & where if where is not None else seen)
        self._checked(write.returning)
        return write

    def delete(self, base: DataFrame, where: Column | None = None) -> dml.Write:
        seen = F.expr(self.where) if self.where else F.lit(True)
        return dml.delete(base, seen & where if where is not None else seen)
