"""Row order within keys without putting a whole key into one task.

`Ordered` answers three questions about rows sorted inside a key: which number a
row has, what the row before it holds, and what a running sum is.

While no key is large these are ordinary window functions.  When one key may
hold a large share of all rows, the rows are range-partitioned by (key, order)
first.  A key then lies in consecutive slices of about equal size; the window
works inside (slice, key), and what crosses a slice border is carried over from
a table with one row per (slice, key).  Keys inside a single slice need no
carry, and there are at most as many slices borders as slices, so the carry
table is bounded by the number of partitions whatever the data size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import durable, slices_for_hot_groups

SLICE = "__slice"
# A number per row once rows are sliced, so that rows of equal place stay apart.
ROW = "__row"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which a null key meets a null key, as it does in grouping and windows."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    slice: str | None = None
    # True when the slices came from range partitioning, i.e. when the number of
    # borders is known to be small.
    bounded: bool = False

    @staticmethod
    def over(df: DataFrame, keys: list[str], order: list[str]) -> "Ordered":
        parts = slices_for_hot_groups(df, keys)
        if not parts:
            return Ordered(df, tuple(keys), tuple(order))
        ranged = df.repartitionByRange(parts, *keys, *order)
        sliced = durable(ranged.withColumns({SLICE: F.spark_partition_id(), ROW: F.monotonically_increasing_id()}))
        return Ordered(sliced, tuple(keys), (*order, ROW), SLICE, True)

    def with_df(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df)

    def result(self) -> DataFrame:
        return self.df.drop(SLICE, ROW) if self.slice == SLICE else self.df

    @property
    def _window(self):
        parts = list(self.keys) + ([self.slice] if self.slice else [])
        return Window.partitionBy(*parts).orderBy(*self.order)

    def _carry(self, per_slice: DataFrame, expr: Column, name: str) -> DataFrame:
        """`expr` over the slices of a key, kept only where a slice before exists."""
        across = Window.partitionBy(*self.keys).orderBy(self.slice)
        out = (
            per_slice.withColumn(name, expr.over(across))
            .withColumn("__n", F.row_number().over(across))
            .filter(F.col("__n") > 1)
            .select(*self.keys, self.slice, name)
        )
        return F.broadcast(out) if self.bounded else out

    def running_sum(self, value: Column, name: str) -> "Ordered":
        local = self.df.withColumn("__v", value.cast("long"))
        upto = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = local.withColumn(name, F.sum("__v").over(upto)).drop("__v")
        if self.slice:
            totals = local.groupBy(*self.keys, self.slice).agg(F.sum("__v").alias("__t"))
            before = Window.partitionBy(*self.keys).orderBy(self.slice).rowsBetween(
                Window.unboundedPreceding, -1
            )
            totals = totals.withColumn("__carry", F.sum("__t").over(before)).filter(
                F.col("__carry").isNotNull() & (F.col("__carry") != 0)
            ).select(*self.keys, self.slice, "__carry")
            if self.bounded:
                totals = F.broadcast(totals)
            out = (
                join_null_safe(out, totals, [*self.keys, self.slice], "left")
                .withColumn(name, F.col(name) + F.coalesce("__carry", F.lit(0)))
                .drop("__carry")
            )
        return self.with_df(out)

    def row_number(self, name: str) -> "Ordered":
        if not self.slice:
            return self.with_df(self.df.withColumn(name, F.row_number().over(self._window).cast("long")))
        return self.running_sum(F.lit(1), name)

    def previous(self, columns: dict[str, str]) -> "Ordered":
        """Add, for each new: old, the value `old` has in the row before."""
        out = self.df
        for new, old in columns.items():
            out = out.withColumn(new, F.lag(old).over(self._window))
        if self.slice:
            last = self.df.groupBy(*self.keys, self.slice).agg(
                F.max_by(F.struct(*columns.values()), F.struct(*self.order)).alias("__last")
            )
            carry = self._carry(last, F.lag("__last"), "__before")
            out = join_null_safe(
                out.withColumn("__first", F.row_number().over(self._window) == 1),
                carry, [*self.keys, self.slice], "left",
            )
            for new, old in columns.items():
                edge = F.col("__first") & F.col("__before").isNotNull()
                out = out.withColumn(
                    new, F.when(edge, F.col(f"__before.{old}")).otherwise(F.col(new))
                )
            out = out.drop("__before", "__first")
        return self.with_df(out)
