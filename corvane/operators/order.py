"""Places and running sums over a whole table's order, from range partitions and the totals of those before; no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written


def _dealt(rows: DataFrame, order: list[str] | list[Column], name: str) -> DataFrame:
    """rows written in their order once, with partition (_part) and place there (_at)."""
    at = F.monotonically_increasing_id()  # partition in the high bits, place there in the low 33
    r = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(r.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)), name)


def _before(totals: DataFrame, column: str) -> Column:
    return F.coalesce(F.sum(column).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, order: str | list[str] | list[Column], name: str = "placed") -> DataFrame:
    """rows with _place, from 0, in the order, which must tell rows apart if reruns are to agree."""
    r = _dealt(rows, [order] if isinstance(order, str) else order, name)
    counts = r.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition, so small at any size
    r = r.join(F.broadcast(counts.select("_part", _before(counts, "_n").alias("_before"))), "_part")
    return r.select(*rows.columns, (F.col("_at") + F.col("_before")).alias("_place"))


def running(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """rows with up_<column>: its sum over the rows before in the order, and all_<column>: its sum over all rows."""
    r = _dealt(rows, [order], "running")
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])
    every = Window.partitionBy()  # over a row for each partition
    totals = totals.select("_part", *[_before(totals, c).alias(f"_b_{c}") for c in columns], *[F.sum(c).over(every).alias(f"all_{c}") for c in columns])
    r = r.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(F.broadcast(totals), "_part")
    return r.select(*rows.columns, *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"up_{c}") for c in columns], *[f"all_{c}" for c in columns])
