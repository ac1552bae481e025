"""Pages of a large ordered table: the order is made once, and a page reads only the part that it lies in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_PART = 1 << 20
_PART, _AT = "page_part", "page_at"


class OrderedTable:
    """Rows in ranges of a stated order, one folder each, with the number of rows before each range.

    Any page is then a filter on the folder and on the place inside it: no page sorts, and only its own rows move, however
    far down it is. The offsets, a row per range, are the one thing that grows with the table in the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, order: Sequence[str], rows_per_part: int = ROWS_PER_PART) -> OrderedTable:
        """Put the rows in order, nulls first. Rows equal in ``order`` keep one order among themselves from then on."""
        keys = [F.asc_nulls_first(c) for c in order]
        parts = max(1, -(-rows.count() // rows_per_part))
        placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(
            "*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(_AT))
        placed.limit(0).write.parquet(f"{self.path}/fields")
        placed.write.partitionBy(_PART).parquet(f"{self.path}/rows")
        self._rows().groupBy(_PART).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.path}/parts")
        return self

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/fields").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def page(self, number: int = 0, size: int = 20) -> DataFrame:
        """Page ``number`` (from 0) in order; empty beyond the end."""
        first, last, start, wanted = number * size, (number + 1) * size, 0, []
        for row in self.spark.read.parquet(f"{self.path}/parts").orderBy(_PART).collect():
            low, high = max(first - start, 0), min(last - start, row["n"])
            if low < high:
                wanted.append((F.col(_PART) == row[_PART]) & F.col(_AT).between(low, high - 1))
            start += row["n"]
        condition = F.lit(False)
        for one in wanted:
            condition |= one
        return self._rows().where(condition).orderBy(_PART, _AT).drop(_PART, _AT)
