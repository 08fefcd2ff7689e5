"""Tables stored by a hash of their key, so that later jobs group and join them where they lie."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class BucketedTable:
    """Parquet in ``buckets`` buckets of ``key``, one sorted file each.

    Tables with the same key and number of buckets join, and each of them groups by the key, without an
    exchange above its scan. The layout is kept beside the files, so any session can open it. A key whose
    rows no task can sort does not belong here: all rows of a key lie in one bucket.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: str = "url", sort: Sequence[str] = (), buckets: int = BUCKETS) -> BucketedTable:
        """Store ``rows`` under a new path."""
        spark, table = rows.sparkSession, cls(rows.sparkSession, path)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        order = [key, *sort]
        name = table._name()
        # dealt by the same hash as the buckets: every task writes one file
        dealt = rows.repartition(buckets, key).sortWithinPartitions(*order)
        dealt.write.format("parquet").option("path", f"{table.path}/rows").bucketBy(buckets, key).sortBy(*order).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
        layout = spark.createDataFrame([(ddl, key, list(order), buckets)], "ddl string, key string, sort array<string>, buckets int")
        layout.coalesce(1).write.json(f"{table.path}/layout")
        return table

    @staticmethod
    def _name() -> str:
        return f"bucketed_{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        """The rows, with their buckets known to the planner; the table name belongs to this session."""
        about = self.spark.read.schema("ddl string, key string, sort array<string>, buckets int").json(f"{self.path}/layout").first()
        name = self._name()
        order = ", ".join(f"`{c}`" for c in about["sort"])
        self.spark.sql(
            f"CREATE TABLE {name} ({about['ddl']}) USING parquet CLUSTERED BY (`{about['key']}`) SORTED BY ({order}) "
            f"INTO {about['buckets']} BUCKETS LOCATION '{self.path}/rows'"
        )
        return self.spark.table(name)
