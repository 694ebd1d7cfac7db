"""Tables that streams keep up to date: rows lie in slots, and a batch replaces the slots it touches.

    table/columns                        the columns, without rows
    table/generation=N/slot=S/part-...   all rows of slot S as of batch N

A batch writes the whole rows of its slots as a generation of its own, which counts once it is complete. Readers take the newest complete
generation of each slot. What is replaced stays for one more batch, for readers that are under way, and is then removed, so the table
has the size of its rows however many batches have run. A batch that is tried again finds its generation complete, or writes it anew
from the same older ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UpsertTable:
    """Rows with the columns of `schema`, one for each value of `keys`; `slot` (a whole number) must follow from the keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], slot: Column, schema: T.StructType | None = None):
        self.spark, self.path, self.keys, self.slot = spark, path.rstrip("/"), keys, slot
        if schema is not None and not self._names(f"{self.path}/columns"):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/columns")
        self.schema = spark.read.parquet(f"{self.path}/columns").schema

    def _folder(self, path: str):
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, system = self._folder(path)
        return [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []

    def _remove(self, path: str) -> None:
        folder, system = self._folder(path)
        system.delete(folder, True)

    def generations(self) -> dict[int, list[int]]:
        """The slots of each complete generation."""
        found = {}
        for name in self._names(self.path):
            if name.startswith("generation="):
                inside = self._names(f"{self.path}/{name}")
                if "_SUCCESS" in inside:
                    found[int(name.removeprefix("generation="))] = [int(n.removeprefix("slot=")) for n in inside if n.startswith("slot=")]
        return found

    def _rows(self, newest: dict[int, int]) -> DataFrame:
        if not newest:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/generation={g}/slot={s}" for s, g in sorted(newest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The rows as of the last complete batch."""
        return self._rows(_newest(self.generations()))

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Puts in the rows of a batch, which replace those of the same keys; or what `merge(held, batch)` makes of the touched slots."""
        older = self.generations()
        if batch_id not in older:
            batch = batch.select(*self.schema.names).persist()
            try:
                touched = [r.slot for r in batch.select(self.slot.alias("slot")).distinct().collect()]  # slots, not rows
                if not touched:
                    return
                newest = _newest({g: s for g, s in older.items() if g < batch_id})
                held = self._rows({s: newest[s] for s in touched if s in newest})
                rows = merge(held, batch) if merge else held.join(batch, self.keys, "left_anti").select(*self.schema.names).unionByName(batch)
                # A slot with very many rows is cut into several files.
                whole = rows.withColumn("slot", self.slot).hint("rebalance", F.col("slot"))
                whole.write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/generation={batch_id}")
            finally:
                batch.unpersist()
        self._forget(older, batch_id)

    def _forget(self, older: dict[int, list[int]], batch_id: int) -> None:
        """Removes the slots that were replaced before this batch."""
        before = {g: s for g, s in older.items() if g < batch_id}
        newest = _newest(before)
        for g, slots in before.items():
            stale = [s for s in slots if newest[s] != g]
            if len(stale) == len(slots) and g != max(before):
                self._remove(f"{self.path}/generation={g}")
            else:
                for s in stale:
                    self._remove(f"{self.path}/generation={g}/slot={s}")


def _newest(generations: dict[int, list[int]]) -> dict[int, int]:
    newest: dict[int, int] = {}
    for g, slots in sorted(generations.items()):
        newest.update(dict.fromkeys(slots, g))
    return newest


def by_hash(keys: list[str], slots: int = 64) -> Column:
    """Slots for keys without a time."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def keep_table(rows: DataFrame, table: UpsertTable, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, mode: str = "update") -> None:
    """Processes what is available of a stream of rows and keeps the table up to date."""
    query = (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id, merge))
        .start()
    )
    query.awaitTermination()
