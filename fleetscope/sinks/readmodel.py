"""Read models kept up to date from batches (DOC-5) with mergeable measures (AG-2).

A batch adds one row of partial measures per key to a folder of its own (its id), so a batch that runs again
replaces itself.  Reading merges the partial rows.  ``fold`` merges old batches into one base table; batches up to the base's
number are skipped if they come again.  Nothing ever reads the written events a second time.

Distinct counts are kept as HyperLogLog sketches, which merge like sums; their relative standard error is
``1.04 / sqrt(2 ** bits)`` (1.6 % for 12 bits).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import _folders


@dataclass(frozen=True)
class Measure:
    """``kind``: count, sum, min, max or distinct (of ``column``)."""

    name: str
    kind: str
    column: str | None = None
    bits: int = 12

    def partial(self) -> Column:
        c = F.col(self.column) if self.column else F.lit(1)
        how = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "distinct": lambda x: F.hll_sketch_agg(x, self.bits)}
        return how[self.kind](c).alias(self.name)

    def merged(self) -> Column:
        how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": F.hll_union_agg}
        return how[self.kind](self.name).alias(self.name)

    def result(self) -> Column:
        return F.hll_sketch_estimate(self.name).alias(self.name) if self.kind == "distinct" else F.col(self.name)


@dataclass(frozen=True)
class ReadModel:
    """DOC-5: measures per key, fed by batches numbered upward by one writer (a stream's ``foreachBatch``)."""

    keys: Sequence[str]
    measures: Sequence[Measure]

    def partials(self, events: DataFrame) -> DataFrame:
        return events.groupBy(*self.keys).agg(*[m.partial() for m in self.measures])

    def merge(self, partials: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """Partial rows merged, to the model's own keys or fewer of them (a roll-up without a rescan)."""
        return partials.groupBy(*(self.keys if keys is None else keys)).agg(*[m.merged() for m in self.measures])

    def results(self, merged: DataFrame) -> DataFrame:
        kept = [c for c in merged.columns if c not in {m.name for m in self.measures}]
        return merged.select(*kept, *[m.result() for m in self.measures])

    @staticmethod
    def _numbers(spark: SparkSession, pattern: str) -> dict[int, str]:
        """Complete folders by number."""
        out = {}
        for fs, folder in _folders(spark, pattern):
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
            if fs.exists(done):
                out[int(folder.getName().split("-")[1])] = folder.toString()
        return out

    def update(self, events: DataFrame, path: str, batch_id: int) -> None:
        """Add a batch; a batch already folded into the base is skipped, one that is there is replaced."""
        base = self._numbers(events.sparkSession, f"{path}/base-*")
        if base and batch_id <= max(base):
            return
        self.partials(events).write.mode("overwrite").parquet(f"{path}/batch-{int(batch_id)}")

    def stored(self, spark: SparkSession, path: str) -> DataFrame | None:
        """All partial rows: the newest base and the batches after it."""
        base, batches = self._numbers(spark, f"{path}/base-*"), self._numbers(spark, f"{path}/batch-*")
        newest = max(base, default=-1)
        parts = ([base[newest]] if base else []) + [p for i, p in sorted(batches.items()) if i > newest]
        return spark.read.parquet(*parts) if parts else None

    def fold(self, spark: SparkSession, path: str) -> None:
        """Merge everything stored into a new base numbered by the newest batch; then the folders it replaces go."""
        base, batches = self._numbers(spark, f"{path}/base-*"), self._numbers(spark, f"{path}/batch-*")
        upto = max([*base, *batches], default=None)
        if upto is None or upto in base:
            return
        self.merge(self.stored(spark, path)).write.mode("overwrite").parquet(f"{path}/base-{upto}")
        for fs, folder in [*_folders(spark, f"{path}/base-*"), *_folders(spark, f"{path}/batch-*")]:
            kind, number = folder.getName().split("-")
            if int(number) < upto or kind == "batch" and int(number) == upto:
                fs.delete(folder, True)

    def read(self, spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame | None:
        """The model as it stands, rolled up to ``keys`` if given."""
        parts = self.stored(spark, path)
        return None if parts is None else self.results(self.merge(parts, keys))
