"""A keyed state table in parts, of which an update rewrites only those it touches.

A row's part is the hash of its key. Every version has a manifest of one row per part: the
version that last wrote the part, its number of rows and its largest id. An update reads the
touched parts, writes them under its own version and takes over all other manifest rows; older
versions stay readable. An update that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from marketlens.sources import tables

_MANIFEST = "part int, written long, rows long, top long"


@dataclass(frozen=True)
class PartedTable:
    """Where the table is, what its rows look like, and how its keys are split."""

    folder: str
    schema: StructType
    keys: Sequence[str]
    parts: int = 64
    id_col: str = "id"

    def part_of(self) -> Column:
        """The part of a row's key; null is a key too."""
        # A null adds nothing to a hash, so its place is hashed as well.
        return F.pmod(F.xxhash64(*[c for k in self.keys for c in (F.col(k), F.col(k).isNull())]), F.lit(self.parts)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Parts that the keys of ``rows`` fall into; at most ``parts`` numbers."""
        return sorted(r[0] for r in rows.select(self.part_of().alias("part")).distinct().collect())

    def manifest(self, spark: SparkSession, version: int) -> dict[int, tuple[int, int, int | None]]:
        """part: (version that wrote it, rows, largest id). At most ``parts`` entries."""
        rows = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/version={version:08d}").collect()
        return {r["part"]: (r["written"], r["rows"], r["top"]) for r in rows}

    def latest(self, spark: SparkSession) -> int | None:
        return tables.latest_version(spark, self.folder, "manifest")

    def read(self, spark: SparkSession, version: int, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, of all parts or of some."""
        wanted = None if only is None else set(only)
        current: dict[int, list[int]] = {}
        for part, (written, n, _) in sorted(self.manifest(spark, version).items()):
            if n and (wanted is None or part in wanted):
                current.setdefault(written, []).append(part)
        found = [self._written(spark, v).where(F.col("part").isin(some)).drop("part") for v, some in sorted(current.items())]
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], self.schema)

    def _written(self, spark: SparkSession, version: int) -> DataFrame:
        """What a version wrote, with the part; other parts' folders are not opened where it is filtered by part."""
        whole = StructType([*self.schema.fields]).add("part", IntegerType())
        return spark.read.schema(whole).parquet(f"{self.folder}/data/version={version:08d}")

    def top(self, spark: SparkSession, version: int) -> int:
        """The largest id of a version, from its manifest alone."""
        return max((t for _, _, t in self.manifest(spark, version).values() if t is not None), default=0)

    def write(self, rows: DataFrame, version: int, touched: Sequence[int] | None = None, before: int | None = None) -> None:
        """Writes ``touched`` parts (by default all) as ``version``; the others stay those of ``before``.

        ``rows`` are all rows of the touched parts after the update.
        """
        spark, place = rows.sparkSession, f"{self.folder}/data/version={version:08d}"
        placed = rows.select(*self.schema.fieldNames()).withColumn("part", self.part_of())
        placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(place)
        counted = {r["part"]: (version, r["n"], r["top"]) for r in self._written(spark, version).groupBy("part").agg(F.count("*").alias("n"), F.max(self.id_col).cast("long").alias("top")).collect()}
        held = {} if before is None else self.manifest(spark, before)
        gone = dict.fromkeys(range(self.parts) if touched is None else touched, (version, 0, None))
        entries = [(p, *e) for p, e in sorted((held | gone | counted).items())]
        tables.publish(spark.createDataFrame(entries, _MANIFEST).coalesce(1), self.folder, "manifest", version)
