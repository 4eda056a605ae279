"""Snapshots: immutable Parquet versions of a table, small changes on top, and a pointer to what is current.

A writer puts a new version, or a file of changed rows, beside what is there and then moves the
pointer, so readers see either the one or the other, and a job that dies halfway
leaves the table as it was. A small change to a large table costs what the change costs; reading
puts base and changes together by key. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.sources import schemas


#: Changes after which they are put together, and the share of a table (one in so many rows) from which it is written anew.
CHANGES = 20
SHARE = 10


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _cast(name: str, rows: DataFrame) -> DataFrame:
    return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schemas.TABLES[name].fields])


@dataclass(frozen=True)
class Store:
    """Tables under ``root``, a URI or path that all executors share."""

    spark: SparkSession
    root: str

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def _pointer(self, name: str) -> dict | None:
        files, base = self._files()
        path = f"{base}/{schemas.identifier(name)}/current.json"
        if files.get_file_info(path).type != fs.FileType.File:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _point(self, name: str, pointer: dict) -> None:
        files, base = self._files()
        spare = f"{base}/{name}/{uuid.uuid4().hex}.tmp"
        files.create_dir(f"{base}/{name}", recursive=True)
        with files.open_output_stream(spare, compression=None) as f:
            f.write(json.dumps(pointer).encode())
        files.move(spare, f"{base}/{name}/current.json")

    def read(self, name: str) -> DataFrame:
        """The table as it is now; empty if it was never written."""
        pointer = self._pointer(name) or {"version": None, "changes": []}
        schema = schemas.TABLES[name]
        rows = schemas.empty(self.spark, name) if pointer["version"] is None else self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{pointer['version']}")
        if not pointer["changes"]:
            return rows
        keys = list(schemas.KEYS[name])
        last = self._last(name, pointer["changes"])
        kept = rows.join(last.select(*keys), keys, "left_anti").select(*schema.fieldNames())
        return kept.unionByName(last.filter("not _gone").select(*schema.fieldNames()))

    def _last(self, name: str, changes: list[str]) -> DataFrame:
        """The last change of every key, and whether it is a deletion (``_gone``)."""
        schema, keys, changed = schemas.TABLES[name], list(schemas.KEYS[name]), None
        for k, version in enumerate(changes):
            part = self.spark.read.schema(f"{_ddl(schema)}, _gone boolean").parquet(f"{self.root}/{name}/{version}").withColumn("_nth", F.lit(k))
            changed = part if changed is None else changed.unionByName(part)
        order = Window.partitionBy(*keys).orderBy(F.col("_nth").desc(), F.col("_gone"))
        return changed.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select(*schema.fieldNames(), "_gone")

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Makes ``rows`` the current version and reads it back; what was there before is kept until ``prune``."""
        version = f"v-{uuid.uuid4().hex}"
        by = schemas.PARTITIONS.get(name, ())
        out = _cast(name, rows)
        # One task per partition value would serialise a large language; ids spread it.
        (out.repartition(*by, "entity_id").write.partitionBy(*by) if by else out.write).parquet(f"{self.root}/{name}/{version}")
        self._point(name, {"version": version, "changes": []})
        return self.read(name)

    def merge(self, name: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
        """Replaces and adds ``upserts`` and removes the keys of ``deletes``; a key in both is replaced. Only the change is written.

        After ``CHANGES`` of them they are put together.
        """
        rows = []
        if upserts is not None:
            rows.append(_cast(name, upserts).withColumn("_gone", F.lit(False)))
        if deletes is not None:
            keys = schemas.KEYS[name]
            rows.append(deletes.select(*keys).distinct().select(*[(F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.TABLES[name].fields], F.lit(True).alias("_gone")))
        if not rows:
            return self.read(name)
        version = f"c-{uuid.uuid4().hex}"
        (rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).write.parquet(f"{self.root}/{name}/{version}")
        pointer = self._pointer(name) or {"version": None, "changes": []}
        pointer = pointer | {"changes": [*pointer["changes"], version]}
        self._point(name, pointer)
        return self._compacted(name, pointer) if len(pointer["changes"]) >= CHANGES else self.read(name)

    def _compacted(self, name: str, pointer: dict) -> DataFrame:
        """Puts the changes together: into one file while they are few beside the table, else into the table, which is written anew."""
        last = self._last(name, pointer["changes"])
        base = pointer["version"] and self.spark.read.parquet(f"{self.root}/{name}/{pointer['version']}").count()
        if not base or SHARE * last.count() >= base:
            return self.write(name, self.read(name))
        version = f"c-{uuid.uuid4().hex}"
        last.write.parquet(f"{self.root}/{name}/{version}")
        self._point(name, pointer | {"changes": [version]})
        return self.read(name)

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Writes several tables, of which each may be computed from the others' versions before."""
        return {name: self.write(name, rows) for name, rows in tables.items()}

    def drop(self, place: str) -> None:
        """Deletes a folder under ``root`` that isn't needed any more."""
        files, base = self._files()
        files.delete_dir(base + place.removeprefix(self.root))

    def prune(self, name: str) -> int:
        """Deletes what isn't current and says how many versions that were."""
        pointer = self._pointer(name)
        files, base = self._files()
        if pointer is None:
            return 0
        live = {pointer["version"], *pointer["changes"]}
        old = [x for x in files.get_file_info(fs.FileSelector(f"{base}/{name}")) if x.type == fs.FileType.Directory and x.base_name not in live]
        for x in old:
            files.delete_dir(x.path)
        return len(old)
