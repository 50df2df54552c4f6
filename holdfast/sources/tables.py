"""Tables as versioned parquet folders: ordered loads, appends, full rewrites.

A table is a folder with one subfolder per version, and a version has one per write; the
highest version with a finished write counts. A rewrite may read the current version while
it writes the next, and a failed write leaves nothing finished behind. Writes are numbered,
so a reader can ask for what came after the one it has seen, whatever the clock says.

A keyed version holds one row a key: later batches take the place of earlier rows when it is read, so a change writes the changed rows
only. After ``MOST_BATCHES`` batches they are merged into the next version.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.quality import foreign_key, union_all
from holdfast.schemas import FOREIGN_KEYS, LOAD_DEFAULTS, LOAD_ORDER, RAW_TABLES
from holdfast.sources.csv import read_csv
from holdfast.sources.workspace import make_folder, remove_folder, subfolders


# Batches of a keyed version that a reader puts together.
MOST_BATCHES = 8


class Tables:
    """Named tables below one shared root folder; one writer a table at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self, name: str) -> list[tuple[int, int]]:
        """(version, batch) of every finished write, in order."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = []
        for version in fs.listStatus(folder):
            for batch in fs.listStatus(version.getPath()):
                path = batch.getPath()
                if fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                    found.append((int(version.getPath().getName()[1:]), int(path.getName()[1:])))
        return sorted(found)

    def _path(self, name: str, version: int, batch: int) -> str:
        return f"{self.root}/{name}/v{version:06d}/b{batch:06d}"

    def _read(self, name: str, batches: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[self._path(name, v, b) for v, b in batches])

    def exists(self, name: str) -> bool:
        return bool(self._batches(name))

    def mark(self, name: str) -> str:
        """How far the table reaches now: its version and last batch; empty without a table."""
        found = self._batches(name)
        return "{}.{}".format(*found[-1]) if found else ""

    def read(self, name: str) -> DataFrame:
        found = self._batches(name)
        last = [x for x in found if x[0] == found[-1][0]]
        key = self._key(name, last[0][0])
        if key is None:
            return self._read(name, last)
        rows = self._read(name, last[:1])
        for batch in last[1:]:
            newer = self._read(name, [batch])
            rows = rows.join(newer.select(key), key, "left_anti").select(*newer.columns).unionByName(newer)
        return rows

    def _key(self, name: str, version: int) -> str | None:
        """The key of a keyed version: the name of a folder beside its batches."""
        names = [x for x in subfolders(self.spark, f"{self.root}/{name}/v{version:06d}") if x.startswith("key=")]
        return names[0].removeprefix("key=") if names else None

    def replace_keyed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Write the next version as a keyed one; ``df`` holds each key once."""
        found = self._batches(name)
        make_folder(self.spark, f"{self.root}/{name}/v{found[-1][0] + 1 if found else 1:06d}/key={key}")
        return self.replace(name, df)

    def upsert(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Write rows that take the place of those with their key; each key once. Nothing else is rewritten, but now and then all batches are merged."""
        if not self.exists(name):
            return self.replace_keyed(name, df, key)
        self.append(name, df)
        found = self._batches(name)
        if sum(v == found[-1][0] for v, _ in found) > MOST_BATCHES:
            self.replace_keyed(name, self.read(name), key)
            self.vacuum(name, keep=2)  # who reads the version before isn't disturbed
        return self.read(name)

    def replaced_since(self, name: str, mark: str) -> bool:
        """Whether the table was rewritten as a whole after ``mark``."""
        return mark.split(".")[0] != self.mark(name).split(".")[0]

    def read_since(self, name: str, mark: str) -> DataFrame:
        """The rows of the batches after ``mark``; all rows once the table was replaced. Older files aren't opened."""
        if not mark or self.replaced_since(name, mark):
            return self.read(name)
        seen = tuple(map(int, mark.split(".")))
        new = [x for x in self._batches(name) if x > seen]
        return self._read(name, new) if new else self.read(name).limit(0)

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Remove all but the last ``keep`` versions, and what failed writes left of earlier ones. Not while others read them."""
        versions = sorted({v for v, _ in self._batches(name)})
        first = versions[-keep] if len(versions) >= keep else 0
        for folder in subfolders(self.spark, f"{self.root}/{name}"):
            if int(folder[1:]) < first:
                remove_folder(self.spark, f"{self.root}/{name}/{folder}")

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next version; readers of the current one are not disturbed."""
        found = self._batches(name)
        # A folder of that number without _SUCCESS is the rest of a failed write.
        df.write.mode("overwrite").parquet(self._path(name, found[-1][0] + 1 if found else 1, 1))
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next batch of the current version."""
        found = self._batches(name)
        if not found:
            return self.replace(name, df)
        version, batch = found[-1]
        df.write.mode("overwrite").parquet(self._path(name, version, batch + 1))
        return self.read(name)


def with_defaults(df: DataFrame, schema: T.StructType, defaults: Mapping) -> DataFrame:
    """The full column list of a table; a default fills only columns the load leaves out."""
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def load(tables: Tables, name: str, path: str, loaded_at: dt.datetime, columns: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """Append a CSV folder to a raw table. ``columns`` is the load list; all but ``created_at`` by default."""
    schema = RAW_TABLES[name]
    columns = columns or [f.name for f in schema.fields if f.name != "created_at"]
    listed = T.StructType([schema[c] for c in columns])
    read = read_csv(tables.spark, path, listed, multiline)
    stamp = F.lit(loaded_at.isoformat(sep=" ")).cast("timestamp_ntz")
    return tables.append(name, with_defaults(read, schema, LOAD_DEFAULTS[name] | {"created_at": stamp}))


def load_all(tables: Tables, paths: Mapping[str, str], loaded_at: dt.datetime, multiline: bool = False) -> DataFrame:
    """Load parents before children and report the orphans of every foreign key."""
    for name in LOAD_ORDER:
        if name in paths:
            load(tables, name, paths[name], loaded_at, multiline=multiline)
    return orphan_report({n: tables.read(n) for n in LOAD_ORDER if n in paths})


def orphan_report(frames: Mapping[str, DataFrame]) -> DataFrame:
    return union_all(
        [
            foreign_key(frames[child], key, frames[parent], f"{child}.{key}")
            for child, keys in FOREIGN_KEYS.items()
            for key, parent in keys
            if child in frames and parent in frames
        ]
    )
