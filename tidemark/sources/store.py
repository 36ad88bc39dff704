"""A store of Parquet tables in versions. A table is a folder: each write puts its files in a new subfolder, then a small
numbered file, the manifest, names all folders that make up the table from now on. Readers take the highest manifest.

Files are complete before a manifest names them, and manifests are only ever added, so readers never see a partial write,
a merge can read what it replaces, and a writer that dies leaves the table as it was. Two writers at a time want the same
number; the second fails. Folders belong to parts of a table, so appends add files, and a change of some parts, such as
days, leaves the others' files as they are. A table is either wholly in parts or has none: what would mix the two, and so
hide rows from readers and writers of parts, is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schemas import TABLES


class ContractError(ValueError):
    """Rows don't have the columns and types of their table."""


class StoreError(RuntimeError):
    """A table's files aren't as they must be, or another writer was faster."""


def checked(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the schema's order. Missing, extra and differently typed columns are errors."""
    have, want = dict(rows.dtypes), {f.name: f.dataType.simpleString() for f in schema.fields}
    if have != want:
        differ = sorted(set(have.items()) ^ set(want.items()))
        raise ContractError(f"columns differ from the contract: {differ}")
    return rows.select(*(f.name for f in schema.fields))


#: Age, in milliseconds, at which files that no manifest names are left-overs and not a writer's at work.
STALE_MS = 24 * 3_600_000


class Store:
    """Tables by name (``schema.table``) under a root that the executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _manifests(self, name: str) -> list[int]:
        """The numbers of a table's manifests, ascending."""
        fs, path = self._fs()
        folder = path(f"{self._folder(name)}/_versions")
        if not fs.exists(folder):
            return []
        return sorted(int(n) for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())

    def _manifest(self, name: str, number: int) -> list[list]:
        """Pairs of a part's key (null: of no part) and its folder."""
        text = self.spark.read.text(f"{self._folder(name)}/_versions/{number}", wholetext=True).first()[0]
        return json.loads(text)["parts"]

    def _parts(self, name: str) -> list[list]:
        numbers = self._manifests(name)
        if not numbers:
            fs, path = self._fs()
            if fs.exists(path(f"{self._folder(name)}/data")):
                raise StoreError(f"{name} has files but no manifest")
            return []
        return self._manifest(name, numbers[-1])

    def _name(self, name: str, before: int, parts: list[list], keep: int = 2) -> None:
        """Add the manifest after ``before``; ``keep`` manifests, and the folders that they name, stay for readers."""
        fs, path = self._fs()
        folder, number = f"{self._folder(name)}/_versions", before + 1
        draft = path(f"{folder}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        if fs.exists(path(f"{folder}/{number}")) or not fs.rename(draft, path(f"{folder}/{number}")):
            fs.delete(draft, False)
            raise StoreError(f"{name} was written by another writer")
        numbers = self._manifests(name)
        kept = {f.split("/")[1] for n in numbers[-keep:] for _, f in self._manifest(name, n)}
        for n in numbers[:-keep]:
            fs.delete(path(f"{folder}/{n}"), False)
        written = fs.getFileStatus(path(f"{folder}/{number}")).getModificationTime()
        for old in fs.listStatus(path(f"{self._folder(name)}/data")):
            # Folders that no kept manifest names may be another writer's, at work; old ones are not.
            if old.getPath().getName() not in kept and old.getModificationTime() < written - STALE_MS:
                fs.delete(old.getPath(), True)

    def _sound(self, name: str, parts: list[list], by: str | None) -> None:
        """Refuse what reads or writes parts of a table without, or the whole of one with parts."""
        if parts and by is None and any(key is not None for key, _ in parts):
            raise StoreError(f"{name} is in parts: say by which column")
        if parts and by is not None and any(key is None for key, _ in parts):
            raise StoreError(f"{name} has rows of no part")

    def exists(self, name: str) -> bool:
        return bool(self._parts(name))

    def read(self, name: str, schema: T.StructType | None = None, parts: Collection | None = None) -> DataFrame:
        """The table, or only the parts of some keys; one that was never written is empty, if its schema is known."""
        schema = schema or TABLES.get(name)
        found = self._parts(name)
        if not found and schema is None:
            raise LookupError(f"no such table: {name}")
        if parts is not None:
            self._sound(name, found, "parts")
        wanted = None if parts is None else {str(p) for p in parts}
        folders = [f for key, f in found if wanted is None or key in wanted]
        if schema is None:
            schema = self.spark.read.parquet(f"{self._folder(name)}/{found[0][1]}").schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self._folder(name)}/{f}" for f in folders))

    def _written(self, name: str, rows: DataFrame, by: str | None) -> list[list]:
        """The rows as files in a new folder, one for each value of ``by``; the pairs that a manifest names them by."""
        if name in TABLES:
            rows = checked(rows, TABLES[name])
        folder = f"data/{uuid.uuid4().hex}"
        if by is None:
            rows.write.parquet(f"{self._folder(name)}/{folder}")
            return [[None, folder]]
        # A copy of the column makes the folders, so that the files have it, too.
        rows.withColumn("_part", F.col(by).cast("string")).write.partitionBy("_part").parquet(f"{self._folder(name)}/{folder}")
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self._folder(name)}/{folder}")) if s.isDirectory()]
        return [[unquote(n.removeprefix("_part=")), f"{folder}/{n}"] for n in sorted(names)]

    def overwrite(self, name: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        """The rows in place of the table; ``by``: a part for each value of that column, which a table in parts keeps."""
        before, parts = max(self._manifests(name), default=0), self._parts(name)
        if by is None:
            self._sound(name, parts, None)
        self._name(name, before, self._written(name, rows, by))
        return self.read(name, rows.schema)

    def replace(self, name: str, rows: DataFrame, by: str, keys: Collection) -> DataFrame:
        """The rows in place of the parts of some keys; all rows have one of them. Other parts' files stay as they are."""
        before, parts, gone = max(self._manifests(name), default=0), self._parts(name), {str(k) for k in keys}
        self._sound(name, parts, by)
        kept = [p for p in parts if p[0] not in gone]
        new = self._written(name, rows, by)
        if extra := {k for k, _ in new} - gone:
            raise StoreError(f"{name}: rows of parts that are not replaced: {sorted(extra)[:5]}")
        self._name(name, before, [*kept, *new])
        return self.read(name, rows.schema)

    def append(self, name: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        """The table with more rows: files are added, none is written again. ``by``: the column of a table in parts."""
        before, parts = max(self._manifests(name), default=0), self._parts(name)
        self._sound(name, parts, by)
        self._name(name, before, [*parts, *self._written(name, rows, by)])
        return self.read(name, rows.schema)

    def compact(self, name: str, files: int, by: str | None = None) -> DataFrame:
        """The table in so many files, or of a table in parts ``by`` a column each part in so many at most, named only
        after they were read again and hold the same parts with as many rows of the same sums."""
        before, parts, rows = max(self._manifests(name), default=0), self._parts(name), self.read(name)
        self._sound(name, parts, by)
        if by is None:
            spread = rows.repartition(files)
        else:
            spread = rows.repartition(F.col(by), F.pmod(F.xxhash64(*rows.columns), F.lit(files)))
        made = self._written(name, spread, by)
        # Rows of a part of another name would be lost to readers of that part.
        if by is not None and {k for k, _ in made} != {k for k, _ in parts}:
            raise StoreError(f"{name} isn't in parts by {by}")
        new = self.spark.read.schema(rows.schema).parquet(*(f"{self._folder(name)}/{f}" for _, f in made)) if made else rows
        digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
        if digest(new) != digest(rows):
            raise StoreError(f"{name} differs after it was compacted")
        self._name(name, before, made)
        return self.read(name, rows.schema)

    def tables(self, views: tuple[str, ...] = ()) -> list[str]:
        """Names of the tables that there are, and of views that are asked for."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        found = [
            f"{s.getPath().getName()}.{t.getPath().getName()}"
            for s in fs.listStatus(path(self.root))
            if s.isDirectory()
            for t in fs.listStatus(s.getPath())
            if fs.exists(path(f"{t.getPath()}/_versions"))
        ]
        return sorted([*found, *views])


def export(rows: DataFrame, folder: str, description: dict[str, str], label: str, files: int | None = None) -> dict:
    """Write a mart as Parquet beside a specification of its columns and a few statistics, as JSON; return the latter.

    ``files``: so many files, in place of as many as the rows' plan gives.
    """
    (rows if files is None else rows.repartition(files)).write.mode("overwrite").parquet(f"{folder}/data")
    written = rows.sparkSession.read.parquet(f"{folder}/data")
    stats = written.agg(
        F.count("*").alias("n_rows"), F.countDistinct("clob_token_id").alias("n_tokens"), F.countDistinct("market_id").alias("n_markets"),
        F.min("odds_timestamp_epoch").alias("first_epoch"), F.max("odds_timestamp_epoch").alias("last_epoch"),
        F.count_if("is_active").alias("n_active_rows"),
    ).first().asDict()
    top = written.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(label)).limit(10).collect()
    spec = {
        "columns": [{"name": f.name, "type": f.dataType.simpleString(), "about": description.get(f.name, "")} for f in written.schema.fields],
        "statistics": stats,
        "top_labels": [[r[label], r["n"]] for r in top],
    }
    text = rows.sparkSession.createDataFrame([(json.dumps(spec),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/spec")
    return spec
