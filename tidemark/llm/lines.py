"""Removal of lines that earlier documents hold, with levelled sorted runs of line keys.

Documents come in batches of ascending ids. A batch's keys are reduced to their smallest document before any shuffle,
merge-anti-joined with the runs of all earlier batches, and what is new becomes a run: a table in buckets of the key's
hash, each sorted by key, so that later merges neither shuffle nor sort it again. When a level holds ``FANOUT`` runs,
they are merged into one of the next level. In the end the runs name one owner for each key, and a line goes unless its
document owns its key. Lines are matched on key and document together, so a line that a third of all documents hold is
spread over as many tasks as any other. Batches and their sizes both grow with the square root of the table.

Defined results: null text is one empty line. Rows of equal id are one document; rows without id are one document
after all others, and so are rows of the id 2**63-1, which stands for none. Lines whose keys are short stay. An empty table gives no rows. Other columns pass through untouched.

Runs are tables of the session's catalogue, as only these keep buckets: the session needs the right to create and drop
tables in its current database. Their names are random; a driver that dies leaves them behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir, written

#: Least batches that a table is dealt into, documents of a batch where there are as many batches as millions of
#: documents in one, and runs of one level before they are merged.
BATCHES, BATCH_DOCS, FANOUT = 4, 1_000_000, 2
#: Least length of a key, in code points.
LEAST = 10

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile know that a bucket of one file is in the order it was written in."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levels of runs; a run has columns ``key`` and ``owner``, each key in one run only."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add the keys of a batch (columns ``key`` and ``doc``) that no run has yet."""
        new = lines.groupBy("key").agg(F.min("doc").alias("owner"))
        for run in self.runs():
            new = new.join(run.hint("merge"), "key", "left_anti")
        self.levels[0].append(self._run(new))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _compact(self, level: int) -> None:
        merged = self._run(reduce(self._merged, self.levels[level]))
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(merged)
        if len(self.levels[level + 1]) >= self.fanout:
            self._compact(level + 1)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one; no key is in both."""
        both = a.join(b.withColumnRenamed("owner", "other").hint("merge"), "key", "full_outer")
        return both.select("key", F.coalesce("owner", "other").alias("owner"))

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        """The rows, dealt by key already, as a table in the shared folder: a sorted file for each bucket of the key."""
        spark = rows.sparkSession
        name, buckets = f"run_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"spark_catalog.default.{name}"
        with ordered_scans(spark):
            out = rows.write.format("parquet").bucketBy(buckets, "key").sortBy("key")
            out.option("path", f"{shared_dir(spark)}/tables/{name}").saveAsTable(table)
        run = spark.table(table)
        run.schema  # noqa: B018  resolved now: the files stay when the name goes
        spark.sql(f"DROP TABLE {table}")
        return run

    def owners(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs())


def dedup_lines(docs: DataFrame, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """The documents with their text reduced to the lines that stay, and counts ``n_lines`` and ``n_dropped``.

    ``batches``: the square root of the documents in millions if not given, ``BATCHES`` at least.
    """
    batches = batches or max(BATCHES, round((docs.count() / BATCH_DOCS) ** 0.5))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    ident = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    code = F.xxhash64(F.coalesce("text", F.lit("")))  # tells rows of equal id apart
    bounds = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = reduce(lambda c, b: c + F.when(ident > b, 1).otherwise(0), bounds, F.lit(0))
    numbered = F.posexplode(lines).alias("pos", "line")
    held = docs.select(ident.alias("doc"), code.alias("code"), batch.alias("batch"), numbered)
    held = held.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= LEAST)
    held = written(held.select("doc", "code", "pos", F.unhex(F.md5("key")).alias("key"), "batch"), "batch")

    runs = LineRuns(fanout)
    for i in range(len(bounds) + 1):
        runs.add(held.filter(F.col("batch") == i).select("key", "doc"))
    owners = runs.owners().withColumnRenamed("owner", "doc")
    gone = held.join(owners, ["key", "doc"], "left_anti").groupBy("doc", "code").agg(F.collect_set("pos").alias("gone"))

    # The other columns travel as one, so that none of their names can clash.
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), lines.alias("lines"), ident.alias("doc"), code.alias("code"))
    n, gone_here = F.size("lines"), F.coalesce("gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), gone_here)
    return whole.join(gone, ["doc", "code"], "left").select(
        *(F.col("rest").getField(c).alias(c) for c in rest),
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("text"),
        n.cast("long").alias("n_lines"),
        F.size(gone_here).cast("long").alias("n_dropped"),
    )
