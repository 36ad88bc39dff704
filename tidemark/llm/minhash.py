"""Near-duplicate documents by a join on MinHash signature coordinates, confirmed on full shingle sets.

Documents of equal shingle sets form a class, represented by its smallest id. A class is posted under its signature's
(coordinate, value) pairs. Pairs that no other class has can't collide and are skipped; a class with fewer others than
the match threshold is skipped whole. Of the others it is posted under the rarest only, so many that two classes that
agree in as many places as the threshold meet in one list at least. Each list gives the pairs of its smallest member
with the others; their collisions are counted, pairs below the threshold go, the others are confirmed on full sets, and links
join components.

A second round finds the links that such stars miss. It takes the classes in lists that hold several components, and
joins them on their full sets, again by the rarest elements, as many as a pair of the wanted similarity must share one
of. The smaller set of a pair must hold the first of these among even fewer, and both must have enough elements left
after it; only such pairs across components are made. So a list of copies gives about as many pairs as it has members, yet no link
between components is lost. What stays quadratic is a rare element that many components share without being alike in more:
of its sets only those are joined whose size and place of the element still allow the similarity.

Defined results: texts without words have no set and no links; texts with fewer words than a shingle have one shingle.
Rows without id stand alone (null component, kept). Rows of equal id are one document. Texts of any length count whole; a
task holds one such set at a time besides its batch. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import checkpointed
from tidemark.llm.text import batches, mixed, texts, tidy, window_codes, word_codes, words

#: Words of a shingle, and percent of the union that two sets share at least.
WIDTH, PERCENT = 5, 85
#: Signature length, and how many standard deviations below its mean the number of equal places may be: pairs of just
#: the wanted similarity are below that with a chance of about 2e-6, closer ones with a smaller one.
COORDINATES, DEVIATIONS = 64, 4.75

_draws = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _OFFSETS = _draws[:COORDINATES] | np.uint64(1), _draws[COORDINATES:]


def match_threshold(percent: int) -> int:
    """The least number of equal places of two signatures whose sets are ``percent`` similar."""
    mean = COORDINATES * percent / 100
    return max(1, int(mean - DEVIATIONS * (mean * (1 - percent / 100)) ** 0.5))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of codes of the text's shingles."""
    return np.unique(window_codes(word_codes(words(text)), width))


def signature(codes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 1024):
        part = codes[at : at + 1024, None] * _FACTORS + _OFFSETS
        least = np.minimum(least, part.min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_shingles``, a ``digest`` of the set and its signature ``sig``."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1000):
            sets = [shingles(t, width) for t in texts(batch.column(1))]
            sigs = np.concatenate([signature(s) if len(s) else np.zeros(COORDINATES, np.int32) for s in sets])
            ends = pa.array(np.arange(0, len(sigs) + 1, COORDINATES, dtype=np.int32))
            columns = {
                "doc_id": batch.column(0).cast(pa.int64()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                "sig": pa.ListArray.from_arrays(ends, pa.array(sigs, pa.int32())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, sig array<int>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id`` and the shingle set ``codes`` of each document."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1000):
            sets = [shingles(t, width).view(np.int64) for t in texts(batch.column(1))]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], ["id", "codes"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "id long, codes array<long>")


def equal_places(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, hit: n + hit)


def rarest(held: DataFrame, least: Column) -> DataFrame:
    """The lists that a join needs: ``id`` and ``element`` of the rarest elements of each id.

    ``held`` has a row for each ``id`` and ``element``. Two ids that share at least the larger of their ``least``
    elements share one of those returned. ``least`` is an aggregate over the id's rows, elements of its own included.
    ``size`` is the number of an id's elements, ``at`` the place of this one among them, the rarest first.
    """
    needed = held.groupBy("id").agg(least.alias("least"), F.count("*").alias("size"))
    counts = held.groupBy("element").agg(F.count("*").alias("n")).filter("n > 1")
    shared = held.join(counts, "element").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("e"))
    spare = F.size("e") - F.col("least") + 1
    posted = shared.join(needed, "id").filter(spare > 0)
    posted = posted.select("id", "size", F.size("e").alias("shared"), F.posexplode(F.slice("e", 1, spare.cast("int"))).alias("at", "e"))
    at = F.col("size") - F.col("shared") + F.col("at")
    return posted.select("id", F.col("e.element").alias("element"), "size", at.alias("at"))


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``n_links``.

    ``component_id`` is the smallest id it reaches over links, itself included; ``kept`` says whether that is its own.
    ``n_links`` counts the confirmed links of its class that were needed to find its component.
    """
    matches = match_threshold(percent)
    every = checkpointed(signed(docs, width))
    some = every.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = checkpointed(some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    posts = classes.select("id", F.posexplode("sig").alias("at", "value"))
    value = F.col("value").cast("long").bitwiseAND((1 << 32) - 1)
    posts = posts.select("id", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(value).alias("element"))
    posted = checkpointed(rarest(posts, F.lit(matches)).select("id", "element"))
    firsts = posted.groupBy("element").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    lists = checkpointed(posted.join(firsts, "element"))
    stars = lists.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    alive = lists.select(F.col("id").alias("doc_id")).distinct()
    sets = checkpointed(shingle_sets(docs.select("doc_id", "text").join(alive, "doc_id", "left_semi"), width))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = sets.withColumnsRenamed({"id": "a", "codes": "x"}), sets.withColumnsRenamed({"id": "b", "codes": "y"})
        both = F.size(F.array_intersect("x", "y"))
        linked = pairs.join(y, "b").join(x, "a").filter(100 * both >= percent * (F.size("x") + F.size("y") - both))
        # Not distinct before it is written: that would bind the join to its own partitions, so that a frequent centre
        # could not be split. Rows of equal id can give a pair more than once.
        return checkpointed(linked.select("a", "b")).distinct()

    signs = classes.select("id", "sig").join(alive.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    x, y = signs.withColumnsRenamed({"id": "a", "sig": "x"}), signs.withColumnsRenamed({"id": "b", "sig": "y"})
    counted = stars.join(x, "a").join(y, "b").filter(equal_places(F.col("x"), F.col("y")) >= matches)
    links = confirmed(counted.select("a", "b"))
    labels = components(links)

    label = labels.select("id", F.col("component").alias("label"))
    marked = lists.select("element", "id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = marked.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    again = checkpointed(marked.join(several.select("element"), "element").select("id", "label").distinct())
    held = sets.join(again.select("id"), "id", "left_semi").distinct().select("id", F.explode("codes").alias("element"))
    met = rarest(held, F.ceil(F.count("*") * percent / 100)).join(again, "id")
    x, y = (met.select(F.col("id").alias(i), "element", *(F.col(c).alias(f"{c}_{i}") for c in ("label", "size", "at"))) for i in "ab")
    x = x.filter((100 + percent) * (F.col("size_a") - F.col("at_a")) >= 2 * percent * F.col("size_a"))
    left = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    enough = (100 + percent) * left >= percent * (F.col("size_a") + F.col("size_b"))
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    across = x.join(y, "element").filter((F.col("label_a") != F.col("label_b")) & smaller & enough).select("a", "b").distinct()
    more = confirmed(across)
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)

    ends = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    found = classes.select("digest", "id").join(labels, "id", "left").join(ends, "id", "left")
    found = found.select("digest", F.coalesce("component", "id").alias("component"), "n_links")
    out = every.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )
