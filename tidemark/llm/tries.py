"""The prefix trie of conversations, from rolling fingerprints of their prefixes.

A prefix's fingerprint is a polynomial in the codes of its turns, over two prime fields. Turns are sorted by conversation
over all tasks; numpy adds up each task's stretch, and the few numbers that a conversation hands from one task to the next
go through the driver, one row for each task. So a conversation of any length is spread over tasks as its rows are.
Fingerprints are kept divided by the power of their length, as plain running sums; the prefix of a conversation rebuilt
from two others is then found from their sums alone, without another sort of the texts.

Prefixes of one depth and fingerprint are a candidate group. Each is verified turn by turn against its representative,
the smallest conversation: all its members must have the representative's last role and text and its parent group.
Members that differ are split off, they and all their longer prefixes get a second fingerprint of where they were split,
and groups are verified again. So the trie is exact whatever the fingerprints.

A node is named by its smallest member. Nodes of one name lie below one another, as a path, and each path hangs on a node
of an earlier path. Sums over subtrees are rolled up along these parents, a path at a time, in as many rounds as the
logarithm of the longest row of paths, and then down each path as running sums.

Rows without ``conv_id`` take no part. A null role or text is empty. Turns are ordered by ``turn``, null first, rows of
equal turn by role, then text; repeated rows are turns of their own. ``conv_id % 5`` has the sign of ``conv_id``, as in SQL.
Roles and texts of any length are one value each. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, written
from tidemark.llm.text import small_batches, tidy

#: The field of both residues of a fingerprint, and their bases; a product of two residues fits a long.
FIELD, BASES = (1 << 31) - 1, (1_103_515_245, 742_938_285)
#: Conversations of a family share the first turns of its first; the most that one shares.
FAMILY, MOST_SHARED = 5, 8
#: Ids of an end node's members that are joined to one string before they are sent to the task that hashes it.
CHUNK = 1 << 14

EMPTY = hashlib.sha256(b"").hexdigest()


class _Carry:
    """A group's rows and sums so far."""

    def __init__(self, group: int | None = None, n: int = 0, sums: tuple[int, ...] = ()) -> None:
        self.group, self.n, self.sums = group, n, sums


class Running:
    """Running sums within groups over sorted rows, a batch after another.

    ``columns`` names each summed column; ``fields`` has for each of them None, or the base and the field in which the
    term at place i of its group is divided by the base's i-th power.
    """

    def __init__(self, group: str, columns: list[str], fields: list[tuple[int, int] | None]) -> None:
        self.group, self.columns, self.fields = group, columns, fields
        self.steps = [None if f is None else (pow(f[0], -1, f[1]), f[1]) for f in fields]

    def shifted(self, sums: Iterable[int], n: int) -> list[int]:
        """Sums of a stretch as they are where ``n`` rows of its group came before."""
        return [s if f is None else s * pow(f[0], n, f[1]) % f[1] for s, f in zip(sums, self.steps, strict=True)]

    def after(self, carry: _Carry, then: _Carry) -> _Carry:
        """What a stretch ``then`` that began anew is after ``carry``."""
        if carry.group is None or carry.group != then.group:
            return then
        sums = [a + b if f is None else (a + b) % f[1] for a, b, f in zip(carry.sums, self.shifted(then.sums, carry.n), self.steps, strict=True)]
        return _Carry(then.group, carry.n + then.n, tuple(sums))

    def batch(self, batch: pa.RecordBatch, carry: _Carry) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], _Carry]:
        """Places from 1, each column's sums with and without the row's own term, and the carry for the next batch."""
        group = batch[self.group].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        start = np.repeat(starts, np.diff(np.append(starts, len(group))))
        place = np.arange(len(group)) - start + 1
        on = (start == 0) & (group[0] == carry.group)  # what goes on with the carried group
        sums, befores = [], []
        for name, step, known in zip(self.columns, self.steps, carry.sums or (0,) * len(self.columns), strict=True):
            terms = batch[name].to_numpy().astype(np.int64)
            if step is not None:
                terms = terms * _powers(*step, len(group))[place] % step[1]
                terms[on] = terms[on] * pow(step[0], carry.n, step[1]) % step[1]
            total = np.cumsum(terms)
            inner = total - (total - terms)[start] + on * known
            befores.append(inner - terms if step is None else (inner - terms) % step[1])
            sums.append(inner if step is None else inner % step[1])
        place = place + on * carry.n
        return place, sums, befores, _Carry(int(group[-1]), int(place[-1]), tuple(int(x[-1]) for x in sums))


def _powers(step: int, field: int, n: int) -> np.ndarray:
    """The powers 0 to ``n`` of ``step``, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * pow(step, len(out), field) % field])
    return out


def running(rows: DataFrame, group: str, order: list[str], columns: list[str], fields: list[tuple[int, int] | None]) -> DataFrame:
    """``rows`` with ``place``, a row's number within its group (a long, never null) by ``order``, and for each of
    ``columns`` its running sum with and without the row's own term, ``<column>_sum`` and ``<column>_before``."""
    small_batches(rows.sparkSession)
    ordered = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))  # the number stays with the rows
    how = Running(group, columns, fields)

    def summary(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for a part: its first group, and what it carries on of its last one."""
        part, first, last = None, None, _Carry()
        for batch in it:
            if batch.num_rows:
                part = batch["_part"][0].as_py()
                first = batch[group][0].as_py() if first is None else first
                last = how.batch(batch, last)[-1]
        if part is not None:
            row = {"part": part, "first": first, "last": last.group, "n": last.n, "sums": list(last.sums)}
            kinds = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist([row], kinds)

    # One row of a few numbers for each part, whatever the table's size.
    light = dealt.select("_part", group, *columns).mapInArrow(tidy(summary), "part int, first long, last long, n long, sums array<long>")
    carries, at = {}, _Carry()
    for r in sorted(light.collect(), key=lambda r: r["part"]):
        carries[r["part"]] = at
        own = _Carry(r["last"], r["n"], tuple(r["sums"]))
        at = how.after(at, own) if r["first"] == r["last"] else own
    names = [*rows.columns, "place", *(f"{c}_sum" for c in columns), *(f"{c}_before" for c in columns)]

    def summed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in it:
            if batch.num_rows:
                carry = carries[batch["_part"][0].as_py()] if carry is None else carry
                place, sums, befores, carry = how.batch(batch, carry)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (place, *sums, *befores))], names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` long" for n in names[len(rows.columns) :]]
    return dealt.mapInArrow(tidy(summed), ", ".join(schema))


def turns(table: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` of the rows that take part."""
    filled = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    return table.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *filled)


def _shared(conv: str) -> Column:
    """How many turns the conversation takes from its family's first."""
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def _fingerprint(a: Column, b: Column) -> Column:
    return a * (1 << 31) + b


def _moved(base: int, mark: Column, own: Column, start: Column, back: Column, field: int) -> Column:
    """A running sum of a conversation's own turns as it is in the rebuilt one: ``start`` (of the turns before) plus what
    was added since ``own``, multiplied by the base's power by which the turns move towards the front."""
    powers = F.array(*(F.lit(pow(base, i, field)).cast("long") for i in range(MOST_SHARED + 1)))
    return (start + F.get(powers, back) * ((mark - own + field) % field)) % field


class Rebuilt:
    """The rebuilt conversations.

    ``convs``: a row for each with ``conv``, its ``length``, and its last prefix's fingerprint ``g``. ``rows``: a row for
    each prefix but the empty one: ``conv``, ``depth``, ``g``, the fingerprint ``pg`` of the prefix without its last turn,
    and that turn's ``role`` and ``text``.
    """

    def __init__(self, table: DataFrame, field: int = FIELD) -> None:
        rows = turns(table)
        codes = [F.pmod(F.xxhash64(F.lit(i), "role", F.xxhash64("text")), F.lit(field)).alias(f"c{i}") for i in (0, 1)]
        bases = [b % (field - 1) + 1 for b in BASES]  # never zero
        scanned = running(rows.select("*", *codes), "conv", ["turn", "role", "text"], ["c0", "c1"], [(b, field) for b in bases])

        # For each conversation its length and its sums after 0 to MOST_SHARED turns and at the end: a few numbers.
        marks = [F.max(F.when(F.col("place") == i, F.struct("c0_sum", "c1_sum"))).alias(f"m{i}") for i in range(1, MOST_SHARED + 1)]
        ends = scanned.groupBy("conv").agg(F.max(F.struct("place", "c0_sum", "c1_sum")).alias("end"), *marks)
        zero = F.struct(F.lit(0).cast("long").alias("c0_sum"), F.lit(0).cast("long").alias("c1_sum"))
        array = F.array(zero, *(f"m{i}" for i in range(1, MOST_SHARED + 1))).alias("marks")
        ends = checkpointed(ends.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("first"), _shared("conv").alias("h"), "end", array))
        heads = ends.filter("conv = first").select("first", F.col("end.place").alias("first_n"), F.col("marks").alias("first_marks"))
        known = ends.join(heads, "first", "left")
        taken = F.least("h", F.coalesce(F.col("first_n"), F.lit(0)).cast("int"))
        here, there = F.get("marks", F.col("h")), F.get("first_marks", F.col("b"))
        known = known.withColumn("b", taken).withColumn("own", here).withColumn("start", F.coalesce(there, zero))
        known = known.withColumn("length", F.col("b") + F.greatest(F.col("end.place") - F.col("h"), F.lit(0)))
        at_end = [
            F.when(F.col("end.place") > F.col("h"), _moved(base, F.col(f"end.c{i}_sum"), F.col(f"own.c{i}_sum"), F.col(f"start.c{i}_sum"), F.col("h") - F.col("b"), field)).otherwise(F.col(f"start.c{i}_sum"))
            for i, base in enumerate(bases)
        ]
        known = checkpointed(known.select("conv", "first", "h", "b", "own", "start", "length", _fingerprint(*at_end).alias("g")))
        self.convs = known.select("conv", "length", "g")

        # What a turn is copied to: its own conversation beyond the shared turns, its whole family within them.
        family = known.filter("b > 0").groupBy("first").agg(F.collect_list(F.struct("conv", "b")).alias("family"))  # of fewer than 2 * FAMILY ids
        plan = known.join(family.withColumnRenamed("first", "conv"), "conv", "left").select("conv", "h", "b", "own", "start", "family")
        joined = scanned.join(plan, "conv")
        befores = [F.col(f"c{i}_before") for i in (0, 1)]
        back = F.col("h") - F.col("b")
        moved = [_moved(base, F.col(f"c{i}_sum"), F.col(f"own.c{i}_sum"), F.col(f"start.c{i}_sum"), back, field) for i, base in enumerate(bases)]
        moved_before = [_moved(base, befores[i], F.col(f"own.c{i}_sum"), F.col(f"start.c{i}_sum"), back, field) for i, base in enumerate(bases)]
        parts = ["conv", "depth", "g", "pg"]
        kept = F.struct(*(c.alias(n) for c, n in zip((F.col("conv"), F.col("place") - back, _fingerprint(*moved), _fingerprint(*moved_before)), parts, strict=True)))
        own = F.when(F.col("place") > F.col("h"), F.array(kept)).otherwise(F.array().cast("array<struct<conv:bigint,depth:bigint,g:bigint,pg:bigint>>"))
        g, pg = _fingerprint(F.col("c0_sum"), F.col("c1_sum")), _fingerprint(*befores)
        wanted = F.filter(F.coalesce("family", F.array().cast("array<struct<conv:bigint,b:int>>")), lambda x: x["b"] >= F.col("place"))
        copies = F.transform(wanted, lambda x: F.struct(x["conv"].alias("conv"), F.col("place").alias("depth"), g.alias("g"), pg.alias("pg")))
        self.rows = joined.select(F.inline(F.concat(own, copies)), "role", "text")


def trie(table: DataFrame, field: int = FIELD) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; columns as ``op11`` returns them.

    ``field`` is that of the first fingerprints; a small one makes prefixes collide, which costs rounds, not results.
    """
    built = Rebuilt(table, field)
    zero = F.lit(0).cast("long")
    roots = built.convs.select("conv", zero.alias("depth"), zero.alias("g"), F.lit(None).cast("long").alias("pg"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = roots.unionByName(built.rows).withColumn("s", zero).withColumn("ps", zero)
    ends = built.convs.select("conv", F.col("length").alias("depth"), "g", zero.alias("s"))
    nodes = _verified(rows)
    while not nodes.filter("split > 0").isEmpty():
        rows = _split(rows, nodes)
        ends = rows.join(ends.select("conv", "depth"), ["conv", "depth"]).select("conv", "depth", "g", "s")
        nodes = _verified(rows)
    nodes = nodes.select("depth", "g", "s", "pg", "ps", "conv_id", "n_convs", "bytes")

    keys = ["depth", "g", "s"]
    up = [(F.col("depth") - 1).alias("depth"), F.col("pg").alias("g"), F.col("ps").alias("s")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, keys, "left").fillna(0, "n_children")
    above = nodes.select("conv_id", *keys).withColumnRenamed("conv_id", "parent_conv_id")
    nodes = nodes.withColumns({"d1": F.col("depth") - 1, "g1": F.col("pg"), "s1": F.col("ps")})
    above = above.withColumnsRenamed({"depth": "d1", "g": "g1", "s": "s1"})
    nodes = nodes.join(above, ["d1", "g1", "s1"], "left").drop("d1", "g1", "s1", "pg", "ps")
    nodes = written(nodes.join(_digests(ends), keys, "left").fillna(EMPTY, "ends_sha256"))
    return _rolled_up(nodes)


def _verified(rows: DataFrame) -> DataFrame:
    """The nodes' candidates, with ``split`` 0 for the representative's turn and a number for each that differs from it.

    Equal members are added up before they are sent, so a group of a third of all rows is a few rows for each task.
    """
    turn = ["depth", "g", "s", "pg", "ps", "role", "text"]
    variants = rows.groupBy(*turn).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    light = variants.select(*turn[:5], F.xxhash64("role", "text").alias("turn_code"), "conv_id", "n_convs", F.octet_length("text").cast("long").alias("bytes"))
    order = Window.partitionBy("depth", "g", "s").orderBy("conv_id")  # of the turns that share a fingerprint: one, as a rule
    return checkpointed(light.withColumn("split", F.row_number().over(order) - 1))


def _split(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with ``s`` and ``ps`` that tell apart what was split, and all that is below it."""
    marks = nodes.filter("split > 0").select("depth", "g", "s", "conv_id", "split")
    # Each split turn's own text and parent, by its smallest member.
    named = rows.join(marks.withColumnRenamed("conv_id", "conv"), ["conv", "depth", "g", "s"])
    named = named.select("depth", "g", "s", "pg", "ps", "role", "text", "split")
    code = F.when(F.col("split").isNull(), F.lit(0)).otherwise(F.xxhash64("depth", "g", "s", "split"))
    marked = rows.join(named, ["depth", "g", "s", "pg", "ps", "role", "text"], "left").filter("depth > 0")
    was = F.when(F.col("s") == F.col("ps"), F.lit(0).cast("long")).otherwise(F.xxhash64("s"))
    codes = [F.pmod(F.xxhash64(F.lit(i), code, was) * F.when((code == 0) & (was == 0), 0).otherwise(1), F.lit(FIELD)).alias(f"c{i}") for i in (0, 1)]
    light = marked.select("conv", "depth", "g", "pg", "role", "text", *codes)
    summed = running(light, "conv", ["depth"], ["c0", "c1"], [None, None])
    totals = [(F.col(f"c{i}_sum") % FIELD, F.col(f"c{i}_before") % FIELD) for i in (0, 1)]
    s, ps = (_fingerprint(totals[0][j], totals[1][j]) for j in (0, 1))
    below = summed.select("conv", "depth", "g", "pg", "role", "text", s.alias("s"), ps.alias("ps"))
    return checkpointed(rows.filter("depth = 0").unionByName(below))


def _digests(ends: DataFrame) -> DataFrame:
    """The SHA-256 of the ids, joined by commas in ascending order, of the conversations that end at each node.

    Ids are sorted over all tasks and joined to strings of at most ``CHUNK`` ids there; only these strings meet in the
    task that hashes a node, one after another, as SHA-256 allows no other way.
    """
    keys = ["depth", "g", "s"]
    dealt = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")

    def joined(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in it:
            found: list[tuple] = []
            for *at, conv in zip(*(batch[c].to_pylist() for c in (*keys, "conv")), strict=True):
                if ids and (at != key or len(ids) == CHUNK):
                    found.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = at
                ids.append(conv)
            yield from _batch(found, [*keys, "from", "ids"])
        if ids:
            yield from _batch([(*key, ids[0], ",".join(map(str, ids)))], [*keys, "from", "ids"])

    def hashed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in it:
            found = []
            for *at, ids in zip(*(batch[c].to_pylist() for c in (*keys, "ids")), strict=True):
                if at != key:
                    if key is not None:
                        found.append((*key, digest.hexdigest()))
                    key, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield from _batch(found, [*keys, "ends_sha256"])
        if key is not None:
            yield from _batch([(*key, digest.hexdigest())], [*keys, "ends_sha256"])

    chunks = dealt.mapInArrow(tidy(joined), "depth long, g long, s long, `from` long, ids string")
    chunks = chunks.repartition(*keys).sortWithinPartitions(*keys, "from")
    return chunks.mapInArrow(tidy(hashed), "depth long, g long, s long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.string() if n in ("ids", "ends_sha256") else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the sums over their subtrees."""
    leaf = (F.col("n_children") == 0).cast("long")
    nodes = nodes.withColumn("leaves", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    top = F.min(F.struct("depth", "parent_conv_id"))
    paths = nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), top.alias("top"))
    paths = checkpointed(paths.select("conv_id", F.col("top.parent_conv_id").alias("up"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved"))
    whole = _totals(paths.select("conv_id", "up", "leaves", "saved"))
    hung = whole.join(paths.filter("up is not null").select("conv_id", "up", "at"), "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    own = nodes.join(hung, ["conv_id", "depth"], "left").fillna(0, ["more_leaves", "more_saved"])
    own = own.withColumn("leaves", F.col("leaves") + F.col("more_leaves")).withColumn("saved", F.col("saved") + F.col("more_saved"))
    light = own.select("conv_id", (-F.col("depth")).alias("height"), "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", "leaves", "saved")
    done = running(light, "conv_id", ["height"], ["leaves", "saved"], [None, None])  # from a path's lower end to its top
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves_sum").alias("n_leaves"), F.col("saved_sum").alias("saved_tokens"), "ends_sha256")


def _totals(paths: DataFrame) -> DataFrame:
    """``leaves`` and ``saved`` of each path and all that hang below it, by jumps of doubled length.

    After a round a path's sums cover all that is fewer than twice as many steps below; paths whose jump would leave the
    tree are done and are not sent again.
    """
    sums, jumps = paths.select("conv_id", "leaves", "saved"), paths.filter("up is not null").select("conv_id", "up")
    while not jumps.isEmpty():
        sent = jumps.join(sums, "conv_id").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("v"))
        both = sums.join(sent, "conv_id", "left").fillna(0, ["l", "v"])
        sums = checkpointed(both.select("conv_id", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("v")).alias("saved")))
        further = jumps.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        jumps = checkpointed(jumps.join(further, "up").select("conv_id", F.col("next").alias("up")))
    return sums
