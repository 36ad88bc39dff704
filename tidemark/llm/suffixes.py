"""Passages that documents share, by a sparse suffix array over words.

Suffixes are kept at minimiser positions only: of ``LEAST - GRAM + 1`` consecutive runs of ``GRAM`` words, the one of
the smallest hash. Documents that share ``LEAST`` words share such a position. Suffixes whose first run occurs in one
document only go, by one aggregate over (hash, document). The others carry the words around them, as far as a match
can reach before another kept suffix takes over, and are range-partitioned and sorted. All suffixes of a head of few are
compared with each other; common words to the right and to the left of both add up to the match. Of a head of many, or
one that partitions may share, each is compared with its nearest neighbours of smaller documents, on either side. That
order can keep two suffixes apart that match, so what a match leaves open is settled by keys: hashes of all runs of
``LEAST`` words whose minimiser the suffix is. The least document of a run always hands on its key, as no match covers it.

So a passage stays in the smallest of the documents that share it, and each other document gets a span. Words are
compared by 32-bit codes.

Defined results: null, empty and short texts have no spans. Rows without id take no part. Rows of equal id are one
document, and repeats within one document are no match. An empty table gives no rows. Of a text that repeats itself,
however long, every position may be kept; a task then holds at most ``MOST_HELD`` of its suffixes at a time and leaves the
rest to the keys, in time in proportion to the text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed
from tidemark.llm.text import batches, texts, tidy, window_codes, word_codes, words

#: Least words of a passage, and words of the runs that are hashed.
LEAST, GRAM = 50, 12
#: Words that a suffix carries to its left and right: as far as the next kept suffix of a match can be.
LEFT, RIGHT = LEAST, LEAST + GRAM

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Suffixes of a head that are all compared with each other, at most, and that a task holds of one of many.
FEW, MOST_HELD = 8, 20_000
#: Spans, and rows of keys: those of the runs that start at ``s`` and after.
_FOUND = "doc_id long, s int, e int, of_doc_id long, keys array<long>"


def minimisers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes of a text, and the hashes of their first runs."""
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = window_codes(codes, GRAM)
    width = min(LEAST - GRAM + 1, len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = np.unique(windows.argmin(1) + np.arange(len(windows)))
    return at, hashes[at]


def _owned(codes: np.ndarray) -> dict[int, tuple[int, int]]:
    """For each minimiser the first and the last of the runs of ``LEAST`` words that it stands for."""
    if len(codes) < LEAST:
        return {}
    windows = np.lib.stride_tricks.sliding_window_view(window_codes(codes, GRAM), LEAST - GRAM + 1)
    at, first, n = np.unique(windows.argmin(1) + np.arange(len(windows)), return_index=True, return_counts=True)
    return dict(zip(at.tolist(), zip(first.tolist(), (first + n - 1).tolist(), strict=True), strict=True))


def kept_suffixes(docs: DataFrame) -> DataFrame:
    """``head`` (hash of the first run), ``doc_id`` and word position ``pos`` of each kept suffix."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1000):
            found = [minimisers(word_codes(words(t))) for t in texts(batch.column(1))]
            counts = [len(at) for at, _ in found]
            heads = np.concatenate([h for _, h in found]).view(np.int64)
            ids = batch.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            places = np.concatenate([at for at, _ in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(heads), ids, pa.array(places)], ["head", "doc_id", "pos"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(run), "head long, doc_id long, pos int")


def _surroundings(docs: DataFrame) -> DataFrame:
    """For documents with the kept positions ``at``: each suffix with the words to its right and, backwards, left."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches(it, 200):
            for doc_id, text, at in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                codes = word_codes(words(text))
                short = codes.astype(">u4")
                ahead, back = short.tobytes(), short[::-1].tobytes()
                hashes = window_codes(codes, GRAM).view(np.int64)
                n, owned = len(short), _owned(codes)
                for p in {p for p in at if p < len(hashes)}:  # rows of equal id may have other texts
                    around = ahead[4 * p : 4 * (p + RIGHT)], back[4 * (n - p) : 4 * (n - p + LEFT)]
                    rows.append((hashes[p], doc_id, p, *around, *owned.get(p, (p, p - 1))))
                    if len(rows) == 5000:
                        yield out()
        if rows:
            yield out()

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
    names = ["head", "doc_id", "pos", "right", "left", "low", "high"]
    return docs.mapInArrow(tidy(run), "head long, doc_id long, pos int, right binary, left binary, low int, high int")


def _common(a: bytes, b: bytes) -> int:
    """How many words two sequences have in common at their start."""
    n = min(len(a), len(b)) & ~3
    if a[:n] == b[:n]:
        return n // 4
    differ = np.frombuffer(a, np.uint32, n // 4) != np.frombuffer(b, np.uint32, n // 4)
    return int(differ.argmax())


class _Suffix:
    __slots__ = ("doc", "high", "left", "low", "match", "pos", "right")

    def __init__(self, doc: int, pos: int, right: bytes, left: bytes, low: int, high: int) -> None:
        self.doc, self.pos, self.right, self.left, self.low, self.high = doc, pos, right, left, low, high
        self.match: tuple[int, int, int] | None = None

    def common(self, other: _Suffix) -> tuple[int, int, int] | None:
        """The span that a suffix of a smaller document has in common with this one, and that document."""
        back, ahead = _common(self.left, other.left), _common(self.right, other.right)
        return (self.pos - back, self.pos + ahead, other.doc) if back + ahead >= LEAST else None

    def compare(self, other: _Suffix) -> None:
        """Match with a suffix of a smaller document, unless there is a longer match."""
        new = self.common(other)
        if new is not None and (self.match is None or new[1] - new[0] > self.match[1] - self.match[0]):
            self.match = new

    def open(self) -> list[tuple[int, int]]:
        """First and last of the runs that the match doesn't cover."""
        if self.match is None:
            runs = [(self.low, self.high)]
        else:
            runs = [(self.low, min(self.high, self.match[0] - 1)), (max(self.low, self.match[1] - LEAST + 1), self.high)]
        return [(a, b) for a, b in runs if a <= b]


def _keys(open_: list[tuple[_Suffix, int, int]]) -> pa.RecordBatch:
    """The keys of runs of suffixes, from the first to the last given."""
    most = LEAST - GRAM  # words of a run to the left of its minimiser, at most
    wide = np.zeros((len(open_), most + LEAST), ">u4")
    for row, (s, _, _) in zip(wide, open_, strict=True):
        left, right = np.frombuffer(s.left[: 4 * most], ">u4")[::-1], np.frombuffer(s.right[: 4 * LEAST], ">u4")
        row[most - len(left) : most] = left
        row[most : most + len(right)] = right
    # All suffixes' texts one after the other; runs across two of them are not chosen.
    hashes = window_codes(wide.astype(np.uint64).ravel(), LEAST).view(np.int64)
    hashes = np.lib.stride_tricks.sliding_window_view(hashes, most + 1)[:: wide.shape[1]]
    at = np.array([(a - s.pos + most, b - s.pos + most) for s, a, b in open_])
    chosen = (np.arange(hashes.shape[1]) >= at[:, :1]) & (np.arange(hashes.shape[1]) <= at[:, 1:])
    ends = np.concatenate([[0], np.cumsum(chosen.sum(1))]).astype(np.int32)
    keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[chosen]))
    none = pa.nulls(len(open_), pa.int32())
    columns = [pa.array([s.doc for s, _, _ in open_], pa.int64()), pa.array([a for _, a, _ in open_], pa.int32()), none]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(open_), pa.int64()), keys], ["doc_id", "s", "e", "of_doc_id", "keys"])


def _neighbours(rows: DataFrame) -> DataFrame:
    """Spans of sorted suffixes that smaller documents hold, and the keys of runs that the comparisons leave open."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple] = []
        left_open: list[tuple[_Suffix, int, int]] = []
        head, group, first, many = None, [], True, False
        # Of one head, suffixes by document, documents ascending: each document is the nearest smaller one of the next.
        stack: deque[list[_Suffix]] = deque()
        held = 0

        def done(s: _Suffix) -> None:
            if s.match is not None:
                spans.append((s.doc, *s.match))
            left_open.extend((s, a, b) for a, b in s.open())

        def add(new: _Suffix) -> None:
            nonlocal held
            while stack and stack[-1][0].doc > new.doc:
                for s in (later := stack.pop()):
                    s.compare(new)
                    done(s)
                held -= len(later)
            if not stack or stack[-1][0].doc < new.doc:
                stack.append([])
            if len(stack) > 1:
                new.compare(stack[-2][-1])
            stack[-1].append(new)
            held += 1
            if held > MOST_HELD:  # the oldest go, and what is then not compared is left to the keys
                oldest = stack.popleft()
                half = len(oldest) // 2 if not stack else 0
                for s in oldest[: len(oldest) - half]:
                    done(s)
                if half:
                    stack.appendleft(oldest[len(oldest) - half :])
                held -= len(oldest) - half

        def end(edge: bool) -> None:
            """The end of a head; ``edge``: other partitions may hold more of it."""
            nonlocal held
            if edge or many:
                for s in group:
                    add(s)
                for s in chain.from_iterable(stack):
                    done(s)
                stack.clear()
                held = 0
            else:
                for s in group:
                    spans.extend((s.doc, *m) for o in group if o.doc < s.doc and (m := s.common(o)) is not None)
            group.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if spans:
                columns = [pa.array(c, t) for c, t in zip(zip(*spans, strict=True), kinds, strict=True)]
                nulls = pa.nulls(len(spans), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2], columns[3], nulls], names)
                spans.clear()
            for at in range(0, len(left_open), 2000):
                yield _keys(left_open[at : at + 2000])
            left_open.clear()

        for part in it:
            each = zip(*(part.column(c).to_pylist() for c in ("head", "doc_id", "pos", "right", "left", "low", "high")), strict=True)
            for h, *rest in each:
                if h != head:
                    if head is not None:
                        end(first)
                        first = False
                    head, many = h, False
                group.append(_Suffix(*rest))
                if many or len(group) > FEW:
                    many = True
                    for s in group:
                        add(s)
                    group.clear()
                if len(spans) + len(left_open) > MOST_HELD:
                    yield from out()
            if len(spans) + len(left_open) > 5000:
                yield from out()
        end(True)
        yield from out()

    kinds, names = (pa.int64(), pa.int32(), pa.int32(), pa.int64()), ["doc_id", "s", "e", "of_doc_id", "keys"]
    return rows.mapInArrow(tidy(run), _FOUND)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Runs of words ``[start_word, end_word)`` of ``doc_id`` that ``of_doc_id``, a smaller id, holds too.

    Overlapping runs of a document are one; ``of_doc_id`` is then the smallest of the documents they were found in.
    """
    kept = checkpointed(kept_suffixes(docs))
    shared = kept.groupBy("head").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    shared = checkpointed(shared.select("head"))  # an input of its own, so that Spark can split a frequent head's rows
    at = kept.join(shared, "head").groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    rows = _surroundings(docs.select("doc_id", "text").join(at, "doc_id"))
    order = ["head", "right", "left", "doc_id", "pos"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges by the two words after the head, not by all: their bounds are sampled to the driver. What a range's edge
    # keeps apart is left open by the comparisons and settled by keys.
    beyond = F.expr(f"substring(right, {4 * GRAM + 1}, 8)")
    ranged = rows.repartitionByRange(n, "head", beyond, "doc_id")
    found = checkpointed(_neighbours(ranged.sortWithinPartitions(*order)))
    keys = found.filter("keys is not null").select("doc_id", "s", F.posexplode("keys").alias("i", "key"))
    keys = keys.select("doc_id", (F.col("s") + F.col("i")).alias("s"), "key")
    least = keys.groupBy("key").agg(F.min("doc_id").alias("of_doc_id"), F.max("doc_id").alias("high")).filter("of_doc_id < high")
    least = checkpointed(least.select("key", "of_doc_id"))
    late = keys.join(least, "key").filter("of_doc_id < doc_id").select("doc_id", "s", (F.col("s") + LEAST).alias("e"), "of_doc_id")
    spans = found.filter("keys is null").select("doc_id", "s", "e", "of_doc_id").unionByName(late)
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int"))
    island = island.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("of_doc_id").alias("of_doc_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "of_doc_id")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, each with the white space that follows it."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, last = [], 0
    for a, b in sorted(spans):
        if a < len(starts) - 1:
            out.append(text[last : starts[a]])
            last = starts[min(b, len(starts) - 1)]
    return b"".join([*out, text[last:]])


def dedup_passages(docs: DataFrame) -> DataFrame:
    """The documents without the passages that smaller documents hold."""
    names, schema = docs.columns, docs.schema
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    # The columns travel as one, so that none of their names can clash.
    whole = docs.select(F.col("doc_id"), F.struct("*").alias("row")).join(spans, "doc_id", "left").select("row", "spans")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 500):
            row = batch.column(0)
            columns = dict(zip(names, row.flatten(), strict=True))
            text = columns["text"]
            made = [
                cut(t, [(s["start_word"], s["end_word"]) for s in f]).decode() if f else None if null else t.decode()
                for t, f, null in zip(texts(text), batch.column(1).to_pylist(), text.is_null().to_pylist(), strict=True)
            ]
            columns["text"] = pa.array(made, text.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return whole.mapInArrow(tidy(run), schema)
