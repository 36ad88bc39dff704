"""Small helpers that the text operators share.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text with A-Z lower-cased: this is what
``bytes.lower().split()`` gives, so a word is a ``bytes`` object throughout.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier of the polynomial over a window of words (odd, so it is invertible modulo 2**64).
_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Rows of an Arrow batch between Spark and its Python workers; both sides hold some of them at a time.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts in batches of ``ARROW_ROWS``, unless it has a size of its own: Spark's default of 10,000
    rows takes tens of MB for each batch, several times over in each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the table ``documents``, ``doc_id`` and ``text`` by default."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def words(text: str | bytes | None) -> list[bytes]:
    """The words of a text; none for null."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_codes(found: list[bytes]) -> np.ndarray:
    """One 64-bit code for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit code for each run of ``width`` words; the whole sequence as one run if it is shorter."""
    width = min(width, len(codes))
    if not width:
        return codes
    out = np.zeros(len(codes) - width + 1, np.uint64)
    for i in range(width):
        out = out * _STEP + codes[i : i + len(out)]
    return mixed(out)


def crc_mod(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def batches(it: Iterable[pa.RecordBatch], rows: int, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and, unless a single row is longer, ``most_bytes`` of text."""
    for batch in it:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if any(f(column.type) for f in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
            to = max(at + 1, min(at + rows, fit, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to


def kept_in_worker(kind: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker, which outlives its tasks; of each kind only the last is kept.

    A module of its own holds it, as functions sent by value bring their globals anew with each task.
    """
    place = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept"))
    held = place.__dict__.get(kind)
    if held is None or held[0] != name:
        place.__dict__[kind] = held = (name, make())
    return held[1]


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``; at its end the task's freed memory goes back to the system.

    Python workers outlive their tasks, and else keep what their largest task needed beside the next stage's sorts.
    """

    @functools.wraps(run)
    def tidied(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it returns memory by its own rules
                pass

    return tidied
