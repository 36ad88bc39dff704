"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A text is cut where a rolling hash of its last characters says so, which gives equal passages of different documents
equal chunks. A worker encodes each distinct chunk once, over its tasks, as long as it remembers it. A chunk's ids hold in the whole text except near its ends, where
the pattern that splits the text into pieces may have seen too little; there the join is encoded again, from before the
chunk's last pieces on, over more and more of the next chunk, until both agree on where a piece starts.

Null and empty texts give no ids. Rows of null or repeated ids are encoded like others, each to a row of its own. Texts of any
length are encoded whole. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.text import batches, kept_in_worker, tidy

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: A chunk has at least MIN_CHUNK characters and at most MAX_CHUNK; 1 in 2**CUT_BITS places can be a cut.
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 128, 8192, 9
#: Chunks and pieces that a worker remembers, over its tasks, before it starts anew.
CHUNKS_KEPT, PIECES_KEPT = 40_000, 300_000
#: Pieces at a chunk's end that what follows may change: a contraction of three characters is seen as three.
LOOSE = 3

# The pattern of the vocabulary's pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same pattern for ASCII, and for texts without numbers beyond the digits: the standard module is twice as fast.
_ASCII_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_DIGIT_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: White space of one module but not of the other; numbers that aren't digits, of the characters that aren't rare.
_ODD, _NUMBERS = re.compile("[\x1c-\x1f]"), re.compile("[\xb2\xb3\xb9\xbc-\xbe]")
#: Characters beyond those whose classes all Unicode versions agree on.
_RARE = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞€]")


def cuts(text: str) -> list[int]:
    """Where the chunks of a text end; the last is the text's end."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    window = code[:-5].copy()
    for i in range(1, 6):
        window = window * np.uint64(0x100000001B3) + code[i : n - 5 + i]
    places = np.flatnonzero((window * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT_BITS) == 0) + 6
    out, last = [], 0
    for at in [*places.tolist(), n]:
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if at - last >= MIN_CHUNK and n - at >= MIN_CHUNK or at == n > last:
            out.append(at)
            last = at
    return out


class Chunk:
    """Ids of a text, and for each piece where it starts in the text and in the ids."""

    __slots__ = ("at", "ids", "starts")

    def __init__(self, starts: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        self.starts, self.at, self.ids = starts, at, ids


class _Numbered(dict):
    """Numbers pieces as they come; ``new`` holds those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = i = len(self)
        return i


def _with(room: np.ndarray, used: int, new: list[int] | np.ndarray) -> np.ndarray:
    """The first ``used`` numbers and the new ones after them; the room at least doubles where it doesn't suffice."""
    if used + len(new) > len(room):
        room = np.concatenate([room[:used], np.empty(used + len(new), room.dtype)])
    room[used : used + len(new)] = new
    return room


class ChunkedBPE:
    """Encodes as the library does with the file at ``path``, without special tokens, truncation or padding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {s: i for i, s in added.items()}
        names = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.split = regex.compile(f"({names})") if added else None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = _shown_bytes()
        self.bytes = [b""] * (max([*vocabulary.values(), *added]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(shown.__getitem__, token)) if i not in added else b""
        for i, token in added.items():
            self.bytes[i] = token.encode()
        self.names = list(map(str, range(len(self.bytes))))
        self.chunks: dict[str, Chunk] = {}
        self._forget()
        self.n_chunks = self.n_reused = 0

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() and not _ODD.search(text):
            return _ASCII_PIECES.findall(text)
        if not _RARE.search(text):
            return (PIECES if _NUMBERS.search(text) else _DIGIT_PIECES).findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _forget(self) -> None:
        """Start without any piece."""
        self.pieces = _Numbered()
        self.flat = np.zeros(0, np.int32)  # all pieces' ids, where each piece's begin, and its characters; with room
        self.first, self.width = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.used = self.learnt = 0

    def _learn(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        if len(new) < 16:
            ids = [self.library.encode(p, add_special_tokens=False).ids for p in new]
        else:
            ids = []
            for at in range(0, len(new), 8192):
                ids += [e.ids for e in self.library.encode_batch(new[at : at + 8192], add_special_tokens=False)]
        ends = self.used + np.cumsum([len(x) for x in ids])
        self.flat = _with(self.flat, self.used, [x for y in ids for x in y])
        self.first = _with(self.first, self.learnt + 1, ends)
        self.width = _with(self.width, self.learnt, [len(p) for p in new])
        self.used, self.learnt = int(ends[-1]), self.learnt + len(new)

    def _chunks(self, texts: Iterable[str]) -> list[Chunk]:
        found = [self._pieces(t) for t in texts]
        edges = np.cumsum([0, *map(len, found)]).tolist()
        i = np.fromiter(map(self.pieces.__getitem__, itertools.chain.from_iterable(found)), np.int64, edges[-1])
        if self.pieces.new:
            self._learn()
        first = self.first[i]
        n = self.first[i + 1] - first
        starts, at = np.zeros(len(i) + 1, np.int64), np.zeros(len(i) + 1, np.int64)
        np.cumsum(self.width[i], out=starts[1:])
        np.cumsum(n, out=at[1:])
        ids = self.flat[np.arange(at[-1]) + np.repeat(first - at[:-1], n)]
        return [Chunk(starts[a : b + 1] - starts[a], at[a : b + 1] - at[a], ids[at[a] : at[b]]) for a, b in itertools.pairwise(edges)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks.clear()
        if len(self.pieces) > PIECES_KEPT:
            self._forget()
        plain = [[t] if self.split is None else self.split.split(t) for t in texts]
        ends = [[cuts(s) if s and s not in self.special else [] for s in parts] for parts in plain]
        wanted: dict[str, None] = {}
        for parts, cut in zip(plain, ends, strict=True):
            for s, e in zip(parts, cut, strict=True):
                for a, b in zip([0, *e], e, strict=False):
                    self.n_chunks += 1
                    if (chunk := s[a:b]) in self.chunks or chunk in wanted:
                        self.n_reused += 1
                    else:
                        wanted[chunk] = None
        self.chunks.update(zip(wanted, self._chunks(wanted), strict=True))
        out = []
        for parts, cut in zip(plain, ends, strict=True):
            got: list[np.ndarray] = []
            for s, e in zip(parts, cut, strict=True):
                got += [np.array([self.special[s]], np.int32)] if s in self.special else self._joined(s, e)
            out.append(np.concatenate(got) if got else np.zeros(0, np.int32))
        return out

    def _joined(self, text: str, ends: list[int]) -> list[np.ndarray]:
        """The ids of a text from those of its chunks."""
        out: list[np.ndarray] = []
        if not ends:
            return out
        here, begin, first = self.chunks[text[: ends[0]]], 0, 0  # pieces of ``here`` from ``first`` on hold
        for a, b in zip(ends, ends[1:], strict=False):
            then = self.chunks[text[a:b]]
            keep = max(first, len(here.starts) - 1 - LOOSE)
            out.append(here.ids[here.at[first] : here.at[keep]])
            redo, n, seen = begin + int(here.starts[keep]), len(then.starts) - 1, 2 * LOOSE
            while True:
                seen = min(n, seen)
                again = self._chunks([text[redo : a + int(then.starts[seen])]])[0]
                sure = (again.starts if seen == n and b == len(text) else again.starts[: -1 - LOOSE]).tolist()
                places = {x + a - redo: i for i, x in enumerate(then.starts[: seen + 1].tolist())}
                agreed = next((i for i, x in enumerate(sure) if i and x in places), None)
                if agreed is not None:  # both start a piece here, so from here on they agree
                    out.append(again.ids[: again.at[agreed]])
                    here, begin, first = then, a, places[sure[agreed]]
                    break
                if seen == n:  # they never agree: what was encoded again stands for the chunk
                    here, begin, first = again, redo, 0
                    break
                seen *= 2
        out.append(here.ids[here.at[first] :])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    for the characters from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode each text, decode the ids, and return counts and digests, one row for each document."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept_in_worker("bpe", path, lambda: ChunkedBPE(path))
        for batch in batches(it, 500):
            encoded = model.encode([x or "" for x in batch.column(1).to_pylist()])
            columns = {
                "doc_id": batch.column(0).cast(pa.int64()),
                "n_tokens": pa.array([len(e) for e in encoded], pa.int64()),
                "ids_sha256": [_sha256(",".join(map(model.names.__getitem__, e.tolist()))) for e in encoded],
                "decoded_sha256": [_sha256(model.decode(e)) for e in encoded],
            }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
