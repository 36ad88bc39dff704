"""Hierarchical multi-length packing of tokenised documents into sequences.

Each Spark task packs the documents of its partition, so no token is shuffled. A document is cut into windows of the
longest context; its last fragment is routed to the tier whose context size is the least that holds it. Tiers are
packed from the longest: a fragment opens a window of its tier, the gap is filled with the largest fragments of
shorter tiers that fit, and what is still open with a cut from the shortest fragments left. Only the last few tokens of
a partition stay without a full window. Sequences of one context size are dealt to step groups of equal tokens.

Null and empty texts hold the end id alone. Repeated rows are packed once each. An empty table gives no rows. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.text import batches, kept_in_worker, tidy

#: Context sizes of the tiers, longest first; each a power of two.
CONTEXTS = (2048, 1024, 512, 256)
#: Tokens of a step group: as many sequences of one context size as make these up.
STEP_TOKENS = 16 * CONTEXTS[0]
#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 2_000_000
#: Distinct words that a worker remembers, over its tasks, before it starts anew.
WORDS_KEPT = 800_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context int, step_group long"
)


class _Numbered(dict):
    """Numbers words as they come; ``new`` holds those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = i = len(self)
        return i


class WordTokenizer:
    """Encodes texts with a tokenizer that lower-cases and never crosses white space, each distinct word once.

    Its tokens at the end of a run of letters must carry ``</w>``. ``WORDS_KEPT`` bounds the memory; the ids don't
    depend on it.
    """

    #: White space for ``str.split`` but not for the tokenizer's patterns.
    _ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: Two marks in a row, or a character whose lower case depends on its place or takes several characters.
    _UNEVEN = re.compile("[^\\w\\s][^\\w\\s]|[^\x00-\u012f\u0131-\u024f\u2000-\u206f]")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbered()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Encode the new words: runs of letters many at a time, told apart by the ends of words; others singly."""
        new, self.known.new = self.known.new, []
        letters = [i for i, w in enumerate(new) if w.isalpha()]
        rest = [i for i, w in enumerate(new) if not w.isalpha()]
        parts = [letters[at : at + 256] for at in range(0, len(letters), 256)]
        counts, owners, chunks = np.zeros(len(new), np.int64), [], []
        for at in range(0, len(parts), 64):
            some = parts[at : at + 64]
            joined = [" ".join([new[i] for i in part]) for part in some]
            for part, e in zip(some, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                got = np.array(e.ids, np.uint32)
                places = np.flatnonzero(self.ends[got]) + 1
                if len(places) == len(part) and places[-1] == len(got):
                    counts[part] = np.diff(places, prepend=0)
                    owners.append(part)
                    chunks.append(got)
                else:
                    rest += part
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            got = [e.ids for e in self.library.encode_batch_fast([new[i] for i in part], add_special_tokens=False)]
            counts[part] = [len(ids) for ids in got]
            owners.append(part)
            chunks.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32))
        # Ids lie as the words were encoded; they are moved to the words' order.
        order = np.concatenate(owners)
        first, ends = np.empty(len(new), np.int64), np.cumsum(counts)
        first[order] = np.cumsum(counts[order]) - counts[order]
        ids = np.concatenate(chunks)[np.arange(ends[-1]) + np.repeat(first - ends + counts, counts)]
        self.starts = np.concatenate([self.starts, len(self.flat) + ends])
        self.flat = np.concatenate([self.flat, ids])

    def _words(self, text: str) -> list[str]:
        """Words whose ids, in order, are the text's: lower-cased, marks before white space apart, where that is safe."""
        if not self._UNEVEN.search(text):
            text = text.lower()
            for mark in (". ", ", ", ".\n", ",\n"):
                text = text.replace(mark, f" {mark}")
        return text.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > WORDS_KEPT:
            self._forget()
        split = [None if any(c in t for c in self._ODD) else self._words(t) for t in texts]
        found = [None if s is None else np.fromiter(map(self.known.__getitem__, s), np.int64, len(s)) for s in split]
        if self.known.new:
            self._learn()
        out = []
        for text, i in zip(texts, found, strict=True):
            if i is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            first = self.starts[i]
            n = self.starts[i + 1] - first
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)])
        return out


class Packer:
    """Packs the fragments of one partition; a fragment is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first: int, contexts: tuple[int, ...] = CONTEXTS, step_tokens: int = STEP_TOKENS) -> None:
        self.contexts, self.step_tokens = contexts, step_tokens
        self.next_sequence = self.next_group = first
        self.held = 0
        self.fragments: list[tuple] = []
        self.rows: list[tuple] = []
        # The last two step groups of each context, as id and sequences: at the end of the task they are made even.
        self.groups: dict[int, list[tuple[int, list[list[tuple]]]]] = {c: [] for c in contexts}

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        """Cut a document: whole windows of the longest context are sequences at once, the rest waits."""
        longest = self.contexts[0]
        whole = len(ids) // longest * longest
        for at in range(0, whole, longest):
            self._emit(longest, [(doc_id, at, ids[at : at + longest], len(ids))])
        if whole < len(ids):
            self.fragments.append((doc_id, whole, ids[whole:], len(ids)))
            self.held += len(ids) - whole

    def _emit(self, context: int, pieces: list[tuple]) -> None:
        groups = self.groups[context]
        if not groups or len(groups[-1][1]) >= max(1, self.step_tokens // context):
            if len(groups) == 2:
                self._let_go(*groups.pop(0))
            groups.append((self.next_group, []))
            self.next_group += 1
        at, rows = 0, []
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            rows.append((doc_id, start, len(ids), crc, total, self.next_sequence, at, context))
            at += len(ids)
        groups[-1][1].append(rows)
        self.next_sequence += 1

    def _let_go(self, group: int, sequences: list[list[tuple]]) -> None:
        self.rows += [(*row, group) for rows in sequences for row in rows]

    def _even(self) -> None:
        """Let all groups go, the last two of a context with as many sequences each."""
        for groups in self.groups.values():
            every = [rows for _, sequences in groups for rows in sequences]
            share = -(-len(every) // max(1, len(groups)))
            for i, (group, _) in enumerate(groups):
                self._let_go(group, every[i * share : (i + 1) * share])
            groups.clear()

    def pack(self, last: bool = False) -> None:
        """Pack what waits; unless it is the last time, fragments that don't fill a window wait on."""
        pool = sorted(self.fragments, key=lambda f: len(f[2]))
        sizes = [len(f[2]) for f in pool]
        left = self.held

        def take(i: int, room: int) -> tuple:
            """The fragment at ``i``, cut to ``room``; what is cut off goes back to its tier."""
            nonlocal left
            doc_id, start, ids, total = pool.pop(i)
            sizes.pop(i)
            if len(ids) > room:
                rest = (doc_id, start + room, ids[room:], total)
                j = bisect_right(sizes, len(rest[2]))
                pool.insert(j, rest)
                sizes.insert(j, len(rest[2]))
                ids = ids[:room]
            left -= len(ids)
            return doc_id, start, ids, total

        for k, context in enumerate(self.contexts):
            shorter = self.contexts[k + 1] if k + 1 < len(self.contexts) else 0
            while pool and sizes[-1] > shorter and left >= context:
                pieces = [take(len(pool) - 1, context)]
                room = context - len(pieces[0][2])
                while room:
                    i = bisect_right(sizes, room) - 1
                    if i >= 0 and (sizes[i] * 2 >= room or i == len(sizes) - 1):
                        pieces.append(take(i, room))
                    else:  # nothing near the gap: cut the shortest fragment that covers it
                        pieces.append(take(i + 1, room))
                    room -= len(pieces[-1][2])
                self._emit(context, pieces)
        # What is left is less than one window of its largest fragment's tier.
        for context in self.contexts if last else ():
            while left >= context:
                pieces, room = [], context
                while room:
                    pieces.append(take(len(pool) - 1, room))
                    room -= len(pieces[-1][2])
                self._emit(context, pieces)
        if last and pool:
            self._emit(self.contexts[-1], [take(len(pool) - 1, self.contexts[-1]) for _ in list(pool)])
        self.fragments, self.held = pool, left
        if last:
            self._even()


def pack(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Pack the documents' ids, each document followed by ``end_id``; one row for each piece.

    ``path`` is a tokenizer file whose patterns never cross white space. ``sequence_id`` and ``step_group`` hold the
    task's number in their upper bits, so that they are unique without a shuffle; a sequence is full unless it is the
    last of its task. A step group has sequences of one context, as many as make up ``STEP_TOKENS``; of the last two of a
    task and context one has at most one sequence more than the other. Null ids and repeated rows are documents like others.
    """

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("words", path, lambda: WordTokenizer(path))
        packer = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=fields)

        for batch in batches(it, 1000):
            ids = batch.column(0).to_pylist()
            encoded = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            for doc_id, found in zip(ids, encoded, strict=True):
                packer.add(doc_id, np.append(found, np.uint32(end_id)))
            if packer.held >= BUFFER_TOKENS:
                packer.pack()
            if len(packer.rows) > 10_000:
                yield out()
        packer.pack(last=True)
        if packer.rows:
            yield out()

    fields = pa.schema(
        [pa.field(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))]
    )
    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
