"""Tokenizers, packing and stored media: exact round trips and the libraries' own results."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, webp

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = ["'", "re", "'re", "'ll", " ", "  ", "\n", "a", "B", "1", "²", "é", "ß", "́", "日", "\x1c", " ", "<|", "|>", ".", "…"]


@pytest.mark.parametrize("bits", [2, 5, 9])
def test_chunks_join_to_the_librarys_ids(monkeypatch, bits):
    monkeypatch.setattr(bpe, "MIN_CHUNK", 4)
    monkeypatch.setattr(bpe, "MAX_CHUNK", 60)
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    r = random.Random(bits)
    texts = ["", "a", "they're  \n\n x  ", "<|endoftext|>", "a <|endoftext|>  b", " " * 500, "a" * 300, "日本語 " * 50]
    texts += ["".join(r.choice(PIECES) for _ in range(r.randrange(300))) for _ in range(150)]
    model, library = bpe.ChunkedBPE(BYTE), Tokenizer.from_file(BYTE)
    for text, ids in zip(texts, model.encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted, text
        assert model.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_repeated_passages_are_encoded_once():
    model = bpe.ChunkedBPE(BYTE)
    r = random.Random(1)
    passage = " ".join(str(r.random()) for _ in range(500))
    model.encode([f"{r.random()} {passage} {r.random()}" for _ in range(4)])
    assert model.n_reused > 0.5 * model.n_chunks


def test_bpe_of_a_table(docs, empty, corpus):
    library = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, BYTE).collect()}
    assert len(got) == len(corpus)
    for doc_id, text, *_ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, BYTE).count() == 0


def test_packing(docs, empty, corpus):
    library, rows = Tokenizer.from_file(WORD), packing.pack(docs, WORD).collect()
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    padded = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len({r["context"] for r in s}) == 1
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 3 * 2048  # at most one open sequence a task
    assert len(documents) == len(corpus)
    for doc_id, text, *_ in corpus:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(documents[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 11])
def test_step_groups_are_balanced(n):
    """Groups of four sequences; of the last two none has two sequences more than the other."""
    packer = packing.Packer(0, step_tokens=4 * 2048)
    for i in range(n):
        packer.add(i, np.ones(2048, np.uint32))
    packer.pack(last=True)
    sizes = defaultdict(set)
    for row in packer.rows:
        sizes[row[-1]].add(row[5])
    counts = [len(sizes[g]) for g in sorted(sizes)]
    assert sum(counts) == n == len({row[5] for row in packer.rows})
    assert all(c == 4 for c in counts[:-2]) and max(counts[-2:]) - min(counts[-2:]) <= 1


def test_tiers_fill_their_windows():
    packer, r = packing.Packer(0), random.Random(2)
    for i in range(500):
        packer.add(i, np.arange(r.choice([1, 50, 300, 700, 1500, 5000]), dtype=np.uint32))
        if i % 100 == 99:
            packer.pack()
    packer.pack(last=True)
    lengths = defaultdict(int)
    for row in packer.rows:
        lengths[row[5]] += row[2]
    assert sum(n not in packing.CONTEXTS for n in lengths.values()) <= 1
    tokens = defaultdict(int)
    for row in packer.rows:
        tokens[row[8]] += row[2]
    assert max(tokens.values()) <= packing.STEP_TOKENS


def test_media_of_a_table(docs, empty, corpus):
    got = {r["doc_id"]: r for r in webp.features(webp.store(docs)).collect()}
    for doc_id, text, *_ in corpus:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    same = [tuple(got[d])[1:] for d, t, *_ in corpus if t == "one"]
    assert same[0] == same[1]
    assert webp.features(webp.store(empty)).count() == 0


def test_payloads_of_all_palette_sizes_come_back():
    r = np.random.default_rng(0)
    for colours in (1, 2, 3, 4, 5, 16, 17, 64, 65, 200, 256):
        for size in (0, 1, 63, 64, 65, 3000):
            data = r.integers(0, colours, size, dtype=np.uint16).astype(np.uint8).tobytes()
            back = webp.decode_payload(webp.encode_payload(data), len(data))
            assert back[: len(data)] == data and not any(back[len(data) :])
    long = b"abc" * 800_000  # rows of more than ROW samples
    media = webp.encode_payload(long)
    assert webp.decode_payload(media, len(long))[: len(long)] == long
    assert len(media) == 8 + int.from_bytes(media[4:8], "little")  # one file


def _plain(media):
    """What a reader symbol by symbol makes of it."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(webp, "_one_channel", lambda *_: None)
        m.setattr(webp, "_at_stride", lambda *_: None)
        return webp.decode(media)


def test_chosen_forms_read_alike_both_ways():
    """Copies (near, far, overlapping), predictors, palettes: by array operations and symbol by symbol."""
    r = np.random.default_rng(3)
    words = [bytes(r.integers(97, 123, r.integers(2, 9), dtype=np.uint8)) for _ in range(200)]
    text = b" ".join(words[i] for i in r.integers(0, 200, 6000))
    ramp = np.cumsum(r.integers(0, 3, 9000)).astype(np.uint8).tobytes()
    top = np.cumsum(r.integers(0, 3, (300, 64)), 0).astype(np.uint8).tobytes()
    few = r.integers(0, 3, 5000).astype(np.uint8).tobytes()
    noise = r.integers(0, 256, 5000).astype(np.uint8).tobytes()
    skew = np.minimum(r.geometric(0.02, 20_000), 255).astype(np.uint8).tobytes()
    sizes, kinds = {}, {}
    for name, data in dict(text=text, ramp=ramp, top=top, few=few, noise=noise, skew=skew, run=b"a" * 70_000, cycle=b"abcdefg" * 3000, none=b"", one=b"x").items():
        media = webp.encode_payload(data)
        whole = webp.decode(media)
        assert (whole == _plain(media)).all(), name
        assert webp.decode_payload(media, len(data))[: len(data)] == data, name
        sizes[name], kinds[name] = len(media) / max(1, len(data)), media[25] & 7  # the first transform
    assert sizes["text"] < 0.45 and sizes["cycle"] < 0.02 and sizes["run"] < 0.01 and sizes["few"] < 0.3
    assert {kinds["ramp"], kinds["top"]} == {1} and kinds["few"] == 7  # a predictor; a palette


def test_code_lengths_come_back():
    r = np.random.default_rng(4)
    for size in (280, 40):
        for some in (1, 2, 3, 5, 30, size):
            counts = np.zeros(size, np.int64)
            counts[r.choice(size, some, replace=False)] = 1 + r.integers(0, 5, some) ** r.integers(1, 12)
            lengths = webp._lengths(counts)
            bits = webp._Bits(np.packbits(np.array(webp._code_header(lengths), np.uint8), bitorder="little").tobytes() + b"\0\0")
            code = webp._read_code(bits, size)
            used = np.flatnonzero(lengths)
            if some == 1:
                assert code.only == used[0]
            else:
                assert sorted(code.used) == sorted(zip(lengths[used].tolist(), used.tolist(), strict=True))


class Writer:
    """Writes a lossless stream with codes of unequal lengths; the transforms' forward steps are computed pixel by pixel."""

    def __init__(self, width, height):
        self.bits = []
        self.put((width - 1, 14), (height - 1, 14), (1, 1), (0, 3))

    def put(self, *fields):
        for value, n in fields:
            self.bits += [value >> i & 1 for i in range(n)]

    def code(self, size, used):
        """A prefix code of the symbols in use: each takes half of what is left, so lengths differ."""
        used = sorted(used) or [0]
        if len(used) == 1 and used[0] < 256:
            self.put((1, 1), (0, 1), (1, 1), (used[0], 8))
            return {used[0]: (0, 0)}
        extra = next(s for s in range(size) if s not in used) if len(used) == 1 else None
        used = sorted([*used, *([] if extra is None else [extra])])
        short = min(6, len(used) - 1)
        rest = len(used) - short
        deep = short + max(0, (rest - 1).bit_length())
        spare = (1 << deep - short) - rest  # the shortest codes of the rest
        lengths = {s: i + 1 for i, s in enumerate(used[:short])} | {s: deep - (i < spare) for i, s in enumerate(used[short:])}
        self.put((0, 1), (15, 4), *((4, 3) if s < 16 else (0, 3) for s in webp._LENGTH_ORDER))
        self.put((0, 1))
        for s in range(size):
            self.put((int(format(lengths.get(s, 0), "04b")[::-1], 2), 4))
        codes, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in lengths.items()):
            code <<= n - last
            last = n
            codes[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
            code += 1
        return codes

    def image(self, argb, main, cache=0, copies=()):
        """An image of literals, colour-cache hits and the given back-references (place: length, distance)."""
        flat, width, items, seen, at = argb.ravel().tolist(), argb.shape[1], [], {}, 0
        copies = dict(copies)
        while at < len(flat):
            if at in copies:
                length, distance = copies[at]
                assert flat[at : at + length] == [flat[at - distance + i] for i in range(length)] or distance < length
                items.append(("copy", *copies[at]))
                span = length
            else:
                key = (0x1E35A7BD * flat[at] & 0xFFFFFFFF) >> 32 - cache if cache else None
                items.append(("cache", key) if cache and seen.get(key) == flat[at] else ("pixel", flat[at]))
                span = 1
            for p in flat[at : at + span]:
                if cache:
                    seen[(0x1E35A7BD * p & 0xFFFFFFFF) >> 32 - cache] = p
            at += span

        def prefix(v):
            if v <= 4:
                return v - 1, 0, 0
            n = (v - 1).bit_length() - 2
            return 2 * (n + 1) + (v - 1 >> n & 1), n, v - 1 & (1 << n) - 1

        near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(webp.NEAR)))}
        used, stream = [set() for _ in range(5)], []
        for kind, *v in items:
            if kind == "pixel":
                parts = [(0, v[0] >> 8 & 255), (1, v[0] >> 16 & 255), (2, v[0] & 255), (3, v[0] >> 24)]
            elif kind == "cache":
                parts = [(0, 280 + v[0])]
            else:
                s, n, x = prefix(v[0])
                d, m, y = prefix(near.get(v[1], v[1] + 120))
                parts = [(0, 256 + s), (None, (x, n)), (4, d), (None, (y, m))]
            for which, s in parts:
                if which is not None:
                    used[which].add(s)
            stream.append(parts)
        self.put(*(((1, 1), (cache, 4)) if cache else ((0, 1),)))
        if main:
            self.put((0, 1))
        sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
        codes = [self.code(n, u) for n, u in zip(sizes, used, strict=True)]
        for parts in stream:
            for which, s in parts:
                self.put(s if which is None else codes[which][s])

    def data(self):
        stream = b"\x2f" + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        stream += b"\0" * (len(stream) % 2)
        return b"RIFF" + (len(stream) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream


def pixels(height, width, seed, most=256):
    return np.random.default_rng(seed).integers(0, most, (height, width, 4)).astype(np.int64)


def joined(c):
    return ((c[..., 0] << 24) | (c[..., 1] << 16) | (c[..., 2] << 8) | c[..., 3]).astype(np.uint32)


def prediction(mode, l, t, tl, tr):
    """One channel, as the format defines it; modes 11 to 13 need more and are handled below."""
    avg = lambda a, b: (a + b) // 2
    return {
        0: None, 1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr),
        10: avg(avg(l, tl), avg(t, tr)), 12: min(255, max(0, l + t - tl)),
        13: min(255, max(0, avg(l, t) + int((avg(l, t) - tl) / 2))),
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    c = pixels(6, 7, mode)
    residual = np.zeros_like(c)
    for y in range(6):
        for x in range(7):
            l, t = c[y, x - 1] if x else None, c[y - 1, x] if y else None
            if y == 0:
                p = [255, 0, 0, 0] if x == 0 else l
            elif x == 0:
                p = t
            else:
                tl, tr = c[y - 1, x - 1], c[y - 1, x + 1] if x < 6 else c[y, 0]
                if mode == 0:
                    p = [255, 0, 0, 0]
                elif mode == 11:
                    full = l + t - tl
                    p = l if np.abs(full - l).sum() < np.abs(full - t).sum() else t
                else:
                    p = [prediction(mode, *map(int, v)) for v in zip(l, t, tl, tr, strict=True)]
            residual[y, x] = (c[y, x] - p) % 256
    w = Writer(7, 6)
    w.put((1, 1), (0, 2), (0, 3))  # blocks of 4
    w.image(joined(np.full((2, 2, 4), [255, 0, mode, 0])), False)
    w.put((0, 1))
    w.image(joined(residual), True)
    assert (webp.decode(w.data()) == joined(c)).all()


def test_cross_colour_and_subtract_green():
    c, k = pixels(5, 9, 3), pixels(2, 3, 4)
    forward = c.copy()
    s8 = lambda x: x - 256 if x > 127 else x
    for y in range(5):
        for x in range(9):
            _, r, g, b = map(int, c[y, x])
            _, red_to_blue, green_to_blue, green_to_red = map(int, k[y // 4, x // 4])
            forward[y, x, 1] = (r - (s8(green_to_red) * s8(g) >> 5)) % 256
            forward[y, x, 3] = (b - (s8(green_to_blue) * s8(g) >> 5) - (s8(red_to_blue) * s8(r) >> 5)) % 256
    green = forward.copy()
    green[..., 1] = (green[..., 1] - green[..., 2]) % 256
    green[..., 3] = (green[..., 3] - green[..., 2]) % 256
    w = Writer(9, 5)
    w.put((1, 1), (1, 2), (0, 3))
    w.image(joined(k), False)
    w.put((1, 1), (2, 2), (0, 1))
    w.image(joined(green), True)
    assert (webp.decode(w.data()) == joined(c)).all()


@pytest.mark.parametrize("colours", [2, 3, 16, 40])
def test_palettes(colours):
    palette = pixels(1, colours, colours)[0]
    place = np.random.default_rng(1).integers(0, colours, (4, 11))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, per = 8 >> packed, 1 << packed
    grid = np.zeros((4, -(-11 // per), 4), np.int64)
    for y in range(4):
        for x in range(11):
            grid[y, x // per, 2] |= int(place[y, x]) << each * (x % per)
    w = Writer(11, 4)
    w.put((1, 1), (3, 2), (colours - 1, 8))
    w.image(joined((np.diff(palette, axis=0, prepend=0) % 256)[None]), False)
    w.put((0, 1))
    w.image(joined(grid), True)
    assert (webp.decode(w.data()) == joined(palette)[place]).all()


def test_back_references_and_colour_cache():
    row = pixels(1, 10, 7)
    c = np.concatenate([row, row, row[:, ::-1], np.repeat(row[:, :1], 10, 1), row])
    flat = joined(c)
    w = Writer(10, 5)
    w.put((0, 1))
    w.image(flat, True, cache=4, copies={10: (10, 10), 31: (9, 1), 40: (10, 40)})
    assert (webp.decode(w.data()) == flat).all()


def test_broken_streams_are_refused():
    good = webp.encode_payload(b"some text to store")
    for bad in (b"", good[:19], b"RIFX" + good[4:], good[:30]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)
