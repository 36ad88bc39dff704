"""Findings of the third review on training-data operators."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import lm, webp


def test_states_serve_backpropagation_without_a_copy():
    net = lm.Network(lm.start_weights(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)), 0.01)
    r = np.random.default_rng(0)
    net.flat += r.normal(0, 0.1, net.flat.shape).astype(np.float32)
    x, h = r.integers(0, lm.SYMBOLS, (9, 5)), r.normal(0, 0.5, (5, lm.HIDDEN)).astype(np.float32)
    states, (before, _, _) = net._states(x, h, True)
    assert np.shares_memory(states, before)
    for t in range(len(x)):
        assert (before[t] == h).all()
        (az, ar, an), (sz, sr, sn) = np.split(net.w["inputs"][x[t]], 3, 1), np.split(h @ net.w["state"], 3, 1)
        z, reset = 1 / (1 + np.exp(-az - sz)), 1 / (1 + np.exp(-ar - sr))
        new = np.tanh(an + reset * sn)
        assert np.allclose(states[t], new + z * (h - new), atol=1e-5)
        h = states[t]


def test_code_headers_and_long_fields_are_read_back():
    r = random.Random(0)
    for n in (1, 2, 3, 30, 280):
        counts = np.array([r.choice([0, 1, 2, 50, 9000]) for _ in range(n)])
        counts[-1] = 1
        lengths = webp._lengths(counts)
        code = webp._read_code(webp._Bits(np.packbits(webp._code_header(lengths), bitorder="little").tobytes() + bytes(8)), n)
        used = np.flatnonzero(lengths).tolist()
        if len(used) == 1:
            assert (code.only if code.only is not None else code.used[0][1]) == used[0]
        else:
            assert code.used == [(int(lengths[s]), s) for s in used]
    far = random.Random(1).randbytes(700_000)
    data = far + far[:9000] + b"x" * 9000  # copies from afar have 18 bits of distance
    assert webp.decode_payload(webp.encode_payload(data), len(data))[: len(data)] == data


def _payloads():
    """Texts, a predictor's two kinds, palettes, noise, runs, rows of more than ``ROW`` samples, and empty ones, in turn."""
    r = np.random.default_rng(5)
    words = [bytes(r.integers(97, 123, r.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    out = []
    for i in range(60):
        out += [b" ".join(words[j] for j in r.integers(0, 300, r.integers(0, 900)) ** 2 // 300), out[3 * i // 2][:1500] if out else b""]
        out.append(np.cumsum(r.integers(0, 3, 64 * i)).astype(np.uint8).tobytes())
        out.append(np.cumsum(r.integers(0, 3, (i, 64)), 0).astype(np.uint8).tobytes())
        out.append(r.integers(0, (2, 3, 16, 40, 256)[i % 5], 50 * i).astype(np.uint8).tobytes())
        out += [b"ab" * (i * i), bytes([i])]
    out.insert(200, b" ".join(words[j] for j in r.integers(0, 300, 9000)))  # several segments for a reader
    return [*out[:300], b"abcdefg" * 160_000, *out[300:]]


def test_payloads_are_coded_and_read_together(monkeypatch):
    """As each alone, but with array operations that serve many at once."""
    payloads, calls = _payloads(), {"_copies": 0, "_one_channels": 0}
    alone = [webp.encode_payload(p) for p in payloads]
    for name in calls:

        def counted(*args, name=name, made=getattr(webp, name)):
            calls[name] += 1
            return made(*args)

        monkeypatch.setattr(webp, name, counted)
    files = list(webp.encode_payloads(payloads))
    assert files == alone
    assert hashlib.sha256(b"".join(files)).hexdigest() == "fac25cbe8510a2a7532f4db2f5ccbdae1ceb97d7b92e4d24999a1c159e5b7e19"  # as when coded one by one
    for got, p in zip(webp.decode_payloads(files, map(len, payloads)), payloads, strict=True):
        assert got == p + bytes(webp.payload_bytes(len(p)) - len(p))
    assert 1 < calls["_copies"] < len(payloads) / 10 and calls["_one_channels"] < len(payloads) / 10
    for i in (3, 90):
        broken = files[:i] + [files[i][:-9]] + files[i + 1 : 120]
        with pytest.raises(ValueError):
            list(webp.decode_payloads(broken, map(len, payloads[:120])))
    assert list(webp.encode_payloads([])) == list(webp.decode_payloads([], [])) == []


def test_a_stream_of_one_copy_symbol_is_refused():
    """No symbol takes bits, so a chain of offsets would never end."""
    green = np.zeros(280, np.int64)
    green[256] = 1
    one = webp._bit_array((1, 1), (0, 1), (0, 1), (0, 1))
    head = webp._bit_array((63, 14), (0, 14), (0, 4), (0, 3))  # 64 pixels; no transform, no cache, one group of codes
    stream = b"\x2f" + np.packbits(np.concatenate([head, webp._code_header(green), *[one] * 4]), bitorder="little").tobytes() + bytes(9)
    chunk = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + len(chunk).to_bytes(4, "little") + chunk)
