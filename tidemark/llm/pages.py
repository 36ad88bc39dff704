"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks, in order: runs of text between tags that start or end a block, each with its path of
open elements (tags, and the words of their class, id and role). A block is a vector: learned vectors of its path's parts
and of its hashed words, and a few measures. A bidirectional LSTM in numpy reads the vectors of the whole page, however
long, and labels every block with what comes before and after it in view; blocks labelled as main text are joined.

The labeller is fitted in one task to at most ``SAMPLE`` pages, by the order of a hash of page_id and url, of at most
``LONGEST`` code points each. Their own blocks are labelled where an element on the path says what it holds (``hint``); the
others take no part in the fit. For each of them, some pages are laid out anew: its text in another container, between menus,
headers, notices, adverts, forms, side bars, comments and footers whose words come from other pages. There the labels are
known, and now and then the telling names are left out, so that neighbours and position have to do.

Markup: comments, declarations, and the content of ``UNSEEN`` elements are no text. An unclosed comment, tag or unseen
element reaches the end of the page. Character references are decoded as browsers do. White space is what Python's
``split`` takes for it. Pages without a block of main text, null and empty pages give an empty text; every row gives one
row, so repeated ids do too, and null ids and urls are kept. Columns of other names are dropped.
"""

from __future__ import annotations

import html
import io
import random
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hash_sample
from tidemark.llm.text import batches, small_batches, tidy

Path = tuple[tuple[str, tuple[str, ...]], ...]
Block = tuple[Path, str, float]

#: Pages that the labeller is fitted to, and the longest of them; new layouts of each; passes over them.
SAMPLE, LONGEST, LAYOUTS, PASSES = 300, 200_000, 5, 10
#: Sizes: buckets of path parts and of words, their vectors, the state of each direction.
BUCKETS, PATH_WIDTH, WORD_WIDTH, MEASURES, STATE = 4096, 16, 8, 8, 16
#: Nearest elements of a path that are looked at; deeper nesting than DEEPEST is read as flat.
NEAREST, DEEPEST = 8, 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head iframe noembed noframes object script select style svg template textarea title xmp".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())  # no tags are read inside
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag closes, if open above the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

#: Elements that a new layout may put main text into, and those of each kind of other text: tag and words of its names.
HOMES = [
    ("article", ()), ("main", ()), ("div", ("content",)), ("div", ("main", "content")), ("div", ("post",)), ("div", ("entry", "content")),
    ("section", ("story",)), ("div", ("article", "body")), ("section", ("article",)), ("div", ("text",)), ("div", ()), ("td", ()),
]
KINDS = {
    "menu": [("nav", ()), ("ul", ("menu",)), ("div", ("nav",)), ("div", ("menu",)), ("div", ("navigation",)), ("div", ("breadcrumb",)), ("div", ("pagination",)), ("div", ("navbar",))],
    "header": [("header", ()), ("div", ("header",)), ("div", ("site", "header")), ("div", ("masthead",)), ("div", ("topbar",)), ("div", ("banner",))],
    "notice": [("div", ("cookie", "notice")), ("div", ("notice",)), ("div", ("alert",)), ("div", ("consent",)), ("div", ("newsletter",)), ("div", ("popup",)), ("dialog", ()), ("noscript", ()), ("div", ("cookie", "banner"))],
    "advert": [("div", ("ad",)), ("div", ("advert",)), ("div", ("advertisement",)), ("div", ("sponsored",)), ("div", ("promo",)), ("aside", ("ad",)), ("div", ("sponsor",))],
    "form": [("form", ()), ("form", ("search",)), ("div", ("search",)), ("fieldset", ()), ("div", ("login",)), ("div", ("subscribe",)), ("button", ())],
    "sidebar": [("aside", ()), ("div", ("sidebar",)), ("div", ("widget",)), ("div", ("related",)), ("div", ("recommended",)), ("div", ("share",)), ("div", ("social",))],
    "comments": [("div", ("comment",)), ("section", ("comment",)), ("ol", ("comment", "list")), ("div", ("respond",)), ("div", ("reply",)), ("div", ("discussion",)), ("section", ("response",))],
    "footer": [("footer", ()), ("div", ("footer",)), ("div", ("site", "footer")), ("div", ("copyright",)), ("div", ("colophon",)), ("div", ("legal",))],
}
#: What a paragraph of main text may be instead.
SHAPES: list[Path] = [
    (("ul", ()), ("li", ())), (("ul", ()), ("li", ())), (("ul", ()), ("li", ())), (("ol", ()), ("li", ())), (("ol", ()), ("li", ())), (("blockquote", ()),), (("blockquote", ()), ("p", ())), (("pre", ()),), (("h2", ()),), (("h3", ()),), (("div", ()),), (("section", ()), ("p", ())),
    (("table", ()), ("tr", ()), ("td", ())), (("dl", ()), ("dd", ())), (("figure", ()), ("figcaption", ())), (),
]
_UNCLEAR = {"site", "main", "post", "text", "body", "list", "banner", "story"}
_OTHER_TAGS = {t for kind in KINDS.values() for t, _ in kind} - {"div", "section", "ul", "ol", "header"}
_OTHER_WORDS = {w for kind in KINDS.values() for _, names in kind for w in names} - _UNCLEAR
_MAIN_TAGS, _MAIN_WORDS = {"article", "main"}, {w for _, names in HOMES for w in names} - _UNCLEAR

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

def _element(tag: str, name: str) -> tuple[str, tuple[str, ...]]:
    """The element's tag and the words of its names, without a plural's s."""
    if "=" not in tag:
        return name, ()
    found = (w.lower() for m in _NAMES.finditer(tag) for w in _WORD.findall(m[1] or m[2] or m[3] or ""))
    return name, tuple(w[:-1] if len(w) > 2 and w[-1] == "s" else w for w in found)


class _Reader:
    """Reads one page's blocks."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.count: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.runs: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.runs:
            if text := " ".join("".join(self.runs).split()):
                path = tuple([e for e in self.open if e[0] not in INLINE][-NEAREST:])
                self.blocks.append((path, text, min(1.0, self.linked / len(text))))
            self.runs, self.linked = [], 0

    def push(self, element: tuple[str, tuple[str, ...]]) -> None:
        if len(self.open) < DEEPEST:
            self.open.append(element)
            self.count[element[0]] = self.count.get(element[0], 0) + 1

    def pop(self, at: int) -> None:
        for name, _ in self.open[at:]:
            self.count[name] -= 1
        del self.open[at:]

    def close(self, names: set[str], within: set[str]) -> None:
        """Closes the innermost element of ``names``, unless one of ``within`` is nearer."""
        if any(self.count.get(n) for n in names):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in names:
                    return self.pop(i)
                if self.open[i][0] in within:
                    return None

    def text(self, run: str) -> None:
        if self.count.get("head") and run.strip():
            self.close({"head"}, set())  # text ends an unclosed head
        if run and not any(self.count.get(n) for n in _UNSEEN_OPEN):
            run = html.unescape(run) if "&" in run else run
            self.runs.append(run)
            if self.count.get("a"):
                self.linked += len(run)

    def start(self, tag: str, name: str) -> None:
        if name == "br":
            self.runs.append("\n")
            return
        if name not in INLINE:
            self.flush()
            if name not in VOID:
                self.close({"p"}, {"button", "table", "td", "th"})
        if name in VOID or name in ("html", "body"):
            if name == "body":
                self.close({"head"}, set())
            return
        if name in CLOSES:
            self.close(*CLOSES[name])
        if name not in UNSEEN:
            self.close({"head"}, set())  # an unclosed head ends where the page's body begins
        self.push(_element(tag, name))

    def end(self, name: str) -> None:
        if name not in INLINE and (self.count.get(name) or name == "p"):
            self.flush()
        if self.count.get(name):
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == name)
            if name in INLINE and any(n not in INLINE for n, _ in self.open[at + 1 :]):
                self.count[name] -= 1
                del self.open[at]  # blocks that were opened within stay open
            else:
                self.pop(at)


_UNSEEN_OPEN = tuple(UNSEEN - RAW)
_HEAD_ONLY = frozenset("base link meta title script style noscript template head".split())


def blocks(page: str | None) -> list[Block]:
    """Path, text and share of linked characters of each of a page's blocks, in order."""
    reader, at, page = _Reader(), 0, page or ""
    while True:
        token = _TOKEN.search(page, at)
        reader.text(page[at : token.start() if token else len(page)])
        if token is None:
            break
        at, tag = token.end(), token[0]
        name = _NAME.match(tag)
        if name is None:
            continue
        name = name[1].lower()
        if tag[1] == "/":
            reader.end(name)
        elif name in RAW:
            if name not in ("title", "script", "style"):
                reader.flush()
            end = _RAW_END[name].search(page, at)
            at = _TOKEN.match(page, end.start()).end() if end else len(page)
        elif reader.count.get("head") and name in _HEAD_ONLY:
            continue
        else:
            reader.start(tag, name)
            if tag.endswith("/>") and name == "svg":
                reader.end(name)
    reader.flush()
    return reader.blocks


def hint(path: Path) -> int | None:
    """1 if the nearest telling element of a path holds main text, 0 if it holds something else, None if none tells."""
    for i in range(len(path) - 1, -1, -1):
        tag, names = path[i]
        if tag in _OTHER_TAGS or not _OTHER_WORDS.isdisjoint(names):
            return 0
        if tag == "header":
            return None if any(t in _MAIN_TAGS for t, _ in path[:i]) else 0
        if tag in _MAIN_TAGS or not _MAIN_WORDS.isdisjoint(names):
            return 1
    return None


def _buckets(texts: Sequence[bytes]) -> np.ndarray:
    """A bucket for each word of texts whose words are parted by single spaces."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    with np.errstate(over="ignore"):
        codes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _PLACES[place & 63], starts)
        codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (codes >> np.uint64(52)).astype(np.int64)  # 12 bits: BUCKETS


_PLACES = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def _parts(path: Path) -> list[str]:
    """The parts of a path: its last element, all tags, all words of names."""
    out = [f"last={path[-1][0]}" if path else "last="]
    for tag, names in path:
        out.append(f"tag={tag}")
        out += [f"name={w}" for w in names]
    return out


class Features:
    """Blocks of several pages as flat arrays: path buckets and word buckets with where each block's begin, measures."""

    def __init__(self, pages: Sequence[list[Block]]) -> None:
        flat = [b for page in pages for b in page]
        self.sizes = np.array([len(p) for p in pages], np.int64)
        parts = [_parts(path) for path, *_ in flat]
        self.path = _buckets([p.encode() for block in parts for p in block]) if flat else np.zeros(0, np.int64)
        self.path_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        texts = [text.encode("utf-8", "replace") for _, text, _ in flat]
        n_words = np.array([t.count(b" ") + 1 for t in texts], np.int64)
        self.word = _buckets(texts) if flat else np.zeros(0, np.int64)
        self.word_at = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        self.measures = np.zeros((len(flat), MEASURES))
        if flat:
            within = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
            of = np.repeat(self.sizes, self.sizes)
            ends = np.array([t[-1:] in (b".", b"!", b"?", b":") for t in texts])
            marks = np.array([t.count(b".") + t.count(b",") for t in texts])
            columns = [np.log1p(n_words) / 5, [b[2] for b in flat], within / of, (of - within) / of, np.log1p(of) / 5, ends, marks / n_words, n_words == 1]
            self.measures = np.stack([np.asarray(c, np.float64) for c in columns], 1)


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows that begin at each of ``at``; none is empty."""
    return np.add.reduceat(rows, at[:-1], axis=0) if len(at) > 1 else np.zeros((0, rows.shape[1]))


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """The model: ``weights`` by name."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        width = PATH_WIDTH + WORD_WIDTH + MEASURES
        some = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        # Parts that no page of the sample shows stay near zero and say nothing.
        self.weights = weights or {"path": r.normal(0, 0.02, (BUCKETS, PATH_WIDTH)), "word": r.normal(0, 0.02, (BUCKETS, WORD_WIDTH)), "out": some(2 * STATE + width, 1)[:, 0], "bias": np.zeros(1)} | {
            k: v for d in ("on", "back") for k, v in ((f"x_{d}", some(width, 4 * STATE)), (f"h_{d}", some(STATE, 4 * STATE)), (f"b_{d}", np.repeat([0.0, 1.0, 0.0, 0.0], STATE)))
        }

    def vectors(self, f: Features) -> np.ndarray:
        path = _sums(self.weights["path"][f.path], f.path_at)
        word = _sums(self.weights["word"][f.word], f.word_at) / np.maximum(np.diff(f.word_at), 1)[:, None]
        return np.concatenate([path, word, f.measures], 1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States along the first axis of ``x`` (steps, pages, width); beyond a page's end its state stays zero."""
        w, kept = self.weights, []
        inputs = x @ w[f"x_{d}"] + w[f"b_{d}"]
        h = c = np.zeros((x.shape[1], STATE))
        out = np.zeros((*x.shape[:2], STATE))
        steps = range(len(x)) if d == "on" else range(len(x) - 1, -1, -1)
        for t in steps:
            z = inputs[t] + h @ w[f"h_{d}"]
            i, g, o = _squash(z[:, :STATE]), np.tanh(z[:, 2 * STATE : 3 * STATE]), _squash(z[:, 3 * STATE :])
            f = _squash(z[:, STATE : 2 * STATE])
            before, was = c, h
            c = (f * c + i * g) * mask[t][:, None]
            s = np.tanh(c)
            h = o * s
            out[t] = h
            kept.append((t, i, f, g, o, s, before, was))
        return out, kept

    def _padded(self, f: Features, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        page = np.repeat(np.arange(len(f.sizes)), f.sizes)
        step = np.arange(len(page)) - np.repeat(np.cumsum(f.sizes) - f.sizes, f.sizes)
        x = np.zeros((int(f.sizes.max(initial=0)), len(f.sizes), v.shape[1]))
        mask = np.zeros(x.shape[:2])
        x[step, page], mask[step, page] = v, 1
        return x, mask, step, page

    def scores(self, f: Features) -> np.ndarray:
        """The log odds of main text, for each block."""
        v = self.vectors(f)
        x, mask, step, page = self._padded(f, v)
        states = [self._run(x, mask, d)[0][step, page] for d in ("on", "back")]
        return np.concatenate([*states, v], 1) @ self.weights["out"] + self.weights["bias"]

    def gradients(self, f: Features, labels: np.ndarray, weight: np.ndarray, heard: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted mean loss and its gradients by all weights; ``heard`` is 0 for blocks whose words are left out."""
        w, spoken = self.weights, slice(PATH_WIDTH, PATH_WIDTH + WORD_WIDTH)
        v = self.vectors(f)
        v[:, spoken] *= np.reshape(heard, (-1, 1))
        x, mask, step, page = self._padded(f, v)
        runs = {d: self._run(x, mask, d) for d in ("on", "back")}
        top = np.concatenate([*(runs[d][0][step, page] for d in ("on", "back")), v], 1)
        z = top @ w["out"] + w["bias"]
        total = max(weight.sum(), 1e-9)
        loss = float((weight * (np.logaddexp(0, z) - labels * z)).sum() / total)
        dz = weight * (_squash(z) - labels) / total
        grads = {"out": top.T @ dz, "bias": np.array([dz.sum()])}
        dtop = dz[:, None] * w["out"]
        dv = dtop[:, 2 * STATE :].copy()
        for n, d in enumerate(("on", "back")):
            dout = np.zeros((*x.shape[:2], STATE))
            dout[step, page] = dtop[:, n * STATE : (n + 1) * STATE]
            dinputs = np.zeros((*x.shape[:2], 4 * STATE))
            dh = dc = np.zeros((x.shape[1], STATE))
            gh = np.zeros_like(w[f"h_{d}"])
            for t, i, fg, g, o, s, before, was in reversed(runs[d][1]):
                dh = dh + dout[t]
                dc = (dc + dh * o * (1 - s * s)) * mask[t][:, None]
                a = np.concatenate([dc * g * i * (1 - i), dc * before * fg * (1 - fg), dc * i * (1 - g * g), dh * s * o * (1 - o)], 1)
                dinputs[t] = a
                gh += was.T @ a
                dh, dc = a @ w[f"h_{d}"].T, dc * fg
            flat = dinputs.reshape(-1, 4 * STATE)
            grads |= {f"x_{d}": x.reshape(-1, x.shape[2]).T @ flat, f"h_{d}": gh, f"b_{d}": flat.sum(0)}
            dv += (dinputs[step, page]) @ w[f"x_{d}"].T
        n_path, n_word = np.diff(f.path_at), np.diff(f.word_at)
        grads["path"], grads["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
        np.add.at(grads["path"], f.path, np.repeat(dv[:, :PATH_WIDTH], n_path, axis=0))
        per_word = dv[:, spoken] * np.reshape(heard, (-1, 1)) / np.maximum(n_word, 1)[:, None]
        np.add.at(grads["word"], f.word, np.repeat(per_word, n_word, axis=0))
        return loss, grads

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Labeller:
        with np.load(io.BytesIO(data)) as kept:
            return cls({k: kept[k] for k in kept.files})


def layout(main: list[tuple[str, str]], words: Sequence[str], r: random.Random) -> tuple[list[Block], list[int]]:
    """A page of another layout around main text, given as (tag, text) pairs: blocks and labels."""
    outer: Path = ((r.choice(["div", "section", "table"]), r.choice([(), ("wrapper",), ("container",), ("page",)])),) if r.random() < 0.4 else ()
    home: Path = (*outer, r.choice(HOMES))
    out: list[tuple[Block, int]] = []

    def said(least: int, most: int) -> str:
        at, n = r.randrange(len(words)), r.randint(least, most)
        return " ".join(words[at : at + n]) or words[at]

    def other(kind: str, base: Path) -> None:
        where = r.choice(KINDS[kind]) if r.random() < 0.9 else ("div", ())
        path: Path = (*base, where)
        if r.random() < 0.15:
            path = (*path, ("div", r.choice([("content",), ("text",), ("body",), ("inner",)])))
        if kind in ("menu", "sidebar") and r.random() < 0.7:
            inner: Path = (*path, *(() if where[0] == "ul" else (("ul", ()),)), ("li", ()))
            out.extend(((inner, said(1, 4), 1.0), 0) for _ in range(r.randint(2, 8)))
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                tag = r.choice([(("p", ()),), (("li", ()),), (("div", ("comment",)), ("p", ())), ()])
                if r.random() < 0.2:
                    tag = ((r.choice(["h2", "h3", "h4", "span"]), ()),)
                out.append((((*path, *tag), said(1, 60), 0.0), 0))
        else:
            tag = r.choice([(("p", ()),), (("label", ()),) if kind == "form" else (), ((r.choice(["h2", "h3", "h4", "div"]), ()),), (("ul", ()), ("li", ())), (), ()])
            out.extend((((*path, *tag), said(2, 30), float(r.random() < 0.2)), 0) for _ in range(r.randint(1, 2)))

    for kind, chance in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("advert", 0.4), ("sidebar", 0.2), ("form", 0.2)):
        if r.random() < chance:
            other(kind, outer)
    shape: Path | None = None
    for n, (tag, text) in enumerate(main):
        lead: Path = (("header", ()),) if n == 0 and tag == "h1" and r.random() < 0.2 else ()
        if shape is None or r.random() < 0.4:  # lists and the like go on for some blocks
            shape = r.choice(SHAPES) if r.random() < 0.2 else None
        text = " ".join(text.split()[: r.choice([1, 1, 2, 4, 12])]) if r.random() < (0.5 if shape else 0.12) else text
        out.append((((*home, *lead, *(shape if shape and tag == "p" else ((tag, ()),))), text, float(r.random() < 0.03)), 1))
        if r.random() < 0.06:
            other(r.choice(["advert", "notice", "sidebar", "form", "menu"]), home)
    for kind, chance in (("sidebar", 0.3), ("comments", 0.5), ("form", 0.3), ("advert", 0.3), ("menu", 0.2), ("footer", 0.8)):
        if r.random() < chance:
            other(kind, home if r.random() < 0.25 else outer)
    return [b for b, _ in out], [label for _, label in out]


def train(sample: Sequence[str], layouts: int = LAYOUTS, passes: int = PASSES, seed: int = 7) -> Labeller:
    """A labeller fitted to pages and new layouts of them."""
    r, model = random.Random(seed), Labeller(seed=seed)
    read = [b for page in sample if (b := blocks(page))]
    if not read:
        return model
    words = [w for page in read for _, text, _ in page for w in text.split()[:200]]
    cases: list[tuple[list[Block], np.ndarray, np.ndarray]] = []
    for page in read:
        told = [hint(path) for path, *_ in page]
        known = np.array([t is not None for t in told], float)
        if known.any():
            cases.append((page, np.array([t or 0 for t in told], float), 4 * known))  # what there is counts for more
        longest = max(len(text) for _, text, _ in page)
        main = [(path[-1][0] if path and path[-1][0] in ("p", "h1", "h2", "h3", "li") else "p", text) for (path, text, _), t in zip(page, told) if t or (1 not in told and 2 * len(text) > longest)]
        for _ in range(layouts if main else 0):
            start = r.randrange(len(main)) if r.random() < 0.2 else 0
            if r.random() < 0.1:  # a few words, again and again
                main = [("p", " ".join(main[start][1].split()[: r.randint(1, 4)]))] * r.randint(1, 30)
                start = 0
            made, labels = layout(main[start : start + r.choice([1, 2, 4, 40, 40, 40])], words, r)
            cases.append((made, np.array(labels, float), np.ones(len(labels))))
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    n, rounds = 0, passes * (-(-len(cases) // 32))
    for _ in range(passes):
        r.shuffle(cases)
        near = sorted(cases, key=lambda c: len(c[0]))  # pages of like length together, in another mixture each time
        groups = [near[i : i + 32] for i in range(0, len(near), 32)]
        r.shuffle(groups)
        for group in groups:
            labels, weight = (np.concatenate([c[i] for c in group]) for i in (1, 2))
            heard = np.array([r.random() < 0.5 for _ in labels], float)  # paths and places have to do without words too
            _, grads = model.gradients(Features([c[0] for c in group]), labels, weight, heard)
            n += 1
            rate = 0.012 * (1 - 0.95 * n / rounds)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] -= rate * first[k] / (1 - 0.9**n) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
    return model


def fit(pages: DataFrame) -> bytes:
    """The weights of a labeller fitted to a bounded sample of ``pages``, in one task."""
    small_batches(pages.sparkSession)
    keyed = pages.select(F.xxhash64("page_id", "url").alias("key"), "html")
    chosen = hash_sample(keyed.select("key").distinct(), "key", SAMPLE)
    short = keyed.filter(F.length("html").between(1, LONGEST)).join(F.broadcast(chosen), "key")
    sample = short.groupBy("key").agg(F.min("html").alias("html")).repartition(1).sortWithinPartitions("key")

    def fitted(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [h for batch in it for h in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train(found).packed()], pa.binary())], ["model"])

    found = sample.mapInArrow(tidy(fitted), "model binary").first()
    return found["model"] if found else Labeller().packed()


def extract(pages: DataFrame, model: bytes | None = None) -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and its length ``n_chars`` of every page."""
    small_batches(pages.sparkSession)
    model = fit(pages) if model is None else model

    def extracted(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.unpacked(model)
        for batch in batches(it, 256):
            read = [blocks(page) for page in batch["html"].to_pylist()]
            out = [""] * len(read)
            order, at = sorted(range(len(read)), key=lambda i: len(read[i])), 0
            while at < len(order):  # pages of like length, so that few steps are beyond a page's end
                to = at + 1
                while to < len(order) and (to - at + 1) * len(read[order[to]]) <= 8192:
                    to += 1
                some = order[at:to]
                if read[some[-1]]:
                    main = iter(labeller.scores(Features([read[i] for i in some])) > 0)
                    for i in some:
                        out[i] = " ".join(text for _, text, _ in read[i] if next(main))
                at = to
            sizes = pa.array([len(t) for t in out], pa.int64())
            text = pa.array([t.encode("utf-8", "replace").decode() for t in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], text, sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(tidy(extracted), "page_id long, url string, text string, n_chars long")
