"""Toxicity scores from a learned lexicon, matched with its misspellings and weighed by context.

The lexicon is learned from a bounded sample of labelled texts: words, and beginnings of words where many words share
one, that are frequent in texts labelled toxic and rare in others. Its trie is intersected with a Levenshtein automaton:
a state is the set of trie nodes that some edits of what was read reach, transitions are made when first needed, and
most words leave the automaton after a few letters. Word forms known from clean texts are no misspellings. Each hit is
weighed in its context window: by other hits near it, and by whether it stands in quotation marks. A logistic regression
on the weighed counts, fitted to the same sample, gives the score.

Defined results: null and empty texts have no hits and get the score of a text without any. Without labelled texts of
both classes every score is the share of toxic ones (0 without labels). Repeated rows get equal scores; the fit takes one text
of each labelled id. Texts of any length are read whole, word by word. An empty table
gives no rows. Only the text enters a score.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, hash_sample
from tidemark.llm.text import batches, kept_in_worker, tidy

#: Most labelled texts that the model is fitted to, by the order of a hash of the id.
SAMPLE = 20_000
#: Most terms of the lexicon; least toxic texts that hold a term, the least share of its texts that are toxic, and the
#: chance, for texts drawn at random, below which such a share must be (times 2 of its logarithm).
TERMS, SUPPORT, PRECISION, EVIDENCE = 2_000, 5, 0.8, 28.0
#: Lengths of word beginnings that can be terms; such a term has this many times the texts of any one word.
STEMS, SPREAD = range(4, 9), 1.5
#: Words on each side of a hit that belong to its context, and the weight of a hit in quotation marks.
WINDOW, QUOTED = 6, 0.25
THRESHOLD = 0.7
#: Words that a task remembers, and terms that it counts before it hands them on.
WORDS_KEPT, TERMS_HELD = 150_000, 100_000
#: States that an automaton remembers before it starts anew.
STATES_KEPT = 150_000

_MARKS = ".,;:!?()[]{}…'’`*_~-–—"
_QUOTES = "\"“”„«»‹›"
_ANY_QUOTE, _NO_QUOTES = re.compile(f"[{_QUOTES}]"), str.maketrans("", "", _QUOTES)
FEATURES = ("exact", "misspelt", "quoted", "dense", "share")


def edits_allowed(term: str, stem: bool) -> int:
    """Edits that still make a misspelling of a term: none of short terms, one less of beginnings."""
    return max(0, (0 if len(term) < 5 else 1 if len(term) < 9 else 2) - stem)


class Automaton:
    """The Levenshtein automaton of a lexicon; ``terms`` maps each term to whether it is a beginning of words."""

    def __init__(self, terms: dict[str, bool]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        for term in sorted(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = (term, terms[term])
        self.most = max((edits_allowed(t, s) for t, s in terms.items()), default=0)
        self._forget()

    def _forget(self) -> None:
        """Start without any state; they are made again when needed, so ``STATES_KEPT`` bounds memory alone."""
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []  # the trie nodes of a state and the edits of each, as numbers of 32 bits: node, edits
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []  # what a word that ends here is
        self.begun: list[tuple[int, str] | None] = []  # what a word that goes on from here is
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, after letters left out of the word."""
        work = list(nodes)
        for node in work:
            if nodes[node] < self.most:
                for child in self.children[node].values():
                    if nodes.get(child, self.most + 1) > nodes[node] + 1:
                        nodes[child] = nodes[node] + 1
                        work.append(child)
        key = array("I", sorted(n << 2 | e for n, e in nodes.items())).tobytes()
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            hits = [(e, *self.ends[n]) for n, e in nodes.items() if self.ends[n] and e <= edits_allowed(*self.ends[n])]
            self.found.append(min(((e, t) for e, t, _ in hits), default=None))
            self.begun.append(min(((e, t) for e, t, stem in hits if stem), default=None))
        return self.numbers[key]

    def _move(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for x in array("I", self.states[state]):
            node, edits = x >> 2, x & 3
            for c, child in self.children[node].items():
                e = edits + (c != letter)
                if e <= self.most and e < after.get(child, self.most + 1):
                    after[child] = e
            if edits < self.most and edits + 1 < after.get(node, self.most + 1):
                after[node] = edits + 1
        self.moves[state][letter] = to = self._state(after) if after else -1
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """Edits and term of the nearest term, or none within the edits allowed."""
        if len(self.states) > STATES_KEPT:
            self._forget()
        state, best, moves, begun = self.start, None, self.moves, self.begun
        for letter in word:
            to = moves[state].get(letter)
            if to is None:
                to = self._move(state, letter)
            if to < 0:
                return best
            state = to
            if begun[state] is not None and (best is None or begun[state] < best):
                best = begun[state]
        end = self.found[state]
        return end if best is None or end is not None and end < best else best


def _bare(token: str) -> str:
    return token.strip(_MARKS + _QUOTES)


class Scorer:
    """Features of texts under a lexicon. ``clean``: word forms that are no misspellings."""

    def __init__(self, terms: dict[str, bool], clean: frozenset[str] = frozenset()) -> None:
        self.automaton, self.clean = Automaton(terms), clean
        self.known: dict[str, tuple[int, str] | None] = {}
        self.hitting: set[str] = set()  # known tokens that are hits

    def hit(self, token: str) -> tuple[int, str] | None:
        bare = _bare(token)
        found = self.automaton.match(bare)
        if found is not None and found[0] and bare in self.clean:
            found = None
        self.known[token] = found
        if found is not None:
            self.hitting.add(token)
        return found

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
            self.hitting.clear()
        distinct = set(tokens)
        for token in distinct.difference(self.known):
            self.hit(token)
        hits = {t: self.known[t] for t in distinct & self.hitting}
        if not hits:
            return [0.0] * len(FEATURES)
        exact = misspelt = quoted = 0.0
        at, weights, inside = [], [], False
        quoting = {t: n for t in distinct if (n := len(t) - len(t.translate(_NO_QUOTES)))} if _ANY_QUOTE.search(text) else {}
        for i, token in enumerate(tokens):
            marks = quoting.get(token, 0)
            if (h := hits.get(token)) is not None:
                weight = 1.0 / (1 + h[0])
                if inside or marks:
                    quoted += weight
                    weight *= QUOTED
                elif h[0]:
                    misspelt += weight
                else:
                    exact += weight
                at.append(i)
                weights.append(weight)
            inside ^= marks % 2 == 1
        place, weight = np.array(at), np.array(weights)
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        near = sums[np.searchsorted(place, place + WINDOW, "right")] - sums[np.searchsorted(place, place - WINDOW)]
        share = 100 * float(weight.sum()) / len(tokens)
        return [float(np.log1p(x)) for x in (exact, misspelt, quoted, near.max(), share)]


def worker_scorer(terms: dict[str, bool], clean: frozenset[str]) -> Scorer:
    """The worker's scorer of this lexicon: Python workers outlive their tasks, and what an automaton has learned in one task
    serves the next. A worker keeps one at a time."""
    name = hashlib.sha256(repr((sorted(terms.items()), sorted(clean))).encode()).hexdigest()
    return kept_in_worker("toxicity", name, lambda: Scorer(terms, clean))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _term_counts(sample: DataFrame) -> DataFrame:
    """For each word, and each beginning of words, the texts that hold it: ``term``, ``stem``, ``toxic``, ``total``."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(counts[1])
            columns = [
                [t for t, _ in terms],
                [s for _, s in terms],
                pa.array([counts[0][t] for t in terms], pa.int64()),
                pa.array([counts[1][t] for t in terms], pa.int64()),
            ]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_pydict(dict(zip(("term", "stem", "toxic", "total"), columns, strict=True)))

        for batch in batches(it, 200):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {w for t in set((text or "").lower().split()) if (w := _bare(t))}
                stems = {(w[:n], True) for w in found for n in STEMS if len(w) > n}
                held = [*((w, False) for w in found), *stems]
                counts[1].update(held)
                if toxic:
                    counts[0].update(held)
            if len(counts[1]) > TERMS_HELD:
                yield out()
        if counts[1]:
            yield out()

    made = sample.select("text", "toxic").mapInArrow(tidy(run), "term string, stem boolean, toxic long, total long")
    return made.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))


def learn_lexicon(sample: DataFrame, rate: float) -> dict[str, bool]:
    """Terms of a sample with columns ``text`` and ``toxic``: each word, or beginning of words (true).

    ``rate`` is the share of toxic texts in the sample.
    """
    share = F.col("toxic") / F.col("total")
    clean = F.when(share < 1, (F.col("total") - F.col("toxic")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    evidence = 2 * (F.col("toxic") * F.log(share / rate) + clean)
    telling = _term_counts(sample).filter((F.col("toxic") >= SUPPORT) & (share >= PRECISION) & (share > rate))
    telling = telling.filter(evidence >= EVIDENCE)
    rows = telling.orderBy(F.desc("toxic"), "term", "stem").limit(10 * TERMS).collect()
    words = {r["term"]: r["toxic"] for r in rows if not r["stem"]}
    terms: dict[str, bool] = {}
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        stem = r["term"]
        if any(stem.startswith(t) for t in terms):
            continue
        if r["toxic"] >= SPREAD * max((n for w, n in words.items() if w.startswith(stem)), default=0):
            terms[stem] = True
    stems = tuple(terms)
    terms |= {w: False for w in words if not w.startswith(stems)} if stems else dict.fromkeys(words, False)
    ranked = sorted(terms, key=lambda t: (-words.get(t, 1 << 40), t))
    return {t: terms[t] for t in ranked[:TERMS]}


def _clean_forms(sample: DataFrame, terms: dict[str, bool]) -> frozenset[str]:
    """Words of clean texts that are within the edits of a term; of more than 50 for each term those of most texts."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, near = Automaton(terms), {}
        for batch in batches(it, 200):
            forms = []
            for text in batch.column(0).to_pylist():
                if len(near) > WORDS_KEPT:
                    near.clear()
                found = set(map(_bare, set((text or "").lower().split())))
                near.update((w, (h := automaton.match(w)) is not None and h[0] > 0) for w in found if w not in near)
                forms += filter(near.__getitem__, found)
            yield pa.RecordBatch.from_pydict({"form": pa.array(forms, pa.string())})

    forms = sample.filter("toxic = 0").select("text").mapInArrow(tidy(run), "form string")
    top = forms.groupBy("form").count().orderBy(F.desc("count"), "form").limit(50 * TERMS)
    return frozenset(r["form"] for r in top.collect())


def _features(docs: DataFrame, terms: dict[str, bool], clean: frozenset[str], kept: str) -> DataFrame:
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_scorer(terms, clean)
        for batch in batches(it, 1000):
            made = pa.array([scorer.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), made], [kept, "x"])

    return docs.select(kept, "text").mapInArrow(tidy(run), f"{kept} long, x array<double>")


class Model:
    """A lexicon, the forms that are no misspellings, and the weights of the features."""

    def __init__(self, terms: dict[str, bool], clean: frozenset[str], weights: np.ndarray) -> None:
        self.terms, self.clean, self.weights = terms, clean, weights

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id`` and ``score`` of each document."""
        x = _features(docs, self.terms, self.clean, "doc_id")
        z = sum((F.col("x")[i] * float(w) for i, w in enumerate(self.weights[:-1])), F.lit(float(self.weights[-1])))
        return x.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


    def keep(self, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """The rows of ``docs`` whose score is below the threshold, as they are."""
        terms, clean, weights = self.terms, self.clean, self.weights
        place = docs.columns.index("text")

        def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = worker_scorer(terms, clean)
            for batch in batches(it, 1000):
                x = np.array([scorer.features(t) for t in batch.column(place).to_pylist()]).reshape(-1, len(FEATURES))
                score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -60, 60)))
                yield batch.filter(pa.array(score < threshold))

        return docs.mapInArrow(tidy(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents (``labels`` has ``doc_id`` and ``toxic``), of at most ``sample`` of them."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(known, "doc_id", sample)
    # One text of each id, however often it is repeated, so that the bound holds for rows, too.
    told = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("long").alias("toxic"))
    rows = checkpointed(told.select("text", "toxic"))
    n, toxic = rows.select(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        rate = toxic / n if n else 0.0
        return Model({}, frozenset(), np.array([0.0] * len(FEATURES) + [30.0 if rate == 1 else -30.0]))
    terms = learn_lexicon(rows, toxic / n)
    clean = _clean_forms(rows, terms)
    got = _features(rows, terms, clean, "toxic").toArrow()
    x = np.array(got["x"].to_pylist())
    return Model(terms, clean, fit_logistic(x, got["toxic"].to_numpy().astype(float)))
