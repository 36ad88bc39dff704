"""A gated recurrent language model over words, trained by truncated backpropagation in numpy on Spark tasks.

Corpus counts come first: each task counts its words, Spark adds the counts up. The most frequent words are symbols of
their own; all others share symbols by a hash of their last letters, and within such a symbol a word has the probability
of its smoothed corpus count. The output softmax is factored: a class of symbols, then a symbol within its class.

Training: a warm start on a bounded sample of documents in one task, so that all replicas start close to each other;
then each task trains a replica on its training documents, and the replicas' weights are averaged by tokens, as a Spark
aggregate. With several step sizes there is a round for each, with its share of all documents, from the average of the last. Windows of a document follow each other with the state carried on; gradients stop at their starts.

Scoring carries the state through the whole document, so its likelihood is complete. Words beyond a bounded table of
frequent ones get their counts by a join, and one sum for each row of the table, by a key made for it, adds them to its
scores.

Defined results: null and empty texts are the end token alone. Without training documents all counts are 0. Repeated
rows of an id are scored apart, each as a text of its own. Rows without id are scored like others and count as held out.
An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, hash_sample
from tidemark.llm.text import batches, kept_in_worker, texts, tidy, words

#: Symbols, symbols of a class, and symbols that stand for all other words by their last bytes.
SYMBOLS, MEMBERS, ENDINGS, LAST_BYTES = 1024, 32, 64, 3
#: Width of the state; documents that a task runs side by side.
HIDDEN, SIDE_BY_SIDE = 16, 512
#: Least and most steps of a window: as many as make up so many tokens, with the documents that are still running.
LEAST_STEPS, MOST_STEPS, WINDOW_TOKENS = 32, 256, 16_384
#: Most frequent words whose counts each task knows; the others' come by a join.
TABLE = 131_072
#: Documents of the warm start, the least number of its passes and steps, and its step size.
WARM_DOCS, WARM_PASSES, WARM_STEPS, WARM_RATE = 2_000, 2, 400, 0.01
#: Step sizes of the replicas in each round.
RATES = (0.004,)
#: The warm start takes more and smaller steps: so many times fewer documents side by side and tokens of a window.
WARM_SHARE = 4
#: Added to each count.
SMOOTHING = 0.1
#: Distinct words that a task counts, and tokens that it holds, before it hands them on.
COUNTED, HELD = 400_000, 3_000_000

#: The end of a text: no word has a blank.
END = b" "
_END_SYMBOL = ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and its number ``c`` over all texts; ``END`` once for each text."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = {"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())}
            counts.clear()
            return pa.RecordBatch.from_pydict(made)

        for batch in batches(it, 500):
            for text in texts(batch.column(0)):
                counts.update(words(text))
            counts[END] += batch.num_rows
            if len(counts) > COUNTED:
                yield out()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending(word: bytes) -> int:
    """The shared symbol of a word."""
    return zlib.crc32(word[-LAST_BYTES:]) % ENDINGS


def _ending(word: Column) -> Column:
    return (F.crc32(F.substring(word, -LAST_BYTES, LAST_BYTES)) % ENDINGS).cast("int")


class Vocabulary:
    """The frequent words, their symbols, and what the corpus counts say of the others; of bounded size."""

    def __init__(self, table: list[tuple[bytes, int]], total: int, distinct: int, masses: dict[int, float]) -> None:
        shortlist = [w for w, _ in table if w != END][: SYMBOLS - ENDINGS - 1]
        known = dict(table)
        self.total, self.distinct, self.name = total, distinct, uuid.uuid4().hex
        rest = [w for w, _ in table if w != END][len(shortlist) :]
        self.words = [END, *shortlist, *rest]
        self.counts = np.array([known.get(w, 0) for w in self.words], np.int64)
        own = 1 + len(shortlist)
        self.symbols = np.concatenate([_END_SYMBOL + np.arange(own), [ending(w) for w in rest]]).astype(np.int32)
        self.own = own
        self.divisor = np.log10(total + SMOOTHING * (distinct + 1))
        #: For each shared symbol, the logarithm of the mass of its words, one unknown included.
        mass = np.full(ENDINGS, SMOOTHING)
        for e, m in masses.items():
            mass[e] += m
        self.mass = np.log10(mass)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of corpus counts (columns ``word`` and ``c``)."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The table's least frequency, from a histogram in sixteenths of octaves: so no task sends more than its share.
    octave = F.floor(F.log2("c") * 16).cast("int")
    histogram = counts.groupBy(octave.alias("octave")).agg(F.count("*").alias("n")).orderBy(F.desc("octave")).collect()
    least, room = 1 << 30, TABLE
    for r in histogram:
        room -= r["n"]
        if room < 0:
            break
        least = r["octave"]
    frequent = counts.filter((octave >= least) | (F.col("word") == END)).toArrow()  # at most TABLE rows and one
    table = list(zip(frequent["word"].to_pylist(), frequent["c"].to_pylist(), strict=True))
    table.sort(key=lambda x: (-x[1], x[0]))
    own = [w for w, _ in table if w != END][: SYMBOLS - ENDINGS - 1]
    masses = counts.groupBy(_ending(F.col("word")).alias("e")).agg((F.sum("c") + SMOOTHING * F.count("*")).alias("m")).collect()
    mass = {r["e"]: r["m"] for r in masses}
    known = dict(table)
    for w in [END, *own]:  # words with symbols of their own are not among a shared symbol's
        if w in known:
            mass[ending(w)] -= known[w] + SMOOTHING
    return Vocabulary(table, total, distinct, {e: max(0.0, m) for e, m in mass.items()})


def worker_encoder(vocab: Vocabulary) -> Encoder:
    """The worker's encoder of a vocabulary, which its later tasks use again."""
    return kept_in_worker("symbols", vocab.name, lambda: Encoder(vocab))


class Encoder:
    """Turns texts into symbols, and keeps apart the words that the table doesn't have."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.index = {w: i for i, w in enumerate(vocab.words)}

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """A symbol for each token, the places of known words in the table (-1: none), and the other words."""
        found = words(text)
        at = np.fromiter(map(self.index.get, found, itertools.repeat(-1)), np.int32, len(found))
        others = [found[i] for i in np.flatnonzero(at < 0).tolist()]
        at = np.append(at, np.int32(0))
        symbols = self.vocab.symbols[at]
        symbols[at < 0] = [ending(w) for w in others]
        return symbols, at, others


def start_weights(shares: np.ndarray) -> dict[str, np.ndarray]:
    """Weights before training: small at random from a fixed seed, output biases from the symbols' shares."""
    r = np.random.default_rng(7)
    classes = SYMBOLS // MEMBERS
    log = np.log(shares + 1e-8).reshape(classes, MEMBERS)
    of_class = np.log(np.exp(log).sum(1))
    weights = {
        "inputs": r.normal(0, 0.1, (SYMBOLS, 3 * HIDDEN)),
        "state": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)),
        "classes": r.normal(0, 0.05, (HIDDEN, classes)),
        "class_bias": of_class,
        "members": r.normal(0, 0.05, (classes, HIDDEN, MEMBERS)),
        "member_bias": log - of_class[:, None],
    }
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in weights.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def _gates(weights: np.ndarray) -> np.ndarray:
    """The columns of each of the three gates apart."""
    return np.ascontiguousarray(weights.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))


class Network:
    """The recurrent network: runs windows of many documents side by side, and trains on them."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.0, share: int = 1) -> None:
        self.flat = _flat(weights).astype(np.float32)
        self.w = _shaped(self.flat, weights)  # views: steps on ``flat`` move them
        self.rate, self.steps = rate, 0
        self.side, self.tokens = SIDE_BY_SIDE // share, WINDOW_TOKENS // share
        self.mean, self.square = (np.zeros_like(self.flat), np.zeros_like(self.flat)) if rate else (None, None)

    def _states(self, x: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple | None]:
        """The state after each step from ``h`` on; ``keep``: also what backpropagation needs.

        Gates lie apart, each a block of its own: numpy is several times faster on whole blocks than on slices of rows.
        """
        inputs, u = _gates(self.w["inputs"]), _gates(self.w["state"])
        for weights in (inputs, u):  # the first two gates need the negative of their sums: exact, and once for all steps
            np.negative(weights[:2], out=weights[:2])
        reached = np.empty((len(x) + 1, *h.shape), np.float32)
        reached[0], states = h, reached[1:]
        g = np.take(inputs, x, axis=1, mode="clip")  # becomes the gates' values, in place
        kept = np.empty_like(states) if keep else None
        s = np.empty((3, *h.shape), np.float32)
        for t in range(len(x)):
            np.matmul(h, u, out=s)
            gates, new = g[:2, t], g[2, t]
            gates += s[:2]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            if keep:
                kept[t] = s[2]
            s[2] *= gates[1]
            new += s[2]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=states[t])
            h *= gates[0]
            h += new
        return states, (reached[:-1], g, kept) if keep else None

    def _outputs(self, h: np.ndarray, y: np.ndarray, learn: bool) -> tuple[np.ndarray, tuple | None]:
        """Natural logarithms of the probabilities of ``y`` after states ``h``; ``learn``: also gradients of their sum.

        The rows are sorted by the class of ``y``, so that a class's rows are a slice.
        """
        of, member = y // MEMBERS, y % MEMBERS
        row = np.arange(len(y))
        ones = np.ones(MEMBERS, np.float32)  # a product with it adds rows up faster than ``sum``
        e = h @ self.w["classes"]
        e += self.w["class_bias"]
        out = e[row, of]
        np.exp(e, out=e)
        sums = e @ ones
        out -= np.log(sums)
        grads = None
        if learn:
            e /= sums[:, None]
            e[row, of] -= 1
            dh = e @ self.w["classes"].T
            grads = (h.T @ e, np.ones(len(y), np.float32) @ e, np.zeros_like(self.w["members"]), np.zeros_like(self.w["member_bias"]), dh)
        bounds = np.searchsorted(of, np.arange(SYMBOLS // MEMBERS + 1)).tolist()
        for c, (a, b) in enumerate(itertools.pairwise(bounds)):
            if a == b:
                continue
            part, each, wanted = h[a:b], row[: b - a], member[a:b]
            e = part @ self.w["members"][c]
            e += self.w["member_bias"][c]
            chosen = e[each, wanted]
            np.exp(e, out=e)
            sums = e @ ones
            out[a:b] += chosen - np.log(sums)
            if learn:
                e /= sums[:, None]
                e[each, wanted] -= 1
                np.matmul(part.T, e, out=grads[2][c])
                grads[3][c] = e.sum(0)
                dh[a:b] += e @ self.w["members"][c].T
        return out, grads

    def _back(self, x: np.ndarray, kept: tuple, dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``inputs`` and ``state`` through the steps of a window."""
        n, u = HIDDEN, np.ascontiguousarray(_gates(self.w["state"]).transpose(0, 2, 1))
        before, (z, r, new), s = kept
        # Factors of the state's gradient in the gates', for all steps at once and in place, as new memory is slow.
        of_new, of_z, of_r, rest = new * new, before - new, s, 1 - z
        np.subtract(1, of_new, out=of_new)
        of_new *= rest
        of_z *= z
        of_z *= rest
        of_r *= r
        of_r *= np.subtract(1, r, out=rest)
        da = np.empty((3, *dstates.shape), np.float32)
        ds = np.empty_like(dstates)  # of the state's part of ``new``; the other gates' are those of ``da``
        dh, part = np.zeros_like(dstates[0]), np.empty_like(dstates[0])
        for t in range(len(x) - 1, -1, -1):
            dh += dstates[t]
            np.multiply(dh, of_z[t], out=da[0, t])
            np.multiply(dh, of_new[t], out=da[2, t])
            np.multiply(da[2, t], of_r[t], out=da[1, t])
            np.multiply(da[2, t], r[t], out=ds[t])
            dh *= z[t]
            for d, w in zip((da[0, t], da[1, t], ds[t]), u, strict=True):
                dh += np.matmul(d, w, out=part)
        before = before.reshape(-1, n).T
        dstate = np.concatenate([before @ d.reshape(-1, n) for d in (da[0], da[1], ds)], axis=1)
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        symbols, first = np.unique(flat[order], return_index=True)
        dinputs, ranked = np.zeros_like(self.w["inputs"]), rest.reshape(-1, n)
        for k in range(3):
            np.take(da[k].reshape(-1, n), order, axis=0, out=ranked, mode="clip")
            dinputs[symbols, k * n : (k + 1) * n] = np.add.reduceat(ranked, first, axis=0)
        return dinputs, dstate

    def _step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        norm = float(np.sqrt(gradient @ gradient))
        if norm > 1:
            gradient /= norm
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.005 * (gradient * gradient - self.square)
        scale = self.rate / (1 - 0.9**self.steps) * np.sqrt(1 - 0.995**self.steps)
        self.flat -= scale * self.mean / (np.sqrt(self.square) + 1e-6)

    def run(self, docs: list[np.ndarray]) -> np.ndarray:
        """The natural logarithm of each document's probability (symbols, the end last).

        With a rate it trains on every window, and the result is of no use.
        """
        out = np.zeros(len(docs))
        by_length = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for at in range(0, len(docs), self.side):
            group = by_length[at : at + self.side]
            lengths = np.array([len(docs[i]) for i in group])
            h = np.zeros((len(group), HIDDEN), np.float32)
            previous = np.full(len(group), _END_SYMBOL, np.int32)
            begin = 0
            while begin < lengths[0]:
                live = int(np.searchsorted(-lengths, -begin, "left"))  # documents that reach beyond ``begin``
                h, previous = h[:live], previous[:live]
                steps = int(min(MOST_STEPS, max(LEAST_STEPS, self.tokens // live), lengths[0] - begin))
                learn = bool(self.rate)
                y = np.zeros((steps, live), np.int32)
                for j, i in enumerate(group[:live]):
                    part = docs[i][begin : begin + steps]
                    y[: len(part), j] = part
                x = np.concatenate([previous[None], y[:-1]])
                there = np.arange(begin, begin + steps)[:, None] < lengths[:live]
                states, kept = self._states(x, h, learn)
                begin += steps
                # A step's prediction comes from the state after the token before it.
                rows = np.flatnonzero(there)
                of = (y.ravel()[rows] // MEMBERS).astype(np.uint16)
                rows = rows[np.argsort(of, kind="stable")]
                seen, wanted = states.reshape(-1, HIDDEN)[rows], y.ravel()[rows]
                logs, grads = self._outputs(seen, wanted, learn)
                each = np.zeros(y.size)
                each[rows] = logs
                out[group[:live]] += each.reshape(y.shape).sum(0)
                if learn:
                    dstates = np.zeros_like(states)
                    dstates.reshape(-1, HIDDEN)[rows] = grads[4]
                    dinputs, dstate = self._back(x, kept, dstates)
                    self._step(np.concatenate([g.ravel() for g in (dinputs, dstate, *grads[:4])]) / len(wanted))
                h, previous = states[-1], y[-1]
        return out


def _encoded(it: Iterable[pa.RecordBatch], encoder: Encoder, place: int) -> Iterator[list[np.ndarray]]:
    """Symbols of documents, as many at a time as a task holds."""
    held: list[np.ndarray] = []
    for batch in batches(it, 500):
        held += [encoder.encode(t)[0] for t in texts(batch.column(place))]
        if sum(map(len, held)) > HELD:
            yield held
            held = []
    if held:
        yield held


def _trained(docs: DataFrame, vocab: Vocabulary, weights: dict[str, np.ndarray], rate: float, warm: bool) -> np.ndarray | None:
    """The average of the weights that the tasks reach on their documents, each weighed by its tokens."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n = Network(weights, rate, WARM_SHARE if warm else 1), 0
        parts = _encoded(it, worker_encoder(vocab), 0)
        if warm:
            parts = list(parts)
            for done in itertools.count():
                if not parts or done >= WARM_PASSES and net.steps >= WARM_STEPS:
                    break
                for held in parts:
                    net.run(held)
            n = sum(len(d) for held in parts for d in held)
        else:
            for held in parts:
                net.run(held)
                n += sum(map(len, held))
        if n:
            place = pa.array(np.arange(len(net.flat), dtype=np.int32))
            weight = pa.array(np.full(len(net.flat), float(n)))
            yield pa.RecordBatch.from_arrays([place, pa.array(net.flat.astype(np.float64) * n), weight], ["i", "v", "n"])

    got = docs.select("text").mapInArrow(tidy(run), "i int, v double, n double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    table = got.toArrow()  # as many rows as the network has weights
    if not table.num_rows:
        return None
    flat = np.empty(table.num_rows, np.float32)
    flat[table["i"].to_numpy()] = table["v"].to_numpy() / table["n"].to_numpy()
    return flat


def train(docs: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Weights trained on all the documents (columns ``doc_id`` and ``text``)."""
    shares = np.zeros(SYMBOLS)
    own = np.arange(vocab.own)
    shares[_END_SYMBOL + own] = vocab.counts[: vocab.own]
    shares[:ENDINGS] = 10.0**vocab.mass
    weights = start_weights((shares + SMOOTHING) / (shares + SMOOTHING).sum())
    ids = hash_sample(docs.select("doc_id"), "doc_id", WARM_DOCS).distinct()
    # All tasks read; one text of each id, however often the id is repeated, goes to the one that trains.
    texts_of_ids = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    warm = texts_of_ids.coalesce(1).sortWithinPartitions("doc_id")
    # Every document trains once, in one of the rounds; each round starts from the average of the one before.
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(len(RATES)))
    rounds = [(docs.filter(turn == i) if len(RATES) > 1 else docs, rate) for i, rate in enumerate(RATES)]
    for sample, rate in ((warm, WARM_RATE), *rounds):
        flat = _trained(sample, vocab, weights, rate, sample is warm)
        if flat is not None:
            weights = _shaped(flat, weights)
    return weights


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Scores of all documents by a model of those for which ``training`` is true.

    ``doc_id``, ``n_tokens``, ``n_known`` (tokens that training documents hold), ``train_tokens``, and the logarithms to
    base 10 of the text's probability by smoothed counts, ``base_score``, and by the model, ``score``.
    """
    learned = docs.filter(training).select("doc_id", "text")
    counts = checkpointed(word_counts(learned))
    vocab = vocabulary(counts)
    weights = train(learned, vocab)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, net = worker_encoder(vocab), Network(weights)
        logs = np.append(np.log10(vocab.counts + SMOOTHING), 0.0)
        rest = np.where(np.arange(len(logs)) < vocab.own, 0.0, logs)  # words without a symbol of their own
        seen = np.append((vocab.counts > 0).astype(np.int64), 0)
        mass = np.append(vocab.mass, np.zeros(SYMBOLS - ENDINGS))
        # A key for each row, unique over all tasks; the checkpoint below fixes it.
        keys = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)

        def out(held: list[tuple]) -> pa.RecordBatch:
            model = net.run([s for _, _, s, _, _ in held]) / np.log(10)
            # Sums over each document's tokens; the last entry of each table is for words that the table lacks.
            at, symbols = np.concatenate([a for *_, a, _ in held]), np.concatenate([s for _, _, s, _, _ in held])
            starts = np.cumsum([0, *(len(a) for *_, a, _ in held[:-1])])
            base = np.add.reduceat(logs[at], starts).tolist()
            known = np.add.reduceat(seen[at], starts).tolist()
            model += np.add.reduceat(rest[at] - mass[symbols], starts)
            rows = []
            for (same, doc_id, _, a, others), k, b, m in zip(held, known, base, model.tolist(), strict=True):
                n = Counter(others)
                rows.append((next(keys), same, doc_id, len(a), k, b - len(a) * vocab.divisor, m, list(n), list(n.values())))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=fields)

        held: list[tuple] = []
        for batch in batches(it, 500):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held.append((np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64), doc_id, *encoder.encode(text)))
            if sum(len(h[2]) for h in held) > HELD:
                yield out(held)
                held = []
        if held:
            yield out(held)

    long, double = pa.int64(), pa.float64()
    kinds = (long, long, long, long, long, double, double, pa.list_(pa.binary()), pa.list_(long))
    names = ("row", "same", "doc_id", "n_tokens", "n_known", "base", "model", "words", "times")
    fields = pa.schema([pa.field(n, k) for n, k in zip(names, kinds, strict=True)])
    schema = "row long, same long, doc_id long, n_tokens long, n_known long, base double, model double, words array<binary>, times array<long>"
    scored = checkpointed(docs.select("doc_id", "text").mapInArrow(tidy(run), schema))
    # What runs side by side with a text shows in the last digits of its score; equal texts get one of theirs.
    of_text = scored.groupBy("same", "n_tokens").agg(F.min("model").alias("lower"), F.max("model").alias("upper")).filter("lower < upper")
    of_text = checkpointed(of_text.select("same", "n_tokens", "lower"))  # few, and an input that Spark can split the join by
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rare = rare.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    added = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + SMOOTHING)).alias("log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known")
    )
    log = F.coalesce("log", F.lit(0.0))
    light = scored.drop("words", "times").join(of_text, ["same", "n_tokens"], "left").withColumn("model", F.coalesce("lower", "model"))
    return light.join(added, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("model") + log).alias("score"),
    )
