"""Language model, toxicity and search: probabilities that add up, held-out accuracy, brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import knn, lm, ordinal, toxicity

from .conftest import SCHEMA, sentence


def test_base_scores_and_counts(docs, corpus):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    counts = Counter()
    for d, t, *_ in corpus:
        if zlib.crc32(str(d).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), lm.END])
    total, distinct = sum(counts.values()), len(counts)
    got = lm.score(docs, training).collect()
    assert len(got) == len(corpus)
    by = {r["doc_id"]: r for r in got}
    for d, t, *_ in corpus:
        tokens = [*(t or "").encode().lower().split(), lm.END]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        r = by[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_rare_words_get_their_counts_by_the_join(docs, monkeypatch):
    training = F.lit(True)
    want = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm.score(docs, training).collect()}
    monkeypatch.setattr(lm, "TABLE", 40)
    got = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm.score(docs, training).collect()}
    for d in want:
        assert got[d][1] == want[d][1] and got[d][0] == pytest.approx(want[d][0], rel=1e-9)


def test_repeated_and_null_ids_have_scores_of_their_own(spark, monkeypatch):
    """With most words beyond the table, so that their counts come by the join."""
    monkeypatch.setattr(lm, "TABLE", 5)
    one, two = " ".join(f"u{i % 7}" for i in range(14)), " ".join(f"u{i % 5} v{i}" for i in range(10))
    rows = [(1, one), (1, one), (1, two), (None, one), (None, one), (2, ""), (2, None)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.coalesce(F.col("doc_id") < 9, F.lit(False))).collect()
    counts = Counter()
    for d, t in rows:
        if d is not None:
            counts.update([*(t or "").encode().split(), lm.END])
    total, distinct = sum(counts.values()), len(counts)

    def expected(d, t):
        tokens = [*(t or "").encode().split(), lm.END]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        return d or 0, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6)

    seen = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert seen == sorted(expected(*r) for r in rows)
    assert all(r["score"] < 0 for r in got)
    assert len({(r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in got}) == 4  # equal texts, equal scores


def test_odd_tables(empty, docs):
    assert lm.score(empty, F.lit(True)).count() == 0
    got = lm.score(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def _network(seed=0, rate=0.0):
    weights = lm.start_weights(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS))
    r = np.random.default_rng(seed)
    return lm.Network({k: v + r.normal(0, 0.3, v.shape).astype(np.float32) for k, v in weights.items()}, rate)


def test_probabilities_of_the_next_symbol_add_up():
    net, begin = _network(), np.array([70, 3, 900])
    logs = net.run([np.append(begin, s).astype(np.int32) for s in range(lm.SYMBOLS)])
    before = net.run([begin.astype(np.int32)])[0]
    assert np.exp(logs - before).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_across_windows(monkeypatch):
    r = np.random.default_rng(1)
    docs = [r.integers(0, lm.SYMBOLS, n).astype(np.int32) for n in (1, 31, 32, 33, 500, 900)]
    whole = _network().run(docs)
    monkeypatch.setattr(lm, "LEAST_STEPS", 3)
    monkeypatch.setattr(lm, "MOST_STEPS", 7)
    assert _network().run(docs) == pytest.approx(whole, rel=1e-4)


def test_every_window_trains(spark):
    """Words of any window of a document get a gradient, of the first as of the last."""
    text = " ".join(w for w in ("alpha", "beta", "gamma", "delta", "omega") for _ in range(lm.MOST_STEPS))
    docs = spark.createDataFrame([(1, text, "", "", 0)], SCHEMA).coalesce(1)
    vocab = lm.vocabulary(lm.word_counts(docs))
    weights = lm.start_weights(np.full(lm.SYMBOLS, 1 / lm.SYMBOLS))
    after = lm._shaped(lm._trained(docs, vocab, weights, lm.RATES[0], False), weights)
    for word in ("alpha", "beta", "gamma", "delta", "omega"):
        symbol = vocab.symbols[vocab.words.index(word.encode())]
        assert (after["inputs"][symbol] != weights["inputs"][symbol]).any(), word


def test_warm_start_is_bounded_in_rows(spark, monkeypatch):
    """Repeated rows of a chosen id are one row of the warm start."""
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)], "doc_id long, text string")
    vocab, taken = lm.vocabulary(lm.word_counts(docs)), []
    monkeypatch.setattr(lm, "WARM_DOCS", 5)
    monkeypatch.setattr(lm, "_trained", lambda rows, *_: taken.append(rows.count()))
    lm.train(docs, vocab)
    assert 0 < taken[0] <= 5 and taken[1] == 300


def test_gradients_match_differences():
    net = _network()
    r = np.random.default_rng(2)
    doc = [r.integers(0, lm.SYMBOLS, 12).astype(np.int32)]
    taken = {}
    net.rate, net.every = 1.0, 1
    net._step = lambda g: taken.update(g=g)
    net.run(doc)
    net.rate = 0.0
    got, flat = taken["g"] * 12, net.flat
    for i in np.argsort(-np.abs(got))[:40:4]:
        old = flat[i]
        step = 2e-2
        flat[i] = old + step
        up = net.run(doc)[0]
        flat[i] = old - step
        down = net.run(doc)[0]
        flat[i] = old
        assert -(up - down) / (2 * step) == pytest.approx(got[i], rel=0.05, abs=5e-3)


def test_training_beats_the_base_on_held_out_texts(spark):
    """Words that follow each other in a fixed order can't be told by their counts."""
    r = random.Random(3)
    cycle = [f"word{i}" for i in range(50)]
    rows = []
    for d in range(300):
        at, n = r.randrange(50), r.randrange(20, 120)
        rows.append((d, " ".join(cycle[(at + i) % 50] for i in range(n)), "", "", 0))
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = [x for x in lm.score(spark.createDataFrame(rows, SCHEMA), training).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 10 == 0]
    assert sum(x["score"] for x in got) > 0.8 * sum(x["base_score"] for x in got)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distances():
    r = random.Random(4)
    terms = {"scoundrel": False, "villainous": False, "rogue": False, "rat": False, "verm": True, "wretch": True}
    automaton = toxicity.Automaton(terms)
    for _ in range(4000):
        word = list(r.choice(list(terms)) + r.choice(["", "", "ish"]))
        for _ in range(r.randrange(4)):
            word[r.randrange(len(word)) : r.randrange(len(word) + 1)] = r.choice(["", "x", "e", "ou"])
            word = word or ["a"]
        word = "".join(word)
        wanted = []
        for t, stem in terms.items():
            d = min(edits(word[:n], t) for n in range(len(word) + 1)) if stem else edits(word, t)
            if d <= toxicity.edits_allowed(t, stem):
                wanted.append((d, t))
        assert automaton.match(word) == min(wanted, default=None), word


def test_quotation_weighs_less_than_abuse():
    scorer = toxicity.Scorer({"scoundrel": False})
    abuse, quoted = scorer.features("you scoundrel you scoundrel"), scorer.features('they wrote "you scoundrel" and "scoundrel" there')
    names = toxicity.FEATURES
    assert abuse[names.index("exact")] > 0 == abuse[names.index("quoted")]
    assert quoted[names.index("quoted")] > 0 == quoted[names.index("exact")]
    assert abuse[names.index("dense")] > quoted[names.index("dense")]
    assert scorer.features("a scoundrl")[names.index("misspelt")] > 0
    assert scorer.features(None) == scorer.features("fine words") == [0.0] * len(names)


def _labelled(n=400):
    r = random.Random(6)
    rows, labels = [], []
    for d in range(n):
        toxic = r.random() < 0.3
        words = sentence(r, r.randrange(10, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["scoundrel", "villainous", *("verm" + x for x in ("in", "ish", "al", "ot", "ent", "ous"))]))
        rows.append((d, " ".join(words), "", "", 0))
        labels.append((d, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark, empty):
    rows, labels = _labelled()
    docs = spark.createDataFrame([*rows, (1000, None, "", "", 0), (1001, "a scoundrl, a vilainous scoundrel", "", "", 0)], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.filter("doc_id % 3 <> 1"))
    assert {"scoundrel", "villainous"} <= set(model.terms) and model.terms.get("verm")
    score = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    held = [(score[d] >= toxicity.THRESHOLD, bool(t)) for d, t in labels if d % 3 == 1]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert score[1000] < 0.2 and score[1001] > 0.7
    kept = {r["doc_id"] for r in model.keep(docs).collect()}
    assert kept == {d for d, s in score.items() if s < toxicity.THRESHOLD}
    assert model.score(empty).count() == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 9) for r in toxicity.fit(docs, none).score(docs).collect()} == {0.0}


def brute(vectors, k=10):
    whole = []
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for i, q in whole:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in whole if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("cell", [20, 20_000])
def test_knn(spark, monkeypatch, cell):
    monkeypatch.setattr(knn, "CELL_ROWS", cell)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(knn, "SAMPLE", 60)
    r = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in np.float32(r.normal(size=8))]) for i in range(900)]
    vectors += [(2000 + i, vectors[3][1]) for i in range(40)]  # ties
    vectors += [(5000, None), (5100, []), (5200, [1.0, None] + [0.0] * 6), (5300, [float("nan")] * 8), (5400, [float("inf")] * 8), (None, [1.0] * 8), (5500, [1.0] * 5)]
    rows = knn.whole_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3))
    got = knn.top_k(rows, rows.filter("vec_id % 100 = 0"), 10)
    assert sorted(map(tuple, got.collect())) == brute(vectors)


def test_knn_prunes_clusters(spark, monkeypatch):
    """Of vectors in 16 clusters, queries in each of them and several blocks, few pairs are left, a row is sent to fewer
    than two blocks on average, and the result is exact. Blocks by a hash of the query would be sent nearly all rows."""
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 12)
    r = np.random.default_rng(9)
    centres = r.normal(0, 4, (16, 8))
    of = r.integers(0, 16, 2000)
    vectors = [(10 * i, [float(x) for x in centres[of[i]] + r.normal(0, 0.05, 8)]) for i in range(2000)]
    rows = knn.whole_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3))
    queries = rows.filter("vec_id % 100 = 0")
    assert len(set(of[::10].tolist())) == 16
    assert sorted(map(tuple, knn.top_k(rows, queries, 10).collect())) == brute(vectors)
    routes = knn.Routes(rows, queries, 10)
    assert 0 < routes.sent < routes.pairs / 4
    needed = routes.asked.select("ring", "block").distinct().count()
    assert routes.data.select("ring", "block").distinct().count() == needed
    assert routes.asked.select("block").distinct().count() >= 16
    assert routes.data.count() < 2000 * 2


def test_a_repeated_id_is_fitted_once(spark):
    """A labelled id with very many rows counts as one, and the bound of the sample holds for what is fitted."""
    r = random.Random(31)
    rows = [(i, sentence(r, 20) + (" awful scum" if i % 3 == 0 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = toxicity.fit(spark.createDataFrame(rows + [rows[3]] * 500, "doc_id long, text string").repartition(5), labels)
    assert often.terms == once.terms and often.clean == once.clean and np.allclose(often.weights, once.weights)


def test_knn_deals_queries_to_blocks(monkeypatch):
    """Neighbouring pivots share a block as far as it has room; large groups have blocks of their own."""
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 10)
    centres = np.array([[0.0], [100.0], [1.0], [101.0], [50.0]])
    first, parts = knn.dealt_blocks(centres, {0: 4, 1: 5, 2: 6, 3: 5, 4: 25})
    assert first[0] == first[2] and first[1] == first[3] != first[0] and parts == {0: 1, 1: 1, 2: 1, 3: 1, 4: 3}
    others = {first[0], first[1]}
    assert others.isdisjoint(range(first[4], first[4] + 3)) and knn.dealt_blocks(centres, {}) == ({}, {})


def test_knn_of_one_id_repeated(spark):
    """Rows of one id are rows of their own, and spread over cells; none is a candidate of its own id."""
    vectors = [(100, [1.0, 0.5 * i]) for i in range(30)] + [(i, [0.25 * i, 1.0]) for i in range(1, 40)]
    rows = knn.whole_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    queries = rows.filter("vec_id = 7 or v[1] = 1024 * 14.5")
    got = sorted(map(tuple, knn.top_k(rows, queries, 5).collect()))
    assert [(r, i) for q, r, i, _ in got if q == 7] == [(1, 39), (2, 38), (3, 37), (4, 36), (5, 35)]
    assert [(r, i) for q, r, i, _ in got if q == 100] == [(1, 39), (2, 38), (3, 37), (4, 36), (5, 35)]


def test_knn_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(0, [1.0, 0.5]), (1, [0.25, 1.0]), (2, [2.0, 2.0])]
    rows = knn.whole_vectors(spark.createDataFrame(few, schema))
    assert sorted(map(tuple, knn.top_k(rows, rows.filter("vec_id = 0"), 10).collect())) == brute(few)
    none = knn.whole_vectors(spark.createDataFrame([], schema))
    assert knn.top_k(none, none, 10).count() == 0


def test_ordinal_gradient_matches_differences():
    r = np.random.default_rng(12)
    docs = [np.unique(ordinal.features(" ".join(f"w{x}" for x in r.integers(0, 9, n)).encode()), return_counts=True) for n in (0, 1, 5, 30, 40, 50)]
    rated = ordinal.Ratings(docs, np.array([3, 0, 1, 2, 3, 1]), 4)
    used = np.unique(np.concatenate([d for d, _ in docs]))
    weights, free = np.zeros(ordinal.SPACE), np.array([-0.7, 0.2, -0.4])
    weights[used] = r.normal(0, 1, len(used))
    _, gradient, dfree = rated.loss(weights, free)
    for at, values, got in [*((i, weights, gradient) for i in used[:12]), *((i, free, dfree) for i in range(3))]:
        old = values[at]
        values[at] = old + 1e-5
        up = rated.loss(weights, free)[0]
        values[at] = old - 1e-5
        down = rated.loss(weights, free)[0]
        values[at] = old
        assert (up - down) / 2e-5 == pytest.approx(got[at], rel=1e-4, abs=1e-8)


def test_ordinal_chances_against_all_weights_by_hand(spark):
    """Expected grade and tail probability of every row, by sums over its words in plain Python."""
    model = ordinal.Model([0, 1, 2], np.random.default_rng(13).normal(0, 2, ordinal.SPACE), np.array([-0.5, 0.8]))
    texts = ["Aa bb bb", "", None, "é x y z " * 50, "one"]
    got = model.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "one")], "doc_id long, text string"), 1).collect()
    for x in got:
        parts = ((texts[x["doc_id"]] if x["doc_id"] is not None else "one") or "").split()
        score, last = 0.0, None
        for w in parts:
            low = w.encode().lower()
            again = ordinal._AGAIN if low == last else ordinal._FRESH
            for code in (zlib.crc32(low), zlib.crc32(w.encode()[-3:], ordinal._ENDING), again):
                score += float(model.weights[code % ordinal.SPACE]) / (3 * len(parts))
            last = low
        above = [1 / (1 + math.exp(t - score)) for t in (-0.5, 0.8)]
        assert x["expected_grade"] == pytest.approx(sum(above), abs=1e-5) and x["tail_probability"] == pytest.approx(above[0], abs=1e-5)


def test_ordinal_gradient_and_order():
    """Grades that follow a score of two words come back in order, with their thresholds apart."""
    r = random.Random(9)
    docs, grade = [], []
    for _ in range(600):
        share = r.random()
        docs.append(ordinal.features(" ".join("good" if r.random() < share else "bad" for _ in range(60)).encode()))
        grade.append(min(3, int(share * 4)))
    weights, thresholds = ordinal.fit_ordinal(ordinal.Ratings([np.unique(d, return_counts=True) for d in docs], np.array(grade), 4), 200)
    assert (np.diff(thresholds) > 0).all() and len(thresholds) == 3
    model = ordinal.Model([1, 2, 4, 8], weights, thresholds)
    p = model.chances(np.array([weights[d].mean() for d in docs]))
    assert p.min() >= 0 and p.sum(1) == pytest.approx(1)
    assert np.mean(p.argmax(1) == grade) > 0.8


def test_quality_on_held_out_texts(spark, empty):
    r = random.Random(10)
    rows, ratings = [], []
    for d in range(300):
        grade = r.randrange(3)
        words = sentence(r, 40).split()
        for i in range(1, 40, (2, 5, 50)[grade]):
            words[i] += "$$$"
        rows.append((d, " ".join(words), "", "", 0))
        ratings.append((d, grade))
    docs = spark.createDataFrame([*rows, (900, None, "", "", 0)], SCHEMA)
    model = ordinal.fit(docs, spark.createDataFrame(ratings, "doc_id long, grade int").filter("doc_id % 3 <> 1"))
    got = {x["doc_id"]: x for x in model.score(docs, 2).collect()}
    held = [(got[d]["kept"], g == 2) for d, g in ratings if d % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.95
    means = [np.mean([got[d]["expected_grade"] for d, g in ratings if g == k]) for k in range(3)]
    assert means == sorted(means) and 0 <= got[900]["tail_probability"] <= 1
    assert {x["doc_id"] for x in model.select(docs, 2).collect()} == {d for d, x in got.items() if x["kept"]}
    assert model.score(empty, 2).count() == 0
    none = ordinal.fit(docs, spark.createDataFrame([], "doc_id long, grade int")).score(docs, 1)
    assert none.filter("kept").count() == 301
    one = ordinal.fit(docs, spark.createDataFrame([(1, 7)], "doc_id long, grade int")).score(docs, 7).first()
    assert (one["expected_grade"], one["tail_probability"]) == (7.0, 1.0)
