"""Lines, near duplicates and passages against brute force."""

import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines, minhash, suffixes
from tidemark.llm.components import components

from .conftest import SCHEMA


def expected_lines(corpus):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(lines._UPPER, lines._LOWER))
    owner = {}
    for doc_id, text, *_ in sorted(corpus, key=lambda r: r[0]):
        for line in (text or "").split("\n"):
            owner.setdefault(key(line), doc_id)
    out = {}
    for doc_id, text, *_ in corpus:
        found = (text or "").split("\n")
        kept = [x for x in found if len(key(x)) < 10 or owner[key(x)] == doc_id]
        out[doc_id] = (len(found), len(found) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (5, 3)])
def test_lines(docs, corpus, batches, fanout):
    got = lines.dedup_lines(docs, batches, fanout)
    assert {"key", "_gone", "lang"} <= set(got.columns)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == expected_lines(corpus)


def test_lines_of_odd_tables(spark, empty):
    assert lines.dedup_lines(empty).count() == 0
    rows = [(1, "a line of text", "", "", 0)] * 2 + [(None, "A line of text ", "", "", 0), (2, "a line of text\na line of text", None, None, None)]
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["doc_id"] or 99, r["text"]) for r in got.collect()) == [(1, "a line of text"), (1, "a line of text"), (2, ""), (99, "")]


def test_runs_are_compacted_and_disjoint(spark):
    runs = lines.LineRuns(2)
    for i in range(5):
        runs.add(spark.createDataFrame([(bytes([k]), 10 * i + k) for k in range(i, i + 4)], "key binary, doc long"))
    assert len(runs.runs()) == 2
    owners = {bytes(r["key"])[0]: r["owner"] for r in runs.owners().collect()}
    assert runs.owners().count() == len(owners) == 8
    assert owners[0] == 0 and owners[3] == 3 and owners[4] == 14


def test_runs_merge_without_shuffle_or_sort(spark):
    """A run is neither shuffled nor sorted again: a batch's keys are, once, and two runs are merged as they lie."""
    runs = lines.LineRuns(9)
    for i in range(2):
        runs.add(spark.createDataFrame([(bytes([k]), 10 * i + k) for k in range(4 * i, 4 * i + 4)], "key binary, doc long"))
    a, b = runs.runs()
    batch = spark.createDataFrame([(b"a", 1)], "key binary, doc long").groupBy("key").agg(F.min("doc").alias("owner"))
    with lines.ordered_scans(spark):
        both = lines.LineRuns._merged(a, b)._jdf.queryExecution().executedPlan().toString()
        anti = batch.join(a.hint("merge"), "key", "left_anti").join(b.hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in both and "Exchange" not in both and "Sort [" not in both
    assert anti.count("SortMergeJoin") == 2 and anti.count("Exchange") == 1 and anti.count("Sort [") == 1


def near_expected(corpus, percent):
    sets = {}
    for doc_id, text, *_ in corpus:
        w = (text or "").encode().lower().split()
        sets[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, corpus, percent):
    got = minhash.near_components(docs, percent=percent).collect()
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_expected(corpus, percent)


def test_second_round_finds_what_stars_miss(spark):
    """Copies that drift: each is near the next, far from the first; no star holds them all."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(words), "", "", 0))
        words[16 * i % 400 : 16 * i % 400 + 6] = [f"n{i}x{j}" for j in range(6)]
    got = minhash.near_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_expected(rows, 85)


def test_near_duplicates_of_odd_tables(spark, empty):
    assert minhash.near_components(empty).count() == 0
    rows = [(None, "a b c", "", "", 0), (5, "a b c", "", "", 0), (4, "A  b c", "", "", 0), (4, "A  b c", "", "", 0), (6, None, "", "", 0)]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, True), (4, 4, True), (4, 4, True), (5, 4, False), (6, 6, True)]


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(pairs).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def covered(corpus, least=50):
    words = {d: (t or "").encode().lower().split() for d, t, *_ in corpus}
    first, out = {}, defaultdict(set)
    for d in sorted(words):
        for i in range(len(words[d]) - least + 1):
            first.setdefault(tuple(words[d][i : i + least]), d)
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            if first[tuple(w[i : i + least])] < d:
                out[d] |= set(range(i, i + least))
    return {d: s for d, s in out.items() if s}


def test_passages(docs, corpus):
    got = defaultdict(set)
    for r in suffixes.repeated_spans(docs).collect():
        assert r["of_doc_id"] < r["doc_id"] and r["n_words"] >= 50
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert got == covered(corpus)


def test_a_passage_of_very_many_documents(spark):
    """Split over all partitions, it stays in the first document alone."""
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(20)) + f" {passage} end{i}", "", "", 0) for i in range(300)]
    got = suffixes.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 300))
    assert {(r["start_word"], r["end_word"]) for r in got} == {(20, 75)}


def test_passages_around_a_run_of_very_many_documents(spark):
    """X + H, H + Y and X + H + Y, with a stock run H in thousands of documents of other surroundings."""
    r = np.random.default_rng(8)
    run = [f"h{i}" for i in range(30)]

    def fresh(n):
        return [f"w{x}" for x in r.integers(0, 1 << 40, n)]

    texts = [fresh(40) + run + fresh(40) for _ in range(3000)]
    for k in range(60):
        before, after = fresh(r.integers(20, 34)), fresh(r.integers(20, 34))
        middle = [before + run, run + after, before[-12:] + run + after[:12]][k % 3]
        texts += [fresh(40) + middle + fresh(40) for _ in range(2)]
    order = r.permutation(len(texts)).tolist()
    rows = [(d, " ".join(t), "", "", 0) for d, t in zip(order, texts, strict=True)]
    got = defaultdict(set)
    for x in suffixes.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect():
        got[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    want = covered(rows)
    assert len(want) >= 60 and got == want


def test_matches_long_to_the_left_behind_a_longer_right(spark):
    """A and C share 50 words that lie mostly before a run H; B shares H and more words after it with A, none before."""
    r = np.random.default_rng(21)

    def fresh(n):
        return [f"w{x}" for x in r.integers(0, 1 << 40, n)]

    texts = []
    for _ in range(150):
        before, run, after = fresh(r.integers(20, 37)), fresh(r.integers(14, 29)), fresh(20)
        before = (before + fresh(50))[: 50 - len(run)]
        texts += [fresh(20) + before + run + after, fresh(30) + run + after[:19], fresh(15) + before + run + fresh(30)]
    order = r.permutation(len(texts)).tolist()
    rows = [(d, " ".join(t), "", "", 0) for d, t in zip(order, texts, strict=True)]
    got = defaultdict(set)
    for x in suffixes.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    want = covered(rows)
    assert len(want) >= 150 and got == want


def test_a_very_long_text_of_one_word(spark):
    """Every position is a minimiser of the same head; time stays in proportion."""
    began = time.time()
    rows = [(1, "again " * 200_000, "", "", 0), (2, "so " * 7 + "again " * 200_000, "", "", 0), (3, "again " * 49, "", "", 0)]
    got = [(r["doc_id"], r["start_word"], r["end_word"], r["of_doc_id"]) for r in suffixes.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(2, 7, 200_007, 1)] and time.time() - began < 60


@pytest.mark.parametrize("most", [3, 9])
def test_few_suffixes_held(spark, docs, corpus, monkeypatch, most):
    """What a task lets go early is settled by keys."""
    monkeypatch.setattr(suffixes, "MOST_HELD", most)
    monkeypatch.setattr(suffixes, "FEW", 1)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(20)) + f" {passage} end{i} {passage}", "", "", 0) for i in range(40)]
    for table, want in ((docs, covered(corpus)), (spark.createDataFrame(rows, SCHEMA), covered(rows))):
        got = defaultdict(set)
        for r in suffixes.repeated_spans(table).collect():
            got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        assert got == want


def test_no_pass_over_suffixes_in_one_task(docs):
    assert "Coalesce 1" not in suffixes.repeated_spans(docs)._jdf.queryExecution().toString()


def test_cutting_passages(docs, corpus, empty):
    spans = covered(corpus)
    got = {r["doc_id"]: r for r in suffixes.dedup_passages(docs).collect()}
    assert len(got) == len(corpus)
    for doc_id, text, lang, *_ in corpus:
        assert got[doc_id]["lang"] == lang
        if doc_id not in spans:
            assert got[doc_id]["text"] == text
        else:
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            assert re.findall(r"[^\x20\x09-\x0D]+", got[doc_id]["text"]) == [w for i, w in enumerate(words) if i not in spans[doc_id]]
    assert suffixes.dedup_passages(empty).count() == 0


def test_minimisers_are_shared_by_shared_words():
    r = np.random.default_rng(3)
    shared = r.integers(0, 2**63, suffixes.LEAST).astype(np.uint64)
    for n in range(5):
        a, b = (np.concatenate([r.integers(0, 2**63, 30 + n).astype(np.uint64), shared, r.integers(0, 2**63, 40).astype(np.uint64)]) for _ in range(2))
        assert set(suffixes.minimisers(a)[1]) & set(suffixes.minimisers(b)[1])


def test_digest_of_kept_lines(spark):
    df = spark.createDataFrame([(1, "x\ny", "", "", 0)], SCHEMA)
    got = lines.dedup_lines(df).select(F.sha2("text", 256)).first()[0]
    assert got == hashlib.sha256(b"x\ny").hexdigest()
