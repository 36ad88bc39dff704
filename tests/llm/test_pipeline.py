"""The stages of the pipeline against brute force, and odd tables."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity

from .conftest import SCHEMA, sentence
from .test_dedup import covered, expected_lines, near_expected

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def mixed():
    """Copies, near copies, shared lines and passages, toxic texts, nulls, repeated rows and a very long text."""
    r = random.Random(31)
    passage, line = sentence(r, 70), "One line that many of these texts share."
    texts, toxic = [sentence(r, r.choice([5, 60, 200])) for _ in range(60)], {}
    for i in range(40):
        words = sentence(r, 40).split()
        for at in (5, 15, 25):
            words.insert(at, r.choice(["scoundrel", "villainous"]))
        toxic[len(texts)] = 1
        texts.append(" ".join(words))
    base = sentence(r, 300).split()
    for i in range(6):
        texts.append(" ".join([*base[: 10 * i], f"odd{i}", *base[10 * i :]]))
    texts += [f"{sentence(r, 40)}\n{line}\n{sentence(r, 20)} {passage} {sentence(r, 20)}" for _ in range(6)]
    texts += [texts[0], texts[1], "", " \n ", "one", sentence(r, 60_000)]
    rows = [(3 * i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(3 * i, 1, toxic.get(i, 0)) for i in range(len(texts))]
    rows += [(rows[4][0], *rows[4][1:])] * 2 + [(None, "no id here", None, None, None), (5000, None, "en", "s", None)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, mixed, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(mixed[0], SCHEMA).repartition(3)
    docs.withColumns({c: F.lit("x") for c in ("key", "id", "row", "spans", "at", "gone")}).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(mixed[1], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def _rows(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=repr)


def test_each_stage_against_brute_force(spark, folder, mixed):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == COLUMNS
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model.terms, model.clean)
    score = lambda t: 1 / (1 + np.exp(-(np.array(scorer.features(t)) @ model.weights[:-1] + model.weights[-1])))
    want = [r[:4] for r in mixed[0] if score(r[1]) < toxicity.THRESHOLD]
    assert _rows(clean) == sorted(want, key=repr) and len(want) == len(mixed[0]) - 40

    lined = stages["line_dedup"](spark, clean, folder)
    some = [r for r in want if r[0] is not None]
    found = {d: t for d, (_, _, t) in expected_lines(some).items()}
    assert lined.columns == COLUMNS
    assert _rows(lined) == sorted([(d, found.get(d, t) if d is not None else t, a, b) for d, t, a, b in want], key=repr)

    near = stages["near_dedup"](spark, lined, folder)
    before = [tuple(r) for r in lined.collect()]
    kept = near_expected([r for r in before if r[0] is not None], 80)
    assert near.columns == COLUMNS
    assert _rows(near) == sorted([r[:4] for r in before if r[0] is None or kept[r[0]][2]], key=repr)

    cut = stages["suffix_dedup"](spark, near, folder)
    before = [tuple(r) for r in near.collect()]
    spans = covered([r for r in before if r[0] is not None])
    after = defaultdict(list)
    for r in cut.collect():
        after[r["doc_id"]].append(r)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert cut.columns == COLUMNS and spans
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for d, t, *_ in before:
        words = [w for i, w in enumerate(word.findall(t or "")) if i not in spans.get(d, ())]
        assert [word.findall(r["text"] or "") for r in after[d]] == [words] * len(after[d])
    assert sum(map(len, after.values())) == len(before)

    packed = stages["packing"](spark, cut, folder).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = defaultdict(int)
    for r in packed:
        size[r["doc_id"]] += r["length"]
    for d, found in after.items():
        assert size[d] == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in found)


def test_the_whole_run_reads_each_stage_again(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    pieces = got.collect()
    assert pieces and all(0 < r["length"] <= 2048 for r in pieces)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
