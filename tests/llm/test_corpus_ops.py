"""Language-model scores, mixing, near duplicates, repeated strings, and the pipeline."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlake.llm import common, decontaminate, graph, hmm, language, mixing, near_text, near_vectors, pii, registry, suffixes
from tests.llm.conftest import ODD, kept_all

QUERIES = registry.QUERIES


def test_running_sum(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else f"g{g}", int(o), int(v)) for g, o, v in zip(rng.choice(4, 3000, p=[0.7, 0.1, 0.1, 0.1]), rng.permutation(3000), rng.integers(0, 9, 3000), strict=True)]
    df = spark.createDataFrame(rows, "g string, o long, v long").withColumn("rs_part", F.lit(1))
    got = common.running_sum(df, ["g"], ["o"], "v", "s")
    assert got.columns == ["g", "o", "v", "rs_part", "s"]
    want, total = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + v
        want[g, o] = total[g]
    assert {(r["g"], r["o"]): r["s"] for r in got.collect()} == want
    assert common.running_sum(df.limit(0), [], ["o"], "v", "s").count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5)]
    f = graph.Forest()
    for a, b in edges:
        f.join(a, b)
    want = {x: f.find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("at_once, most", [(300_000, 1), (40, 100), (0, 100)])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, at_once, most):
    """A chain, a hub and pairs over many partitions: at once a single table is written, and rounds find the same."""
    tables = []
    monkeypatch.setattr(graph, "AT_ONCE", at_once, raising=False)
    monkeypatch.setattr(graph, "written", lambda df, label: tables.append(label) or common.written(df, label))
    edges = [(i + 1, i) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 100)] + [(i, i + 1) for i in range(0, 100, 2)] * 2
    named = [tuple(x.to_bytes(2, "big") for x in e) for e in edges]
    f = graph.Forest()
    for a, b in named:
        f.join(a, b)
    got = graph.components(spark.createDataFrame(named, "a binary, b binary").repartition(8)).collect()
    assert len(got) == 61 + 100 + 100 and {bytes(r["node"]): bytes(r["root"]) for r in got} == {x: f.find(x) for e in named for x in e}
    assert len(tables) <= most


# -- language model ---------------------------------------------------------------------------


def test_base_scores(spark, sf_dir, pairs):
    want = hmm.brute_base(pairs)
    got = QUERIES["op3_hmm"](spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    for held in (True, False):
        assert sum(r["score"] for r in got if r["held_out"] == held) > sum(r["base_score"] for r in got if r["held_out"] == held)


def test_scaled_recursion_is_exact():
    rng = np.random.default_rng(8)
    share = rng.dirichlet(np.ones(hmm.SYMBOLS))
    model = hmm.Model.first(share)
    texts = [rng.integers(0, hmm.END, n).astype(np.uint16) for n in (0, 1, 5, 20_000, 17)]
    seen = 0
    for mine, flat, alive in hmm.lanes(texts):
        like = hmm.forward(model, flat, alive)[0]
        for lane, i in enumerate(mine):
            assert math.isclose(like[lane], hmm.brute_likelihood(model, texts[i]), rel_tol=1e-11)
            seen += 1
    assert seen == len(texts)


def test_scores_against_brute_force(spark, pairs, documents):
    """Every score word by word, with symbols from plain counts: the model is the trained one."""
    docs = documents.select("doc_id", "text").withColumn("held", common.crc_mod("doc_id", 5) == 1)
    corpus = hmm.prepare(docs, "held")
    model = hmm.train(corpus, 1)
    held = {r["doc_id"] for r in docs.where("held").collect()}
    counts: dict = {}
    for k, t in pairs:
        if k not in held:
            for w in common.space_words((t or "").encode()):
                counts[w] = counts.get(w, 0) + 1
    often = sorted(counts, key=lambda w: (-counts[w], hashlib.sha256(w).hexdigest()))[: hmm.TOP]
    assert corpus.top == [hashlib.sha256(w).hexdigest() for w in often]
    got = {r["doc_id"]: r["score"] for r in hmm.likelihoods(corpus, model).collect()}
    for k, t in sorted(pairs, key=lambda p: len(p[1] or ""))[:150]:
        assert math.isclose(got[k], hmm.brute_score(corpus, model, counts, t), rel_tol=1e-9)


def test_long_texts_are_part_of_the_start(spark, docs_of, monkeypatch):
    """All training texts are long, and one word is longer than any usual one: both are learned from."""
    long = "w" * 5000
    docs = docs_of([(i, " ".join([long, *(f"v{(i + j) % 50}" for j in range(3000))])) for i in range(6)]).withColumn("held", F.lit(False))
    corpus = hmm.prepare(docs, "held")
    assert hashlib.sha256(long.encode()).hexdigest() in corpus.top
    model = hmm.start_model(corpus.coded, corpus.texts, corpus.share)
    assert np.abs(model.emit - hmm.Model.first(corpus.share).emit).max() > 1e-3


def test_every_round_learns_from_all_texts(spark, docs_of, monkeypatch):
    """More texts than a sample of 1,000, some long: the start is plain Baum-Welch over all of them, as are the rounds behind it."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 40, 6))) for i in range(3000)]
    rows += [(3000 + i, " ".join(f"{'abc'[w // 1500]}{w % 40}" for w in range(4500))) for i in range(3)] + [(4000, None), (4001, "zz zz")]
    docs = docs_of(rows).withColumn("held", F.col("doc_id") == 4001)
    monkeypatch.setattr(hmm, "START_ROUNDS", 3)
    corpus = hmm.prepare(docs, "held")
    texts = [hmm.unpacked(r["symbols"], np.uint16) for r in corpus.coded.where("NOT held_out").collect()]
    assert len(texts) == corpus.texts == len(rows) - 1
    want = hmm.Model.first(corpus.share)
    for _ in range(3):
        want = hmm.Model.of(*hmm.expected(want, texts)[:3], corpus.share)
    got = hmm.start_model(corpus.coded, corpus.texts, corpus.share)
    for a, b in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-7)
    got, want = hmm.train(corpus, 1), hmm.Model.of(*hmm.expected(want, texts)[:3], corpus.share)
    assert np.allclose(got.emit, want.emit, rtol=1e-3, atol=1e-7)


def test_expected_counts_against_plain_recursion(monkeypatch):
    """Counts in double precision, one text at a time, against those of texts side by side in several blocks."""
    rng = np.random.default_rng(13)
    texts = [rng.integers(0, 30, n).astype(np.uint16) for n in (0, 0, 1, 2, 7, 40, 40, 90, 200)]
    share = np.bincount(np.concatenate(texts), minlength=hmm.SYMBOLS) + 0.01
    model = hmm.Model.first(share / share.sum())
    start, move, emit, like = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.SYMBOLS, hmm.STATES)), sum(hmm.brute_likelihood(model, t) for t in texts)
    for t in texts:
        seq = [*t.tolist(), hmm.END]
        a, b = [model.start * model.emit[seq[0]]], [np.ones(hmm.STATES)]
        for s in seq[1:]:
            a.append(a[-1] @ model.move * model.emit[s])
            a[-1] /= a[-1].sum()
        for s in seq[:0:-1]:
            b.insert(0, model.move @ (model.emit[s] * b[0]))
            b[0] /= b[0].sum()
        for i, s in enumerate(seq):
            here = a[i] * b[i] / (a[i] * b[i]).sum()
            emit[s] += here
            start += here if i == 0 else 0
            if i:
                pair = a[i - 1][:, None] * model.move * (model.emit[s] * b[i])
                move += pair / pair.sum()
    for tokens, lanes in ((hmm.LANE_TOKENS, hmm.LANES), (100, 1024), (1000, 2)):
        monkeypatch.setattr(hmm, "LANE_TOKENS", tokens)
        monkeypatch.setattr(hmm, "LANES", lanes)
        got = hmm.expected(model, texts)
        for x, y in zip(got[:3], (start, move, emit), strict=True):
            assert np.allclose(x, y, rtol=1e-4, atol=1e-5)
        assert math.isclose(got[3], like, rel_tol=1e-5)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(9)
    texts = [np.where(rng.random(60) < 0.9, rng.integers(0, 20, 60) + 40 * (i % 2), 99).astype(np.uint16) for i in range(60)]
    share = np.bincount(np.concatenate(texts), minlength=hmm.SYMBOLS) + 0.01
    share[hmm.END] = 60
    share = share / share.sum()
    model, last = hmm.Model.first(share), -np.inf
    for _ in range(6):
        a, b, c, like = hmm.expected(model, texts)
        assert math.isclose(a.sum(), len(texts), rel_tol=1e-4) and math.isclose(c.sum(), sum(len(t) + 1 for t in texts), rel_tol=1e-4)
        assert like > last - 5
        last, model = like, hmm.Model.of(a, b, c, share)
    assert math.isclose(model.emit.sum(0).max(), 1, rel_tol=1e-6)


def test_chunks_change_nothing(spark, sf_dir, documents, monkeypatch):
    docs = documents.select("doc_id", "text").withColumn("held", F.col("doc_id") % 5 == 1)
    whole = {r["doc_id"]: r["base_score"] for r in hmm.score(docs, "held", rounds=0).collect()}
    # workers read the limits from the module, so the small chunks are made here
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 500)
    again = {r["doc_id"]: r["base_score"] for r in hmm.score(docs.repartition(7), "held", rounds=0).collect()}
    assert whole.keys() == again.keys() and all(math.isclose(whole[k], again[k], rel_tol=1e-9) for k in whole)


@given(st.lists(st.one_of(st.none(), st.text(" \t\n\x0b\x0c\raZÉ\x1c\x1f\x85\xa0\0", max_size=30)), max_size=20))
def test_words_of_many_texts_at_once(texts):
    for kind in (pa.string(), pa.large_string()):
        words, ends = hmm.split_words(pa.array(["ab c", *texts], kind).slice(1))
        words = [w.encode() for w in words.to_pylist()]
        assert [words[lo:hi] for lo, hi in zip(ends, ends[1:])] == [common.space_words((t or "").encode()) for t in texts]


def test_texts_are_laid_once_for_all_rounds(spark, documents, monkeypatch):
    corpus = hmm.prepare(documents.select("doc_id", "text").withColumn("held", F.col("doc_id") % 5 == 1), "held")
    made, lay = [], hmm.laid
    monkeypatch.setattr(hmm, "laid", lambda coded: made.append([(r["flat"], r["sizes"]) for r in lay(coded).collect()]) or lay(coded))
    monkeypatch.setattr(hmm, "START_ROUNDS", 2)
    hmm.train(corpus, 1)
    assert len(made) == 1
    # whole texts, every one learned from, and none twice
    want = sorted(len(hmm.unpacked(r["symbols"], np.uint16)) + 1 for r in corpus.coded.where("NOT held_out").collect())
    assert sorted(n for _, sizes in made[0] for n in np.frombuffer(sizes, np.int64).tolist()) == want
    assert sum(len(hmm.unpacked(flat, np.uint16)) for flat, _ in made[0]) == sum(want)


# -- mixing -----------------------------------------------------------------------------------


def test_mix_meets_targets(spark, sf_dir):
    got = QUERIES["op5_mixing"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    sizes = {r.doc_id: len(common.space_words((r.text or "").encode())) for r in docs.itertuples()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == sizes
    got = got.merge(docs[["doc_id", "source"]], on="doc_id")
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    want = mixing.brute_targets(by["size"].to_dict())
    for source, r in by.iterrows():
        assert math.isclose(r.target, want[source], rel_tol=1e-9)
        assert abs(r.taken - r.target) <= 2 * r.most
    assert (got.taken <= 2 * got["size"]).all() and got.taken.sum() <= 1.5 * got["size"].sum()
    again = QUERIES["op5_mixing"](spark, sf_dir).toPandas()
    assert got[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def test_words_taken_against_brute_force(spark, documents, docs_of):
    for docs in (documents, docs_of([(i, "w " * (1 + i * i % 23), None, None if i % 4 == 0 else f"s{i % 3}", 1) for i in range(1, 60)] + [(100, None), (101, ""), (5, "w w w"), (5, "w w w")])):
        got = mixing.mix(docs).collect()
        want = mixing.brute_taken([(r["doc_id"], r["source"], r["size"], r["place"]) for r in got])
        by: dict = {}
        for r in got:
            by.setdefault((r["doc_id"], r["source"], r["size"], r["place"]), []).append(r["taken"])
        assert {k: sum(v) for k, v in by.items()} == want


def test_very_many_sources(spark):
    df = spark.createDataFrame([(f"d{i}", 1 + i * 37 % 1009) for i in range(3000)] + [(None, 12)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = mixing.brute_targets({r["source"]: r["source_size"] for r in df.collect()})
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert "SinglePartition" not in mixing.targets(df)._jdf.queryExecution().executedPlan().toString()


def test_mixing_sizes_hold_no_words(docs_of):
    """Words of odd texts are counted as bytes.split() has them, without an array of a text's words."""
    texts = [None, "", "  ", " \t\n", "a", "\t\n a", "a b ", "\x85a\xa0b\x1cc d", "\U0001F600 \U0001F600x \u3000y", "é\r\n\x0b\x0cç", "$1 \\ $", "a\u0301 \u0301", "\x00 \x00", "ab " * 500_000, " " * 1_000_000]
    sized = mixing._sized(docs_of(list(enumerate(texts))), 0)
    assert {r["doc_id"]: r["size"] for r in sized.collect()} == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert "extract_all" not in sized._jdf.queryExecution().executedPlan().toString()


def test_mixing_stage(spark, docs_of):
    """Whole documents with how often they are taken; none that isn't; rows repeated as a whole count apart."""
    rows = [(i, "w " * (1 + i % 7), None, f"s{i % 3}", 1) for i in range(1, 80)] + [(500, "again again", None, "s1", 2)] * 5 + [(None, "no id", None, "s0", 1), (600, None, None, "s0", 1), (601, "", None, "s0", 1)]
    docs = docs_of(rows).withColumn("Repeats", F.lit("clash"))
    got = mixing.stage(spark, docs, "")
    assert kept_all(got, docs) and got.columns[-2:] == ["repeats_", "taken"]
    taken: dict = {}
    for r in got.collect():
        assert r["repeats_"] in (1, 2) and r["taken"] == r["repeats_"] * len(r["text"].split()) and r["Repeats"] == "clash"
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    want: dict = {}
    for r in mixing.mix(docs).collect():
        if r["taken"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert taken == want and 500 in taken
    assert mixing.stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10, None: 5}, {"a": 0, "b": 7}, {None: 3}, {"x": 5, "y": 5, "z": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = mixing.brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


# -- near duplicates --------------------------------------------------------------------------


def groups(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_near_texts_against_brute_force(spark, sf_dir, pairs):
    assert groups(QUERIES["op7_near_text"](spark, sf_dir)) == near_text.brute(pairs)


def varied(rng, n, words=120, change=3):
    base = [f"v{k}" for k in rng.integers(0, 10_000, words)]
    out = []
    for _ in range(n):
        mine = list(base)
        for at in rng.integers(0, words, change):
            mine[at] = f"x{rng.integers(0, 10**9)}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_a_large_group_in_blocks(spark, docs_of, table_dir, monkeypatch, block):
    rng = np.random.default_rng(6)
    texts = varied(rng, 60) + varied(rng, 40, words=60, change=1) + ["only one of its kind " * 3] * 30
    rows = list(enumerate(texts, 1))
    monkeypatch.setattr(near_text, "BLOCK", block)
    assert groups(QUERIES["op7_near_text"](spark, table_dir(docs_of(rows)))) == near_text.brute(rows)


@pytest.mark.parametrize("block", [5, 40])
def test_long_lists_by_representatives(spark, monkeypatch, block):
    """Chains and clusters across many blocks: the components are those of all pairs, for both comparisons."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(near_text, "BLOCK", block)
    rows = []
    for template in range(4):
        base = [f"t{template}x{k}" for k in range(150)]
        for i in range(70):
            mine = list(base)
            for at in rng.integers(0, 150, 1 + i // 14):  # from nearly equal to far from one another
                mine[at] = f"x{rng.integers(0, 10**9)}"
            rows.append(" ".join(mine))
    rows = list(enumerate(rows, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["doc_id"] == r["component_id"]) for r in near_text.group(docs).collect()}
    want = near_text.brute(rows)
    assert got == want and 4 < sum(v[2] for v in want.values()) < 270


def test_one_template_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Many blocks of one component: rows compared grow with the members, not with their square."""
    monkeypatch.setattr(near_text, "BLOCK", 10)
    rows = spark.range(400).select(F.lit(b"g").alias("g"), F.md5(F.col("id").cast("string").cast("binary")).cast("binary").alias("cls"))
    seen = spark.sparkContext.accumulator(0)

    def compare(batches):
        for b in batches:
            seen.add(b.num_rows)
            # everything in a block is linked
            names, keys = b.column(3).to_pylist(), list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            first: dict = {}
            pairs = [(b"g", first.setdefault(k, n), n) for k, n in zip(keys, names, strict=True)]
            if pairs := [p for p in pairs if p[1] != p[2]]:
                yield near_text._edges(pairs)

    edges = near_text.forests(common.written(rows, "members"), "g", 4, compare, ["cls"])
    assert len({r["root"] for r in graph.components(edges).collect()}) == 1 and edges.count() == 399
    assert seen.value < 3 * 400


def test_few_rows_are_compared_in_few_tasks(spark, monkeypatch):
    """The levels behind a large group's first comparison hold few rows: not all partitions start a task for them."""
    monkeypatch.setattr(near_text, "BLOCK", 10)
    rows = spark.range(60).select(F.lit(b"g").alias("g"), F.md5(F.col("id").cast("string").cast("binary")).cast("binary").alias("cls"))
    tasks = spark.sparkContext.accumulator(0)

    def compare(batches):
        tasks.add(1)
        first: dict = {}
        for b in batches:
            keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            pairs = [(b"g", first.setdefault(k, n), n) for k, n in zip(keys, b.column(3).to_pylist(), strict=True)]
            if pairs := [p for p in pairs if p[1] != p[2]]:
                yield near_text._edges(pairs)

    edges = near_text.forests(common.written(rows, "members"), "g", 40, compare, ["cls"])
    assert edges.count() == 59 and tasks.value < 2 * 40


def test_dedup_stage_keeps_one_of_each(spark, docs_of):
    docs = docs_of([*ODD, (20, "a b c d e f g h"), (21, "A B C D E F G H"), (22, "a b c d e f g h")]).withColumn("verdict", F.lit(1))
    kept = near_text.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, k) for k in (1, 2, 3, 4, 5, 6, 8, 9, 20)] + [(True, 0), (True, 0)]


def test_dedup_stage_against_brute_force(spark, docs_of):
    rng = np.random.default_rng(17)
    texts = []
    for change in (2, 5, 6, 7, 8, 12):  # a pair of texts of 300 words with so many changed is 0.68 to 0.97 alike
        base = [f"v{k}" for k in rng.integers(0, 10_000, 300)]
        for _ in range(6):
            other = list(base)
            for at in rng.choice(300, change, replace=False):
                other[at] = f"x{rng.integers(0, 10**9)}"
            texts += [" ".join(base), " ".join(other)]
            base = [f"v{k}" for k in rng.integers(0, 10_000, 300)]
    rows = list(enumerate(texts, 1))
    want = {k for k, v in near_text.brute(rows, 80).items() if v[2]}
    assert len(want) < sum(v[2] for v in near_text.brute(rows).values())  # some pairs lie between 0.8 and 0.85
    assert {r["doc_id"] for r in near_text.stage(spark, docs_of(rows), "").collect()} == want


def vectors_of(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = rng.normal(size=32)
        for _ in range(10):
            rows.append((len(rows), (base + rng.normal(size=32) * 0.05).tolist(), c % 3))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(5)]  # copies
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 32, 0), (n + 3, [float("nan")] * 32, 0), (n + 4, [None, *[1.0] * 31], 0), (n + 5, [float("inf")] * 32, 0), (n + 6, rows[0][1], None), (n + 7, [2 * x for x in rows[0][1]], 0), (n + 8, [1e30] * 32, 1), (n + 9, [1.0] * 32, 1), (n + 10, [1.0] * 31, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_vectors.group(df).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    assert vectors_of(got) == near_vectors.brute(rows)


@pytest.mark.parametrize("block", [1000, 9])
def test_near_vectors_in_blocks(spark, monkeypatch, block):
    rng = np.random.default_rng(13)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.08).tolist(), 1) for i in range(80)]
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    got = near_vectors.group(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    want, found = near_vectors.brute(rows), vectors_of(got)
    assert sum(v[0] for v in found.values()) >= 0.995 * sum(v[0] for v in want.values())
    assert all(found[k][0] <= want[k][0] for k in want)


# -- repeated strings -------------------------------------------------------------------------


def stripped(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffixes_against_brute_force(spark, sf_dir, pairs):
    assert stripped(QUERIES["op10_suffixes"](spark, sf_dir)) == suffixes.brute(pairs)


def test_matching_statistics():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, int(rng.integers(1, 30)))) for _ in range(25)] + [b"abab" * 6, b"abab" * 6]
    best, starts, _ = suffixes.matching(strings)
    places = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    for k, i in places:
        longest = 0
        for k2, j in places:
            if (k, i) != (k2, j):
                a, b, n = strings[k][i:], strings[k2][j:], 0
                while n < min(len(a), len(b)) and a[n] == b[n]:
                    n += 1
                longest = max(longest, n)
        assert best[starts[k] + i] == longest


@pytest.mark.parametrize(("group_bytes", "group_rows"), [(suffixes.GROUP_BYTES, suffixes.GROUP_ROWS), (300, 1000), (1 << 20, 3), (300, 1)])
def test_suffixes_on_hard_texts(spark, docs_of, group_bytes, group_rows):
    rng = np.random.default_rng(21)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = word(260)
    rows = [(i, word(150) + shared[: 200 + i % 61] + word(100)) for i in range(40)]
    rows += [(100, "ab" * 400), (101, "To " * 300 + "é" * 120), (102, shared), (103, shared[:199]), (104, None), (105, ""), (106, word(1000)), (107, "x" * 201), (108, rows[0][1]), (None, rows[3][1])]
    got = suffixes.strip(docs_of(rows).withColumn("dedup_marks", F.lit(1)).withColumn("Dedup", F.lit(1)), group_bytes=group_bytes, group_rows=group_rows)
    found = {(r["doc_id"]): (r["dedup"]["n_bytes"], r["dedup"]["n_bytes"] - len(r["dedup"]["kept"]), len(r["dedup"]["spans"])) for r in got.collect()}
    assert found == {k: v[:3] for k, v in suffixes.brute(rows).items()}


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_general_operators_on_odd_rows(spark, docs_of, case):
    """Grouping, mixing and scoring keep a row for each row, whatever else the table holds."""
    docs = docs_of(ODD if case == "odd" else ODD[:0]).withColumn("cls", F.lit(1)).withColumn("component_id", F.lit(1)).withColumn("size", F.lit("x")).withColumn("held_out", F.lit(1)).withColumn("held", F.lit(None).cast("boolean"))
    n = docs.count()
    for found in (near_text.group(docs), mixing.mix(docs), hmm.score(docs, "held", rounds=1)):
        assert found.count() == n
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found.collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())


def test_vectors_among_odd_rows(spark):
    kinds = "vec_id long, embedding array<float>, label int, cls int, n_links int, tokens int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, None, None), (2, [], 1), (3, [None, 1.0], 1), (4, [0.0, 0.0], 1)]
    got = near_vectors.group(spark.createDataFrame([(*r, 7, 7, 7) for r in rows], kinds)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4)]
    assert near_vectors.group(spark.createDataFrame([], kinds)).count() == 0


# -- pipeline ---------------------------------------------------------------------------------


def texts_of(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}


def test_pipeline_stages_against_brute_force(spark, sf_dir, documents):
    """Each stage on what the one before kept, against its plain counterpart."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
    stages = dict(corpus_pipeline.STAGES)
    odd = spark.createDataFrame([(9001, "Привет мир это русский текст про разные вещи " * 5, None, "s", 1), (9002, "123 !!", None, "s", 1), (9003, None, None, "s", 1)], documents.schema)
    docs = documents.unionByName(odd).withColumn("extra", F.lit("kept"))
    before = docs

    def ran(name):
        out = common.written(stages[name](spark, before, sf_dir), f"test-{name}")
        assert kept_all(out, before)
        return out

    out = ran("language")  # labels from the model itself: its parts have their own brute force
    model = language.fit(before)
    cut = language.cutoffs(language.classify(before.where("lang IS NOT NULL"), model))
    far = {r["doc_id"] for r in language.classify(before, model).where(language.rejected(cut)).collect()}
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in before.collect()} - far and {9001, 9002, 9003} <= far
    before = out
    out = ran("near_duplicates")
    want = near_text.brute([(r["doc_id"], r["text"]) for r in before.collect()], near_text.STAGE_PERCENT)
    assert {r["doc_id"] for r in out.collect()} == {k for k, v in want.items() if v[2]}
    before = out
    out = ran("decontamination")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = decontaminate.brute([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert texts_of(out) == {(r["doc_id"], r["text"]) for r in before.collect() if not hit[r["doc_id"]][4]}
    before = out
    out = ran("personal_data")
    net, plain = pii.network(), {}
    for r in before.collect():
        (base, added), = pii.find_spans([r["text"] or ""], net)
        t, shift = r["text"], 0
        done = -1
        for k, s, e in pii.by_place(base + added):
            if s >= done:
                t = t[: s + shift] + f"<{k.upper()}>" + t[e + shift :]
                shift += len(k) + 2 - (e - s)
            done = max(done, e)
        plain[r["doc_id"]] = t
    assert {r["doc_id"]: r["text"] for r in out.collect()} == plain and all(r["n_chars"] == len(r["text"]) for r in out.collect())
    before = out
    out = ran("mixing")
    rows = mixing.mix(before).collect()
    taken = mixing.brute_taken([(r["doc_id"], r["source"], r["size"], r["place"]) for r in rows])
    assert {(r["doc_id"], r["taken"]) for r in out.collect()} == {(k[0], v) for k, v in taken.items() if v}
    assert texts_of(out) <= texts_of(before)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {"text", "repeats", "taken"} <= set(whole.columns) and whole.where("taken = 0 OR text IS NULL").count() == 0


def test_pipeline_on_odd_rows(spark, odd, table_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, table_dir(odd)).collect()
    # texts with a letter, one of each group; what a budget of one and a half times the words leaves out may lack
    ids = {r["doc_id"] for r in got}
    assert ids and ids <= {4, 5, 6, 9, None} and all(r["taken"] == r["repeats"] * len(common.space_words(r["text"].encode())) > 0 for r in got)


def test_pipeline_on_an_empty_table(spark, odd, table_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, table_dir(odd.limit(0)))
    assert got.collect() == [] and {"doc_id", "text", "repeats"} <= set(got.columns)
