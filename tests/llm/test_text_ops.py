"""Language, toxicity, licenses, benchmark windows, personal data."""

from __future__ import annotations

import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlake.llm import common, decontaminate, language, licenses, pii, registry, toxicity
from tests.llm.conftest import KINDS, ODD, kept_all

QUERIES = registry.QUERIES


def test_word_rules():
    text = "Ab\x0b CD ef É's 12,3\x7f{x}"
    assert common.space_words(text.encode()) == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    assert common.alnum_words(text.encode()) == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_odd_rows(spark, odd, table_dir, name):
    """One row for each input row, and no crash, on nulls, empty, long and repeated rows."""
    if name.startswith("op6"):
        pytest.skip("reads no texts")
    d = table_dir(odd)
    got = QUERIES[name](spark, d).collect()
    assert len(got) == len(ODD)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((k is None, k or 0) for k, _ in ODD)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_empty_tables(spark, odd, table_dir, sf_dir, name):
    empty = table_dir(odd.limit(0), benchmark=spark.createDataFrame([], "item_id long, text string"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert QUERIES[name](spark, empty).collect() == []


# -- language ---------------------------------------------------------------------------------


def test_language_accuracy(spark, sf_dir, documents):
    got = QUERIES["op1_language"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["rejected"] for r in got)


def test_language_rejects_what_is_none(spark, documents):
    odd = spark.createDataFrame([(9001, "Привет мир это русский текст про разные вещи " * 5, None, "s", 1), (9002, "123 !!", None, "s", 1), (9003, None, None, "s", 1)], KINDS)
    docs = documents.unionByName(odd).withColumn("language", F.lit("a clash"))
    kept = language.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in documents.select("doc_id").collect()}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ein langer Text über alles, " * 900 + "x"
    whole = next(language.counts([text]))
    monkeypatch.setattr(language, "GROUP_POINTS", 97)
    parts = next(language.counts([text]))
    assert (whole[1] == parts[1]).all() and parts[2].all()


def test_language_without_labels(spark, docs_of):
    model = language.fit(docs_of([(1, "a text", None, "s", 1)]))
    got = language.classify(docs_of([(1, "a text", None, "s", 1)]), model).first()["language"]
    assert got["pred"] == "und" and got["score"] == 0


def test_every_label_is_learned_whatever_its_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 9)))
    rows = [("une phrase qui revient toujours", "fr")] * 30_000 + [("ein satz der immer wieder da steht", "de")] * 30_000
    rows += [(f"noch ein satz über {word()} und {word()}", "de") for _ in range(40)] + [("12 34", "de")]
    rows += [(f"the weather {word()} {word()}", "en") for _ in range(40)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), per_label=20)
    assert set(model.labels) == {"de", "en", "fr"}
    assert model.labels.count("de") == model.labels.count("en") == language.CENTROIDS


def test_every_label_is_learned_however_many(spark):
    names = [f"l{i}" for i in range(2010)]
    model = language.fit(spark.createDataFrame([(f"text of {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", n) for i, n in enumerate(names)], "text string, lang string"))
    assert model.labels == sorted(names)


def test_language_against_brute_force(spark, documents):
    """Every prediction is the label of the nearest of all centroids, and its score and cutoff follow from the cosines."""
    model = language.fit(documents)
    got = language.classify(documents, model).select("doc_id", "text", "lang", "language.*").collect()
    cut = language.cutoffs(language.classify(documents.where("lang IS NOT NULL"), model))
    logs: dict = {}
    for r in got:
        tf = np.zeros(language.BUCKETS)
        t = (r["text"] or "").lower()
        for size, seed in ((2, 0x1B873593), (3, 0xCC9E2D51)):
            for i in range(len(t) - size + 1):
                g = [ord(c) if c.isalpha() else 32 for c in t[i : i + size]]
                if g[0] == 32 and g[-1] == 32:
                    continue
                h = seed
                for p in g:
                    h = ((h ^ p) * 0x9E3779B1) & 0xFFFFFFFF
                    h ^= h >> 15
                tf[h >> 19] += 1
        if not any(c.isalpha() for c in t):
            assert r["pred"] == "und" and r["score"] == 0
            continue
        x = np.sqrt(tf) * model.idf
        x /= np.linalg.norm(x)
        cos = [float(x @ c) for c in model.centroids]
        best = {n: max(c for c, k in zip(cos, model.labels, strict=True) if k == n) for n in set(model.labels)}
        top = max(best.values())
        assert top - best[r["pred"]] < 1e-5 and abs(r["cosine"] - top) < 1e-5
        assert abs(r["score"] - 1 / sum(np.exp(language.SHARPNESS * (b - top)) for b in best.values())) < 1e-3
        if r["lang"] is not None:
            logs.setdefault(r["pred"], []).append(np.log(max(r["cosine"], 1e-6)))
    for n, v in logs.items():
        assert abs(cut[n] - np.exp(np.mean(v) - language.REJECT_AT * max(np.std(v), 0.1))) < 1e-4


def test_language_learns_from_labelled_rows_only(spark, documents, table_dir):
    """Rows without a label change neither a prediction nor a cutoff."""
    extra = documents.where("doc_id < 40").selectExpr("doc_id + 4000000 AS doc_id", "reverse(text) AS text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    a = {r["doc_id"]: tuple(r) for r in QUERIES["op1_language"](spark, table_dir(documents)).collect()}
    b = {r["doc_id"]: tuple(r) for r in QUERIES["op1_language"](spark, table_dir(documents.unionByName(extra))).collect()}
    assert all(b[k] == v for k, v in a.items()) and len(b) > len(a)


def test_a_column_in_other_letters_is_replaced(spark, documents):
    docs = documents.limit(5).withColumn("Language", F.lit(1)).withColumn("TOXICITY", F.lit(1)).withColumn("License", F.lit(1)).withColumn("Hits", F.lit(1)).withColumn("Pii", F.lit(1))
    for out, made in (("language", language.classify(docs, language.fit(documents))), ("toxicity", toxicity.score(docs, toxicity.train([], np.zeros(0), 0.5))), ("license", licenses.scan(docs)), ("hits", decontaminate.mark(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))), ("pii", pii.detect(docs))):
        left = docs.drop(out)
        assert kept_all(made, left) and made.columns[-1] == out and len(made.columns) == len(left.columns) + 1
        assert made.count() == 5


# -- toxicity ---------------------------------------------------------------------------------


def test_machine_learns_pairs():
    """An insult beside a group is marked, either alone isn't: no sum of single weights fits."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1200):
        a, b = i % 4 in (0, 1), i % 4 in (0, 2)
        words = [f"w{k}" for k in rng.integers(0, 200, 12)] + ["insult"] * a + ["group"] * b
        rows.append(toxicity.features(" ".join(words).encode()))
        labels.append(float(a and b))
    labels = np.array(labels)
    model = toxicity.train(rows[:1000], labels[:1000], labels.mean())
    assert np.mean((model.raw(rows[1000:]) >= 0) == labels[1000:]) > 0.95


def test_rare_words_and_balanced_pairs_are_learned():
    """Insults of ten texts each, and two words that only tell in pairs, each in a fifth of the texts."""
    rng = np.random.default_rng(2)
    rows = [toxicity.features(" ".join([*(f"w{k}" for k in rng.integers(0, 3000, 10)), *[f"slur{rng.integers(0, 300)}"] * (i % 2)]).encode()) for i in range(6000)]
    labels = np.arange(6000) % 2.0
    model = toxicity.train(rows[:4800], labels[:4800], 0.5)
    assert np.mean((model.raw(rows[4800:]) >= 0) == labels[4800:]) > 0.7
    rows, labels = [], []
    for i in range(4000):
        k = i % 10
        words = [f"w{j}" for j in rng.integers(0, 200, 12)] + ["insult"] * (k in (0, 1)) + ["group"] * (k in (1, 2))
        rows.append(toxicity.features(" ".join(words).encode()))
        labels.append(float(k in (0, 2) if k < 3 else i // 10 % 2))
    labels, told = np.array(labels), np.arange(4000) % 10 < 3
    model = toxicity.train(rows[:3000], labels[:3000], labels.mean())
    right = (model.raw(rows[3000:]) >= 0) == labels[3000:]
    assert np.mean(right[told[3000:]]) > 0.8


@pytest.mark.parametrize(("insult", "group"), [(0.25, 0.5), (0.5, 0.25), (0.1, 0.1)])
def test_words_that_only_tell_as_a_pair(insult, group):
    """Marked is who has exactly one of the two words."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for _ in range(6000):
        a, b = rng.random() < insult, rng.random() < group
        rows.append(toxicity.features(" ".join([*(f"w{k}" for k in rng.integers(0, 500, 12)), *["insult"] * a, *["group"] * b]).encode()))
        labels.append(float(a != b))
    labels = np.array(labels)
    model = toxicity.train(rows[:5000], labels[:5000], labels.mean())
    assert np.mean((model.raw(rows[5000:]) >= 0) == labels[5000:]) > 0.98


def test_pairs_in_few_texts():
    """Two words in a twentieth of the texts each, balanced alone."""
    rng = np.random.default_rng(12)
    rows, labels, told = [], [], []
    for _ in range(9000):
        k = int(np.searchsorted([0.025, 0.05, 0.075], rng.random()))
        rows.append(toxicity.features(" ".join([*(f"w{j}" for j in rng.integers(0, 500, 12)), *["insult"] * (k in (0, 1)), *["group"] * (k in (1, 2))]).encode()))
        labels.append(float(k in (0, 2)) if k < 3 else float(rng.random() < 0.5))
        told.append(k < 3)
    labels, told = np.array(labels), np.array(told)
    model = toxicity.train(rows[:7500], labels[:7500], 0.5)
    assert np.mean(((model.raw(rows[7500:]) >= 0) == labels[7500:])[told[7500:]]) > 0.95


def test_toxicity_accuracy_and_formula(spark, documents):
    """Held-out labels of the larger tables, and each score by the formula, pair by pair."""
    big = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, big).collect()}
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in marks.collect() if r["toxic"] is not None and got[r["doc_id"]]["held_out"]]
    toxic = [p for p, y in held if y == 1]
    assert len(held) > 300 and np.mean([p == y for p, y in held]) > 0.95 and np.mean(toxic) > 0.7
    model = toxicity.fit(docs, marks)
    some = documents.limit(60)
    for r in toxicity.score(some, model, out="TOX").collect():
        at = [i for b in toxicity.features((r["text"] or "").encode()) for i in np.flatnonzero(model.buckets == b)]
        raw = model.bias + sum(model.weight[i] for i in at) + sum(float(model.factor[i] @ model.factor[j]) for n, i in enumerate(at) for j in at[:n])
        assert abs(r["TOX"] - 1 / (1 + np.exp(-raw))) < 1e-6


def test_toxicity_columns(spark, sf_dir):
    got = QUERIES["op2_toxicity"](spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_labels_with_nulls_and_repeats(spark, docs_of):
    docs = docs_of([(i, f"bad word{i}" if i % 2 else f"good word{i}") for i in range(40)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(v >= 0.5) == bool(k % 2) for k, v in got.items()]) == 1


# -- licenses ---------------------------------------------------------------------------------


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), places


def test_licenses_against_brute_force(spark, docs_of, pairs, table_dir, odd):
    more = ["Under the MIT License, under the MIT license under-the mit LICENSE", "x cc by nc cc by nc", "the mit license", "apache license version 2.0 and CC-BY-NC", "GNU General Public License, version 3", "mit " * 50]
    docs = docs_of([*pairs, *((10_000 + i, t) for i, t in enumerate(more)), *ODD])
    got = QUERIES["op8_licenses"](spark, table_dir(docs)).collect()
    texts = {**dict(pairs), **{10_000 + i: t for i, t in enumerate(more)}}
    for r in got:
        if r["doc_id"] in texts and r["doc_id"] not in {k for k, _ in ODD}:
            n, places = brute_places(texts[r["doc_id"]])
            at = [i for _, i in places]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
            assert r["base_labels"] == ",".join(sorted({x for x, _ in places}))
    by = {r["doc_id"]: r for r in got}
    assert by[10_000]["n_base"] == 3 and by[10_004]["labels"] == "gpl-3" and by[10_003]["labels"] == "apache-2,cc-by-nc"


def test_license_texts_are_told_by_their_postings(spark, docs_of):
    mit = next(t for n, t, k in licenses.TEMPLATES if n == "mit" and len(t.split()) > 100)
    changed = mit.replace("merchantability", "merchandise")
    docs = docs_of([(1, "Some head. " + mit.upper().replace(" ", ", ") + " tail"), (2, changed), (3, "permission is granted"), (4, mit + " " + mit), (5, "general public " * 50), (6, "permission is hereby not granted free of charge to any person obtaining a copy")])
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert [(h["label"], h["start"], h["score"]) for h in got[1]["hits"]] == [("mit", 2, 1.0)]
    assert [(h["label"], 0.98 < h["score"] < 1) for h in got[2]["hits"]] == [("mit", True)]
    assert [h["start"] for h in got[4]["hits"]] == [0, len(mit.split())] and not got[3]["hits"] and not got[5]["hits"] and not got[6]["hits"]
    for name, t, k in licenses.TEMPLATES:
        assert f" {k} " in f" {t} ", name


def test_license_postings_are_the_rarest_words():
    df = {"a": 5, "b": 1, "c": 3, "d": 1}
    assert licenses.postings({"x": ["a", "b", "c", "d"], "y": ["a"], "z": ["a", "c", "a"]}, df) == {"x": [("b", 1), ("d", 3)], "y": [("a", 0)], "z": [("c", 1), ("a", 0)]}


def test_license_plan_is_native(spark, documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- benchmark windows ------------------------------------------------------------------------


def digests(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_windows_against_brute_force(spark, sf_dir, pairs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert digests(QUERIES["op9_decontaminate"](spark, sf_dir)) == decontaminate.brute(pairs, items)


def test_windows_in_blocks_and_offsets(spark, docs_of):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:14])), (2, "Short one"), (2, "short ONE"), (None, "no id"), (3, None), (4, " ,. ")]
    docs = [(1, "x " + " ".join(words[:14]).upper().replace(" ", ", ") + " y"), (2, "a short  one, short one"), (3, " ".join(words[2:11])), (4, "no id"), (5, None), (6, "")]
    want = decontaminate.brute(docs, items)
    assert [want[k][1] for k in range(1, 7)] == [14, 4, 0, 2, 0, 0]
    marked = decontaminate.mark(docs_of(docs).withColumn("hit_words", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), max_window_words=20)
    for r in marked.collect():
        text = dict(docs)[r["doc_id"]]
        n, n_hit, n_items, sha, _ = want[r["doc_id"]]
        assert (r["hits"]["n_words"], r["hits"]["n_hit"], len(r["hits"]["item_ids"])) == (n, n_hit, n_items)
        assert decontaminate.digest(r["hits"]["item_ids"]) == sha and r["hit_words"] == 1
        covered = [w for s in r["hits"]["spans"] for w in re.findall("[0-9a-z]+", text[s["start"] : s["end"]].lower())]
        assert len(covered) == n_hit


def test_a_benchmark_beyond_one_automaton(spark, docs_of, sf_dir, pairs):
    """The distributed windows give what the single automaton does, on the given tables and on odd rows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = docs_of([*pairs, *ODD]).withColumn("hit_windows", F.lit(7)).withColumn("hit_h", F.lit(7))
    one = decontaminate.mark(docs, items)
    many = decontaminate.mark(docs, items, max_window_words=100)
    assert kept_all(many, docs) and many.columns == one.columns
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", repr(r["hits"]))
    assert sorted(map(key, many.collect())) == sorted(map(key, one.collect()))
    assert decontaminate.mark(docs.limit(0), items, max_window_words=100).count() == 0


def test_decontamination_stage(spark, docs_of, sf_dir):
    item = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 15)
    docs = docs_of([(1, f"before {item} after"), (2, "a clean text"), (3, None)]).withColumn("hits", F.lit("clash"))
    kept = decontaminate.stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["hits"]) for r in kept.collect()) == [(2, "clash"), (3, "clash")]


# -- personal data ----------------------------------------------------------------------------

PIECES = st.sampled_from(["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", "12-", "é", " ", "\n", "-", ".", "0", "abc", "10.0.0.255", "+49 30 1234567 890"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12))
def test_patterns_against_plain_expressions(pieces):
    text = "".join(pieces)
    found = pii.pattern_spans(text)
    counts, sha = pii.brute(text)
    assert {k: sum(f[0] == k for f in found) for k in pii.KINDS} == counts
    assert hashlib.sha256(pii.joined(found).encode()).hexdigest() == sha


def test_numbers_of_very_many_digits():
    for part in ("0" * 5000 + ".1.2.3", "1.2.3." + "0" * 5000 + "255", "9" * 5000 + ".1.2.3"):
        found = pii.pattern_spans(part)
        assert ({k: sum(f[0] == k for f in found) for k in pii.KINDS}, hashlib.sha256(pii.joined(found).encode()).hexdigest()) == pii.brute(part)
    assert [k for k, _, _ in pii.pattern_spans("0" * 5000 + ".1.2.3")] == ["ip"] and pii.plausible("ip", "0" * 5000 + ". 1.2.3")


def test_personal_data_query_against_brute_force(spark, docs_of, pairs, table_dir, net):
    """All columns of the query: counts and digest by plain expressions, spans with what the network adds."""
    more = ["mail a.b@c.de or 10.0.0.1, +1 (555) 010-4477 4539578763621486 before noon", "0" * 5000 + ".1.2.3", "call +49 30 1234567 or 4111 1111 1111 1111", "x@y.z " * 400]
    docs = {**dict(pairs), **{10_000 + i: t for i, t in enumerate(more)}}
    got = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, table_dir(docs_of([*docs.items(), *((k, t) for k, t in ODD if k is None)]))).collect() if r["doc_id"] is not None}
    assert got.keys() == docs.keys()
    added = 0
    for k, t in docs.items():
        counts, sha = pii.brute(t)
        (base, more), = pii.find_spans([t or ""], net)
        added += len(more)
        assert {n: got[k][f"n_{n}"] for n in pii.KINDS} == counts and got[k]["base_sha256"] == sha
        assert got[k]["spans"] == pii.joined(base + more)
        assert all(s[2] <= x[1] or s[1] >= x[2] for s in more for x in base)
    assert added


def test_the_network_is_trained_once(spark):
    calls = []
    for _ in range(2):
        assert common.remembered(spark, "test-bytes", lambda: calls.append(1) or b"abc") == b"abc"
    assert calls == [1]
    net = pii.Network.new(np.random.default_rng(3))
    again = pii.loaded(pii.saved(net))
    assert all((again.p[k] == v).all() and again.p[k].dtype == v.dtype for k, v in net.p.items())


def test_patterns_on_hostile_texts():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "1 " * 50_000):
        pii.pattern_spans(text)  # linear: ends at once


@pytest.fixture(scope="module")
def net():
    return pii.network()


def test_network_reads_new_spans(net):
    rng = np.random.default_rng(123)
    made = [pii.sample(rng) for _ in range(200)]
    tags = net.decode(np.stack([pii.encode(s) for s, _ in made]))
    assert (tags == np.stack([t for _, t in made])).mean() > 0.97


def test_spans_across_windows(net):
    text = "word " * 40 + "reach me at some.body+tag@mail.example.com or call " + "again " * 40 + " 4111-1111-1111-1111 x"
    (base, added), = pii.find_spans([text], net)
    assert [k for k, _, _ in base] == ["email", "card"] and added == []


def test_network_adds_what_patterns_miss(net):
    text = "please call +1 (555) 010-4477 4539578763621486 before noon and thanks"
    (base, added), = pii.find_spans([text], net)
    assert {k for k, _, _ in base + added} == {"phone", "card"}
    assert pii.find_spans(["the year 2024, page 12 of 300, version 1.2, 50% of $1,000.00"], net)[0] == ([], [])


def test_redaction(spark, docs_of):
    docs = docs_of([(1, "mail a.b@c.de now"), (2, "clean text"), (3, None), (4, "")]).withColumn("pii", F.lit("clash"))
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["pii"]) for r in pii.stage(spark, docs, "").collect()}
    assert got == {1: ("mail <EMAIL> now", 16, "clash"), 2: ("clean text", 10, "clash"), 3: (None, None, "clash"), 4: ("", 0, "clash")}


def test_redaction_takes_one_worker_a_task(spark, docs_of):
    plan = pii.redact(docs_of([(1, "mail a.b@c.de now")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_decoding_keeps_no_gates():
    net, ids = pii.Network.new(np.random.default_rng(3)), np.ones((512, pii.WINDOW), np.int64)
    tracemalloc.start()
    net.decode(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20


def test_gradients_are_right():
    rng = np.random.default_rng(5)
    small = pii.Network.new(rng)
    small.p = {k: v.astype(np.float64) for k, v in small.p.items()}
    s, t = pii.sample(rng, 12)
    ids, tags = pii.encode(s)[None], t[None]
    _, g = small.gradients(ids, tags)
    for name in ("O", "A", "Xf", "Hb", "cf"):
        at = tuple(rng.integers(0, n) for n in small.p[name].shape)
        eps, was = 1e-4, small.p[name][at]
        small.p[name][at] = was + eps
        up = small.gradients(ids, tags)[0]
        small.p[name][at] = was - eps
        down = small.gradients(ids, tags)[0]
        small.p[name][at] = was
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name
