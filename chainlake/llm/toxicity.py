"""Toxicity score by a factorization machine over hashed terms.

A text's features are the distinct buckets of its words (2^24, so that an insult's bucket is hardly
ever hit by another word); the model holds those that several sampled texts have. Besides a weight
each bucket has a short factor vector, and the products of the vectors score pairs of words (an insult beside a group that
it is aimed at) that no sum of single weights can tell from their parts. It is trained in numpy on a
bounded sample of labelled rows (about `per_class` rows of either class, chosen by hash);
the share of the classes over all labelled rows sets the intercept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, arrow_schema, below, crc_mod, read_table, share_below, tune, utf8, with_columns

BUCKETS, FACTORS = 1 << 24, 8
PER_CLASS = 6000
#: A bucket is learned if so many sampled texts have it. It takes whole steps if their classes differ
#: from the sample's by so much (chi squared), or it is in this share of the sample, where chance evens
#: out; below, steps shrink with the square of what is there of either, down to a least part.
LEAST_TEXTS, FULL_CHI2, COMMON, LEAST_PART = 5, 15.0, 0.3, 0.02
#: A bucket also takes whole steps if the texts that have it beside another one are marked so differently
#: from what the two alone let expect (chi squared). Pairs are counted by hash, in so many sampled texts of
#: either class, between buckets that PAIR_LEAST of them have: with fewer texts no pair could tell, as its
#: words' rates together are taken to let expect LOW at least and 1 - LOW at most. So a pair tells from
#: about a twentieth of the sample on.
PAIR_CHI2, PAIR_SLOTS, PAIR_TEXTS, LOW, PAIR_LEAST = 32.0, 1 << 22, 1000, 0.25, 11
EPOCHS, TRIAL_EPOCHS, BATCH, RATE, SHRINK = 12, 6, 128, 0.5, 1e-3
#: Words whose bucket a worker remembers.
REMEMBERED = 150_000
#: Texts scored together.
TOGETHER = 256

_bucket: dict[bytes, int] = {}


def features(text: bytes) -> np.ndarray:
    """The distinct buckets of a text's words, ascending."""
    if len(_bucket) > REMEMBERED:
        _bucket.clear()
    found = []
    for w in set(alnum_words(text)):
        b = _bucket.get(w)
        if b is None:
            b = _bucket[w] = (crc32(w) * 0x9E3779B1 >> 8) & (BUCKETS - 1)
        found.append(b)
    return np.unique(np.array(found, np.int32))


@dataclass
class Model:
    """weight and factor have a row for each bucket of `buckets`, ascending."""

    bias: float
    buckets: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def known(self, row: np.ndarray) -> np.ndarray:
        """Places of a text's buckets in the model; those that it hasn't drop out."""
        at = np.searchsorted(self.buckets, row).astype(np.int32)
        at[at == len(self.buckets)] = 0
        return at[self.buckets[at] == row] if len(self.buckets) else at[:0]

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log-odds of rows of buckets, TOGETHER of them at a time, as each bucket takes its factors along."""
        return np.concatenate([np.zeros(0), *(self._raw(rows[lo : lo + TOGETHER]) for lo in range(0, len(rows), TOGETHER))])

    def _raw(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        known = [self.known(r) for r in rows]
        full = [i for i, r in enumerate(known) if len(r)]
        if not full:
            return out
        at = np.concatenate([known[i] for i in full])
        starts = np.cumsum([0, *(len(known[i]) for i in full[:-1])])
        v = self.factor[at]
        s = np.add.reduceat(v, starts)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), starts))
        out[full] += np.add.reduceat(self.weight[at], starts) + pairs
        return out


def _slots(row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first, slots of pairs) of all pairs of a row's places, some places with all at a time; each pair comes twice."""
    h = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    step = max(1, 500_000 // max(len(row), 1))
    for lo in range(0, len(row), step):
        both = (h[lo : lo + step, None] + h) * np.uint64(0xBF58476D1CE4E5B9)
        yield lo, (both >> np.uint64(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)


def in_pairs(known: list[np.ndarray], labels: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Which places tell in a pair: its texts' labels are far from what the places' own rates, added, let expect.

    known holds the places of each text, rate is by place. All pairs of the texts looked at are counted.
    """
    told = np.zeros(len(rate), bool)
    mine = np.concatenate([np.flatnonzero(labels == y)[:PAIR_TEXTS] for y in (0, 1)])
    often = np.bincount(np.concatenate([known[i] for i in mine]), minlength=len(rate)) >= PAIR_LEAST
    rows = [known[i][often[known[i]]] for i in mine]
    both = np.zeros(PAIR_SLOTS, np.int64)  # texts in the low half, those of label 1 in the high half
    for row, i in zip(rows, mine, strict=True):
        for _, at in _slots(row):
            np.add.at(both, at.ravel(), 1 + ((1 << 32) if labels[i] else 0))
    texts, toxic = ((both & 0xFFFFFFFF) // 2).astype(np.int32), ((both >> 32) // 2).astype(np.int32)
    del both
    some = np.zeros(PAIR_SLOTS, bool)
    for lo in range(0, PAIR_SLOTS, 1 << 18):
        n, y = texts[lo : lo + (1 << 18)], toxic[lo : lo + (1 << 18)]
        far = np.maximum(y - LOW * n, (1 - LOW) * n - y)
        some[lo : lo + (1 << 18)] = (far > 0) & (far * far >= PAIR_CHI2 * n * LOW * (1 - LOW))
    p = labels[mine].mean()
    for row in rows if some.any() else ():
        for lo, at in _slots(row):
            x, y = np.nonzero(some[at])
            a, b, k = row[lo + x], row[y], at[x, y]
            e = np.clip(rate[a] + rate[b] - p, LOW, 1 - LOW)
            sure = (a != b) & ((toxic[k] - texts[k] * e) ** 2 >= PAIR_CHI2 * texts[k] * e * (1 - e))
            told[a[sure]] = True
    return told


def train(rows: list[np.ndarray], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """The model of a sample; share: of label 1 among all labelled rows, to set the intercept right.

    Evidence from pairs helps where words tell only together, and misleads where copies of a text make
    all its pairs seem to tell: a model with it and one without are tried on every fifth text, and the
    better one (balanced accuracy) is trained on all.
    """
    test = np.arange(len(rows)) % 5 == 4
    some, other = [r for r, t in zip(rows, test, strict=True) if not t], [r for r, t in zip(rows, test, strict=True) if t]
    both = lambda y: len(set(y.tolist())) == 2
    if not both(labels[test]) or not both(labels[~test]):
        return _train(rows, labels, share, False, seed)
    right = []
    for pairs in (False, True):
        m = _train(some, labels[~test], share, pairs, seed, TRIAL_EPOCHS)
        ok = (m.raw(other) >= 0) == labels[test]
        right.append(ok[labels[test] == 1].mean() + ok[labels[test] == 0].mean())
    return _train(rows, labels, share, right[1] > right[0], seed)


def _train(rows: list[np.ndarray], labels: np.ndarray, share: float, pairs: bool, seed: int, epochs: int = EPOCHS) -> Model:
    """Gradient steps on log-loss with weight decay.

    Steps are scaled by the evidence for a bucket: a rare word moves little, so no text is learned by heart.
    """
    rng = np.random.default_rng(seed)
    there = min(max(share, 1e-6), 1 - 1e-6)
    buckets, texts = np.unique(np.concatenate([np.zeros(0, np.int32), *rows]), return_counts=True)
    toxic = np.bincount(np.searchsorted(buckets, np.concatenate([np.zeros(0, np.int32), *(r for r, y in zip(rows, labels, strict=True) if y)])), minlength=len(buckets))
    p = labels.mean() if len(labels) else 0.0
    chi2 = (toxic - texts * p) ** 2 / np.maximum(texts * p * (1 - p), 1e-9)
    keep = texts >= LEAST_TEXTS
    part = np.clip(np.maximum(chi2 / FULL_CHI2, texts / max(COMMON * len(rows), 1e-9)), LEAST_PART, 1)[keep] ** 2
    buckets = buckets[keep]
    n = len(buckets)
    if not n or len(set(labels.tolist())) < 2:
        return Model(float(np.log(there / (1 - there))), buckets[:0], np.zeros(0), np.zeros((0, FACTORS)))
    model = Model(0.0, buckets, np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)))
    known = [model.known(r) for r in rows]
    w, v, bias = model.weight, model.factor, 0.0
    if pairs:
        part[in_pairs(known, labels, toxic[keep] / texts[keep])] = 1
    full = [i for i in range(len(rows)) if len(known[i])]
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for epoch in range(epochs):
        rate = RATE / (1 + epoch)
        order = rng.permutation(full)
        for lo in range(0, len(order), BATCH):
            mine = order[lo : lo + BATCH]
            sizes = np.array([len(known[i]) for i in mine])
            at = np.concatenate([known[i] for i in mine])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            x = v[at]
            s = np.add.reduceat(x, starts)
            y = bias + np.add.reduceat(w[at], starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((x * x).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[mine]) * balance[mine]
            g /= np.sqrt(sizes)  # long texts have many words that don't matter
            each = np.repeat(g, sizes)
            by = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(at[by]) > 0]))
            used = at[by][cut]
            w[used] -= part[used] * rate * np.clip(np.add.reduceat(each[by], cut), -1, 1)
            v[used] -= part[used, None] * rate * np.clip(np.add.reduceat((each[:, None] * (np.repeat(s, sizes, axis=0) - x))[by], cut), -0.1, 0.1)
            w *= 1 - SHRINK
            v *= 1 - SHRINK
            bias -= 0.1 * rate * float(np.clip(g.sum(), -1, 1))
    # the intercept with the fewest errors on the sample, its classes weighed as they are in all rows
    y, true = model.raw(rows), np.where(labels == 1, there / labels.mean(), (1 - there) / (1 - labels.mean()))
    by = np.argsort(-y, kind="stable")
    gain = np.cumsum(np.where(labels[by] == 1, true[by], -true[by]))[:-1]
    gain[y[by][:-1] == y[by][1:]] = -np.inf
    k = int(gain.argmax())
    model.bias = -float(y[by[k]] + y[by[k + 1]]) / 2
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learns from the texts of docs that labels marks 0 or 1.

    A key that labels marks more than once counts by its highest label, and of several texts of a key the
    smallest counts; nulls don't count, nor do keys without a text. Empty tables, or labels of one class
    only, give a model of the intercept alone. Whole texts are read, however long. About per_class keys of either class are read, chosen by hash, so the join
    broadcasts a bounded table; the class shares come from all labels.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("mark")).where("key IS NOT NULL AND mark IN (0, 1)").groupBy("key").agg(F.max("mark").alias("mark"))
    share = marks.agg(F.avg("mark")).first()[0]
    shares = {r["mark"]: share_below(per_class, r["count"]) for r in marks.groupBy("mark").count().collect()}
    picked = marks.where(below(F.xxhash64("key"), F.when(F.col("mark") == 1, shares.get(1, 0)).otherwise(shares.get(0, 0))))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key").where("text IS NOT NULL")
    texts = texts.groupBy("key", "mark").agg(F.min("text").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [features(t) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(at, pa.list_(pa.int32()))], names=["key", "mark", "at"])

    got = texts.select("key", "mark", "text").mapInArrow(go, "key string, mark int, at array<int>").toArrow().sort_by("key").combine_chunks()
    if not got.num_rows:
        return train([], np.zeros(0), share or 0.5)
    at = got["at"].combine_chunks()
    at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
    flat, ends = at.flatten().to_numpy(), at.value_lengths().to_numpy().cumsum()
    rows = np.split(flat, ends[:-1])
    return train(rows, got["mark"].to_numpy().astype(float), share)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with the probability of label 1 in `out` (double, 0 to 1); every row and column is kept.

    Null texts count as empty; an empty text gets the intercept's probability. Repeated words count
    once, whole texts are read however long, equal texts get equal scores, repeated rows stay, and an
    empty table stays empty. If docs has a column `out`, in any case of letters, it is replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = utf8(b.column(text)), []
            for lo in range(0, len(texts), TOGETHER):
                y = shared.value.raw([features(t) for t in texts[lo : lo + TOGETHER]])
                found.append(1 / (1 + np.exp(-np.clip(y, -500, 500))))
            yield with_columns(b, {out: pa.array(np.concatenate(found) if found else np.zeros(0))})

    return docs.mapInArrow(go, arrow_schema(docs, (out, T.DoubleType())))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    found = score(docs.select("doc_id", held.alias("held_out"), "text"), model, out="score")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
