"""Language identification by nearest centroid.

A text becomes a vector of hashed character bigrams and trigrams, weighted by TF-IDF and scaled to
length 1. Each language has several centroids, found by spherical k-means on a bounded sample of its
labelled rows (`per_label`, a parameter); the language of the nearest centroid by cosine is the
prediction. Document frequencies cover all labelled rows, and so do the distances that set each
language's rejection cutoff. The model is a few fixed-size arrays a language, whatever the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, below, crc_mod, discard, fresh, place, read_table, released, share_below, shuffle_parts, tune, with_columns, written
from .graph import sorted_groups

BUCKETS = 8192
CENTROIDS = 4
PER_LABEL = 400
#: A text is rejected if its log-cosine lies so many deviations under its language's mean, and its
#: cosine isn't so many times what its grams would have if dealt to buckets at random.
REJECT_AT, ABOVE_CHANCE = 4.0, 3.0
#: How sharply differences of cosine turn into a score.
SHARPNESS = 25.0
#: Texts are turned into vectors in groups of at most so many rows and code points.
GROUP_ROWS, GROUP_POINTS = 64, 400_000

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    start, group, total = 0, [], 0
    for i, t in enumerate(texts):
        points = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if group and (len(group) >= GROUP_ROWS or total + len(points) > GROUP_POINTS):
            yield start, group
            start, group, total = i, [], 0
        group.append(points)
        total += len(points)
    if group:
        yield start, group


def counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, gram counts, whether there is a letter) of one group of rows after another."""
    known = letters()
    for start, group in _groups(texts):
        if len(group) == 1 and len(group[0]) > 2 * GROUP_POINTS:
            yield start, *_long(group[0], known)
            continue
        n = len(group)
        sizes = np.fromiter(map(len, group), np.int64, n)
        if not sizes.sum():
            yield start, np.zeros((n, BUCKETS), np.float32), np.zeros(n, bool)
            continue
        a = np.concatenate(group)
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        yield start, *_counted(a, row, n, known)


def _counted(a: np.ndarray, row: np.ndarray, n: int, known: np.ndarray, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts and letters of n rows of code points; only grams that begin before a place, if one is given."""
    letter = known[a]
    some = np.bincount(row, letter, n) > 0
    a = np.where(letter, a, np.uint32(32))
    grams = []
    for size, seed in ((2, 0x1B873593), (3, 0xCC9E2D51)):
        if len(a) < size:
            continue
        end = len(a) - size + 1
        h = np.full(end, seed, np.uint32)
        for k in range(size):
            h = (h ^ a[k : k + end]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = (row[:end] == row[size - 1 :]) & (letter[:end] | letter[size - 1 :])
        grams.append((row[:end].astype(np.int64) * BUCKETS + (h >> np.uint32(19)))[:before][inside[:before]])
    flat = np.bincount(np.concatenate(grams), minlength=n * BUCKETS) if grams else np.zeros(n * BUCKETS)
    return flat.reshape(n, BUCKETS).astype(np.float32), some


def _long(a: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long text, piece by piece; pieces overlap by what a trigram needs."""
    tf, some = np.zeros((1, BUCKETS), np.float32), np.zeros(1, bool)
    for at in range(0, len(a), GROUP_POINTS):
        piece = a[at : at + GROUP_POINTS + 2]
        t, s = _counted(piece, np.zeros(len(piece), np.int32), 1, known, GROUP_POINTS)
        tf, some = tf + t, some | s
    return tf, some


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(tf) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


@dataclass
class Model:
    """labels[k] is the label of centroid row k; cutoffs: the least cosine by label."""

    labels: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    cutoffs: dict[str, float] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; fewer centroids if rows coincide."""
    seeds = [x.mean(0)]
    for _ in range(k):
        seeds.append(x[int(np.argmin(np.max(x @ np.array(seeds).T, axis=1)))])
    c = np.array(seeds[1:])
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].sum(0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_label: int = PER_LABEL, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows of docs whose text and label aren't null.

    The centroids come from about per_label distinct texts with a letter a label (chosen by text hash,
    all of a smaller label, one at least), the document frequencies from all rows. Every label is
    learned, each in a task of its own; the model takes 32 KB a centroid. Repeated rows count towards the
    frequencies; an empty table, or one without labels, gives a model without centroids.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            ok = []
            for start, tf, some in counts(b.column(0).to_pylist()):
                df += (tf > 0).sum(0)
                n += len(tf)
                ok.append(start + np.flatnonzero(some))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *ok]))
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, b.column(1).take(at), b.column(2).take(at)], names=["bucket", "df", "label", "h"])
        none = pa.nulls(BUCKETS + 1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], df])), none.cast(pa.string()), none], names=["bucket", "df", "label", "h"])

    hashed = rows.withColumn("h", F.xxhash64("text"))
    seen = written(hashed.select("text", "label", "h").mapInArrow(frequencies, "bucket long, df long, label string, h long"), "frequencies")
    df = np.zeros(BUCKETS + 1)
    for r in seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"] + 1] = r["df"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    distinct = seen.where("label IS NOT NULL").select("label", "h").distinct()
    each = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.min(place(F.col("h"))).alias("least")).collect()
    discard(seen)
    # a label's share of hash values passes, so that about per_label distinct texts do, whatever their copies, and the smallest
    # hash always does: no ranking, and equal texts pass together
    shares = docs.sparkSession.createDataFrame([(r["label"], max(share_below(per_label, r["texts"]), r["least"] + 1)) for r in each], "label string, below long")
    hashed = hashed.join(F.broadcast(shares), "label").where(below(F.col("h"), F.col("below")))
    picked = hashed.groupBy("label", "h").agg(F.min("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, tf, some in counts(b.column(0).to_pylist()):
                ok = np.flatnonzero(some)
                at = [np.flatnonzero(tf[i]).astype(np.int32) for i in ok]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(pa.array(start + ok)) for k in (1, 2)), pa.array(at, pa.list_(pa.int32())), pa.array([tf[i][j] for i, j in zip(ok, at, strict=True)], pa.list_(pa.float32()))],
                    names=["label", "h", "at", "tf"],
                )

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), t in sorted_groups(batches, 1):
            x = np.zeros((t.num_rows, BUCKETS), np.float32)
            start = 0
            for b in t.to_batches():
                row = start + np.repeat(np.arange(b.num_rows), b["at"].value_lengths().to_numpy())
                x[row, b["at"].flatten().to_numpy()] = b["tf"].flatten().to_numpy()
                start += b.num_rows
            c = cluster(vectors(x, idf), centroids).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(range(len(c)), pa.int32()), pa.array([y.tobytes() for y in c], pa.binary())], names=["label", "nth", "centroid"])

    sampled = picked.select("text", "label", "h").mapInArrow(sparse, "label string, h long, at array<int>, tf array<float>")
    sampled = sampled.repartition(shuffle_parts(docs.sparkSession), "label").sortWithinPartitions("label", "h")
    got = sorted(sampled.mapInArrow(learned, "label string, nth int, centroid binary").collect(), key=lambda r: (r["label"], r["nth"]))
    names, parts = [r["label"] for r in got], [np.frombuffer(r["centroid"], np.float32) for r in got]
    return Model(names, np.array(parts) if parts else np.zeros((0, BUCKETS), np.float32), idf)


def classify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """docs with struct(pred, score, cosine, chance) in `out`; every row and column is kept.

    pred is the label of the nearest centroid, `und` where text is null or has no letter (or nothing
    was learned); score the share that label's cosine has among all labels', sharpened; chance the
    cosine that as many grams dealt at random would have; the numbers are 0 for `und`. A tie goes to the
    label that sorts first. Whole texts count, very long ones piece by piece; repeated rows stay, and an
    empty table stays empty. If docs has a column `out`, in any case of letters, it is replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("pred", pa.string()), ("score", pa.float64()), ("cosine", pa.float64()), ("chance", pa.float64())])
    nothing = {"pred": "und", "score": 0.0, "cosine": 0.0, "chance": 0.0}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = sorted(set(m.labels))
        mean = m.centroids.mean(1) if names else None
        places: dict[str, list[int]] = {}
        for i, n in enumerate(m.labels):
            places.setdefault(n, []).append(i)
        own = [np.array(places[n]) for n in names]
        for b in batches:
            rows = []
            for _, tf, some in counts(b.column(text).to_pylist()):
                if not names:
                    rows += [nothing] * len(tf)
                    continue
                x = vectors(tf, m.idf)
                cos = x @ m.centroids.T
                chance = x.sum(1) * mean[cos.argmax(1)]
                best = np.stack([cos[:, k].max(1) for k in own], axis=1).astype(np.float64)
                top = best.argmax(1)
                near = best[np.arange(len(top)), top]
                share = 1 / np.exp(SHARPNESS * (best - near[:, None])).sum(1)
                for k, s, c, r, ok in zip(top, share, near, chance, some, strict=True):
                    rows.append({"pred": names[k], "score": float(s), "cosine": min(1.0, float(c)), "chance": float(r)} if ok else nothing)
            yield with_columns(b, {out: pa.array(rows, kind)})

    made = T.StructType([T.StructField("pred", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("score", "cosine", "chance"))])
    return docs.mapInArrow(released(go), arrow_schema(docs, (out, made)))


def cutoffs(found: DataFrame, out: str = "language", at: float = REJECT_AT) -> dict[str, float]:
    """By predicted label the cosine under which a text is far: from the mean and deviation of log-cosine over all rows given.

    Give rows that may be learned from. A label that none of them is predicted to have rejects nothing.
    """
    lc = F.log(F.greatest(F.col(f"{out}.cosine"), F.lit(1e-6)))
    stats = found.where(F.col(f"{out}.pred") != "und").groupBy(F.col(f"{out}.pred").alias("label")).agg(F.avg(lc).alias("mean"), F.coalesce(F.stddev_pop(lc), F.lit(0.0)).alias("dev")).collect()
    return {r["label"]: float(np.exp(r["mean"] - at * max(r["dev"], 0.1))) for r in stats}


def rejected(cut: dict[str, float], out: str = "language") -> Column:
    """Whether a classified row has no language: no letter, or too far from every centroid."""
    far = F.lit(False)
    for label, least in sorted(cut.items()):
        far = far | ((F.col(f"{out}.pred") == label) & (F.col(f"{out}.cosine") < least))
    return (F.col(f"{out}.pred") == "und") | (far & (F.col(f"{out}.cosine") < F.col(f"{out}.chance") * ABOVE_CHANCE))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held))
    taught = ~held & F.col("lang").isNotNull()
    found = written(classify(docs.select("doc_id", "text", held.alias("held_out"), taught.alias("taught")), model).drop("text"), "language")
    cut = cutoffs(found.where("taught"))
    return found.select("doc_id", "held_out", F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.cosine").alias("cosine"), F.col("language.chance").alias("chance"), rejected(cut).alias("rejected"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: those with a letter that aren't far from every centroid.

    Null, empty and letterless texts go, repeated rows share their fate, and an empty table stays empty.
    Without any labelled row only what has no letter is told and goes. Columns and their names stay.
    """
    out = fresh(docs, "language")
    model = fit(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # the cutoffs need all distances first; classifying twice is cheaper than storing the texts in between
    cut = cutoffs(classify(docs.where("lang IS NOT NULL").select("text"), model, out=out), out)
    return classify(docs, model, out=out).where(~rejected(cut, out)).select(*docs.columns)
