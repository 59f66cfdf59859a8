"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Every run of ten consecutive words of a benchmark item (the whole item, if it is shorter) is a
pattern. Patterns are word sequences, so the automaton has a node a word, and a document is scanned
once, word by word; stretches of words that no pattern has are stepped over. Hits come back as word
indices and are mapped to code-point offsets of the original text.

The automaton travels to the executors. Its size is counted first. Beyond `max_window_words` the
windows stay a distributed table: a bit filter of fixed size over their hashes tells where a document
may hold one, these places' hashes are joined with the windows', and each batch of documents is scanned
with one automaton over the windows that its own documents may hold. No task then holds more than that.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, arrow_schema, fresh, read_table, tune, utf8, with_columns, written

WINDOW = 10
MAX_WINDOW_WORDS = 1_000_000
#: Bits of the filter over a large benchmark, and how many of them a window sets: 32 MB wherever it goes.
FILTER_BITS, FILTER_HASHES = 1 << 28, 4
#: Words whose hash a worker remembers.
REMEMBERED = 200_000

_ORIGINAL_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS)])
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_built: dict[str, tuple] = {}
_hashes: dict[bytes, int] = {}


def windows(items: DataFrame, text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: (window, words, ids), ids being the distinct non-null item ids, sorted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for body, key in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                w = alnum_words(body)
                n = min(size, len(w))
                found = {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ()
                rows += [(x.decode(), n, key) for x in found]
            yield pa.RecordBatch.from_pylist(
                [{"window": x, "words": n, "id": k} for x, n, k in rows],
                schema=pa.schema([("window", pa.string()), ("words", pa.int32()), ("id", pa.string())]),
            )

    flat = items.select(F.col(text), F.col(item_id).cast("string")).mapInArrow(cut, "window string, words int, id string")
    return flat.groupBy("window", "words").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def automaton(patterns: list[str]) -> tuple:
    """Word numbers, the automaton over them, and the least pattern; a pattern's value is (length, its number)."""
    import ahocorasick

    number: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k, window in enumerate(patterns):
        key = tuple(number.setdefault(w, len(number) + 1) for w in window.encode().split())
        machine.add_word(key, (len(key), k))
    if patterns:
        machine.make_automaton()
    return number, machine, min((x.count(" ") + 1 for x in patterns), default=0)


def scan(words: list[bytes], number: dict[bytes, int], machine, least: int) -> Iterator[tuple[int, int, int]]:
    """(first word, end, pattern) of every occurrence."""
    ids = [number.get(w, 0) for w in words]
    lo, n = 0, len(ids)
    while lo < n:
        if not ids[lo]:
            lo += 1
            continue
        try:
            hi = ids.index(0, lo)
        except ValueError:
            hi = n
        if hi - lo >= least:
            for end, (length, k) in machine.iter(tuple(ids[lo:hi])):
                yield lo + end - length + 1, lo + end + 1, k
        lo = hi


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _marked(body: str | None, raw: bytes, built: tuple, ids: list[list[str]]) -> dict:
    """One text's row of `out`: the automaton's hits as numbers, items and offsets."""
    words = alnum_words(raw)
    spans, seen = [], set()
    if words and ids:
        for s, e, k in scan(words, *built):
            spans.append((s, e))
            seen.add(k)
    places, n_hit = [], 0
    if spans:
        at = [m.span() for m in _ORIGINAL_WORD.finditer(body)]
        for s, e in merged(spans):
            n_hit += e - s
            places.append({"start": at[s][0], "end": at[e - 1][1]})
    return {"n_words": len(words), "n_hit": n_hit, "item_ids": sorted({x for k in seen for x in ids[k]}), "spans": places}


def mark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    size: int = WINDOW,
    max_window_words: int = MAX_WINDOW_WORDS,
    out: str = "hits",
) -> DataFrame:
    """docs with struct(n_words, n_hit, item_ids, spans) in `out`, all rows and columns kept.

    n_hit counts the words inside any occurrence of a window, item_ids lists the items whose windows
    occur (as strings, sorted, distinct), spans are the merged hit stretches as code-point offsets of
    the original text, end exclusive. Null text has no words; items with null ids hit but aren't
    listed; items with equal ids are one item; empty items have no window; an empty benchmark hits
    nothing, and an empty table stays empty. Whole texts are read, however long; repeated rows stay and
    equal texts get equal hits. If docs has a column `out`, in any case of letters, it is replaced.
    """
    spark = docs.sparkSession
    tune(spark)
    found = written(windows(items, item_text, item_id, size), "windows")
    total = found.agg(F.sum("words")).first()[0] or 0
    docs = docs.drop(out)
    if total > max_window_words:
        return _mark_large(docs, found, text, out)
    patterns = [(r["window"], r["ids"]) for r in found.select("window", "ids").orderBy("window").toLocalIterator()]
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, patterns))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, patterns = shared.value
        if key not in _built:
            _built.clear()
            _built[key] = automaton([w for w, _ in patterns]), [x for _, x in patterns]
        built, ids = _built[key]
        for b in batches:
            rows = [_marked(body, raw, built, ids) for body, raw in zip(b.column(text).to_pylist(), utf8(b.column(text)), strict=True)]
            yield with_columns(b, {out: pa.array(rows, _HITS_ARROW)})

    return docs.mapInArrow(go, arrow_schema(docs, (out, _HITS)))


# -- a benchmark too large for one automaton --------------------------------------------------


def rolled(words: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The 64-bit hashes of every run of each size in words."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    known = list(map(_hashes.get, words))
    for i, k in enumerate(known):
        if k is None:
            known[i] = _hashes[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    ids, out = np.array(known, np.uint64), []
    for n in sizes:
        end = max(0, len(ids) - n + 1)
        h = np.full(end, n, np.uint64)
        for k in range(n if end else 0):
            h = (h ^ ids[k : k + end]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return out


def filter_bits(h: np.ndarray) -> Iterator[np.ndarray]:
    """The bits that each hash sets, one array after another."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(FILTER_HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _keys(text: str) -> tuple[Column, Column]:
    return F.xxhash64(text), F.crc32(F.col(text).cast("binary"))


def _mark_large(docs: DataFrame, found: DataFrame, text: str, out: str) -> DataFrame:
    spark = docs.sparkSession
    sizes = sorted(r["words"] for r in found.select("words").distinct().collect())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [int(rolled(w.split(), [n])[0].view(np.int64)[0]) for w, n in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True)]
            yield with_columns(b, {"wh": pa.array(h, pa.int64())})

    named = written(found.select("window", "words", "ids").mapInArrow(hashed, "window string, words int, ids array<string>, wh long"), "hashed")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(list(filter_bits(h))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["slot", "bits"])

    # what reaches the driver is bounded by the filter: a row for each of its words
    made = named.select("wh").mapInArrow(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[made["slot"].to_numpy()] = made["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            hs, cs, ws = [], [], []
            for h, c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                for runs in rolled(alnum_words(raw), sizes):
                    inside = np.ones(len(runs), bool)
                    for at in filter_bits(runs):
                        inside &= (bits[at >> 6] >> (at & 63)) & 1 == 1
                    w = np.unique(runs[inside])
                    hs += [h] * len(w)
                    cs += [c] * len(w)
                    ws.append(w)
            w = (np.concatenate(ws) if ws else np.zeros(0, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(cs, pa.int64()), pa.array(w)], names=["h", "c", "wh"])

    h, c = _keys(text)
    maybe = docs.select(h.alias("h"), c.alias("c"), F.col(text)).mapInArrow(candidates, "h long, c long, wh long").distinct()
    mine = written(maybe, "candidates").join(named, "wh").groupBy("h", "c").agg(F.collect_list(F.struct("window", "ids")).alias("mine"))
    names = [fresh(docs, x) for x in ("hit_h", "hit_c", "hit_windows")]
    mine = written(mine, "per-text").toDF(*names)
    h, c = _keys(text)
    joined = docs.join(mine, (h == F.col(names[0])) & (c == F.col(names[1])), "left").select(*docs.columns, names[2])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, list[str]] = {}
            for row in b.column(b.num_columns - 1).to_pylist():
                held |= {x["window"]: x["ids"] for x in row or ()}
            built, ids = automaton(list(held)), list(held.values())
            texts = b.column(text)
            rows = [_marked(body, raw, built, ids) for body, raw in zip(texts.to_pylist(), utf8(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, _HITS_ARROW)], names=[*b.schema.names[:-1], out])

    return joined.mapInArrow(go, arrow_schema(docs, (out, _HITS)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = mark(docs, read_table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window; the others pass unchanged.

    Null and empty texts hold none and stay, repeated rows share their fate, an empty benchmark drops
    nothing, and an empty table stays empty.
    """
    out = fresh(docs, "hits")
    marked = mark(docs, read_table(spark, sf_dir, "benchmark"), out=out)
    return marked.where(F.col(f"{out}.n_hit") == 0).select(*docs.columns)


def digest(ids: list[str]) -> str:
    """What items_sha256 holds for these ids."""
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = WINDOW) -> dict:
    """The same result by trying every window at every place."""
    cut: dict[tuple, set[str]] = defaultdict(set)
    for key, body in items:
        w = alnum_words((body or "").encode())
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            cut[tuple(w[i : i + n])] |= {str(key)} if key is not None else set()
    out = {}
    for key, body in docs:
        w, hit, ids = alnum_words((body or "").encode()), set(), set()
        for n in {len(x) for x in cut}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in cut:
                    hit |= set(range(i, i + n))
                    ids |= cut[k]
        out[key] = (len(w), len(hit), len(ids), digest(list(ids)), bool(hit))
    return out


SQL9 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
