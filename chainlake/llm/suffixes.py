"""Exact removal of repeated 200-byte strings by a run-length suffix index.

Every 200-byte window of a text is dealt to its minimizer, the 32-byte string in it with the smallest
hash; consecutive windows with one minimizer make a segment. Equal windows have equal minimizers, so
they meet in the same anchor group wherever they are, and only anchors that occur twice go on.

Segments that occur twice as a whole, by two 64-bit hashes (of the anchor and of the segment), are folded
to one with a count: all their windows repeat. For anchors with several different segments a suffix index
over the segments is built, group by group: suffix order by rank doubling, the Burrows-Wheeler transform
run-compressed, and samples kept at run heads and ends only. Longest matches are computed at the samples
and streamed through the text: a position inside a run matches one byte less than the position before it.
Windows whose matching statistic, with the suffix before or after, is 200 or more repeat. Repetitive
segments make long runs, so few samples are compared.

A large group (one string in a great many contexts) is dealt anew before it is indexed: windows that hold
the anchor at nearly the same place share 167 bytes, and segments meet by those. A string of 167 bytes in
more contexts than a group may have is left to counting: its windows meet by their own 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, lookup, read_table, shuffle_parts, tune, utf8, written
from .graph import sorted_groups

LENGTH, SEED = 200, 32
#: Bytes of texts taken together and of segments indexed together; bytes and segments of one group at most.
BATCH_BYTES, INDEX_BYTES, GROUP_BYTES, GROUP_ROWS = 1 << 20, 1 << 20, 4 << 20, 1000
REACH = 34
#: Texts whose hash a task remembers, to cut copies once.
REMEMBERED = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + 1024)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, anchor, segment hash, anchor's place) of the segments of texts, one batch after another.

    A text is cut where a batch is full; a cut segment is another segment, so nothing depends on it.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= LENGTH:
            piece = t[at : at + BATCH_BYTES]
            if size + len(piece) > BATCH_BYTES and parts:
                yield _segments(parts)
                parts, size = [], 0
            parts.append((i, at, piece))
            size += len(piece)
            at += max(1, len(piece) - LENGTH + 1)
    if parts:
        yield _segments(parts)


def _segments(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    a = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    n = len(a)
    power, inverse = _power(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:n])])
    seeds = _mix((sums[SEED:] - sums[:-SEED]) * inverse[: n - SEED + 1])
    bits = np.uint64(23)
    key = ((seeds >> bits) << bits) | np.arange(len(seeds), dtype=np.uint64)
    width, have, least = LENGTH - SEED + 1, 1, key
    while have * 2 <= width:  # minima of 2, 4, ... neighbours
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (width - have)], least[width - have :])  # one for each window
    anchor_at = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor_at)]
    inside = np.flatnonzero(np.arange(len(anchor_at)) + LENGTH <= ends[part])
    at, own = anchor_at[inside], part[inside]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
    first = inside[cut]
    count = np.diff(np.concatenate([cut, [len(inside)]]))
    stop = first + count + LENGTH - 1
    whole = _mix((sums[stop] - sums[first]) * inverse[first] + (at[cut] - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64))
    p = part[first]
    text = np.array([i for i, _, _ in parts])[p]
    offset = first - (ends - sizes)[p] + np.array([o for _, o, _ in parts])[p]
    return text, offset, count, seeds[at[cut]].view(np.int64), whole.view(np.int64), at[cut] - first


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, text) to the segments of each text, equal ones folded: (h, c, anchor, segment, n)."""
    for b in batches:
        texts = utf8(b.column(2))
        h, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        for text, _, _, anchor, segment, _ in segments(texts):
            order = np.lexsort((segment, anchor, text))
            t, a, s = text[order], anchor[order], segment[order]
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
            n = np.diff(np.concatenate([new, [len(t)]]))
            yield pa.RecordBatch.from_arrays([pa.array(h[t[new]]), pa.array(c[t[new]]), pa.array(a[new]), pa.array(s[new]), pa.array(n)], names=["h", "c", "anchor", "segment", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted) to (anchor, segment, bytes, seed) of the wanted segments; seed is the anchor's place in them."""
    for b in batches:
        texts = utf8(b.column(0))
        wanted = [{(x["anchor"], x["segment"]) for x in w} for w in b.column(1).to_pylist()]
        rows = []
        for text, offset, count, anchor, segment, seed in segments(texts):
            for t, o, n, key, at in zip(text.tolist(), offset.tolist(), count.tolist(), zip(anchor.tolist(), segment.tolist(), strict=True), seed.tolist(), strict=True):
                if key in wanted[t]:
                    wanted[t].discard(key)
                    rows.append((*key, texts[t][o : o + n + LENGTH - 1], at))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["anchor", "segment", "bytes", "seed"])


# -- the index --------------------------------------------------------------------------------


def suffix_order(sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of all strings in suffix order; sym holds bytes plus 1, ends the end of each position's string.

    A string's end sorts before any byte. Equal suffixes of different strings stay in place order.
    """
    n = len(sym)
    at, ends = np.arange(n, dtype=np.int32), ends.astype(np.int32)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key |= np.where(at + k < ends, sym[np.minimum(at + k, n - 1)], 0)
    rank = _ranked(key)
    step, most = 7, int((ends - at).max(initial=0))
    while step < most and rank.max() < n:
        key[:] = rank
        key <<= 32
        key |= np.where(at + step < ends, rank[np.minimum(at + step, n - 1)], 0)
        rank = _ranked(key)
        step *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


def _ranked(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys."""
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]), dtype=np.int32)
    return rank


def common(a: np.ndarray, i: np.ndarray, j: np.ndarray, ends: np.ndarray, step: int = 32, slice_: int = 50_000) -> np.ndarray:
    """How many bytes the suffixes at i and j share, within their strings; some pairs at a time."""
    if len(i) > slice_:
        return np.concatenate([common(a, i[k : k + slice_], j[k : k + slice_], ends, step) for k in range(0, len(i), slice_)])
    room = np.minimum(ends[i] - i, ends[j] - j)
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(room > 0)
    reach = np.arange(step)
    while len(live):
        p, q = (i[live] + out[live])[:, None] + reach, (j[live] + out[live])[:, None] + reach
        same = (a[np.minimum(p, len(a) - 1)] == a[np.minimum(q, len(a) - 1)]) & (reach < (room[live] - out[live])[:, None])
        got = np.where(same.all(1), step, same.argmin(1))
        out[live] += got
        live = live[got == step]
    return out


def matching(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Matching statistics of all positions of the strings, where each string starts, and the runs of the transform.

    The statistic of a position is the longest match its suffix has at any other position.
    """
    sizes = np.array([len(s) for s in strings])
    stops = np.cumsum(sizes)
    a = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.repeat(stops, sizes).astype(np.int32)
    starts = stops - sizes
    order = suffix_order(a.astype(np.int16) + np.int16(1), ends)
    # the transform: the byte before each suffix; a string's start has none and equals no other
    n = len(a)
    before = np.concatenate([[0], a[:-1]]).astype(np.int32)
    before[starts] = -1 - np.arange(len(strings))
    bwt = before[order]
    edge = np.flatnonzero(bwt[1:] != bwt[:-1]).astype(np.int32)  # a run ends at edge, the next begins at edge + 1
    del before, bwt
    best, place = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    shared = common(a, order[edge], order[edge + 1], ends).astype(np.int32)
    for sample, first_or_last in ((order[edge + 1], order[0]), (order[edge], order[-1])):
        held = np.full(n, -1, np.int32)  # at run heads the match with the suffix before, at run ends with the one after
        held[sample] = shared
        held[first_or_last] = 0
        last = np.maximum.accumulate(np.where(held >= 0, place, -1))
        best = np.maximum(best, held[last] - (place - last))
    return best, starts, len(edge) + 1


def _runs(mask: np.ndarray) -> list[int]:
    """Starts and ends of the true stretches, one after another."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], axis=1).ravel().tolist()


def strips(anchor: int, s: bytes, at: int) -> Iterator[tuple[int, int]]:
    """(x, hash) of the strings that a segment's windows share with whatever holds one of them.

    A window reaches x bytes to the left of its anchor (at `at`) and LENGTH - SEED - x to the right of it.
    For x in a stretch of REACH values it holds what the least x gives on the left and the greatest on the
    right: segments of one anchor that share a window share that string, for one of a few stretches.
    """
    for x in range(0, LENGTH - SEED + 1, REACH):
        right = at + SEED + max(0, LENGTH - SEED - x - REACH + 1)
        if at >= x and right <= len(s):
            yield x, xxhash.xxh3_64_intdigest(s[at - x : right] + anchor.to_bytes(8, "little", signed=True), seed=x) - (1 << 63)


def promising(held: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, bytes, int]]:
    """The segments (anchor, segment, bytes, place of the anchor) that may share a window with another of their anchor."""
    seen: dict[tuple, list[int]] = defaultdict(list)
    for k, (anchor, _, s, at) in enumerate(held):
        for key in strips(anchor, s, at):
            seen[key].append(k)
    good = {k for ks in seen.values() if len(ks) > 1 for k in ks}
    return [held[k] for k in sorted(good)]


_MARKED = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("windows", pa.list_(pa.int64()))])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, anchor, segment, bytes, seed), sorted by group, to (anchor, segment, windows): runs of windows that repeat."""
    held: list[tuple[int, int, bytes, int]] = []
    size = 0

    def index() -> pa.RecordBatch:
        held[:] = promising(held)
        best, starts, _ = matching([x[2] for x in held]) if held else (np.zeros(0), np.zeros(0, np.int64), 0)
        rows = []
        for (anchor, segment, s, _), at in zip(held, starts.tolist(), strict=True):
            runs = _runs(best[at : at + len(s) - LENGTH + 1] >= LENGTH)
            if runs:
                rows.append((anchor, segment, runs))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MARKED)], schema=_MARKED)

    for _, t in sorted_groups(batches, 1):
        held += zip(*(t[c].to_pylist() for c in ("anchor", "segment", "bytes", "seed")), strict=True)
        size += sum(len(x[2]) for x in held[-t.num_rows :])
        if size >= INDEX_BYTES:
            yield index()
            size = 0
    if held:
        yield index()


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, segment, bytes, seed) to a row for each strip: (anchor, segment, x, strip)."""
    for b in batches:
        rows = [(anchor, segment, x, strip) for anchor, segment, s, at in zip(*(c.to_pylist() for c in b.columns), strict=True) for x, strip in strips(anchor, s, at)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["anchor", "segment", "x", "strip"])


def _hashed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, segment, bytes, seed, x) to a row for each window of stretch x: (anchor, segment, at, window), window being a hash."""
    for b in batches:
        for anchor, segment, s, seed, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lo, hi = max(0, seed - x - REACH + 1), min(len(s) - LENGTH, seed - x)
            n = max(0, hi - lo + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, anchor)), pa.array(np.full(n, segment)), pa.array(np.arange(lo, lo + n)), pa.array([xxhash.xxh3_128_digest(s[i : i + LENGTH]) for i in range(lo, lo + n)], pa.binary())],
                names=["anchor", "segment", "at", "window"],
            )


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, text) without those that a task has passed on already, as far as it remembers."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        if len(seen) > REMEMBERED:
            seen.clear()
        keep = []
        for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64())) if len(keep) < b.num_rows else b


def _joined_runs(at: list[int]) -> list[int]:
    mask = np.zeros(max(at) + 1, bool)
    mask[at] = True
    return _runs(mask)


def _crowded(cut: DataFrame, parts: int, group_rows: int) -> DataFrame:
    """Marks of segments whose anchors have too many of them for one index."""
    kinds = "anchor long, segment long"
    found = written(cut.select("anchor", "segment", "bytes", "seed").mapInArrow(_stripped, f"{kinds}, x long, strip long"), "strips")
    sizes = written(found.groupBy("strip").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "strip-sizes")
    met = written(found.join(lookup(sizes), "strip").join(cut, ["anchor", "segment"]).select("strip", "anchor", "segment", "bytes", "seed", "x", "n"), "strip-members")
    few = met.where(F.col("n") <= group_rows).select("strip", "anchor", "segment", "bytes", "seed")
    indexed = few.repartition(parts, "strip").sortWithinPartitions("strip", "anchor", "segment").mapInArrow(_repeats, f"{kinds}, windows array<long>")
    windows = written(met.where(F.col("n") > group_rows).select("anchor", "segment", "bytes", "seed", "x").mapInArrow(_hashed_windows, f"{kinds}, at long, window binary"), "windows")
    again = written(windows.groupBy("window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("window"), "again")
    at = windows.join(lookup(again), "window").groupBy("anchor", "segment").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([_joined_runs(x) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))], names=["anchor", "segment", "windows"])

    return indexed.unionByName(at.mapInArrow(runs, f"{kinds}, windows array<long>"))


def repeated(docs: DataFrame, text: str, group_bytes: int = GROUP_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(h, c, marks) for each text of docs with repeated windows: marks are array of struct(anchor, segment, windows).

    h and c are hashes of the text (64 and 32 bits); windows is null if all windows of the segment repeat.
    A segment may come several times, with different windows.
    """
    spark = docs.sparkSession
    tune(spark)
    parts = shuffle_parts(spark)
    base = docs.select(*_key(text), F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH)
    folded = written(base.mapInArrow(_folded, "h long, c long, anchor long, segment long, n long"), "folded")
    twice = folded.groupBy("anchor").agg(F.sum("n").alias("total"), (F.min("segment") != F.max("segment")).alias("mixed")).where("total > 1").select("anchor", "mixed")
    # copies of a text are one row here
    occurs = folded.join(twice, "anchor").groupBy("h", "c", "anchor", "segment").agg(F.sum("n").alias("n"), F.max("mixed").alias("mixed"))
    occurs = written(occurs, "occurrences")
    discard(folded)
    distinct = occurs.groupBy("anchor", "segment").agg(F.sum("n").alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("h", "c")).alias("of"))
    distinct = written(distinct, "distinct")

    wanted = distinct.where("mixed").groupBy(F.col("of.h").alias("wh"), F.col("of.c").alias("wc")).agg(F.collect_list(F.struct("anchor", "segment")).alias("wanted"))
    # a task passes each text on once, so a text of very many copies is a row a task, not a row a copy
    once = base.mapInArrow(_first_of_each, base.schema)
    texts = once.join(wanted, (F.col("h") == F.col("wh")) & (F.col("c") == F.col("wc"))).select("text", "wanted")
    cut = written(texts.mapInArrow(_cut, "anchor long, segment long, bytes binary, seed long").dropDuplicates(["anchor", "segment"]), "segments")
    sizes = cut.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("size"), F.count(F.lit(1)).alias("n"))
    large = written(sizes.where((F.col("size") > group_bytes) | (F.col("n") > group_rows)).select("anchor"), "large")
    some = large.limit(1).count() > 0
    usual = cut.join(lookup(large), "anchor", "left_anti") if some else cut
    usual = usual.select(F.col("anchor").alias("group"), "anchor", "segment", "bytes", "seed")
    indexed = usual.repartition(parts, "group").sortWithinPartitions("group", "segment").mapInArrow(_repeats, "anchor long, segment long, windows array<long>")
    if some:
        indexed = indexed.unionByName(_crowded(written(cut.join(lookup(large), "anchor", "left_semi"), "crowded"), parts, group_rows))
    whole = distinct.where("n > 1").select("anchor", "segment", F.lit(None).cast("array<long>").alias("windows"))
    single = distinct.where("n = 1 AND mixed").select("anchor", "segment")
    marks = written(whole.unionByName(indexed.join(single, ["anchor", "segment"])), "marks")
    return occurs.select("h", "c", "anchor", "segment").join(marks, ["anchor", "segment"]).groupBy("h", "c").agg(F.collect_list(F.struct("anchor", "segment", "windows")).alias("marks"))


def _key(text: str):
    return F.xxhash64(text).alias("h"), F.crc32(F.col(text).cast("binary")).alias("c")


def _by_segment(marks: Iterable[dict]) -> dict[tuple[int, int], list[int] | None]:
    """Runs of repeated windows by segment; None if all repeat. A segment's runs from several groups are put together."""
    out: dict[tuple[int, int], list[int] | None] = {}
    for x in marks:
        key, runs = (x["anchor"], x["segment"]), x["windows"]
        before = out.get(key, [])
        out[key] = None if runs is None or before is None else before + runs
    return out


def covered(texts: list[bytes], marks: list[dict[tuple[int, int], list[int] | None]]) -> list[np.ndarray]:
    """For each text which of its bytes lie in a repeated window."""
    edges = [np.zeros(len(t) + 1, np.int32) if m else None for t, m in zip(texts, marks, strict=True)]
    for text, offset, count, anchor, segment, _ in segments([t if m else b"" for t, m in zip(texts, marks, strict=True)]):
        for t, o, n, key in zip(text.tolist(), offset.tolist(), count.tolist(), zip(anchor.tolist(), segment.tolist(), strict=True), strict=True):
            if key in marks[t]:
                runs = marks[t][key]
                for lo, hi in [(0, n)] if runs is None else zip(runs[::2], runs[1::2], strict=True):
                    edges[t][o + lo] += 1
                    edges[t][o + hi + LENGTH - 1] -= 1
    return [np.zeros(len(t), bool) if e is None else np.cumsum(e[:-1]) > 0 for t, e in zip(texts, edges, strict=True)]


def strip(docs: DataFrame, text: str = "text", out: str = "dedup", group_bytes: int = GROUP_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs with struct(n_bytes, spans, kept) in `out`; every row and column is kept.

    spans: array of struct(start, end), the maximal stretches of bytes covered by 200-byte strings that
    also start elsewhere in the table, kept: the remaining bytes (binary: a cut may split a character).
    Null counts as empty; texts under 200 bytes keep everything; repeated rows repeat each other. Whole
    texts are read, however long; an empty table stays empty. If docs has a column `out`, in any case of
    letters, it is replaced.
    """
    docs = docs.drop(out)
    names = [fresh(docs, x) for x in ("dedup_h", "dedup_c", "dedup_marks")]
    marks = written(repeated(docs, text, group_bytes, group_rows), "marked").toDF(*names)
    h, c = _key(text)
    on = (h == F.col(names[0])) & (c == F.col(names[1]))
    joined = docs.join(marks, on, "left").select(*docs.columns, names[2])
    kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                texts = utf8(b.column(text))
                mine = [_by_segment(m or ()) for m in b.column(b.num_columns - 1).to_pylist()]
                rows = []
                for t, gone in zip(texts, covered(texts, mine), strict=True):
                    runs = _runs(gone)
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if runs else t
                    rows.append({"n_bytes": len(t), "spans": [{"start": s, "end": e} for s, e in zip(runs[::2], runs[1::2], strict=True)], "kept": kept})
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, kind)], names=[*b.schema.names[:-1], out])

    made = T.StructType.fromDDL("n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return joined.mapInArrow(go, T.StructType([*docs.schema.fields, T.StructField(out, made)]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings removed from every document."""
    found = strip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.col("dedup.kept")
    return found.select(
        "doc_id",
        F.col("dedup.n_bytes").alias("n_bytes"),
        (F.col("dedup.n_bytes") - F.length(kept)).cast("long").alias("n_removed"),
        F.size("dedup.spans").cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def brute(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same result by counting every window."""
    texts = {k: (t or "").encode() for k, t in docs}
    n: dict[bytes, int] = defaultdict(int)
    for t in texts.values():
        for i in range(len(t) - length + 1):
            n[t[i : i + length]] += 1
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[k] = (len(t), int(gone.sum()), len(_runs(gone)) // 2, hashlib.sha256(kept).hexdigest())
    return out


SQL10 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
g AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w SEMI JOIN g USING (k)),
b AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
x AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM b GROUP BY r, run),
y AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS before FROM x),
z AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head, max(e) AS last, sum(e - s) AS removed, count(*) AS spans FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN z.r IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""
