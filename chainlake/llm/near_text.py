"""Near-duplicate texts by MinHash and a signature-coordinate inverted join.

Texts with the same set of 5-word shingles are one class. A class has H min-hashes; each
(coordinate, value) pair is a token, and two classes can only be linked if they share at least M of
their H tokens (at the least similarity linked, sharing fewer has a chance of 1e-5 at most).

Prefix: tokens are ordered by how many classes have them; two classes that share M tokens share one
of the H - M + 1 rarest of either. So only that prefix is posted, and tokens that one class alone has
(most of them) fill it without being posted at all. A passage that many documents hold makes common
tokens, which come last: it posts nothing. Skip: in a posting list only pairs whose sizes allow the
similarity, that collide in M coordinates, and whose classes the list hasn't joined yet go on. Each
list leaves a spanning forest, never all its pairs.

The forests' components are candidate groups. Their whole shingle sets are then compared exactly,
skipping pairs that are already connected, which leaves the components exact as well.

Long lists and groups are compared block by block, then by one class of each of their components, and
then only the classes outside a list's main component with all the others: a template with very many
near copies, which its blocks' representatives join into one component, is not compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, lookup, read_table, released, space_words, tune, utf8, written
from .graph import Forest, components, sorted_groups

WORDS = 5
HASHES = 64
#: Linked if so many percent of the union are shared at least, and so many min-hashes collide: op7's, and the pipeline stage's.
PERCENT, LEAST_SHARED = 85, 40
STAGE_PERCENT, STAGE_LEAST_SHARED = 80, 35
#: Members and bytes of a block of a posting list or candidate group.
BLOCK, BLOCK_BYTES = 1000, 32 << 20
#: Rows that a task is worth where groups have become few.
TASK_ROWS = 100
REMEMBERED = 150_000

_ids: dict[bytes, int] = {}
_MULTIPLIERS = np.random.default_rng(20240131).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, ascending; a shorter text is one shingle."""
    if len(_ids) > REMEMBERED:
        _ids.clear()
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    known = list(map(_ids.get, words))
    for i, k in enumerate(known):
        if k is None:
            known[i] = _ids[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    ids = np.array(known, np.uint64)
    n = min(size, len(ids))
    end = len(ids) - n + 1
    h = np.full(end, n, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + end]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def tokens(s: np.ndarray) -> np.ndarray:
    """Coordinate and value of each min-hash, in one number."""
    least = np.array([(s * a).min() for a in _MULTIPLIERS]) >> np.uint64(32)
    return (least | (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))).astype(np.int64)


def signatures(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The keys with n_shingles, cls (a hash of the whole set; null if empty) and the tokens."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, tok = [], [], []
            for t in utf8(b.column(b.num_columns - 1)):
                s = shingles(t)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tok.append(tokens(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(tok, pa.list_(pa.int64()))],
                names=[*keys, "n_shingles", "cls", "tokens"],
            )

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(released(go), f"{kinds}, n_shingles long, cls binary, tokens array<long>")


def in_blocks(members: DataFrame, group: str, parts: int, most: int | None = None) -> DataFrame:
    """members once for each pair of blocks of its group that it takes part in, sorted by group and pair: all pairs, for exact counts.

    Adds block columns x <= y and mine (the member's own block, of some most members). A group of one block comes once.
    """
    size = F.ceil(F.count(F.lit(1)) / (most or BLOCK))
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("members"), size.cast("int").alias("blocks")).where("members > 1").drop("members")
    m = members.join(sizes, group).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("other", "blocks")
    keys = [group, "x", "y"]
    rest = [c for c in m.columns if c not in keys]
    return m.select(*keys, *rest).repartition(parts, *keys).sortWithinPartitions(*keys)


def forests(members: DataFrame, group: str, parts: int, compare: Callable, columns: Sequence[str], bytes_of: str | None = None) -> DataFrame:
    """Edges (grp, a, b) between classes: as many as join all that compare links, directly or not.

    members (group, cls and what compare reads) is a table. compare takes rows (group, x, y, cls, ...,
    mine, root), sorted by group and block pair x <= y, and links the pairs of one block, or those across
    two, whose roots differ; it gives an edge for each join of two components in its block pair, with the
    root that is one no more as b. Groups of one block are compared at once. Of larger ones each block is
    compared by itself; then the roots that are left stand for their components, and these are compared in
    the same way, as long as they get fewer; at last the classes outside the largest component of their
    group are compared with all others, as nothing less is exact.
    """
    every = ["x", "y", *columns, "mine", "root"]

    def size(of: Column) -> Column:
        """Blocks for the rows of a group that `of` is true of."""
        n = F.ceil(F.count_if(of) / BLOCK)
        return (F.greatest(n, F.ceil(F.sum(F.when(of, F.col(bytes_of))) / BLOCK_BYTES)) if bytes_of else n).cast("int")

    def tasks(rows: int) -> int:
        return min(parts, 1 + rows // TASK_ROWS)

    def compared(rows: DataFrame, most: int = parts) -> DataFrame:
        dealt = rows.select(group, *every).repartition(parts, group, "x", "y").coalesce(most).sortWithinPartitions(group, "x", "y")
        return dealt.mapInArrow(released(compare), f"grp {members.schema[group].dataType.simpleString()}, a binary, b binary")

    def alone(rows: DataFrame, number: Column) -> DataFrame:
        return rows.select("*", number.alias("x"), number.alias("y"), number.alias("mine"))

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("cls"), F.col(of)).cast("int")

    everything = F.lit(True)
    large = lookup(written(members.groupBy(group).agg(size(everything).alias("blocks")).where("blocks > 1"), "large"))
    small = members.join(large, group, "left_anti").withColumn("root", F.col("cls"))
    edges = written(compared(alone(small, F.lit(0))), "near")
    if not large.limit(1).count():
        return edges
    whole = written(members.join(large, group).withColumn("root", F.col("cls")), "whole")
    level, left = whole, whole.count()
    while True:
        found = written(compared(alone(level, block("blocks")), tasks(left)), "near")
        edges = edges.unionByName(found)
        joined = found.select(F.col("grp").alias(group), F.col("b").alias("cls"))
        roots = written(level.drop("blocks").join(lookup(joined, found.count()), [group, "cls"], "left_anti"), "roots")
        blocks = roots.groupBy(group).agg(size(everything).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").select(group, "blocks")
        level = written(roots.join(lookup(written(blocks.coalesce(tasks(left)), "blocks")), group), "level")
        now = level.count()
        if not now:
            return edges
        if now > 0.7 * left:
            break
        left = now
    reached = lookup(written(components(edges), "reached"))
    rooted = written(whole.drop("root", "blocks").join(reached, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node"), "rooted")
    # the classes of other components than their group's largest, with all of the group
    per = rooted.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"))
    mains = per.groupBy(group).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").select(group, "main")
    some = written(rooted.join(lookup(written(mains, "mains")), group), "rest")
    cuts = some.groupBy(group).agg(size(everything).alias("ys"), size(F.col("root") != F.col("main")).alias("xs"))
    some = some.join(lookup(written(cuts, "cuts")), group)
    # block x of the others against block y of all: numbered so that x stands before every y
    others = some.where("root <> main").withColumn("mine", block("xs")).withColumn("x", F.col("mine")).withColumn("y", F.explode(F.expr("sequence(xs, xs + ys - 1)")))
    all_ = some.withColumn("mine", F.col("xs") + block("ys")).withColumn("y", F.col("mine")).withColumn("x", F.explode(F.expr("sequence(0, xs - 1)")))
    return edges.unionByName(written(compared(others.select(group, *every).unionByName(all_.select(group, *every))), "near"))


def _edges(found: list[tuple]) -> pa.RecordBatch:
    """Some edges as rows; there must be one, which tells the kind of group."""
    group = pa.int64() if isinstance(found[0][0], int) else pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((group, pa.binary(), pa.binary()))], names=["grp", "a", "b"])


def _joined(column: pa.ChunkedArray) -> tuple[Forest, list[bytes], list[int]]:
    """A forest over numbers for the roots that classes have already, the roots by number, and each row's number."""
    number: dict[bytes, int] = {}
    at = [number.setdefault(r, len(number)) for r in column.to_pylist()]
    return Forest(), list(number), at


def _list_forest(batches: Iterator[pa.RecordBatch], percent: int, least_shared: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, x, y, cls, n_shingles, tokens, mine, root): pairs that share enough, as a forest of each list."""
    out: list[tuple] = []
    for (key, x, y), t in sorted_groups(batches, 3):
        names, own = t["cls"].to_pylist(), t["mine"].to_numpy()
        n, sig = t["n_shingles"].to_numpy(), np.concatenate([c.flatten().to_numpy() for c in t["tokens"].chunks]).reshape(len(names), -1)
        f, roots, at = _joined(t["root"])
        for i in range(1, len(names)):
            fits = np.minimum(n[:i], n[i]) * 100 >= percent * np.maximum(n[:i], n[i])
            if x != y:
                fits &= own[:i] != own[i]
            js = np.flatnonzero(fits)
            if len(js):
                js = js[(sig[js] == sig[i]).sum(1) >= least_shared]
            for j in js:
                if gone := f.absorb(at[j], at[i]):
                    out.append((key, roots[gone[0]], roots[gone[1]]))
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _group_forest(batches: Iterator[pa.RecordBatch], percent: int, least_shared: int) -> Iterator[pa.RecordBatch]:
    """Rows (candidates, x, y, cls, n_shingles, shingles, tokens, mine, root): exact links, as a forest of each group."""
    out: list[tuple] = []
    for (key, x, y), t in sorted_groups(batches, 3):
        names, own, n = t["cls"].to_pylist(), t["mine"].to_numpy(), t["n_shingles"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        sig = np.concatenate([c.flatten().to_numpy() for c in t["tokens"].chunks]).reshape(len(names), -1)
        distinct, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        dense = np.split(numbers, ends[:-1])
        mark = np.zeros(len(distinct), np.int32)
        f, roots, at = _joined(t["root"])
        for i in range(1, len(names)):
            fits = np.minimum(n[:i], n[i]) * 100 >= percent * np.maximum(n[:i], n[i])
            if x != y:
                fits &= own[:i] != own[i]
            js = np.flatnonzero(fits)
            if len(js):
                js = js[(sig[js] == sig[i]).sum(1) >= least_shared]
            if not len(js):
                continue
            mark[dense[i]] = 1
            for j in js:
                if f.find(at[j]) == f.find(at[i]):
                    continue
                both = int(mark[dense[j]].sum())
                if both * 100 >= percent * int(n[i] + n[j] - both) and (gone := f.absorb(at[j], at[i])):
                    out.append((key, roots[gone[0]], roots[gone[1]]))
            mark[dense[i]] = 0
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(doc_id, text_md5, n_shingles, cls, component_id) for every row of docs.

    Texts are linked that share percent of the union of their shingles at least; least_shared of their
    HASHES min-hashes must collide, which has to be few enough for that similarity.

    component_id is the smallest doc_id reachable over links, the row's own if it has none. Null and
    empty texts have no shingles, cls null, and are linked with nothing. Equal texts are linked. Null
    ids are linked too but never name a component unless all its ids are null. Repeated rows are rows of
    their own; whole texts count, however long; an empty table gives an empty result. Only the text and id
    columns are read.
    """
    spark = docs.sparkSession
    tune(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("text_md5"), F.col(text).alias("text"))
    rows = written(signatures(base, "text", ["doc_id", "text_md5"]), "signatures")
    first = F.min(F.struct("doc_id", "text_md5")).alias("first")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("n_shingles").alias("n_shingles"), F.min("tokens").alias("tokens"), F.min("doc_id").alias("least"), first)
    classes = written(classes, "classes")

    posted = classes.select("cls", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = posted.join(shared, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    # tokens of one class alone are the rarest: they fill the prefix first
    room = F.greatest(F.lit(HASHES - least_shared + 1 - HASHES) + F.size("own"), F.lit(0))
    prefix = own.select("cls", F.explode(F.slice("own", F.lit(1), room)).alias("t")).select("cls", "t.token")
    postings = written(prefix.join(classes.select("cls", "n_shingles", "tokens"), "cls"), "postings")
    near = forests(postings, "token", parts, partial(_list_forest, percent=percent, least_shared=least_shared), ["cls", "n_shingles", "tokens"])
    groups = written(components(near), "groups")
    discard(postings)

    # the whole texts of the candidate classes: one row of each, found by its id and hash
    wanted = written(groups.join(classes, groups["node"] == classes["cls"]).select(F.col("root").alias("candidates"), "cls", F.col("first.doc_id").alias("id"), F.col("first.text_md5").alias("md5")), "wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([8 * len(s) for s in sets], pa.int64()), pa.array([tokens(s) for s in sets], pa.list_(pa.int64()))],
                names=["candidates", "cls", "n_shingles", "shingles", "bytes", "tokens"],
            )

    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("md5") == F.col("text_md5"))
    texts = base.join(lookup(wanted), match).select("candidates", "cls", "text")
    sets = texts.mapInArrow(released(whole), "candidates binary, cls binary, n_shingles long, shingles binary, bytes long, tokens array<long>")
    sets = written(sets.dropDuplicates(["cls"]), "sets")
    links = forests(sets, "candidates", parts, partial(_group_forest, percent=percent, least_shared=least_shared), ["cls", "n_shingles", "shingles", "tokens"], "bytes")
    discard(sets)
    linked = components(links)

    named = classes.select("cls", "least").join(linked, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    named = written(named, "named")
    least = lookup(written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least"))
    by_class = lookup(written(named.join(least, "root").select(F.col("cls").alias("of"), "component_id"), "by-class"), most=100_000)
    return rows.join(by_class, F.col("cls") == F.col("of"), "left").select("doc_id", "text_md5", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = group(read_table(spark, sf_dir, "documents"), percent=PERCENT, least_shared=LEAST_SHARED)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one whose id names it. Rows repeated as a whole stay once.

    Groups are linked from STAGE_PERCENT on.
    Rows with null ids are kept unless their group has a row with an id; of several such rows with
    equal texts one stays.
    """
    found = group(docs, percent=STAGE_PERCENT, least_shared=STAGE_LEAST_SHARED)
    gone = found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = found.groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    verdict = gone.select("doc_id", "text_md5").distinct().withColumn("verdict", F.lit("gone"))
    verdict = verdict.unionByName(again.join(verdict, [again["doc_id"].eqNullSafe(verdict["doc_id"]), again["text_md5"].eqNullSafe(verdict["text_md5"])], "left_anti").select("doc_id", "text_md5").withColumn("verdict", F.lit("again")))
    verdict = written(verdict.select(F.col("doc_id").alias("v_id"), F.col("text_md5").alias("v_md5"), "verdict"), "verdicts")
    names = {c: fresh(docs, c) for c in ("v_id", "v_md5", "verdict")}
    for c, name in names.items():
        verdict = verdict.withColumnRenamed(c, name)
    verdict = lookup(verdict)
    on = docs["doc_id"].eqNullSafe(verdict[names["v_id"]]) & F.unhex(F.md5(docs["text"])).eqNullSafe(verdict[names["v_md5"]])
    judged = docs.join(verdict, on, "left")
    once = judged.where(F.col(names["verdict"]).isNull()).select(*docs.columns)
    repeated = judged.where(F.col(names["verdict"]) == "again").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def brute(docs: list[tuple[int, str | None]], percent: int = PERCENT) -> dict[int, tuple[int, int, bool]]:
    """The same result by comparing the word shingles of all pairs."""
    sets = {}
    for key, text in docs:
        w = space_words((text or "").encode())
        n = min(WORDS, len(w))
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    f, keys = Forest(), sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                f.join(a, b)
    return {k: (len(s), f.find(k), f.find(k) == k) for k, s in sets.items()}


SQL7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
