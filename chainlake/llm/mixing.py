"""Mixing sources to target weights by weighted fair queueing.

Sources are weighed by the order of their names; a source's target is its share of the budget, at
most `max_repeats` times its own size, and what that cap leaves is shared again among the others.
Documents are put in a fixed shuffled order within their source, and each gets a virtual finish
time: the source's cumulative words up to and with it, divided by the source's target; a further
round through a source continues the sum. All rounds of all documents are range-sorted by finish
time and cut where the budget is used up.

Both sums run over range-sorted stretches (common.running_sum), so a source with any share of the
rows is spread over all tasks. Only numbers, ids and source names are moved, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUNS, fresh, lookup, read_table, running_sum, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2


def targets(sources: DataFrame, share: float = SHARE, repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with weight and target: min(repeats * size, level * weight), the level using up the budget.

    Sources in order of cap by weight reach their caps one after another, so the level is found in one
    pass of running sums. Ranks and sums run over range-sorted stretches: sources may be as many as domains.
    An empty table gives an empty result; a source of size 0 has target 0; of equal ratios the name decides.
    """
    named = sources.select("source", "source_size", F.col("source").isNull().cast("int").alias("unnamed"), F.lit(1).cast("long").alias("one"))
    ranked = running_sum(named, [], ["unnamed", "source"], "one", "nth")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    s = ranked.select("source", "source_size", "unnamed", weight.alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = ["ratio", "unnamed", "source"]
    s = running_sum(running_sum(s, [], order, "cap", "caps"), [], order, "weight", "weights")
    total, heavy = s.agg(F.sum("source_size"), F.sum("weight")).first()
    if not heavy:
        return s.select("source", "source_size", "weight", F.col("cap").cast("double").alias("target"))
    level = (F.lit(float(total) * share) - (F.col("caps") - F.col("cap"))) / (F.lit(heavy) - (F.col("weights") - F.col("weight")))
    found = s.select("ratio", "unnamed", "source", level.alias("level")).where("ratio > level")
    least = found.agg(F.min_by("level", F.struct(*order))).first()[0]
    cap = F.col("cap").cast("double")
    return s.select("source", "source_size", "weight", (cap if least is None else F.least(cap, F.lit(least) * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, share: float = SHARE, repeats: int = MAX_REPEATS, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, place) for every row of docs.

    taken is the number of words that the mix takes from the document, repeats counted: a multiple of
    size, at most `repeats` times it. Null and empty texts have size 0 and take nothing; null sources
    are one source, last in order; null ids are kept; equal rows may swap their (equal) places; an
    empty table gives an empty result. Whole texts count, however long. Only doc_id, text and source are
    read; place is the document's place in the shuffled order of its source.
    """
    base = written(_sized(docs, seed), "sizes")
    sources = written(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share, repeats), "targets")
    ordered = running_sum(base, ["source"], ["place", "doc_id", "size"], "size", "upto")
    named = sources.withColumnRenamed("source", "of")
    queued = ordered.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = [F.struct(((F.col("source_size") * k + F.col("upto")) / F.col("target")).alias("finish"), "place", "doc_id", "size", F.lit(k).alias("round")) for k in range(repeats)]
    rounds = queued.where("size > 0 AND target > 0").select(F.explode(F.array(*key)).alias("key")).select("key.*")
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    served = running_sum(rounds, [], ["finish", "place", "doc_id", "size", "round"], "size", "served")
    cut = served.where(F.col("served") <= budget).agg(F.max(F.struct("finish", "place", "doc_id", "size", "round")).alias("cut")).first()["cut"]
    taken = F.lit(0).cast("long")
    if cut is not None:
        kinds = rounds.schema
        last = F.struct(*(F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in kinds))
        for k in key:
            within = F.coalesce(F.col("size") > 0, F.lit(False)) & (F.col("target") > 0) & (k <= last)
            taken = taken + F.when(within, F.col("size")).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "place")


def _place(seed: int) -> Column:
    """Where a document stands in the shuffled order of its source; with the id it names the row, but for rows equal in id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    # one character stands for each word: regexp_count would hold all words of a text in an array
    size = F.coalesce(F.length(F.regexp_replace("text", SPACE_RUNS, "$1")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _place(seed).alias("place"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: those that the mix takes, with their columns, and how often (`repeats`) and how many words (`taken`).

    What the mix takes nothing of, null and empty texts among it, goes. Of rows equal in id and text each
    has its own number. If docs has such columns the new ones get an underscore. An empty table stays empty.
    """
    at = {c: fresh(docs, c) for c in ("m_id", "m_source", "m_place", "m_size", "m_times", "m_nth", "repeats", "taken")}
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    mixed = mix(docs).select("doc_id", "source", "place", "size", times.alias("times"))
    # of a key's rows so many are taken once at least, twice at least, ...
    at_least = F.array(*(F.count_if(F.col("times") >= k) for k in range(1, MAX_REPEATS + 1)))
    by = mixed.groupBy("doc_id", "source", "place").agg(F.max("size").alias("size"), at_least.alias("times"), F.count(F.lit(1)).alias("rows")).where("times[0] > 0")
    by = written(by, "turns")
    again = by.where("rows > 1").limit(1).count() > 0
    keys = [at["m_id"], at["m_source"], at["m_place"]]
    found = lookup(by).toDF(*keys, at["m_size"], at["m_times"], fresh(docs, "m_rows"))
    on = docs["doc_id"].eqNullSafe(F.col(keys[0])) & docs["source"].eqNullSafe(F.col(keys[1])) & (_place(0) == F.col(keys[2]))
    joined = docs.join(found, on)
    n = F.col(fresh(docs, "m_rows"))
    numbered = joined.where(n == 1).withColumn(at["m_nth"], F.lit(1).cast("long"))
    if again:
        one, row = fresh(joined, "m_one"), fresh(joined, "m_row")
        rows = joined.where(n > 1).withColumn(one, F.lit(1).cast("long")).withColumn(row, F.monotonically_increasing_id())
        numbered = numbered.unionByName(running_sum(rows, keys, [row], one, at["m_nth"]).drop(one, row))
    repeats = F.size(F.filter(at["m_times"], lambda c: c >= F.col(at["m_nth"])))
    out = numbered.withColumn(at["repeats"], repeats).where(F.col(at["repeats"]) > 0)
    return out.select(*docs.columns, at["repeats"], (F.col(at["m_size"]) * F.col(at["repeats"])).alias(at["taken"]))


def brute_targets(sizes: dict[str | None, int], share: float = SHARE, repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Targets by resharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= repeats * sizes[s]}
        for s in over or free:
            out[s] = float(repeats * sizes[s]) if over else level * weight[s]
        if not over:
            break
        left -= sum(repeats * sizes[s] for s in over)
        free -= over
    return out


def brute_taken(docs: list[tuple[object, str | None, int, int]], share: float = SHARE, repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words taken of each (id, source, size, place) by serving documents one after another, by finish time, until the budget is used up."""
    sizes: dict[str | None, int] = {}
    for _, source, size, _ in docs:
        sizes[source] = sizes.get(source, 0) + size
    target, upto, queue = brute_targets(sizes, share, repeats), dict.fromkeys(sizes, 0), []
    for key, source, size, place in sorted(docs, key=lambda d: (d[3], d[0], d[2])):
        upto[source] += size
        if size and target[source]:
            queue += [((sizes[source] * k + upto[source]) / target[source], place, key, size, k, source) for k in range(repeats)]
    served, taken = 0, {(key, source, size, place): 0 for key, source, size, place in docs}
    for _, place, key, size, _, source in sorted(queue):
        served += size
        if served > share * sum(sizes.values()):
            break
        taken[key, source, size, place] += size
    return taken
