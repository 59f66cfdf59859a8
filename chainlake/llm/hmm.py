"""Language-model scores by a hidden Markov model over words.

Words are counted over the whole training corpus. The model's symbols are the TOP most frequent
words, one class for each hash of the endings of all other words, and the end of the text. Latent
states emit symbols; a word within its class has its smoothed share of the class, so every text,
unknown words included, has a proper probability. Baum-Welch counts are summed over all training
texts, partition by partition, in every round; the rounds begin with states that emit as the whole
corpus does, told apart by seeded noise. A text's score is its exact likelihood by the scaled forward
recursion.

The texts are read once, and laid side by side as symbols once for all rounds. A task cuts its documents into chunks of bounded size, each with its own
dictionary: only the dictionaries (a row for each distinct word of a chunk) meet the corpus counts,
and go back to their chunk, which then knows the counts and classes of all its words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, read_table, shuffle_parts, space_words, tune, written
from .graph import sorted_groups

STATES, TOP, ENDINGS = 8, 4096, 512
END = TOP + ENDINGS
SYMBOLS = END + 1
_PLACES = np.arange(SYMBOLS * STATES).reshape(SYMBOLS, STATES)
ROUNDS, START_ROUNDS = 3, 12
CHUNK_TOKENS, CHUNK_WORDS = 2_000_000, 400_000
#: Tokens whose forward variables are held at a time, and texts side by side. In training an array of these
#: variables stays under 32 MB, up to which the allocator uses memory again instead of asking for fresh pages.
LANE_TOKENS, LANES = 1_000_000, 1024
#: Tokens (and TEXT_COST for each text) that are gathered before they are laid side by side, as symbols only:
#: of more texts, more are alike in length, so a step of the recursion serves more of them.
HELD_TOKENS, TEXT_COST = 8_000_000, 100


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: small numbers leave planes of zeros, which compress to nothing."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _numbered() -> defaultdict[bytes, int]:
    """A dictionary that numbers words as they are first asked for."""
    ids = defaultdict()
    ids.default_factory = ids.__len__
    return ids


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as by `space_words`, and where each text's begin and the last one's end; null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    some = pc.greater(pc.binary_length(words), 0)  # blanks around a text leave empty pieces
    ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[ends]
    return words.filter(some), ends


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to dictionary rows and document rows of chunks."""
    chunk = TaskContext.get().partitionId() << 32
    ids = _numbered()
    keys, held, docs, total = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nothing = lambda n, t: pa.nulls(n, t)
        words = list(ids)
        taught = [d for d, h in zip(docs, held, strict=True) if not h]
        n = np.bincount(np.concatenate(taught), minlength=len(words)) if taught else np.zeros(len(words), np.int64)
        for lo in range(0, len(words), 100_000):
            part = words[lo : lo + 100_000]
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, chunk)), pa.array(np.arange(lo, lo + k, dtype=np.int32)), pa.array(part, pa.binary()), pa.array(n[lo : lo + k], pa.int64()), nothing(k, key_type), nothing(k, pa.bool_()), nothing(k, pa.binary())],
                names=names,
            )
        for lo in range(0, len(docs), 500):
            part = docs[lo : lo + 500]
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, chunk)), *(nothing(k, t) for t in (pa.int32(), pa.binary(), pa.int64())), pa.array(keys[lo : lo + k], key_type), pa.array(held[lo : lo + k], pa.bool_()), pa.array([packed(d) for d in part], pa.binary())],
                names=names,
            )

    names = ["chunk", "local", "word", "n", "doc_id", "held_out", "ids"]
    key_type = pa.int64()
    for b in batches:
        key_type = b.schema.field(0).type
        words, ends = split_words(b.column(2))
        lo = 0
        while lo < b.num_rows:
            # as many texts as the chunk has room for, one at least: only their distinct words are looked up here
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK_TOKENS - total, "left")))
            hi = min(hi, b.num_rows)
            part = words.slice(ends[lo], ends[hi] - ends[lo]).dictionary_encode()
            found = part.dictionary.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_pylist()
            number = np.fromiter(map(ids.__getitem__, found), np.int32, len(found))
            docs += np.split(number[part.indices.to_numpy()], ends[lo + 1 : hi] - ends[lo])
            keys += b.column(0).slice(lo, hi - lo).to_pylist()
            held += b.column(1).slice(lo, hi - lo).to_pylist()
            total += int(ends[hi] - ends[lo])
            lo = hi
            if total >= CHUNK_TOKENS or len(ids) >= CHUNK_WORDS:
                yield from flush()
                chunk, total = chunk + 1, 0
                ids, keys, held, docs = _numbered(), [], [], []
    if docs:
        yield from flush()


@dataclass
class Lexicon:
    """Corpus statistics: of the training tokens, and by class their tokens and distinct words."""

    tokens: int
    distinct: int
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram share of words with these training counts."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's smoothed share of its class; 0 for words that are a class of their own."""
        share = (counts + 0.5) / (self.class_tokens[classes] + 0.5 * (self.class_words[classes] + 1))
        return np.where(classes < TOP, 0.0, np.log10(share))


def _coded(lexicon):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (chunk, kind, local, c, class, doc_id, held_out, ids), sorted by chunk, to scored and symbol-coded documents."""
        lex: Lexicon = lexicon.value
        end_base = float(lex.base(np.array([lex.ends]))[0])
        for _, t in sorted_groups(batches, 1):
            word = t["kind"].to_numpy() == 0
            entries, rest = t.filter(pa.array(word)), t.filter(pa.array(~word))
            local = entries["local"].to_numpy()
            counts, classes = np.empty(len(local), np.int64), np.empty(len(local), np.int64)
            counts[local], classes[local] = entries["c"].to_numpy(), entries["class"].to_numpy()
            base, within, known = lex.base(counts), lex.within(counts, classes), counts > 0
            symbols = classes.astype(np.uint16)
            ids = [unpacked(x, np.int32) for x in rest["ids"].to_pylist()]
            for lo in range(0, len(ids), 2000):
                mine = ids[lo : lo + 2000]
                part = rest.slice(lo, len(mine)).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part[c].combine_chunks() if part[c].num_chunks != 1 else part[c].chunk(0) for c in ("doc_id", "held_out")),
                        pa.array([len(d) + 1 for d in mine], pa.int64()),
                        pa.array([int(known[d].sum()) + (lex.ends > 0) for d in mine], pa.int64()),
                        pa.array([float(base[d].sum()) + end_base for d in mine], pa.float64()),
                        pa.array([float(within[d].sum()) for d in mine], pa.float64()),
                        pa.array([packed(symbols[d]) for d in mine], pa.binary()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "symbols"],
                )

    return go


# -- the hidden Markov model ------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)

    @classmethod
    def first(cls, share: np.ndarray, seed: int = 5) -> Model:
        """States that emit nearly as the corpus does, each a little differently."""
        rng = np.random.default_rng(seed)
        emit = share[:, None] * np.exp(rng.normal(0, 0.5, (len(share), STATES)))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """From expected counts; every event keeps some probability."""
        emit = emit + 20.0 * share[:, None]
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def at_each_time(sizes: np.ndarray) -> np.ndarray:
    """How many texts of these sizes, longest first, are longer than t, for each t."""
    return np.cumsum(np.bincount(sizes, minlength=sizes[0] + 1)[::-1])[::-1][1:]


def lanes(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts side by side, longest first: (their places, symbols by time, texts at each time)."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lo = 0
    while lo < len(order):
        hi, total = lo, 0
        while hi < len(order) and (hi == lo or (hi - lo < LANES and total + len(texts[order[hi]]) + 1 <= LANE_TOKENS)):
            total += len(texts[order[hi]]) + 1
            hi += 1
        mine = order[lo:hi]
        sizes = np.array([len(texts[i]) + 1 for i in mine])
        alive = at_each_time(sizes)
        offset = np.concatenate([[0], np.cumsum(alive)[:-1]])
        flat = np.empty(total, np.uint16)
        for lane, i in enumerate(mine):
            at = offset[: sizes[lane]] + lane
            flat[at[:-1]] = texts[i]
            flat[at[-1]] = END
        yield mine, flat, alive
        lo = hi


def forward(model: Model, flat: np.ndarray, alive: np.ndarray, kind: type = np.float64, keep: bool = False) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray]:
    """Natural log-likelihood of each lane by the scaled recursion; with keep the scaled variables, scales and scaled emissions instead.

    Scores are computed in double precision. Training passes single precision: its counts are sums of
    posteriors, normalised anew at each place, so errors don't add up along a text.
    """
    move, start, ones = model.move.astype(kind), model.start.astype(kind), np.ones((STATES, STATES), kind)
    emit = model.emit.astype(kind).take(flat, 0)
    alpha = np.empty_like(emit) if keep else None
    scales = np.empty(len(flat), kind)
    at, a = 0, None
    for n in alive.tolist():
        e, out = emit[at : at + n], alpha[at : at + n] if keep else None
        if a is None:
            a = np.multiply(e, start, out)
        else:
            a = np.matmul(a[:n], move, out)
            a *= e
        c = a @ ones  # the scale, in every column: numpy divides much slower by a column that it has to spread
        scales[at : at + n] = c[:, 0]
        a /= c
        if keep:
            e /= c
        at += n
    if keep:
        return None, alpha, scales, emit
    lane = np.arange(len(flat)) - np.repeat(np.cumsum(alive) - alive, alive)
    return np.bincount(lane, np.log(scales.astype(np.float64)), alive[0]), None, scales, emit


def counted(model: Model, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of blocks (symbols by time, texts at each time): (start, move, emit) and their log-likelihood."""
    start, move, emit, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(SYMBOLS * STATES), 0.0
    m = model.move.astype(np.float32)
    back = np.ascontiguousarray(m.T)
    for flat, alive in blocks:
        _, alpha, scales, e = forward(model, flat, alive, np.float32, keep=True)
        total += float(np.log(scales).sum(dtype=np.float64))
        ahead, beta, pairs = None, None, np.zeros((STATES, STATES), np.float32)
        for n, end in zip(alive[::-1].tolist(), np.cumsum(alive)[::-1].tolist(), strict=True):
            a = alpha[end - n : end]
            if beta is None:
                beta = np.ones((n, STATES), np.float32)
            else:
                after = len(beta)
                ahead *= beta
                pairs += a[:after].T @ ahead
                beta = ahead @ back
                a[:after] *= beta  # becomes the posterior
                if after < n:  # texts that end here
                    beta = np.concatenate([beta, np.ones((n - after, STATES), np.float32)])
            ahead = e[end - n : end]
        start += alpha[: alive[0]].sum(0)
        move += pairs * m
        for lo in range(0, len(flat), 32_768):
            # all states in one count: the places of a symbol's states lie side by side
            emit += np.bincount(_PLACES.take(flat[lo : lo + 32_768], 0).ravel(), alpha[lo : lo + 32_768].ravel(), SYMBOLS * STATES)
    return start, move, emit.reshape(SYMBOLS, STATES), total


def expected(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of texts: (start, move, emit) and their log-likelihood."""
    return counted(model, ((flat, alive) for _, flat, alive in lanes(texts)))


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [unpacked(x, np.uint16) for x in column.to_pylist()]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches with symbols, as many at a time as HELD_TOKENS allows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("symbols").nbytes // 2 + TEXT_COST * b.num_rows
        if size >= HELD_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def laid(coded: DataFrame) -> DataFrame:
    """All training texts as blocks side by side (symbols by time, sizes of the texts), laid once for all rounds."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            texts = [t for batch in held for t in _texts(batch.column("symbols"))]
            for mine, flat, _ in lanes(texts):
                sizes = np.array([len(texts[i]) + 1 for i in mine], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([packed(flat)], pa.binary()), pa.array([sizes.tobytes()], pa.binary())], names=["flat", "sizes"])

    return written(coded.where("NOT held_out").select("symbols").mapInArrow(go, "flat binary, sizes binary"), "laid")


def baum_welch(blocks: DataFrame, model: Model, share: np.ndarray) -> Model:
    """One round over all training texts, as `laid` has them: each task sums its own counts, one row for the start, each state and each symbol."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    columns = [f"n{s}" for s in range(STATES)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for flat, sizes in zip(batch.column("flat"), batch.column("sizes"), strict=True):
                    yield unpacked(flat.as_py(), np.uint16), at_each_time(np.frombuffer(sizes.as_py(), np.int64))

        a, b, c, _ = counted(shared.value, read())
        sums = np.concatenate([a[None], b, c])
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(sums[at, s])) for s in range(STATES))], names=["at", *columns])

    summed = blocks.mapInArrow(go, ", ".join(["at int", *(f"{c} double" for c in columns)]))
    rows = summed.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    sums = np.zeros((1 + STATES + SYMBOLS, STATES))
    sums[rows["at"].to_numpy()] = np.stack([rows[c].to_numpy() for c in columns], 1)
    return Model.of(sums[0], sums[1 : 1 + STATES], sums[1 + STATES :], share)


def start_model(coded: DataFrame, texts: int, share: np.ndarray, blocks: DataFrame | None = None) -> Model:
    """Breaks the symmetry of the states: START_ROUNDS of Baum-Welch over all of the texts learned from, if there are any.

    blocks: the texts as `laid` has them, if they are laid already.
    """
    model, lay = Model.first(share), blocks is None
    blocks = laid(coded) if lay else blocks
    for _ in range(START_ROUNDS if texts else 0):
        model = baum_welch(blocks, model, share)
    if lay:
        discard(blocks)
    return model


@dataclass
class Corpus:
    """Documents coded as symbols (doc_id, held_out, n_tokens, n_known, base_score, within, symbols), with what was counted.

    top names the words (by sha256) that are symbols of their own, in their order; texts counts those learned from.
    """

    coded: DataFrame
    lexicon: Lexicon
    share: np.ndarray
    top: list[str]
    texts: int


def prepare(docs: DataFrame, held: str, text: str = "text", doc_id: str = "doc_id") -> Corpus:
    """Counts the words of all rows but those whose column `held` is true, and codes every row."""
    spark = docs.sparkSession
    tune(spark)
    parts = shuffle_parts(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    schema = f"chunk long, local int, word binary, n long, doc_id {kind}, held_out boolean, ids binary"
    encoded = written(source.mapInArrow(_encoded, schema), "encoded")
    entries, texts = encoded.where("ids IS NULL"), encoded.where("ids IS NOT NULL")

    ending = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int").alias("ending")
    counts = written(entries.groupBy("word").agg(F.sum("n").alias("c")).select("word", "c", ending), "counts")
    # the most frequent words by name of their hash, so that what is collected doesn't depend on their lengths
    often = counts.where("c > 0").select(F.sha2("word", 256).alias("name"), "c").orderBy(F.desc("c"), "name").limit(TOP).collect()
    names = [r["name"] for r in often]
    top = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, nth int")
    ranked = counts.withColumn("name", F.sha2("word", 256)).join(F.broadcast(top), "name", "left").select("word", "c", F.coalesce("nth", F.col("ending") + TOP).alias("class"))
    by_class = ranked.where("c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("words")).collect()
    tokens, words = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for r in by_class:
        tokens[r["class"]], words[r["class"]] = r["c"], r["words"]
    ends = texts.where("NOT held_out").count()
    tokens[END], words[END] = ends, ends > 0
    lexicon = Lexicon(int(tokens.sum()), int(words.sum()), ends, tokens, words)
    shared = spark.sparkContext.broadcast(lexicon)

    found = entries.select("chunk", "local", "word").join(ranked, "word")
    none = F.lit(None)
    both = found.select("chunk", F.lit(0).alias("kind"), "local", "c", "class", none.cast(kind).alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("binary").alias("ids")).unionByName(
        texts.select("chunk", F.lit(1).alias("kind"), none.cast("int").alias("local"), none.cast("long").alias("c"), none.cast("int").alias("class"), "doc_id", "held_out", "ids")
    )
    both = both.repartition(parts, "chunk").sortWithinPartitions("chunk")  # one number as key: a radix sort
    coded = written(both.mapInArrow(_coded(shared), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, within double, symbols binary"), "coded")
    discard(encoded, counts)
    return Corpus(coded, lexicon, (tokens + 0.5) / (tokens + 0.5).sum(), names, ends)


def train(corpus: Corpus, rounds: int = ROUNDS) -> Model:
    """The start model, then so many further rounds of Baum-Welch, all over everything learned from."""
    blocks = laid(corpus.coded)
    model = start_model(corpus.coded, corpus.texts, corpus.share, blocks)
    for _ in range(rounds):
        model = baum_welch(blocks, model, corpus.share)
    discard(blocks)
    return model


def likelihoods(corpus: Corpus, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every coded row."""
    shared = corpus.coded.sparkSession.sparkContext.broadcast(model)
    kind = corpus.coded.schema["doc_id"].dataType.simpleString()

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            texts = [t for b in held for t in _texts(b.column("symbols"))]
            out, lo = np.zeros(len(texts)), 0
            for mine, flat, alive in lanes(texts):
                out[mine] = forward(shared.value, flat, alive)[0]
            for b in held:
                total = out[lo : lo + b.num_rows] / np.log(10) + b.column("within").to_numpy()
                lo += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = corpus.coded.mapInArrow(likelihood, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(corpus.lexicon.tokens).cast("long"))


def score(docs: DataFrame, held: str, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose column `held` is true are scored but not learned from; null counts as false. Scores
    are log10 probabilities of the whole text and its end. Null and empty texts are an end only.
    With nothing to learn from all scores are finite still; an empty table gives an empty result. Whole
    texts count, however long; equal texts get equal scores, and repeated rows stay.
    """
    corpus = prepare(docs, held, text, doc_id)
    return likelihoods(corpus, train(corpus, rounds))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held", crc_mod("doc_id", 5) == 1)
    return score(docs, "held").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute_base(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    """(held_out, n_tokens, n_known, train_tokens, base_score) by plain counting."""
    from collections import Counter

    held = {k: k is not None and crc32(str(k).encode()) % 5 == 1 for k, _ in docs}
    split = {k: [*space_words((t or "").encode()), b" "] for k, t in docs}
    c = Counter(w for k, ws in split.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(ws), sum(c[w] > 0 for w in ws), n, float(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))) for k, ws in split.items()}


def brute_likelihood(model: Model, text: np.ndarray) -> float:
    """Log-likelihood of one text, without scaling tricks: in log space, step by step."""
    seq = [*text.tolist(), END]
    a = np.log(model.start) + np.log(model.emit[seq[0]])
    for s in seq[1:]:
        a = np.logaddexp.reduce(a[:, None] + np.log(model.move), axis=0) + np.log(model.emit[s])
    return float(np.logaddexp.reduce(a))


def brute_score(corpus: Corpus, model: Model, counts: dict[bytes, int], text: str | None) -> float:
    """log10 probability of one text word by word: symbols from plain counts, then the recursion in log space."""
    top = {n: i for i, n in enumerate(corpus.top)}
    seq, within, lex = [], 0.0, corpus.lexicon
    for w in space_words((text or "").encode()):
        k = top.get(hashlib.sha256(w).hexdigest(), TOP + crc32(w[-3:]) % ENDINGS)
        seq.append(k)
        if k >= TOP:
            within += np.log10((counts.get(w, 0) + 0.5) / (lex.class_tokens[k] + 0.5 * (lex.class_words[k] + 1)))
    return brute_likelihood(model, np.array(seq, np.int64)) / np.log(10) + within
