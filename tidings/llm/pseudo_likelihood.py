"""LM scoring by masked pseudo-likelihood.

Model.  A token is a lower-cased word.  Words that occur at least sqrt(T) times
among the corpus's T tokens have a symbol of their own, so there are at most
sqrt(T) of them and their number grows with the corpus; all others share the
symbol of their bucket (``BUCKETS``, by the hash of the last three bytes) and are
told apart inside it by their own corpus count:

    p(word | both sides) = p(symbol | l2, l1, r1, r2) * p(word | symbol)

A bidirectional window network gives the first factor: the four neighbours'
vectors are summed, ``h = tanh(sum + a)``, and a softmax in two steps (class of
symbols, then symbol in the class, each of about sqrt(symbols) outcomes) reads h.
The second factor is 1 for a word with its own symbol, else ``(n + 1/2) / (N +
(D + 1) / 2)`` for a word counted n times in a bucket of D words and N tokens; the
last half is for words the corpus does not have.  A document's score is the sum of
the log-probabilities of its tokens.

Jobs.  1. Count all words (one row per word).  2. Write every text as word
numbers; words outside the ``DIRECT`` most frequent (or the words with a symbol,
if those are more) are kept beside them with their count in the text.  3. Train:
each round takes one of ``PARTS`` parts of the documents, every task runs Adagrad
over its windows in numpy from the same weights, and the tasks' weights are
averaged chunk by chunk in Spark.  Whole passes over all parts go on until
``ENOUGH`` windows were seen and the loss of the last ``SPAN`` rounds, taken on
each batch before its step, is less than ``SETTLED`` below that of the ``SPAN``
rounds before; ``PASSES`` at most.  4. Score: the network and the known
counts in the tasks, the counts of the other words by a join on the word.

Scale.  No window is shuffled.  A word outside the frequent ones is rare, so the
join has no hot key.  Sent to the workers: the frequent words (``DIRECT``, or
sqrt(T) at most if that is more) and the network, whose size is in the order of the
symbols.  As many trainers run as the cluster has
cores, so what is averaged grows with cores and symbols, not with the corpus.

Edge cases.  Null and empty texts have no token: score 0, no mean.  An empty
corpus gives one word's probability to any token in each bucket and an untrained
network.  Ties between words of one count go to the word that sorts first.
Repeated rows count as often as they occur and score alike.  A very long text is
one row of word numbers and its windows are handled in blocks.  Other columns of
the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import utf8, written

BUCKETS = 256  # a power of two
SUFFIX = 3  # bytes of a word that choose its bucket
DIRECT = 1 << 17  # words whose counts the tasks have at hand
WIDTH = 16
RATE = 0.1
START = 1e-7  # of the sums of squared gradients
PARTS = 6
PASSES = 6
SPAN = 2  # rounds whose mean loss is compared: parts differ among each other
SETTLED = 0.05  # nats a token
ENOUGH = 5_000_000  # windows; fewer are passed again
BATCH = 1 << 14  # windows a step, at least
BLOCK = 1 << 15  # windows scored at a time
CHUNK = 1 << 16  # weights a row while they are averaged
FLUSH = 400_000
SIDES = (-2, -1, 1, 2)


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-SUFFIX:], 42) % BUCKETS


def bucket_column(word: Column) -> Column:
    """``bucket`` of a binary column."""
    return F.pmod(F.xxhash64(F.substring(word, -SUFFIX, SUFFIX)), F.lit(BUCKETS)).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in utf8(batch, "text"):
                seen.update(words(text))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """``direct`` words have the numbers 0, 1, ..; a bucket b has ``len(direct) + b``.

    ``symbol`` and ``inside`` give a number's symbol and the logarithm of what is
    known of p(word | symbol); for a bucket's number ``log(n + 1/2)`` is missing."""

    direct: list[bytes]
    symbol: np.ndarray
    inside: np.ndarray
    totals: np.ndarray  # tokens of each symbol


def vocabulary(counts: DataFrame, direct: int = DIRECT) -> Vocabulary:
    """Symbols and known counts from ``word_counts``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = counts.where(F.col("n") >= sqrt(total)).count()
    top = counts.select("word", "n").orderBy(F.desc("n"), "word").limit(max(direct, own)).toArrow()
    n, known = top["n"].to_numpy().astype(float), top["word"].to_pylist()
    shared = counts.where(F.col("n") < sqrt(total)).groupBy(bucket_column(F.col("word")).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    tokens, distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in shared.collect():
        tokens[r["b"]], distinct[r["b"]] = r["n"], r["d"]
    totals = np.concatenate([n[:own], tokens])
    place = np.empty(len(totals), np.int32)
    place[np.argsort(-totals, kind="stable")] = np.arange(len(totals))  # frequent symbols share classes
    buckets = np.array([bucket(w) for w in known[own:]], int)
    bottom = np.log(tokens + (distinct + 1) / 2)
    return Vocabulary(known, np.concatenate([place[:own], place[own + buckets], place[own:]]),
                      np.concatenate([np.zeros(own), np.log(n[own:] + 0.5) - bottom[buckets], -bottom]), -np.sort(-totals))


class Numbers(dict):
    """word -> number; words without one are counted in ``rare``."""

    def __init__(self, direct: list[bytes]):
        super().__init__(zip(direct, range(len(direct))))
        self.first, self.rare = len(direct), Counter()

    def __missing__(self, word: bytes) -> int:
        self.rare[word] += 1
        return self.first + bucket(word)


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """row, doc_id, part, ids (int32 numbers of the words), rare (word, times) of
    every document; written, so that ``row`` stays as it is."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocab.direct)
    rare = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(sent.value)
        for batch in batches:
            ids, others = [], []
            for text in utf8(batch, "text"):
                w = words(text)
                ids.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)).tobytes())
                others.append([{"word": k, "times": v} for k, v in number.rare.items()])
                number.rare.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(others, rare)], schema=schema)

    out = (docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, rare array<struct<word: binary, times: long>>")
           .withColumn("row", F.monotonically_increasing_id())
           .withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")))
    path = scratch_path(spark, "coded")
    out.write.partitionBy("part").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


class Network:
    """Weights in one float32 vector; layout: neighbours' vectors, a, classes and
    their bias, symbols by class and their bias."""

    def __init__(self, symbols: int, width: int = WIDTH, weights: np.ndarray | None = None):
        self.symbols, self.width = symbols, width
        self.size = ceil(sqrt(symbols))  # symbols a class
        self.classes = -(-symbols // self.size)
        c, s = self.classes, self.size
        shapes = [(len(SIDES), symbols + 1, width), (width,), (width, c), (c,), (c, width, s), (c, s)]
        ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
        if weights is None:
            weights = np.random.default_rng(0).normal(0, 0.1, ends[-1]).astype(np.float32)
        self.weights = weights
        self.sides, self.a, self.top, self.top_bias, self.low, self.low_bias = (weights[i:j].reshape(x) for i, j, x in zip(ends, ends[1:], shapes))

    def start(self, totals: np.ndarray) -> None:
        """The biases say how frequent symbols are; places without one get nothing."""
        cells = np.full(self.classes * self.size, -1e9)
        cells[:self.symbols] = np.log((totals + 0.5) / (totals + 0.5).sum())
        cells = cells.reshape(self.classes, self.size)
        top = np.log(np.exp(cells).sum(axis=1))
        self.top_bias[:] = top
        self.low_bias[:] = cells - top[:, None]

    def by_class(self, centre: np.ndarray) -> np.ndarray:
        """An order of windows in which classes stand together."""
        return np.argsort((centre // self.size).astype(np.uint16), kind="stable")

    def step(self, near: np.ndarray, centre: np.ndarray, grad: Network | None = None) -> np.ndarray:
        """log p(centre | near) of windows ordered ``by_class``; ``near`` is (side,
        window).  With ``grad``, the gradient of the negative sum is added to it."""
        h = np.tanh(sum(self.sides[i].take(x, axis=0) for i, x in enumerate(near)) + self.a)
        k, at = np.divmod(centre, self.size)
        every = np.arange(len(centre))
        z, logp = _softmax(h @ self.top + self.top_bias, every, k)
        if grad is not None:
            z[every, k] -= 1
            grad.top += h.T @ z
            grad.top_bias += z.sum(axis=0)
            dh = z @ self.top.T
        first = np.flatnonzero(np.diff(k, prepend=-1, append=-1))
        for i, j in zip(first, first[1:]):
            c = k[i]
            z, lp = _softmax(h[i:j] @ self.low[c] + self.low_bias[c], every[:j - i], at[i:j])
            logp[i:j] += lp
            if grad is not None:
                z[every[:j - i], at[i:j]] -= 1
                grad.low[c] += h[i:j].T @ z
                grad.low_bias[c] += z.sum(axis=0)
                dh[i:j] += z @ self.low[c].T
        if grad is not None:
            dh *= 1 - h * h
            grad.a += dh.sum(axis=0)
            columns = dh.T.astype(np.float64)
            for i, x in enumerate(near):
                for w, column in enumerate(columns):
                    grad.sides[i, :, w] += np.bincount(x, column, self.symbols + 1)
        return logp

    def log_probs(self, near: np.ndarray, centre: np.ndarray) -> np.ndarray:
        out = np.empty(len(centre), np.float64)
        for at in range(0, len(centre), BLOCK):
            order = at + self.by_class(centre[at:at + BLOCK])
            out[order] = self.step(near[:, order], centre[order])
        return out


def _softmax(z: np.ndarray, row: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log-probability of the chosen).  The outcomes' biases start as
    log-probabilities, so values stay near them; the clip keeps float32 from overflow."""
    np.clip(z, -80, 60, out=z)
    own = z[row, chosen]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    z /= total[:, None]
    return z, own - np.log(total)


def windows(texts: list[np.ndarray], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """((side, window) symbols of the neighbours, centre) of every token; beyond a
    text's ends stands the edge, which is number ``symbols``."""
    gap = np.full(2, symbols, np.int32)
    line = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    at = np.flatnonzero(line != symbols)
    return np.stack([line[at + d] for d in SIDES]), line[at]


def numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]


def train(texts: DataFrame, vocab: Vocabulary, width: int = WIDTH, rate: float = RATE, passes: int = PASSES) -> tuple[np.ndarray, list[float]]:
    """(weights, mean negative log-likelihood of a symbol in each round)."""
    spark = texts.sparkSession
    symbols = len(vocab.totals)
    net = Network(symbols, width)
    net.start(vocab.totals)
    weights, power, losses = net.weights, np.full(len(net.weights), START, np.float32), []
    total = 0
    for turn in range(passes * PARTS):
        sent = spark.sparkContext.broadcast((vocab.symbol, weights, power))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            symbol, w, p = sent.value
            net, p = Network(symbols, width, w.copy()), p.copy()
            grad = Network(symbols, width, np.zeros_like(w))
            rng, seen, loss = np.random.default_rng(turn), 0, 0.0
            size = max(BATCH, 8 * symbols)  # a step's own cost grows with the symbols
            for batch in batches:
                near, centre = windows([symbol[t] for t in numbers(batch)], symbols)
                mixed = rng.permutation(len(centre))
                for at in range(0, len(mixed), size):
                    some = mixed[at:at + size]
                    some = some[net.by_class(centre[some])]
                    grad.weights[:] = 0
                    loss -= float(net.step(near[:, some], centre[some], grad).sum(dtype=np.float64))
                    grad.weights /= len(some)
                    p += grad.weights ** 2
                    net.weights -= rate * grad.weights / np.sqrt(p)
                seen += len(centre)
            if seen:
                for i in range(0, len(w), CHUNK):
                    both = np.stack([net.weights[i:i + CHUNK], p[i:i + CHUNK]]).astype(np.float64) * seen
                    yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([both.tobytes()], pa.binary()), pa.array([seen], pa.int64()), pa.array([loss])],
                                                     names=["chunk", "sums", "seen", "loss"])

        schema = "chunk int, sums binary, seen long, loss double"
        trained = (texts.where(F.col("part") == turn % PARTS).select("ids").coalesce(spark.sparkContext.defaultParallelism)
                   .mapInArrow(run, schema).repartition("chunk").mapInArrow(_summed, schema))
        found = sorted(trained.collect(), key=lambda r: r["chunk"])
        sent.unpersist()
        if found:
            mean = np.concatenate([np.frombuffer(r["sums"]).reshape(2, -1) / r["seen"] for r in found], axis=1).astype(np.float32)
            weights, power = mean[0], mean[1]
            losses.append(found[0]["loss"] / found[0]["seen"])
            total += found[0]["seen"]
        settled = total >= ENOUGH and np.mean(losses[-2 * SPAN:-SPAN]) - np.mean(losses[-SPAN:]) < SETTLED
        if (turn + 1) % PARTS == 0 and (settled or not total):
            break
    return weights, losses


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: the sums over the trainers."""
    sums: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            have = sums.setdefault(r["chunk"], [0.0, 0, 0.0])
            have[0], have[1], have[2] = have[0] + np.frombuffer(r["sums"]), have[1] + r["seen"], have[2] + r["loss"]
    for chunk, (total, seen, loss) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64()), pa.array([loss])],
                                         names=["chunk", "sums", "seen", "loss"])


@dataclass
class Model:
    counts: DataFrame
    vocab: Vocabulary
    weights: np.ndarray
    losses: list[float]
    width: int


def fit(docs: DataFrame, width: int = WIDTH, direct: int = DIRECT, passes: int = PASSES) -> tuple[Model, DataFrame]:
    """(model learned from all of ``docs``, their ``coded`` rows)."""
    counts = written(word_counts(docs), "words")
    vocab = vocabulary(counts, direct)
    texts = coded(docs, vocab)
    return Model(counts, vocab, *train(texts, vocab, width, passes=passes), width), texts


def score(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, pll (summed log-probabilities), mean_pll of every document
    of ``coded`` rows."""
    vocab, width = model.vocab, model.width
    sent = texts.sparkSession.sparkContext.broadcast((vocab.symbol, vocab.inside, model.weights))
    symbols = len(vocab.totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, inside, weights = sent.value
        net = Network(symbols, width, weights)
        for batch in batches:
            texts = numbers(batch)
            size = np.array([len(t) for t in texts], np.int64)
            flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
            near, centre = windows([symbol[t] for t in texts], symbols)
            total = np.bincount(np.repeat(np.arange(len(texts)), size), net.log_probs(near, centre) + inside[flat], len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(size), pa.array(total)], names=["row", "doc_id", "n_tokens", "known"])

    known = texts.select("row", "doc_id", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, known double")
    rare = (texts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times")
            .join(model.counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest")))
    pll = F.col("known") + F.coalesce("rest", F.lit(0.0))
    return known.join(rare, "row", "left").select("doc_id", "n_tokens", pll.alias("pll"), F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")).alias("mean_pll"))
