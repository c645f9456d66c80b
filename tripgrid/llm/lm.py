"""Scores of texts under a log-bilinear neural model, trained by noise-contrastive estimation.

Tokens are words (ASCII lower case, cut at ASCII white space) and one end per text. The
``OWN`` most frequent tokens are classes of their own; all others fall into ``RARE``
classes by their last letters, and within a class a word has the share that its count
plus one has, with one count for all unseen words. The model predicts the class from
the two classes before: each has a vector, scaled per position, and their sum is
compared with the vector of the next class.

Training reads every training text once, in ``ROUNDS`` parts. In each part every task
takes gradient steps in numpy over its own texts, against noise drawn from class
counts, and the tasks' parameters are averaged in Spark, weighted by tokens; only the
averaged parameters, of fixed size, reach the driver. Noise-contrastive training needs
no normaliser; scores use the exact one, computed for every pair of classes in batched
matrix products.

Counts cover all texts. Words with at least 1 / ``COMMON`` of all tokens (so at most
``COMMON`` words) are broadcast; the rest meet their counts in a join, where by that
bound no word is hot.

A null text is empty and has its end only. Repeated rows count and are scored as often
as they occur; a null id is hashed as null and trains. Extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.llm.common import whole
from tripgrid.llm.flat import slices
from tripgrid.session import remove, stage

OWN = 768
RARE = 256
COMMON = 500_000
WIDTH = 24
CONTEXT = 2
ROUNDS = 3
RATE = 0.2
# Noise samples and tokens of a gradient step, tokens scored at a time.
NOISE = 64
STEP = 512
BATCH = 8192
SEED = 5
# Texts that a task holds as classes at a time.
TEXTS = 256
# Bytes of text that a task encodes at a time; one longer text is encoded alone.
PIECE = 2_000_000
# Bytes of text, in such pieces, that a task gathers before it counts their words.
COUNTED = 6_000_000
# The end of a text among the words; no word is empty.
END = b""


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for every word and end of the texts, what each code stands for, and where each text ends.

    The last code is the end; one before it may have no token.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = split.flatten().dictionary_encode()
    codes, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary.cast(pa.binary())
    # Space around a text leaves empty pieces.
    inside = codes != pc.index(words, pa.scalar(END, pa.binary())).as_py()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    outside = np.searchsorted(np.cumsum(sizes), np.flatnonzero(~inside), "right")
    ends = np.cumsum(sizes - np.bincount(outside, minlength=len(sizes)) + 1)
    out = np.full(ends[-1], len(words), codes.dtype)
    word = np.ones(len(out), bool)
    word[ends - 1] = False
    out[word] = codes[inside]
    return out, pa.concat_arrays([words, pa.array([END], pa.binary())]), ends


def rare_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % RARE


def rare_classes(words: pa.Array) -> np.ndarray:
    """``rare_class`` of each word, computed once for each distinct ending."""
    tails = pc.binary_slice(words, -3).dictionary_encode()
    made = np.array([rare_class(t) for t in tails.dictionary.to_pylist()], np.uint16)
    return made[tails.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Vocabulary:
    """Common words by falling count, their training counts, and the weight of every class."""

    words: list[bytes]
    counts: np.ndarray
    weights: np.ndarray  # training tokens of each class
    masses: np.ndarray  # counts plus one of the words of each rare class, and one
    n: int
    v: int

    @cached_property
    def place(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def classes(self) -> np.ndarray:
        own = min(OWN, len(self.words))
        return np.array([*range(own), *map(rare_class, self.words[own:])], np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, a): occurrences in the training texts and in all, of (held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = {False: [], True: []}, {False: 0, True: 0}

        def flush(held: bool) -> pa.RecordBatch:
            texts = pa.concat_arrays(waiting[held])
            waiting[held], size[held] = [], 0
            codes, words, _ = tokens(texts)
            n = np.bincount(codes, minlength=len(words))
            words, n = words.filter(pa.array(n > 0)), n[n > 0]
            return pa.RecordBatch.from_arrays([words, pa.array(np.zeros_like(n) if held else n), pa.array(n)], ["word", "c", "a"])

        for batch in batches:
            for at, texts in slices(batch.column("text"), min(PIECE, COUNTED)):
                held_out = batch.column("held_out").slice(at, len(texts))
                for held in waiting:
                    mine = texts.filter(pc.equal(held_out, held))
                    if len(mine):
                        waiting[held].append(mine)
                        size[held] += mine.nbytes
                    if size[held] >= COUNTED:
                        yield flush(held)
        for held in waiting:
            if waiting[held]:
                yield flush(held)

    counted = docs.select("held_out", "text").mapInArrow(run, "word binary, c long, a long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.sum("a").alias("a"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    every = total["a"] or 0
    common = counts.filter(F.col("a") * COMMON >= every).select("word", "c").toArrow()
    words, n = common.column("word").to_pylist(), common.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    # The end is a class of its own whatever its count.
    order.sort(key=lambda i: words[i] != END)
    words, n = [words[i] for i in order], np.array([n[i] for i in order], np.int64)
    own = words[:OWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, weight, mass = pa.array(own, pa.binary()), np.zeros(OWN + RARE), np.zeros(OWN + RARE)
        for batch in batches:
            others = batch.filter(pc.invert(pc.is_in(batch.column("word"), mine)))
            k, c = rare_classes(others.column("word")), others.column("c").to_numpy()
            weight += np.bincount(k, c, OWN + RARE)
            mass += np.bincount(k, c + 1, OWN + RARE)
        rare = np.arange(OWN, OWN + RARE)
        yield pa.RecordBatch.from_arrays([pa.array(rare), pa.array(weight[rare]), pa.array(mass[rare])], ["k", "weight", "mass"])

    seen = counts.filter("c > 0").select("word", "c").mapInArrow(run, "k long, weight double, mass double")
    weights, masses = np.zeros(OWN + RARE), np.ones(OWN + RARE)
    weights[: len(own)] = n[: len(own)]
    for row in seen.groupBy("k").agg(F.sum("weight").alias("weight"), F.sum("mass").alias("mass")).collect():
        weights[row["k"]], masses[row["k"]] = row["weight"], row["mass"] + 1
    return Vocabulary(words, n, weights, masses, total["n"] or 0, total["v"])


ENCODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, classes binary, known long, "
    "logs double, rare_logs double, rare array<struct<word:binary,n:long>>"
)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Classes of every token (16 bits each), sums of log10(c + 1) over common words, and the other words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        place, classes, logs = v.place, v.classes, np.log10(v.counts + 1.0)
        known = v.counts > 0
        for whole_batch in batches:
            for at, texts in slices(whole_batch.column("text"), PIECE):
                batch = whole_batch.slice(at, len(texts))
                codes, words, ends = tokens(texts)
                starts = np.concatenate(([0], ends[:-1]))
                listed = words.to_numpy(zero_copy_only=False).tolist()
                # Of each distinct word, then of its tokens.
                found = np.fromiter((place.get(w, -1) for w in listed), np.int64, len(listed))
                common = found >= 0
                own = found[common]
                mine, seen = np.empty(len(words), np.uint16), np.zeros(len(words), np.int64)
                log, rare_log = np.zeros(len(words)), np.zeros(len(words))
                mine[common], mine[~common] = classes[own], rare_classes(words.filter(pa.array(~common)))
                seen[common], log[common], rare_log[common] = known[own], logs[own], np.where(own >= OWN, logs[own], 0.0)
                raw = pa.py_buffer(mine[codes])
                others = np.flatnonzero(~common[codes])
                pairs, n = np.unique(np.searchsorted(ends, others, "right") * len(words) + codes[others], return_counts=True)
                firsts = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(words))
                rare = pa.StructArray.from_arrays([words.take(pa.array(pairs % len(words))), pa.array(n, pa.int64())], ["word", "n"])
                made = [
                    pa.array(ends - starts, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.concatenate(([0], 2 * ends)).astype(np.int32)), raw]),
                    pa.array(np.add.reduceat(seen[codes], starts)),
                    pa.array(np.add.reduceat(log[codes], starts)),
                    pa.array(np.add.reduceat(rare_log[codes], starts)),
                    pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), rare),
                ]
                given = [batch.column(c) for c in ("row", "doc_id", "held_out")]
                names = ["row", "doc_id", "held_out", "n_tokens", "classes", "known", "logs", "rare_logs", "rare"]
                yield pa.RecordBatch.from_arrays([*given, *made], names)

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, ENCODED)


@dataclass
class Model:
    """Vectors of context classes (the last is the start of a text) and next classes, position scales, biases."""

    context: np.ndarray
    next: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(weights: np.ndarray) -> Model:
        rng, m = np.random.default_rng(SEED), len(weights)
        share = (weights + 1) / (weights + 1).sum()
        return Model(
            rng.normal(0, 0.1, (m + 1, WIDTH)).astype(np.float32),
            rng.normal(0, 0.1, (m, WIDTH)).astype(np.float32),
            np.ones((CONTEXT, WIDTH), np.float32),
            np.log(share).astype(np.float32)[:, None],
        )

    def parts(self) -> dict[str, np.ndarray]:
        return {"context": self.context, "next": self.next, "scale": self.scale, "bias": self.bias}

    def squares(self) -> dict[str, np.ndarray]:
        return {name: np.full(p.shape, 1e-8, np.float32) for name, p in self.parts().items()}

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        return reduce(np.add, (self.context[contexts[:, i]] * self.scale[i] for i in range(CONTEXT)))


def contexts_of(classes: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The two classes before each token, the nearest first; texts end before ``ends``."""
    first = np.zeros(len(classes), bool)
    first[np.concatenate(([0], ends[:-1]))] = True
    out = np.full((len(classes), CONTEXT), start, np.int64)
    out[1:, 0] = classes[:-1]
    out[first, 0] = start
    out[1:, 1] = out[:-1, 0]
    out[first, 1] = start
    return out


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    # Classes have 16 bits, for which numpy's stable sort is a radix sort.
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[cut], np.add.reduceat(rows[order], cut, axis=0)


class Trainer:
    """Noise-contrastive gradient steps with per-parameter rates (AdaGrad).

    ``squares`` are the gradients' squares summed so far, which later parts go on with.
    """

    def __init__(self, model: Model, squares: dict[str, np.ndarray], weights: np.ndarray, seed: int):
        self.model, self.squares, self.rng = model, squares, np.random.default_rng(seed)
        share = (weights + 1) / (weights + 1).sum()
        self.steps, self.noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)

    def _move(self, name: str, at, grad: np.ndarray) -> None:
        squares, part = self.squares[name], self.model.parts()[name]
        square = squares[at] + grad * grad
        squares[at] = square
        part[at] += RATE * grad / np.sqrt(square)

    def step(self, contexts: np.ndarray, target: np.ndarray) -> None:
        m, size = self.model, len(target)
        n = np.float32(size)
        near = [m.context[contexts[:, i]] for i in range(CONTEXT)]
        hidden = reduce(np.add, (near[i] * m.scale[i] for i in range(CONTEXT)))
        noise = np.searchsorted(self.steps, self.rng.random(NOISE) * self.steps[-1]).clip(0, len(self.steps) - 1)
        nexts, noises = m.next[target], m.next[noise]
        true = (hidden * nexts).sum(axis=1) + m.bias[target, 0] - self.noise[target]
        up = (1 / (1 + np.exp(true.clip(-30, 30)))) / n
        # -1 / (1 + exp(-false)) / n, in one array.
        down = hidden @ noises.T
        down += m.bias[noise, 0]
        down -= self.noise[noise]
        np.clip(down, -30, 30, out=down)
        np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        down /= n
        dhidden = up[:, None] * nexts + down @ noises
        # Gradients of the next classes' vectors, and of their biases in the last column.
        grads = np.empty((size + NOISE, WIDTH + 1), np.float32)
        np.multiply(up[:, None], hidden, out=grads[:size, :WIDTH])
        grads[:size, WIDTH] = up
        np.matmul(down.T, hidden, out=grads[size:, :WIDTH])
        down.sum(axis=0, out=grads[size:, WIDTH])
        keys, rows = _summed(np.concatenate((target, noise)), grads)
        ckeys, crows = _summed(contexts.T.ravel(), np.concatenate([dhidden * m.scale[i] for i in range(CONTEXT)]))
        dscale = np.stack([(dhidden * near[i]).sum(axis=0) for i in range(CONTEXT)])
        self._move("next", keys, rows[:, :-1])
        self._move("bias", keys, rows[:, -1:])
        self._move("context", ckeys, crows)
        self._move("scale", slice(None), dscale)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts of a batch, one after the other, and where each ends."""
    raw = batch.column("classes").to_pylist()
    ends = np.cumsum([len(r) // 2 for r in raw])
    return np.frombuffer(b"".join(raw), np.uint16).astype(np.int64), ends


def train(encoded: DataFrame, weights: np.ndarray) -> Model:
    """A model of the training texts among ``encoded``, each read once."""
    model = Model.start(weights)
    squares = model.squares()
    if not weights.any():
        return model
    part = F.pmod(F.xxhash64("row"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        shared = encoded.sparkSession.sparkContext.broadcast((model, squares))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            start, sums = shared.value
            own = Model(**{name: p.copy() for name, p in start.parts().items()})
            trainer, seen = Trainer(own, {name: p.copy() for name, p in sums.items()}, weights, SEED + k), 0
            for batch in batches:
                for piece in (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS)):
                    classes, ends = _texts(piece)
                    contexts = contexts_of(classes, ends, len(weights))
                    for at in range(0, len(classes), STEP):
                        trainer.step(contexts[at : at + STEP], classes[at : at + STEP])
                    seen += len(classes)
            if seen:
                for name, p in own.parts().items():
                    both = np.column_stack((p, trainer.squares[name]))
                    columns = [pa.array([name] * len(p)), pa.array(np.arange(len(p))), pa.array([float(seen)] * len(p))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(both), pa.list_(pa.float32()))], ["name", "i", "n", "v"])

        mine = encoded.filter(~F.col("held_out") & (part == k)).select("classes")
        rows = mine.mapInArrow(run, "name string, i long, n double, v array<float>")
        mean = F.array(*[F.sum(F.col("n") * F.get("v", F.lit(j))) / F.sum("n") for j in range(2 * WIDTH)])
        parts = {name: p.copy() for name, p in model.parts().items()}
        for row in rows.groupBy("name", "i").agg(mean.alias("v")).collect():
            p, i = parts[row["name"]], row["i"]
            width = p.shape[1]
            p[i], squares[row["name"]][i] = row["v"][:width], row["v"][width : 2 * width]
        model = Model(**parts)
        shared.unpersist()
    return model


def normalisers(spark: SparkSession, model: Model) -> np.ndarray:
    """log of the sum of exp(score) over all next classes, for each pair of context classes."""
    m = len(model.context)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a in batch.column("id").to_pylist():
                pairs = np.column_stack((np.full(m, a), np.arange(m)))
                scores = own.hidden(pairs) @ own.next.T + own.bias[:, 0]
                top = scores.max(axis=1)
                z = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([z], pa.list_(pa.float32()))], ["a", "z"])

    found = spark.range(m).mapInArrow(run, "a long, z array<float>").toArrow()
    out = np.empty((m, m), np.float32)
    for a, z in zip(found.column("a").to_pylist(), found.column("z"), strict=True):
        out[a] = z.values.to_numpy()
    return out


def log_probabilities(model: Model, z: np.ndarray, classes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each class after its context."""
    out = np.empty(len(classes))
    for at in range(0, len(classes), BATCH):
        near, c = contexts[at : at + BATCH], classes[at : at + BATCH]
        out[at : at + BATCH] = (model.hidden(near) * model.next[c]).sum(axis=1) + model.bias[c, 0] - z[near[:, 0], near[:, 1]]
    return out


def predict(encoded: DataFrame, model: Model, masses: np.ndarray) -> DataFrame:
    """(row, class_score): log10 probability of each text's classes, less log10 of the mass of the rare ones."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((model, normalisers(spark, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, z = shared.value
        inside = np.where(np.arange(OWN + RARE) < OWN, 0.0, np.log10(masses))
        for batch in batches:
            for piece in (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS)):
                classes, ends = _texts(piece)
                contexts = contexts_of(classes, ends, OWN + RARE)
                each = log_probabilities(own, z, classes, contexts) / math.log(10) - inside[classes]
                sums = np.add.reduceat(each, np.concatenate(([0], ends[:-1])))
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(sums)], ["row", "class_score"])

    return encoded.select("row", "classes").mapInArrow(run, "row long, class_score double")


def score(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word counts) and score of every row.

    The model and the counts know only rows for which ``held_out`` is not true.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        whole(text).alias("text"),
    )
    counts = stage(count_words(own), "words")
    vocab = vocabulary(counts.df)
    encoded = stage(encode(own, vocab), "classes")
    model = train(encoded.df, vocab.weights)
    scored = stage(predict(encoded.df, model, vocab.masses), "scored")
    # A word that no training text has adds nothing: log10(0 + 1).
    rare = encoded.df.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    seen = counts.df.filter("c > 0").select("word", F.log10(F.col("c") + 1.0).alias("log"))
    rest = rare.join(seen, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("more"), F.sum("n").alias("found"))
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    unit = math.log10(vocab.n + vocab.v + 1)
    out = encoded.df.drop("classes", "rare").join(scored.df, "row").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + found).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("class_score") + F.col("rare_logs") + more).alias("score"),
    )
    done = stage(out, "lm")
    for gone in (counts, encoded, scored):
        remove(spark, gone.path)
    return done.df
