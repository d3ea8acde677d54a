"""Quality scores from random-indexing word vectors, pooled per document, and a two-layer network.

Every token has a sparse random index vector that follows from its hash. The vector of a token is the sum of the
index vectors of its neighbours in all documents, labelled or not, so tokens of like company get like vectors. Each word gives
two tokens: itself, and its shape (letters, capitals, digits and punctuation in order, runs collapsed, and whether
it repeats the word before), so that words met once still have a known vector. Vectors are kept by the first bits of a
token's hash: no token is left out, rare ones may share a place, and the table has the same size for any corpus. Tasks add
up what they read in one such table each, in integers, so that sums do not depend on the order in which tasks end.

A document is the mean of its word vectors, the mean of its shape vectors, and two lengths. The network is trained in numpy on
a labelled sample; a temperature, fitted on labelled rows that the network did not see, calibrates its probabilities.

Bounds: at most ``most`` labelled documents of each class train the network (parameter), and the table has 2 ** PLACES
vectors (25 MB), which is what the driver gets and tasks are sent.

Defined results: a text without words has the zero vector and a score like any other; texts of any length are read whole; without
labelled rows of both classes all scores are 0.5; columns of documents other than id and text are not read; repeated ids each have a row;
an empty table gives no rows; labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import buffers, id_and_text, sliced
from loomgraph.llm.labelled import fold, sampled, sigmoid
from loomgraph.llm.words import FIRST, SECOND, U64, Words

SIZE, NONZERO, REACH = 48, 4, 2
#: Bits of a token's hash that give its row among the vectors.
PLACES = 17
FEATURES = 2 * SIZE + 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letter classes of a shape: a, A, 0; other ASCII characters stand for themselves.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123] = CLASS[128:] = ord("a")
CLASS[65:91] = ord("A")
CLASS[48:58] = ord("0")


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, and the hashes of each word (lower-cased) and of its shape."""
    words = Words(data, offsets)
    word = FIRST.of_bytes(LOWER[data], words.starts, words.ends)
    kind = CLASS[data]
    change = np.concatenate(([True], kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, bool)
    change[words.starts] = True
    at = np.concatenate(([0], np.cumsum(change)))
    shape = SECOND.of_bytes(kind[change], at[words.starts], at[words.ends])
    again = np.zeros(len(words), bool)
    again[1:] = (word[1:] == word[:-1]) & (words.text[1:] == words.text[:-1])
    return words, word, shape ^ np.where(again, U64(0xA5A5A5A5A5A5A5A5), U64(0))


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """(n, SIZE) small integers: NONZERO places and signs from the bits of the hash."""
    out = np.zeros((len(hashes), SIZE), np.int8)
    rows = np.arange(len(hashes))
    for k in range(NONZERO):
        bits = hashes >> U64(14 * k)
        np.add.at(out, (rows, (bits & U64(0x1FFF)).astype(np.int64) % SIZE), np.where(bits & U64(0x2000), np.int8(1), np.int8(-1)))
    return out


def place_of(hashes: np.ndarray) -> np.ndarray:
    """Row of a token in the table of vectors."""
    return (hashes * U64(0x9E3779B97F4A7C15) >> U64(64 - PLACES)).astype(np.int64)


def add_company(table: np.ndarray, words: Words, hashes: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours, up to REACH words away in the same text."""
    if not len(hashes):
        return
    distinct, at = np.unique(hashes, return_inverse=True)
    index = index_vectors(distinct)[at]
    near = np.zeros_like(index)
    for step in range(1, REACH + 1):
        if len(hashes) > step:
            same = (words.text[step:] == words.text[:-step]).astype(np.int8)[:, None]
            near[step:] += index[:-step] * same
            near[:-step] += index[step:] * same
    place = place_of(hashes)
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], place[order][1:] != place[order][:-1])))
    table[place[order][first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)


@dataclass
class Vectors:
    """Unit vectors by place."""

    rows: np.ndarray

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, FEATURES) of the texts of a slice."""
        words, word, shape = tokens(data, offsets)
        n = np.maximum(words.counts, 1)[:, None]
        out = np.zeros((len(words.counts), FEATURES), np.float32)
        some = np.flatnonzero(words.counts)
        for k, hashes in enumerate((word, shape)):
            if len(some):
                out[some, k * SIZE : (k + 1) * SIZE] = np.add.reduceat(self.rows[place_of(hashes)], words.bounds[some], axis=0)
        out[:, : 2 * SIZE] /= n
        out[:, -2] = np.log1p(words.counts) / 8
        out[:, -1] = np.log1p(np.diff(offsets) / n[:, 0]) / 4
        return out


@dataclass
class Network:
    """Two layers over standardised features; the temperature divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
    """Full-batch Adam on the cross-entropy, both classes with equal weight."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    parts = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for t in range(1, rounds + 1):
        inner = z @ parts[0] + parts[1]
        out = np.maximum(inner, 0)
        error = weight * (sigmoid(out @ parts[2] + parts[3]) - y)
        back = np.outer(error, parts[2]) * (inner > 0)
        slopes = [z.T @ back + decay * parts[0], back.sum(axis=0), out.T @ error + decay * parts[2], error.sum(keepdims=True)]
        for p, m, v, g in zip(parts, first, second, slopes, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]))


def calibrated(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature with the least cross-entropy on rows that training did not use."""
    if len(y):
        z = net.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(20), 120))
        loss = [np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t)) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def token_vectors(texts: DataFrame) -> Vectors:
    """Vectors of all tokens of all texts: one table of sums a task, added up part by part."""
    parts, size = 512, (1 << PLACES) // 512

    def run(batches):
        table = np.zeros((1 << PLACES, SIZE), np.int64)
        for batch in batches:
            for part in sliced(batch, 0):
                words, word, shape = tokens(*buffers(part.column(0)))
                for hashes in (word, shape):
                    add_company(table, words, hashes)
        for g in range(parts):
            own = table[g * size : (g + 1) * size]
            if own.any():
                small = next(t for t in (np.int16, np.int32, np.int64) if np.abs(own).max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([np.dtype(small).itemsize], pa.int32()), pa.array([own.astype(small).tobytes()], pa.binary())], names=["g", "width", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(g, np.zeros((size, SIZE), np.int64))
                sums[g] += np.frombuffer(raw, f"<i{width}").reshape(size, SIZE)
        for g, x in sums.items():
            unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([unit.tobytes()], pa.binary())], names=["g", "rows"])

    summed = texts.select("text").mapInArrow(run, "g int, width int, sums binary").repartition("g").mapInArrow(add, "g int, rows binary")
    rows = np.zeros((1 << PLACES, SIZE), np.float32)
    for r in summed.toLocalIterator():
        rows[r["g"] * size : (r["g"] + 1) * size] = np.frombuffer(r["rows"], np.float32).reshape(size, SIZE)
    return Vectors(rows)


def quality(docs: DataFrame, labels: DataFrame, most: int = 2000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col)
    key = base.schema["doc_id"].dataType.simpleString()
    chosen = sampled(labels.select(F.col(id_col).alias("doc_id"), label), label, most).toArrow()
    finish = lambda df: df.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    if len(set(chosen["y"].to_pylist())) < 2:
        return finish(base.select("doc_id", F.lit(0.5).alias("score")))
    # 2 * most rows at most.
    texts = base.join(F.broadcast(spark.createDataFrame(chosen)), "doc_id").select("text", "y", "fold")
    vectors = token_vectors(base)
    sent = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            for part in sliced(batch, 0):
                x = sent.value.pooled(*buffers(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "fold", "x"])

    got = texts.mapInArrow(pool, "y int, fold int, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    y, part_of = got["y"].to_numpy(), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y))  # not the order in which tasks ended
    x, y, part_of = x[order], y[order], part_of[order]
    net = calibrated(train(x[part_of != 4], y[part_of != 4]), x[part_of == 4], y[part_of == 4])
    sent_net = spark.sparkContext.broadcast(net)

    def score(batches):
        for batch in batches:
            for part in sliced(batch, 1):
                s = sent_net.value.score(sent.value.pooled(*buffers(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    return finish(base.mapInArrow(score, f"doc_id {key}, score double"))
