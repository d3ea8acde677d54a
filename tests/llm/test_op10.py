import random

import duckdb
import numpy as np
import pyarrow as pa

from loomgraph.llm import random_indexing as ri
from loomgraph.llm.common import buffers
from loomgraph.llm.queries import QUERIES
from tests.llm.helpers import ODD, odd_documents, rows, texts


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(("ka", "ro", "mi", "tel", "su", "ban")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(15, 90))]
        kind = i % 4
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            words = [w for w in words for _ in range(6)][: len(words)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind in (0, 3))))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    got = rows(ri.quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")))
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_whole_table(spark, sf_dir):
    got = rows(QUERIES["op10_random_indexing"](spark, sf_dir))
    assert got.keys() == texts(sf_dir).keys()


def test_odd_rows_and_missing_labels(spark):
    docs, labels = corpus(120)
    frame = spark.createDataFrame([*[(100_000 + i, y) for i, y in labels], (1, None)], "doc_id long, quality int")
    table = odd_documents(spark, [(100_000 + i, t) for i, t in docs])
    got = rows(ri.quality(table, frame))
    assert all(0 <= got[i]["score"] <= 1 for i, _ in ODD) and got[5]["score"] == got[6]["score"] and got[1]["score"] == got[2]["score"]
    assert {r["score"] for r in ri.quality(table, frame.limit(0)).collect()} == {0.5}
    assert ri.quality(table.limit(0), frame.limit(0)).count() == 0


def plain_vectors(all_texts):
    """Unit vectors by place, by plain loops over every text."""
    table = np.zeros((1 << ri.PLACES, ri.SIZE))
    for text in all_texts:
        words, word, shape = ri.tokens(*buffers(pa.array([text or ""])))
        for hashes in (word, shape):
            index, place = ri.index_vectors(hashes), ri.place_of(hashes)
            for i in range(len(hashes)):
                for j in range(max(0, i - ri.REACH), min(len(hashes), i + ri.REACH + 1)):
                    if i != j:
                        table[place[i]] += index[j]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def test_vectors_and_pooling_equal_plain_loops(spark):
    table = odd_documents(spark, [(100 + i, t) for i, t in corpus(40)[0]]).repartition(7)
    all_texts = [r["text"] for r in table.collect()]
    vectors = ri.token_vectors(table)
    rows_ = plain_vectors(all_texts)
    assert np.array_equal(vectors.rows, rows_)
    got = vectors.pooled(*buffers(pa.array([t or "" for t in all_texts])))
    for text, x in zip(all_texts, got, strict=True):
        _, word, shape = ri.tokens(*buffers(pa.array([text or ""])))
        n = max(len(word), 1)
        want = [*sum(rows_[ri.place_of(word)], np.zeros(ri.SIZE)) / n, *sum(rows_[ri.place_of(shape)], np.zeros(ri.SIZE)) / n, np.log1p(len(word)) / 8, np.log1p(len((text or "").encode()) / n) / 4]
        assert np.allclose(x, want, atol=1e-4)


def test_scores_are_reproducible_and_held_out_rows_are_ranked(spark):
    sf = "/root/testdata/sf0.01"
    runs = [{r["doc_id"]: (r["score"], r["held_out"]) for r in QUERIES["op10_random_indexing"](spark, sf).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    y = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet' where quality is not null").fetchall())
    good, bad = ([s for i, (s, held) in runs[0].items() if held and y.get(i) == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + rng.normal(0, 1.0, 300) > 0).astype(int)
    net = ri.train(x[:150], y[:150], rounds=800)
    loss = lambda: -np.mean(np.log(np.where(y[150:] == 1, net.score(x[150:]), 1 - net.score(x[150:])) + 1e-12))
    before = loss()
    ri.calibrated(net, x[150:], y[150:])
    assert loss() <= before + 1e-9
