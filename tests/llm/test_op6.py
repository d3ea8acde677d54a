import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from loomgraph.llm import kneser_ney as kn
from loomgraph.llm.common import buffers
from loomgraph.llm.labelled import logistic, sampled
from loomgraph.llm.queries import QUERIES
from tests.llm.helpers import ODD, odd_documents, rows, texts


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ran", "tol", "mer", "sib", "cor", "dan") for b in ("a", "eto", "iv", "und", "ost", "er", "il")]
    bad = ["grumbag", "wretchel", "nastorp"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 120))]
        y = i % 3 == 0
        if y:
            for _ in range(2 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(("", "en", "s"))
        docs.append((i, " ".join(words)))
        labels.append((i, int(y)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    got = rows(kn.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert {i for i in got if got[i]["held_out"]} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_whole_table(spark, sf_dir):
    got = rows(QUERIES["op6_kneser_ney"](spark, sf_dir))
    assert got.keys() == texts(sf_dir).keys()


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (rows(kn.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int"))) for x in (labels, turned))
    assert all(abs(a[i]["score"] - b[i]["score"]) < 1e-12 for i in a)


def test_odd_rows_and_missing_labels(spark):
    docs, labels = corpus(150)
    frame = spark.createDataFrame([*[(100_000 + i, y) for i, y in labels], (1, None), (None, 1)], "doc_id long, toxic int")
    table = odd_documents(spark, [(100_000 + i, t) for i, t in docs])
    got = rows(kn.toxicity(table, frame))
    assert all(0 <= got[i]["score"] <= 1 for i, _ in ODD) and got[5]["score"] == got[6]["score"] and got[1]["score"] == got[2]["score"]
    assert {r["score"] for r in kn.toxicity(table, frame.limit(0)).collect()} == {0.5}
    assert kn.toxicity(table.limit(0), frame.limit(0)).count() == 0


def test_rare_expressions_count(spark):
    """A stem in two toxic training texts and in no ordinary one is evidence, more so than a word nobody has."""
    docs, labels = corpus()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    marked = [i for i, y in labels if y and fold(i) in (1, 2, 3)][:2]
    docs = [(i, f"{t} zyxoquent" if i in marked else t) for i, t in docs]
    docs += [(9001, "rana zyxoquent coril"), (9002, "rana quvabble coril")]
    got = rows(kn.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert got[9001]["whole"] > got[9002]["whole"] + 0.01 and got[9001]["stretch"] > got[9002]["stretch"] + 0.01


def plain_differences(docs, labels):
    """Both log-likelihood differences of every document, from dictionaries: a second writing of the model."""
    stems = lambda t: [w[: kn.STEM] for w in "".join(" " if c in ".,;:!?\"'()[]{}*#$%&|<>" else c for c in t.lower()).split()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    train = [(stems(t), dict(labels)[i]) for i, t in docs if i in dict(labels) and fold(i) in (1, 2, 3)]
    texts_of = [sum(y == c for _, y in train) for c in (0, 1)]
    pairs = [Counter(p for ws, y in train if y == c for p in set(zip(["^", *ws], ws, strict=False))) for c in (0, 1)]
    names = {w for c in (0, 1) for _, w in pairs[c]}
    everything = Counter(w for _, t in docs for w in stems(t))
    total = sum(everything.values())
    off = lambda n, most: n * n / (n + most) if n else 0.0

    def model(c):
        before = Counter(w for _, w in pairs[c])
        types = max(len(pairs[c]), 1)
        share = {w: off(before[w], kn.WORD_DISCOUNT * texts_of[c]) / types for w in names}
        back = 1 - sum(share.values())
        shared = lambda w: ((everything[w] if w in names else 0) + 1) / (total + len(names) + 1)
        context = Counter()
        for (u, _), n in pairs[c].items():
            context[u] += n
        kept = {p for k in (0, 1) for p in pairs[k] if p[0] in names}
        gain = {p: off(pairs[c][p], kn.PAIR_DISCOUNT * texts_of[c]) / max(context[p[0]], 1) for p in kept}
        stay = {u: 1 - sum(g for p, g in gain.items() if p[0] == u) for u in names}

        def chance(u, w):
            low = share.get(w, 0.0) + back * shared(w)
            return gain[u, w] + stay[u] * low if (u, w) in kept else stay.get(u, 1.0) * low

        return chance

    chances = [model(c) for c in (0, 1)]
    out = {}
    for i, t in docs:
        ws = stems(t)
        d = [np.log(chances[1](u, w) / chances[0](u, w)) for u, w in zip(["^", *ws], ws, strict=False)]
        k = kn.STRETCH
        out[i] = (sum(d) / max(len(d), 1), max((sum(d[a : a + k]) / k for a in range(len(d) - k + 1)), default=sum(d) / k))
    return out


def test_differences_equal_plain_dictionaries(spark):
    docs, labels = corpus(200)
    docs += [(5000, "grumbag mertol"), (5001, "nobody knows"), (5002, "")]
    got = rows(kn.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    for i, (whole, stretch) in plain_differences(docs, labels).items():
        assert abs(got[i]["whole"] - whole) < 1e-8 and abs(got[i]["stretch"] - stretch) < 1e-8, i


def test_held_out_rows_of_a_table_are_ranked(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(QUERIES["op6_kneser_ney"](spark, sf))
    y = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet' where toxic is not null").fetchall())
    bad, good = ([r["score"] for i, r in got.items() if r["held_out"] and y.get(i) == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.8


def test_sample_is_bounded(spark):
    frame = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    assert sampled(frame, "toxic", 20).groupBy("y").count().orderBy("y").collect() == [(0, 20), (1, 20)]


def test_probabilities_sum_to_one():
    """Over the vocabulary and the unknown word, each class's probabilities after a known word add up to 1."""
    data, offsets = buffers(pa.array(["one two one three two one two", "two four one two five two"]))
    words, u, w = kn.tokens(data, offsets)
    distinct = sorted(set(zip(u.tolist(), w.tolist(), strict=True)))
    u2, w2 = (np.array(x, np.uint64) for x in zip(*distinct, strict=True))
    counts = np.array([[sum(1 for a, b, t in zip(u.tolist(), w.tolist(), words.text, strict=True) if (a, b, t) == (x, y, c)) for c in (0, 1)] for x, y in distinct])
    everything = np.unique(w)
    model = kn.fit(u2, w2, counts, lambda names: (np.array([(w == x).sum() for x in names]), len(w)), least=1)
    for context in everything:
        p = np.exp(model.log_likelihoods(np.full(len(everything), context), everything))
        unknown = np.exp(model.log_likelihoods(np.array([context]), np.array([12345], np.uint64)))
        assert np.all(p.sum(axis=0) + unknown[0] < 1.02) and np.all(p.sum(axis=0) > 0.8)


def test_logistic_finds_the_border():
    x = np.linspace(-1, 1, 200)[:, None]
    w = logistic(x, (x[:, 0] > 0.3).astype(float), np.ones(200))
    assert abs(-w[1] / w[0] - 0.3) < 0.05


def test_every_labelled_text_counts(spark):
    """5,000 toxic training texts, over any sample's size: an expression of the last of them by id hash is still known."""
    from pyspark.sql import functions as F

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = [i for i in range(9000) if fold(i) in (1, 2, 3)][:5000]
    last = spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.xxhash64("doc_id").desc()).first()[0]
    docs = [(i, "bad words zyxoquent" if i == last else "bad words") for i in ids] + [(20_000 + i, "good words") for i in range(100)]
    docs += [(90_001, "words zyxoquent"), (90_002, "words quvabble")]
    labels = [(i, 1) for i in ids] + [(20_000 + i, 0) for i in range(100)]
    got = rows(kn.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert got[90_001]["whole"] != got[90_002]["whole"]


def test_logistic_on_a_table_equals_logistic(spark):
    from pyspark.sql import functions as F

    from loomgraph.llm.labelled import logistic_of

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0.5).astype(int)
    table = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "whole double, stretch double, y int")
    got = logistic_of(table, ["whole", "stretch"], F.when(F.col("y") == 1, 2.0).otherwise(0.5))
    assert np.allclose(got, logistic(x, y, np.where(y == 1, 2.0, 0.5)), atol=1e-8)
