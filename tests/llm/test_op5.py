import re

import numpy as np
import xxhash

from loomgraph.llm import simhash
from loomgraph.llm.components import components
from loomgraph.llm.queries import QUERIES
from tests.llm.helpers import ODD, odd_documents, rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Smallest id reachable, by comparing all pairs."""
    ids, x = list(fps), np.array(list(fps.values()), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    label = np.array(ids)
    while True:
        new = np.where(near, label[None], label.max()).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


def check(got, want):
    fps = {i: fingerprint(t) for i, t in want.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == classes(fps)


def test_whole_table(spark, sf_dir):
    check(rows(QUERIES["op5_ball_hashing"](spark, sf_dir)), texts(sf_dir))


def test_odd_rows(spark):
    check(rows(simhash.near_duplicates(odd_documents(spark), passes=2)), dict(ODD))
    assert simhash.near_duplicates(odd_documents(spark).limit(0), passes=1).count() == 0


def test_links_of_close_fingerprints_are_complete(spark, tmp_path):
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    x = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7))) for c in centre for _ in range(60)}
    x = sorted(x)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in x], "fp long")
    for passes in (1, 8):
        found = components(simhash.links(df, f"{tmp_path}/{passes}", passes), f"{tmp_path}/c{passes}").collect()
        root = {r["node"]: r["root"] for r in found}
        want = classes(dict(zip(x, x, strict=True)))
        group = {v: root.get(int(np.uint64(v).view(np.int64)), int(np.uint64(v).view(np.int64))) for v in x}
        assert len(set(group.values())) == len(set(want.values()))
        assert len({(group[v], want[v]) for v in x}) == len(set(want.values()))


def test_long_chain_is_one_component(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, str(tmp_path)).collect()}
    assert got == {**{i: 1 for i in range(2, 201)}, 501: 500}


def test_one_document_of_each_group_stays(spark):
    docs = odd_documents(spark)
    stay = simhash.one_of_each(docs, passes=1)
    assert stay.columns == docs.columns
    ids = {r["doc_id"] for r in stay.collect()}
    assert 5 in ids and 6 not in ids and 1 in ids and 2 not in ids


def test_rows_without_an_id_stay_unless_a_document_with_one_is_near(spark):
    far = "nothing else in this table reads at all like this sentence does"
    docs = odd_documents(spark, [(None, far), (None, "same text here"), (None, None)])
    stay = [r["text"] for r in simhash.one_of_each(docs, passes=1).collect() if r["doc_id"] is None]
    assert stay == [far]
    ids = {r["doc_id"] for r in simhash.one_of_each(docs, passes=1).collect()}
    assert ids == {None} | {r["doc_id"] for r in simhash.one_of_each(odd_documents(spark), passes=1).collect()}
