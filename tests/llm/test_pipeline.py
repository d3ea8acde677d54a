import random

import numpy as np
import xxhash

import corpus_pipeline
from loomgraph.llm import line_crf, mixing, simhash
from tests.llm.helpers import odd_documents, texts
from tests.llm.test_op2 import base
from tests.llm.test_op4 import brute
from tests.llm.test_op5 import LOW, WORD


def fingerprint(text, k=5):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def word_prints(text):
    """Bit sums over the distinct words, lane by lane."""
    words = sorted(set(WORD.findall((text or "").translate(LOW))))
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 43) for w in words], np.uint64)
    out = []
    for k in range(simhash.LANES):
        h = [int(x) for x in simhash.lane_of(hashes, k)]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return out


def grouped(docs):
    """Smallest id reachable by shingle links (4 bits) or word links (4 bits in a lane, and 16 by shingles), over all pairs."""
    ids, prints = list(docs), np.array([fingerprint(t) for t in docs.values()], np.uint64)
    bits = np.bitwise_count(prints[:, None] ^ prints[None])
    near = bits <= 4
    lanes = np.array([word_prints(t) for t in docs.values()], np.uint64)
    for k in range(lanes.shape[1]):
        near |= (np.bitwise_count(lanes[:, None, k] ^ lanes[None, :, k]) <= 4) & (bits <= 16)
    label = np.array(ids)
    while True:
        new = np.where(near, label[None], label.max()).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


def test_near_copies_with_a_similarity_of_four_fifths_go(spark):
    """Copies with 2 % of their words changed: at least nine of ten go; unrelated texts stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
    common = [word() for _ in range(3000)]
    text = lambda n: [rng.choice(common) for _ in range(n)]
    rows, similar = [], 0
    for i in range(100):
        own = text(rng.randint(80, 400))
        copy = [word() if rng.random() < 0.02 else w for w in own]
        sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (own, copy)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            similar += 1
            rows.append((1000 + i, " ".join(copy)))
        rows.append((i, " ".join(own)))
    left = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), passes=1).collect()}
    assert similar > 50 and left >= set(range(100)) and len(left) - 100 <= 0.1 * similar


def test_run_equals_a_plain_version(spark, sf_dir):
    """Every stage by brute force, but for the two learned or sampled decisions, which are taken from their operators."""
    docs = texts(sf_dir)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = {r["doc_id"]: r["kept"] for r in line_crf.line_quality(table).collect()}
    docs = {i: t for i, t in docs.items() if labelled[i]}
    assert not any(base(t)["base_failed"] for t in docs.values())
    group = grouped(docs)
    docs = {i: t for i, t in docs.items() if group[i] == i}
    cut = brute(docs)
    docs = {i: cut[i][2] if cut[i][1] else t for i, t in docs.items() if cut[i][1] < cut[i][0] or not cut[i][0]}
    third = [r for r in table.collect() if r["doc_id"] in docs]
    left = spark.createDataFrame([(r["doc_id"], docs[r["doc_id"]], r["lang"], r["source"]) for r in third], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in mixing.chances(left).filter("kept").collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == kept and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got.values())


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    table = odd_documents(spark)
    for docs in (table, table.limit(0)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, docs = docs.columns, stage(spark, docs, "")
            assert k == 4 or docs.columns == before
        docs.collect()
