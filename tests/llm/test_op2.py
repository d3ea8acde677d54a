import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgraph.llm import line_crf as crf
from loomgraph.llm.common import buffers
from loomgraph.llm.queries import QUERIES
from loomgraph.llm.words import Words
from tests.llm.helpers import ODD, odd_documents, rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, repeat = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            repeat.update(range(i, i + 8))
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup, "n_repeat_words": len(repeat), "base_failed": n < 20 or 100 * len(repeat) > 30 * n,
    }


def check(got, want):
    assert got.keys() == want.keys()
    for i, text in want.items():
        r, b = got[i], base(text)
        assert {k: r[k] for k in b} == b, i
        assert not (r["kept"] and r["base_failed"])
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert r["n_lines"] == len(lines)


def test_base_of_whole_table(spark, sf_dir):
    check(rows(QUERIES["op2_line_crf"](spark, sf_dir)), texts(sf_dir))


def test_odd_rows(spark):
    check(rows(crf.line_quality(odd_documents(spark))), dict(ODD))
    assert crf.line_quality(odd_documents(spark).limit(0)).count() == 0


def test_kept_documents_keep_their_columns(spark):
    extra = [(20, "This is a plain sentence with quite a few words in it. Nothing in it is said twice, so far as one can see. Another one follows here, and it ends well.")]
    docs = odd_documents(spark, extra)
    kept = crf.kept_documents(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [20]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 5, 3, 0, 8])
    bounds = np.concatenate(([0], np.cumsum(counts)))
    score, turns = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
    got = crf.viterbi(score, bounds, turns)
    for a, b in itertools.pairwise(bounds):
        def total(y):
            return sum(s for s, k in zip(score[a:b], y, strict=True) if k) + sum(turns[p][q] for p, q in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=b - a), key=total)
        assert abs(total(best) - total(got[a:b])) < 1e-9


def plain_features(text):
    """One row of features for each line with words, by plain loops over bytes."""
    out, seen = [], set()
    for line in (text or "").split("\n"):
        words, raw = WORD.findall(line), line.encode()
        if not words:
            continue
        n = len(words)
        upper = sum(65 <= c < 91 for c in raw)
        letters = sum(65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in raw)
        again = sum(a == b for a, b in itertools.pairwise(words))
        out.append([1, min(len(re.findall(r"[#*$%&|<>]", line)) / n, 3), upper / max(letters, 1), min(raw.count(b"!") / n, 3), line in seen, again / n, words[-1][-1] in ".!?:;\"')", np.log1p(n) / 5])
        seen.add(line)
    return np.array(out, float).reshape(-1, len(crf.FEATURES))


def plain_content(text, model):
    """Words in content lines, by a plain Viterbi."""
    scores = plain_features(text) @ np.array(model.weights)
    sizes = [len(WORD.findall(x)) for x in (text or "").split("\n") if WORD.search(x)]
    best, t = [(0.0, [0]), (scores[0], [1])] if len(scores) else [(0.0, []), (-1.0, [])], model.transitions
    for s in scores[1:]:
        best = [max(((best[p][0] + t[p][q] + s * q, best[p][1] + [q]) for p in (0, 1)), key=lambda x: x[0]) for q in (0, 1)]
    labels = max(best, key=lambda x: x[0])[1]
    return sum(n for n, y in zip(sizes, labels, strict=True) if y == 0)


def test_features_shares_and_verdicts_equal_a_plain_version(spark, sf_dir):
    model, want = crf.LineCrf(), {**texts(sf_dir), **{-i: t for i, t in ODD}}
    got = rows(crf.line_quality(spark.createDataFrame(list(want.items()), "doc_id long, text string")))
    for i, text in want.items():
        own = crf.Lines(Words(*buffers(pa.array([text or ""])))).features
        assert np.allclose(own, plain_features(text)), i
        share = plain_content(text, model) / max(got[i]["n_words"], 1)
        assert abs(got[i]["content_share"] - share) < 1e-12, i
        assert got[i]["kept"] == (not got[i]["base_failed"] and share >= model.min_content), i


def test_slopes_equal_differences():
    rng = np.random.default_rng(4)
    bounds = np.concatenate(([0], np.cumsum([3, 0, 1, 6, 2])))
    score, turns, y = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2)), rng.integers(0, 2, bounds[-1])
    value, by_line, by_step = crf.chain_gradient(score, y, bounds, turns)
    every = 0.0
    for a, b in itertools.pairwise(bounds):
        total = lambda z, a=a, b=b: sum(s for s, k in zip(score[a:b], z, strict=True) if k) + sum(turns[p][q] for p, q in itertools.pairwise(z))
        every += total(y[a:b]) - np.log(sum(np.exp(total(z)) for z in itertools.product((0, 1), repeat=b - a)))
    assert abs(every - value) < 1e-9
    for k in range(len(score)):
        step = np.eye(len(score))[k] * 1e-5
        assert abs((crf.chain_gradient(score + step, y, bounds, turns)[0] - crf.chain_gradient(score - step, y, bounds, turns)[0]) / 2e-5 - by_line[k]) < 1e-6
    for p, q in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[p, q] = 1e-5
        assert abs((crf.chain_gradient(score, y, bounds, turns + step)[0] - crf.chain_gradient(score, y, bounds, turns - step)[0]) / 2e-5 - by_step[p, q]) < 1e-6


def test_a_fitted_model_tells_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    model = crf.fitted(docs, labels)
    got = crf.line_quality(docs, model).join(labels, "doc_id").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 AND NOT base_failed").groupBy("quality").agg({"kept": "count", "content_share": "avg"}).collect()
    share = {r["quality"]: r["avg(content_share)"] for r in got}
    assert share[1] > 0.9 and share[0] < 0.5


def test_fit_recovers_marked_lines():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    x = np.stack([np.ones(300), y * 1.0 + rng.normal(0, 0.1, 300)], axis=1)
    bounds = np.arange(0, 301, 10)
    m = crf.fit(x, y, bounds, rounds=300)
    assert (crf.viterbi(x @ np.array(m.weights), bounds, m.transitions) == y).mean() > 0.95


def test_junk_goes_and_prose_stays(spark):
    prose = "The quick fox ran over the hill and into the wood, where it slept. " * 1 + "Nobody saw it again until the spring came round.\nThen it was seen by all."
    junk = "\n".join(" ".join(f"{w}{i}$$$" for i in range(12)) for w in ("ab", "cd", "ef"))
    got = rows(crf.line_quality(spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")))
    assert got[1]["kept"] and not got[2]["kept"]
