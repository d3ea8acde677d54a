import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from loomgraph.llm import phrases
from loomgraph.llm.common import buffers
from loomgraph.llm.phrases import Repeats
from loomgraph.llm.queries import QUERIES
from loomgraph.llm.words import SECOND, Words
from tests.llm.helpers import ODD, odd_documents, rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n=50):
    """(n_words, n_removed, kept words) by comparing every window of every document."""
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def check(got, docs):
    want = brute(docs)
    assert got.keys() == want.keys()
    for i, (n, removed, kept) in want.items():
        assert (got[i]["n_words"], got[i]["n_removed"]) == (n, removed), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest(), i


def test_whole_table(spark, sf_dir):
    check(rows(QUERIES["op4_phrase_automata"](spark, sf_dir)), texts(sf_dir))


def awkward():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(n))
    passage, other, exact = say(120), say(50), say(49)
    docs = {100 + k: f"{say(rng.randint(0, 60))}\n{passage if k % 3 else other}\t{say(rng.randint(0, 60))}" for k in range(30)}
    docs |= {200: f"{say(5)} {exact} {say(5)}", 201: f"{say(5)} {exact} {say(5)}"}  # one word short
    docs |= {210: "w " * 300, 211: "w " * 70, 212: "w " * 49}  # one window, everywhere
    docs |= {220: passage + " " + passage, 221: other + " " + passage[10:] + " " + other, 222: passage, 223: "  ".join(passage.split())}
    docs |= {230: f"{passage[:-1]} {say(3)}", 231: passage.replace(" ", "\n", 7), 232: "x" + passage}
    return docs


def test_awkward_passages_and_odd_rows(spark):
    docs = awkward()
    check(rows(Repeats(odd_documents(spark, list(docs.items()))).report()), {**dict(ODD), **docs})


def test_passages_of_one_to_three_windows(spark):
    """Where a passage has few windows, each counts: their anchors lie anywhere in them, at both ends too."""
    rng = random.Random(50)
    say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 10**6)) for _ in range(n))
    docs = {}
    for k in range(600):
        passage = say(50 + k % 3)
        docs |= {1000 + k: f"{say(rng.randint(0, 9))} {passage} {say(rng.randint(0, 9))}", 2000 + k: f"{say(rng.randint(0, 9))} {passage} {say(rng.randint(0, 9))}"}
    check(rows(Repeats(odd_documents(spark, list(docs.items()))).report()), {**dict(ODD), **docs})


def test_empty_table(spark):
    assert Repeats(odd_documents(spark).limit(0)).report().count() == 0


def test_automata_find_the_passages(spark, monkeypatch):
    """With empty automata nothing is found: places come from them, not from the anchors."""
    docs = awkward()
    table = odd_documents(spark, list(docs.items()))
    words = WORD.findall(docs[222])
    segment = pa.array([" ".join(words[:60])])
    shard = phrases.Shard()
    h = np.array([7], np.int64)
    own = Words(*buffers(segment))
    start = np.array([3])
    w = SECOND.of_words(own.hashes(SECOND), start, start + 50).view(np.int64)
    shard.rows.append((h, w, np.array([1], np.int64)))
    assert len(shard.compiled().spans(np.array([5]), np.array([0]), segment)[0]) == 0
    shard = phrases.Shard()
    shard.rows.append((h, w, np.array([1], np.int64)))
    shard.phrases[" ".join(words[20:28])] = 7
    assert [x.tolist() for x in shard.compiled().spans(np.array([5]), np.array([0]), segment)] == [[5], [3], [53]]
    assert Repeats(table).ranges.count() > 30


def test_clashing_columns(spark):
    docs = [(i, f"{'a b c d e f g h i j ' * 6}{i}", i, "x", 2.0) for i in range(3)]
    out = Repeats(spark.createDataFrame(docs, "doc_id long, text string, ranges int, own_id string, new_text double")).documents()
    assert out.columns == ["doc_id", "text", "ranges", "own_id", "new_text"]
    assert sorted((r[0], r[2], r[3], r[4]) for r in out.collect()) == [(0, 0, "x", 2.0), (1, 1, "x", 2.0), (2, 2, "x", 2.0)]


def test_documents_lose_what_the_report_says(spark):
    docs = awkward()
    table = odd_documents(spark, list(docs.items()))
    out = Repeats(table).documents()
    assert out.columns == table.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, (n, removed, kept) in brute({**dict(ODD), **docs}).items():
        if removed == 0:
            assert got[i] == {**dict(ODD), **docs}[i]
        elif removed == n:
            assert i not in got
        else:
            assert got[i] == kept
