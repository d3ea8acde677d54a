import re
import textwrap

import pytest

from loomgraph.llm import licenses
from loomgraph.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import ODD, odd_documents, rows
from tests.llm.test_op7 import against_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

NOTICES = [
    (100, "Released under the MIT License."), (101, "Licensed under CC BY-NC 4.0."), (102, "Apache License,\nVersion 2.0"),
    (103, "x under the MIT license under the MIT license and CC\tBY/NC."), (104, "apache license version 20"), (105, "All rights reserved"),
    (106, "Licensed under the Apache License, Version 2.0 (the License)"), (107, "the MIT license under"), (108, "filler " * 200 + "this work is licensed under a Creative Commons Attribution 4.0 international license " + "tail " * 90),
    (109, "mİt under the mit licenſe"), (110, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), (111, "UNDER THE MIT LICENSE\x7f2"),
    (112, "this wor\u212a is licensed under a creative commons attribution 4 0 international license"), (113, "all \u212a rights\n# reserved " * 40),
]


def brute(text):
    low = (text or "").translate(LOW)
    words = WORD.findall(low)
    places, own = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        own |= {label} if found else set()
    best, more = 0.0, set(own)
    for label, t, size in licenses.flat(licenses.TEMPLATES):
        for s in range(0, max(len(words) - size // 2, 1), size // 2):
            c = len(set(words[s : s + size]) & set(t)) / len(t)
            if c >= licenses.THRESHOLD - 1e-12:
                best, more = max(best, c), more | {label}
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(more)), "score": 1.0 if own else pytest.approx(best, abs=1e-6),
    }


def test_query_equals_sql(spark, sf_dir):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    against_sql(rows(QUERIES["op8_license_join"](spark, sf_dir)), ORACLES["op8_license_join"], sf_dir, names)


def test_notices_and_odd_rows_equal_brute_force(spark):
    table = odd_documents(spark, NOTICES)
    got = rows(licenses.licenses(table))
    for i, text in [*ODD, *NOTICES]:
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, i
    assert got[100]["labels"] == "mit" and got[105]["labels"] == "rights-reserved" and "cc-by" in got[108]["labels"].split(",")
    assert got[103]["n_base"] == 3 and got[104]["n_base"] == 0
    assert licenses.licenses(table.limit(0)).count() == 0


def wrapped(text, width, mark=""):
    return "".join(f"{mark}{line}\n" for line in textwrap.wrap(text, width))


def test_wrapped_notices_are_found(spark):
    """Whole notices, broken into comment lines, in the midst of other text, with a tenth of their words changed; and half of one."""
    filler = "".join(f"int value_{i} = compute(i, {i});\n" for i in range(300))
    want = {}
    for k, (label, texts) in enumerate(sorted(licenses.TEMPLATES.items())):
        want[200 + k] = (label, filler + wrapped(texts[-1], 40, " * ") + filler)
    mit = licenses.TEMPLATES["mit"][-1].split()
    want[300] = ("mit", wrapped(" ".join("changed" if i % 20 == 7 else w for i, w in enumerate(mit)), 72, "// "))
    assert len(licenses.TEMPLATES["bsd"][-1].split()) > 180
    docs = spark.createDataFrame([(i, text) for i, (_, text) in want.items()] + [(400, wrapped(" ".join(mit[20:80]), 60))], "doc_id long, text string")
    got = rows(licenses.licenses(docs))
    for i, (label, text) in want.items():
        assert label in got[i]["labels"].split(","), (i, label)
        assert got[i]["labels"] == brute(text)["labels"], i
    assert "mit" not in got[400]["labels"].split(",")


def test_rows_with_one_id_keep_their_own_finds(spark):
    texts = ["plain", "all rights reserved", "all rights reserved", None, None]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(None, t) for t in texts], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["labels"]) for r in licenses.licenses(docs).collect())
    one = [(0, ""), (0, ""), (1, ""), (3, "rights-reserved"), (3, "rights-reserved")]
    assert got == sorted((i, *x) for i in ("1", "None") for x in one)


def test_main_path_has_no_python(spark, sf_dir):
    plan = QUERIES["op8_license_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
