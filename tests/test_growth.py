"""Steps whose work must not outgrow the input: what is read again, and what is sent."""

from collections import Counter, defaultdict

import pytest

from loomgraph import catalog
from loomgraph.functions import terms as t
from loomgraph.operators import findings, paths, patterns, validation
from loomgraph.sources import nodes as nd
from loomgraph.sources import triples as tr


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def reachable(pairs, seeds, zero):
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    out = set()
    for s in seeds:
        seen, todo = set(), set(after[s])
        while todo:
            seen |= todo
            todo = {y for x in todo for y in after[x]} - seen
        out |= {(s, x) for x in seen | ({s} if zero else set())}
    return out


CHAIN = [(f"c{i:02}", f"c{i + 1:02}") for i in range(24)]
ROUNDABOUT = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "e"), ("e", "e"), ("e", "f"), ("a", "c")]


@pytest.mark.parametrize("zero", [True, False])
@pytest.mark.parametrize("seeds", [["a"], ["c00"], ["f"], ["a", "b", "d", "c00", "c20", "nowhere"]])
def test_walks_end_with_each_pair_once(spark, zero, seeds):
    pairs = CHAIN[-4:] + ROUNDABOUT + CHAIN[:2]
    step = spark.createDataFrame([("r", a, b) for a, b in pairs], "rid string, start string, end string")
    got = paths.walk(step, spark.createDataFrame([("r", s) for s in seeds], "rid string, start string"), zero=zero)
    rows = [(r["start"], r["end"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == reachable(pairs, seeds, zero)


def test_long_walks_compare_with_all_before_a_few_times(spark, monkeypatch):
    made, written = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, path, name: (made.append(name), written(df, path, name))[1])
    step = spark.createDataFrame([("r", a, b) for a, b in CHAIN], "rid string, start string, end string")
    got = paths.walk(step, step.select("rid", "start").distinct())
    assert {(r["start"], r["end"]) for r in got.collect()} == reachable(CHAIN, [a for a, _ in CHAIN], True)
    assert sum(n.startswith("reached") for n in made) <= 8


def test_only_asked_kinds_are_made(spark):
    docs = spark.createDataFrame([(1, '<r><x a="1">t</x></r>'), (2, "<r>")], "doc_id int, text string")
    kinds = lambda **k: sorted((r["doc_id"], r["kind"]) for r in nd.xml_nodes(docs, "x", columns=["kind"], **k).collect())
    assert kinds(kinds=["attribute"]) == [(1, "attribute"), (2, "error")]
    assert len(kinds()) == 5


def test_declared_predicates_go_before_the_rest_is_made_distinct(spark):
    quads = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b")], "rid string, p string")
    out = findings.undeclared(quads, spark.createDataFrame([("a",)], "p string"))
    assert [tuple(r[c] for c in ("rid", "p")) for r in out.collect()] == [("1", "b")]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate") < text.index("LeftAnti")


def test_unique_items_send_no_item_by_itself(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(['{"l": [1, 1.0]}', '{"l": [1, "1"]}', '{"l": [null, null]}', '{"l": [[], []]}'])], "doc_id int, text string")
    out = validation.json_violations(nd.json_nodes(docs), {"properties": {"l": {"uniqueItems": True}}})
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2]
    assert "count(distinct" not in plan(out)


def test_documents_are_dealt_before_they_are_grouped(spark, sf_dir):
    assert "REPARTITION_BY_NUM" in plan(catalog.json_documents(spark, sf_dir)) and "REPARTITION_BY_NUM" in plan(catalog.xml_documents(spark, sf_dir))


def test_triples_are_made_once(spark, sf_dir):
    assert "Generate" not in plan(catalog.lift_xml_member_order(spark, sf_dir))


@pytest.mark.parametrize("name,joins", [("theta_less_than", 1), ("bgp_join_chain", 1), ("product_within_record", 2), ("group_empty", 1), ("group_concat_ordered", 0), ("rank_earlier_siblings", 0)])
def test_patterns_of_one_subject_need_no_join(spark, sf_dir, name, joins):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert sum("Join" in line for line in text.splitlines()) == joins and "Generate" not in text


def test_terms_are_taken_apart_once_a_row_not_once_a_pair(spark, sf_dir):
    assert not any("Join" in line and t.XSD in line for line in plan(catalog.theta_less_than(spark, sf_dir)).splitlines())


@pytest.mark.parametrize("pairs", [[("w", "?w"), ("n", "?n")], [("w", "Sa"), ("n", "?n")], [("k", "?v"), ("n", "?v")], [("n", "?n")], [("w", "?w"), ("w", "?w2")], [("g", "?s"), ("w", "?w")], [("g", "?g"), ("f", "?f")], [("w", "Sno")]])
def test_a_star_is_the_join_of_its_patterns(spark, pairs):
    df = spark.createDataFrame([(1, 1, "a", 1, 1), (1, 2, None, 5, 1), (1, 3, "a", 5, None), (2, 1, "a", None, 2), (2, 2, "b", 2, 2), (None, 1, "a", 1, 1)], "g int, k int, w string, n int, f int")
    args = ("x", ["g", "k"], "g", {"g": "x", "f": "x"})
    named = [(f"Iurn:table:x#{c}", o) for c, o in pairs] + [(tr.TYPE, "Iurn:table:x")]
    star, joined = patterns.star(tr.property_table(df, *args), "?s", *named), patterns.bgp(tr.direct(df, *args), *(("?s", *x) for x in named))
    assert set(star.columns) == set(joined.columns)
    assert Counter(map(tuple, star.filter("rid IS NOT NULL").select(*joined.columns).collect())) == Counter(map(tuple, joined.collect()))
