"""Rules that plain SQL logic does not have: unbound variables, errors, values and terms, cycles, refusals."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as x
from loomgraph.functions import terms as t
from loomgraph.operators import aggregates as a
from loomgraph.operators import construct as c
from loomgraph.operators import findings as g
from loomgraph.operators import paths, records, validation
from loomgraph.operators import patterns as m

XSD = t.XSD
INT, DEC, BOOL, DATE = (f"T{XSD}{k}\0" for k in ("integer", "decimal", "boolean", "dateTime"))


def solutions(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    ("term", "want"),
    [("S", False), ("Sx", True), (INT + "0", False), (INT + "7", True), (DEC + "0.0", False), (BOOL + "true", True), (BOOL + "false", False), ("Iurn:a", None), ("Bb", None), (INT + "x", False), ("Len\0", False), ("Len\0a", True), ("Turn:d\0x", None), (None, None), (f"T{XSD}double\0NaN", False)],
)
def test_truth(spark, term, want):
    df = solutions(spark, ["v"], [(term,)])
    assert df.select(t.truth(F.col("v"))).first()[0] is want


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        ("Sa", "Sa", True), ("Sa", "Sb", False), (INT + "1", DEC + "1.0", True), (INT + "01", INT + "1", True), (INT + "1", INT + "2", False), ("Sa", "Len\0a", False),
        ("Iurn:a", "Sa", False), ("Turn:d\0x", "Turn:d\0x", True), ("Turn:d\0x", "Turn:d\0y", None), (BOOL + "1", BOOL + "true", True), (None, "Sa", None),
        (DATE + "2020-01-01T00:00:00Z", DATE + "2020-01-01T01:00:00+01:00", True), ("Sa", INT + "1", None),
    ],
)
def test_equal(spark, left, right, want):
    df = solutions(spark, ["a", "b"], [(left, right)])
    assert df.select(t.equal(F.col("a"), F.col("b"))).first()[0] is want


def test_parts_of_terms(spark):
    df = solutions(spark, ["v"], [("Iurn:a",), ("Bx",), ("Sa\0b",), (INT + "5",), ("Len-GB\0hi",)])
    got = df.select(t.lexical(F.col("v")), t.datatype(F.col("v")), t.language(F.col("v")), t.n_triple(F.col("v"))).collect()
    assert [r[0] for r in got] == ["urn:a", "x", "a\0b", "5", "hi"]
    assert [r[1] for r in got] == [None, None, XSD + "string", XSD + "integer", t.RDF + "langString"]
    assert [r[2] for r in got] == [None, None, "", "", "en-GB"]
    assert [r[3] for r in got] == ["<urn:a>", "_:x", '"a\0b"', f'"5"^^<{XSD}integer>', '"hi"@en-GB']


def test_scalar_edges(spark):
    df = spark.createDataFrame([("abcdef",)], "v string")
    v = F.col("v")
    one = lambda col: df.select(col).first()[0]
    assert one(x.substr(v, 0, 2)) is None and one(x.substr(v, 5)) == "ef" and one(x.substr(v, 9)) == "" and one(x.substr(v, 1, -1)) is None
    assert one(x.before(v, F.lit(""))) == "" and one(x.after(v, F.lit(""))) == "abcdef" and one(x.before(v, F.lit("z"))) == "" and one(x.after(v, F.lit("f"))) == ""
    for text, want in (("17", 17), (" 17", None), ("+5", 5), ("9223372036854775808", None), ("1.0", None)):
        assert one(x.to_integer(F.lit(text))) == want
    assert one(x.divided(F.lit(17), F.lit(4))) == "4.25" and one(x.divided(F.lit(1), F.lit(0))) is None and one(x.divided(F.lit(8), F.lit(4))) == "2.0"
    assert one(x.added(F.lit(2**63 - 1), F.lit(1))) is None
    assert one(x.matches(F.lit("été"), r"^\w+$")) is True and one(x.replaced(F.lit("a.b"), ".", "-", "q")) == "a-b"
    assert one(x.if_else(F.lit(None).cast("boolean"), F.lit("a"), F.lit("b"))) is None
    with pytest.raises(ValueError):
        x.matches(v, "a", "z")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.ORG", "http://example.org"), ("https://a.b:443/x", "https://a.b/x"), ("http://a.b:8080", "http://a.b:8080"), ("http://a.b/./c/../d", "http://a.b/d"),
        ("http://a.b/../../c/", "http://a.b/c"), ("ftp://a.b/", "ftp://a.b"), ("http://a.b/%7eb/%2e%2e/c//", "http://a.b/c"), ("http://a.b//c", "http://a.b//c"), ("http://[::1]/", "http://[::1]"), ("http://[::x]/", None), ("http://u@a.b/", None), ("http://a.b/?q", None), ("http://a.b/#f", None), ("a.b/c", None), ("http://", None), (None, None),
    ],
)
def test_base_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(x.normal_base_url(F.col("u"))).first()[0] == want


def test_compatible_join(spark):
    left = solutions(spark, ["rid", "a", "v"], [("1", "x", "p"), ("1", "y", None), ("2", "z", "p")])
    right = solutions(spark, ["rid", "b", "v"], [("1", "r", "p"), ("1", "s", None), ("1", "u", "q")])
    got = values(m.compatible_join(left, right, ["v"]).select("rid", "a", "b", "v"))
    assert got == sorted([("1", "x", "r", "p"), ("1", "x", "s", "p"), ("1", "y", "r", "p"), ("1", "y", "s", None), ("1", "y", "u", "q")], key=str)


def test_minus_needs_a_shared_bound_variable(spark):
    left = solutions(spark, ["rid", "a", "v"], [("1", "x", "p"), ("1", "y", None), ("1", "z", "q")])
    right = solutions(spark, ["rid", "v"], [("1", "p"), ("1", None)])
    assert values(m.minus(left, right, ["v"]).select("a")) == [("y",), ("z",)]
    assert m.minus(left, right.withColumnRenamed("v", "w"), []).count() == 3


def test_optional_keeps_multiplicity(spark):
    left = solutions(spark, ["rid", "a"], [("1", "x"), ("1", "x"), ("1", "y")])
    right = solutions(spark, ["rid", "a", "b"], [("1", "x", "1"), ("1", "x", "2")])
    assert m.optional(left, right).count() == 5
    assert m.optional(left, right, F.col("b") == "2").count() == 3
    assert m.optional(left, right, F.lit(None).cast("boolean")).count() == 3


def test_walks_end_on_cycles(spark):
    e = solutions(spark, ["rid", "start", "end"], [("1", "a", "b"), ("1", "b", "c"), ("1", "c", "a"), ("1", "d", "d"), ("2", "a", "z")])
    seeds = solutions(spark, ["rid", "start"], [("1", "a"), ("1", "d"), ("1", "lone")])
    assert values(paths.walk(e, seeds).select("start", "end")) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("lone", "lone")]
    assert values(paths.walk(e, seeds, zero=False).select("start", "end")) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d")]


def test_aggregates_over_errors_and_nothing(spark):
    df = spark.createDataFrame([("1", 1, "b"), ("1", 2, "a"), ("2", None, "c"), ("2", 3, None), ("3", 2**63 - 1, "d"), ("3", 1, "d")], "rid string, n long, s string")
    got = {r["rid"]: r for r in a.grouped(df, [], total=a.total(F.col("n")), avg=a.average(F.col("n")), text=a.group_concat(F.col("s"), [F.col("n")], "-")).collect()}
    assert (got["1"]["total"], got["1"]["avg"], got["1"]["text"]) == (3, 1.5, "b-a")
    assert got["2"]["total"] is None and got["2"]["avg"] is None and got["2"]["text"] is None and got["3"]["total"] is None


def test_min_max_rank_terms(spark):
    df = solutions(spark, ["rid", "v"], [("1", INT + "9"), ("1", INT + "10"), ("2", "Iurn:z"), ("2", "Bb"), ("2", "Sa")])
    got = {r["rid"]: (r["lo"], r["hi"]) for r in a.grouped(df, [], lo=a.least(F.col("v")), hi=a.greatest(F.col("v"))).collect()}
    assert got == {"1": (INT + "9", INT + "10"), "2": ("Bb", "Sa")}


def test_construct_drops_ill_typed_triples(spark):
    df = solutions(spark, ["rid", "s", "v"], [("1", "Iurn:a", "Sx"), ("1", "Sa", "Sx"), ("1", "Iurn:a", None), ("1", "Iurn:a", "Sx")])
    assert values(c.construct(df, ("?s", "Iurn:p", "?v"), ("?s", "?v", "?v"))) == [("1", "Iurn:a", "Iurn:p", "Sx")]


def test_versions_refuse(spark):
    p = records.SPECIALIZATION
    for rows in ([("1", "Iurn:d", p, "Iurn:r"), ("1", "Iurn:d", p, "Iurn:q")], [("1", "Bd", p, "Iurn:r")], [("1", "Iurn:d#x", p, "Iurn:r")]):
        with pytest.raises(Exception, match="no version can be named"):
            records.versions(solutions(spark, ["rid", "s", "p", "o"], rows)).collect()


def test_dropped_versions_take_their_blank_nodes(spark):
    """A chain and a cycle of blank nodes behind the arrival of a dropped version go; what a kept arrival reaches as well stays."""
    p, rows = records.SPECIALIZATION, []
    for d in ("1", "2"):
        rows += [("1", f"Iurn:d{d}", p, "Iurn:r"), ("1", f"Iurn:d{d}", "Iurn:v", f"S{d}"), ("1", f"Ba{d}", records.ARRIVED_AS, f"Iurn:d{d}"), ("1", "Bother", "Iurn:of", f"Iurn:d{d}")]
        rows += [("1", f"Ba{d}", records.HAS_SELECTOR, f"Bm{d}"), ("1", f"Bm{d}", "I" + t.RDF + "value", f"S/x[{d}]"), ("1", f"Bm{d}", "Iurn:next", f"Bn{d}"), ("1", f"Bn{d}", "Iurn:next", f"Bn{d}"), ("1", f"Bn{d}", "Iurn:next", f"Bo{d}")]
        rows += [("1", f"Bo{d}", "Iurn:c", f"S{d}"), ("1", f"Ba{d}", "Iurn:with", "Bshared")]
    rows += [("1", "Bshared", "Iurn:c", "Sboth"), ("1", "Balone", "Iurn:c", "Salone")]
    q = solutions(spark, ["rid", "s", "p", "o"], rows)
    named = records.versions(q)
    stay = records.kept(named).filter("kept").first()["draft"][-1]
    gone = "1" if stay == "2" else "2"
    out = values(records.without_dropped(q, named))
    assert {r[1] for r in out if r[2] == "Iurn:c"} == {f"Bo{stay}", "Bshared", "Balone"}
    assert not any(x.startswith("B") and x.endswith(gone) or f"urn:d{gone}" in x for r in out for x in r[1:])
    assert [(r["draft"], r["selector"]) for r in records.dropped(q, named).collect()] == [(f"Iurn:d{gone}", f"/x[{gone}]")]


@pytest.mark.parametrize("bad", [("Iurn:d1", "Iurn:v", "Bnode"), ("Iurn:d1#a", "Iurn:v", "Iurn:d2#b")])
def test_versions_that_cannot_be_named_raise(spark, bad):
    rows = [("1", "Iurn:d1", records.SPECIALIZATION, "Iurn:r"), ("1", "Iurn:d2", records.SPECIALIZATION, "Iurn:r"), ("1", *bad)]
    with pytest.raises(Exception, match="the version Iurn:d1"):
        records.versions(solutions(spark, ["rid", "s", "p", "o"], rows)).collect()


def test_neighbouring_integers_differ(spark):
    big, next_one, one, real = (F.lit(x) for x in (f"T{t.XSD}integer\0009007199254740993", f"T{t.XSD}long\0009007199254740992", f"T{t.XSD}integer\0001", f"T{t.XSD}double\0001.0"))
    row = spark.range(1).select(t.equal(big, next_one), t.less(next_one, big), t.less(big, next_one), t.equal(one, real), t.sort_key(next_one) < t.sort_key(big)).first()
    assert list(row) == [False, True, False, True, True]


def test_less_of_all_pairs_of_kinds(spark):
    """Only numbers with numbers, plain strings with plain strings and dateTimes with dateTimes have an order; worked out before a join it is the same."""
    numbers = {INT + "9": 9, INT + "10": 10, DEC + "9.5": 9.5, INT + "-1": -1, f"T{XSD}double\0001e1": 10}
    texts, moments = {"S10": "10", "S9": "9", "S": ""}, {DATE + "2020-01-01T00:00:00Z": 1, DATE + "2019-12-31T23:00:00-02:00": 2}
    without = [INT + "x", DATE + "soon", BOOL + "true", "Len\0a", "I9", "B9", None]
    df = solutions(spark, ["a"], [(v,) for v in [*numbers, *texts, *moments, *without]])
    both = df.crossJoin(df.withColumnRenamed("a", "b")).select("a", "b", t.less(F.col("a"), F.col("b")).alias("less"), t.comparable(F.col("a")).alias("x"), t.comparable(F.col("b")).alias("y"))
    for r in both.withColumn("early", t.precedes(F.col("x"), F.col("y"))).collect():
        kinds = [k for k in (numbers, texts, moments) if r["a"] in k and r["b"] in k]
        want = kinds[0][r["a"]] < kinds[0][r["b"]] if kinds else None
        assert (r["less"], r["early"]) == (want, want), r


def test_json_equality_is_by_kind_and_value(spark):
    rows = [("1.0", "number"), ("1", "string"), ("true", "boolean"), (None, "null"), ("1e0", "number")]
    df = spark.createDataFrame(rows, "value string, kind string")
    got = lambda want: [bool(r[0]) for r in df.select(F.coalesce(validation.json_equal(F.col("value"), F.col("kind"), want), F.lit(False))).collect()]
    assert got(1) == [True, False, False, False, True] and got("1") == [False, True, False, False, False]
    assert got(True) == [False, False, True, False, False] and got(None) == [False, False, False, True, False]
    broken = [r[0] for r in df.select(validation.json_keyword(F.col("value"), F.col("kind"), "enum", [1, True])).collect()]
    assert broken == [False, True, False, True, False]


def test_unsupported_keyword_raises():
    with pytest.raises(ValueError, match="not supported"):
        validation.json_keyword(F.lit("a"), F.lit("string"), "contains", {})


def test_severity_order(spark):
    gaps = spark.createDataFrame([("g", "Warning")], "gap string, severity string")
    f = spark.createDataFrame([("g", None), ("g", "Violation"), ("h", None)], "body string, written string")
    assert sorted(r["severity"] for r in g.with_severity(f, gaps).collect()) == ["Info", "Violation", "Warning"]


def test_triples_of_versions_are_dealt_once(spark, sf_dir):
    """By record; joins by record and term move no triple again."""
    from loomgraph import catalog

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = catalog.drafts(spark, sf_dir)
        plan = records.without_dropped(q, records.versions(q))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "__own" in plan and "Exchange hashpartitioning(rid" in plan
    assert not any("Exchange hashpartitioning(rid" in x and "__own" in x.split(", 4")[0] for x in plan.splitlines())
