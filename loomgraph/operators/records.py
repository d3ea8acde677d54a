"""Record versions: content-addressed names, the one that stays, what goes with those that don't, and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import scalars as x
from loomgraph.functions import terms as t
from loomgraph.tables import shared_dir, written

# The placeholder of version names, and names of the PROV vocabulary.
PLACEHOLDER = "urn:this-version"
SPECIALIZATION = "Ihttp://www.w3.org/ns/prov#specializationOf"
HAS_SELECTOR = "Ihttp://www.w3.org/ns/oa#hasSelector"
#: A node that tells how a draft came: it goes with the draft.
ARRIVED_AS = "Iurn:loomgraph:arrivedAs"


def drafts(quads: DataFrame) -> DataFrame:
    """rid, draft, record: subjects of specializationOf. A blank draft, a draft with a fragment, or one of two records raises."""
    found = quads.filter(F.col("p") == SPECIALIZATION).select("rid", F.col("s").alias("draft"), F.col("o").alias("record"))
    bad = (F.col("n") > 1) | (t.kind(F.col("draft")) != "I") | F.contains("draft", F.lit("#"))
    one = found.groupBy("rid", "draft").agg(F.count_distinct("record").alias("n"), F.min("record").alias("record"))
    return one.select("rid", "draft", F.when(bad, F.raise_error(F.concat(F.lit("no version can be named: "), "draft"))).otherwise(F.col("record")).alias("record"))


def by_record(df: DataFrame) -> DataFrame:
    """Rows dealt by record once, over all shuffle partitions: the joins and groupings by rid and more that follow then move only their other side."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid")


def owner(term: Column) -> Column:
    """The IRI before a fragment."""
    return F.substring_index(term, "#", 1)


def renamed(term: Column, old: Column, new: Column) -> Column:
    """A term with one IRI, whole or before a fragment, replaced."""
    return F.when(term == old, new).when(F.startswith(term, F.concat(old, F.lit("#"))), F.concat(new, F.substring(term, F.length(old) + 1, F.length(term)))).otherwise(term)


def versions(quads: DataFrame) -> DataFrame:
    """rid, draft, record, canonical, name: the draft's triples with a placeholder for the draft, as sorted distinct lines, hashed.

    A version that holds a blank node or names another version of its record set raises: its name would not follow from its content."""
    quads = by_record(quads)
    d = drafts(quads)
    own = quads.withColumn("draft", owner(F.col("s"))).join(d, ["rid", "draft"])
    others = d.select("rid", F.col("draft").alias("__own"), F.lit(True).alias("__other"))
    own = own.withColumn("__own", F.when((t.kind(F.col("o")) == "I") & (owner(F.col("o")) != F.col("draft")), owner(F.col("o")))).join(others, ["rid", "__own"], "left")
    refuse = lambda why: F.raise_error(F.concat(F.lit("the version "), "draft", F.lit(why), "o")).cast("string")
    checked = F.when(t.kind(F.col("o")) == "B", refuse(" holds the blank node ")).when(F.col("__other"), refuse(" names the version ")).otherwise(F.col("o"))
    own = own.withColumn("o", checked)
    place = F.lit("I" + PLACEHOLDER)
    s, p, o = (t.n_triple(renamed(F.col(c), F.col("draft"), place)) for c in ("s", "p", "o"))
    lines = own.groupBy("rid", "draft", "record").agg(F.array_sort(F.collect_set(F.concat_ws(" ", s, p, o, F.lit(".")))).alias("lines"))
    canonical = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
    return lines.select("rid", "draft", "record", canonical.alias("canonical")).withColumn("name", x.ni_name(F.col("canonical")))


def kept(named: DataFrame) -> DataFrame:
    """versions with ``kept``: of the versions of a record the one with the least (name, draft)."""
    n = F.row_number().over(W.partitionBy("rid", "record").orderBy("name", "draft"))
    return named.withColumn("kept", n == 1)


def selectors(quads: DataFrame) -> DataFrame:
    """rid, draft, selector: where the arrivals of drafts were found."""
    came = quads.filter(F.col("p") == ARRIVED_AS).select("rid", F.col("s").alias("node"), F.col("o").alias("draft"))
    at = quads.filter(F.col("p") == HAS_SELECTOR).select("rid", F.col("s").alias("node"), F.col("o").alias("at"))
    text = quads.filter(F.col("p") == "I" + t.RDF + "value").select("rid", F.col("s").alias("at"), t.lexical(F.col("o")).alias("selector"))
    return came.join(at, ["rid", "node"]).join(text, ["rid", "at"]).select("rid", "draft", "selector").distinct()


def dropped(quads: DataFrame, named: DataFrame) -> DataFrame:
    """rid, draft, kept_name and selector of versions that go: the name that stays for their record, and the least selector of their arrivals."""
    k = kept(named)
    stays = k.filter("kept").select("rid", "record", F.col("name").alias("kept_name"))
    least = selectors(quads).groupBy("rid", "draft").agg(F.min("selector").alias("selector"))
    return k.filter(~F.col("kept")).select("rid", "record", "draft").join(stays, ["rid", "record"]).join(least, ["rid", "draft"], "left").select("rid", "draft", "kept_name", "selector")


def orphans(quads: DataFrame, gone: DataFrame, path: str) -> DataFrame:
    """(rid, s): gone (rid, s), and the blank nodes that only they point to, and what only those point to, and so on.

    One round a step along chains of blank nodes; a round looks at nodes that the round before has reached."""
    refs = by_record(quads.filter((t.kind(F.col("o")) == "B") & (F.col("s") != F.col("o"))).select("rid", F.col("o").alias("node"), "s")).distinct()
    refs = written(refs, path, "referrers")
    all_gone = frontier = written(gone.distinct(), path, "gone0")
    k = 0
    while True:
        k += 1
        asked = refs.join(frontier, ["rid", "s"], "left_semi").select("rid", "node").distinct()
        asked = asked.join(all_gone.withColumnRenamed("s", "node"), ["rid", "node"], "left_anti")
        held = refs.join(asked, ["rid", "node"], "left_semi").join(all_gone, ["rid", "s"], "left_anti").select("rid", "node").distinct()
        frontier = written(asked.join(held, ["rid", "node"], "left_anti").select("rid", F.col("node").alias("s")), path, f"gone{k}")
        if frontier.isEmpty():
            return all_gone
        all_gone = quads.sparkSession.read.schema(frontier.schema).parquet(*(f"{path}/gone{i}" for i in range(k + 1)))


def without_dropped(quads: DataFrame, named: DataFrame) -> DataFrame:
    """Triples of versions that stay, under their names; triples of dropped versions and of their arrivals, triples that name them,
    and blank nodes that only these reach, by however many steps, go."""
    path = shared_dir(quads.sparkSession)
    quads, k = written(quads, path, "quads"), written(kept(named).select("rid", "draft", "name", "kept"), path, "named")
    lost = k.filter(~F.col("kept")).select("rid", F.col("draft").alias("__own"))
    subjects = quads.filter(t.kind(F.col("s")) == "I").select("rid", "s").distinct().withColumn("__own", owner(F.col("s"))).join(lost, ["rid", "__own"], "left_semi").select("rid", "s")
    came = quads.filter(F.col("p") == ARRIVED_AS).select("rid", "s", owner(F.col("o")).alias("__own")).join(lost, ["rid", "__own"], "left_semi").select("rid", "s")
    subjects = subjects.union(came)
    left = by_record(quads).join(orphans(quads, subjects, path), ["rid", "s"], "left_anti")
    left = left.withColumn("__own", owner(F.col("o"))).join(lost, ["rid", "__own"], "left_anti").select("rid", "s", "p", "o")
    names = k.filter("kept").select("rid", F.col("draft").alias("__d"), t.iri(F.col("name")).alias("__n"))
    out = left
    for c in ("s", "o"):
        out = out.withColumn("__own", owner(F.col(c))).join(names.withColumnRenamed("__d", "__own"), ["rid", "__own"], "left")
        out = out.withColumn(c, F.when(F.col("__n").isNull(), F.col(c)).otherwise(renamed(F.col(c), F.col("__own"), F.col("__n")))).drop("__own", "__n")
    return out.select("rid", "s", "p", "o")


def arrivals(named: DataFrame, selectors: DataFrame) -> DataFrame:
    """How each kept version arrived: one stable node for a document, version and selector (columns rid, document, selector)."""
    rows = kept(named).filter("kept").join(selectors, "rid")
    node = t.blank(x.stable_label(F.col("document"), F.col("name"), F.col("selector")))
    return rows.select("rid", "name", "document", "selector", t.lexical(node).alias("node"))


def document_table(facts: DataFrame, lookups: DataFrame, keys: list[str]) -> DataFrame:
    """Two passes over records: what a first query found in any record of a document is joined to every record of it."""
    return facts.join(lookups.distinct(), keys, "left")


def restored(quads: DataFrame, source: DataFrame, predicate: str) -> DataFrame:
    """dateTime objects of a predicate as the source wrote them: values of the record (rid, value) that mean the same moment, least first."""
    lexical = source.select("rid", "value", F.try_to_timestamp("value").alias("at")).filter("at IS NOT NULL")
    first = lexical.groupBy("rid", "at").agg(F.min("value").alias("value"))
    mine = quads.withColumn("at", F.when(F.col("p") == predicate, t.moment(F.col("o"))))
    out = mine.join(first, ["rid", "at"], "left")
    new = F.when(F.col("value").isNotNull(), t.typed(F.col("value"), t.XSD + "dateTime")).otherwise(F.col("o"))
    return out.select("rid", "s", "p", new.alias("o"))


def described(documents: DataFrame) -> DataFrame:
    """(rid, s, p, o) that describe a document (columns document, name): an entity, the activity that read it, and how they hang together."""
    prov, rdf = "http://www.w3.org/ns/prov#", t.RDF
    doc, act = t.iri(F.col("name")), t.blank(x.stable_label(F.col("document"), F.col("name")))
    one = lambda s, p, o: F.struct(s.alias("s"), F.lit("I" + p).alias("p"), o.alias("o"))
    triples = F.array(
        one(doc, rdf + "type", F.lit("I" + prov + "Entity")),
        one(act, rdf + "type", F.lit("I" + prov + "Activity")),
        one(act, prov + "used", doc),
        one(doc, "http://www.w3.org/2000/01/rdf-schema#label", t.plain(F.col("document"))),
    )
    return documents.select(F.col("document").alias("rid"), F.inline(triples))


def graph_digest(quads: DataFrame) -> DataFrame:
    """rid, triples and digest: SHA-256 of a record's sorted distinct lines (graphs without blank nodes)."""
    line = F.concat_ws(" ", *(t.n_triple(F.col(c)) for c in ("s", "p", "o")), F.lit("."))
    lines = quads.groupBy("rid").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    return lines.select("rid", F.size("lines").cast("bigint").alias("triples"), F.sha2(F.concat(F.array_join("lines", "\n"), F.lit("\n")).cast("binary"), 256).alias("digest"))
