"""License scans by an exact set-similarity join, with DataFrame operations only.

A license template is the word set of a common notice, short references and whole notices alike. The blocks that it is
compared with are runs of words of a text, line ends or none: twice as long as the template or more (a power of
two), each begun half a block after the last, so that a notice always lies whole in a block. A block meets a template if it
holds at least ``threshold`` of the template's words.

Template words are ordered by how often the corpus has them, rarest first. A block with the needed overlap must hold one
of the first words of the template (prefix filter: only such words leave the scan, by a join with the templates'
prefixes inside the scan's own stage), must have enough words at all (length filter), and enough template
words after the first shared one (positional filter); what is left is verified, each block and template once. The
filters only save work: the result is that of comparing every block with every template. Base phrases are found
the same way, by their first word.

What tasks get in whole are the templates and the ranks of their words, which are parameters of the query, not data.
Two scans of the texts (counts, then search); what is shuffled is one small row a document and one a find.

Defined results: a null text is empty; texts without words have no labels and score 0; every place of a base phrase
counts, also across lines; a text of any length is one stream of words; rows that repeat an id repeat, each with the
finds of its own text; a null id is an id; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.license_texts import TEMPLATES

#: What separates words once capitals are small.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

THRESHOLD = 0.8
LEAST_BLOCK = 16


def flat(templates: dict[str, list[str]]) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, size of the blocks that it is compared with) of every template."""
    out = []
    for label, texts in templates.items():
        for text in texts:
            words = [w for w in re.split(GAP, text.lower()) if w]
            out.append((label, sorted(set(words)), max(LEAST_BLOCK, 1 << (2 * len(words) - 1).bit_length())))
    return out


def _words(text: Column) -> Column:
    """Words of a text in small letters; the first and the last may be empty.

    The two capitals outside ASCII whose small form holds an ASCII letter are put aside, so that only A-Z becomes a-z."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for odd in ("\u212a", "\u0130"):
        text = F.replace(text, F.lit(odd), F.lit("Ω"))
    return F.split(F.lower(text), GAP)


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How often the corpus has each word of a vocabulary (a parameter, so the driver gets no more rows than it has)."""
    every = docs.select(F.explode_outer(_words(F.col(text_col))).alias("word"))
    return {r["word"]: r["n"] for r in every.filter(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count("*").alias("n")).collect()}


def found(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), kind, n_words, place, label, containment: a row of kind 'text' for every document, and one for
    every base phrase ('base') and every block that meets a template ('block')."""
    names = flat(templates)
    counts = word_counts(docs, sorted({w for _, t, _ in names for w in t}), text_col)
    order = sorted({w for _, t, _ in names for w in t}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    # Words at which something may be found. The empty word leads every text and stands for the text itself.
    wanted = [("", "text", None, None, None, None, None, None)]
    for phrase, label in BASE.items():
        parts = phrase.split()
        wanted.append((parts[0], "base", label, parts, 0, len(parts), len(parts), 0))
    for label, t, size in names:
        own = sorted(t, key=rank.get)
        need = math.ceil(threshold * len(own) - 1e-9)
        wanted += [(own[j], "block", label, own, j, need, size, shift) for j in range(len(own) - need + 1) for shift in (0, 1)]
    spark = docs.sparkSession
    look_for = F.broadcast(spark.createDataFrame(wanted, "word string, kind string, label string, own array<string>, j int, need int, size int, shift int"))  # the templates, a parameter

    texts = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("key"), F.concat(F.array(F.lit("")), _words(F.col(text_col))).alias("w"))
    lead = 1 + (F.element_at("w", 2) == "").cast("int")
    n_words = F.greatest(F.size("w") - lead - (F.element_at("w", -1) == "").cast("int"), F.lit(0))
    every = texts.select("doc_id", "key", "w", lead.alias("lead"), n_words.alias("n_words")).select("*", F.posexplode_outer("w").alias("pos", "word"))
    hits = every.filter(F.col("word").isin(sorted({x[0] for x in wanted}))).join(look_for, "word")
    place = F.col("pos") - F.col("lead")
    half = F.col("size") / 2
    start = ((F.floor(place / half) - F.col("shift")) * half).cast("int")
    hits = hits.select("doc_id", "key", "w", "lead", "n_words", "pos", "word", "kind", "label", "own", "j", "need", "size", place.alias("place"), F.when(F.col("kind") == "base", place).otherwise(start).alias("start"))

    run = F.slice("w", F.col("lead") + F.col("start") + 1, F.col("size"))
    long_enough = F.least(F.col("size"), F.col("n_words") - F.col("start")) >= F.col("need")
    first_of_block = F.array_position(run, F.col("word")) == F.col("place") - F.col("start") + 1
    first_shared = F.size(F.array_intersect(F.slice("own", F.lit(1), F.col("j")), run)) == 0
    is_text = (F.col("kind") == "text") & (F.col("pos") == 0)
    is_base = (F.col("kind") == "base") & long_enough & (run == F.col("own"))
    may_meet = (F.col("kind") == "block") & (F.col("start") >= 0) & long_enough & first_of_block & first_shared
    kept = hits.filter(is_text | is_base | may_meet)

    have = F.when(F.col("kind") == "block", F.array_intersect(F.array(*map(F.lit, order)), run))  # in rank order
    held = kept.select("doc_id", "key", "kind", "n_words", "place", "label", "own", "j", "need", "word", have.alias("have"))
    position = F.array_position("have", F.col("word"))
    positional = 1 + F.least(F.size("have") - position, F.size("own") - F.col("j") - 1) >= F.col("need")
    # With a function over arrays Spark leaves this step, which few rows reach, out of the code that it compiles for every word:
    # with it that method is over the 8,000 bytes that the JVM compiles, and the whole scan slows down threefold.
    overlap = F.size(F.filter("own", lambda x: F.array_contains("have", x)))
    met = held.filter((F.col("kind") != "block") | (positional & (overlap >= F.col("need"))))
    return met.select("doc_id", "key", "kind", F.col("n_words").cast("long").alias("n_words"), F.col("place").cast("long").alias("place"), "label", F.when(F.col("kind") == "block", overlap / F.size("own")).alias("containment"))


def licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    kind = lambda name, value: F.when(F.col("kind") == name, value)
    copies = F.count_if(F.col("kind") == "text")
    # Rows with the same id and text are one group: counted, searched alike, and dealt out again.
    one = found(docs, templates, threshold, id_col, text_col).groupBy("doc_id", "key").agg(
        copies.alias("copies"), F.max("n_words").alias("n_words"), (F.count_if(F.col("kind") == "base") / copies).cast("long").alias("n_base"),
        F.min(kind("base", F.col("place"))).alias("first_word"), F.max(kind("base", F.col("place"))).alias("last_word"),
        F.array_sort(F.collect_set(kind("base", F.col("label")))).alias("own"), F.array_sort(F.collect_set("label")).alias("every"), F.max("containment").alias("best"),
    )
    return one.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("own", ",").alias("base_labels"), F.array_join("every", ",").alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 6)).alias("score"),
    )


def _sql() -> str:
    quote = lambda w: "'" + w + "'"
    small = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    template = ", ".join(f"('{label}', [{', '.join(map(quote, t))}], {math.ceil(THRESHOLD * len(t) - 1e-9)}, {size})" for label, t, size in flat(TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT k, '{label}' AS label, i FROM (SELECT k, w, unnest(range(0, greatest(len(w) - {len(p.split()) - 1}, 0))) AS i FROM hot) WHERE " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in BASE.items()
    )
    return rf"""
WITH counted AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({small}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hot AS (SELECT * FROM counted WHERE list_contains(w, 'license') OR list_contains(w, 'nc')),
places AS ({places}),
base AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS own FROM places GROUP BY k),
templates(label, words, need, size) AS (VALUES {template}),
sizes AS (SELECT DISTINCT size FROM templates),
cut AS (SELECT k, w, size, unnest(range(0, greatest(len(w) - size // 2, 1), size // 2)) AS s FROM counted, sizes),
blocks AS (SELECT k, size, list_distinct(w[s + 1:s + size]) AS b FROM cut),
met AS (SELECT k, label, len(list_intersect(b, words)) / len(words) AS c FROM blocks JOIN templates USING (size) WHERE len(list_intersect(b, words)) >= need),
method AS (SELECT k, list(DISTINCT label) AS more, max(c) AS best FROM met GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(coalesce(own, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(coalesce(best, 0)::DOUBLE, 6) END AS score
FROM counted LEFT JOIN base USING (k) LEFT JOIN method USING (k)
"""


SQL = _sql()
