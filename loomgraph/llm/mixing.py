"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents are counted into cells (source, language, topic). The sample is to have ``retention`` of all tokens. The cells' token
weights are raked: for one dimension after the other they are multiplied so that its marginal meets its target share of that
budget, where a cell counts for the tokens it has at most; after the last round all are scaled to the budget again, so that what
full cells could not take goes to the others. A cell's factor, 1 at most, is the probability of its documents; a hash of the id decides. Rare
cells stay whole, the others share the rest in target proportions, and no single cell sets how much is kept.
``marginals`` shows what targets were missed and by how much.

A round is three grouped sums (with partial sums in tasks) and equi-joins on the cell table, which is written after each. The only work
over documents is one scan, one aggregation with partial sums and one equi-join with the factors, which Spark may turn into a
broadcast after it has measured their size.

Defined results: null dimensions are the value ''; texts without words have no tokens and the probability of
their cell; a cell whose dimensions have no tokens keeps its factor; texts of any length are counted whole; ids decide, so rows that repeat an id
stay or go together, and a null id counts as ''; other columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import shared_dir, written

BLANKS = " \t\n\x0b\f\r"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 12
SCALE_STEPS = 8
#: Share of all tokens that the sample is to have.
RETENTION = 0.5
#: Targets of the registered query: shares of tokens to this power. Below 1 it lifts what is rare.
POWER = 0.7


def n_words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x09-\x0D ]+"))).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from marks in the whole text."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit("|")), "table")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(t.rlike("(?i)licen[cs]e"), "legal")
        .when(F.length(t) >= 3000, "long")
        .otherwise("short")
    )


def uniform(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """value, share: targets that are the dimension's shares of tokens to a power, normed to 1."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
    raised = sums.select("value", F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0).alias("r"))
    total = raised.agg(F.sum("r")).first()[0] or 1.0
    return raised.select("value", (F.col("r") / total).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = ROUNDS, path: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """cells with a column ``factor``; targets: for each dimension value and share of tokens (values left out get share 0).

    A cell counts for tokens * least(1, factor), so never for more than it has. Raking ends after ``rounds``, or, with a ``tolerance``,
    once no marginal's residual (see ``marginals``) is larger."""
    stays = F.col("tokens") * F.least(F.lit(1.0), F.col("factor"))
    now = cells.withColumn("factor", F.lit(1.0))
    for d, target in targets.items():
        now = now.join(target.select(F.col("value").alias(d), F.col("share").alias(f"__{d}")), d, "left").fillna(0.0, [f"__{d}"])
    path = path or shared_dir(cells.sparkSession)
    now = written(now, path, "start")
    for k in range(rounds):
        for d in targets:
            have = now.groupBy(d).agg(F.sum(stays).alias("__have"))
            step = F.when(F.col("__have") > 0, F.col("factor") * F.col(f"__{d}") * budget / F.col("__have")).otherwise(F.col("factor"))
            now = now.join(have, d).withColumn("factor", step).drop("__have")
        now = written(now, path, f"round{k}")
        if tolerance and (marginals(now, targets, budget).agg(F.max(F.abs("residual"))).first()[0] or 0.0) < tolerance:
            break
    # What full cells could not take goes to the others: one number from the cell table a step, each nearer to the budget.
    scale = 1.0
    for _ in range(SCALE_STEPS):
        kept = now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * scale))).first()[0] or 0.0
        scale *= budget / kept if kept > 0 else 1.0
    return now.select(*cells.columns, (F.col("factor") * scale).alias("factor"))


def marginals(factors: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """dimension, value, target and expected tokens, and the residual (their difference over the budget): a target that raking could not
    meet, since its cells have no more tokens, shows here."""
    out = None
    for d, target in targets.items():
        have = factors.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor"))).alias("expected"))
        one = have.join(target, "value", "full").select(F.lit(d).alias("dimension"), "value", (F.coalesce("share", F.lit(0.0)) * budget).alias("target"), F.coalesce("expected", F.lit(0.0)).alias("expected"))
        out = one if out is None else out.union(one)
    return out.withColumn("residual", (F.col("expected") - F.col("target")) / budget)


def chances(docs: DataFrame, targets=None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of=topic, retention: float = RETENTION, tolerance: float = 0.0) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every document.

    targets: a function from the cell table to {dimension: (value, share)}; tempered shares where it is None.
    retention: the share of all tokens that the sample is to have."""
    path = shared_dir(docs.sparkSession)
    text = F.col(text_col).cast("string")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), name(source_col).alias("source"), name(lang_col).alias("lang"), topic_of(text).alias("topic"), n_words(text).alias("n_tokens")
    )
    base = written(base, path, "counted")
    cells = written(base.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), path, "cells")
    targets = targets(cells) if targets else {d: tempered(cells, d) for d in DIMENSIONS}
    budget = retention * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factors = written(raked(cells, targets, budget, rounds, path, tolerance), path, "factors")
    probability = F.least(F.lit(1.0), F.col("factor"))
    return base.join(factors.select(*DIMENSIONS, probability.alias("probability")), list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "n_tokens", F.round("probability", 9).alias("probability"), (uniform(F.col("doc_id")) < F.col("probability")).alias("kept")
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The sampled documents, with their columns as they are."""
    id_col = settings.get("id_col", "doc_id")
    stay = chances(docs, **settings).filter("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__stay")).distinct()
    keyed = docs.withColumn("__stay", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return keyed.join(stay, "__stay", "left_semi").select(*docs.columns)


def _sql() -> str:
    steps, last = [], "start"
    stays = "tokens * least(1.0, factor)"
    for k in range(ROUNDS):
        for d in DIMENSIONS:
            name = f"s{k}_{d}"
            have = f"sum({stays}) OVER (PARTITION BY {d})"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN {have} > 0 THEN factor * t_{d} * budget / {have} ELSE factor END AS factor) FROM {last})")
            last = name
    for k in range(SCALE_STEPS):
        steps.append(f"s{k} AS (SELECT * REPLACE (CASE WHEN sum({stays}) OVER () > 0 THEN factor * (budget / sum({stays}) OVER ()) ELSE factor END AS factor) FROM {last})")
        last = f"s{k}"
    share = lambda d: f"t_{d} AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {POWER}) ELSE 0 END AS r FROM cells GROUP BY {d})"
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(t, '|') THEN 'table' WHEN contains(t, '@') THEN 'contact' WHEN regexp_matches(t, '(?i)licen[cs]e') THEN 'legal'
      WHEN length(t) >= 3000 THEN 'long' ELSE 'short' END AS topic,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
), cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM base GROUP BY ALL),
{", ".join(map(share, DIMENSIONS))},
start AS (
  SELECT cells.*, 1.0::DOUBLE AS factor, {RETENTION}::DOUBLE * (sum(tokens) OVER ())::DOUBLE AS budget,
    {", ".join(f"(t_{d}.r / (SELECT sum(r) FROM t_{d})) AS t_{d}" for d in DIMENSIONS)}
  FROM cells {" ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS)}
), {", ".join(steps)},
chance AS (SELECT source, lang, topic, least(1.0, factor) AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS probability,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) < p AS kept
FROM base JOIN chance USING (source, lang, topic)
"""


SQL = _sql()
