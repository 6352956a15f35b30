"""Mixing sources to target weights: a token budget handed down a domain-language-source tree.

At each node the budget is split among the children by weight; a child that
cannot use its share (``max_epochs`` times its tokens) keeps what it can use and
the rest goes to its siblings, and only what the whole family cannot use stays
with the family's own siblings one level up: capacities are sums over subtrees,
so the top-down split decides both. A leaf with target T reads whole seeded
epochs and then a prefix of the next one, up to the document in which T is
reached.

Documents are ordered by the MD5 of (seed, epoch, id). Where the prefix ends is
found by descent over the hash's leading digits, a few hundred sums a leaf and
round, so no leaf is ever sorted in one task, whatever its share of the rows.
What joins the documents again is one row a leaf; it is broadcast only if it
counts at most ``MAX_BROADCAST_LEAVES``.

Defined results: null languages and sources form leaves of their own; rows with
one id share a place in the order; texts without words hold no tokens and are
read with their epoch, and in a prefix only if they come before its end; a
weight of 0 or a budget of 0 selects nothing; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import table, words, written

SEED = 17
MAX_EPOCHS = 3
#: Integer weights a level; names that are not listed weigh 1. All names of a level compete within their parent.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}}
LEVELS = ("domain", "lang", "source")
#: Hex digits of a round of the descent, and its rounds: 16 ** (2 * 3) ranges of a leaf's order.
DIGITS, ROUNDS = 2, 3
MAX_BROADCAST_LEAVES = 50_000


def domain_of(source: Column) -> Column:
    """The tree's first level: sources are dealt to four domains by the number in their name; others form one of their own."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.try_cast("int") % 4).cast("string")))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("bigint")


def split_budget(children: DataFrame, parents: list[str]) -> DataFrame:
    """children: (*parents, budget, cap, w, name..); adds ``got``. Capacity over weight orders who is filled first.

    Shares are whole tokens; what rounding down leaves goes to the first open children, one each, so a family spends all it can.
    """
    family = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    ranked = children.withColumn("ratio", F.col("cap") / F.when(F.col("w") > 0, F.col("w")).cast("double"))
    order = family.orderBy(F.col("ratio").asc_nulls_last(), *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "rest_w": F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "used": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rn": F.row_number().over(order),
    })
    # Tokens for one unit of weight, were all before it filled up.
    ranked = ranked.withColumn("rate", (F.col("budget") - F.col("used")) / F.when(F.col("rest_w") > 0, F.col("rest_w")).cast("double"))
    ranked = ranked.withColumn("full", F.coalesce(F.col("ratio") <= F.col("rate"), F.lit(False)))
    open_ = ~F.col("full") & (F.col("w") > 0)
    ranked = ranked.withColumn("first", F.min(F.when(open_, F.struct("rn", "rate", (F.col("budget") - F.col("used")).alias("left")))).over(family))
    ranked = ranked.withColumn("share", F.when(open_, F.floor(F.col("first.rate") * F.col("w"))))
    spare = F.col("first.left") - F.sum("share").over(family)
    more = (F.col("rn") - F.col("first.rn") < spare).cast("bigint")
    got = F.when(F.col("full"), F.col("cap")).when(open_, F.least(F.col("cap"), F.col("share") + more)).otherwise(0)
    return ranked.withColumn("got", F.greatest(got.cast("bigint"), F.lit(0))).drop("ratio", "rest_w", "used", "rn", "rate", "full", "first", "share")


def leaf_targets(leaves: DataFrame, budget: int | None, weights: dict, max_epochs: int) -> DataFrame:
    """leaves: (domain, lang, source, tokens). Adds target, full_epochs and rest (tokens of the epoch after those)."""
    caps = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("bigint"))
    total = F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint") if budget is None else F.lit(budget).cast("bigint")
    top = caps.agg(total.alias("budget"))
    parents: list[str] = []
    given = top
    for level in LEVELS:
        names = [*parents, level]
        nodes = caps.groupBy(*names).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(level, weights))
        if parents:
            on = [F.col(f"n.{p}").eqNullSafe(F.col(f"g.{p}")) for p in parents]
            nodes = nodes.alias("n").join(given.alias("g"), on).select("n.*", "g.budget")
        else:
            nodes = nodes.join(F.broadcast(given))  # one row
        given = split_budget(nodes, parents).select(*names, "tokens", F.col("got").alias("budget"))
        parents = names
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.when(F.col("tokens") > 0, F.col("tokens")))).otherwise(0).cast("bigint")
    return given.withColumn("full_epochs", full).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens")).withColumnRenamed("budget", "target")


def _with_leaf(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins on the leaf. The plan has one row a leaf; beyond a bound of leaves AQE chooses, and splits a hot leaf."""
    small = plan.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES
    p = plan.withColumnsRenamed({c: f"__{c}" for c in LEVELS})
    on = [rows[c].eqNullSafe(p[f"__{c}"]) for c in LEVELS]
    return rows.join(F.broadcast(p) if small else p, on).drop(*[f"__{c}" for c in LEVELS])


def mixing_plan(units: DataFrame, budget: int | None = None, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """units: (doc_id, domain, lang, source, n_tokens). One row a leaf: target, full_epochs, and cut, the last key read of the epoch after those."""
    leaves = units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    targets = written(leaf_targets(leaves, budget, weights, max_epochs), "mix-targets")
    state = targets.where("rest > 0").select(*LEVELS, "full_epochs", "rest", F.lit("").alias("prefix"))
    leaf = W.partitionBy(*LEVELS)
    for _ in range(ROUNDS):
        rows = _with_leaf(units, state).withColumn("key", order_key(seed, F.col("full_epochs") + 1, F.col("doc_id")))
        rows = rows.where(F.col("key").startswith(F.col("prefix")))
        rows = rows.withColumn("digits", F.substr("key", F.length("prefix") + 1, F.lit(DIGITS)))
        sums = rows.groupBy(*LEVELS, "full_epochs", "rest", "prefix", "digits").agg(F.sum("n_tokens").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(leaf.orderBy("digits").rowsBetween(W.unboundedPreceding, 0)))
        ends = sums.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        state = written(
            ends.select(*LEVELS, "full_epochs", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), F.concat("prefix", "digits").alias("prefix")), "mix-cut"
        )
    rows = _with_leaf(units, state).withColumn("key", order_key(seed, F.col("full_epochs") + 1, F.col("doc_id")))
    by_key = rows.where(F.col("key").startswith(F.col("prefix"))).groupBy(*LEVELS, "rest", "key").agg(F.sum("n_tokens").alias("n"))
    by_key = by_key.withColumn("upto", F.sum("n").over(leaf.orderBy("key").rowsBetween(W.unboundedPreceding, 0)))
    cuts = by_key.where(F.col("upto") - F.col("n") < F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    c = cuts.withColumnsRenamed({x: f"__{x}" for x in LEVELS})
    return written(targets.join(c, [targets[x].eqNullSafe(c[f"__{x}"]) for x in LEVELS], "left").select(*targets.columns, "cut"), "mix-plan")


def with_leaf(docs: DataFrame) -> DataFrame:
    """Adds the tree's first level; lang and source are the others."""
    return docs.withColumn("domain", domain_of(F.col("source")))


def select_epochs(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """rows: (doc_id, domain, lang, source, ...). Each row once for each epoch that reads it, with ``epoch`` from 1."""
    p = plan.select(*LEVELS, F.col("full_epochs").alias("__full"), F.col("cut").alias("__cut"))
    joined = _with_leaf(rows, p)
    next_epoch = F.col("__full") + 1
    taken = F.coalesce(order_key(seed, next_epoch, F.col("doc_id")) <= F.col("__cut"), F.lit(False))
    n = F.col("__full") + taken.cast("bigint")
    # A leaf without tokens has no target and no epoch.
    return joined.where(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))))).drop("__full", "__cut")


def units_of(docs: DataFrame) -> DataFrame:
    counted = with_leaf(docs).select("doc_id", *LEVELS, F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"))
    return written(counted, "mix-units")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = units_of(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return select_epochs(units, mixing_plan(units)).select("doc_id", *LEVELS, "epoch", "n_tokens")


def _sql_weight(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS[level].items()) + " ELSE 1 END"


def _sql_level(name: str, level: str, parents: list[str], given: str) -> str:
    cols = ", ".join([*parents, level])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    on = " AND ".join(f"n.{p} IS NOT DISTINCT FROM g.{p}" for p in parents) or "true"
    return f"""
{name}_n AS (SELECT {cols}, sum(tokens * {MAX_EPOCHS})::BIGINT AS cap, sum(tokens)::BIGINT AS tokens, ({_sql_weight(level)})::BIGINT AS w FROM leaves GROUP BY {cols}),
{name}_r AS (SELECT n.*, g.budget, n.cap / n.w::DOUBLE AS ratio FROM {name}_n n JOIN {given} g ON {on}),
{name}_s AS (SELECT *, row_number() OVER ({part} ORDER BY ratio, {cols}) AS rn, sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY ratio, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w,
  coalesce(sum(cap) OVER ({part} ORDER BY ratio, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {name}_r),
{name}_f AS (SELECT *, (budget - used)::DOUBLE / rest_w::DOUBLE AS rate, ratio <= (budget - used)::DOUBLE / rest_w::DOUBLE AS filled FROM {name}_s),
{name}_g AS (SELECT *, min(rn) FILTER (WHERE NOT filled) OVER ({part}) AS rn0, floor(arg_min(rate, rn) FILTER (WHERE NOT filled) OVER ({part}) * w)::BIGINT AS share,
  arg_min(budget - used, rn) FILTER (WHERE NOT filled) OVER ({part}) AS left0 FROM {name}_f),
{name}_h AS (SELECT *, left0 - sum(share) FILTER (WHERE NOT filled) OVER ({part}) AS spare FROM {name}_g),
{name} AS (SELECT {cols}, tokens, CASE WHEN filled THEN cap ELSE least(cap, share + (rn - rn0 < spare)::INT) END::BIGINT AS budget FROM {name}_h)"""


OP5_SQL = f"""
WITH s AS (SELECT *, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) AS number FROM documents),
u AS (SELECT doc_id, CASE WHEN number = '' THEN 'other' ELSE 'd' || (number::BIGINT % 4) END AS domain, lang, source,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM s),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM u GROUP BY ALL),
top AS (SELECT sum(tokens)::BIGINT AS budget FROM leaves),
{_sql_level('l1', 'domain', [], 'top')},
{_sql_level('l2', 'lang', ['domain'], 'l1')},
{_sql_level('l3', 'source', ['domain', 'lang'], 'l2')},
t AS (SELECT *, budget // tokens AS full_epochs, budget % tokens AS rest FROM l3 WHERE tokens > 0),
k AS (SELECT u.*, full_epochs, rest, md5('{SEED}:' || (full_epochs + 1) || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM u JOIN t ON u.domain = t.domain AND u.lang IS NOT DISTINCT FROM t.lang AND u.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - n_tokens < rest AS below, full_epochs AS f FROM k),
-- The prefix ends with the document that reaches its tokens; one without words that follows has as many before it and stays out.
n AS (SELECT *, f + below::INT AS epochs FROM c)
SELECT doc_id, domain, lang, source, unnest(range(1, epochs + 1)) AS epoch, n_tokens FROM n WHERE epochs > 0"""
