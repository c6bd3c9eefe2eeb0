"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources shares out a budget of tokens. Going down, each node's budget is split among its
children by weight, limited by what each subtree can supply: its tokens times `epochs`. What a child cannot take goes to
its siblings by weight first; only when a whole subtree is exhausted does the shortage reach its parent's siblings. The
split is exact in integers: with children in the order of supply per weight, those that the level of the rest would
overfill are filled, and the others get their share of the rest, rounded down.

Each leaf then takes tokens from seeded epochs. In every epoch the documents of a leaf are ordered by a digest of seed and
id; full epochs take all of them, and the last one takes the longest prefix whose tokens fit into the rest. Prefix sums
never order a whole leaf: the digest's first digits cut it into even buckets, sums per bucket are added up, and only
the bucket in which the prefix ends is ordered document by document.

Edge cases: a null text has no tokens and is never needed; null levels are nodes of their own, and a value without a weight
weighs 1; weights of 0 take nothing; a null doc_id is ordered as "null"; documents of a leaf with equal ids are taken
or left together; an empty table or a budget of 0 selects nothing; `select` keeps all columns and adds `copies`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import settled, small_side, table, words

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the digest that number a bucket.
DIGITS = 3


@dataclass(frozen=True)
class Plan:
    """Weights by level and value, the budget as a share of all tokens, the most epochs of a leaf, and the seed."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=lambda: {
        "domain": {"web": 50, "forum": 30, "books": 20}, "lang": {"en": 55, "de": 15, "fr": 15, "es": 15},
    })
    budget_percent: int = 60
    epochs: int = 4
    seed: int = 17


def domain(source: Column) -> Column:
    """The domain of a source, by the rest that 3 leaves of the number in its name; a number may have any length."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    digits = lambda which: F.length(F.regexp_replace(number, f"[^{which}]", ""))
    rest = (digits("147") + 2 * digits("258")) % 3  # that of the sum of its digits
    return F.when(number == "", "web").otherwise(F.element_at(F.array(F.lit("web"), F.lit("forum"), F.lit("books")), rest + 1))


def _weight(plan: Plan, level: str) -> Column:
    known = plan.weights.get(level, {})
    out = F.lit(1)
    for value, weight in known.items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("long")


def _split(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Children (weight w, supply s) with the parent's budget b shared out to them as `budget`.

    Sums run over the children of one node. Products of tokens and weights stay exact as 38-digit decimals.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    # Children in the order of supply per weight; that order alone needs no more than double precision.
    order = Window.partitionBy(*parents).orderBy(F.col("key"), F.col(level))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    ranked = (
        children.where("w > 0").withColumn("key", F.col("s").cast("double") / F.col("w").cast("double"))
        .withColumn("s_before", F.coalesce(F.sum("s").over(upto), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
        .withColumn("w_all", F.sum("w").over(whole))
        .withColumn("full", wide(F.col("s")) * wide(F.col("w_all") - F.col("w_before")) <= wide(F.col("w")) * wide(F.col("b") - F.col("s_before")))
    )
    # The first child that is not full sets the level for itself and all after it.
    first = F.min(F.when(~F.col("full"), F.struct("key", level, "s_before", "w_before"))).over(whole)
    levelled = ranked.withColumn("first", first).withColumn("after", F.col("first").isNotNull() & (F.struct("key", level) >= F.struct("first.key", f"first.{level}")))
    share = F.expr("(cast(b - first.s_before as decimal(38,0)) * w) div (w_all - first.w_before)")
    return levelled.withColumn("budget", F.when(F.col("after"), F.least(F.greatest(share, F.lit(0)), F.col("s"))).otherwise(F.col("s")).cast("long"))


def leaf_budgets(documents: DataFrame, plan: Plan = Plan(), levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(levels, tokens, budget) of each leaf; documents holds the levels and n_tokens. One row per node from here on."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    leaves = settled(documents.select(*named, "n_tokens").groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    nodes = leaves.withColumn("s", F.col("tokens") * plan.epochs)
    whole = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets, parents = None, []
    for depth, level in enumerate(levels):
        path = list(levels[:depth + 1])
        children = nodes.groupBy(*path).agg(F.sum("s").alias("s")).withColumn("w", _weight(plan, level))
        given = children.join(budgets, parents) if parents else children.withColumn("b", F.lit(whole * plan.budget_percent // 100).cast("long"))
        budgets = _split(given, parents, level).select(*path, F.col("budget").alias("b"))
        parents = path
    return leaves.join(budgets, list(levels)).withColumnRenamed("b", "budget")


def mix(documents: DataFrame, plan: Plan = Plan(), levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The documents (doc_id, levels, n_tokens and any more) that are taken, with `copies`: the epochs that take them."""
    names = documents.columns
    digest = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    path = [f"_{c}" for c in levels]
    keyed = documents.withColumns(
        {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels} | {"_digest": digest, "_bucket": F.substring(digest, 1, DIGITS)})
    budgets = settled(
        leaf_budgets(documents, plan, levels).where("tokens > 0").toDF(*path, "_tokens", "_budget")
        .withColumn("_full", F.expr("_budget div _tokens")).withColumn("_rest", F.expr("_budget % _tokens")))
    # Where the last prefix ends: bucket sums, then one bucket per leaf in order of the digest.
    sums = keyed.groupBy(*path, "_bucket").agg(F.sum("n_tokens").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*path).orderBy("_bucket"))
    ends = sums.withColumn("_upto", run).join(budgets, path)
    edge = settled(
        ends.where("_upto > _rest").groupBy(*path).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_e"))
        .select(*path, F.col("_e._bucket").alias("_edge"), F.col("_e._before").alias("_before")))
    # One row per leaf: counted, and broadcast if that is few; else Spark shuffles.
    limits = settled(budgets.join(edge, path, "left"))
    at_edge = (
        keyed.select(*path, "_bucket", "_digest", "n_tokens").join(small_side(limits), path).where("_bucket = _edge")
        .groupBy(*path, "_digest", "_before", "_rest").agg(F.sum("n_tokens").alias("_n"))
    )
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*path).orderBy("_digest"))
    last = at_edge.withColumn("_upto", upto).where("_upto <= _rest").groupBy(*path).agg(F.max("_digest").alias("_last"))
    limits = settled(limits.join(last, path, "left"))
    partial = F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")) | F.coalesce((F.col("_bucket") == F.col("_edge")) & (F.col("_digest") <= F.col("_last")), F.lit(False))
    copies = F.col("_full") + F.when(partial & (F.col("_rest") > 0), 1).otherwise(0)
    return keyed.join(small_side(limits), path).withColumn("copies", copies.cast("long")).where("copies > 0 and n_tokens > 0").select(*names, "copies")


def with_levels(documents: DataFrame) -> DataFrame:
    """Documents with the domain of their source and their number of words."""
    return documents.withColumn("domain", domain(F.col("source"))).withColumn("n_tokens", F.size(words(F.col("text"))).cast("long"))


def select(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The documents of the mixture with their columns as given, and `copies`."""
    names = documents.columns
    rows = documents.select(
        F.struct(*[documents[c] for c in names]).alias("_row"), "doc_id", "lang", "source", domain(F.col("source")).alias("domain"),
        F.size(words(F.col("text"))).cast("long").alias("n_tokens"),
    )
    return mix(rows, plan).select(*[F.col(f"_row.`{c}`").alias(c) for c in names if c != "copies"], "copies")


def op3_mixture(spark, folder: str) -> DataFrame:
    """The mixture drawn from the whole `documents` table."""
    rows = with_levels(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return mix(rows)


def oracle(plan: Plan = Plan()) -> str:
    """DuckDB SQL of op3_mixture: the same splits, and prefix sums over whole leaves."""
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN n.{level} = '{v}' THEN {w}" for v, w in plan.weights.get(level, {}).items())
        return f"(CASE {cases} ELSE 1 END)" if cases else "1"

    steps, parent, path = [], "budget0", []
    for depth, level in enumerate(LEVELS):
        path.append(level)
        on = " AND ".join(f"n.{c} = p.{c}" for c in path[:-1]) or "true"
        by = f"PARTITION BY {', '.join(path[:-1])}" if path[:-1] else ""
        keys = ", ".join(path)
        steps.append(f"""
kids{depth} AS (SELECT {', '.join('n.' + c for c in path)}, n.s, {weight(level)}::HUGEINT AS w, p.b FROM
  (SELECT {keys}, sum(s)::HUGEINT AS s FROM nodes GROUP BY {keys}) n JOIN {parent} p ON {on}),
rank{depth} AS (SELECT *, s::DOUBLE / w::DOUBLE AS k FROM kids{depth} WHERE w > 0),
run{depth} AS (SELECT *, coalesce(sum(s) OVER ({by} ORDER BY k, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
  coalesce(sum(w) OVER ({by} ORDER BY k, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(w) OVER ({by}) AS wa FROM rank{depth}),
full{depth} AS (SELECT *, s * (wa - wb) <= w * (b - sb) AS f FROM run{depth}),
lev{depth} AS (SELECT *, min(CASE WHEN NOT f THEN wb END) OVER ({by}) AS fw, min(CASE WHEN NOT f THEN sb END) OVER ({by}) AS fs FROM full{depth}),
budget{depth + 1} AS (SELECT {keys}, CASE WHEN fw IS NOT NULL AND wb >= fw THEN least(greatest(((b - fs) * w)::HUGEINT // (wa - fw)::HUGEINT, 0), s) ELSE s END AS b FROM lev{depth})""")
        parent = f"budget{depth + 1}"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, source, CASE regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) WHEN '' THEN 'web' ELSE
           ['web', 'forum', 'books'][(length(regexp_replace(regexp_extract(source, '([0-9]+)$', 1), '[^147]', '', 'g')) + 2 * length(regexp_replace(regexp_extract(source, '([0-9]+)$', 1), '[^258]', '', 'g'))) % 3 + 1] END AS domain,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents),
nodes AS (SELECT domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, sum(n_tokens) AS t, sum(n_tokens) * {plan.epochs} AS s FROM d GROUP BY ALL),
budget0 AS (SELECT (sum(t)::HUGEINT * {plan.budget_percent}) // 100 AS b FROM nodes),{','.join(steps)},
leaf AS (SELECT n.domain, n.lang, n.source, (b // t)::BIGINT AS full_epochs, (b % t)::BIGINT AS rest FROM nodes n JOIN {parent} USING (domain, lang, source) WHERE t > 0),
o AS (SELECT d.*, leaf.full_epochs, leaf.rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{plan.seed}:' || coalesce(d.doc_id::VARCHAR, 'null'))) AS upto
      FROM d JOIN leaf ON d.domain = leaf.domain AND coalesce(d.lang, '') = leaf.lang AND coalesce(d.source, '') = leaf.source)
SELECT doc_id, lang, source, domain, n_tokens, (full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM o WHERE n_tokens > 0 AND full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""
