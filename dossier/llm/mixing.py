"""Mixing sources to target weights. DataFrame operations only.

The corpus is a tree, by default domain - language - source. A node's budget goes to its children by weight; a child that can't
use its share (its tokens times max_epochs are fewer) is filled, and what is left goes to its siblings by weight. Only what a
whole subtree can't use reaches the siblings of its root: shortages move among siblings before ancestors. All of this is integer
arithmetic in windows over the children of a node, one row for each child.

Each leaf orders its documents anew for every epoch by md5(seed:epoch:doc_id). Its budget is a number of whole epochs and the
longest prefix of the next epoch that fits. To find the prefix, tokens are summed by the first hex digits of the order; only
the documents of the one bucket in which the prefix ends are sorted. A hot leaf is therefore never one task.

A child of weight 0 gets nothing, and its tokens don't count for what its ancestors can use; they do count for the size of the corpus, of
which the budget is a share.

Null and empty texts have no tokens and are never chosen; null levels are a leaf named by the empty string. Repeated rows count
each. The result is the chosen rows, with all their columns and __n_tokens and __copies, the number of epochs that take them (names that the
input has get an underscore more). An empty table, or one without tokens or usable leaves, gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace, unused

#: Share of the corpus's tokens that is asked for, epochs that a leaf may give, and the seed of the orders.
BUDGET_PERCENT, MAX_EPOCHS, SEED, DIGITS = 50, 3, 17, 3
#: Relative weights of the query's domains and languages; sources weigh the same.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 10, "fr": 4, "de": 3, "es": 3}


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The documents' sources are numbered; four domains share them."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long") % 4, F.lit(0)).cast("string"))


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each parent's `budget` to its children (columns cap, weight): by weight, nobody above cap, what is left by weight to the others."""
    order = [(F.col("cap") / F.col("weight")).asc(), F.col(name).asc()]
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = by.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = by.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    steps = children.where("weight > 0").withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(onward))
    steps = steps.withColumn("full", (F.col("budget") - F.col("filled")) * F.col("weight") >= F.col("cap") * F.col("weights"))
    steps = steps.withColumn("rest", F.col("budget") - F.min(F.when(~F.col("full"), F.col("filled"))).over(by)).withColumn("over", F.max(F.when(~F.col("full"), F.col("weights"))).over(by))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(rest * weight) div over"))
    return steps.select(*parent, name, "tokens", share.alias("budget"))


def _weight(name: str, weights: dict[str, int]) -> Column:
    """Weight of the children by name; those that aren't listed weigh 1."""
    given = F.lit(1)
    for value, w in weights.items():
        given = F.when(F.col(name) == value, F.lit(int(w))).otherwise(given)
    return given.cast("long")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """leaves (levels, tokens) with the budget of each that can have one."""
    top = leaves.agg(F.expr(f"sum(tokens) * {percent} div 100").alias("budget"))
    usable = leaves
    for name, weight in zip(levels, weights):
        usable = usable.where(_weight(name, weight) > 0)
    budgets = None
    for depth, (name, weight) in enumerate(zip(levels, weights)):
        parent = levels[:depth]
        nodes = usable.groupBy(*parent, name).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs).withColumn("weight", _weight(name, weight))
        nodes = nodes.crossJoin(F.broadcast(top)) if budgets is None else nodes.join(budgets.select(*parent, "budget"), parent)
        budgets = fill(nodes, parent, name)
    return budgets


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], id_col: str = "doc_id", text_col: str = "text", percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, digits: int = DIGITS) -> DataFrame:
    """The chosen rows of docs, with their tokens and copies."""
    space = Workspace(docs.sparkSession, "mixing")
    n_tokens, copies, id_, whole, rest, rank, bucket, end, before, *names = (unused(docs, f"__{n}") for n in ("n_tokens", "copies", "id", "whole", "rest", "rank", "bucket", "end", "before", *levels))
    leafed = docs.select("*", token_count(F.col(f"`{text_col}`")).alias(n_tokens), *(F.coalesce(column.cast("string"), F.lit("")).alias(name) for name, column in zip(names, levels.values())))
    narrow = space.save(leafed.select(F.col(f"`{id_col}`").alias(id_), n_tokens, *names), "tokens")
    leaves = space.save(narrow.groupBy(*names).agg(F.sum(n_tokens).alias("tokens")).where("tokens > 0"), "leaves")
    budgets = leaf_budgets(leaves, names, weights, percent, max_epochs).select(*names, F.expr("budget div tokens").alias(whole), F.expr("budget % tokens").alias(rest))
    budgets = space.save(budgets, "budgets")

    def ordered(rows: DataFrame, key: str) -> DataFrame:
        place = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(whole) + 1).cast("string"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
        return rows.join(budgets, names).withColumn(rank, place).withColumn(bucket, F.substring(rank, 1, digits))

    sums = ordered(narrow, id_).groupBy(*names, bucket, rest).agg(F.sum(n_tokens).alias("tokens"))
    up_to = F.sum("tokens").over(W.partitionBy(*names).orderBy(bucket))
    ends = sums.withColumn("up_to", up_to).where(F.col("up_to") > F.col(rest)).groupBy(*names).agg(F.min(F.struct(F.col(bucket).alias("bucket"), F.expr("up_to - tokens").alias("before"))).alias("first"))
    ends = space.save(ends.select(*names, F.col("first.bucket").alias(end), F.col("first.before").alias(before)), "ends")
    placed = ordered(leafed.where(F.col(n_tokens) > 0), id_col).join(ends, names)
    clear = placed.where(F.col(bucket) != F.col(end)).withColumn(copies, F.col(whole) + (F.col(bucket) < F.col(end)).cast("long"))
    through = F.col(before) + F.sum(n_tokens).over(W.partitionBy(*names).orderBy(rank, F.col(f"`{id_col}`")).rowsBetween(W.unboundedPreceding, W.currentRow))
    split = placed.where(F.col(bucket) == F.col(end)).withColumn(copies, F.col(whole) + (through <= F.col(rest)).cast("long"))
    return clear.unionByName(split).where(F.col(copies) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], n_tokens, copies)


def document_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def mixing_report(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_tokens, copies of the chosen documents."""
    chosen = mix(docs.select("doc_id", "text", "lang", "source"), document_levels(), [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}])
    return chosen.select("doc_id", "lang", "source", F.col("__n_tokens").alias("n_tokens"), F.col("__copies").alias("copies"))


def _level_sql(parent: list[str], name: str, weight: str, above: str, made: str) -> str:
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, name])
    on = " AND ".join(f"n.{p} = a.{p}" for p in parent) or "true"
    order = f"{part} ORDER BY cap / weight, {name}"
    return f"""
{made}_n AS (SELECT {keys}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {MAX_EPOCHS} AS cap, ({weight})::BIGINT AS weight FROM usable GROUP BY {keys}),
{made}_s AS (SELECT *,
    coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
  FROM (SELECT n.*, a.budget FROM {made}_n n JOIN {above} a ON {on})),
{made}_f AS (SELECT *, (budget - filled) * weight >= cap * weights AS is_full FROM {made}_s),
{made}_r AS (SELECT *, budget - min(CASE WHEN NOT is_full THEN filled END) OVER ({part}) AS rest, max(CASE WHEN NOT is_full THEN weights END) OVER ({part}) AS over_w FROM {made}_f),
{made} AS (SELECT {keys}, tokens, CASE WHEN is_full THEN cap ELSE (rest * weight) // over_w END AS budget FROM {made}_r)"""


def _sql() -> str:
    case = lambda column, weights: "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, 'domain' || coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4, 0) AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
top AS (SELECT (sum(tokens)::BIGINT * {BUDGET_PERCENT}) // 100 AS budget FROM leaves),
usable AS (SELECT * FROM leaves WHERE ({case("domain", DOMAIN_WEIGHTS)}) > 0 AND ({case("lang", LANG_WEIGHTS)}) > 0),
{_level_sql([], "domain", case("domain", DOMAIN_WEIGHTS), "top", "b1")},
{_level_sql(["domain"], "lang", case("lang", LANG_WEIGHTS), "b1", "b2")},
{_level_sql(["domain", "lang"], "source", "1", "b2", "b3")},
o AS (SELECT d.*, b.budget // b.tokens AS whole, b.budget % b.tokens AS rest, md5('{SEED}:' || (b.budget // b.tokens + 1) || ':' || d.doc_id) AS rank
      FROM d JOIN b3 b ON d.domain = b.domain AND d.lang = b.lang AND d.source = b.source),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM o)
SELECT doc_id, lang, source, n_tokens, (whole + CASE WHEN through <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
WHERE n_tokens > 0 AND whole + CASE WHEN through <= rest THEN 1 ELSE 0 END > 0
"""


SQL = _sql()
