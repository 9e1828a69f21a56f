"""Set scoring, accuracies, intervals, paired comparison. Everything is an aggregate over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyword_list import close_in
from ..functions.text import collapse, is_empty, strip
from ..sources.shared import running_sums

Z95 = 1.959964


def overlap_counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """df with tp, fp, fn of two array columns taken as sets."""
    g, p = F.array_distinct(F.col(gold)), F.array_distinct(F.col(predicted))
    tp = F.size(F.array_intersect(g, p))
    return df.withColumns({"tp": tp, "fp": F.size(p) - tp, "fn": F.size(g) - tp})


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp.cast("double"), (tp + fp).cast("double"))


def recall(tp: Column, fn: Column) -> Column:
    return F.try_divide(tp.cast("double"), (tp + fn).cast("double"))


def f1(p: Column, r: Column, of_zeros: float | None = 0.0) -> Column:
    """Null if either is undefined; `of_zeros` if both are 0, which is 0 for a single document and undefined for sums over many."""
    return F.when(p.isNotNull() & r.isNotNull(), F.when((p == 0) & (r == 0), F.lit(of_zeros)).otherwise(2 * p * r / (p + r)))


def prf(df: DataFrame, digits: int = 6, of_zeros: float | None = 0.0) -> DataFrame:
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return df.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(f1(p, r, of_zeros), digits)})


def micro(df: DataFrame, *keys: str) -> DataFrame:
    """Counts summed over documents that have anything on either side, then precision, recall and F1 (null where both are 0)."""
    some = df.where("tp + fp + fn > 0")
    return prf(some.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), of_zeros=None)


def jaccard(a: Column, b: Column) -> Column:
    """Null if both sets are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def mean_jaccard(df: DataFrame, overlap: str, *keys: str) -> DataFrame:
    """n and mean of the overlaps that are defined; those of two empty sets don't count."""
    return df.groupBy(*keys).agg(F.count(overlap).alias("n"), F.round(F.avg(overlap), 6).alias("jaccard"))


def critical_recall(df: DataFrame, hits: str, criticals: str, *keys: str) -> DataFrame:
    """Critical items that were found of all critical ones, over the documents of each group; null where there are none."""
    sums = df.groupBy(*keys).agg(F.sum(criticals).alias("n"), F.sum(hits).alias("hits"))
    return sums.select(*keys, "n", "hits", F.round(F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")), 6).alias("critical_recall"))


def same_scalar(a: Column, b: Column) -> Column:
    norm = lambda c: collapse(F.lower(strip(c)))
    return norm(a) == norm(b)


def category_correct(gold: Column, predicted: Column) -> Column:
    """Null (not scored) where the gold value is empty."""
    return F.when(~is_empty(gold), F.coalesce(same_scalar(gold, predicted), F.lit(False)))


def date_correct(gold: Column, predicted: Column) -> Column:
    """An empty gold date asks for an empty prediction."""
    return F.when(is_empty(gold), is_empty(predicted)).otherwise(F.coalesce(same_scalar(gold, predicted), F.lit(False)))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of k successes of n; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def with_average(df: DataFrame, key: str, label: str = "AVERAGE", digits: int = 6) -> DataFrame:
    """df with one more row: the mean of every numeric or boolean column."""
    numeric = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "boolean") and n != key}
    as_double = df.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c).cast("string").alias(c) for c in df.columns])
    last = as_double.agg(*[F.round(F.avg(c), digits).alias(c) for c in df.columns if c in numeric]).withColumn(key, F.lit(label))
    return as_double.unionByName(last, allowMissingColumns=True)


def field_success(df: DataFrame, sentinels: dict[str, tuple[str, ...]], strict: bool = False) -> DataFrame:
    """Per field, rows whose value is no sentinel. As published, missing values and `ERROR: ...` count as success; strict counts neither."""
    def good(c: str, bad) -> Column:
        ok = ~F.coalesce(F.col(c), F.lit("")).isin(*bad)
        return ok & ~is_empty(F.col(c)) if strict else ok

    return df.agg(F.count("*").alias("total"), *[F.count_if(good(c, bad)).alias(c) for c, bad in sentinels.items()])


def error_kind(in_match: Column, is_gold: Column, item: Column, given: Column, full: Column) -> Column:
    """Why an item is right or wrong: matched, or by whether its words are in the text that was given or in the whole one."""
    return (
        F.when(in_match, F.lit("correct"))
        .when(is_gold & close_in(item, given), F.lit("missed, in the given text"))
        .when(is_gold & close_in(item, full), F.lit("missed, not in the given text"))
        .when(is_gold, F.lit("missed, not found in the text"))
        .when(close_in(item, given), F.lit("added, in the given text"))
        .otherwise(F.lit("added, not in the given text"))
    )


def paired_counts(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """How many pairs improved or got worse, and the mean difference."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(b) > F.col(a)).alias("improved"), F.count_if(F.col(b) < F.col(a)).alias("worse"), F.round(F.avg(F.col(b) - F.col(a)), 6).alias("mean_diff"))


#: Largest n for which the signed-rank test's p is exact, provided that no differences tie or are zero.
EXACT_PAIRS = 50


def signed_rank_counts(most: int = EXACT_PAIRS) -> list[list[int]]:
    """[n][w]: in how many of the 2**n sign patterns the ranks 1..n of one sign add up to w; each rank is one more convolution."""
    rows = [[1]]
    for n in range(1, most + 1):
        before, size = rows[-1], n * (n + 1) // 2 + 1
        rows.append([(before[w] if w < len(before) else 0) + (before[w - n] if 0 <= w - n < len(before) else 0) for w in range(size)])
    return rows


def _exact_tails(spark: SparkSession) -> DataFrame:
    """(n, w, exact): two-sided p for the smaller sum w; about EXACT_PAIRS ** 3 / 12 rows whatever the data."""
    rows = []
    for n, counts in enumerate(signed_rank_counts()):
        below = 0
        for w in range(n * (n + 1) // 4 + 1):
            below += counts[w]
            rows.append((n, float(w), min(1.0, 2 * below / 2**n)))
    return spark.createDataFrame(rows, "n long, w double, exact double")


def signed_rank(df: DataFrame, diff: str, *keys: str) -> DataFrame:
    """Wilcoxon's W over non-zero differences with mean ranks for ties, and the two-sided p.

    p is exact for at most EXACT_PAIRS differences without zeros and ties, by the null distribution, and else the normal approximation with ties
    corrected for (z). It is 1 if all differences are zero. Ranks are running counts of distinct sizes, summed by ranges, so one group may have all rows.
    """
    sized = df.withColumn("__size", F.abs(diff))
    ties = sized.groupBy(*keys, "__size").agg(F.count("*").alias("t"), F.count_if(F.col(diff) > 0).alias("up")).where("__size is not null")
    some = F.col("__size") > 0
    ranked = running_sums(ties.withColumn("t_", F.when(some, F.col("t")).otherwise(0)), list(keys), ["__size"], "t_", "upto")
    ranked = ranked.withColumn("rank", F.col("upto") - F.col("t_") + (F.col("t_") + 1) / 2)
    one = lambda x: F.sum(F.when(some, x).otherwise(0))
    t, up = F.col("t"), F.col("up")
    sums = ranked.groupBy(*keys).agg(one(t).alias("n"), one(up * F.col("rank")).alias("plus"), one((t - up) * F.col("rank")).alias("minus"), one(t * t * t - t).alias("tied"), F.count_if(~some).alias("zeros"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    z = F.try_divide(F.abs(F.least("plus", "minus") - n * (n + 1) / 4), spread)
    out = sums.select(*keys, "n", F.least("plus", "minus").alias("w"), z.alias("z"), (F.col("tied") + F.col("zeros")).alias("__rough"))
    tails = F.broadcast(_exact_tails(df.sparkSession).withColumnsRenamed({"n": "__n", "w": "__w"}))
    both = out.join(tails, (F.col("n") == F.col("__n")) & (F.col("w") == F.col("__w")) & (F.col("__rough") == 0), "left")
    p = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.coalesce("exact", upper_tail(F.col("z"))))
    return both.select(*keys, "n", "w", "z", p.alias("p"))


def upper_tail(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation (absolute error below 1e-7), as Spark has no erf."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(2 * F.exp(-z * z / 2) / 2.5066282746310002 * poly, F.lit(1.0))
