"""Bootstrap intervals and hypothesis tests. Spark computes moments, ranks and resamples; only the p-value of each
finished test, one row, goes through Python."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revwatch.functions.numeric import safe_divide
from revwatch.functions.pvalues import chi2_pvalue, normal_pvalue, t_pvalue
from revwatch.functions.subquery import only_row
from revwatch.operators.global_order import exact_quantiles_by, rank_globally
from revwatch.session import materialize

MIN_GROUP = 10
MIN_PAIRS = 5
#: Rows (a few numbers each) that the draws of a bootstrap may look up in every task.
BROADCAST_ROWS = 200_000

Statistic = Callable[[Column], Column]


def _uniform_int(*parts: Column) -> Column:
    """32-bit number from an md5 of the parts; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("bigint")


def _interval(replicates: DataFrame, keys: Sequence[str], confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    return replicates.groupBy(*keys).agg(F.percentile("stat", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))


def _point(df: DataFrame, keys: Sequence[str], value: str, statistic: Statistic, min_group: int) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(statistic(F.col(value)).alias("estimate"), F.count(value).alias("n"))
        .filter(F.col("n") >= min_group)
    )


def bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order_by: Sequence[str],
    statistic: Statistic = F.avg,
    replicates: int = 2000,
    confidence: float = 0.95,
    seed: int = 42,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Percentile interval from resamples with replacement; groups below ``min_group`` are left out.

    ``order_by`` must order the rows of a group completely. Each draw is a hashed row number, looked up by an equi-join,
    so any aggregate can be the statistic. This emits rows x replicates and suits result tables;
    ``poisson_bootstrap_ci`` is the form for large data.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*{*keys, *order_by}, F.col(value).alias("x"))
    ranked = rank_globally(rows, [F.col(c) for c in (*keys, *order_by)])
    groups = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.min("position").alias("first"))
    numbered = ranked.join(groups, list(keys)).select(
        *keys, "x", "n", (F.col("position") - F.col("first")).alias("i")
    )
    numbered = materialize(numbered, "numbered")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = (
        numbered.filter(F.col("n") >= min_group)
        .repartition(partitions, *keys, "i")  # few rows, many replicates: spread before they multiply
        .select(*keys, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
        .select(*keys, "b", (_uniform_int(F.lit(seed), F.col("b"), F.col("i")) % F.col("n")).alias("i"))
    )
    lookup = numbered.select(*keys, "i", "x")
    if numbered.count() <= BROADCAST_ROWS:  # result tables; beyond that, draws and rows are shuffled to each other
        lookup = F.broadcast(lookup)
    stats = draws.join(lookup, [*keys, "i"]).groupBy(*keys, "b").agg(statistic(F.col("x")).alias("stat"))
    return _point(df, keys, value, statistic, min_group).join(_interval(stats, keys, confidence), list(keys)).select(
        *keys, "n", "estimate", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper")
    )


# Cumulative Poisson(1) probabilities; a uniform above the k-th one means a weight above k.
_POISSON_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def poisson_bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    row_id: Sequence[str],
    replicates: int = 2000,
    confidence: float = 0.95,
    seed: int = 42,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Interval of a mean with Poisson(1) weights per (row, replicate): no join, and only one partial sum per replicate
    and task is shuffled."""
    u = _uniform_int(F.lit(seed), F.col("b"), *[F.col(c) for c in row_id]) / F.lit(float(1 << 32))
    weight = sum(((u >= F.lit(c)).cast("int") for c in _POISSON_CDF[1:]), (u >= F.lit(_POISSON_CDF[0])).cast("int"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = (
        df.filter(F.col(value).isNotNull())
        .select(*{*keys, value, *row_id})
        .repartition(partitions, *row_id)  # spread before the replicates multiply the rows
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("w", weight)
        .groupBy(*keys, "b")
        .agg(safe_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("stat"))
    )
    return _point(df, keys, value, F.avg, min_group).join(_interval(stats, keys, confidence), list(keys)).select(
        *keys, "n", "estimate", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper")
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    return safe_divide(F.sum(value * weight), F.sum(weight))


def weighted_median(value: Column, weight: Column) -> Column:
    return F.percentile(value, F.lit(0.5), weight)


def little_bootstraps_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    row_id: Sequence[str],
    statistics: Mapping[str, Callable[[Column, Column], Column]] = MappingProxyType(
        {"mean": weighted_mean, "median": weighted_median}
    ),
    subsets: int = 10,
    replicates: int = 81,
    gamma: float = 0.6,
    confidence: float = 0.95,
    seed: int = 42,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Intervals of any weighted statistics by a bag of little bootstraps: (keys, statistic, n, estimate, ci_lower, ci_upper).

    Of a group of n rows, up to ``subsets`` disjoint subsets of about b = n ** ``gamma`` rows each are drawn by hash. In each,
    a resample of n rows is b weights: the counts of a multinomial, in their normal approximation, from hashes of (replicate,
    row). The percentile intervals of the subsets are averaged; the estimate is that of all rows. Only the rows of the
    subsets are shuffled, once and before they meet the replicates, so the shuffle does not depend on their number.
    Groups below ``min_group`` rows are left out, and so are null values.
    """
    ids = [F.col(c) for c in row_id]
    rows = df.filter(F.col(value).isNotNull()).select(*{*keys, *row_id}, F.col(value).cast("double").alias("x"))
    one = F.lit(1).cast("bigint")
    estimates = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[stat(F.col("x"), one).alias(f"est_{name}") for name, stat in statistics.items()]
    )
    groups = estimates.filter(F.col("n") >= min_group).select(
        *keys, "n", F.floor(F.col("n") / F.ceil(F.pow(F.col("n").cast("double"), F.lit(gamma)))).cast("bigint").alias("parts")
    )
    part = F.shiftright(_uniform_int(F.lit(seed), *ids) * F.col("parts"), 32).alias("part")
    drawn = rows.join(groups, list(keys)).select(*keys, *[c for c in row_id if c not in keys], "x", "n", part)
    drawn = drawn.filter(F.col("part") < subsets).repartition(*keys, "part")
    own = Window.partitionBy(*keys, "part")
    drawn = drawn.withColumn("rate", F.col("n") / F.count(F.lit(1)).over(own))
    resampled = drawn.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # Four uniform numbers of 32 bits add up to an almost normal one; its variance is a third.
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.col("b"), *ids))
    quarter = sum((F.conv(F.substring(digest, k, 8), 16, 10).cast("bigint") for k in (9, 17, 25)), F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"))
    normal = (quarter - F.lit(2 * (2**32 - 1))) / F.lit(2.0**32) * F.sqrt(F.lit(3.0))
    weight = F.greatest(F.floor(F.col("rate") + F.sqrt("rate") * normal + 0.5), F.lit(0)).cast("bigint")
    stats = resampled.withColumn("w", weight).groupBy(*keys, "part", "b").agg(
        *[stat(F.col("x"), F.col("w")).alias(name) for name, stat in statistics.items()]
    )
    long = stats.unpivot([*keys, "part", "b"], list(statistics), "statistic", "stat")
    within = _interval(long, [*keys, "part", "statistic"], confidence)
    averaged = within.groupBy(*keys, "statistic").agg(
        F.avg(F.col("ci")[0]).alias("ci_lower"), F.avg(F.col("ci")[1]).alias("ci_upper")
    )
    wide = {f"est_{name}": name for name in statistics}
    points = estimates.withColumnsRenamed(wide).unpivot([*keys, "n"], list(statistics), "statistic", "estimate")
    return points.join(averaged, [*keys, "statistic"]).select(*keys, "statistic", "n", "estimate", "ci_lower", "ci_upper")


def _moments(value: Column | str) -> list[Column]:
    return [F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).cast("double").alias("n")]


def one_sample_ttest(df: DataFrame, value: str, against: float, keys: Sequence[str] = ()) -> DataFrame:
    t = safe_divide(F.col("m") - F.lit(against), F.sqrt(F.col("v") / F.col("n")))
    return (
        df.groupBy(*keys)
        .agg(*_moments(value))
        .withColumns({"t": t, "df": F.col("n") - 1})
        .select(*keys, F.col("m").alias("mean"), F.col("n").cast("bigint").alias("n"), "t", "df",
                t_pvalue("t", "df").alias("p_value"))
    )


def paired_ttest(
    df: DataFrame,
    value: str,
    group: str,
    base: Sequence[str],
    other: Sequence[str],
    match_on: Sequence[str] = ("method_type", "scaler"),
    min_pairs: int = MIN_PAIRS,
) -> DataFrame:
    """Mean difference other - base over matched groups; the test is empty below ``min_pairs`` pairs."""

    def side(names, alias):
        return df.filter(F.col(group).isin(*names)).groupBy(*match_on).agg(F.avg(value).alias(alias))

    diff = side(base, "a").join(side(other, "b"), list(match_on)).select((F.col("b") - F.col("a")).alias("d"))
    enough = F.col("n") >= min_pairs
    t = safe_divide(F.col("m"), F.sqrt(F.col("v") / F.col("n")))
    return (
        diff.agg(*_moments("d"))
        .withColumns({"t": F.when(enough, t), "df": F.when(enough, F.col("n") - 1)})
        .select(
            F.when(enough, F.col("m") * 100).alias("improvement_pct"),
            F.col("n").cast("bigint").alias("n_pairs"),
            "t",
            "df",
            t_pvalue("t", "df").alias("p_value"),
        )
    )


def welch_ttest(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """Two-sample t-test with unequal variances: rows where ``flag`` holds against the others."""
    a, b = F.when(flag, F.col(value)), F.when(~flag, F.col(value))
    row = df.agg(
        F.avg(a).alias("mean_a"), F.var_samp(a).alias("va"), F.count(a).cast("double").alias("na"),
        F.avg(b).alias("mean_b"), F.var_samp(b).alias("vb"), F.count(b).cast("double").alias("nb"),
    )
    ea, eb = safe_divide(F.col("va"), F.col("na")), safe_divide(F.col("vb"), F.col("nb"))
    t = safe_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(ea + eb))
    dof = safe_divide((ea + eb) * (ea + eb), ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))
    return row.withColumns({"t": t, "df": dof}).select(
        "mean_a", F.col("na").cast("bigint").alias("n_a"), "mean_b", F.col("nb").cast("bigint").alias("n_b"),
        "t", "df", t_pvalue("t", "df").alias("p_value"),
    )


def contingency(df: DataFrame, row: str, col: Column, values: Sequence) -> DataFrame:
    """Row × column counts, absent cells 0."""
    return df.withColumn("c", col).groupBy(row).pivot("c", list(values)).agg(F.count(F.lit(1))).na.fill(0)


def chi_square(df: DataFrame, row: str, flag: Column) -> DataFrame:
    """Independence of a category and a yes/no outcome; one degree of freedom gets the continuity correction.

    NULL when the outcome never varies or only one category occurs.
    """
    counts = df.groupBy(row).agg(F.count_if(flag).alias("yes"), F.count("*").alias("row_total"))
    everything = Window.partitionBy()  # one row per category
    counts = counts.withColumns(
        {
            "all_yes": F.sum("yes").over(everything),
            "n": F.sum("row_total").over(everything),
            "n_rows": F.count("*").over(everything),
        }
    )
    cell = F.array(
        F.struct(F.col("yes").alias("o"), F.col("all_yes").alias("col_total")),
        F.struct((F.col("row_total") - F.col("yes")).alias("o"), (F.col("n") - F.col("all_yes")).alias("col_total")),
    )
    cells = (
        counts.select("row_total", "n", (F.col("n_rows") - 1).alias("dof"), F.inline(cell))
        .withColumn("e", F.col("row_total") * F.col("col_total") / F.col("n"))
    )
    gap = F.abs(F.col("o") - F.col("e"))
    used = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    defined = (F.min("col_total") > 0) & (F.col("dof") > 0)
    return (
        cells.groupBy("dof", "n")
        .agg(F.when(defined, F.sum(F.try_divide(used * used, F.col("e")))).alias("chi2"))
        .select("chi2", "dof", "n", chi2_pvalue("chi2", F.col("dof").cast("double")).alias("p_value"))
    )


def mann_whitney(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Two-sided U test with average ranks, tie-corrected normal approximation and continuity correction.

    Values are counted per distinct value first; ranks come from running counts over those.
    """
    two = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    counts = two.groupBy(F.col(value).alias("v")).agg(
        F.count_if(F.col(group) == a).alias("ca"), F.count("*").alias("c")
    )
    ranked = rank_globally(counts, [F.col("v")], {"upto": F.col("c")}).select(
        F.col("ca").cast("double").alias("ca"),
        F.col("c").cast("double").alias("c"),
        (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"),
    )
    row = ranked.agg(
        F.sum(F.col("ca") * F.col("rank")).alias("rank_sum"),
        F.sum("ca").alias("n1"),
        F.sum(F.col("c") - F.col("ca")).alias("n2"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - safe_divide(F.col("ties"), n * (n - 1))))
    z = safe_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)

    medians = only_row(
        exact_quantiles_by(two, [group], value, [0.5]).agg(
            F.max(F.when(F.col(group) == a, F.col("q50"))).alias("a"),
            F.max(F.when(F.col(group) == b, F.col("q50"))).alias("b"),
        )
    )
    return row.withColumns({"u": u, "z": z}).select(
        "u", "z", n1.cast("bigint").alias("n_a"), n2.cast("bigint").alias("n_b"),
        medians["a"].alias("median_a"), medians["b"].alias("median_b"), normal_pvalue("z").alias("p_value"),
    )


def jarque_bera(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Normality from population skewness and excess kurtosis, n/6 (S² + K²/4), over all rows of each key."""
    skew, kurt = F.col("skewness"), F.col("excess_kurtosis")
    return (
        df.groupBy(*keys)
        .agg(
            F.count(value).alias("n"),
            F.skewness(value).alias("skewness"),
            F.kurtosis(value).alias("excess_kurtosis"),
        )
        .withColumn("jb", F.col("n") / 6 * (skew * skew + kurt * kurt / 4))
        .withColumn("p_value", chi2_pvalue("jb", F.lit(2.0)))
    )
