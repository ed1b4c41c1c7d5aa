"""Rank statistics, strata, regression and class metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import beta_i, gamma_q

PARTS = 64


def _part(df: DataFrame, value: str, parts: int = PARTS) -> Column:
    """A number that never falls as value rises: parts of about equal size, from quantiles on the driver (`parts` numbers)."""
    edges = sorted(set(df.approxQuantile(value, [i / parts for i in range(1, parts)], 0.002)))
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col(value)))


def ranks_of_counts(counts: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """value, out (ranks from 1, ties sharing their mean), out_ties of distinct values that stand n times each. A window
    ranks the values of one part, and the parts' sums place the parts, so that no task sorts all values."""
    counts = counts.withColumn("_part", _part(counts, value))
    sums = counts.groupBy("_part").agg(F.sum(n).alias("_all"))
    before = sums.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))  # a row a part
    upto = F.sum(n).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("_upto", upto).join(F.broadcast(before), "_part")
    return ranks.select(F.col(value), (F.col("_before") + F.col("_upto") - (F.col(n) - 1) / 2).alias(out), F.col(n).alias(out + "_ties"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the ranks of its values: distinct values are counted first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    return df.join(ranks_of_counts(counts, value, "_n", out), value, "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho, p (two-sided, Student's t) over pairs where both are there. Equal pairs are one row with their number from the
    beginning, so a frequent value is no hot key; the correlation of ranks comes from weighted sums around their known mean."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("m"))
    one, two = (ranks_of_counts(pairs.groupBy(c).agg(F.sum("m").alias("_n")), c, "_n", "r" + c).select(c, "r" + c) for c in ("x", "y"))
    ranked = pairs.join(one, "x").join(two, "y")
    total = pairs.agg(F.sum("m").alias("n"))  # one row
    mid = (F.col("n") + 1) / 2
    a, b, m = F.col("rx") - mid, F.col("ry") - mid, F.col("m")
    r = ranked.join(F.broadcast(total)).agg(F.sum("m").alias("n"), F.sum(m * a * b).alias("_ab"), F.sum(m * a * a).alias("_aa"), F.sum(m * b * b).alias("_bb"))
    norm = F.sqrt("_aa") * F.sqrt("_bb")
    r = r.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(norm > 0, F.col("_ab") / norm).alias("rho"))
    df_ = (F.col("n") - 2).cast("double")
    t2 = F.col("rho") * F.col("rho") * df_ / (1 - F.col("rho") * F.col("rho"))
    p = F.when(F.abs(F.col("rho")) >= 1, 0.0).otherwise(beta_i(df_ / (df_ + t2), df_ / 2, F.lit(0.5)))
    return r.withColumn("p", p)


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """n, h (corrected for ties), p (chi-squared). Equal values of a group are one row with their number."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).cast("double").alias("v"), F.col(group).alias("g")).agg(F.count("*").alias("m"))
    counts = rows.groupBy("v").agg(F.sum("m").alias("_n"))
    ranked = rows.join(ranks_of_counts(counts, "v", "_n", "r"), "v")
    groups = ranked.groupBy("g").agg(F.sum(F.col("r") * F.col("m")).alias("s"), F.sum("m").alias("m"))
    t = F.col("_n").cast("double")
    ties = counts.agg(F.sum(t * t * t - t).alias("ties"))
    h = groups.agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("ss"), F.sum("m").alias("n"), F.count("*").alias("k")).join(F.broadcast(ties))
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("ss") - (n + 1) * 3
    h = h.withColumn("h", raw / (1 - F.col("ties") / (n * n * n - n)))
    return h.select("n", "h", gamma_q((F.col("k") - 1) / F.lit(2.0), F.col("h") / 2).alias("p"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, accuracy: int = 50_000) -> DataFrame:
    """by, q: exact linear-interpolated quantiles, NULL without values, without all values in one task.

    A mergeable sketch brackets each quantile between two values that are a few rows in `accuracy` apart; a second pass counts
    the rows below each bracket and the distinct values inside, of which the ones at the wanted places are picked. In
    small tables a place may be the one before or behind a bracket, so those two values are kept, too.
    """
    by, v = by or [], F.col(value).cast("double")
    eps = 4 / accuracy
    rows = df.where(F.col(value).isNotNull()).select(*by, v.alias("_v"))
    edges = lambda sign: F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, p + sign * eps))) for p in probs]), accuracy)
    aggs = [F.count("*").alias("_n"), edges(-1).alias("_lo"), edges(1).alias("_hi")]
    bounds = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)  # a row for each group of `by`
    met = rows.join(F.broadcast(bounds.drop("_n")), by) if by else rows.join(F.broadcast(bounds.drop("_n")))
    k = len(probs)
    inside = F.exists(F.arrays_zip("_lo", "_hi"), lambda e: F.col("_v").between(e["_lo"], e["_hi"]))
    below = [F.sum(F.when(F.col("_v") < F.col("_lo")[i], 1).otherwise(0)).alias(f"_b{i}") for i in range(k)]
    beside = [x for i in range(k) for x in (F.max(F.when(F.col("_v") < F.col("_lo")[i], F.col("_v"))).alias(f"_p{i}"), F.min(F.when(F.col("_v") > F.col("_hi")[i], F.col("_v"))).alias(f"_n{i}"))]
    counts = met.groupBy(*by, F.when(inside, F.col("_v")).alias("_at")).agg(F.count("*").alias("_m"), *below, *beside)
    last = [F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_m").alias("m"))))).alias("_list"), *[f(f"{c}{i}").alias(f"{c}{i}") for i in range(k) for f, c in ((F.sum, "_b"), (F.max, "_p"), (F.min, "_n"))]]
    got = counts.groupBy(*by).agg(*last) if by else counts.agg(*last)
    got = got.join(bounds, by) if by else got.join(F.broadcast(bounds))

    def at(i: int, index: Column) -> Column:
        """The value at a place, by running counts over the bracket's values."""
        own = F.filter("_list", lambda e: e["at"].between(F.col("_lo")[i], F.col("_hi")[i]))
        start = F.struct(F.col(f"_b{i}").alias("upto"), F.lit(None).cast("double").alias("found"))
        step = lambda s, e: F.struct((s["upto"] + e["m"]).alias("upto"), F.when(s["found"].isNull() & (s["upto"] + e["m"] > index), e["at"]).otherwise(s["found"]).alias("found"))
        return F.when(index < F.col(f"_b{i}"), F.col(f"_p{i}")).otherwise(F.coalesce(F.aggregate(own, start, step)["found"], F.col(f"_n{i}")))

    out = []
    for i, p in enumerate(probs):
        place = F.lit(p) * (F.col("_n") - 1)
        low, high = at(i, F.floor(place)), at(i, F.ceil(place))
        share = place - F.floor(place)
        # as percentile() weighs them
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + share * high))
    return got.select(*by, F.array(*out).alias("q"))


def quantile_strata(df: DataFrame, value: str, n: int = 4, out: str = "stratum") -> DataFrame:
    """The number of inner quantile edges at or below the value."""
    edges = exact_quantiles(df, value, [i / n for i in range(1, n)]).select(F.col("q").alias("_edges"))  # one row
    return df.join(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), F.size(F.filter("_edges", lambda e: e <= F.col(value))))).drop("_edges")


def stratum_stats(df: DataFrame, value: str, stratum: str = "stratum") -> DataFrame:
    rows = df.where(F.col(value).isNotNull() & F.col(stratum).isNotNull()).select(stratum, value)
    sums = rows.groupBy(stratum).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    q = exact_quantiles(rows, value, [0.25, 0.5, 0.75], [stratum])
    return sums.join(q, stratum).select(stratum, "mean", F.col("q")[1].alias("median"), "std", F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "n")


def share(condition: Column) -> Column:
    """Percentage of rows with a known condition that fulfil it."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0)) * 100


def change_summary(df: DataFrame, value: str, threshold: float = 0.05) -> DataFrame:
    v = F.col(value)
    sums = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), share(v > threshold).alias("wet_pct"), share(v < -threshold).alias("dry_pct"), share(F.abs(v) <= threshold).alias("neutral_pct"))
    q = exact_quantiles(df, value, [0.1, 0.9])  # one row each
    return sums.join(F.broadcast(q)).select("n", "mean", "std", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"), "wet_pct", "dry_pct", "neutral_pct")


def regression_metrics(df: DataFrame, obs: str = "obs", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """n, r2, rmse, mae, bias over finite pairs; NULL for fewer than two pairs, r2 for constant observations."""
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    finite = o.isNotNull() & p.isNotNull() & ~F.isnan(o) & ~F.isnan(p) & (F.abs(o) < float("inf")) & (F.abs(p) < float("inf"))
    e = p - o
    rows = df.where(finite)
    enough = F.count("*") >= 2
    sst = F.var_pop(o) * F.count("*")
    aggs = [F.count("*").alias("n"), F.when(enough & (sst > 0), 1 - F.sum(e * e) / sst).alias("r2"), F.when(enough, F.sqrt(F.avg(e * e))).alias("rmse"), F.when(enough, F.avg(F.abs(e))).alias("mae"), F.when(enough, F.avg(e)).alias("bias")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def transfer_metrics(df: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    """regression_metrics, pearson, spearman and the r2 after a least-squares line."""
    base = regression_metrics(df, obs, pred)
    line = df.agg(F.corr(obs, pred).alias("pearson"), F.regr_r2(obs, pred).alias("r2_corrected"))
    rank = spearman(df, obs, pred).select(F.col("rho").alias("spearman"))
    return base.join(F.broadcast(line)).join(F.broadcast(rank))  # one row each


def interval_calibration(df: DataFrame, obs: str, lo: str, hi: str, mid: str, nominal: float = 0.9) -> DataFrame:
    o, e = F.col(obs), F.col(obs) - F.col(mid)
    inside = F.avg(F.when(o.between(F.col(lo), F.col(hi)), 1.0).otherwise(0.0))
    return df.agg(inside.alias("coverage"), (inside - nominal).alias("gap"), F.avg(F.col(hi) - F.col(lo)).alias("width"), F.avg(F.greatest(e * 0.5, e * -0.5)).alias("pinball"))


def cv_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    return folds.agg(*[x for m in metrics for x in (F.avg(m).alias(m + "_mean"), F.stddev_pop(m).alias(m + "_std"))])


def confusion(df: DataFrame, n_classes: int, pred: str = "pred", target: str = "target") -> DataFrame:
    """tp, fp, fn of each class, over rows with a target: one pass of sums, unpivoted."""
    rows = df.where(F.col(target).isNotNull())
    hit = lambda a: F.sum(F.when(a, 1).otherwise(0))
    sums = rows.agg(*[F.struct(F.lit(k).alias("class"), hit((F.col(pred) == k) & (F.col(target) == k)).alias("tp"), hit((F.col(pred) == k) & (F.col(target) != k)).alias("fp"), hit((F.col(pred) != k) & (F.col(target) == k)).alias("fn")).alias(f"c{k}") for k in range(n_classes)])
    return sums.select(F.inline(F.array(*[F.col(f"c{k}") for k in range(n_classes)])))


def per_class_scores(df: DataFrame, n_classes: int, pred: str = "pred", target: str = "target") -> DataFrame:
    """iou (NULL for an empty union) and f1 (0 for a zero denominator) of each class."""
    c = confusion(df, n_classes, pred, target)
    tp, union = F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.col("tp") * 2 + F.col("fp") + F.col("fn")
    return c.select("class", F.when(union > 0, tp / union).alias("iou"), F.when(f1 > 0, tp * 2 / f1).otherwise(0.0).alias("f1"))


def mean_iou(df: DataFrame, n_classes: int, pred: str = "pred", target: str = "target") -> DataFrame:
    return per_class_scores(df, n_classes, pred, target).agg(F.avg("iou").alias("miou"))


def report(df: DataFrame, wet: str, dry: str, index: str, wetness: str, slope: str, checkpoint, n: int = 4) -> DataFrame:
    """name, value: rank correlations, rank tests by quantile strata of wetness and slope, statistics of both seasons by strata of
    wetness, and the index's summary. df's rows have all five values; with their strata they are read several times, so
    `checkpoint` cuts the plan there."""
    x = checkpoint(quantile_strata(quantile_strata(df.select(wet, dry, index, wetness, slope), wetness, n, "_t"), slope, n, "_s"))
    row = lambda d, name, v, digits=6: d.select(name.alias("name"), (F.round(F.col(v).cast("double"), digits) + F.lit(0.0)).alias("value"))
    parts = [row(spearman(x, a, b), F.lit(f"spearman_{a}_{b}"), "rho") for a, b in ((index, wetness), (index, slope), (wet, dry), (wet, wetness))]
    parts += [row(kruskal_wallis(x, v, g), F.lit(f"kruskal_{v}_by_{by}"), "h", 4) for v, g, by in ((wet, "_t", wetness), (dry, "_t", wetness), (index, "_t", wetness), (wet, "_s", slope))]
    for v in (wet, dry):
        s = stratum_stats(x, v, "_t")
        parts.append(_unpivoted(s, [c for c in s.columns if c != "_t"], lambda c, v=v: F.concat(F.lit(f"{v}_{c}_"), F.col("_t").cast("string"))))
    s = change_summary(x, index).drop("n")
    parts.append(_unpivoted(s, s.columns, lambda c: F.lit(f"{index}_{c}")))
    return reduce(DataFrame.unionByName, parts)


def _unpivoted(df: DataFrame, columns: list[str], name) -> DataFrame:
    pairs = F.array(*[F.struct(name(c).alias("name"), (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias("value")) for c in columns])
    return df.select(F.inline(pairs))
