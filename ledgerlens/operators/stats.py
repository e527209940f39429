"""Statistics operators.

Moments come from one aggregation (Spark's ``skewness``/``kurtosis`` are the population forms,
trap T7); quantiles are exact and distributed (``exact_quantiles``); correlations use
``covar_pop / (stddev_pop * stddev_pop)`` over pairwise-complete rows because ``corr`` raises
on a constant column under ANSI mode (T1); p-values come from the one-row t UDF (T8).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import qcol, safe_div
from ..functions.pvalues import t_pvalue
from ..session import materialize
from ._common import nonnull, one_row
from .quantiles import exact_quantiles


def _num(col: str) -> Column:
    return qcol(col).cast("double")


def _clean(df: DataFrame, col: str) -> DataFrame:
    """Numeric values only (``pd.to_numeric(errors='coerce').dropna()``)."""
    v = qcol(col).cast("string").try_cast("double") if dict(df.dtypes)[col] == "string" else _num(col)
    return df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def adjusted_skew(g1: Column, n: Column) -> Column:
    """pandas ``Series.skew``: G1 = g1 * sqrt(n(n-1)) / (n-2), n > 2."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


# ---------------------------------------------------------------- G01 - G04

def describe_measure(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, population std / variance, population skewness, excess kurtosis
    (null below 3 rows)."""
    v = _clean(df, col)
    mom = v.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                F.var_pop("v").alias("variance"), F.skewness("v").alias("skewness"),
                F.kurtosis("v").alias("kurtosis"))
    med = exact_quantiles(v, ["v"], [0.5]).agg(F.max("value").alias("median"))
    out = mom.crossJoin(one_row(med))
    ok = F.col("n") >= 3
    return out.select("n", *[F.when(ok, F.col(c)).alias(c) for c in
                             ("mean", "median", "std", "variance", "skewness", "kurtosis")])


def zscore_outliers(df: DataFrame, col: str, z: float = 2.0, top: int | None = 10,
                    keep: list[str] | None = None) -> DataFrame:
    """Rows with |population z| > z, largest |z| first (top ``top``), with the total
    outlier count on every row."""
    stats = df.agg(F.avg(_num(col)).alias("_mu"), F.stddev_pop(_num(col)).alias("_sd"))
    keep = keep or df.columns
    zc = F.try_divide(F.abs(_num(col) - F.col("_mu")), F.col("_sd"))
    flagged = (df.crossJoin(one_row(stats)).select(*[qcol(k) for k in keep], zc.alias("z_score"))
               .filter(F.col("z_score") > z))
    count = flagged.agg(F.count(F.lit(1)).alias("outlier_count"))
    ordered = flagged.orderBy(F.col("z_score").desc(), *[qcol(k).asc() for k in keep])
    if top:
        ordered = ordered.limit(top)
    return ordered.crossJoin(one_row(count))


def top_anomaly(df: DataFrame, col: str = "revenue", z: float = 3.0,
                keep: tuple[str, ...] = ("product", "city", "category")) -> DataFrame:
    """The single most extreme row by |z| when |z| >= z and there are >= 5 rows;
    direction = spike above the mean, drop below. Empty result otherwise."""
    stats = df.agg(F.avg(_num(col)).alias("_mu"), F.stddev_pop(_num(col)).alias("_sd"),
                   F.count(F.lit(1)).alias("_n"))
    zc = F.try_divide(F.abs(_num(col) - F.col("_mu")), F.col("_sd"))
    rows = df.crossJoin(one_row(stats)).select(
        *[qcol(k) for k in keep], _num(col).alias(col), zc.alias("z"), "_mu", "_n")
    best = rows.filter((F.col("_n") >= 5) & (F.col("z") >= z)) \
        .orderBy(F.col("z").desc(), *[qcol(k).asc() for k in keep]).limit(1)
    return best.withColumn("direction", F.when(F.col(col) > F.col("_mu"), "spike").otherwise("drop")) \
        .drop("_mu", "_n")


def normality(df: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """G04 (re-aimed from Shapiro-Wilk on the first 5,000 rows): Jarque-Bera on all rows,
    JB = n/6 (S^2 + K^2/4) with population skewness S and excess kurtosis K;
    p = exp(-JB/2) (chi-square, 2 dof)."""
    v = _clean(df, col)
    m = v.agg(F.count("v").alias("n"), F.skewness("v").alias("skewness"),
              F.kurtosis("v").alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return (m.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2.0))
            .withColumn("is_normal", F.col("p_value") > alpha))


# ---------------------------------------------------------------- G05, G06, G15, G16

def _pair_aggs(x: str, y: str, tag: str) -> list[Column]:
    both = _num(x).isNotNull() & _num(y).isNotNull() & ~F.isnan(_num(x)) & ~F.isnan(_num(y))
    xv, yv = F.when(both, _num(x)), F.when(both, _num(y))
    return [F.covar_pop(xv, yv).alias(f"{tag}_cov"), F.stddev_pop(xv).alias(f"{tag}_sx"),
            F.stddev_pop(yv).alias(f"{tag}_sy"), F.count(xv).alias(f"{tag}_n")]


def correlation_matrix(df: DataFrame, cols: list[str], wide: bool = False) -> DataFrame:
    """Pearson r for every pair, pairwise-complete, all pairs in ONE aggregation.

    Long form (x, y, r, n) including the diagonal (r = 1 unless constant); ``wide=True`` pivots
    to one row per x. Constant columns give null r (pandas NaN). A first, cheap count pass finds
    the columns without missing values: pairs of such columns use the plain ``covar_pop`` and the
    shared per-column ``stddev_pop`` (small generated code, one pass); only pairs touching a
    column with gaps pay for the pairwise-complete masks.
    """
    vals = df.select(*[F.when(F.isnan(_num(c)), None).otherwise(_num(c)).alias(f"c{j}") for j, c in enumerate(cols)])
    counts = vals.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"c{j}").alias(f"n{j}") for j in range(len(cols))]).first()
    full = {j for j in range(len(cols)) if counts[f"n{j}"] == counts["_n"]}
    pairs = list(combinations(range(len(cols)), 2))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for j in range(len(cols)):
        aggs += [F.stddev_pop(f"c{j}").alias(f"d{j}_sx"), F.count(f"c{j}").alias(f"d{j}_n")]
    for i, (a, b) in enumerate(pairs):
        if a in full and b in full:
            aggs.append(F.covar_pop(f"c{a}", f"c{b}").alias(f"p{i}_cov"))
        else:
            xa = F.when(F.col(f"c{b}").isNotNull(), F.col(f"c{a}"))
            xb = F.when(F.col(f"c{a}").isNotNull(), F.col(f"c{b}"))
            aggs += [F.covar_pop(xa, xb).alias(f"p{i}_cov"), F.stddev_pop(xa).alias(f"p{i}_sx"),
                     F.stddev_pop(xb).alias(f"p{i}_sy"), F.count(xa).alias(f"p{i}_n")]
    one = vals.agg(*aggs)
    structs = []
    for i, (a, b) in enumerate(pairs):
        shared = a in full and b in full
        sx = F.col(f"d{a}_sx") if shared else F.col(f"p{i}_sx")
        sy = F.col(f"d{b}_sx") if shared else F.col(f"p{i}_sy")
        n = F.col("_rows") if shared else F.col(f"p{i}_n")
        r = F.when(sx > 0, F.when(sy > 0, F.try_divide(F.col(f"p{i}_cov"), sx * sy)))
        for x, y in ((cols[a], cols[b]), (cols[b], cols[a])):
            structs.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r.alias("r"), n.alias("n")))
    for j, x in enumerate(cols):
        r = F.when(F.col(f"d{j}_sx") > 0, F.lit(1.0))
        structs.append(F.struct(F.lit(x).alias("x"), F.lit(x).alias("y"), r.alias("r"),
                                F.col(f"d{j}_n").alias("n")))
    long = one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    if not wide:
        return long
    return long.groupBy("x").pivot("y", cols).agg(F.first("r"))


def strength_word(r: Column, cuts=(0.3, 0.5), words=("weak", "moderate", "strong")) -> Column:
    a = F.abs(r)
    return F.when(a < cuts[0], words[0]).when(a < cuts[1], words[1]).otherwise(words[2])


def pearson_test(df: DataFrame, x: str, y: str, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """R, n, t = r sqrt((n-2)/(1-r^2)), dof = n-2, two-sided p; strength words at .3/.5."""
    one = df.agg(*_pair_aggs(x, y, "q"))
    r = F.try_divide(F.col("q_cov"), F.col("q_sx") * F.col("q_sy"))
    out = one.select(r.alias("r"), F.col("q_n").alias("n"))
    out = out.withColumn("dof", F.col("n") - 2)
    t = F.when(F.abs(F.col("r")) < 1, F.col("r") * F.sqrt(F.try_divide(F.col("dof").cast("double"),
                                                                      1 - F.col("r") ** 2)))
    out = out.withColumn("t", t).withColumn("strength", strength_word(F.col("r")))
    if with_p:
        p = F.when(F.abs(F.col("r")) >= 1, F.lit(0.0)).otherwise(t_pvalue(F.col("t"), F.col("dof")))
        out = out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)
    return out


def relationship(df: DataFrame, x: str, y: str) -> DataFrame:
    """R (0 when undefined) with strength words at .15/.35/.6 and direction; needs 5
    complete pairs."""
    one = df.agg(*_pair_aggs(x, y, "q"))
    r = F.coalesce(F.try_divide(F.col("q_cov"), F.col("q_sx") * F.col("q_sy")), F.lit(0.0))
    a = F.abs(F.col("r"))
    strength = (F.when(a < 0.15, "no clear").when(a < 0.35, "a weak").when(a < 0.6, "a moderate")
                .otherwise("a strong"))
    direction = F.when(a < 0.15, "").when(F.col("r") > 0, "positive").otherwise("negative")
    out = one.select(F.col("q_n").alias("n"), r.alias("r"))
    return (out.withColumn("strength", strength).withColumn("direction", direction)
            .withColumn("enough_data", F.col("n") >= 5))


def strongest_pair(df: DataFrame, cols: list[str], min_cols: int = 3) -> DataFrame:
    """The off-diagonal pair with the largest |r| (first pair in column order on ties);
    empty when fewer than ``min_cols`` columns or all r are 0/undefined."""
    if len(cols) < min_cols:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    order = {c: i for i, c in enumerate(cols)}
    long = correlation_matrix(df, cols).filter(F.col("x") != F.col("y"))
    ix = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    long = long.withColumn("_i", ix[F.col("x")]).withColumn("_j", ix[F.col("y")])
    best = long.filter(F.col("r").isNotNull() & (F.abs("r") > 0)) \
        .orderBy(F.abs("r").desc(), "_i", "_j").limit(1)
    return best.select("x", "y", "r")


# ---------------------------------------------------------------- G07

def two_sample_ttest(df: DataFrame, group: str, value: str, a: str = "Yes", b: str = "No",
                     alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """Student's two-sample t-test with pooled variance (scipy ``ttest_ind`` default);
    defined when both groups have more than one row."""
    v = _num(value)
    ga, gb = F.col(group) == a, F.col(group) == b
    one = df.agg(F.count(F.when(ga, v)).alias("n_a"), F.avg(F.when(ga, v)).alias("mean_a"),
                 F.var_samp(F.when(ga, v)).alias("var_a"), F.count(F.when(gb, v)).alias("n_b"),
                 F.avg(F.when(gb, v)).alias("mean_b"), F.var_samp(F.when(gb, v)).alias("var_b"))
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / dof
    se = F.sqrt(pooled * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    ok = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    out = one.withColumn("dof", dof).withColumn(
        "t", F.when(ok, F.try_divide(F.col("mean_a") - F.col("mean_b"), se)))
    if with_p:
        out = out.withColumn("p_value", F.when(ok, F.coalesce(t_pvalue(F.col("t"), F.col("dof")),
                                                               F.lit(1.0))).otherwise(F.lit(1.0)))
        out = out.withColumn("significant", F.col("p_value") < alpha)
    return out


# ---------------------------------------------------------------- G08 - G14, G17

def boxplot_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """N, min, max, q1, median, q3, mean, sample std / variance, IQR, 1.5 IQR fences,
    outlier count and %, adjusted skewness. With ``by``: one row per group (G11 building block)."""
    v = _num(col)
    base = df.select(*([F.col(by)] if by else []), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    if by:
        base = base.filter(F.col(by).isNotNull())
    keys = [by] if by else []
    mom = (base.groupBy(*keys) if keys else base.groupBy()).agg(
        F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.var_samp("v").alias("variance"),
        F.skewness("v").alias("_g1"))
    q = exact_quantiles(base, ["v"], [0.25, 0.5, 0.75], by=by)
    qw = (q.groupBy(*keys) if keys else q.groupBy()).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    st = mom.join(qw, keys) if keys else mom.crossJoin(one_row(qw))
    st = (st.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr"))
          .withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr"))
          .withColumn("std", F.when(F.col("n") > 1, F.col("std")).otherwise(0.0))
          .withColumn("variance", F.when(F.col("n") > 1, F.col("variance")).otherwise(0.0))
          .withColumn("skew", F.coalesce(adjusted_skew(F.col("_g1"), F.col("n").cast("double")), F.lit(0.0)))
          .drop("_g1"))
    fences = st.select(*keys, "lo_fence", "hi_fence")
    if keys:
        fences = materialize(fences, "fences")  # written, so that the planner knows its size
    joined = base.join(fences, keys) if keys else base.crossJoin(one_row(fences))
    outl = (joined.groupBy(*keys) if keys else joined.groupBy()).agg(
        F.count(F.when((F.col("v") < F.col("lo_fence")) | (F.col("v") > F.col("hi_fence")), 1))
        .alias("outlier_count"))
    st = st.join(outl, keys) if keys else st.crossJoin(one_row(outl))
    return st.withColumn("outlier_pct", safe_div(F.col("outlier_count") * 100.0, F.col("n")))


def iqr_outliers(df: DataFrame, col: str) -> DataFrame:
    """The rows outside q1 - 1.5 IQR .. q3 + 1.5 IQR (fences from exact quartiles)."""
    base = df.filter(_num(col).isNotNull() & ~F.isnan(_num(col)))
    q = quantile_fences(base, col)
    j = base.crossJoin(one_row(q))
    return j.filter((_num(col) < F.col("_lo")) | (_num(col) > F.col("_hi"))).drop("_lo", "_hi")


def quantile_fences(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, [col], [0.25, 0.75]).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("_q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    return q.select((F.col("_q1") - k * iqr).alias("_lo"), (F.col("_q3") + k * iqr).alias("_hi"))


def most_variable_group(df: DataFrame, dim: str, col: str) -> DataFrame:
    """The group with the largest sample standard deviation (smallest key on ties)."""
    g = nonnull(df, dim).groupBy(dim).agg(F.stddev_samp(_num(col)).alias("std")) \
        .filter(F.col("std").isNotNull() & ~F.isnan("std"))
    return g.agg(F.min_by(dim, F.struct(-F.col("std"), F.col(dim))).alias(dim), F.max("std").alias("std"))


def grouped_boxplot(df: DataFrame, dim: str, col: str, k: int = 15) -> DataFrame:
    """Box statistics for the k groups with the most non-null values."""
    base = nonnull(df, dim)
    counts = base.groupBy(dim).agg(F.count(_num(col)).alias("_cnt"))
    top = counts.orderBy(F.col("_cnt").desc(), F.col(dim).asc()).limit(k).select(dim)
    kept = base.join(F.broadcast(top), dim, "left_semi")
    return boxplot_stats(kept, col, by=dim)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max, last bin closed; all bins present (0 counts
    included); one row per bin with its edges."""
    v = _num(col)
    base = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rng = base.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = base.crossJoin(one_row(rng))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int"), F.lit(bins - 1)))
    counts = j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    out = spine.join(counts, "bin", "left").na.fill(0, ["count"])
    w = (F.col("hi") - F.col("lo")) / bins
    return out.select("bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                      F.when(F.col("bin") == bins - 1, F.col("hi"))
                      .otherwise(F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"),
                      F.col("count").cast("long").alias("count")).orderBy("bin")


def numeric_distribution(df: DataFrame, col: str, stats: DataFrame | None = None) -> DataFrame:
    """q1, median, q3 and the adjusted skewness with its shape word (|skew| < .5
    symmetric); needs >= 5 values. ``stats``: precomputed G08 row to reuse."""
    st = stats if stats is not None else boxplot_stats(df, col)
    shape = (F.when(F.abs("skew") < 0.5, "fairly symmetric").when(F.col("skew") >= 0.5, "right-skewed")
             .otherwise("left-skewed"))
    return st.select("n", "q1", "median", "q3", "skew", shape.alias("shape"),
                     (F.col("n") >= 5).alias("enough_data"))


def numeric_spread(df: DataFrame, col: str, stats: DataFrame | None = None) -> DataFrame:
    """Median, q1, q3 and the 1.5 IQR outlier count; needs >= 5 values."""
    st = stats if stats is not None else boxplot_stats(df, col)
    return st.select("n", "median", "q1", "q3", "outlier_count", (F.col("n") >= 5).alias("enough_data"))


def top_categories_with_other(df: DataFrame, col: str, k: int = 6) -> DataFrame:
    """Value counts; with more than k values the first k-1 are kept and the rest are summed
    into 'Other' (one regroup after a per-value count)."""
    g = nonnull(df, col).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    n_vals = g.agg(F.count(F.lit(1)).alias("_nv"))
    top = g.orderBy(F.col("count").desc(), F.col(col).asc()).limit(k - 1).withColumn("_keep", F.lit(True))
    j = g.join(F.broadcast(top.select(col, "_keep")), col, "left").crossJoin(one_row(n_vals))
    label = F.when(F.col("_keep") | (F.col("_nv") <= k), F.col(col).cast("string")).otherwise(F.lit("Other"))
    out = j.groupBy(label.alias(col)).agg(F.sum("count").alias("count"))
    total = out.agg(F.sum("count").alias("_t"))
    return out.crossJoin(one_row(total)).withColumn("share_pct", F.col("count") * 100.0 / F.col("_t")).drop("_t")


# Preferred measure and grouping columns of the distribution views.
PREFERRED_MEASURES = ["Total Revenue", "Profit", "Profit Margin", "Orders", "Discount", "Original Price",
                      "Current Price", "Delivery Time", "Delivery Cost"]
PREFERRED_GROUPERS = ["City", "Category", "Product Name", "Influencer Active", "Delivery Partner", "Price Tier",
                      "Customer Segment"]


def numeric_columns(df: DataFrame, preferred: list[str] | None = None) -> list[str]:
    """Preferred measures that exist, then the other numeric columns in table order."""
    pref = [c for c in (preferred or PREFERRED_MEASURES) if c in df.columns]
    nums = [f.name for f in df.schema.fields if f.dataType.typeName() in
            ("integer", "long", "double", "float", "short", "byte", "decimal")]
    return pref + [c for c in nums if c not in pref]


def group_columns(df: DataFrame, preferred: list[str] | None = None) -> list[str]:
    """Preferred grouping columns that exist and have more than one distinct value (one
    aggregation for all candidates)."""
    cands = [c for c in (preferred or PREFERRED_GROUPERS) if c in df.columns]
    if not cands:
        return []
    row = df.agg(*[F.countDistinct(qcol(c)).alias(f"_{i}") for i, c in enumerate(cands)]).first()
    return [c for i, c in enumerate(cands) if row[f"_{i}"] > 1]
