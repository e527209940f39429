"""Aggregation operators.

Every operator is one ``groupBy``/``agg`` (partial aggregation on the map side, one shuffle of
group-sized rows) or a ``GROUPING SETS`` pass that fuses several group-bys into one scan.
Rankings over the grouped result use ``positions`` (distributed) or ``orderBy().limit``
(TakeOrderedAndProject), never a single-partition window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ._common import SALES, SalesCols, dmean, dsum, nonnull, one_row, positions, ranked_desc


# ---------------------------------------------------------------- E01

def kpis(df: DataFrame, cols: SalesCols = SALES) -> DataFrame:
    """Headline KPIs in one scan.

    ``GROUPING SETS ((), (category), (city), (product))`` computes the totals and the three
    leader rankings in one pass; a second aggregation over the (group-sized) result picks the
    leaders with ``min_by`` on (-value, name), i.e. highest value, smallest name on ties.
    """
    k = cols
    base = df.select(
        F.col(k.category).alias("_cat"), F.col(k.city).alias("_city"),
        F.col(k.product).alias("_prod"), F.col(k.revenue).alias("_rev"),
        F.col(k.profit).alias("_profit"), F.col(k.orders).alias("_orders"),
        F.col(k.price).alias("_price"))
    g = base.groupingSets([[], ["_cat"], ["_city"], ["_prod"]], "_cat", "_city", "_prod").agg(
        F.grouping_id().alias("gid"), F.sum("_rev").alias("rev"), F.sum("_profit").alias("profit"),
        F.sum("_orders").alias("orders"), F.avg("_price").alias("avg_price"),
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_rev").cast("double")).alias("rev_mean"),
        F.stddev_samp(F.col("_rev").cast("double")).alias("rev_std"))
    # gid bits: _cat=4, _city=2, _prod=1 (1 = aggregated away)
    tot, cat_set, city_set, prod_set = 7, 3, 5, 6
    def pick(gid: int, key: str, what: Column) -> Column:
        keep = (F.col("gid") == gid) & F.col(key).isNotNull()
        return F.min_by(F.when(keep, what), F.when(keep, F.struct(-F.col("rev"), F.col(key))))
    tot_only = F.col("gid") == tot
    out = g.agg(
        dsum(F.when(tot_only, F.col("rev"))).alias("total_revenue"),
        dsum(F.when(tot_only, F.col("profit"))).alias("total_profit"),
        F.coalesce(F.sum(F.when(tot_only, F.col("orders"))), F.lit(0)).cast("long").alias("total_orders"),
        F.max(F.when(tot_only, F.col("avg_price"))).alias("avg_price"),
        F.max(F.when(tot_only, F.col("n"))).cast("long").alias("record_count"),
        F.max(F.when(tot_only, F.col("rev_mean"))).alias("revenue_mean"),
        F.max(F.when(tot_only, F.col("rev_std"))).alias("revenue_std"),
        pick(cat_set, "_cat", F.col("_cat")).alias("top_category"),
        pick(cat_set, "_cat", F.col("rev")).cast("double").alias("top_category_rev"),
        pick(city_set, "_city", F.col("_city")).alias("top_city"),
        pick(city_set, "_city", F.col("rev")).cast("double").alias("top_city_rev"),
        pick(prod_set, "_prod", F.col("_prod")).alias("top_product"),
        pick(prod_set, "_prod", F.col("rev")).cast("double").alias("top_product_rev"),
    )
    return out.select(
        "*",
        safe_div(F.col("total_profit") * 100.0, F.col("total_revenue")).alias("profit_margin"),
        safe_div(F.col("total_revenue"), F.col("total_orders")).alias("aov"))


# ---------------------------------------------------------------- E02, E03

def revenue_by(df: DataFrame, dim: str, measure: str = "revenue", name: str | None = None) -> DataFrame:
    """Sum of a measure per dimension value (null keys dropped), descending then key."""
    name = name or measure
    agg = nonnull(df, dim).groupBy(dim).agg(dsum(measure).alias(name))
    return agg.orderBy(*ranked_desc(name, dim))


def top_n(df: DataFrame, dim: str, measure: str = "revenue", n: int = 10,
          name: str | None = None) -> DataFrame:
    """The n largest groups (TakeOrderedAndProject: per-partition top-n, then merge)."""
    name = name or measure
    agg = nonnull(df, dim).groupBy(dim).agg(dsum(measure).alias(name))
    return agg.orderBy(*ranked_desc(name, dim)).limit(n)


def bottom_n(df: DataFrame, dim: str, measure: str = "revenue", n: int = 5,
             name: str | None = None) -> DataFrame:
    """Tail of the descending ranking, re-sorted ascending (report's bottom 5)."""
    name = name or measure
    agg = nonnull(df, dim).groupBy(dim).agg(dsum(measure).alias(name))
    # tail of (value desc, key asc) == head of (value asc, key desc)
    tail = agg.orderBy(F.col(name).asc_nulls_first(), F.col(dim).desc_nulls_first()).limit(n)
    return tail.orderBy(F.col(name).asc(), F.col(dim).desc())


# ---------------------------------------------------------------- E04

def pivot_sum(df: DataFrame, row: str, col: str, measure: str = "revenue",
              values: list | None = None) -> DataFrame:
    """Row x col heat map of sums, missing cells 0, null keys dropped.

    Pass ``values`` to skip the distinct-values job; otherwise the sorted distinct values of
    ``col`` are fetched first (one small aggregation; the pivot width is that count).
    """
    base = nonnull(df, row, col)
    if values is None:
        values = [r[0] for r in base.select(col).distinct().orderBy(col).collect()]
    out = base.groupBy(row).pivot(col, values).agg(F.sum(measure).cast("double"))
    return out.na.fill(0.0, subset=[str(v) for v in values]).orderBy(row)


# ---------------------------------------------------------------- E05 - E07, E09, E10

def promo_impact(df: DataFrame, dim: str = "category", flag: str = "promo",
                 measure: str = "revenue") -> DataFrame:
    """Mean revenue per (dimension, promo flag)."""
    return (nonnull(df, dim, flag).groupBy(dim, flag)
            .agg(dmean(measure).alias("avg_revenue")).orderBy(dim, flag))


def discount_curve(df: DataFrame, cols: SalesCols = SALES) -> DataFrame:
    """Per discount level mean revenue, mean orders, count; flags the sweet spot
    (highest mean revenue, lowest discount on ties)."""
    k = cols
    g = (nonnull(df, k.discount).groupBy(k.discount)
         .agg(dmean(k.revenue).alias("avg_revenue"), dmean(k.orders).alias("avg_orders"),
              F.count(k.orders).alias("count")))
    best = g.agg(F.min_by(k.discount, F.struct(-F.col("avg_revenue"), F.col(k.discount)))
                 .alias("_best"))
    return (g.crossJoin(one_row(best))
            .withColumn("is_sweet_spot", F.col(k.discount) == F.col("_best")).drop("_best")
            .orderBy(k.discount))


# Price-tier edges (right-closed) and labels of the sales dashboards.
PRICE_TIER_EDGES = [0, 60, 100, 140, 180]
PRICE_TIER_LABELS = ["₹20–60", "₹61–100", "₹101–140", "₹141–180", "₹181+"]


def add_price_tier(df: DataFrame, price: str = "current_price", edges=None, labels=None,
                   name: str = "price_tier") -> DataFrame:
    """``pd.cut`` with right-closed bins (e0,e1], (e1,e2], ..., (e_last, inf); <= e0 -> null.
    Adds the label and its ordinal (``<name>_ord``) for ordering."""
    edges = edges or PRICE_TIER_EDGES
    labels = labels or PRICE_TIER_LABELS
    p = F.col(price)
    lab, ordv = None, None
    for i, lo in enumerate(edges):
        hi = edges[i + 1] if i + 1 < len(edges) else None
        cond = (p > lo) if hi is None else ((p > lo) & (p <= hi))
        lab = F.when(cond, F.lit(labels[i])) if lab is None else lab.when(cond, F.lit(labels[i]))
        ordv = F.when(cond, F.lit(i)) if ordv is None else ordv.when(cond, F.lit(i))
    return df.withColumn(name, lab).withColumn(f"{name}_ord", ordv)


def revenue_by_tier(df: DataFrame, price: str = "current_price", measure: str = "revenue") -> DataFrame:
    """Revenue per occurring price tier, in tier order."""
    t = add_price_tier(df, price)
    return (t.filter(F.col("price_tier").isNotNull())
            .groupBy("price_tier", "price_tier_ord").agg(dsum(measure).alias("revenue"))
            .orderBy("price_tier_ord").withColumnRenamed("price_tier", "tier"))


def promo_ranking(df: DataFrame, cols: SalesCols = SALES) -> DataFrame:
    """Orders, revenue and AOV for promo Yes / No."""
    k = cols
    return (df.filter(F.col(k.promo).isin("Yes", "No")).groupBy(k.promo)
            .agg(F.sum(k.orders).cast("long").alias("orders"), dsum(k.revenue).alias("revenue"))
            .withColumn("aov", safe_div("revenue", "orders")).orderBy(k.promo))


def dimension_performance(df: DataFrame, dim: str, sort_by: str = "revenue",
                          cols: SalesCols = SALES) -> DataFrame:
    """Revenue, profit, orders and weighted margin (sum profit / sum revenue) per group."""
    k = cols
    g = (nonnull(df, dim).groupBy(dim)
         .agg(dsum(k.revenue).alias("revenue"), dsum(k.profit).alias("profit"),
              F.sum(k.orders).cast("long").alias("orders")))
    g = g.withColumn("margin", F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100.0)
                     .otherwise(F.lit(0.0)))
    return g.orderBy(*ranked_desc(sort_by, dim))


def product_performance(df: DataFrame, metric: str = "revenue", n: int = 10,
                        cols: SalesCols = SALES) -> DataFrame:
    """E10 by product plus its modal category (ties -> smallest), top n by ``metric``.
    The mode is a two-stage aggregation (count per (product, category), then ``min_by``), so
    no product's category values are held in one buffer."""
    k = cols
    base = nonnull(df, k.product)
    g = (base.groupBy(k.product)
         .agg(dsum(k.revenue).alias("revenue"), dsum(k.profit).alias("profit"),
              F.sum(k.orders).cast("long").alias("orders")))
    cnt = base.filter(F.col(k.category).isNotNull()).groupBy(k.product, k.category).agg(F.count(F.lit(1)).alias("_c"))
    mode = cnt.groupBy(k.product).agg(F.min_by(k.category, F.struct(-F.col("_c"), F.col(k.category))).alias("category"))
    g = g.join(mode, k.product, "left")
    g = g.withColumn("margin", F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100.0)
                     .otherwise(F.lit(0.0)))
    return g.orderBy(*ranked_desc(metric, k.product)).limit(n)


# ---------------------------------------------------------------- E12, E13

def location_performance(df: DataFrame, geo: DataFrame | None = None, metric: str = "revenue",
                         cols: SalesCols = SALES) -> DataFrame:
    """Per city sums + mean of row margins, coordinates looked up from ``geo``
    (city, lat, lon; left join), rank on ``metric``, share of the non-negative total and the
    best-vs-weakest gap over mapped cities."""
    k = cols
    g = (nonnull(df, k.city).groupBy(k.city)
         .agg(dsum(k.revenue).alias("revenue"), F.sum(k.orders).cast("long").alias("orders"),
              dsum(k.profit).alias("profit"), F.avg(k.margin).alias("avg_row_margin_pct")))
    if geo is not None:
        # A coordinate table has one row per known place; the planner/AQE chooses the join side.
        g = g.join(geo.select(F.col(geo.columns[0]).alias(k.city), "lat", "lon"), k.city, "left")
    else:
        g = g.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double"))
    g = g.withColumn("mapped", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    stats = (g.filter("mapped").agg(
        F.sum(F.greatest(F.col(metric), F.lit(0.0))).alias("_pos_total"),
        F.max(metric).alias("_best"), F.min(metric).alias("_worst")))
    stats = stats.withColumn(
        "gap_pct", F.when(F.col("_worst") > 0,
                          (F.col("_best") - F.col("_worst")) / F.col("_worst") * 100.0).otherwise(0.0))
    ranked = positions(g.filter("mapped"), ranked_desc(metric, k.city), name="rank")
    out = (g.join(ranked.select(k.city, "rank"), k.city, "left").crossJoin(one_row(stats))
           .withColumn("share_pct", F.when(F.col("mapped"), safe_div(
               F.greatest(F.col(metric), F.lit(0.0)) * 100.0, F.col("_pos_total"))))
           .drop("_pos_total", "_best", "_worst"))
    return out


def city_operations(df: DataFrame, cols: SalesCols = SALES) -> DataFrame:
    """Orders and revenue by city, plus distinct cities / products and line count."""
    k = cols
    by_city = (nonnull(df, k.city).groupBy(k.city)
               .agg(F.sum(k.orders).cast("long").alias("orders"), dsum(k.revenue).alias("revenue")))
    totals = df.agg(F.countDistinct(k.city).alias("n_cities"),
                    F.countDistinct(k.product).alias("n_products"),
                    F.count(F.lit(1)).alias("n_lines"))
    return by_city.crossJoin(one_row(totals)).orderBy(*ranked_desc("orders", k.city))


# ---------------------------------------------------------------- E14, E15, E16

def movers(df: DataFrame, k_: int = 8, cols: SalesCols = SALES) -> DataFrame:
    """Fast movers = top k products by orders; slow movers = bottom k, ascending."""
    k = cols
    g = nonnull(df, k.product).groupBy(k.product).agg(F.sum(k.orders).cast("long").alias("orders"))
    fast = (g.orderBy(F.col("orders").desc(), F.col(k.product).asc()).limit(k_)
            .withColumn("kind", F.lit("fast")))
    slow = (g.orderBy(F.col("orders").asc(), F.col(k.product).desc()).limit(k_)
            .withColumn("kind", F.lit("slow")))
    return fast.unionByName(slow)


_AGG = {
    "sum": lambda x: F.sum(x), "mean": lambda x: F.avg(x), "average": lambda x: F.avg(x),
    "count": lambda x: F.count(x), "count_distinct": lambda x: F.countDistinct(x),
    "min": lambda x: F.min(x), "max": lambda x: F.max(x),
}


@dataclass(frozen=True)
class AggSpec:
    """E15 configuration: what the reference's chart config describes."""
    metric: str
    dimension: str | None = None
    aggregation: str = "sum"
    top_n: int | None = 10
    sort: str = "desc"


def aggregate(df: DataFrame, spec: AggSpec) -> DataFrame:
    """One ``groupBy().agg`` for any dimension/none x sum/mean/count/count_distinct/min/max,
    sorted, optionally limited; medians are exact and distributed (``exact_quantiles``)."""
    m = F.col(spec.metric)
    if spec.aggregation == "median":
        from .quantiles import exact_quantiles
        if not spec.dimension:
            q = exact_quantiles(df, [spec.metric], [0.5])
            return q.select(F.lit(spec.metric).alias("label"), "value")
        g = exact_quantiles(nonnull(df, spec.dimension), [spec.metric], [0.5], by=spec.dimension) \
            .select(spec.dimension, "value")
    else:
        fn = _AGG.get(spec.aggregation, _AGG["sum"])
        val = fn(m.cast("double") if spec.aggregation in ("mean", "average") else m)
        if spec.aggregation == "sum":
            val = val.cast("double")
        if not spec.dimension:
            return df.agg(val.alias("value")).select(F.lit(spec.metric).alias("label"), "value")
        g = nonnull(df, spec.dimension).groupBy(spec.dimension).agg(val.alias("value"))
    order = ([F.col("value").asc(), F.col(spec.dimension).asc()] if spec.sort == "asc"
             else ranked_desc("value", spec.dimension))
    g = g.orderBy(*order)
    return g.limit(spec.top_n) if spec.top_n else g


def aggregate_insight(series: DataFrame, label: str, value: str = "value",
                      ascending: bool = False) -> DataFrame:
    """Leader (first in the series order), its share of the total and distance from the
    mean, and the trailing item. One aggregation over the (group-sized) series."""
    lead_key = F.struct(F.col(value), F.col(label)) if ascending else F.struct(-F.col(value), F.col(label))
    trail_key = F.struct(-F.col(value), F.col(label).cast("string")) if ascending else \
        F.struct(F.col(value), F.col(label))
    out = series.agg(
        F.min_by(label, lead_key).alias("leader"), F.min_by(value, lead_key).alias("leader_value"),
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"),
        F.min_by(label, trail_key).alias("trailing"), F.min_by(value, trail_key).alias("trailing_value"))
    return out.select(
        "leader", F.col("leader_value").cast("double").alias("leader_value"),
        safe_div(F.col("leader_value") * 100.0, F.col("total")).alias("share_pct"),
        safe_div((F.col("leader_value") - F.col("mean")) * 100.0, F.col("mean")).alias("vs_avg_pct"),
        F.when(F.col("n") > 1, F.col("trailing")).alias("trailing"),
        F.when(F.col("n") > 1, F.col("trailing_value").cast("double")).alias("trailing_value"),
        F.col("n").alias("groups"))


# ---------------------------------------------------------------- E17, E18, E19

def measure_totals(df: DataFrame, measures: list[str]) -> DataFrame:
    """Sum and mean of every given measure from one wide aggregation, unpivoted."""
    aggs = []
    for m in measures:
        aggs += [F.sum(m).cast("double").alias(f"{m}__sum"), dmean(m).alias(f"{m}__mean")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{m}', `{m}__sum`, `{m}__mean`" for m in measures)
    return wide.selectExpr(f"stack({len(measures)}, {stack}) AS (measure, total, mean)")


def breakdowns(df: DataFrame, dims: list[str], measure: str, k: int = 12) -> DataFrame:
    """Top k groups of ``measure`` for each given dimension.

    One ``GROUPING SETS`` pass over the data, then a per-set ``row_number`` whose group limit is
    applied before the shuffle (WindowGroupLimit), so each set ships at most k rows per task.
    """
    sel = [F.col(d).cast("string").alias(f"_d{i}") for i, d in enumerate(dims)]
    base = df.select(*sel, F.col(measure).alias("_m"))
    g = base.groupingSets([[f"_d{i}"] for i in range(len(dims))], *[f"_d{i}" for i in range(len(dims))]) \
        .agg(F.sum("_m").cast("double").alias("value"), F.grouping_id().alias("_gid"))
    n = len(dims)
    dim_name = F.lit(None).cast("string")
    key = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid_i = (1 << n) - 1 - (1 << (n - 1 - i))
        dim_name = F.when(F.col("_gid") == gid_i, F.lit(d)).otherwise(dim_name)
        key = F.when(F.col("_gid") == gid_i, F.col(f"_d{i}")).otherwise(key)
    long = g.select(dim_name.alias("dimension"), key.alias("value_label"), "value") \
        .filter(F.col("value_label").isNotNull())
    w = Window.partitionBy("dimension").orderBy(F.col("value").desc(), F.col("value_label").asc())
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# Sets of the context bundle (E19): (name, key column) pairs; () is the grand total.
CONTEXT_SETS = ("category", "city", "product", "promo", "discount")


def context_bundle(df: DataFrame, cols: SalesCols = SALES) -> DataFrame:
    """Every shared group-by of the dashboard assistant in ONE grouping-sets job.

    Long form: (grouping, key, revenue, orders, profit, lines, avg_row_margin_pct,
    avg_discount, avg_revenue, avg_orders). ``context_totals`` derives the distinct counts and lifts.
    """
    k = cols
    keys = {"category": k.category, "city": k.city, "product": k.product, "promo": k.promo,
            "discount": k.discount}
    base = df.select(*[F.col(v).cast("string").alias(f"_{n}") for n, v in keys.items()],
                     F.col(k.revenue).alias("_rev"), F.col(k.orders).alias("_ord"),
                     F.col(k.profit).alias("_pro"), F.col(k.margin).alias("_mar"),
                     F.col(k.discount).alias("_dis"))
    names = list(keys)
    g = base.groupingSets([[]] + [[f"_{n}"] for n in names], *[f"_{n}" for n in names]).agg(
        F.grouping_id().alias("_gid"), dsum("_rev").alias("revenue"),
        F.sum("_ord").cast("long").alias("orders"), dsum("_pro").alias("profit"),
        F.count(F.lit(1)).alias("lines"), F.avg("_mar").alias("avg_row_margin_pct"),
        dmean("_dis").alias("avg_discount"), dmean("_rev").alias("avg_revenue"),
        dmean("_ord").alias("avg_orders"))
    n = len(names)
    grouping = F.when(F.col("_gid") == (1 << n) - 1, F.lit("total"))
    key = F.lit(None).cast("string")
    for i, nm in enumerate(names):
        gid_i = (1 << n) - 1 - (1 << (n - 1 - i))
        grouping = grouping.when(F.col("_gid") == gid_i, F.lit(nm))
        key = F.when(F.col("_gid") == gid_i, F.col(f"_{nm}")).otherwise(key)
    out = g.select(grouping.alias("grouping"), key.alias("key"), "revenue", "orders", "profit",
                   "lines", "avg_row_margin_pct", "avg_discount", "avg_revenue", "avg_orders")
    # pandas group-bys drop null keys; the total row has none by construction.
    return out.filter((F.col("grouping") == "total") | F.col("key").isNotNull())


def context_totals(bundle: DataFrame) -> DataFrame:
    """(n_products, n_cities, n_categories, rev_lift_pct, ord_lift_pct), one row from the context
    bundle: its rows per key are the distinct values, its promo rows hold the means that the lifts compare."""
    def rows(name):
        return F.count(F.when(F.col("grouping") == name, 1))

    def mean(value, key):
        return F.max(F.when((F.col("grouping") == "promo") & (F.col("key") == key), F.col(value)))

    one = bundle.agg(rows("product").alias("n_products"), rows("city").alias("n_cities"),
                     rows("category").alias("n_categories"), mean("avg_revenue", "Yes").alias("rev_y"),
                     mean("avg_revenue", "No").alias("rev_n"), mean("avg_orders", "Yes").alias("ord_y"),
                     mean("avg_orders", "No").alias("ord_n"))
    lift = lambda a, b: F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b) * 100.0).otherwise(0.0)
    return one.select("n_products", "n_cities", "n_categories", lift("rev_y", "rev_n").alias("rev_lift_pct"),
                      lift("ord_y", "ord_n").alias("ord_lift_pct"))


# ---------------------------------------------------------------- E20 - E25

# Cost shares of mean revenue per order used by the unit-economics view.
UNIT_ECONOMICS_RATES = {"cogs": 0.52, "rider": 0.12, "packaging": 0.03, "gateway": 0.02, "promos": 0.05}


def unit_economics(df: DataFrame, rates: dict | None = None, cols: SalesCols = SALES) -> DataFrame:
    """Cost lines as shares of mean revenue, net and contribution %, delivery cost
    (rider + packaging) per order, in total and as % of revenue."""
    rates = rates or UNIT_ECONOMICS_RATES
    k = cols
    t = df.agg(dmean(k.revenue).alias("avg_revenue"), dsum(k.revenue).alias("total_revenue"),
               F.coalesce(F.sum(k.orders), F.lit(0)).cast("long").alias("total_orders"))
    avg = F.coalesce(F.col("avg_revenue"), F.lit(0.0))
    cost_cols = [(avg * F.lit(float(v))).alias(f"{n}_cost") for n, v in rates.items()]
    out = t.select("avg_revenue", "total_revenue", "total_orders", *cost_cols)
    total_cost = sum((F.col(f"{n}_cost") for n in rates), F.lit(0.0))
    per_order = F.col("rider_cost") + F.col("packaging_cost") if {"rider", "packaging"} <= set(rates) \
        else F.lit(0.0)
    out = out.withColumn("net_profit", avg - total_cost)
    out = out.withColumn("contribution_pct", F.when(avg > 0, F.col("net_profit") / avg * 100.0)
                         .otherwise(F.lit(0.0)))
    out = out.withColumn("delivery_cost_per_order", per_order)
    out = out.withColumn("total_delivery_cost", per_order * F.col("total_orders"))
    return out.withColumn("delivery_pct_of_revenue",
                          safe_div(F.col("total_delivery_cost") * 100.0, F.col("total_revenue")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share % per value, descending (nulls dropped)."""
    g = nonnull(df, col).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count").alias("_total"))
    return (g.crossJoin(one_row(total))
            .withColumn("share_pct", F.col("count") * 100.0 / F.col("_total")).drop("_total")
            .orderBy(*ranked_desc("count", col)))


def crosstab_share(df: DataFrame, group: str, target: str, k: int = 8,
                   first_target: str | None = None) -> DataFrame:
    """Counts group x target for the k largest groups, share of the first target value
    (smallest by sort order unless given) and best/worst flags."""
    base = nonnull(df, group, target)
    cnt = base.groupBy(group, target).agg(F.count(F.lit(1)).alias("n"))
    if first_target is None:
        ft = cnt.agg(F.min(F.col(target).cast("string")).alias("_ft"))
    else:
        ft = cnt.sparkSession.range(1).select(F.lit(first_target).alias("_ft"))
    per_group = cnt.crossJoin(one_row(ft)).groupBy(group).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col(target).cast("string") == F.col("_ft"), F.col("n")).otherwise(0)).alias("first_n"),
        F.first("_ft").alias("first_target"))
    top = per_group.orderBy(F.col("total").desc(), F.col(group).asc()).limit(k)
    top = top.withColumn("share_first", F.col("first_n") / F.col("total"))
    best = top.agg(F.min_by(group, F.struct(-F.col("share_first"), F.col(group))).alias("_best"),
                   F.min_by(group, F.struct(F.col("share_first"), F.col(group))).alias("_worst"))
    return (top.crossJoin(one_row(best))
            .withColumn("is_best", F.col(group) == F.col("_best"))
            .withColumn("is_worst", F.col(group) == F.col("_worst")).drop("_best", "_worst"))


def financial_breakdown(df: DataFrame, revenue: str = "revenue", cogs: str | None = None,
                        profit: str | None = "profit") -> DataFrame:
    """Revenue, cogs, gross profit (revenue - cogs when cogs exists, else profit) and
    gross margin %."""
    aggs = [dsum(revenue).alias("revenue")]
    aggs.append(dsum(cogs).alias("cogs") if cogs else F.lit(None).cast("double").alias("cogs"))
    if profit and not cogs:
        aggs.append(dsum(profit).alias("_profit"))
    t = df.agg(*aggs)
    gp = (F.col("revenue") - F.col("cogs")) if cogs else (F.col("_profit") if profit else F.lit(None))
    t = t.withColumn("gross_profit", gp.cast("double"))
    t = t.withColumn("gross_margin_pct", safe_div(F.col("gross_profit") * 100.0, F.col("revenue")))
    return t.select("revenue", "cogs", "gross_profit", "gross_margin_pct")


def revenue_per_order(df: DataFrame, dim: str, cols: SalesCols = SALES) -> DataFrame:
    """Sum revenue / sum orders per group, ascending (low-value finder)."""
    k = cols
    g = nonnull(df, dim).groupBy(dim).agg(dsum(k.revenue).alias("revenue"),
                                          F.sum(k.orders).cast("long").alias("orders"))
    g = g.withColumn("revenue_per_order", F.try_divide(F.col("revenue"), F.col("orders").cast("double")))
    return g.filter(F.col("revenue_per_order").isNotNull()).orderBy("revenue_per_order", dim)


def loss_making(df: DataFrame, dim: str, profit: str = "profit") -> DataFrame:
    """Groups whose total profit is negative (HAVING), most negative first."""
    g = nonnull(df, dim).groupBy(dim).agg(dsum(profit).alias("profit"))
    return g.filter(F.col("profit") < 0).orderBy("profit", dim)


def promo_stats(df: DataFrame, cols: SalesCols = SALES, alpha: float = 0.05,
                with_p: bool = True) -> DataFrame:
    """Promo Yes / No mean revenue and orders, lifts %, counts and the pooled t-test p
    on revenue (p = 1 unless both groups have more than one row)."""
    from .stats import two_sample_ttest
    k = cols
    y, n = F.col(k.promo) == "Yes", F.col(k.promo) == "No"
    one = df.agg(
        F.try_divide(F.sum(F.when(y, F.col(k.revenue))).cast("double"), F.count(F.when(y, F.col(k.revenue)))).alias("rev_y"),
        F.try_divide(F.sum(F.when(n, F.col(k.revenue))).cast("double"), F.count(F.when(n, F.col(k.revenue)))).alias("rev_n"),
        F.try_divide(F.sum(F.when(y, F.col(k.orders))).cast("double"), F.count(F.when(y, F.col(k.orders)))).alias("ord_y"),
        F.try_divide(F.sum(F.when(n, F.col(k.orders))).cast("double"), F.count(F.when(n, F.col(k.orders)))).alias("ord_n"),
        F.count(F.when(y, 1)).alias("count_y"), F.count(F.when(n, 1)).alias("count_n"))
    lift = lambda a, b: F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b) * 100.0).otherwise(0.0)
    out = one.select(
        F.coalesce("rev_y", F.lit(0.0)).alias("rev_y"), F.coalesce("rev_n", F.lit(0.0)).alias("rev_n"),
        lift("rev_y", "rev_n").alias("rev_lift_pct"),
        F.coalesce("ord_y", F.lit(0.0)).alias("ord_y"), F.coalesce("ord_n", F.lit(0.0)).alias("ord_n"),
        lift("ord_y", "ord_n").alias("ord_lift_pct"), "count_y", "count_n")
    if with_p:
        t = two_sample_ttest(df, k.promo, k.revenue, "Yes", "No", alpha).select("p_value", "significant")
        out = out.crossJoin(one_row(t))
    return out
