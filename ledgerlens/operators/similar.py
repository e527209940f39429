"""Near-duplicate spellings in text columns (``difflib.get_close_matches`` semantics).

For every distinct value v of a column: the up to ``n`` best matches x with
``SequenceMatcher(None, x, v).ratio() >= cutoff`` (v itself always ranks first), then greedy
grouping: walking the values in a fixed order (ascending; the reference walks first-appearance
order, which Spark tables do not have), each value not yet seen forms the group
{v} + its matches, and every member becomes seen.

Spark plan, exact and without all-pairs:
1. distinct (column, value) pairs;
2. a ratio of t means that M >= t (|A| + |B|) / 2 characters match in order, and so that at least
   (2q - 1) M - (q - 1)(|A| + |B| + 1) q-grams are common (an unmatched character spoils q grams of its own value and
   q - 1 of the other). Grams are numbered per value ("gram#k" = k-th occurrence) and ordered rarest first;
3. a pair with c common grams has its first l common ones within the first n - c + l grams of either value, for every
   l <= c. Keys start at l = 1. A key that more than ``crowded`` values have is split: its values get keys of one more
   gram each, up to four, so that long buckets break up until they are short (``candidate_pairs``);
4. the pairs that remain are counted against c, and only those that have c common grams get the true ratio (Arrow
   UDF); top n-1 per value by a partitioned ``row_number`` (group limit applied before the shuffle);
5. the greedy walk is resolved in rounds of joins (``greedy_leaders``): a value leads a group
   unless a smaller leading value lists it among its matches.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import qcol
from ..functions.similarity import sequence_ratio
from ..session import checkpointed, ensure_checkpoint_dir


CROWDED = 8
LEVELS = 4


def least_matches(total: int, cutoff: float) -> int:
    """Characters that match in a pair of ``total`` characters whose ratio is at least the cutoff; the margin keeps
    rounding from asking for one too many."""
    return math.ceil(total * cutoff / 2 - 1e-9)


def common_grams(total: int, cutoff: float, q: int) -> int:
    return (2 * q - 1) * least_matches(total, cutoff) - (q - 1) * (total + 1)


def gram_size(cutoff: float) -> int:
    """2 where every pair of values of two characters or more that reaches the cutoff has a common pair of characters, else
    single characters. Beyond 200 characters the bound grows with the length wherever it does before."""
    pairs = ((a, b) for a in range(2, 101) for b in range(a, 101) if least_matches(a + b, cutoff) <= a)
    return 2 if cutoff > 0.7 and all(common_grams(a + b, cutoff, 2) >= 1 for a, b in pairs) else 1


def _needed(left: Column, right: Column, cutoff: float, q: int) -> Column:
    """``common_grams`` of two lengths."""
    total = left + right
    return ((2 * q - 1) * F.ceil(total * (cutoff / 2) - 1e-9) - (q - 1) * (total + 1)).cast("int")


def _can_match(left: Column, right: Column, cutoff: float) -> Column:
    return F.least(left, right) >= F.ceil((left + right) * (cutoff / 2) - 1e-9)


def gram_table(vals: DataFrame, cutoff: float, q: int) -> DataFrame:
    """(k, v, vid, L, n, c, grams) per distinct value: its numbered grams, rarest in its column first, and the fewest that
    it has in common with any value it matches. Written to the shared folder, which fixes the numbers ``vid``."""
    at = F.sequence(F.lit(1), F.greatest(F.length("v") - (q - 1), F.lit(1)))
    grams = vals.select("k", "v", F.explode(F.transform(at, lambda i: F.substring("v", i, q))).alias("g"))
    counted = grams.groupBy("k", "v", "g").count()
    numbered = counted.select("k", "v", F.explode(F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("count")), lambda i: F.xxhash64("g", i))).alias("tok"))
    often = numbered.groupBy("k", "tok").agg(F.count(F.lit(1)).alias("f"))
    ordered = numbered.join(often, ["k", "tok"]).groupBy("k", "v").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "tok"))), lambda s: s["tok"]).alias("grams"))
    out = ordered.withColumn("L", F.length("v")).withColumn("n", F.size("grams"))
    partners = F.filter(F.sequence(F.floor(F.col("L") * (cutoff / 2)).cast("int"), F.ceil(F.col("L") * (2 / cutoff)).cast("int")),
                        lambda m: (m >= 1) & _can_match(F.col("L"), m, cutoff))
    fewest = F.array_min(F.transform(partners, lambda m: _needed(F.col("L"), m, cutoff, q)))
    out = out.withColumn("c", F.greatest(fewest, F.lit(1)))
    return checkpointed(out.withColumn("vid", F.monotonically_increasing_id()))


def candidate_pairs(table: DataFrame, cutoff: float, q: int, crowded: int = CROWDED, levels: int = LEVELS) -> DataFrame:
    """(a, b) numbers of values, a < b, without repeats: every pair that has the common grams it needs is among them.

    Rows (key, value) of one level share ``level`` grams with their key. In a key of at most ``crowded`` values all
    pairs of fitting lengths are candidates; in longer ones only pairs that need no more than ``level`` common grams, as
    these have all of them, and the others meet again under keys of one more gram. At the last level all pairs of
    fitting lengths are candidates."""
    size = F.col("n") - F.col("c")
    rows = table.select("vid", "L", "n", "c", "grams", F.xxhash64("k").alias("key"), F.lit(0).alias("at"))
    found, level = [], 0
    while True:
        level += 1
        # The next gram after the last one, within the first n - c + level.
        more = F.sequence(F.col("at") + 1, F.least(F.col("n"), size + level))
        rows = rows.filter(F.least(F.col("n"), size + level) > F.col("at")).withColumn("next", F.explode(more)).select(
            "vid", "L", "n", "c", "grams", F.xxhash64("key", F.element_at("grams", F.col("next"))).alias("key"),
            F.col("next").alias("at"))
        rows = checkpointed(rows)
        full = checkpointed(rows.groupBy("key").count().filter(
            (F.col("count") > crowded) & F.lit(level < levels)).select("key"))
        short = rows.join(full, "key", "left_anti").select("key", "vid", "L")
        left, right = short.alias("x"), short.alias("y")
        fits = _can_match(F.col("x.L"), F.col("y.L"), cutoff)
        found.append(left.join(right, (F.col("x.key") == F.col("y.key")) & (F.col("x.vid") < F.col("y.vid")) & fits).select(
            F.col("x.vid").alias("a"), F.col("y.vid").alias("b")))
        if full.isEmpty():
            break
        rows = checkpointed(rows.join(full, "key", "left_semi"))
        # Pairs of the crowded keys that have all the grams they need, by the lengths for which that is so.
        done = rows.filter(F.col("c") <= level).select("key", "vid", "L", F.explode(F.filter(
            F.sequence(F.floor(F.col("L") * (cutoff / 2)).cast("int"), F.ceil(F.col("L") * (2 / cutoff)).cast("int")),
            lambda m: (m >= 1) & _can_match(F.col("L"), m, cutoff) & (_needed(F.col("L"), m, cutoff, q) <= level))).alias("M"))
        left, right = done.alias("x"), rows.select("key", "vid", "L").alias("y")
        found.append(left.join(right, (F.col("x.key") == F.col("y.key")) & (F.col("x.M") == F.col("y.L")) & (
            F.col("x.vid") < F.col("y.vid"))).select(F.col("x.vid").alias("a"), F.col("y.vid").alias("b")))
    return reduce(lambda x, y: x.unionByName(y), found).distinct()


def close_pairs(table: DataFrame, cutoff: float, q: int, crowded: int = CROWDED) -> DataFrame:
    """(k, word, x): both directions of the candidates that have the common grams they need."""
    pairs = candidate_pairs(table, cutoff, q, crowded)
    one = table.select("k", F.col("vid").alias("a"), F.col("v").alias("va"), F.col("L").alias("la"), F.col("grams").alias("ga"))
    two = table.select(F.col("vid").alias("b"), F.col("v").alias("vb"), F.col("L").alias("lb"), F.col("grams").alias("gb"))
    both = pairs.join(one, "a").join(two, "b")
    enough = F.size(F.array_intersect("ga", "gb")) >= _needed(F.col("la"), F.col("lb"), cutoff, q)
    kept = both.filter(enough)
    way = F.array(F.struct(F.col("va").alias("word"), F.col("vb").alias("x")), F.struct(F.col("vb").alias("word"), F.col("va").alias("x")))
    return kept.select("k", F.explode(way).alias("s")).select("k", "s.word", "s.x")


def greedy_leaders(close: DataFrame) -> DataFrame:
    """Resolve the ordered greedy walk without a sequential scan.

    ``close``: (k, word, x) match edges. A value v *leads* a group iff it has matches and no
    smaller value u that leads a group lists v among its matches (that is exactly "v not seen
    yet" in the walk). Statuses are settled in rounds: a value whose smaller in-neighbours are
    all settled is decided (leader when none of them leads); each round is one join and one
    aggregation over the edges, and the number of rounds is the longest chain of dependent
    values, not the data size. Returns (k, v, leader: boolean).
    """
    ensure_checkpoint_dir(close.sparkSession)
    nodes = (close.select("k", F.col("word").alias("v")).unionByName(close.select("k", F.col("x").alias("v")))
             .distinct())
    has_out = close.select("k", F.col("word").alias("v")).distinct().withColumn("_out", F.lit(True))
    dep = close.filter(F.col("word") < F.col("x")).select("k", F.col("word").alias("u"), F.col("x").alias("v"))
    status = checkpointed(nodes.join(has_out, ["k", "v"], "left")
                          .select("k", "v", F.coalesce("_out", F.lit(False)).alias("out"),
                                  F.lit(None).cast("boolean").alias("leader")))
    dep = checkpointed(dep)
    while True:
        s_u = status.select("k", F.col("v").alias("u"), F.col("leader").alias("lu"))
        inc = dep.join(s_u, ["k", "u"]).groupBy("k", "v").agg(
            F.max(F.col("lu").cast("int")).alias("any_leader"),
            F.min(F.col("lu").isNotNull().cast("int")).alias("all_settled"))
        nxt = status.join(inc, ["k", "v"], "left")
        decided = (F.when(F.col("leader").isNotNull(), F.col("leader"))
                   .when(~F.col("out"), F.lit(False))
                   .when(F.col("any_leader") == 1, F.lit(False))
                   .when(F.col("all_settled").isNull() | (F.col("all_settled") == 1), F.lit(True)))
        nxt = checkpointed(nxt.select("k", "v", "out", decided.alias("leader"),
                                      (F.col("leader").isNull() & decided.isNotNull()).alias("_new")))
        progressed = nxt.filter("_new").limit(1).count()
        status = nxt.drop("_new")
        if progressed == 0:
            pending = status.filter(F.col("leader").isNull()).limit(1).count()
            if pending:
                raise RuntimeError("greedy grouping did not settle")  # cannot happen: dependencies are acyclic
            return status.select("k", "v", "leader")


def similar_values(df: DataFrame, cols: list[str] | str, cutoff: float = 0.85, n: int = 4,
                   crowded: int = CROWDED) -> DataFrame:
    """Groups of similar spellings per column: (column, leader, members, size). ``crowded`` (values of a key that is
    not split) changes the work, never the result."""
    cols = [cols] if isinstance(cols, str) else cols
    parts = [F.struct(F.lit(c).alias("k"), qcol(c).cast("string").alias("v")) for c in cols]
    vals = (df.select(F.explode(F.array(*parts)).alias("s")).select("s.k", "s.v")
            .filter(F.length("v") > 0).distinct())
    t, q = float(cutoff), gram_size(cutoff)
    ensure_checkpoint_dir(df.sparkSession)
    cand = checkpointed(close_pairs(gram_table(vals, t, q), t, q, crowded))
    scored = cand.withColumn("score", sequence_ratio(F.col("x"), F.col("word"))).filter(F.col("score") >= t)
    w = Window.partitionBy("k", "word").orderBy(F.col("score").desc(), F.col("x").desc())
    top = scored.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n - 1)
    spark = df.sparkSession
    schema = "column string, leader string, members array<string>, size int"
    if top.limit(1).count() == 0:
        return spark.createDataFrame([], schema)
    top = checkpointed(top)
    leaders = greedy_leaders(top.select("k", "word", "x")).filter("leader")
    groups = (top.join(leaders.select("k", F.col("v").alias("word")), ["k", "word"])
              .groupBy("k", "word").agg(F.collect_list("x").alias("close")))
    members = F.array_sort(F.array_distinct(F.concat(F.array(F.col("word")), F.col("close"))))
    return groups.select(F.col("k").alias("column"), F.col("word").alias("leader"), members.alias("members"),
                         F.size(members).alias("size"))
