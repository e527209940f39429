"""SimHash near-deduplication with multi-index hashing.

Fingerprints are cut into segments. If two of them differ in at most r bits, then in some one of
m segments they differ in at most r // m bits: every fingerprint enumerates the small Hamming
ball around each of its segments, fetches from that segment's table the fingerprints stored under
those values, and checks the complete distance inside the join. Equal fingerprints are one node
throughout, so copies are never paired.

A pair of buckets of which both hold more than ``heavy`` different fingerprints would give a
product of their sizes. Fingerprints of such buckets meet in common points instead: each
emits the points within r - r // 2 bits, and at a point that some fingerprint has within r // 2
bits all others link to that one. Every such link is within r bits, and every pair within r bits
has such a point, so the classes are the same, at a cost in proportion to the bucket.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import majority_fingerprint
from .tables import per_text, salted_lookup, stage

BITS = 64


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the majority fingerprint of every whole text, as a signed long."""
    return per_text(docs, "fp long", lambda: lambda text: (majority_fingerprint(text, shingle),), id_col, text_col)


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, from the high bits on."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(BITS - b, b - a) for a, b in zip(edges, edges[1:])]


def _masks(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits."""
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def _value(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _key(value: Column, segment: int, count: int) -> Column:
    return value * F.lit(count) + F.lit(segment)


def links(prints: DataFrame, radius: int = 3, segments: int = 2, heavy: int = 1000) -> DataFrame:
    """(u, v) links between distinct fingerprints (column fp): the classes they span are those
    of all pairs at most ``radius`` bits apart. Needs at least two segments."""
    if segments < 2:
        raise ValueError("segments must be at least 2")
    cuts = _segments(segments)
    ball = radius // segments
    fp = F.col("fp")
    index = prints.select("fp", F.explode(F.array(*[
        _key(_value(fp, s, w), i, segments) for i, (s, w) in enumerate(cuts)])).alias("key"))

    def probes(i: int, shift: int, width: int) -> Column:
        """Values reached by flips of which the highest turns 0 to 1: a pair meets from the side
        with the smaller segment, and once."""
        value = _value(fp, shift, width)
        reached = F.transform(F.array(*[F.lit(m) for m in _masks(width, ball)]), lambda m: value.bitwiseXOR(m))
        return F.transform(F.filter(reached, lambda x: x >= value),
                           lambda x: F.struct(_key(x, i, segments).alias("key"), F.lit(i).alias("segment")))

    probe = prints.select("fp", F.explode(F.concat(*[
        probes(i, s, w) for i, (s, w) in enumerate(cuts)])).alias("p")).select("fp", "p.key", "p.segment")
    crowded = stage(index.groupBy("key").count().filter(F.col("count") > heavy).select("key"), "heavy-buckets")
    some_heavy = not crowded.isEmpty()
    if some_heavy:
        members = stage(index.join(crowded, "key").select("fp").distinct(), "heavy-fingerprints")
        flag = members.withColumn("crowded", F.lit(True))
        index = index.join(crowded.withColumn("crowded", F.lit(True)), "key", "left")
        probe = probe.join(flag, "fp", "left")
    t, p = index.alias("t"), probe.alias("p")
    differ = F.col("p.fp").bitwiseXOR(F.col("t.fp"))
    found = (F.col("p.key") == F.col("t.key")) & (F.bit_count(differ) <= radius)
    own = F.lit(False)
    for i, (s, w) in enumerate(cuts):
        same = _value(differ, s, w) == 0
        first = F.lit(True)
        for j in range(i):
            first = first & (F.bit_count(_value(differ, *cuts[j])) > ball)
        own = own | ((F.col("p.segment") == i) & first & (~same | (F.col("p.fp") < F.col("t.fp"))))
    found = found & own
    if some_heavy:
        found = found & ~(F.col("p.crowded").isNotNull() & F.col("t.crowded").isNotNull())
    out = p.join(t, found).select(F.col("p.fp").alias("u"), F.col("t.fp").alias("v"))
    return out.unionByName(_meeting_points(members, radius)) if some_heavy else out


def _meeting_points(members: DataFrame, radius: int) -> DataFrame:
    """Star links among fingerprints through points close to both ends."""
    near, far = radius // 2, radius - radius // 2
    points = members.select("fp", F.explode(F.transform(
        F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in _masks(BITS, far)]),
        lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("point"), (F.bit_count(m) <= near).alias("near")))).alias("x"))
    points = points.select("fp", "x.point", "x.near")
    centre = points.filter("near").groupBy("point").agg(F.min("fp").alias("v"))
    return points.join(centre, "point").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, segments: int = 2, heavy: int = 1000,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, fp, component_id), component_id being the smallest id reachable
    over links of at most ``radius`` differing bits.

    Null and empty texts have fingerprint zero and link like any other. Equal texts, ties and
    repeated rows share a class. Rows with a null id take part, but a null is never the smallest id
    (a class of such rows only has a null class id). An empty table gives an empty result; further
    columns are ignored."""
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), radius, segments, heavy))
    # Merge joins as in line dedup: a broadcast is built in the driver.
    rooted = nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component_id")
    return salted_lookup(prints, classes, "fp", "id").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3, segments: int = 2, heavy: int = 1000) -> DataFrame:
    """The documents with the smallest doc_id of their class, all columns unchanged.

    Rows with a null doc_id stay: they cannot be told apart from the others of their class. Of
    rows repeated with the class's smallest doc_id all stay, as they are one document."""
    stays = near_duplicates(docs.select("doc_id", "text"), shingle, radius, segments, heavy)
    stays = stays.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.filter(F.col("doc_id").isNull()).unionByName(docs.join(stays, "doc_id", "left_semi"))
