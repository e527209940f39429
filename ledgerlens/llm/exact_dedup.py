"""Exact document deduplication by content sort (DataFrame functions only).

1. Texts that very many rows share are found by counting 64-bit hashes, reduced within tasks. Their rows become a few
   entries each (best row and count per salt) before their text is shuffled; every other row is an entry.
2. Entries are range-partitioned by their first normalised bytes; where very many texts begin alike, the splitters tell
   them apart by the digest of the whole. Splitters are sampled from these short keys, however long the texts are.
3. An external sort by the whole normalised bytes places equal entries side by side, and neighbours are compared over
   the full bytes. Equal texts have equal keys, so no group spans two ranges. The best row of a group stays.
4. The rows of the very frequent texts take over the group of their entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import salt_count, stage

#: Bytes that the splitters compare.
HEAD_BYTES = 64
#: No text is very frequent with fewer rows.
FREQUENT = 64
#: Entries that a very frequent text is reduced to, at most.
ENTRIES = 16
WHITESPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: str | Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for ch in WHITESPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _better(n: str, ident: str) -> Column:
    """A value that is smaller the better the row: most code points, then the smallest id, null last."""
    return F.struct((-F.col(n)).alias("n"), F.col(ident).isNull().alias("none"), F.col(ident).alias("id"))


def frequent_hashes(keyed: DataFrame, rows: int, least: int) -> DataFrame:
    """Hashes that more rows have than half a partition's share, ``least`` at least: not more than 2 a partition."""
    most = max(least, rows // (2 * salt_count(keyed.sparkSession)))
    return stage(keyed.groupBy("h").count().filter(F.col("count") > most).select("h"), "frequent-texts")


def sorted_groups(entries: DataFrame) -> DataFrame:
    """``entries`` (id, n, size, norm, sha) with keep_n, keep_id, group_size and the ``place`` in their group, without norm:
    range partition, sort and comparison of neighbours."""
    equal = Window.partitionBy("head", "norm", "sha")  # in this order: sorted and compared by bytes, the digest last
    best = equal.orderBy(F.desc("n"), F.asc_nulls_last("id"))
    keyed = entries.withColumn("head", F.substring(F.col("norm").cast("binary"), 1, HEAD_BYTES))
    return keyed.repartitionByRange("head", "sha").select(
        *[c for c in entries.columns if c != "norm"], F.first("n").over(best).alias("keep_n"),
        F.first("id").over(best).alias("keep_id"), F.sum("size").over(equal).alias("group_size"),
        F.row_number().over(best).alias("place"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the most code points in the original text, then the smallest id,
    stays. Null texts are empty texts, and all empty texts are one group. A null id sorts after
    all others. Of rows repeated with the same id and text exactly one is kept. An empty table
    gives an empty result; further columns are ignored, whatever their names. ``frequent`` changes the work, never the
    result."""
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.char_length(F.coalesce(text, F.lit(""))).alias("n"),
                        normalised(text).alias("norm")).withColumn("h", F.xxhash64("norm"))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    often = F.broadcast(frequent_hashes(keyed, docs.count(), frequent))  # at most 2 rows a partition
    single = keyed.join(often, "h", "left_anti").select(
        "id", "n", F.lit(1).cast("long").alias("size"), "norm", sha, F.lit(False).alias("many"))
    # Rows of the frequent texts, without the texts.
    crowd = stage(keyed.join(often, "h").select("id", "n", sha, F.monotonically_increasing_id().alias("row")), "frequent-rows")
    salt = F.pmod(F.xxhash64("id"), F.lit(ENTRIES))
    reduced = keyed.join(often, "h").groupBy("norm", salt.alias("salt")).agg(
        F.min(_better("n", "id")).alias("best"), F.count(F.lit(1)).alias("size"))
    reduced = reduced.select(F.col("best.id").alias("id"), (-F.col("best.n")).alias("n"), "size", "norm", sha, F.lit(True).alias("many"))
    groups = stage(sorted_groups(single.unionByName(reduced)), "content-sort")
    few = groups.filter("not many").select("id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "sha")
    heads = groups.filter("many and place = 1").select("sha", "keep_id", "keep_n", "group_size")  # one row a frequent text
    named = crowd.join(F.broadcast(heads), "sha")
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    stays = named.filter(best).groupBy("sha").agg(F.min("row").alias("stay"))
    many = named.join(F.broadcast(stays), "sha").select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("stay")).alias("kept"), "sha")
    return few.unionByName(many).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
