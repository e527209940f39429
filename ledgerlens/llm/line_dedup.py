"""Line deduplication by a segment-partition edit join (DataFrame functions only).

Two lines of at least ``min_chars`` code points are linked if at most ``k`` edits (insert, delete,
substitute a code point) turn one into the other, and linked lines form classes. Shorter lines, from
``equal_chars`` code points on, form a class only with their equals.
The first occurrence of a class, by document id and position, stays; the others are removed.

* Equal lines are one node (their 128-bit digest); copies are counted, never paired.
* Every line is cut into k + 1 segments. k edits leave one segment untouched, so a line within k
  edits contains it, shifted by a few places: each line probes the segment index with the substrings at those places only.
  Lines of nearly one length are cut alike, the last segment counted from the end, so that most places
  are those of a line's own segments, and only the shorter length next to a boundary is probed besides.
* Candidates are verified with a banded bit-parallel automaton over the whole lines: bit d of
  word e says that diagonal d of the band can be reached with e edits.
* In buckets with more than ``crowded`` different lines (variants of one line) what is left of a line
  beside the shared segment is cut into k + 1 segments again, so that pairs must share two of
  them, and their letter counts must differ by at most 2k in all, which k edits cannot exceed.

Different lines are written once, tightly compressed, as several steps read them. Line texts are not shuffled but for
repeated lines and candidates, probes only where they hit a segment, documents only where lines go. All are picked out during the scan by a bitmap of bounded size over the hashes wanted; false
positives only cost time, as exact joins follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import salt_count, salted_lookup, stage

BITMAP_BITS = 1 << 28  # 64 bits of bitmap take 8 bytes of a broadcast table: at most 32 MB, whatever the size of the data
COUNTED = ("abcdefghijklm", "nopqrstuvwxyz")  # letters counted in crowded buckets, modulo 16


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc, version, pos, line, n, h, id) per line of at least ``least`` code points; version tells different texts of one
    repeated document id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("doc"), F.xxhash64(text).alias("version"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    out = out.withColumn("n", F.char_length("line")).filter(F.col("n") >= least)
    return out.withColumn("h", F.xxhash64("line")).withColumn("id", F.unhex(F.md5("line")))


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """(bucket, words) per occupied bucket of 32768 bits, at most bits / 32768 rows; words: 512 numbers of 64 bits each.

    Words are full: the driver builds the broadcast table in arrays that double, so a bit unused costs it several."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    maps = keys.select(F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(F.lit(32767)).alias("bit")).groupBy(
        "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    word = F.transform(F.sequence(F.lit(0), F.lit(511)),  # to base -10: as a signed number
                       lambda i: F.conv(F.hex(F.substring("map", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return maps.select("bucket", word.alias("words"))


def bitmap_bits(keys: int) -> int:
    """A power of two of 8 bits a key or more, from 2 ** 20 to BITMAP_BITS."""
    return min(BITMAP_BITS, 1 << max(20, (8 * keys - 1).bit_length()))


def _marked(rows: DataFrame, keys: DataFrame, by: str = "h") -> DataFrame:
    """``rows`` with ``wanted``: false for certain if the row's ``by`` is not among the ``h`` of ``keys`` (a written table)."""
    bits = bitmap_bits(keys.count())
    slot = F.col(by).bitwiseAND(F.lit(bits - 1))
    at = slot.bitwiseAND(F.lit(32767))
    # Words are big-endian, the bits of a byte are numbered from its lowest.
    place = (56 - F.shiftright(at.bitwiseAND(F.lit(63)), 3) * 8 + at.bitwiseAND(F.lit(7))).cast("int")
    # The broadcast side is bounded by BITMAP_BITS.
    joined = rows.withColumn("bucket", F.shiftright(slot, 15)).join(F.broadcast(_bitmap(keys, bits)), "bucket", "left")
    word = F.get("words", F.shiftright(at, 6).cast("int"))
    return joined.withColumn("wanted", F.coalesce(F.getbit(word, place) == 1, F.lit(False))).drop("bucket", "words")


def _segment(m: Column, i: Column, k: int) -> tuple[Column, Column]:
    """(start from 0, length) of segment i of a string of length m cut into k + 1."""
    base = F.floor(m / (k + 1)).cast("int")
    longer = (F.lit(k + 1) - m % (k + 1)).cast("int")  # segments from here on have one code point more
    return base * i + F.greatest(F.lit(0), i - longer), base + (i >= longer).cast("int")


def _shifts(i: int, delta: int, k: int) -> range:
    """Places, against the segment's own, at which a line longer by delta can hold segment i."""
    return range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1)


def _explode(rows: DataFrame, names: tuple, values: list[tuple]) -> DataFrame:
    """``rows`` once per tuple of ``values``, with these in the struct ``_s``."""
    return rows.withColumn("_s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, x)]) for x in values])))


def _part(text: str) -> Column:
    """The ``len`` code points of the column ``text`` from ``at`` on, as UTF-8. In ASCII texts (``_bytes`` is not null there) no
    walk along the text is needed."""
    at, length = F.col("at") + 1, F.col("len")
    return F.coalesce(F.substring("_bytes", at, length), F.substring(text, at, length).cast("binary"))


def _with_bytes(rows: DataFrame, text: str, n: str) -> DataFrame:
    return rows.withColumn("_bytes", F.when(F.octet_length(text) == F.col(n), F.col(text).cast("binary")))


def _common_length(n: Column) -> Column:
    """The length that lines of n code points are cut at: steps of 4, from 64 on of 16."""
    return (n - n % F.when(n < 64, 4).otherwise(16)).cast("int")


def _line_shifts(k: int) -> list[tuple[int, int]]:
    """(segment, shift) at which a line of at least the same length can hold a segment of another, with the last one's
    counted from the end.

    Up to 3 edits between lines of one length hold one insertion and one deletion at most, so all segments
    that moved went the same way, seen from either line: as both probe, those to the right suffice."""
    found = {(i, shift) for i in range(k) for delta in range(k + 1) for shift in _shifts(i, delta, k)
             if delta or shift >= 0 or k > 3}
    found |= {(k, shift - delta) for delta in range(k + 1) for shift in _shifts(k, delta, k)}
    return sorted(found)


def _line_keys(rows: DataFrame, k: int, own: bool) -> DataFrame:
    """``rows`` (with line, n) once per key of the line's own segments, or per probe into the index of other
    lines' segments (its own left out), with ``key``, ``at`` and ``len``."""
    n, shift, i = F.col("n"), F.col("_s.shift"), F.col("_s.i")
    if own:
        cuts = [(0, i, 0) for i in range(k + 1)]
    else:
        cuts = [(delta, *x) for delta in range(k + 1) for x in _line_shifts(k) if delta or x[1]]
    out = _explode(_with_bytes(rows, "line", "n"), ("delta", "i", "shift"), cuts)
    m = _common_length(n - F.col("_s.delta"))
    out = out.withColumn("_m", m)
    if not own:  # shorter lines that are cut at another length
        out = out.filter((F.col("_s.delta") == 0) | (F.col("_m") != _common_length(n - F.col("_s.delta") + 1)))
    length = F.floor(F.col("_m") / (k + 1)).cast("int")
    start = F.when(i == k, n - length).otherwise(length * i) + shift
    out = out.withColumns({"at": start.cast("int"), "len": length})
    return out.withColumn("key", F.xxhash64("_m", i, _part("line"))).drop("_bytes", "_s", "_m")


def _rest_keys(rows: DataFrame, k: int, own: bool) -> DataFrame:
    """``rows`` (with rest, left) once per segment of the rest of a line, or per probe into the index of such
    segments of rests up to k shorter (its own left out), with ``cut``, a hash of the segment."""
    if own:
        cuts = [(0, i, 0) for i in range(k + 1)]
    else:
        cuts = [(delta, i, shift) for delta in range(k + 1) for i in range(k + 1) for shift in _shifts(i, delta, k)
                if delta or shift]
    out = _explode(_with_bytes(rows, "rest", "left"), ("delta", "i", "shift"), cuts)
    m, i = F.col("left") - F.col("_s.delta"), F.col("_s.i")
    start, length = _segment(m, i, k)
    out = out.withColumns({"at": (start + F.col("_s.shift")).cast("int"), "len": length.cast("int")})
    return out.withColumn("cut", F.xxhash64(m, i, _part("rest"))).drop("_bytes", "_s", "at", "len")


def within_edits(x: Column, y: Column, k: int) -> Column:
    """Whether at most k edits turn x into y, two arrays of code points (columns of a written table:
    an expression would be evaluated anew at every step), by a banded bit-parallel automaton.

    Word e holds a bit per diagonal d = i - j + k of the band (2k + 1 bits) that is reachable with
    at most e edits after j code points of y. The words are packed into one long."""
    width = 2 * k + 1
    full = (1 << width) - 1
    n, m = F.size(x), F.size(y)

    def matches(char: Column, j: Column) -> Column:  # j from 0; diagonal d is at place j + d - k of x
        out = F.lit(0).cast("long")
        for d in range(width):
            out = out.bitwiseOR(F.when(F.get(x, j + (d - k)) == char, F.lit(1 << d)).otherwise(F.lit(0)).cast("long"))
        return out

    def word(state: Column, e: int) -> Column:
        return F.shiftright(state, e * width).bitwiseAND(F.lit(full))

    def step(state: Column, match: Column) -> Column:
        out, last = F.lit(0).cast("long"), None
        for e in range(k + 1):
            now = word(state, e).bitwiseAND(match)
            if last is not None:
                before = word(state, e - 1)
                now = now.bitwiseOR(before)  # substitute: same diagonal
                now = now.bitwiseOR(F.shiftright(before, 1))  # one more code point of y only
                now = now.bitwiseOR(F.shiftleft(last, 1).bitwiseAND(F.lit(full)))  # one more of x only
            out, last = out.bitwiseOR(F.shiftleft(now, e * width)), now
        return out

    # Before y begins, e edits reach the first e places of x.
    start = sum(sum(1 << (k + d) for d in range(e + 1)) << (e * width) for e in range(k + 1))
    final = F.aggregate(F.transform(y, matches), F.lit(start).cast("long"), step)
    end = F.get(F.array(*[F.lit(1 << d) for d in range(width)]), n - m + k)
    return F.when(F.abs(n - m) > k, F.lit(False)).otherwise(word(final, k).bitwiseAND(end) > 0)


def _letter_counts(line: Column, n: Column, letters: str) -> Column:
    """Occurrences of each letter modulo 16, packed into one long."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(letters):
        count = (n - F.char_length(F.replace(line, F.lit(letter), F.lit("")))) % 16
        out = out.bitwiseOR(F.shiftleft(count.cast("long"), 4 * i))
    return out


def _count_distance(a: Column, b: Column, letters: str) -> Column:
    """Sum of the differences around the circle of 16: never more than the true difference."""
    out = F.lit(0).cast("long")
    for i in range(len(letters)):
        apart = (F.shiftright(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * i).bitwiseAND(F.lit(15)) + 16) % 16
        out = out + F.least(apart, 16 - apart)
    return out


def _distinct_texts(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(h, n, line) once per different line: lines that are certainly single straight from the
    scan, the others through an aggregation that keeps one of each before and after the shuffle."""
    marked = _marked(lines.select("h", "n", "line"), repeated)
    several = marked.filter("wanted").withColumn("id", F.unhex(F.md5("line"))).groupBy("id").agg(
        F.first("h").alias("h"), F.first("n").alias("n"), F.first("line").alias("line"))
    single = marked.filter("not wanted").select("h", "n", "line")
    return single.unionByName(stage(several.select("h", "n", "line"), "repeated-lines"))


def _pairs(texts: DataFrame, k: int, crowded: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of line digests, a < b."""
    line, n = F.col("line"), F.col("n")
    index = stage(_line_keys(texts, k, True).select("h", "n", "key"), "line-index")
    # Most probes hit no segment of any line: these go before they are shuffled.
    probe = _line_keys(texts, k, False).select("h", "n", "key")
    probe = _marked(probe, index.select(F.col("key").alias("h")), "key").filter("wanted").select("h", "n", "key")
    full = stage(index.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "crowded-segments")
    open_index = index.join(full, "key", "left_anti")
    # A probe into a crowded bucket meets one row that stands for the bucket, and is noted with b null.
    buckets = open_index.select("h", "n", "key").unionByName(
        full.select(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("n"), "key")).alias("i")
    p = probe.alias("p")
    like = F.abs(F.col("p.n") - F.col("i.n")) <= k
    met = p.join(buckets, (F.col("p.key") == F.col("i.key")) & (
        F.col("i.h").isNull() | ((F.col("p.h") != F.col("i.h")) & like))).select(
        F.when(F.col("i.h").isNull(), F.col("p.h")).otherwise(F.least("p.h", "i.h")).alias("a"),
        F.when(F.col("i.h").isNotNull(), F.greatest("p.h", "i.h")).alias("b"))
    met = stage(met.unionByName(_same(open_index, like)).distinct(), "line-candidates")
    found = met.filter("b is not null")
    if full.isEmpty():
        return found
    # Lines that stand in a crowded bucket or probe one, cut again beside the shared segment.
    inside = index.join(full, "key", "left_semi").select("h")
    some = stage(inside.unionByName(met.filter("b is null").select(F.col("a").alias("h"))).distinct(), "crowded-ends")
    lines = stage(_marked(texts, some).filter("wanted").select("h", "n", "line").join(some, "h", "left_semi"), "crowded-lines")

    def finer(first_own: bool, second_own: bool) -> DataFrame:
        """Keys of a shared segment together with a segment of the rest of the line."""
        held = _line_keys(lines.select("h", "n", "line"), k, first_own).join(full, "key")
        rest = F.concat(F.substring(line, F.lit(1), F.col("at")), F.substring(line, F.col("at") + F.col("len") + 1, n))
        held = held.select("h", "key", rest.alias("rest"), (n - F.col("len")).alias("left"),
                           *[_letter_counts(line, n, x).alias(f"c{i}") for i, x in enumerate(COUNTED)])
        return _rest_keys(held, k, second_own).select("h", "c0", "c1", F.xxhash64("key", "cut").alias("key"))

    # A line's own segments meet as before; a shifted probe may leave a rest of equal length.
    base = finer(True, True)
    other = finer(True, False).unionByName(finer(False, True)).unionByName(finer(False, False))
    close = F.lit(0)
    for i, letters in enumerate(COUNTED):
        close = close + _count_distance(F.col(f"p.c{i}"), F.col(f"i.c{i}"), letters)
    near = other.alias("p").join(base.alias("i"), (F.col("p.key") == F.col("i.key")) & (
        F.col("p.h") != F.col("i.h")) & (close <= 2 * k)).select(
        F.least("p.h", "i.h").alias("a"), F.greatest("p.h", "i.h").alias("b"))
    return found.unionByName(near).unionByName(_same(base, close <= 2 * k)).distinct()


def _same(index: DataFrame, close: Column) -> DataFrame:
    """Pairs of different lines (a < b) under one key; ``close`` is a further condition on rows p and i."""
    return index.alias("p").join(index.alias("i"), (F.col("i.key") == F.col("p.key")) & (
        F.col("p.h") < F.col("i.h")) & close).select(F.col("p.h").alias("a"), F.col("i.h").alias("b"))


def line_links(lines: DataFrame, repeated: DataFrame, k: int, crowded: int) -> DataFrame:
    """(u, v) digests of different lines at most k edits apart, all of them."""
    texts = stage(_distinct_texts(lines, repeated), "line-texts", "zstd")
    pairs = stage(_pairs(texts, k, crowded), "line-pairs")
    ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "line-ends")
    bodies = _marked(texts, ends).filter("wanted").select("h", "n", "line").join(ends, "h", "left_semi")
    bodies = stage(bodies.withColumn("id", F.unhex(F.md5("line"))).withColumns(
        {f"c{i}": _letter_counts(F.col("line"), F.col("n"), x) for i, x in enumerate(COUNTED)}), "candidate-lines")
    counts = bodies.select("h", "c0", "c1")
    close = F.lit(0)
    for i, letters in enumerate(COUNTED):
        close = close + _count_distance(F.col(f"p.c{i}"), F.col(f"i.c{i}"), letters)
    few = pairs.join(counts.withColumnRenamed("h", "a").alias("p"), "a").join(
        counts.withColumnRenamed("h", "b").alias("i"), "b").filter(close <= 2 * k).select("a", "b").distinct()
    left = bodies.select(F.col("h").alias("a"), F.col("id").alias("u"), F.split("line", "").alias("x"))
    right = bodies.select(F.col("h").alias("b"), F.col("id").alias("v"), F.split("line", "").alias("y"))
    ends = few.join(left, "a").join(right, "b").select("u", "v", "x", "y")
    ends = stage(ends.repartition(salt_count(pairs.sparkSession), "u", "v"), "line-verification")
    return ends.filter(within_edits(F.col("x"), F.col("y"), k)).select("u", "v")


def _least(min_chars: int, equal_chars: int | None) -> int:
    """Code points from which lines are compared at all: never fewer than 1, never more than min_chars."""
    return min_chars if equal_chars is None else max(1, min(equal_chars, min_chars))


def line_classes(docs: DataFrame, k: int = 2, min_chars: int = 40, crowded: int = 16,
                 equal_chars: int | None = None) -> DataFrame:
    """(doc, version, pos, n, keep_doc, keep_pos) per line occurrence whose class occurs more than
    once; the occurrence with doc = keep_doc and pos = keep_pos is the one that stays."""
    if k < 1 or min_chars <= 2 * (k + 1):
        raise ValueError("k must be at least 1 and min_chars over 2 * (k + 1)")
    least = _least(min_chars, equal_chars)
    lines = lines_of(docs, least)
    places = stage(lines.select("doc", "version", "pos", "n", "h", "id"), "lines")
    nodes = stage(places.groupBy("id").agg(
        F.first("h").alias("h"), F.first("n").alias("n"), F.min("doc").alias("least"),
        F.count(F.lit(1)).alias("times")), "distinct-lines")
    long = F.col("n") >= min_chars
    links = line_links(lines.filter(long), nodes.filter(long & (F.col("times") > 1)).select("h"), k, crowded)
    roots = components(links)
    # A line that stands once and has no link is no class. Classes meet lines by merge joins: a broadcast is built in the driver.
    rooted = nodes.join(roots.hint("merge"), nodes["id"] == roots["node"], "left").filter("times > 1 or root is not null").select(
        "id", "h", "least", "times", F.coalesce("root", "id").alias("root"))
    repeated = rooted.groupBy("root").agg(F.min("least").alias("keep_doc"), F.sum("times").alias("times")).filter("times > 1")
    keep = stage(rooted.select("id", "h", "root").join(
        repeated.select("root", "keep_doc").hint("merge"), "root"), "repeated-classes")
    found = _marked(places, keep.select("h")).filter("wanted").select("doc", "version", "pos", "n", "id")
    found = salted_lookup(found, keep.select("id", "root", "keep_doc"), "id", "doc").filter(F.col("keep_doc").isNotNull())
    found = stage(found.select("doc", "version", "pos", "n", "root", "keep_doc"), "repeated-places")
    first = found.filter(F.col("doc") == F.col("keep_doc")).groupBy("root").agg(F.min("pos").alias("keep_pos"))
    return salted_lookup(found, first, "root", "doc").select("doc", "version", "pos", "n", "keep_doc", "keep_pos")


def deduplicate_lines(docs: DataFrame, k: int = 2, min_chars: int = 40, crowded: int = 16,
                      equal_chars: int | None = None) -> DataFrame:
    """The input rows with the text less its removed lines, all other columns unchanged, and with
    ``line_report``: struct(lines, compared, removed, removed_chars, kept_in).

    Lines of at least min_chars meet up to k edits, shorter ones of at least equal_chars (by default
    none) only if equal. ``lines`` counts all lines, ``compared`` those of either kind, ``removed`` those taken
    out; ``kept_in`` lists the ids of the documents that hold the occurrences kept for them, in
    order. Null texts stay null and have no lines; an empty text is one empty line. Rows with a
    null doc_id stay as they are. Rows repeated with one id and text are one document and
    come out alike. Of ties the smallest document id, then the first position stays. An empty
    table gives an empty result. A column named line_report is replaced."""
    gone = line_classes(docs.select("doc_id", "text"), k, min_chars, crowded, equal_chars).filter(
        (F.col("doc") != F.col("keep_doc")) | (F.col("pos") != F.col("keep_pos")))
    per_doc = gone.groupBy("doc", "version").agg(
        F.collect_set("pos").alias("gone"), F.array_sort(F.collect_set("keep_doc")).alias("kept_in"))
    per_doc = stage(per_doc, "removed-lines")
    # The row as one value: its columns can have any name.
    row, text = F.col("row"), F.col("row.text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    # Only documents that can lose lines are shuffled, the others pass through.
    rows = _marked(rows.withColumn("_key", F.xxhash64("doc", "version")), per_doc.select(F.xxhash64("doc", "version").alias("h")), "_key")
    joined = rows.filter("wanted").join(per_doc, ["doc", "version"], "left")
    untouched = rows.filter("not wanted").withColumns({c: F.lit(None).cast(per_doc.schema[c].dataType) for c in ("gone", "kept_in")})
    rows = joined.unionByName(untouched).withColumn("parts", F.split(text, "\n"))
    # Both as columns of their own: inside a lambda an expression would be evaluated for every line.
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    rows = rows.withColumn("stay", stay)
    new = F.when(F.col("gone").isNull(), text).otherwise(
        F.array_join(F.transform("stay", lambda i: F.get("parts", i)), "\n"))
    least = _least(min_chars, equal_chars)
    compared = F.size(F.filter("parts", lambda x: F.char_length(x) >= least))
    none = F.array().cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")

    def number(of: Column) -> Column:
        return F.when(text.isNull(), 0).otherwise(F.coalesce(of, F.lit(0))).cast("long")

    report = F.struct(
        number(F.size("parts")).alias("lines"), number(compared).alias("compared"),
        number(F.when(F.col("gone").isNotNull(), F.size("gone"))).alias("removed"),
        number(F.char_length(text) - F.char_length(new)).alias("removed_chars"),
        F.coalesce("kept_in", none).alias("kept_in"))
    same = [new.alias("text") if c == "text" else row.getField(c).alias(c) for c in docs.columns if c != "line_report"]
    return rows.select(*same, report.alias("line_report"))


def drop_repeating(docs: DataFrame, **settings) -> DataFrame:
    """Documents with their removed lines taken out, in the columns of ``docs``.

    A document goes only if lines were removed from it and nothing but white space is left; all
    other documents stay with the lines they have left."""
    out = deduplicate_lines(docs, **settings)
    emptied = (F.col("line_report.removed") > 0) & ~F.col("text").rlike(r"\S")
    return out.filter(~F.coalesce(emptied, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])
