"""Exact, SimHash and line deduplication against brute force, and on awkward rows."""
from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import components, exact_dedup, line_dedup, simhash_dedup
from ledgerlens.llm.hashing import majority_fingerprint

DOCS = ("doc_id long, text string, source string, keep_id string, component_id string, line_report string, id string, "
        "doc int, gone int, version int, row int, _salt int")


def docs(spark, rows):
    """Documents with further columns, some named as the operators' own."""
    return spark.createDataFrame([(i, t, "s", "x", "y", "z", "w", 1, 2, 3, 4, 5) for i, t in rows], DOCS)


AWKWARD = [(5, "a b c d"), (3, "abcd"), (3, "abcd"), (4, None), (9, ""), (8, " \t\n"), (None, "abcd"), (None, None),
           (7, "x" * 200_000), (6, "x " * 200_000), (2, "other text"), (1, "é ü"), (0, "éü")]


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("frequent", [64, 1])
def test_exact_groups_awkward(spark, frequent):
    rows = {}
    for r in exact_dedup.exact_groups(docs(spark, AWKWARD), frequent=frequent).collect():
        rows.setdefault(r.doc_id, []).append(r)
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    for i, t in AWKWARD:
        norm = (t or "").translate(strip)
        same = [(len(u or ""), j) for j, u in AWKWARD if (u or "").translate(strip) == norm]
        best = min(same, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[1]
        got = [r for r in rows[i] if r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        assert {(r.keep_id, r.group_size) for r in got} == {(best, len(same))}
    kept = [r for rs in rows.values() for r in rs if r.kept]
    assert len(kept) == len({r.text_sha256 for rs in rows.values() for r in rs})


def test_exact_hot_text_is_dealt_over_salts(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("text"))
    out = exact_dedup.exact_groups(many)
    hot = out.filter("keep_id = 0").agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.max("group_size")).first()
    assert tuple(hot) == (1334, 1, 1334)


@pytest.mark.parametrize("heavy", [1000, 1])
@pytest.mark.parametrize("segments", [2, 3, 4])
def test_links_span_the_classes_of_all_close_pairs(spark, heavy, segments):
    rng = random.Random(segments)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:12]:
        for _ in range(10):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(x - 2**64 if x >> 63 else x for x in prints)
    close = [(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    links = simhash_dedup.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, segments, heavy)
    found = [(r.u, r.v) for r in links.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
    assert groups_of(found, prints) == groups_of(close, prints)
    if heavy == 1000:
        assert sorted(tuple(sorted(p)) for p in found) == close  # every pair, once


def test_fingerprint_is_the_stated_vote():
    text = "One two\tTHREE four one two three four Ärger"
    words = "one two three four one two three four Ärger".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert majority_fingerprint(text, 3) & (2**64 - 1) == want
    assert majority_fingerprint("Two words", 3) & (2**64 - 1) == xxhash.xxh64_intdigest(b"two words", 42)
    assert majority_fingerprint(None, 3) == majority_fingerprint(" \n", 3) == 0


def test_near_duplicates_awkward(spark):
    out = {}
    for r in simhash_dedup.near_duplicates(docs(spark, AWKWARD)).collect():
        out.setdefault((r.doc_id, r.fp), []).append(r.component_id)
    prints = {i: majority_fingerprint(t, 3) for i, t in enumerate(t for _, t in AWKWARD)}
    close = [(a, b) for a, b in combinations(prints, 2) if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3]
    group = groups_of(close, prints)
    for n, (i, _) in enumerate(AWKWARD):
        ids = [AWKWARD[m][0] for m in group if group[m] == group[n] and AWKWARD[m][0] is not None]
        assert set(out[(i, prints[n])]) == {min(ids) if ids else None}
    kept = simhash_dedup.keep_one_of_each(docs(spark, AWKWARD))
    assert kept.columns == docs(spark, AWKWARD).columns
    assert kept.filter("doc_id is null").count() == 2


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert line_dedup.deduplicate_lines(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    out = components.components(links.unionByName(links))
    assert out.count() == 301 and out.agg(F.max("root")).first()[0] == 0


def test_components_of_small_tables_broadcast_nothing(spark, monkeypatch):
    """Each round's joins would be broadcasts built in the driver, as the sides are small; stars need no round."""
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(7, 7), (3, 3)]
    plans, written = [], []

    def watched(df, name, *more):
        out = components_stage(df, name, *more)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append(name)
        return out

    components_stage = components.stage
    monkeypatch.setattr(components, "stage", watched)
    # Written, so that the planner knows how small they are; ids as the operators' (digests, numbers).
    links = components_stage(spark.createDataFrame([(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in pairs], "u binary, v binary"), "t")
    got = {(bytes(r["node"]), bytes(r["root"])) for r in components.components(links).collect()}
    ends = {x for a, b in pairs if a != b for x in (a, b)}
    expected = groups_of([(a, b) for a, b in pairs if a != b], ends)
    least = {}
    for n, g in expected.items():
        least[g] = min(n, least.get(g, n))
    assert got == {(f"{n:03}".encode(), f"{least[g]:03}".encode()) for n, g in expected.items()}
    assert len(written) > 2 and not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
    written.clear()
    stars = spark.createDataFrame([(0, 5), (5, 0), (0, 6), (8, 1), (1, 9), (4, 4)], "u long, v long")
    assert {tuple(r) for r in components.components(stars).collect()} == {(0, 0), (5, 0), (6, 0), (1, 1), (8, 1), (9, 1)}
    assert len(written) == 1


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_automaton(spark, k):
    rng = random.Random(k)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        rows.append((a, "".join(b), list(a), [c for c in "".join(b)]))
    df = spark.createDataFrame(rows, "a string, b string, x array<string>, y array<string>")
    for r in df.select("a", "b", line_dedup.within_edits(F.col("x"), F.col("y"), k).alias("near")).collect():
        assert r.near == (distance(r.a, r.b) <= k)


def changed(rng, line, edits):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + rng.randint(0, 1)] = rng.choice(["", "q", "ß"])
    return "".join(out)


@pytest.mark.parametrize("crowded", [16, 1])
def test_line_classes_against_brute_force(spark, crowded):
    rng = random.Random(crowded)
    bases = ["".join(rng.choice("abcde ") for _ in range(rng.randint(20, 40))) for _ in range(12)]
    lines = [changed(rng, rng.choice(bases), rng.randint(0, 3)) for _ in range(90)] + bases[:3] * 3
    rows = [(i, "\n".join(lines[i * 9:i * 9 + 9])) for i in range(11)]
    places = [(i, p, line) for i, t in rows for p, line in enumerate(t.split("\n")) if len(line) >= 20]
    close = [(a, b) for a, b in combinations(range(len(places)), 2) if distance(places[a][2], places[b][2]) <= 2]
    group = groups_of(close, range(len(places)))
    gone = {places[n][:2] for n in group if group[n] != n}
    out = line_dedup.deduplicate_lines(docs(spark, rows), k=2, min_chars=20, crowded=crowded).collect()
    for r in out:
        text = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for p, x in enumerate(text) if (r.doc_id, p) not in gone)
        mine = {places[group[n]][0] for n in group if places[n][0] == r.doc_id and group[n] != n}
        assert r.line_report.kept_in == sorted(mine)
        assert r.line_report.removed == sum(i == r.doc_id for i, _ in gone)


def test_line_dedup_awkward(spark):
    long = "a line that is long enough to be compared with others"
    rows = [(2, long), (1, f"{long}\nshort\n{long}\nshort"), (1, f"{long}\nshort\n{long}\nshort"), (3, None), (4, ""),
            (None, long), (5, "y" * 200_000), (6, "y" * 200_001), (7, "short\n" * 20_000)]
    out = line_dedup.deduplicate_lines(docs(spark, rows))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.line_report.removed))
    assert got[1] == [(f"{long}\nshort\nshort", 1)] * 2
    assert got[2] == [("", 1)] and got[3] == [(None, 0)] and got[4] == [("", 0)] and got[None] == [(long, 0)]
    assert got[5] == [("y" * 200_000, 0)] and got[6] == [("", 1)] and got[7] == [("short\n" * 20_000, 0)]
    assert out.columns == [c for c in docs(spark, rows).columns if c != "line_report"] + ["line_report"]
    kept = line_dedup.drop_repeating(docs(spark, rows).drop("line_report"))
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 1, 3, 4, 5, 7]


def test_short_lines_meet_their_equals(spark):
    long = "a line of more than twenty characters"
    rows = [(1, f"MIT License.\n\n{long}\nown"), (2, f"MIT License.\n\n{long[:-1]}\nMIT License"), (3, "own\nMIT License.")]
    out = line_dedup.deduplicate_lines(docs(spark, rows), k=2, min_chars=20, equal_chars=1)
    got = {r.doc_id: (r.text, r.line_report.compared, r.line_report.removed) for r in out.collect()}
    assert got == {1: (rows[0][1], 3, 0), 2: ("\nMIT License", 3, 2), 3: ("", 2, 2)}


def test_production_compares_all_lines(spark, tmp_path):
    from ledgerlens.llm.queries import REGISTRY
    rows = [(1, "MIT License.\n\nown words"), (2, "MIT License.\nother words")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = REGISTRY["op10_line_dedup"][0](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.compared, r.removed) for r in out} == {1: (2, 0), 2: (2, 1)}


def test_documents_with_text_left_stay(spark):
    long = "a line that is long enough to be compared with others " * 4
    rows = [(1, long), (2, f"{long}\nnowhere else"), (3, f"{long}\n \n")]
    kept = line_dedup.drop_repeating(docs(spark, rows).drop("line_report"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, long), (2, "nowhere else")]


def test_operators_stay_native(spark):
    frame = docs(spark, AWKWARD)
    for out in (exact_dedup.exact_groups(frame), line_dedup.deduplicate_lines(frame)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_exact_groups_come_from_neighbours_in_one_range_sort(spark):
    """Every group, also one of many rows, is one stretch of the sort; its text is not dealt by a digest or a hash."""
    texts = [f"{'same beginning ' * 9}{i % 700}" for i in range(1500)] + ["hot"] * 900
    entries = spark.createDataFrame([(i, len(t), 1, t, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)],
                                    "id long, n int, size long, norm string, sha string").repartition(6)
    out = exact_dedup.sorted_groups(entries)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(head") == 1 and "hashpartitioning" not in plan
    first = {r.keep_id: r.group_size for r in out.filter("place = 1").collect()}
    assert len(first) == 701 and first[1500] == 900 and first[0] == 3
    whole = exact_dedup.exact_groups(entries.select(F.col("id").alias("doc_id"), F.col("norm").alias("text")), frequent=2)
    got = {(r.keep_id, r.group_size) for r in whole.filter("kept").collect()}
    assert got == set(first.items()) and whole.count() == 2400
    hot = exact_dedup.stage  # the frequent text itself is at most ENTRIES entries
    sizes = []
    try:
        exact_dedup.stage = lambda df, name: sizes.append((name, df.count())) or hot(df, name)
        exact_dedup.exact_groups(entries.select(F.col("id").alias("doc_id"), F.col("norm").alias("text"))).count()
    finally:
        exact_dedup.stage = hot
    assert dict(sizes)["content-sort"] <= 1500 + exact_dedup.ENTRIES and dict(sizes)["frequent-rows"] == 900


def variants(rng, lengths, alphabets, k):
    """(table of different lines, pairs of them at most k edits apart): variants of random lines, which are far from each other."""
    families = [[base] + [changed(rng, base, rng.randint(1, k)) for _ in range(5)] for n in lengths for alphabet in alphabets
                for base in ["".join(rng.choice(alphabet) for _ in range(n))]]
    families = [sorted({x for x in f if len(x) >= 18}) for f in families]
    number = {x: i for i, x in enumerate(sorted({x for f in families for x in f}))}
    near = {tuple(sorted((number[a], number[b]))) for f in families for a, b in combinations(f, 2) if distance(a, b) <= k}
    return [(i, len(x), x) for x, i in number.items()], near


@pytest.mark.parametrize("k", [1, 2, 3])
def test_line_dedup_makes_few_probes_and_misses_no_pair(spark, k):
    lengths = [20, 23, 24, 25, 33, 47, 48, 62, 63, 64, 65, 66, 79, 80, 81, 82]
    rows, near = variants(random.Random(k), lengths, ("abcdefgh", "abcdéß日𝄞"), k)
    texts = spark.createDataFrame(rows, "h long, n int, line string").repartition(4)
    own, probes = ([(r.h, r.key) for r in line_dedup._line_keys(texts, k, kind).collect()] for kind in (True, False))
    if k == 2:
        assert len(probes) < 5 * len(rows)  # nine a line before
    holders, met = {}, set()
    for h, key in own:
        holders.setdefault(key, set()).add(h)
    for h, key in own + probes:
        met |= {tuple(sorted((h, other))) for other in holders.get(key, ())}
    assert len(near) > 100 and near <= met


def test_bitmap_words_are_full_and_exact(spark):
    """Every bit of a broadcast word is used, the sign bit too: the driver holds 8 bytes for 64 bits."""
    bits = 1 << 16
    rng = random.Random(3)
    wanted = {*range(0, 64), 32767, 32768, bits - 1, *(rng.randrange(bits) for _ in range(500))}
    keys = spark.createDataFrame([(h - (bits if h % 2 else 0),) for h in wanted], "h long")
    found = line_dedup._bitmap(keys, bits).collect()
    assert len(found) == 2 and {len(r["words"]) for r in found} == {32768 // 64}
    assert sum(bin(w & (1 << 64) - 1).count("1") for r in found for w in r["words"]) == len(wanted)
    full = line_dedup.bitmap_bits(len(wanted))
    rows = spark.range(0, bits + 4096).select(F.col("id").alias("h")).unionByName(keys)
    slots = {h % full for h in (r["h"] for r in keys.collect())}
    marked = line_dedup._marked(rows, keys).collect()
    assert len(marked) == bits + 4096 + len(wanted)
    assert all(r["wanted"] == (r["h"] % full in slots) for r in marked)
