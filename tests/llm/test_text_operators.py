"""Licence scan, packing, BPE, toxicity and fingerprints against the libraries and brute force."""
from __future__ import annotations

import random
import re
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from ledgerlens.llm import bpe, fingerprints, license_scan, packing, toxicity
from ledgerlens.llm.queries import REGISTRY

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [(1, None), (2, ""), (3, "The MIT License"), (3, "The MIT License"), (None, "cc by CC BY"), (5, "word " * 60_000),
           (6, "x" * 5_000), (7, "日本 ½ İ ﬁ <|endoftext|> it's\x1c don't "), (8, "\n \t")]


def frame(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "a", 1.0, "b") for i, t in rows],
                                 "doc_id long, text string, id string, score double, labels string")


def odd_texts(n):
    rng = random.Random(n)
    pool = [chr(x) for x in (*range(0, 600), 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF, 0x65E5, 0x1F600, 0x301, 0x660)]
    pool += ["<|endoftext|>", "<|startoftext|>", "'ll", "  ", "\n\n", " a", "the "] * 20
    return ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(n)] + ["", "a" * 3000, " " * 500]


def test_bpe_equals_the_library():
    own, lib = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    for t in odd_texts(800):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_rows(spark):
    coded = bpe.encode(frame(spark), BYTE)
    back = Counter((r.doc_id, r.text) for r in bpe.decode(coded, BYTE).collect())
    assert back == Counter((i, t or "") for i, t in AWKWARD)
    digests = bpe.round_trip(frame(spark), BYTE).join(coded.dropDuplicates(["doc_id"]), "doc_id").select(
        "n_tokens", F.size("ids").alias("n"), "ids_sha256", F.sha2(F.array_join("ids", ","), 256).alias("s"))
    assert all(r.n_tokens == r.n and r.ids_sha256 == r.s for r in digests.collect())
    assert bpe.round_trip(frame(spark, []), BYTE).count() == 0


def test_word_tokenizer_equals_the_library():
    own, lib = packing.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    for t in odd_texts(800):
        assert array("I", own.ids(t)).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark):
    rows = packing.pack(frame(spark), WORD, with_ids=True).collect()
    lib = Tokenizer.from_file(WORD)
    docs = Counter()
    for i, t in AWKWARD:
        docs[(i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    parts, used = {}, {}
    for r in rows:
        ids = array("I", list(r.ids))
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (i, ids), times in docs.items():
        found = sorted(parts[(i, len(ids))])
        assert [x for _, p in found[::times] for x in p] == list(ids) and len(found) % times == 0
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(frame(spark, []), WORD).count() == 0


def test_shortest_pack_first_keeps_the_histogram():
    rng = random.Random(3)
    histogram = dict(Counter(rng.randint(1, 64) for _ in range(5000)))
    patterns = packing.shortest_pack_first(histogram, 64)
    assert all(sum(p) <= 64 for _, p in patterns)
    found = Counter()
    for n, p in patterns:
        for length in p:
            found[length] += n
    assert found == histogram
    assert sum(n * 64 for n, _ in patterns) < 1.05 * sum(k * v for k, v in histogram.items())
    spans = {}
    for length, low, high, _, _, _ in packing.places(patterns):
        spans.setdefault(length, []).append((low, high))
    for length, found in spans.items():
        assert found[0][0] == 0 and found[-1][1] == histogram[length]
        assert all(a[1] == b[0] for a, b in zip(found, found[1:]))


def test_license_base_counts_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in REGISTRY["op1_license_scan"][0](spark, SF_SMALL).collect():
        low = "".join(c.lower() if c.isascii() else c for c in texts[r.doc_id])
        words, starts, labels = word.findall(low), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_fuzzy_spans(spark):
    text = "Ünrelated. Licensed under teh Apache-Licence, and al rights reserved."
    rows = license_scan.scan(frame(spark, [(1, text), (2, "emit licensed things and rights"), (3, None)])).collect()
    found = {n.label: text[n.start:n.end] for n in rows[0].notices}
    assert found["apache"] == "Licensed under teh Apache-Licence" and found["all-rights-reserved"] == "al rights reserved"
    assert rows[0].base_labels == "" and 0 < rows[0].score < 1
    assert rows[1].labels == "" and rows[1].score == 0 and rows[2].n_words == 0 and rows[2].first_word is None
    notice = license_scan.Notice.of("x", "all rights reserved")
    rng = random.Random(5)
    for _ in range(300):  # any variant within the bound is found
        s = list("all rights reserved")
        s[rng.randrange(1, 18)] = rng.choice(["", "q", "qq"[:1]])
        assert license_scan.notice_spans(("x " + "".join(s) + " y").encode(), notice)


@pytest.mark.parametrize("edited", ["gnu genral public license", "gnu generl publc license", "gnu general public license"])
def test_license_notices_close_together(edited):
    """Every notice of a window is found, wherever the one with the fewest edits stands."""
    notice = license_scan.Notice.of("gpl", "gnu general public license")
    exact = "gnu general public license"
    for parts in ([edited, exact], [exact, edited], [edited, "gnu generl publc license", exact, edited], [edited] * 400):
        words, spans, at = " or ".join(parts).encode(), [], 0
        for p in parts:
            spans.append((at, at + len(p)))
            at += len(p) + 4
        assert [x[:2] for x in license_scan.notice_spans(words, notice)] == spans


def test_license_overlapping_places():
    assert license_scan.phrase_places(b"cc by cc by by cc by", b"cc by") == [0, 2, 5]
    assert license_scan.phrase_places(b"a a a", b"a a") == [0, 1]


def test_toxicity_held_out(spark):
    out = REGISTRY["op8_toxicity"][0](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    # About a tenth of these toxic rows are junk pages without a word of their toxic text left.
    assert auc > 0.94
    assert sum(r.predicted == r.toxic for r in rows) > 0.97 * len(rows)


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(3, 1), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    out = toxicity.score_documents(frame(spark), labels).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score_documents(frame(spark), none).collect()} == {0}
    assert toxicity.score_documents(frame(spark, []), labels).count() == 0
    assert toxicity.keep_clean(frame(spark), none).columns == frame(spark).columns


def test_toxicity_fold_is_crc32(spark):
    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_compare_with_next_against_brute_force(spark):
    rows = AWKWARD + [(i, f"text number {i} " * (i % 7)) for i in range(20, 60)]
    once = list(dict.fromkeys(rows))
    by_hash = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in once], "t string").distinct().select(
        "t", F.xxhash64("t")).collect()}
    once = sorted({(i, t or "") for i, t in once}, key=lambda r: (r[0] is None, -(r[0] or 0), by_hash[r[1]]))
    times = Counter((i, t or "") for i, t in rows)
    want = Counter()
    for n, (i, t) in enumerate(once):
        follow = once[(n + 1) % len(once)][1]
        fp = fingerprints.weighted_fingerprint
        new = t[:len(t) - len(t) // 2] + follow[:len(t) // 2]
        want[(i, len(t), fp(t), fp(new), fingerprints.likeness(fp(t), fp(new)), fingerprints.likeness(fp(t), fp(follow)))] += times[(i, t)]
    out = fingerprints.compare_with_next(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.fp, r.edited_fp, r.near_edited, r.near_next) for r in out) == want
    assert fingerprints.compare_with_next(frame(spark, [])).count() == 0
    assert fingerprints.compare_with_next(frame(spark, [(1, "a b c d")])).first().near_next == 1.0


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_neighbours_against_brute_force(spark, blocks):
    rng = random.Random(blocks)
    prints = {rng.getrandbits(63) for _ in range(80)}
    for base in list(prints)[:20]:
        prints |= {base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(6)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = sorted((r.q, r.fp) for r in fingerprints.neighbours(df.select(F.col("fp").alias("q")), df, 3, blocks).collect())
    assert found == sorted((a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 3)


@pytest.mark.parametrize("text, labels", [
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"),
    ("Licensed under CC BY-ND 4.0", "cc-by"), ("Licensd under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0.", "cc-by,cc-by-nc,cc-by-sa"),
    ("Licensed under the GNU General Public License version 2", "gpl"),
    ("Licensed under the GNU General Public License, version 3", "gpl,gpl-3"),
    ("Licenced under the GNU Generl Public License, version 3", "gpl,gpl-3"),
    ("Licensed under the Apache License, Version 1.1", "apache"), ("Licensed under the Apache License, Version 2.0", "apache,apache-2"),
    ("released under the BSD license", ""), ("released under the ISC license", ""), ("released under the X11 license", ""),
    ("relased under the MIT license", "mit"), ("the GNU Lesser General Public License", "lgpl"),
    ("subject to the terms of the Eclipse Public License", ""), ("subject to the term of the Mozilla Public License", "mpl-2")])
def test_license_labels_of_neighbours(text, labels):
    phrases = [(p.encode(), label) for p, label in license_scan.PHRASES]
    notices = [license_scan.Notice.of(*n) for n in license_scan.NOTICES]
    assert license_scan._scan("Intro. " + text + " and more words", phrases, notices)[5] == labels
