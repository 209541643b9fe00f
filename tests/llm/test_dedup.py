"""Exact and near duplicates against brute force, and the cases that each operator defines."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelftally.llm import exact_dedup, simhash
from shelftally.llm.components import components

DOCS = "doc_id long, text string, lang string, kept string, id long, print long"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "clash", 7, 7) for i, t in rows], DOCS)


def plain(text):
    return "".join(c for c in text or "" if c not in "\t\n\x0b\x0c\r ")


def test_exact_groups(spark):
    rows = [(5, "a b"), (4, "ab"), (3, " a b "), (2, None), (9, ""), (8, "\n \t"), (7, "nbsp x"), (6, "nbspx"), (None, "abc"), (1, "abc")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [got[i]["keep_id"] for i in (5, 4, 3)] == [3, 3, 3] and got[3]["kept"] and not got[4]["kept"]
    assert {got[i]["keep_id"] for i in (2, 8, 9)} == {8}
    assert got[7]["group_size"] == 1
    assert got[None]["keep_id"] == 1 and not got[None]["kept"]
    assert got[5]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_exact_repeated_rows_keep_one(spark):
    got = exact_dedup.exact_duplicates(docs(spark, [(1, "x")] * 3 + [(None, "y")] * 2)).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in got) == [(0, False), (0, True), (1, False), (1, False), (1, True)]
    left = exact_dedup.drop_duplicates(docs(spark, [(1, "x")] * 3 + [(None, "y")] * 2))
    assert left.count() == 2 and left.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(docs(spark, [])).count() == 0


def test_exact_survivors_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    best = {}
    for r in rows.collect():
        key, rank = plain(r["text"]), (-len(r["text"]), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    assert {r["doc_id"] for r in exact_dedup.drop_duplicates(rows).collect()} == {i for _, i in best.values()}


def test_cuckoo_insert_delete_resize():
    index, live, rng = exact_dedup.CuckooIndex(16), set(), random.Random(1)
    before = index.buckets
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for step in range(20000):
        d = rng.choice(digests)
        if rng.random() < 0.6:
            index.put(d, step)
            live.add(d)
        else:
            assert index.delete(d) == (d in live)
            live.discard(d)
    assert index.buckets > before
    assert index.size == len(live) and {d for d, _ in index.items()} == live
    assert all((d in index) == (d in live) for d in digests)


def test_cuckoo_same_fingerprint_is_verified():
    index = exact_dedup.CuckooIndex(16)
    a, b = b"\0" * 10 + b"a" * 22, b"\0" * 10 + b"b" * 22
    index.put(a, 1)
    assert b not in index
    for n in range(40):  # more of one fingerprint than two buckets hold
        index.put(b"\0" * 10 + bytes([n]) * 22, n + 2) if n < 7 else None
    assert a in index and index.delete(a) and a not in index


def test_standing_index(spark):
    rows = spark.range(300).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    index = exact_dedup.build_index(rows, 4)
    changes = rows.limit(0).withColumn("live", F.lit(True)).unionAll(
        spark.range(290, 310).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)), F.col("id") >= 300)
    )
    index = exact_dedup.update_index(index, changes, 4)
    asked = spark.range(400).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    assert exact_dedup.probe_index(index, asked, 4).count() == 300


def bits_of(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints):
    """doc -> smallest id, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r["doc_id"]: bits_of(r["text"]) for r in rows.collect()}
    want = reachable(prints)
    got = simhash.near_duplicates(rows).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.drop_near_duplicates(rows)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_near_duplicates_defined_cases(spark):
    rows = [(3, None), (2, ""), (4, " \n"), (None, "a b c d"), (6, "A B  c\td"), (7, "one two"), (7, "one two"), (9, "x" * 300_000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    found = defaultdict(set)
    for r in got:
        found[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert found[3] == found[2] == found[4] == {("0" * 16, 2)}
    assert {c for _, c in found[None]} == {6}
    assert found[7] == {(f"{bits_of('one two'):016x}", 7)}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(docs(spark, rows)).count() == 4


def test_every_component_keeps_a_row_whatever_its_ids(spark):
    """Unrelated texts without an id, and one id on unrelated texts, are components of their own."""
    near = "the cat sat on the mat and looked at the dog"
    rows = [(None, "one quite lonely text"), (None, "another sort of words entirely"), (None, near), (6, near.upper()), (5, "first text of five"), (5, "something else that five has"), (5, "something else that five has"), (0, "zero is an id")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([*rows[:2], *rows[3:6], rows[7]], key=repr)


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_with_full_lists(spark, monkeypatch, tile):
    """Many prints that share blocks: lists are split into cells, and no link is lost."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            p = base
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(20)
            prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = reachable({s: s & (1 << 64) - 1 for (s,) in signed})
    frame = spark.createDataFrame(signed, "print long")
    found = {r["node"]: r["component"] for r in components(simhash.links(frame).toDF("a", "b")).collect()}
    assert {s: found.get(s, s) for (s,) in signed} == want


def test_compare_tiles():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 12, 2500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 2500).astype(np.uint64)) for b in base]))
    a, b = simhash.compare(prints, np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64))
    forest = simhash.Forest(len(prints))
    forest.join(a, b)
    whole = simhash.Forest(len(prints))
    for i in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2)
        whole.join(np.full(len(near), i), near)
    assert np.array_equal(forest.parent, whole.parent)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (60, 60)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[100] == 50 and {got[200 + i] for i in range(30)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
