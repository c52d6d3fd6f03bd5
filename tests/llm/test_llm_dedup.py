"""Duplicates: exact copies, near copies and repeated lines against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinetable.llm import exact_dedup, line_dedup, simhash
from kinetable.llm.components import components
from kinetable.llm.exact_dedup import Filter


def slow_fingerprint(text):
    words = [w for w in bytes((text or "").encode()).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_spark_hash(spark):
    texts = ["", "One", "ONE two\tthree", "Ää ÉX a b c d e", "a b c d a b c d a b", " ".join(str(i) for i in range(300)), None]
    for t in texts:
        assert simhash.fingerprint(t) % 2**64 == slow_fingerprint(t)
    assert spark.sql("select xxhash64('ää b')").first()[0] % 2**64 == xxhash.xxh64_intdigest("ää b".encode(), 42)


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)] + [(300, 301), (5, 5)]
    got = dict(components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect())
    want = roots(361, edges)
    assert got == {i: want[i] for i in range(361) if want[i] != i}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def planted(count, seed=1):
    """Random words with copies at a few changed bits, so that chains of links appear."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, size=count // 4, dtype=np.uint64)
    made = [base]
    for flips in (1, 3, 5):
        masks = np.array([sum(1 << int(b) for b in r.choice(63, flips, replace=False)) for _ in base], dtype=np.uint64)
        made.append(base ^ masks)
    return np.unique(np.concatenate(made).view(np.int64))


@pytest.mark.parametrize("tile", (64, 32_768))
def test_tiled_links_are_exact(spark, tile):
    fps = planted(1_200)
    near = np.argwhere(np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None]) <= 4)
    want = roots(len(fps), [(int(a), int(b)) for a, b in near if a < b])
    prints = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    settings = simhash.Settings(tile=tile)
    table = simhash.tiles(prints, settings).cache()
    assert sum(len(r.fps) // 8 for r in table.collect()) == len(fps)
    got = roots(len(fps), [(r.a, r.b) for r in simhash.links(table, settings).collect()])
    assert got == want and len(set(want)) < len(fps)


def test_forest_within_and_across_sub_tiles():
    fps = planted(4_000, seed=3)
    r = np.random.default_rng(0).permutation(len(fps))
    one, two = fps[r[:1500]], fps[r[1500:]]
    near = np.argwhere(np.bitwise_count(one.view(np.uint64)[:, None] ^ two.view(np.uint64)[None]) <= 4)
    want = roots(len(fps), [(int(a), int(b) + len(one)) for a, b in near])
    assert simhash.forest(one, two, 4).tolist() == want
    group = np.arange(3_000, dtype=np.int64) % 8  # many links of one group
    assert set(simhash.forest(group, None, 4)) == {0}


def test_near_duplicates_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (9, text + " x"), (7, None), (2, ""), (8, " \t "), (None, text), (4, "q r s t u v"), (4, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("rep", F.lit(0))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[3].component_id == by[9].component_id == 3 and by[None].component_id == 3
    assert by[7].component_id == by[8].component_id == 2 and by[7].fingerprint == "0" * 16
    assert by[5].fingerprint == format(slow_fingerprint(text), "016x")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "4", "None"]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_first(docs.limit(0)).collect() == []


def test_quotient_filters_lose_nothing():
    r = np.random.default_rng(5)
    parts = [r.integers(0, 2**12, size=n).astype(np.uint64) << np.uint64(43) for n in (0, 1, 500, 4_000)] + [r.integers(0, 2**55, size=3_000).astype(np.uint64)]
    whole = Filter.of(np.empty(0, np.uint64), np.empty(0, np.int64), 55)
    for p in parts:
        part = Filter.of(*np.unique(p, return_counts=True), 55)
        assert (part.values() == np.unique(p)).all()
        whole = whole.merged(Filter.from_row(part.row()))
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.values() == values).all() and (whole.counts == counts).all()


def test_exact_duplicates(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b ", "b", "", None, "long " * 50, f"own {i}"])) for i in range(300)]
    rows += [(7, "same id"), (7, "same id"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("fp", F.lit(1)).withColumn("sha", F.lit("y"))
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(x.doc_id), x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got) == want
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_one_checksum_of_two_texts_is_told_apart(spark, monkeypatch):
    """The bytes decide: with a constant in place of both hashes each text is its own group."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.lit(5).cast("long"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("s"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def slow_lines(rows):
    windows = {}
    for i, t in sorted((i, t) for i, t in rows if t is not None and i is not None):
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            windows.setdefault(tuple(ls[p : p + 3]), []).append((i, p))
    gone = {}
    for found in windows.values():
        first = min(found)
        for i, p in set(found) - {first}:
            begin = max(p, first[1] + 3) if i == first[0] else p
            gone.setdefault(i, set()).update(range(begin, p + 3))
    return gone


def test_line_dedup(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randrange(9)))) for i in range(60)]
    rows += [(100, "x\n" * 9), (101, None), (102, "one"), (103, "p\nq\nr\ns"), (104, "0\np\nq\nr\ns\n1"), (None, "p\nq\nr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1)).withColumn("removed", F.lit("z"))
    gone = slow_lines(rows)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        text = dict(rows)[row.doc_id]
        removed = sorted(gone.get(row.doc_id, ()))
        assert row.removed == ",".join(map(str, removed)) and row.n_removed == len(removed)
        assert row.text == (text if not removed else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in removed))
        assert row.n_lines == (0 if text is None else len(text.split("\n")))
    assert gone[104] == {1, 2, 3, 4} and line_dedup.dedup_lines(docs.limit(0)).collect() == []
