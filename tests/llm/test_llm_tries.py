"""Prefix trie against a plain one, tree contraction against recursion."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kinetable.llm import tries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    totals = {}
    for key in sorted(members, key=len, reverse=True):
        mine = (len(members[key]) - 1) * (len(WORD.findall(key[-1][1])) if key else 0)
        below = [totals[k] for k in kids.get(key, [])]
        totals[key] = (sum(t[0] for t in below) or 1, mine + sum(t[1] for t in below))
    out = []
    for key, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if whole[c] == key)))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(convs), len(key), parent, len(convs), len(kids.get(key, [])), *totals[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=150, deep=0):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 4 * n), n):
        for turn in range(r.choice([0, 1, 1, 2, 3, 5, 8]) + 1):
            rows.append((c, r.choice([turn, turn, turn, None, 2]), r.choice(["user", "assistant", None, ""]), r.choice(["hi", "hi there", "", None, "a  b\tc d"])))
    rows += [(20, t, "user", f"turn {t % 3}") for t in range(deep)]
    rows += [(None, 0, "user", "nobody"), *rows[:5]]
    return rows


@pytest.mark.parametrize(("seed", "deep"), [(1, 0), (2, 0), (3, 300)])
def test_trie_equals_the_plain_one(spark, seed, deep):
    rows = conversations(seed, deep=deep)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("node", F.lit(1))
    settings = tries.Settings(part_rows=40, slice_turns=16)  # conversations cross parts and slices
    got = sorted((tuple(r) for r in tries.trie(frame.repartition(6), settings).collect()), key=str)
    assert got == plain(rows)


def test_many_members_and_turnless_conversations(spark):
    # Conversation 40 lends its turns; those with as few turns of their own keep none.
    rows = [(40, t, "user", f"q{t}") for t in range(4)] + [(c, 0, "user", "own") for c in range(41, 60)] + [(c, 0, "user", "own") for c in range(1, 20)]
    rows += [(c * 20, t, "user", "same words here") for c in range(100, 2_000) for t in range(2)]
    got = sorted((tuple(r) for r in tries.trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == plain(rows)
    assert any(r[1] == 0 and r[3] == 1_939 for r in got)


def test_empty_table_has_no_node(spark):
    assert tries.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert tries.trie(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA)).collect() == []


def recursion(parents, values):
    order, totals, depth = list(parents), dict(values), {}

    def level(n):
        path = []
        while n is not None and n not in depth:
            path.append(n)
            n = parents[n]
        base = depth[n] if n is not None else -1
        for k, m in enumerate(reversed(path)):
            depth[m] = base + 1 + k

    for n in order:
        level(n)
    for n in sorted(order, key=depth.get, reverse=True):
        if parents[n] is not None:
            totals[parents[n]] += totals[n]
    return totals


def shapes():
    r = random.Random(7)
    yield "path", {i: i - 1 if i else None for i in range(400)}, 30
    yield "star", {i: 0 if i else None for i in range(400)}, 2
    yield "forest", {i: r.choice([None, *range(max(0, i - 6), i)]) if i > 5 else None for i in range(300)}, 30
    yield "comb", {i: (i - 2 if i % 2 == 0 else i - 1) if i else None for i in range(200)}, 30
    yield "one", {9: None}, 1


@pytest.mark.parametrize(("name", "parents", "most"), list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_contraction_equals_recursion(spark, name, parents, most):
    r = random.Random(3)
    one, two = ({n: r.randrange(100) for n in parents} for _ in range(2))
    frame = spark.createDataFrame([(n, p, one[n], two[n]) for n, p in parents.items()], "node long, parent long, a long, b long")
    rounds = []
    got = {x.node: (x.a, x.b) for x in tries.subtree_totals(frame, ["a", "b"], rounds).collect()}
    a, b = recursion(parents, one), recursion(parents, two)
    assert got == {n: (a[n], b[n]) for n in parents}
    assert len(rounds) <= most
