"""Fill-in-middle against regular expressions and plain slicing."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", " a", "a ", "\t\n", "a b  c\r\nd ", "é😀 ü x", "x<P>y z", "a<M", "b<<S>", "< P> <S <M >P>", "\x1f\x85 \x0b"]


def noise(seed, n=300, alphabet="ab \n\té😀<>PSM"):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(r.randrange(n)))


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted(x % (len(tokens) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    pre, mid, suf = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(tokens), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("text", [*TEXTS, *map(noise, range(30))])
def test_tokens_are_those_of_the_pattern(text, monkeypatch):
    monkeypatch.setattr(infill, "PIECE", 7)  # borders of pieces fall everywhere
    assert infill.token_widths(text).tolist() == [len(t) for t in TOKEN.findall(text)]


@pytest.mark.parametrize("size", [0, 1, 4, 5, 63, 1000, 50_000])
def test_skip_list_reaches_every_rank(size):
    widths = np.random.default_rng(size).integers(1, 9, size)
    found = infill.SkipList(widths)
    ends = np.concatenate([[0], np.cumsum(widths)])
    for rank in {0, size, *np.random.default_rng(1).integers(0, size + 1, 200).tolist()}:
        assert found.find(rank) == ends[rank]
    with pytest.raises(IndexError):
        found.find(size + 1)
    for units, chars, below in found.lanes[1:]:  # links of a lane span what lies below them
        assert len(units) == len(chars) == len(below) and (np.diff(below) > 0).all()
    assert len(found.lanes) <= 2 + 2 * np.log(max(2, size))


def test_every_text_comes_back(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, *map(noise, range(60)), "word " * 100_000])] + [(None, "no id here"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("output", F.lit(1))
    made = infill.fill_in_middle(docs)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key) == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_digest_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = infill.digest(infill.fill_in_middle(docs))
    assert got.collect() == [] and got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
