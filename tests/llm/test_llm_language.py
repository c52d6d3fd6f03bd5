"""Language identification against a plain context tree, and on held-out documents."""

import math
import zlib

import pandas as pd
import pytest

from kinetable.llm import language

SCHEMA = "doc_id long, text string, lang string"
A = ["the cat sat on the mat", "then the other thing that they thought", "a theme of the north", "that is this and those"]
B = ["der hund und die katze", "unter dem dach der stadt", "durch den wald und über den fluss", "und dann die stunde"]


def tree(texts, order):
    """Followers of every context of up to ``order`` bytes, by plain loops."""
    out = {}
    for text in texts:
        data = text.encode()
        for i, byte in enumerate(data):
            for k in range(min(i, order) + 1):
                followers = out.setdefault(data[i - k : i], {})
                followers[byte] = followers.get(byte, 0) + 1
    return out


def pruned(full, least):
    return {c: f for c, f in full.items() if not c or sum(f.values()) >= least}


def plain_bits(contexts, order, text):
    data, bits = text.encode(), 0.0
    for i, byte in enumerate(data):
        context = data[max(0, i - order) : i]
        while context not in contexts:
            context = context[1:]
        barred = set()
        while True:
            followers = {b: n for b, n in contexts[context].items() if b not in barred}
            total, kinds = sum(followers.values()), len(followers)
            if byte in followers:
                bits -= math.log2(followers[byte] / (total + kinds))
                break
            if followers:
                bits -= math.log2(kinds / (total + kinds))
            barred |= set(contexts[context])
            if not context:
                bits += math.log2(256 - len(barred))
                break
            context = context[1:]
    return bits


def learned(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


@pytest.mark.parametrize("order", [0, 2, 4])
@pytest.mark.parametrize("piece", [5, 1 << 15])
def test_code_lengths_are_exact(spark, monkeypatch, order, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    ids = [i for i in range(100) if learned(i)]
    rows = [(ids[k], t, lang) for k, (t, lang) in enumerate([(t, "a") for t in A] + [(t, "b") for t in B])]
    settings = language.Settings(order=order, contexts=1 << 20)
    model = language.fit(spark.createDataFrame(rows, SCHEMA), settings)
    assert model.langs == ["a", "b"]
    trees = [pruned(tree(x, order), settings.least) for x in (A, B)]
    for text in [*A, *B, "x", "the über", "QQ!", "é😀", "thethethe" * 20]:
        assert model.code_lengths(text) == pytest.approx([plain_bits(t, order, text) for t in trees], rel=1e-5)


def test_long_texts_count_as_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(language, "FLUSH", 50)
    frame = spark.createDataFrame([(" ".join(A) * 3, "a"), ("der", "b")], "text string, lang string").coalesce(1)
    got = language.follower_counts(frame, language.Settings(order=3)).toPandas()
    full = tree([" ".join(A) * 3], 3)
    mine = {(r.context.to_bytes(r.size, "big"), r.byte): r.n for r in got[got["lang"] == "a"].itertuples()}
    assert mine == {(c, b): n for c, f in full.items() for b, n in f.items()}


def test_cases_with_a_defined_result(spark):
    ids = [i for i in range(400) if learned(i)]
    rows = [(ids[k], (A if k % 2 else B)[k // 2 % 4], "en" if k % 2 else "de") for k in range(60)]
    extra = [(1000, None, "en"), (1001, "", None), (1002, "123 !? ²", None), (None, "then the other", "de"), (1003, "the thing that they thought", None), (1004, "über den fluss " * 40_000, None), (1003, "the thing that they thought", None)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    docs = docs.selectExpr("*", "1 AS score", "'x' AS h", "2 AS place")
    got = {(r.doc_id, r.lang_pred) for r in language.languages(docs, language.fit(docs)).collect() if r.doc_id is None or r.doc_id >= 1000}
    assert got == {(1000, "und"), (1001, "und"), (1002, "und"), (None, "en"), (1003, "en"), (1004, "de")}
    every = language.languages(docs, language.fit(docs)).collect()
    assert len(every) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in every)
    empty = docs.limit(0)
    assert language.languages(empty, language.fit(empty)).collect() == []
    assert {r.lang_pred for r in language.languages(docs, language.fit(empty)).collect()} == {"und"}


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    got = language.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    apart = got[got["held_out"] & (got["lang_pred"] != "und")]
    assert len(apart) > 150 and (apart["lang_pred"] == apart["lang"]).mean() > 0.97
    # Labels of held-out rows change nothing.
    blind = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    again = language.fit(blind)
    assert again.langs == model.langs and (again.bits == model.bits).all()
    assert isinstance(got, pd.DataFrame)
