import tracemalloc
from collections import Counter

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomlake.llm import common, ngram_join, queries

from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    one = C.cut(C.identify_language(spark, docs, SF))
    assert one.columns == docs.columns
    kept = {r.doc_id: r for r in one.collect()}
    assert set(source) - set(kept) == {i for i, t in source.items() if not any(c.isalpha() for c in t)}
    two = C.cut(C.drop_near_duplicates(spark, one, SF))
    want = {i for i, _, c in brute([(i, r.text) for i, r in kept.items()]) if i == c}
    assert {r.doc_id for r in two.collect()} == want and two.columns == docs.columns
    three = C.cut(C.mix_sources(spark, two, SF))
    drawn = {r.doc_id: r.text for r in three.collect()}
    assert set(drawn) <= want and drawn
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    have = Counter()
    for r in C.pack_windows(spark, three, SF).collect():
        have[r.doc_id] += r.length
    assert have == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in drawn.items()}
    assert sum(have.values()) == sum(r.length for r in C.run(spark, SF).collect())


def test_stages_take_anything(spark):
    """Nulls, repeated rows, long texts, an empty table and columns of clashing names."""
    words = "the river runs under a stone bridge and nobody in town remembers who built it first".split()
    text = lambda i: " ".join(words[(i * j + j) % len(words)] + str(i % 7) for j in range(30 + i))
    rows = [(i, text(i), "en", "s%d" % (i % 3), len(text(i)), 1, "x") for i in range(40)]
    rows += [rows[3], rows[3], (None, "no id at all", None, None, None, 2, "y"), (None, None, None, None, None, 2, "y"), (90, None, "en", "s0", 0, 3, "z"), (91, "", None, "s0", 0, 3, "z"), (92, "12 !", "en", "s1", 4, 3, "z"), (93, "word " * 50_000, "en", "s1", 9, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _first int, c0 string")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in C.STAGES:
            now = C.cut(stage(spark, now, SF))
            if name != "packing":
                assert now.columns == docs.columns
                held = {r.doc_id for r in now.collect()}
                assert not held & {90, 91, 92}
                if name == "ngram_jaccard" and start is docs:
                    assert {None, 0, 3, 93} <= held
        assert start is docs or now.count() == 0


def test_queries_are_the_ten():
    assert [int(q.split("_")[0][2:]) for q in queries.QUERIES] == list(range(1, 11))
    assert [n for n, _ in C.STAGES] == ["language_id", "ngram_jaccard", "mixing", "packing"] and ngram_join.WORDS == 5


def test_weights_need_no_worker(spark):
    """A table of Python objects would be read by workers of their own, which stay on beside those of packing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for now in (docs, docs.selectExpr("doc_id", "'' as text", "lang", "source")):
        plan = C.mix_sources(spark, now, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_hashes_take_one_array():
    data = np.random.default_rng(3).integers(0, 256, 1_000_000).astype(np.uint8)
    starts, ends = np.arange(0, 999_000, 5), np.arange(0, 999_000, 5) + 7
    common.span_hashes(data, starts[:1], ends[:1])  # the powers are kept
    tracemalloc.start()
    try:
        got = common.span_hashes(data, starts, ends)
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()
    assert (got[:50] == common.span_hashes(data[:300], starts[:50], ends[:50])).all()
