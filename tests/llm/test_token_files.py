import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from loomlake.llm import token_files as T
from loomlake.llm.queries import vocabulary


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    for high in (1, 2, 300, 50_000, 2**32):
        ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        if n > 10:
            ids[r.integers(0, n, 5)] = 2**32 - 1
        for percentile in (0.01, 0.5, 0.9, 1.0):
            assert (T.decode_blocks(b"".join(T.encode_blocks(ids, percentile))) == ids).all()


def test_block_layout():
    """Minimum 7, differences 0 to 3 in two bits, and one exception."""
    ids = np.array([7, 8, 9, 10] * 16, np.uint32)
    ids[5] = 7 + 1000
    (block,) = T.encode_blocks(ids, 0.9)
    assert T._HEAD.unpack_from(block) == (64, 1, 2, 7) and len(block) == T._HEAD.size + 16 + 6
    words = np.frombuffer(block, "<u8", 2, T._HEAD.size)
    bits = int(words[0]) | int(words[1]) << 64
    assert [bits >> 2 * i & 3 for i in range(64)] == [(x - 7) & 3 for x in ids.tolist()]
    assert np.frombuffer(block, "<u2", 1, T._HEAD.size + 16)[0] == 5 and np.frombuffer(block, "<u4", 1, T._HEAD.size + 18)[0] == 1000 >> 2


def test_spans_and_documents():
    r = np.random.default_rng(1)
    docs = [(i if i != 3 else None, r.integers(0, 70_000, n).astype(np.uint32)) for i, n in enumerate([1, 5000, 1, 20_000, 1, 1024, 300_000, 3])]
    out = io.BytesIO()
    w = T.Writer(out)
    for d in docs:
        w.document(*d)
    assert w.close() == len(out.getvalue())
    reader = T.Reader(pa.BufferReader(out.getvalue()))
    flat = np.concatenate([x for _, x in docs])
    for a, b in [(0, 0), (0, 1), (1023, 1025), (4000, 27_000), (len(flat) - 1, len(flat)), (0, len(flat) + 9)]:
        assert (reader.span(a, b) == flat[a:b]).all()
    for some in (1, 3000, 1 << 20):
        got = list(reader.documents(some))
        assert [x[0] for x in got] == [d[0] for d in docs] and all((x[2] == d[1]).all() for x, d in zip(got, docs))
        assert [x[1] for x in got] == [0, *np.cumsum([len(x) for _, x in docs])[:-1].tolist()]


def test_written_files(spark, tmp_path):
    texts = [None, "", "Hello, world", "é ü " * 20, "x" * 70_000, "<|endoftext|> a", "b\r\n c"]
    rows = [(None if i % 11 == 0 else 5 if i % 3 == 0 else i, texts[i % 7], i) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    manifest = T.write(df, vocabulary(), f"file://{tmp_path}/ids", file_ids=100_000)
    got = T.read(manifest).orderBy("start").collect()
    tok = tokenizers.Tokenizer.from_file(vocabulary())
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in rows]
    assert len(got) == 90 and manifest.count() > 1
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted((x[0] for x in rows), key=lambda i: (i is not None, i or 0))
    crc = lambda d, ids: (-1 if d is None else d, zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(crc(r.doc_id, np.frombuffer(r.ids, "<u4")) for r in got) == sorted(crc(d, w) for (d, _, _), w in zip(rows, want))
    again = T.read(T.write(df.repartition(2), vocabulary(), f"file://{tmp_path}/again"))
    assert sorted(map(tuple, again.select("doc_id", "start", F.crc32("ids")).collect(), ), key=repr) == sorted(((r.doc_id, r.start, zlib.crc32(r.ids)) for r in got), key=repr)
    first = manifest.orderBy("start").first()
    with open(first.path.removeprefix("file://"), "rb") as f:
        assert f.read(8) == T.MAGIC


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.read(T.write(df, vocabulary())).count() == 0
