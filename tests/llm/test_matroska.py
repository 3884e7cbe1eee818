import hashlib
import os
import zlib

import pytest

from loomlake.llm import matroska as M


@pytest.mark.parametrize("n", [64, 512, 576, 4096, 4160, 40000 * 64 // 64 * 64, 1 << 20])
def test_round_trip(n):
    payload = os.urandom(n)
    data = M.write_pcm(payload)
    m = M.parse(data)
    assert m.error is None and m.doc_type == "matroska" and m.tracks[0]["codec"] == "A_PCM/INT/LIT"
    assert b"".join(data[a : a + k] for *_, a, k in m.packets) == payload
    times = [p[1] for p in m.packets]
    assert times == [i * 64_000_000 for i in range(len(times))]
    assert [m.segment + c["cluster"] for c in m.cues] == m.clusters


@pytest.mark.parametrize("kind", [M.NONE, M.XIPH, M.FIXED, M.EBML_LACING])
def test_lacing(kind):
    frames = [b"a" * 300, b"b" * 300] if kind == M.FIXED else [b"x"] if kind == M.NONE else [b"a" * 255, b"", b"c" * 1000, b"d" * 3, b"e" * 700]
    body = M.lace(frames, kind)
    assert [body[a : a + n] for a, n in M.unlace(body, 0, len(body), kind)] == frames


def test_unknown_sizes_groups_and_faults():
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, b"\x81\x00\x05\x00abc") + M.element(M.REFERENCE, b"\x01"))
    cluster = bytes.fromhex("1f43b675") + b"\x01" + b"\xff" * 7
    body = cluster + M.uint(M.TIMESTAMP, 7) + group + cluster + M.uint(M.TIMESTAMP, 9) + M.element(0xEC, b"void") + M.element(M.SIMPLE_BLOCK, b"\x82\xff\xff\x80z")
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + body
    m = M.parse(data)
    assert m.error is None and len(m.clusters) == 2
    assert [(p[0], p[1], p[2], data[p[6] : p[6] + p[7]]) for p in m.packets] == [(1, 12_000_000, False, b"abc"), (2, 8_000_000, True, b"z")]
    cut = M.parse(M.write_pcm(bytes(9000))[:-400])
    assert cut.error
    assert M.parse(b"").packets == [] and M.parse(b"\x00junk").error


def test_rows(spark):
    texts = [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (None, "x" * 200_000)]
    df = spark.createDataFrame([(*t, b"clash") for t in texts], "doc_id long, text string, media binary")
    rows = M.media_features(M.text_media(df)).collect()
    assert len(rows) == 5
    for r in rows:
        t = next((t or "").encode() for i, t in texts if i == r.doc_id)
        p = M.pad(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert M.packet_table(M.text_media(df), "doc_id", "media").where("id = 3").count() == 2
    assert M.media_features(M.text_media(df.limit(0))).count() == 0


def test_deep_nesting_and_faults_without_packets(spark):
    deep = bytes([0xA0, 0x01, *[0xFF] * 7]) * 20_000
    m = M.parse(deep)
    assert m.packets == []
    body = b""
    for _ in range(1500):
        body = M.element(M.CUE_POINT, body)
    assert M.parse(body).error is None and len(M.parse(body).cues) == 1500
    df = spark.createDataFrame([(1, b"\x00junk"), (2, bytearray(M.write_pcm(bytes(64)))), (3, None), (4, b"")], "id long, media binary")
    rows = {r.id: r for r in M.packet_table(df, "id", "media").collect()}
    assert rows.keys() == {1, 2} and rows[1].error and rows[1].track is None and rows[2].error is None


def test_hostile_numbers_are_errors(spark):
    """Numbers that no column holds, and files with bytes changed: rows with an error, and never a failure."""
    import random

    from loomlake.llm import matroska as M

    block = lambda track, time: M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.TIMESTAMP, time) + M.element(M.SIMPLE_BLOCK, M.vint(track) + b"\0\0\x80" + b"abc")))
    head = M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska"))
    big = (2**63 - 1).to_bytes(8, "big")
    files = [head + block(2**40, b"\1"), head + block(1, big), head + block(1, b"\1" * 9), head + block(1, b"\1")]
    files += [head + M.element(M.SEGMENT, M.element(M.INFO, M.element(M.SCALE, big)) + block(1, b"\1" * 7)[5:])]
    r, good = random.Random(0), M.write_pcm(bytes(range(256)) * 40)
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(4):
            bad[r.randrange(len(bad)) if r.random() < 0.5 else r.randrange(200)] = r.randrange(256)
        files.append(bytes(bad))
    got = M.packet_table(spark.createDataFrame(list(enumerate(files)), "i long, media binary"), "i", "media").collect()
    by = {}
    for x in got:
        by.setdefault(x.id, []).append(x)
    assert all(by[i][0].error for i in (0, 1, 2)) and by[3][0].error is None and by[3][0].timestamp_ns == 1_000_000
    assert all(by[i][0].error == M.parse(f).error for i, f in enumerate(files) if i in by)
