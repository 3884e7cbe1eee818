import io
import random
import struct
import zipfile

import pytest

from loomlake.sources import archives as A


def make(path, members, **kw):
    with zipfile.ZipFile(path, "w", **kw) as z:
        for name, data in members.items():
            z.writestr(name, data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("zips")
    r = random.Random(0)
    want = {}
    for i in range(200):
        members = {f"d{k}/f{k}-é.txt": bytes(r.choices(b"ab \n", k=r.randrange(2000))) for k in range(r.randrange(6))}
        sub = at / f"s{i % 3}"
        sub.mkdir(exist_ok=True)
        make(sub / f"set-{i}.zip", members | {"empty/": b""}, compression=r.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
        want |= {(f"set-{i}", n): d for n, d in members.items()}
    make(at / "other.zip", {"x": b"1"})
    return at, want


def stem(path):
    return path.rsplit("/", 1)[1][:-4]


def test_members_and_contents(spark, folder):
    at, want = folder
    members = A.zip_members(spark, str(at), "set-")
    assert {(stem(r.archive), r.name): r.size for r in members.collect()} == {k: len(v) for k, v in want.items()}
    got = A.member_contents(members).collect()
    assert {(stem(r.archive), r.name): bytes(r.content) for r in got} == want and not any(r.error for r in got)
    some = A.member_contents(members.where("name like 'd0/%'"))
    assert some.count() == sum(n.startswith("d0/") for _, n in want)


def test_one_archive_over_many_tasks(spark, tmp_path):
    make(tmp_path / "one.zip", {f"f{i:05d}": f"{i}" * 50 for i in range(3000)}, compression=zipfile.ZIP_DEFLATED)
    got = A.member_contents(A.zip_members(spark, str(tmp_path)), tasks=6)
    assert got.rdd.getNumPartitions() == 6
    assert {r.name: bytes(r.content).decode() for r in got.collect()} == {f"f{i:05d}": f"{i}" * 50 for i in range(3000)}


def test_64_bit_records(spark, tmp_path):
    """A directory whose counts, sizes and places stand in the 64-bit records alone."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"w" * 999)
        z.writestr("b", b"bb")
    data = buf.getvalue()
    at = data.rindex(A.END)
    _, _, _, _, count, size, place, _ = A._END.unpack_from(data, at)
    directory = bytearray(data[place : place + size])
    sign, *rest = A._ENTRY.unpack_from(directory, 0)
    name_end = A._ENTRY.size + rest[9]
    extra = struct.pack("<2H3Q", 1, 24, rest[8], rest[7], rest[-1])
    rest[7] = rest[8] = rest[-1] = 0xFFFFFFFF
    first = A._ENTRY.pack(sign, *rest[:10], len(extra), *rest[11:]) + bytes(directory[A._ENTRY.size : name_end]) + extra
    old = A._ENTRY.unpack_from(data, place)
    directory = first + bytes(directory[name_end + old[11] :])
    end64 = A._END64.pack(A.END64, 44, 45, 45, 0, 0, count, count, len(directory), place)
    tail = A._END64_AT.pack(A.END64_AT, 0, place + len(directory), 1) + A._END.pack(A.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"hey"
    (tmp_path / "wide.zip").write_bytes(data[:place] + directory + end64 + tail)
    (tmp_path / "in-front.zip").write_bytes(b"#!/bin/sh\n" + data)
    assert zipfile.ZipFile(tmp_path / "wide.zip").read("wide") == b"w" * 999
    got = A.member_contents(A.zip_members(spark, str(tmp_path))).collect()
    assert {(stem(r.archive), r.name): bytes(r.content) for r in got} == {(a, n): d for a in ("wide", "in-front") for n, d in (("wide", b"w" * 999), ("b", b"bb"))}


def test_faulty_archives_are_rows(spark, tmp_path):
    make(tmp_path / "good.zip", {"a": b"a" * 500}, compression=zipfile.ZIP_DEFLATED)
    data = (tmp_path / "good.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(data[:-30])
    (tmp_path / "text.zip").write_bytes(b"not an archive")
    r = random.Random(1)
    for i in range(60):
        bad = bytearray(data)
        for _ in range(3):
            bad[r.randrange(len(bad))] = r.randrange(256)
        (tmp_path / f"bad{i}.zip").write_bytes(bytes(bad))
    (tmp_path / "far.zip").write_bytes(data[:-6] + struct.pack("<L", 0x7FFFFFFF) + data[-2:])
    (tmp_path / "wrong.zip").write_bytes(data[:40] + b"zzzz" + data[44:])
    got = A.member_contents(A.zip_members(spark, str(tmp_path))).collect()
    by = {stem(x.archive): x for x in got}
    assert bytes(by["good"].content) == b"a" * 500 and by["good"].error is None
    assert all(by[n].error and by[n].content is None for n in ("cut", "text", "far", "wrong"))
    assert all(x.error or bytes(x.content) == b"a" * 500 for x in got)


def test_extracted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make(tmp_path / "in/a.zip", {"x/y.txt": b"1", "z": b"2"})
    make(tmp_path / "in/b.zip", {"../out.txt": b"3", "/abs": b"4", "ok": b"5"})
    for _ in range(2):
        got = A.extract_zips(spark, str(tmp_path / "in"), f"file://{tmp_path}/to").collect()
        assert {(r.name, bool(r.error)) for r in got} == {("x/y.txt", False), ("z", False), ("../out.txt", True), ("/abs", True), ("ok", False)}
    assert sorted(str(p.relative_to(tmp_path / "to")) for p in (tmp_path / "to").rglob("*") if p.is_file()) == ["a/x/y.txt", "a/z", "b/ok"]
    assert not (tmp_path / "out.txt").exists()
