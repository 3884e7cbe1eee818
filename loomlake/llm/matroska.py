"""Media columns: Matroska files written, parsed to packet tables, and read back by byte range.

The parser walks EBML elements of variable-length ids and sizes (unknown sizes too), skips what it does not know, and
takes tracks, clusters, SimpleBlocks and BlockGroups with no, Xiph, fixed-size or EBML lacing, and cues. A packet is a
frame: its track, timestamp in ns, key flag, place in its lace, and the byte range in the file.

A broken file gives the packets before the fault and its description in ``error``; if there are none, one row without
a packet that has the ``error``. Null media: no rows. Empty tables give empty tables; repeated rows give repeated packets;
packets of one time keep the order of the file; very long files are parsed whole, one at a time; other columns, of
whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlake.llm.common import batches, texts_of

# Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
DOC_TYPE, SCALE, DURATION, NUMBER, UID, TYPE, CODEC, RATE, CHANNELS, DEPTH = 0x4282, 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION, REFERENCE, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA1, 0x9B, 0xFB, 0xB3, 0xF7, 0xF1
DEFAULT_DURATION = 0x23E383
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
NONE, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
SAMPLE_RATE = 8000


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, place behind, whether all value bits are set)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & (1 << 7 * width) - 1
    return n if keep_marker else bare, at + width, bare == (1 << 7 * width) - 1


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The body of a block behind its flags."""
    if kind == NONE:
        return frames[0]
    out = [bytes([len(frames) - 1])]
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        out += [b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]]
    elif kind == EBML_LACING:
        out.append(vint(sizes[0]))
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            out.append(vint(d + (1 << 7 * w - 1) - 1, w))
    return b"".join(out + frames)


def write_pcm(payload: bytes, frame: int = 512, per_block: int = 8, per_cluster: int = 8) -> bytes:
    """8-bit mono samples as a Matroska file with laced blocks, clusters and cues. Multiples of 8 samples are whole ms."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, uint(SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, np.array(SAMPLE_RATE, ">f8").tobytes()) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    track = uint(NUMBER, 1) + uint(UID, 1) + uint(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, frame * 1_000_000_000 // SAMPLE_RATE) + audio
    body, cues = [info, element(TRACKS, element(TRACK, track))], []
    place = sum(map(len, body))
    span = frame * per_block
    for at in range(0, len(payload), span * per_cluster):
        ms = at * 1000 // SAMPLE_RATE
        blocks = [uint(TIMESTAMP, ms)]
        for b in range(at, min(len(payload), at + span * per_cluster), span):
            part = payload[b : b + span]
            frames = [part[i : i + frame] for i in range(0, len(part), frame)]
            kind = NONE if len(frames) == 1 else FIXED if len(part) % frame == 0 else EBML_LACING
            relative = b * 1000 // SAMPLE_RATE - ms
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace(frames, kind)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, ms) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, place))))
        body.append(element(CLUSTER, b"".join(blocks)))
        place += len(body[-1])
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    #: (track, timestamp in ns, key frame, lacing, place in the lace, cluster, first byte, number of bytes)
    packets: list[tuple] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    segment: int = 0
    error: str | None = None


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block."""
    if kind == NONE:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError(f"lace at {at} does not divide")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                value, behind, _ = read_vint(data, at)
                size = value if not i else sizes[-1] + value - ((1 << 7 * (behind - at) - 1) - 1)
                at = behind
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace at {at} is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    m = Media()
    try:
        _walk(data, m)
    except (ValueError, IndexError) as e:
        m.error = str(e) or "cut off"
    return m


def _number(data: bytes) -> int:
    if len(data) > 8:
        raise ValueError(f"a number of {len(data)} bytes")
    return int.from_bytes(data, "big")


def _block(data: bytes, at: int, end: int, m: Media, state: dict, key: bool | None) -> None:
    track, at, _ = read_vint(data, at)
    if at + 3 > end:
        raise ValueError(f"block cut off at {at}")
    if track >= 1 << 31:
        raise ValueError(f"track {track} at {at}")
    when = state.get("time", 0) + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    step = next((t.get("default_duration", 0) for t in m.tracks if t.get("number") == track), 0)
    if abs(when) * m.scale + 256 * step >= 1 << 63:
        raise ValueError(f"time beyond 64 bits at {at}")
    for i, (a, n) in enumerate(unlace(data, at + 3, end, flags >> 1 & 3)):
        m.packets.append((track, when * m.scale + i * step, bool(flags & 0x80) if key is None else key, flags >> 1 & 3, i, len(m.clusters) - 1, a, n))


def _walk(data: bytes, m: Media) -> None:
    """All elements of a file. What holds the place reached is a stack of (end, id, unknown size), so nesting has no bound."""
    at, state, inside = 0, {}, [(len(data), 0, False)]
    while True:
        end, parent, open_ = inside[-1]
        if at >= end:
            inside.pop()
            if parent == BLOCK_GROUP and state["block"]:
                _block(data, *state["block"], m, state, state["key"])
            if not inside:
                return
            continue
        began = at
        ident, at, _ = read_vint(data, at, keep_marker=True)
        size, at, unknown = read_vint(data, at)
        if unknown:  # such a cluster ends where the next element of its parent begins
            if parent == SEGMENT and ident not in (CLUSTER, CUES):
                raise ValueError(f"unknown size at {began}")
            stop = end
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element at {began} is longer than what holds it")
        if parent == CLUSTER and open_ and ident in (CLUSTER, CUES, INFO, TRACKS):
            inside.pop()
            at = began
            continue
        body = data[at:stop] if ident not in MASTERS and ident not in (SIMPLE_BLOCK, BLOCK) else b""
        if ident == SEGMENT:
            m.segment = at
        elif ident == CLUSTER:
            m.clusters.append(began)
        elif ident == TRACK:
            m.tracks.append({})
        elif ident == CUE_POINT:
            m.cues.append({})
        if ident in MASTERS:
            if ident == BLOCK_GROUP:
                state["block"], state["key"] = None, True
            inside.append((stop, ident, unknown))
            continue
        if ident == SIMPLE_BLOCK:
            _block(data, at, stop, m, state, None)
        elif ident == BLOCK:
            state["block"] = (at, stop)
        elif ident == REFERENCE:
            state["key"] = False
        elif ident == TIMESTAMP:
            state["time"] = _number(body)
        elif ident == SCALE:
            m.scale = _number(body)
        elif ident == DOC_TYPE:
            m.doc_type = body.decode("ascii", "replace")
        elif ident == CODEC and m.tracks:
            m.tracks[-1]["codec"] = body.decode("ascii", "replace")
        elif ident in _TRACK_NUMBERS and m.tracks:
            m.tracks[-1][_TRACK_NUMBERS[ident]] = _number(body)
        elif ident == RATE and m.tracks:
            m.tracks[-1]["rate"] = float(np.frombuffer(body, ">f4" if len(body) == 4 else ">f8")[0])
        elif ident in _CUE_NUMBERS and m.cues:
            m.cues[-1][_CUE_NUMBERS[ident]] = _number(body)
        at = stop


_TRACK_NUMBERS = {NUMBER: "number", TYPE: "type", CHANNELS: "channels", DEPTH: "depth", DEFAULT_DURATION: "default_duration"}
_CUE_NUMBERS = {CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet of each file of df, and one for each faulty file without packets. A file whose numbers no
    column holds (a track of 2^31 and more, times beyond 64 bits, a number of more than 8 bytes) is faulty from there on."""
    names = ["id", "track", "timestamp_ns", "key", "lacing", "lace_index", "cluster", "first_byte", "n_bytes", "error"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()])))

    def run(rows):
        for b in batches(rows):
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data is not None and ((m := parse(data)).packets or m.error):
                    out = [(i, *p, m.error) for p in m.packets] or [(i, *[None] * 8, m.error)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{media_col}` as media").mapInArrow(run, "id long, track int, timestamp_ns long, key boolean, lacing int, lace_index int, cluster int, first_byte long, n_bytes long, error string")


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def features(m: Media, payload: bytes) -> str:
    """Packets, clusters, cues that name a cluster, duration; level, power and sign changes of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    clusters = set(m.clusters)
    hits = sum(m.segment + c.get("cluster", -1) in clusters for c in m.cues)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"packets={len(m.packets)};clusters={len(m.clusters)};cues={hits};ms={len(x) * 1000 // SAMPLE_RATE};sum={int(x.sum())};power={int((x * x).sum())};crossings={crossings}"


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64())])


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): texts (null: empty), padded by zero bytes to a multiple of 64, as Matroska files."""

    def run(rows):
        for b in batches(rows):
            texts = texts_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_pcm(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(df: DataFrame) -> DataFrame:
    """Rows of text_media() -> what the parsed files say. The payload is read back through the packets' byte ranges."""

    def run(rows):
        for b in batches(rows):
            out = []
            for i, n, data in zip(*(c.to_pylist() for c in b.columns)):
                m = parse(data)
                payload = b"".join([data[a : a + k] for *_, a, k in m.packets])
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(m, payload), len(m.packets)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long")
