"""Media columns: Matroska files in a binary column, and their packet tables.

The muxer stores a byte payload losslessly as one audio track of 8-bit PCM samples: an EBML header, then a segment of
known size with its info, track, clusters and cues. A frame is 64 samples or a multiple; frames are laced, eight to a
block, by fixed-size lacing where they are equal and EBML lacing where the last is shorter.

The parser reads any Matroska file: element ids and sizes of variable length (unknown sizes too), unknown elements
skipped, clusters, simple blocks and block groups, no, Xiph, EBML or fixed-size lacing, and cues. It gives one row per
packet: track, timestamp, byte range, keyframe and the cluster's place; ranges are checked against the file's length. Of a
truncated or otherwise malformed file Media raises ValueError; in the tables such a row has no packets, null digests and
the message in the column `error`, and the other rows are as ever.

Files are row values: each task muxes and parses its own rows, nothing is shuffled or gathered.

Edge cases: null text counts as empty; an empty payload is padded like the rest, to 64 bytes. Equal payloads give equal
files (there is no date or random id). A payload may be as long as a row allows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# EBML element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VOID, CRC32 = 0xEC, 0xBF
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, LACING, FRAME_TIME = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

SAMPLE_RATE, FRAME, LACE, BLOCKS = 8000, 512, 8, 32  # samples a second, bytes a frame, frames a block, blocks a cluster


def vint(n: int, width: int = 0) -> bytes:
    """A size of the least width (or the given one); all ones is kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed(n: int) -> bytes:
    """EBML lacing's size difference: a size of width w, moved by 2**(7w-1) - 1."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1) - 1)
    return vint(n + (1 << 7 * width - 1) - 1, width)


def _block(track: int, time: int, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        lacing, head = 0x00, b""
    elif len(set(sizes)) == 1:
        lacing, head = 0x04, bytes([len(frames) - 1])
    else:
        lacing, head = 0x06, bytes([len(frames) - 1]) + vint(sizes[0]) + b"".join(_signed(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return vint(track) + struct.pack(">hB", time, 0x80 | lacing) + head + b"".join(frames)


def mux(payload: bytes, rate: int = SAMPLE_RATE, frame: int = FRAME) -> bytes:
    """A Matroska file whose only track holds payload, a sample per byte."""
    header = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + number(FRAME_TIME, frame * 10**9 // rate) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)) + element(MUXER, b"quillspark") + element(WRITER, b"quillspark"))
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(frames), LACE * BLOCKS):
        base = c * frame * 1000 // rate
        blocks = [
            element(SIMPLE, _block(1, b * frame * 1000 // rate - base, frames[b : min(b + LACE, c + LACE * BLOCKS)]))
            for b in range(c, min(c + LACE * BLOCKS, len(frames)), LACE)
        ]
        cluster = element(CLUSTER, number(TIME, base) + b"".join(blocks))
        cues.append(element(CUE, number(CUE_TIME, base) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place); keep leaves the marker bit, as ids do. A size of all ones is -1, unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("truncated file")
    n = raw if keep else raw - (1 << 7 * width)
    return (-1 if not keep and n == (1 << 7 * width) - 1 else n), at + width


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        start = at
        kind, at = _vint(data, at, keep=True)
        if kind in TOP:
            return start
        size, at = _vint(data, at)
        if size < 0:
            return end
        at += size
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, end) of each element; one of unknown size ends where one begins
    that can't be inside it."""
    while at < end:
        start = at
        kind, at = _vint(data, at, keep=True)
        size, at = _vint(data, at)
        if size < 0:
            stop = _cluster_end(data, at, end) if kind == CLUSTER else end
        else:
            stop = at + size
            if stop > end:
                raise ValueError(f"element at byte {start} goes beyond its parent")
        yield kind, start, at, stop
        at = stop


def _int(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _laced(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of the frames of a block."""
    track, at = _vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags & 0x06
    if not lacing:
        return track, time, flags, [(at, end)]
    count, at = data[at] + 1, at + 1
    if lacing == 0x04:
        if (end - at) % count:
            raise ValueError("fixed-size lacing of uneven length")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for k in range(count - 1):
            if lacing == 0x02:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                first = at
                size, at = _vint(data, at)
                if k:
                    size += sizes[-1] - (1 << 7 * (at - first) - 1) + 1
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond its block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return track, time, flags, out


class Media:
    """What a file holds: tracks (number to codec, kind and audio settings), packets and cues."""

    def __init__(self, data: bytes) -> None:
        self.scale, self.duration, self.tracks, self.cues, self.clusters = 1_000_000, 0.0, {}, [], 0
        self.packets: list[tuple[int, int, int, int, bool, int]] = []  # track, ns, start, end, keyframe, cluster
        try:
            self._file(data)
        except (struct.error, IndexError, StopIteration, OverflowError) as e:
            raise ValueError(f"malformed file: {e}") from e

    def _file(self, data: bytes) -> None:
        head, *_ = top = list(elements(data, 0, len(data))) or [(0, 0, 0, 0)]
        if head[0] != EBML:
            raise ValueError("not an EBML file")
        for kind, _, at, end in top:
            if kind == SEGMENT:
                self._segment(data, at, end)

    def _segment(self, data: bytes, base: int, end: int) -> None:
        for kind, start, a, b in elements(data, base, end):
            if kind == INFO:
                for k, _, x, y in elements(data, a, b):
                    if k == SCALE:
                        self.scale = _int(data, x, y)
                    elif k == DURATION:
                        self.duration = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
            elif kind == TRACKS:
                for k, _, x, y in elements(data, a, b):
                    if k == TRACK:
                        self._track(data, x, y)
            elif kind == CLUSTER:
                self._cluster(data, a, b, start - base)
            elif kind == CUES:
                for k, _, x, y in elements(data, a, b):
                    if k == CUE:
                        self._cue(data, x, y)

    def _track(self, data: bytes, a: int, b: int) -> None:
        got: dict = {"lacing": 1}
        for k, _, x, y in elements(data, a, b):
            if k in (NUMBER, KIND):
                got["number" if k == NUMBER else "kind"] = _int(data, x, y)
            elif k == FRAME_TIME:
                got["frame_time"] = _int(data, x, y)
            elif k == CODEC:
                got["codec"] = data[x:y].decode()
            elif k == AUDIO:
                for m, _, p, q in elements(data, x, y):
                    if m == RATE:
                        got["rate"] = struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
                    elif m in (CHANNELS, DEPTH):
                        got["channels" if m == CHANNELS else "depth"] = _int(data, p, q)
        self.tracks[got.get("number", 0)] = got

    def _cluster(self, data: bytes, a: int, b: int, place: int) -> None:
        self.clusters, time = self.clusters + 1, 0
        for k, _, x, y in elements(data, a, b):
            key = None
            if k == TIME:
                time = _int(data, x, y)
            elif k == SIMPLE:
                key, block = bool(data[_vint(data, x)[1] + 2] & 0x80), (x, y)
            elif k == GROUP:
                inner = [(m, p, q) for m, _, p, q in elements(data, x, y)]
                key = all(m != REFERENCE for m, _, _ in inner)
                block = next(((p, q) for m, p, q in inner if m == BLOCK), None)
                if block is None:
                    raise ValueError(f"block group without a block at byte {x}")
            if key is not None:
                track, relative, _, ranges = _laced(data, *block)
                ns = (time + relative) * self.scale
                step = self.tracks.get(track, {}).get("frame_time", 0)
                if not ranges or abs(ns) + len(ranges) * step >= 1 << 63:
                    raise ValueError(f"timestamp out of range in the cluster at {place}")
                self.packets += [(track, ns + i * step, s, e, key, place) for i, (s, e) in enumerate(ranges)]

    def _cue(self, data: bytes, a: int, b: int) -> None:
        time, places = 0, []
        for k, _, x, y in elements(data, a, b):
            if k == CUE_TIME:
                time = _int(data, x, y)
            elif k == CUE_PLACES:
                inner = {m: _int(data, p, q) for m, _, p, q in elements(data, x, y) if q - p <= 8}
                places.append((inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)))
        self.cues += [(time * self.scale, track, place) for track, place in places]

    def track_bytes(self, data: bytes, track: int) -> bytes:
        return b"".join(data[s:e] for t, _, s, e, _, _ in self.packets if t == track)


def parse(data: bytes | None) -> tuple[Media | None, str | None]:
    """The file, or what is wrong with it."""
    try:
        return (Media(data), None) if data is not None else (None, "null")
    except ValueError as e:
        return None, str(e)


def feature(media: Media, samples: bytes) -> str:
    """Of a track of 8-bit samples: codec, packets, clusters, cues that point at clusters, ms, and sample statistics."""
    track = {"codec": "", "rate": 0.0} | next(iter(media.tracks.values()), {})
    x = np.frombuffer(samples, np.uint8)
    places = {p[5] for p in media.packets}
    good = sum(place in places for _, _, place in media.cues)
    histogram = np.bincount(x >> 4, minlength=16)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return (
        f"{track['codec']};rate={track['rate']:.0f};packets={len(media.packets)};clusters={media.clusters};cues={good};ms={media.duration:.3f};"
        f"sum={total};square={square};crossings={crossings};histogram={','.join(map(str, histogram.tolist()))}"
    )


def padded(data: bytes, to: int = 64) -> bytes:
    return data + bytes(-len(data) % to if data else to)


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t.as_py() or b"" for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (of the unpadded UTF-8 text) and media, a Matroska file, for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_mux, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per packet: id_col, packet (its number), track, timestamp_ns, offset, size, keyframe, cluster (offset in the
    segment). Null and malformed files have no packets; media_digests() says what is wrong with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch["id"], batch["media"], strict=True):
                media, _ = parse(value.as_py())
                packets = media.packets if media else []
                columns = list(zip(*packets, strict=True)) or [()] * 6
                start, end = np.array(columns[2], dtype=np.int64), np.array(columns[3], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc.as_py()] * len(packets), batch["id"].type), pa.array(range(len(packets)), pa.int64()), pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()), pa.array(start), pa.array(end - start), pa.array(columns[4], pa.bool_()), pa.array(columns[5], pa.int64()),
                    ],
                    ["id", "packet", "track", "timestamp_ns", "offset", "size", "keyframe", "cluster"],
                )

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    out = rows.mapInArrow(run, f"id {kind}, packet long, track long, timestamp_ns long, offset long, size long, keyframe boolean, cluster long")
    return out.withColumnRenamed("id", id_col)


DIGESTS = pa.schema(
    [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
     ("feature", pa.string()), ("error", pa.string())]
)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch["media"]:
            data = value.as_py()
            media, error = parse(data)
            row = {"error": error}
            if data is not None:
                row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
            if media:
                payload = media.track_bytes(data, 1)
                row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": feature(media, payload)}
            rows.append(row)
        found = pa.RecordBatch.from_pylist(rows, schema=DIGESTS)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], *found.columns], ["id", "n_bytes", *DIGESTS.names])


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the stored files back: sizes, digests, features and error (null where the file is sound) of every row of to_media()."""
    rows = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = media.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(
        _decode,
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )
    return out.withColumnRenamed("id", id_col)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(to_media(read(spark, sf_dir, "documents")))
