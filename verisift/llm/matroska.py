"""Matroska media columns: a writer of 8-bit PCM files and a parser of any Matroska file.

`store` puts each payload into an audio file of one track (codec A_PCM/INT/LIT, 8 bits,
8 kHz mono): EBML header, Info, Tracks, Clusters of laced SimpleBlocks, Cues.  A frame is
64 samples (8 ms), the payload's last unit.  `packet_rows` parses EBML elements
with variable-length ids and sizes (unknown sizes too), clusters, all four lacings and
cues, into one row per packet: track, time stamp, byte range.

Null texts count as empty; the payload of an empty text is 64 bytes of 0.  Equal texts give
equal files whatever their doc_id.  Rows that share a doc_id are kept apart; an empty
table gives no rows; other columns are ignored.  A very long text is one file, held whole with its packet list by one task.
`parse` raises MatroskaError on any damage.  The operators keep such a row: `features` gives `feature` as "damaged: " and the reason,
null payload fields and the stored bytes' own size and digest; a null file has null fields alone; `packet_rows` has no rows for either.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element ids of the Matroska specification (RFC 9559) and EBML (RFC 8794).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Those that end a cluster of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

FRAME, RATE = 64, 8000
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 32, 64
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)


class MatroskaError(ValueError):
    """Bytes that are no whole Matroska file."""


# --- writing ---------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size: as many leading zero bits as bytes follow the first."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The head of the frame sizes and the frames of one block."""
    sizes = [len(f) for f in frames]
    if lacing == NO_LACING:
        head = b""
    elif lacing == FIXED:
        head = bytes([len(frames) - 1])
    elif lacing == XIPH:
        head = bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    else:
        head = bytes([len(frames) - 1]) + vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


_HEAD = element(
    EBML,
    number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes, lacing: int = FIXED) -> bytes:
    """A file whose packets are the payload's units of FRAME bytes, in order."""
    ms = FRAME * 1000 // RATE
    per_block = 1 if lacing == NO_LACING else FRAMES_PER_BLOCK
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, np.array(len(payload) // FRAME * ms, ">f8").tobytes()) + element(MUXING_APP, b"verisift") + element(WRITING_APP, b"verisift"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    span = BLOCKS_PER_CLUSTER * per_block * FRAME
    for start in range(0, len(payload), span):
        base = start // FRAME * ms
        blocks = [number(TIMESTAMP, base)]
        for k in range(start, min(start + span, len(payload)), per_block * FRAME):
            part = payload[k : min(k + per_block * FRAME, start + span)]
            frames = len(part) // FRAME
            how = lacing if frames > 1 else NO_LACING
            head = vint(1) + (k // FRAME * ms - base).to_bytes(2, "big", signed=True) + bytes([0x80 | how << 1])
            laced = bytes([frames - 1]) + part if how == FIXED else lace([part[x : x + FRAME] for x in range(0, len(part), FRAME)], how)
            blocks.append(element(SIMPLE_BLOCK, head + laced))
        parts.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    return _HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# --- parsing ---------------------------------------------------------------


@dataclass
class Track:
    number: int = 0
    type: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0
    frame_ns: int = 0


@dataclass
class Parsed:
    scale: int = 1_000_000
    duration: float = 0.0
    doc_type: str = ""
    tracks: dict[int, Track] = field(default_factory=dict)
    #: track, time stamp in ns, byte offset, size, cluster, block, place in the lace, key frame
    packets: list[tuple[int, int, int, int, int, int, int, bool]] = field(default_factory=list)
    #: time stamp in scale units, track, byte offset of the cluster
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: byte offset of each cluster
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0


def read_vint(data: bytes, at: int, marked: bool) -> tuple[int, int]:
    """Value and next position; `marked` keeps the length marker, as ids do.  All ones: -1, unknown."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MatroskaError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if marked:
        return raw, at + width
    value = raw & (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def _real(body: bytes) -> float:
    if len(body) not in (0, 4, 8):
        raise MatroskaError(f"a real number of {len(body)} bytes")
    return float(np.frombuffer(body, f">f{len(body)}")[0]) if body else 0.0


def _byte(data: bytes, at: int, end: int) -> int:
    if at >= end:
        raise MatroskaError("a lace's head passes its block's end")
    return data[at]


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise MatroskaError("a lace without a head")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise MatroskaError("a fixed lace of uneven size")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while (byte := _byte(data, at, end)) == 255:
                size, at = size + 255, at + 1
            size, at = size + byte, at + 1
        else:
            width = 9 - _byte(data, at, end).bit_length()
            value, at = read_vint(data, at, False)
            if at > end or value < 0:
                raise MatroskaError("a lace's head passes its block's end")
            size = value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("a lace longer than its block")
    return sizes, at


def parse(data: bytes) -> Parsed:
    out, segment = Parsed(), 0
    stack: list[tuple[int, int]] = []  # ident and end of the open elements
    cluster_time, track, cue, at = 0, Track(), [0, 0, 0], 0
    while at < len(data):
        while stack and at >= stack[-1][1]:
            ident, end = stack.pop()
            if at > end:
                raise MatroskaError(f"an element passes its parent's end at byte {end}")
            if ident == TRACK_ENTRY:
                out.tracks[track.number] = track
            elif ident == CUE_TRACK_POSITIONS:
                out.cues.append((cue[0], cue[1], segment + cue[2]))
        began = at
        ident, at = read_vint(data, at, True)
        size, at = read_vint(data, at, False)
        if ident in TOP:  # ends open clusters of unknown size
            while stack and stack[-1][0] == CLUSTER and stack[-1][1] == len(data):
                stack.pop()
        if size < 0:
            if ident not in (SEGMENT, CLUSTER):
                raise MatroskaError("an unknown size where none may stand")
            size = len(data) - at
        end = at + size
        if end > len(data):
            raise MatroskaError(f"the element at byte {began} is cut off")
        if ident in MASTERS:
            stack.append((ident, end))
            if ident == SEGMENT:
                segment = at
            elif ident == CLUSTER:
                out.clusters.append(began)
            elif ident == TRACK_ENTRY:
                track = Track()
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            number_, p = read_vint(data, at, False)
            if p + 3 > end:
                raise MatroskaError(f"the block at byte {began} has no whole head")
            if not out.clusters:
                raise MatroskaError(f"the block at byte {began} stands in no cluster")
            time = cluster_time + int.from_bytes(data[p : p + 2], "big", signed=True)
            flags = data[p + 2]
            sizes, p = frame_sizes(data, p + 3, end, flags >> 1 & 3)
            step = out.tracks[number_].frame_ns if number_ in out.tracks else 0
            for k, n in enumerate(sizes):
                out.packets.append((number_, time * out.scale + k * step, p, n, len(out.clusters) - 1, out.blocks, k, flags & 0x80 > 0))
                p += n
            out.blocks += 1
        elif ident == TIMESTAMP:
            cluster_time = int.from_bytes(data[at:end], "big")
        elif ident == CUE_TIME:
            cue[0] = int.from_bytes(data[at:end], "big")
        elif ident == CUE_TRACK:
            cue[1] = int.from_bytes(data[at:end], "big")
        elif ident == CUE_CLUSTER_POSITION:
            cue[2] = int.from_bytes(data[at:end], "big")
        elif ident == TIMESTAMP_SCALE:
            out.scale = int.from_bytes(data[at:end], "big")
        elif ident == DURATION:
            out.duration = _real(data[at:end])
        elif ident == DOC_TYPE:
            out.doc_type = data[at:end].rstrip(b"\0").decode("ascii", "replace")
        elif ident == TRACK_NUMBER:
            track.number = int.from_bytes(data[at:end], "big")
        elif ident == TRACK_TYPE:
            track.type = int.from_bytes(data[at:end], "big")
        elif ident == CODEC_ID:
            track.codec = data[at:end].decode("ascii", "replace")
        elif ident == SAMPLING_FREQUENCY:
            track.rate = _real(data[at:end])
        elif ident == CHANNELS:
            track.channels = int.from_bytes(data[at:end], "big")
        elif ident == BIT_DEPTH:
            track.bits = int.from_bytes(data[at:end], "big")
        elif ident == DEFAULT_DURATION:
            track.frame_ns = int.from_bytes(data[at:end], "big")
        at = end
    while stack:
        ident, _ = stack.pop()
        if ident == TRACK_ENTRY:
            out.tracks[track.number] = track
        elif ident == CUE_TRACK_POSITIONS:
            out.cues.append((cue[0], cue[1], segment + cue[2]))
    if out.doc_type not in ("matroska", "webm"):
        raise MatroskaError("no Matroska header")
    return out


def payload_of(data: bytes, found: Parsed, track: int = 1) -> bytes:
    """The bytes of a track's packets, joined; packets that touch are read at once."""
    out, start, stop = [], -1, -1
    for number_, _, at, n, *_ in found.packets:
        if number_ == track:
            if at != stop:
                if start >= 0:
                    out.append(data[start:stop])
                start = at
            stop = at + n
    if start >= 0:
        out.append(data[start:stop])
    return b"".join(out)


def feature(payload: bytes, found: Parsed) -> str:
    """Counts of the file and measures of its samples, as text."""
    samples = np.frombuffer(payload, np.uint8)
    sound = found.cues and all(at in found.clusters for _, _, at in found.cues)
    parts = {
        "codec": ",".join(t.codec for t in found.tracks.values()), "clusters": len(found.clusters), "blocks": found.blocks, "packets": len(found.packets),
        "cues": len(found.cues), "cues_point_at_clusters": int(bool(sound)), "ms": (found.packets[-1][1] - found.packets[0][1]) // 1_000_000 if found.packets else 0,
        "sum": int(samples.sum(dtype=np.int64)), "energy": int((samples.astype(np.uint32) ** 2).sum(dtype=np.int64)), "peak": int(samples.max(initial=0)), "silence": int(len(samples) - np.count_nonzero(samples)),
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


def padded(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of FRAME."""
    return raw + bytes(-len(raw) % FRAME if raw else FRAME)


# --- operators -------------------------------------------------------------


def store(docs: DataFrame, lacing: int = FIXED) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, media): a Matroska file for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in raws], pa.int64()), pa.array([mux(padded(x), lacing) for x in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("raw")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKET = "doc_id long, packet int, track int, timestamp_ns long, byte_offset long, size int, cluster int, block int, lace int, keyframe boolean"


def packet_rows(media: DataFrame) -> DataFrame:
    """(doc_id, media) to one row per packet; a null or damaged file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKET.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        for batch in slices(batches, 1 << 20):
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with suppress(MatroskaError):
                    rows += [(doc, k, *p) for k, p in enumerate(parse(data).packets if data is not None else ())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, PACKET)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to digests and features of what the stored bytes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in slices(batches):
            rows = []
            for doc, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                try:
                    found = parse(data)
                except MatroskaError as fault:
                    rows.append((doc, n, None, None, None, len(data), hashlib.sha256(data).hexdigest(), f"damaged: {fault}"))
                    continue
                payload = payload_of(data, found)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, found)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
