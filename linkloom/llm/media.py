"""Media columns: bytes in Ogg files of two multiplexed streams, and back.

Writing: the payload becomes frames of 576 unsigned 8-bit samples, one packet each, in a sound stream; a second stream
holds a checksum packet for each frame. Both begin with a header packet. Packets go to pages by lacing values and may
run on over pages; the pages of both streams are interleaved by granule position (samples until the last packet that
ends on a page).

Reading: each page's checksum is verified, packets are reassembled from lacing values, the logical streams are told
apart by serial number with their page numbers in sequence, and times come from granule positions. Every frame is held
against its checksum packet.

A page's granule position is the end of its last packet; the ends of those before follow from the frame's length, which
the sound stream's header gives.

Defined cases: null and empty texts are a payload of 576 bytes 255; equal texts give equal files; texts are whole, of any
length; repeated rows give repeated rows; input columns named like the new ones are replaced; an empty table gives an
empty table. read() and payload_of() raise ValueError for a file that is empty or cut off, or has a wrong checksum, a
lost page or a lost frame; from_media() gives nulls and the error's text for such a file, and nulls for a null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import add_columns, slices, small_batches

FRAME = 576
RATE = 8000
SOUND, CHECK = 1, 2
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's checksum: polynomial 04C11DB7, most significant bit first, from zero. zlib has its mirror image, so bits are mirrored."""
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream. The first packet has the first page for itself."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, continued, last_granule = bytearray(), [], -1, False, 0

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, continued, last_granule
        flags = (1 if continued else 0) | (0 if out else 2) | (4 if last else 0)
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, len(out), 0) + bytes([len(lacing)]) + bytes(lacing)
        page = head + b"".join(body)
        page = page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]
        last_granule = granule if granule >= 0 else last_granule
        out.append((last_granule, page))
        continued = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), [], -1

    for k, (packet, g) in enumerate(zip(packets, granules, strict=True)):
        at, left = 0, len(packet)
        while True:
            if len(lacing) == 255:
                flush(False)
            take = min(left, 255)
            room = 255 - len(lacing)
            if left >= 255 and room > 1:  # whole segments at once
                n = min(left // 255, room)
                lacing += b"\xff" * n
                body.append(packet[at : at + 255 * n])
                at, left = at + 255 * n, left - 255 * n
                continue
            lacing.append(take)
            body.append(packet[at : at + take])
            at, left = at + take, left - take
            if take < 255:
                break
        granule = g
        if k == 0:
            flush(len(packets) == 1)
    if lacing:
        flush(True)
    return out


def write(payload: bytes) -> bytes:
    """An Ogg file of a payload whose length is a positive multiple of FRAME."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = b"\x80rawpcm8" + struct.pack("<BII", 1, RATE, FRAME)
    granules = [0] + [FRAME * (k + 1) for k in range(len(frames))]
    sound = pages_of(SOUND, [head, *frames], granules)
    check = pages_of(CHECK, [b"\x80fcheck" + struct.pack("<I", len(frames)), *(struct.pack("<I", zlib.crc32(f)) for f in frames)], granules)
    order = sorted([(i > 0, g, 0, i, p) for i, (g, p) in enumerate(sound)] + [(i > 0, g, 1, i, p) for i, (g, p) in enumerate(check)])
    return b"".join(x[-1] for x in order)


def read(data: bytes) -> dict[int, tuple[list[bytes], list[float]]]:
    """Packets and their end times in seconds, by stream."""
    streams: dict[int, dict] = {}
    at = 0
    if not data:
        raise ValueError("an empty file")
    while at < len(data):
        if len(data) < at + 27:
            raise ValueError("a page's header is cut off")
        magic, version, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one should begin")
        lacing = data[at + 27 : at + 27 + count]
        begin = at + 27 + count
        end = begin + sum(lacing)
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc or end > len(data):
            raise ValueError(f"wrong checksum on page {number} of stream {serial}")
        s = streams.setdefault(serial, {"next": 0, "open": [], "packets": [], "ends": [], "done": False})
        if number != s["next"] or bool(flags & 1) != bool(s["open"]) or bool(flags & 2) != (number == 0) or s["done"]:
            raise ValueError(f"stream {serial} isn't in sequence at page {number}")
        s["next"] += 1
        s["done"] = bool(flags & 4)
        p, size, ended = begin, 0, 0
        for v in lacing:
            size += v
            if v < 255:
                s["packets"].append(b"".join([*s["open"], data[p : p + size]]))
                s["open"], p, size, ended = [], p + size, 0, ended + 1
        if size:
            s["open"].append(data[p : p + size])
        s["ends"] += [(granule, ended - 1 - i) for i in range(ended)]
        at = end
    if any(s["open"] or not s["done"] for s in streams.values()):
        raise ValueError("a stream has no end")
    rate, frame = next((struct.unpack_from("<II", s["packets"][0], 9) for s in streams.values() if s["packets"] and s["packets"][0].startswith(b"\x80rawpcm8") and len(s["packets"][0]) >= 17), (RATE, FRAME))
    return {k: (s["packets"], [max(0, granule - frame * later) / (rate or RATE) for granule, later in s["ends"]]) for k, s in streams.items()}


def payload_of(data: bytes) -> tuple[bytes, float]:
    """The payload read back and its length in seconds; every frame is held against its checksum packet."""
    streams = read(data)
    if any(not streams.get(k, ([], []))[0] for k in (SOUND, CHECK)):
        raise ValueError("a stream is lost")
    (head, *frames), times = streams[SOUND]
    (_, *checks), _ = streams[CHECK]
    if len(frames) != len(checks) or any(struct.pack("<I", zlib.crc32(f)) != c for f, c in zip(frames, checks, strict=True)):
        raise ValueError("a frame isn't as it was written")
    if not head.startswith(b"\x80rawpcm8"):
        raise ValueError("no sound stream")
    return b"".join(frames), times[-1]


def features(payload: bytes, seconds: float) -> str:
    """Whole numbers of the samples: mean and root mean square in hundredths, crossings of the middle, peaks, length in ms."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    sign = x >= 0
    crossings = int((sign[1:] != sign[:-1]).sum())
    mean, rms = total * 100 // len(x), int(np.sqrt(square / len(x)) * 100)
    return f"frames={len(x) // FRAME};ms={round(seconds * 1000)};mean={mean};rms={rms};cross={crossings};low={int(x.min())};high={int(x.max())}"


def store(texts: list[str]) -> list[pa.Array]:
    media, back, sizes, feats = [], [], [], []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        sizes.append(len(raw))
        data = write(raw + b"\xff" * (-len(raw) % FRAME or (FRAME if not raw else 0)))
        payload, seconds = payload_of(data)
        media.append(data)
        back.append(payload)
        feats.append(features(payload, seconds))
    return [pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.array(feats, pa.string())]


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_bytes long (of the text), media binary (the Ogg file), payload binary (read back from it), feature string."""
    return add_columns(df, text, lambda: store, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])


def from_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload binary, times array<double> (each frame's end in seconds), feature string and error string of its Ogg files."""
    new = [T.StructField("payload", T.BinaryType()), T.StructField("times", T.ArrayType(T.DoubleType())), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())]
    taken = {f.name for f in new}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    at = next(i for i, c in enumerate(kept.columns) if c.lower() == media.lower())
    names = [*kept.columns, *(f.name for f in new)]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None
        try:
            payload, seconds = payload_of(data)
            return payload, read(data)[SOUND][1][1:], features(payload, seconds), None
        except ValueError as e:
            return None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, pc.binary_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False)):
                got = list(zip(*map(one, part.column(at).to_pylist()), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(got, (pa.binary(), pa.list_(pa.float64()), pa.string(), pa.string()), strict=True))], names=names)

    return small_batches(kept).mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """As to_media, but the file and payload only as sizes and digests, so that no bytes leave the task."""

    def make():
        def fn(texts: list[str]) -> list[pa.Array]:
            sizes, media, payload, feats = store(texts)
            m, p = media.to_pylist(), payload.to_pylist()
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            return [sizes, pa.array([len(x) for x in p], pa.int64()), sha(p), pa.array([zlib.crc32(x[-32:]) for x in p], pa.int64()), pa.array([len(x) for x in m], pa.int64()), sha(m), feats]

        return fn

    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return add_columns(df, text, make, [T.StructField(n, t) for n, t in fields])
