"""AVI files of motion JPEG: writing, reading through the RIFF index, and cutting into shots.

``store`` turns every text into an AVI file of grey JPEG frames that holds its bytes losslessly (see jpeg.py);
``features`` and ``clips`` read the stored bytes back, decode the intra frames and find shot boundaries.

A shot starts where the histogram difference to the frame before exceeds an adaptive threshold: twice the mean
difference over the last ``window`` frames plus a sixteenth of the frame's samples. All of it is integer arithmetic.

Defined results: null text counts as empty and is stored as one block of zeros; equal texts give equal
files and values; null ids stay null; repeated rows give repeated rows; empty tables give empty ones.
Files without an idx1 index are read by walking the movi list.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg, textbytes

BLOCKS = 64  # of a frame, at most: 64 x 64 samples
BINS = 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = 25, note: bytes = b"") -> bytes:
    """A RIFF AVI file with one MJPG video stream, a comment and an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", note)) if note else b""
    index, at, parts = [], 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(_chunk(b"00dc", f))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _list(b"movi", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> dict:
    """Rate, size, comment and the compressed frames in index order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    out: dict = {"note": b"", "fps": 25.0, "frames": []}
    movi, index = None, b""

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            stop = min(body + size, end)
            if kind == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, stop)
            elif kind == b"LIST":
                walk(body + 4, stop)
            elif kind == b"avih":
                out["width"], out["height"] = struct.unpack_from("<2I", data, body + 32)
            elif kind == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<2I", data, body + 20)
                out["fps"] = rate / (scale or 1)
            elif kind == b"ICMT":
                out["note"] = data[body:stop]
            elif kind == b"idx1":
                index = data[body:stop]
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    if index:
        entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
        video = [(at, size) for kind, _, at, size in entries if kind[2:] in (b"dc", b"db")]
        # offsets count from the movi list's type, in some writers' files from the start of the file
        base = 0 if video and data[video[0][0] : video[0][0] + 4][2:] in (b"dc", b"db") else movi[0]
        out["frames"] = [data[base + at + 8 : base + at + 8 + size] for at, size in video]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                out["frames"].append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return out


def store_bytes(raw: np.ndarray) -> bytes:
    """The AVI file of one payload: zero-padded to 64-byte blocks, up to BLOCKS blocks a frame."""
    blocks = max(1, -(-len(raw) // 64))
    per = min(blocks, BLOCKS)
    room = -(-blocks // per) * per
    padded = np.zeros(64 * room, np.uint8)
    padded[: len(raw)] = raw
    width, height = (64, 64) if per == BLOCKS else (8 * per, 8)
    head = jpeg.header(width, height)
    frames = [head + body for body in jpeg.encode(padded.reshape(room, 64), per)]
    return write_avi(frames, width, height, note=f"{len(raw)}/{64 * blocks}".encode())


def decode(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """The parsed file, the coefficients of all frames (frames, blocks, 64), and the samples alike."""
    video = read_avi(data)
    coefs, quant = [], []
    for frame in video["frames"]:
        c, head = jpeg.coefficients(frame)
        coefs.append(c)
        quant.append(head["quant"][head["table"]])
    if not coefs:
        return video, np.zeros((0, 1, 64), np.int16), np.zeros((0, 1, 64), np.uint8)
    every = np.stack(coefs)
    return video, every, np.concatenate([jpeg.samples(c, q)[None] for c, q in zip(coefs, quant, strict=True)])


def shots(samples: np.ndarray, window: int = 8) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the histograms of all frames."""
    n = len(samples)
    flat = samples.reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
    at = (flat >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    hist = np.bincount(at.ravel(), minlength=BINS * n).reshape(n, BINS) if n else np.zeros((0, BINS), np.int64)
    starts, past = ([0] if n else []), []
    for i in range(1, n):
        d = int(np.abs(hist[i] - hist[i - 1]).sum())
        if past and d * len(past) > 2 * sum(past) + len(past) * flat.shape[1] // 16:
            starts.append(i)
            past = []
        past = [*past[1 - window :], d]
    return starts, hist


def store(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and media, the AVI file of each row's text."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbytes.slices(whole, "text"):
                raw, at = textbytes.text_bytes(batch.column(1))
                media = [store_bytes(raw[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold: payload, checksums, a feature string of frames, shots and histogram, and the shots as timed clips."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    def one(data: bytes) -> tuple:
        video, coefs, samples = decode(data)
        n, size = map(int, video["note"].split(b"/"))
        payload = jpeg.stored(coefs).ravel()[:size].tobytes()
        starts, hist = shots(samples)
        feature = f"frames={len(samples)} shots={len(starts)} cuts={zlib.crc32(repr(starts).encode()):08x} bins={','.join(map(str, hist.sum(0)))}"
        times = [{"start_s": a / video["fps"], "end_s": b / video["fps"]} for a, b in zip(starts, [*starts[1:], len(samples)], strict=True)]
        return n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip]
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                rows = [one(x.as_py()) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s: double, end_s: double>>")


def clips(media: DataFrame) -> DataFrame:
    """One row per shot: doc_id, clip, first_frame, frames, start_s, end_s."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                video, _, samples = decode(batch.column(1)[i].as_py())
                starts, _ = shots(samples)
                ends = [*starts[1:], len(samples)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, batch.column(0).type), pa.array(range(n), pa.int32()), pa.array(starts, pa.int32()),
                        pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int32()),
                        pa.array([s / video["fps"] for s in starts], pa.float64()), pa.array([e / video["fps"] for e in ends], pa.float64()),
                    ],
                    ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"],
                )

    return media.mapInArrow(run, f"doc_id {kind}, clip int, first_frame int, frames int, start_s double, end_s double")
