"""Baseline JPEG with one 8-bit component, in numpy.

``encode`` stores 64 bytes per 8x8 block as the block's quantised coefficients, losslessly. A byte e becomes
the coefficient of magnitude category 8 whose eight extra bits are e itself, so one Huffman code of one
bit (category 8, no zero run) serves all 64 coefficients, and a block is always 72 bytes before stuffing.
A restart marker after each block resets the DC predictor. ``coefficients`` reads such streams by whole
arrays and any other baseline scan of one component bit by bit.
"""

from __future__ import annotations

import struct

import numpy as np

#: Zigzag order of an 8x8 block, by its rule: diagonals of alternating direction.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


def _idct() -> np.ndarray:
    """64 zigzag coefficients times this matrix give 64 samples."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0) / 2  # [sample, frequency]
    both = np.einsum("ya,xb->abyx", basis, basis).reshape(64, 64)
    return both[ZIGZAG].astype(np.float32)


IDCT = _idct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, height: int) -> bytes:
    one_code = bytes([1] + [0] * 15)
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + bytes([1] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + one_code + b"\x08"),
        _segment(0xC4, b"\x10" + one_code + b"\x08"),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def encode(blocks: np.ndarray, per_frame: int) -> list[bytes]:
    """Entropy-coded data and end marker of each frame of ``per_frame`` blocks; blocks is (n, 64) bytes."""
    n = len(blocks)
    bits = np.zeros((n, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(n, 64, 8)
    body = np.empty((n, 74), np.uint8)
    body[:, :72] = np.packbits(bits.reshape(n, 576), axis=1)
    place = np.arange(n) % per_frame
    body[:, 72] = 0xFF
    body[:, 73] = 0xD0 + place % 8
    full = body == 0xFF
    full[:, 72:] = False
    body[place == per_frame - 1, 73] = 0xD9  # the frame's last block ends the image instead
    out = []
    flat, extra = body.ravel(), full.ravel()
    times = 1 + extra.astype(np.int64)
    wide = np.repeat(flat, times)
    ends = np.cumsum(times)
    wide[ends[extra] - 1] = 0
    stop = ends[74 * per_frame - 1 :: 74 * per_frame]
    begin = 0
    for e in stop:
        out.append(wide[begin:e].tobytes())
        begin = e
    return out


def _codes(table: bytes) -> dict[tuple[int, int], int]:
    counts, symbols = table[:16], table[16:]
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse(image: bytes) -> dict:
    """Frame size, quantisation table, Huffman tables, restart interval and the entropy-coded data."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    out: dict = {"huffman": {}, "quant": {}, "restart": 0}
    at = 2
    while at + 4 <= len(image):
        if image[at] != 0xFF:
            raise ValueError("marker expected")
        kind, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation is not baseline")
                out["quant"][body[0] & 15], body = np.frombuffer(body[1:65], np.uint8), body[65:]
        elif kind == 0xC0:
            bits, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("one 8-bit component expected")
            out["table"] = body[8]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["huffman"][body[0] >> 4, body[0] & 15], body = bytes(body[1:n]), body[n:]
        elif kind == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            out["dc"], out["ac"] = (0, body[2] >> 4), (1, body[2] & 15)
            end = image.rfind(b"\xff\xd9")
            out["data"] = image[at : end if end >= at else len(image)]
            return out
    raise ValueError("no scan")


_ONE = bytes([1] + [0] * 15) + b"\x08"


def _values(e: np.ndarray) -> np.ndarray:
    return np.where(e >= 128, e.astype(np.int16), e.astype(np.int16) - 255)


def stored(coefs: np.ndarray) -> np.ndarray:
    """The bytes that ``encode`` has put into these coefficients."""
    return np.where(coefs > 0, coefs, coefs + 255).astype(np.uint8)


def coefficients(image: bytes) -> tuple[np.ndarray, dict]:
    """Quantised coefficients, (blocks, 64) in zigzag order, and the parsed header."""
    head = parse(image)
    n = -(-head["width"] // 8) * -(-head["height"] // 8)
    if head["restart"] == 1 and head["huffman"][head["dc"]] == _ONE == head["huffman"][head["ac"]]:
        data = np.frombuffer(head["data"], np.uint8)
        ff = np.flatnonzero(data[:-1] == 0xFF)
        after = data[ff + 1]
        drop = np.ones(len(data), np.bool_)
        drop[ff[after == 0] + 1] = False
        marks = ff[after >= 0xD0]
        drop[marks] = drop[marks + 1] = False
        plain = data[drop]
        if len(plain) != 72 * n:
            raise ValueError("damaged scan")
        bits = np.unpackbits(plain.reshape(n, 72), axis=1).reshape(n, 64, 9)
        return _values(np.packbits(bits[:, :, 1:], axis=2).reshape(n, 64)), head
    return _walk(head, n), head


def _walk(head: dict, n: int) -> np.ndarray:
    """Any baseline scan of one component, bit by bit."""
    dc, ac = _codes(head["huffman"][head["dc"]]), _codes(head["huffman"][head["ac"]])
    data, out = head["data"], np.zeros((n, 64), np.int16)
    at, have, held = 0, 0, 0

    def bit() -> int:
        nonlocal at, have, held
        if not have:
            if at >= len(data):
                raise ValueError("scan ends early")
            held, have = data[at], 8
            at += 2 if held == 0xFF else 1
        have -= 1
        return held >> have & 1

    def symbol(codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bit()
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def number(size: int) -> int:
        v = 0
        for _ in range(size):
            v = v << 1 | bit()
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    last = 0
    for i in range(n):
        if head["restart"] and i and i % head["restart"] == 0:
            have, last = 0, 0
            if data[at : at + 1] != b"\xff" or not 0xD0 <= data[at + 1] <= 0xD7:
                raise ValueError("restart marker expected")
            at += 2
        last += number(symbol(dc))
        out[i, 0] = last
        k = 1
        while k < 64:
            rs = symbol(ac)
            if rs == 0:
                break
            k += rs >> 4
            if rs & 15:
                out[i, min(k, 63)] = number(rs & 15)
            k += 1
    return out


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 64) samples 0 to 255 of each block, row by row."""
    out = (coefs * quant.astype(np.float32)).astype(np.float32) @ IDCT
    return np.clip(np.rint(out) + 128, 0, 255).astype(np.uint8)
