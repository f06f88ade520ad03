"""A baseline JPEG encoder for queries and tests: it writes given coefficient blocks, with options for what decoders must bear."""

from __future__ import annotations

import struct

from tessera.schema import ZIGZAG


def canonical_table(symbols: list[int]) -> tuple[list[int], list[int]]:
    """A flat table: all codes of one length that leaves the all-ones code free, or two lengths."""
    length = max(1, (len(symbols)).bit_length())
    if len(symbols) == (1 << length):
        length += 1
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return counts, symbols


def skewed_table(symbols: list[int]) -> tuple[list[int], list[int]]:
    """Codes of all lengths up to 16: each length takes half of the room that is left until the rest fits into the last."""
    counts, left, room = [0] * 16, len(symbols), 1 << 16
    for length in range(1, 16):
        size = 1 << 16 - length
        # The rest must fit into codes of 16 bits, of which the last stays free.
        while left and room - size > left - 1 and counts[length - 1] < max(1, left // 8) and length > 1:
            counts[length - 1], left, room = counts[length - 1] + 1, left - 1, room - size
    counts[15] = left
    return counts, symbols


DC_TABLE = canonical_table(list(range(12)))
AC_TABLE = canonical_table([r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0])


class Bits:
    def __init__(self):
        self.acc, self.n = 0, 0

    def put(self, value: int, size: int) -> None:
        self.acc, self.n = self.acc << size | value, self.n + size

    def done(self) -> bytes:
        pad = -self.n % 8
        raw = (self.acc << pad | (1 << pad) - 1).to_bytes((self.n + pad) // 8, "big") if self.n else b""
        return raw.replace(b"\xff", b"\xff\x00")


def codes(table):
    from tessera.functions.jpeg import canonical

    return {s: c for s, c in zip(table[1], canonical(table[0]))}


def magnitude(v: int) -> tuple[int, int]:
    size = abs(v).bit_length()
    return size, v if v > 0 else v + (1 << size) - 1


def put_block(bits: Bits, zz: list[int], before: int, dc, ac) -> None:
    size, raw = magnitude(zz[0] - before)
    bits.put(*dc[size])
    bits.put(raw, size)
    run = 0
    last = max((k for k in range(1, 64) if zz[k]), default=0)
    for k in range(1, last + 1):
        if not zz[k]:
            run += 1
            continue
        while run > 15:
            bits.put(*ac[0xF0])
            run -= 16
        size, raw = magnitude(zz[k])
        bits.put(*ac[run << 4 | size])
        bits.put(raw, size)
        run = 0
    if last < 63:
        bits.put(*ac[0])


def segment(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def encode(width, height, comps, blocks, quants=None, interval=0, wide_tables=False, extra=b"", fill=b"", end=True, joined=False, tables=None):
    """comps: (id, h, v) each; blocks: {(comp, brow, bcol): 64 coefficients in natural order}; quants: natural order by component."""
    dc_table, ac_table = tables or (DC_TABLE, AC_TABLE)
    quants = quants or [[1] * 64 for _ in comps]
    max_h, max_v = max(c[1] for c in comps), max(c[2] for c in comps)
    w, h = -(-width // 8), -(-height // 8)
    across, down = -(-w // max_h), -(-h // max_v)
    out = [b"\xff\xd8", extra]
    qts = [bytes([(16 if wide_tables else 0) | k]) + struct.pack(">64H" if wide_tables else ">64B", *(q[n] for n in ZIGZAG)) for k, q in enumerate(quants)]
    out += [segment(0xDB, b"".join(qts))] if joined else [segment(0xDB, t) for t in qts]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, len(comps)) + b"".join(bytes([i, a << 4 | b, k]) for k, (i, a, b) in enumerate(comps))))
    hts = [bytes([kind << 4]) + bytes(t[0]) + bytes(t[1]) for kind, t in ((0, dc_table), (1, ac_table))]
    out += [segment(0xC4, b"".join(hts))] if joined else [segment(0xC4, t) for t in hts]
    if interval:
        out.append(segment(0xDD, struct.pack(">H", interval)))
    out.append(segment(0xDA, bytes([len(comps)]) + b"".join(bytes([i, 0]) for i, _, _ in comps) + bytes([0, 63, 0])))
    dc, ac = codes(dc_table), codes(ac_table)
    bits, before = Bits(), [0] * len(comps)
    for mcu in range(across * down):
        if interval and mcu and mcu % interval == 0:
            out += [bits.done(), fill, b"\xff", bytes([0xD0 + (mcu // interval - 1) % 8])]
            bits, before = Bits(), [0] * len(comps)
        for k, (_, a, b) in enumerate(comps):
            for y in range(b):
                for x in range(a):
                    zz = [blocks[k, mcu // across * max_v + y, mcu % across * max_h + x][n] for n in ZIGZAG]
                    put_block(bits, zz, before[k], dc, ac)
                    before[k] = zz[0]
    out.append(bits.done())
    if end:
        out += [fill, b"\xff\xd9"]
    return b"".join(out)
