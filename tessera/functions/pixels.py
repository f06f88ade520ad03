"""Integer-exact pixel arithmetic: Column expressions for queries, numpy twins for bulk work.

Blocks are arrays of 64 integers in row-major order. Shifts are arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import ZIGZAG


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def wrap16(x: Column) -> Column:
    """The value a 16-bit store keeps."""
    return (x + 32768).bitwiseAND(65535) - 32768


def sign_extend(value: Column, size: Column) -> Column:
    """The signed number that ``size`` magnitude bits stand for."""
    one = F.lit(1)
    half = F.when(size > 0, F.call_function("shiftleft", one, size - 1)).otherwise(0)
    return F.when(size == 0, 0).when(value < half, value - (2 * half - 1)).otherwise(value)


def dezigzag(block: Column) -> Column:
    """Stream order to natural order."""
    place = {natural: k for k, natural in enumerate(ZIGZAG)}
    return F.transform(F.array(*(F.lit(place[n]) for n in range(64))), lambda k: F.element_at(block, k + 1))


def dequantize(block: Column, table: Column) -> Column:
    return F.zip_with(block, table, lambda c, q: wrap16(c * q))


def _shift(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


# -- the inverse transform ---------------------------------------------------
#
# The published AAN transform as three linear steps, of which two truncate: every
# frequency is scaled; five sums of scaled frequencies are turned by a constant;
# each half of the outputs is a sum of what the other steps gave. The even half
# and the odd half make outputs n and 7 - n as their sum and their difference.


@dataclass(frozen=True)
class Accuracy:
    """Factor and right shift of each frequency's scale and of each turn."""

    scales: tuple[tuple[int, int], ...]
    turns: tuple[tuple[int, int], ...]


ACCURACY = {
    "high": Accuracy(((181, 5), (251, 5), (59, 3), (213, 5), (181, 5), (71, 4), (49, 4), (25, 4)), ((181, 7), (181, 7), (277, 8), (669, 8), (49, 6))),
    "low": Accuracy(((22, 2), (31, 2), (30, 2), (27, 2), (22, 2), (18, 2), (12, 2), (6, 2)), ((90, 6), (90, 6), (69, 6), (167, 6), (49, 6))),
}
#: The sums that are turned, over scaled frequencies 0 to 7.
TURNED = (
    (0, 0, 1, 0, 0, 0, -1, 0),
    (0, 1, 0, -1, 0, -1, 0, 1),
    (0, 0, 0, -1, 0, 1, 0, 0),
    (0, 1, 0, 0, 0, 0, 0, -1),
    (0, 1, 0, -1, 0, 1, 0, -1),
)
#: Halves of the outputs 0 to 3, over the eight scaled frequencies and the five turned sums.
EVEN = (
    (1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0),
    (1, 0, -1, 0, -1, 0, -1, 0, 1, 0, 0, 0, 0),
    (1, 0, 1, 0, -1, 0, 1, 0, -1, 0, 0, 0, 0),
    (1, 0, -1, 0, 1, 0, -1, 0, 0, 0, 0, 0, 0),
)
ODD = (
    (0, 1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0),
    (0, -1, 0, -1, 0, -1, 0, -1, 0, 0, 0, 1, -1),
    (0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, -1, 1),
    (0, -1, 0, -1, 0, -1, 0, -1, 0, -1, 1, 1, 0),
)
#: The scales leave four bits of fraction.
FRACTION = 4


def _weighted(row: Sequence[int], terms: Sequence[Column]) -> Column:
    """The sum of terms with signs, positive ones first."""
    signed = sorted(((w, t) for w, t in zip(row, terms) if w), key=lambda x: -x[0])
    out = signed[0][1]
    for w, t in signed[1:]:
        out = out + t if w > 0 else out - t
    return out


def idct_1d(x: Sequence[Column], accuracy: str = "high") -> Column:
    """The eight outputs of one integer inverse transform, as an array."""
    a = ACCURACY[accuracy]
    each = lambda array, n: [array[k] for k in range(n)]
    scaled = F.array(*(_shift(v * m, n) for v, (m, n) in zip(x, a.scales)))

    def outputs(known: Column) -> Column:
        terms = each(known, 13)
        halves = F.array(*(_weighted(row, terms) for row in (*EVEN, *ODD)))
        sums = lambda h: [wrap16(_shift(h[k] + h[k + 4], FRACTION)) for k in range(4)] + [wrap16(_shift(h[k] - h[k + 4], FRACTION)) for k in (3, 2, 1, 0)]
        return let(halves, lambda h: F.array(*sums(h)))

    turned = lambda s: F.array(*(_shift(_weighted(row, each(s, 8)) * m, n) for row, (m, n) in zip(TURNED, a.turns)))
    return let(scaled, lambda s: let(F.concat(s, turned(s)), outputs))


def idct_pass(block: Column, stride: int, accuracy: str = "high") -> Column:
    """One pass: stride 8 transforms columns, stride 1 rows. The result is in natural order."""
    step = 1 if stride == 8 else 8
    done = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: idct_1d([F.element_at(block, j * step + stride * i + 1) for i in range(8)], accuracy))
    if stride == 1:
        return F.flatten(done)
    return let(done, lambda a: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.element_at(F.element_at(a, k % 8 + 1), F.shiftright(k, 3) + 1)))


def idct_2d(block: Column, accuracy: str = "high") -> Column:
    return let(idct_pass(block, 8, accuracy), lambda half: idct_pass(half, 1, accuracy))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x))


def red(y: Column, cr: Column) -> Column:
    return clamp(y + _shift(cr * 45, 5) + 128)


def green(y: Column, cb: Column, cr: Column) -> Column:
    return clamp(y - _shift(cb * 11 + cr * 23, 5) + 128)


def blue(y: Column, cb: Column) -> Column:
    return clamp(y + _shift(cb * 113, 6) + 128)


def rgb_float(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """The colour formula with real factors, halves to the even number."""
    exact = {"r": y + F.lit(1.402) * cr, "g": y - F.lit(0.344) * cb - F.lit(0.714) * cr, "b": y + F.lit(1.772) * cb}
    return {name: clamp(F.rint(v + 128)) for name, v in exact.items()}


# -- numpy -------------------------------------------------------------------

_PLACE = np.argsort(np.array(ZIGZAG))


def np_wrap16(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16).astype(np.int32)


def np_dezigzag(blocks: np.ndarray) -> np.ndarray:
    return blocks[:, _PLACE]


_TURNED, _HALVES = np.array(TURNED, np.float64), np.array(EVEN + ODD, np.float64)


def _np_1d(x: np.ndarray, accuracy: str) -> np.ndarray:
    """x: eight rows of inputs, any shape behind. In floats, whose 53 bits hold all products and sums exactly; a floor is a right shift."""
    a = ACCURACY[accuracy]
    factors = lambda pairs: np.array([[m / (1 << n)] for m, n in pairs])
    known = np.empty((13, x[0].size))
    np.floor(x.reshape(8, -1) * factors(a.scales), out=known[:8])
    np.floor(_TURNED @ known[:8] * factors(a.turns), out=known[8:])
    halves = _HALVES @ known
    out = np.concatenate([halves[:4] + halves[4:], (halves[:4] - halves[4:])[::-1]])
    return np_wrap16(np.floor(out / (1 << FRACTION)).astype(np.int32)).reshape(x.shape)


def np_idct(blocks: np.ndarray, accuracy: str = "high") -> np.ndarray:
    """(n, 64) coefficients to (n, 8, 8) samples without the level shift."""
    x = blocks.astype(np.int32).reshape(-1, 8, 8)
    half = _np_1d(x.transpose(1, 0, 2), accuracy)  # rows of inputs are block rows: columns are transformed
    return _np_1d(half.transpose(2, 1, 0), accuracy).transpose(1, 2, 0)


def sql_idct_1d(accuracy: str = "high") -> tuple[str, str, list[str]]:
    """SQL of the three steps: s0 to s7 from x0 to x7, t0 to t4 from those, and the eight outputs before the last shift."""
    a = ACCURACY[accuracy]

    def total(row: Sequence[int]) -> str:
        names = [f"s{k}" for k in range(8)] + [f"t{k}" for k in range(5)]
        return " ".join(f"{'+' if w > 0 else '-'} {n}" for w, n in zip(row, names) if w).removeprefix("+ ")

    scaled = ", ".join(f"(x{k} * {m}) >> {n} AS s{k}" for k, (m, n) in enumerate(a.scales))
    turned = ", ".join(f"(({total(row)}) * {m}) >> {n} AS t{k}" for k, (row, (m, n)) in enumerate(zip(TURNED, a.turns)))
    pairs = [(total(e), total(o)) for e, o in zip(EVEN, ODD)]
    return scaled, turned, [f"{e} + ({o})" for e, o in pairs] + [f"{e} - ({o})" for e, o in reversed(pairs)]


def np_idct_float(blocks: np.ndarray) -> np.ndarray:
    """The exact transform, as a yardstick for accuracy."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ku,bkl,lv->buv", basis, blocks.reshape(-1, 8, 8).astype(float), basis)


def np_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Samples to bytes; the last axis is R, G, B."""
    r = y + (cr * 45 >> 5) + 128
    g = y - (cb * 11 + cr * 23 >> 5) + 128
    b = y + (cb * 113 >> 6) + 128
    return np.clip(np.stack([r, g, b], axis=-1), 0, 255).astype(np.uint8)


def np_rgb_float(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """The colour formula with real factors, as a yardstick."""
    rgb = np.stack([y + 1.402 * cr, y - 0.344 * cb - 0.714 * cr, y + 1.772 * cb], axis=-1) + 128
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
