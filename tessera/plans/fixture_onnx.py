"""A small model file for queries and tests: mean of each channel, then a matrix and a bias; written as protocol buffers by hand."""

from __future__ import annotations

import struct


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(tag: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _number(tag << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(tag << 3 | 2) + _number(len(raw)) + raw


def _node(kind: str, inputs: list[str], output: str) -> bytes:
    return _field(1, b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, kind))


def _tensor(name: str, dims: list[int], values: list[float]) -> bytes:
    return _field(5, b"".join(_field(1, d) for d in dims) + _field(2, 1) + _field(8, name) + _field(9, struct.pack(f"<{len(values)}f", *values)))


def _value(tag: int, name: str, dims: list[int]) -> bytes:
    shape = b"".join(_field(1, _field(1, d)) for d in dims)
    return _field(tag, _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape))))


def mean_model(side: int, weights: list[list[float]], bias: list[float]) -> bytes:
    classes = len(bias)
    graph = b"".join([
        _node("GlobalAveragePool", ["x"], "pooled"), _node("Flatten", ["pooled"], "flat"), _node("Gemm", ["flat", "w", "b"], "y"), _field(2, "means"),
        _tensor("w", [3, classes], [v for row in weights for v in row]), _tensor("b", [classes], bias), _value(11, "x", [1, 3, side, side]), _value(12, "y", [1, classes]),
    ])
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))
