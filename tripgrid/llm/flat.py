"""Arrow texts as one run of bytes, cut and counted by numpy.

All patterns here are ASCII or two-byte Latin, so bytes of UTF-8 can be classed one by
one: no byte of a longer character looks like an ASCII one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text held at a time; one longer text is held alone.
SLICE = 4_000_000


def slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(position of the first, texts) of stretches of about ``size`` bytes (``SLICE``), one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (size or SLICE), "right")))
        yield at, texts.slice(at, end - at)
        at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each starts and the last ends."""
    big = texts.cast(pa.large_string())
    offsets = np.frombuffer(big.buffers()[1], np.int64, len(big) + 1, big.offset * 8)
    held = big.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def coded(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Stretches of ``data`` between ``ends`` as a code each, and the distinct stretches by code."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    found = pa.LargeStringArray.from_buffers(len(ends) - 1, buffers[1], buffers[2]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def ends_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of ``lengths``."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal stretch of bytes that are ``inside``; none reaches past a text's end."""
    first = np.zeros(len(inside) + 1, bool)
    first[starts] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def text_of(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text that holds each byte position; empty texts hold none."""
    return np.searchsorted(starts, at, "right") - 1
