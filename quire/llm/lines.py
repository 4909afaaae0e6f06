"""Whole texts as numpy tables of characters and lines, for work on every line without a loop over them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_END = "\x1e"


@dataclass
class Lines:
    """codes: characters of all texts; start, stop: where each line begins and ends; text, number: the text
    it belongs to and its number there, from 1; prose: neither blank nor beginning with $$, ![ or %."""

    codes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    number: np.ndarray
    prose: np.ndarray

    def string(self, i: int) -> str:
        return self.codes[self.start[i] : self.stop[i]].tobytes().decode("utf-32-le", "replace")


def lines_of(texts: list[str | None], compose: bool = True) -> Lines:
    """All lines of all texts, nulls as empty texts; compose: characters in composed form (NFC)."""
    flat = [t.replace(_END, " ") if t else "" for t in texts]
    if compose:
        flat = [t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in flat]
    whole = ("\n" + _END).join([*flat, ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
    ends = np.flatnonzero(codes == ord(_END))
    stop = np.flatnonzero(codes == 10)
    text = np.searchsorted(ends, stop)
    start = np.empty_like(stop)
    if len(stop):
        start[0] = 0
        start[1:] = stop[:-1] + 1
        first = np.zeros(len(stop), bool)
        first[0] = True
        first[1:] = text[1:] != text[:-1]
        start[1:] += first[1:]  # the separator stands before the first line of a text
        at = np.flatnonzero(first)
        number = np.arange(len(stop)) - np.repeat(at, np.diff(np.append(at, len(stop)))) + 1
    else:
        number = stop
    c0 = codes[start] if len(start) else start
    c1 = codes[np.minimum(start + 1, len(codes) - 1)] if len(start) else start
    odd = (c0 == 37) | ((c0 == 36) & (c1 == 36)) | ((c0 == 33) & (c1 == 91))
    solid = np.concatenate([[0], np.cumsum(~_SPACE[np.minimum(codes, 0xFFFF)])])
    blank = solid[stop] == solid[start]
    return Lines(codes, start, stop, text, number, ~odd & ~blank)


#: Tables of characters end here, after the last plane that has letters; what lies beyond (tags, selectors and
#: private planes) counts as the last entry.
TOP = 0x32400


def clipped(codes: np.ndarray) -> np.ndarray:
    """Code points as places in tables of TOP entries."""
    return np.minimum(codes, TOP - 1)


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a binary column without nulls holds as bytes, in one array, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    held = column.buffers()[2]
    whole = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and len(column) else np.zeros(0, np.uint8)
    return whole.view(kind), np.diff(at) // np.dtype(kind).itemsize


def binary(numbers: np.ndarray, many: np.ndarray) -> pa.Array:
    """The opposite of flat: a binary column whose rows hold so many numbers each."""
    ends = np.concatenate([[0], np.cumsum(many)]) * numbers.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])


_SPACE = np.zeros(0x10000, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def chunks(b: pa.RecordBatch, column: int, rows: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many rows and, but for single rows, bytes of text in a column.

    This bounds a worker's memory by the longest text instead of by the number of long texts.
    """
    each = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, n in enumerate(each):
        if i > start and (i - start >= rows or total + n > size):
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(each):
        yield b.slice(start)
