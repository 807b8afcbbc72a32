"""Slices of texts for operators on single words: a bounded number of bytes at a time, whatever the length of a text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import text_slices


def word_slices(column: pa.Array, word: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like text_slices, but a text longer than `most` bytes comes as several slices of that one row.

    It is cut before a byte that is in no word. A run of word bytes that is longer than `most` stays in one slice.
    """
    for lo, hi, data, offsets in text_slices(column, most):
        if hi - lo > 1 or len(data) <= most:
            yield lo, hi, data, offsets
            continue
        at = 0
        while at < len(data):
            end = min(len(data), at + most)
            while end < len(data) and word[data[end]]:
                step = word[data[end : end + most]]
                end += len(step) if step.all() else int(step.argmin())
            yield lo, hi, data[at:end], np.array([0, end - at], np.int64)
            at = end
