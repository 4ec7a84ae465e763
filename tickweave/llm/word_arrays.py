"""Words of many texts as one integer array, for work that numpy does on a slice of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice (and one text at least).
SLICE = 1 << 20
#: Distinct words that a task holds.
CACHE = 200_000


class WordIds(dict):
    """Numbers from 1 in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) + 1
        return found


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[list[bytes | None]]:
    """The texts in order, in lists of about ``size`` bytes."""
    part: list[bytes | None] = []
    held = 0
    for value in texts.cast(pa.binary()):
        part.append(value.as_py())
        held += len(part[-1] or b"")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def numbered(texts: list[list[bytes]], ids: WordIds, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by ``gap`` zeros, and where each text begins (one more for the end)."""
    if len(ids) > CACHE:
        ids.clear()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + gap)])
    out = np.zeros(int(begins[-1]), np.int64)
    for words, at in zip(texts, begins.tolist()):
        out[at : at + len(words)] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    return out, begins


def order_of(keys: np.ndarray) -> np.ndarray:
    """Indices that sort non-negative keys, ties in order of index."""
    bits = max(1, int(len(keys)).bit_length())
    if len(keys) and int(keys.max()).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    packed = np.sort((keys << bits) | np.arange(len(keys)))
    return packed & ((1 << bits) - 1)


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted sequence, the place at which its group of equal keys begins."""
    head = np.ones(len(sorted_keys[0]), bool)
    head[1:] = False
    for key in sorted_keys:
        head[1:] |= key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
