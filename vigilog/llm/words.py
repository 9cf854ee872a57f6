"""Words of whole texts as arrays: places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

#: Characters of texts that are worked on together; a longer text is worked on alone.
GROUP_CHARS = 1 << 20
#: Numbers hashed together up to which tables of powers are kept, two times 16 MB.
_POWERS = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(0, n - 1), base, np.uint64))])[:max(1, n)]


@lru_cache(maxsize=4)
def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    return powers(np.uint64(base), n), powers(np.uint64(pow(base, -1, 1 << 64)), n)


def sequence_hash(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of each stretch of numbers, from all of them in order and their count; stretches follow each other without gaps."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(values) > _POWERS:
        place = np.arange(len(values)) - np.repeat(starts, sizes)
        sums = np.add.reduceat(values * powers(base, int(sizes.max()))[place], starts)
    else:
        # The same sums: powers run on through all stretches, and each stretch's first is divided out.
        up, down = _tables(int(base), 1 << max(16, (len(values) - 1).bit_length()))
        sums = np.add.reduceat(values * up[:len(values)], starts) * down[starts]
    return mix(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words (runs of anything but ASCII white space, A-Z lowered) of some texts.

    `data` has all bytes, a line end after each text; `starts` and `ends` are the words' bytes, `owner` their texts, `hash` their hashes.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
        self.text_ends = np.cumsum([len(r) + 1 for r in raw])
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.n = len(self.starts)
        self.owner = np.searchsorted(self.text_ends, self.starts, side="right")
        sizes = self.ends - self.starts
        letters = self.data[~space].astype(np.uint64) + np.uint64(1)
        self.hash = sequence_hash(letters, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, _P) if self.n else np.zeros(0, np.uint64)


def groups(batches: Iterator[pd.DataFrame], text: str = "text") -> Iterator[pd.DataFrame]:
    """Rows in groups of at most GROUP_CHARS characters, or single longer texts."""
    for batch in batches:
        begin = total = 0
        for k, size in enumerate(batch[text].str.len().fillna(0).astype(int).tolist()):
            if k > begin and total + size > GROUP_CHARS:
                yield batch.iloc[begin:k]
                begin, total = k, 0
            total += size
        if begin < len(batch):
            yield batch.iloc[begin:]


def texts_of(frame: pd.DataFrame, text: str = "text") -> list[str | None]:
    return [t if isinstance(t, str) else None for t in frame[text]]
