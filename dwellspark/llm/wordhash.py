"""Words as 64-bit hashes, and packed rows that travel between tasks: shared by operators 2 and 9."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

from dwellspark.llm.common import WORD

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Known(dict):
    """Hashes of words seen by this worker, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_KNOWN = _Known()
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def lowered(text: str) -> str:
    """A to Z in lower case, other letters as they are."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads near ones."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, by their start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _M1 + h[j : j + n]
    return mixed(out)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpacked(raw: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """kinds: (dtype, width) of each column; of width above 1, a matrix."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    row = sum(np.dtype(t).itemsize * w for t, w in kinds)
    n, at, out = len(data) // row, 0, []
    for t, w in kinds:
        size = n * w * np.dtype(t).itemsize
        column = np.frombuffer(data, t, n * w, at)
        out.append(column.reshape(n, w) if w > 1 else column)
        at += size
    return out
