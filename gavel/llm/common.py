"""What several operators share: text rules and vectorised word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.workspace import Workspace  # noqa: F401  the operators take it from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A top-level column, whatever its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: operators carry it beside columns of their own, so that no name can clash."""
    return F.struct(*[column(c) for c in df.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ---- vectorised hashing of words, for Arrow batches -------------------------------------------------------------

#: A-Z to a-z, as bytes; UTF-8 never uses these bytes inside a longer character.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts, in order.

    A polynomial hash by prefix sums modulo 2**64 over random byte values: no Python object per word.  A word's hash depends on
    its bytes alone, so long texts are hashed in stretches that end at white space.
    """

    STRETCH = 1 << 17

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INV)):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.cumprod(out))

    def __call__(self, data: bytes) -> np.ndarray:
        if len(data) <= self.STRETCH:
            return self.stretch(np.frombuffer(data, np.uint8))
        b, out, at = np.frombuffer(data, np.uint8), [], 0
        while at < len(b):
            end = at + self.STRETCH
            while end < len(b) and not (gaps := np.flatnonzero(_SPACE[b[end : end + self.STRETCH]])).size:
                end += self.STRETCH
            end = len(b) if end >= len(b) else end + int(gaps[0])
            out.append(self.stretch(b[at:end]))
            at = end
        return np.concatenate(out)

    def stretch(self, b: np.ndarray) -> np.ndarray:
        if not len(b):
            return np.empty(0, np.uint64)
        self.powers(len(b))
        edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.up[: len(b)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles of word hashes; with fewer words, of the whole sequence as one."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(width, len(words)), np.uint64)
    for i in range(min(width, len(words))):
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n])
    return np.unique(h)
