"""A text encoder without a model: hashed character n-grams, projected to a few signed dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lengths of n-grams, and characters that are hashed at a time.
GRAMS, STEP = (2, 3, 4), 1 << 16
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, times in zip((30, 27), _MIX[1:], strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def encoded(text: str, dimensions: int = 64) -> np.ndarray:
    """A text's unit vector (zero for an empty text): each n-gram of its case-folded characters, with a mark at both ends, adds or takes 1 in one dimension."""
    out = np.zeros(dimensions)
    if not text:
        return out.astype(np.float32)
    points = np.frombuffer(f"\x02{text.casefold()}\x03".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in GRAMS:
            for i in range(0, max(0, len(points) - n + 1), STEP):
                part = points[i : i + STEP + n - 1]
                h = np.full(len(part) - n + 1, n, np.uint64)
                for k in range(n):
                    h = _mixed(h * np.uint64(_MIX[0]) + part[k : len(part) - n + 1 + k])
                sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
                out += np.bincount((h % np.uint64(dimensions)).astype(int), sign, dimensions)
    size = np.linalg.norm(out)
    return (out / size if size else out).astype(np.float32)


def encode(words: DataFrame, key: str = "id", text: str = "text", dimensions: int = 64) -> DataFrame:
    """``key, embedding`` of every row of ``words``: whole texts, one map without a shuffle; a null text is as an empty one."""
    rows = words.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encoded(t or "", dimensions) for t in b.column(text).to_pylist()]
            flat = pa.array(np.concatenate(made) if made else np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.FixedSizeListArray.from_arrays(flat, dimensions).cast(pa.list_(pa.float32()))], names=[key, "embedding"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>")
