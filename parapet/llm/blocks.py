"""Documents in compressed blocks of bounded size, one row per block.

Operators that look at whole texts several times read these rows instead of the
documents; a block's number names it when answers come back from other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.storage import written

BLOCK_BYTES = 4 << 20


def block_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES,
                name: str = "blocks") -> DataFrame:
    """block, ids (as strings), n_bytes and data; a longer text is a block by itself. Null texts are empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, total = [], [], 0

        def full() -> pd.DataFrame:
            return pd.DataFrame({"ids": [list(ids)], "n_bytes": [total], "data": [pack(texts)]})

        for b in batches:
            for key, text in zip(b.iloc[:, 0], b.iloc[:, 1]):
                data = (text or "").encode()
                if texts and total + len(data) > size:
                    yield full()
                    ids, texts, total = [], [], 0
                ids.append(key)
                texts.append(data)
                total += len(data)
        if texts:
            yield full()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInPandas(
        run, "ids array<string>, n_bytes long, data binary")
    return written(rows.withColumn("block", F.monotonically_increasing_id()), name, codec="uncompressed")


def pack(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed cell."""
    sizes = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def unpack(cell: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(cell)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    sizes = np.frombuffer(raw, dtype=np.int64, count=n, offset=8)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    return [raw[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


def planes(values: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight side by side, which compresses well."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()
