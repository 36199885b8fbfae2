"""A deterministic embedder without a model: signed hashes of words and word pairs."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import words

SIZE = 256
#: Rows of a batch of vectors.
ROWS = 1024


def _embed(size: int, most: int):
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        # A row at a time: a batch's words as Python strings take many times its bytes.
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            for row in batch.column(1):
                terms = row.as_py() or []
                v = np.zeros(size)
                for feature in [*terms, *(f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False))]:
                    hit = known.get(feature)
                    if hit is None:
                        digest = blake2b(feature.encode(), digest_size=8).digest()
                        hit = (int.from_bytes(digest[:4], "little") % size, 1.0 if digest[4] & 1 else -1.0)
                        if len(known) < most:
                            known[feature] = hit
                    v[hit[0]] += hit[1]
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.float32()))], schema=schema)

    return run, "id bigint, vector array<float>"


def hash_embeddings(rows: DataFrame, size: int = SIZE, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, vector): unit vectors; a text without words has the zero vector."""
    terms = words(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.select(F.col(id_col).alias("id"), terms.alias("terms")).mapInArrow(*_embed(size, 200_000))
