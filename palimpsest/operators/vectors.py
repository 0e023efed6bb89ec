"""Exact vector search for one query: distances where the rows lie, then a top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T


def nearest(df: DataFrame, column: str, query: list[float], k: int, id_column: str) -> DataFrame:
    """The k rows nearest to ``query`` with ``distance``, Euclidean in double precision; ties by id.
    Filter before: the answer is exact for whatever rows are left. Vectors of another length and
    those with a null or undefined number take no part.

    Each batch of rows is one block of differences, of which only its own k best leave it.
    """
    wanted = np.asarray(query, dtype=np.float64)
    usable = df.filter(F.size(column) == len(query))
    target = T.StructType([*df.schema.fields, T.StructField("distance", T.DoubleType())])
    at, key = df.columns.index(column), df.columns.index(id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(at).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            apart = flat.reshape(-1, len(wanted)) - wanted
            distance = np.sqrt((apart * apart).sum(1))
            ids = np.array(batch.column(key).to_pylist(), dtype=object)
            good = np.flatnonzero(~np.isnan(distance))
            if len(good) > k:
                good = good[distance[good] <= np.partition(distance[good], k - 1)[k - 1]]
            best = sorted(good.tolist(), key=lambda i: (distance[i], ids[i] is not None, ids[i]))[:k]
            take = batch.take(pa.array(best, pa.int64()))
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array(distance[best], pa.float64())], names=target.names)

    return usable.mapInArrow(run, target).orderBy("distance", id_column).limit(k)
