"""Rows of vectors as the operators on embeddings take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def matrix(column, dtype="f8"):
    """An Arrow list column of one width as a numpy matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def runs(batches, keys: list[str]):
    """(key, batch) for each run of rows with equal ``keys``, in pieces where a run spans batches."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        at = np.append(np.flatnonzero(change), batch.num_rows)
        for a, b in zip(at, at[1:]):
            part = batch.slice(int(a), int(b - a))
            yield tuple(part.column(k)[0].as_py() for k in keys), pa.record_batch(part.columns, names=part.schema.names)


def sample_rows(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those first in the order of a hash of the id."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(most)
