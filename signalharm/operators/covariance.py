"""Shrunk covariance per group from blocks of outer products."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose sums a task holds at once; more are sent on and begun anew.
KEYS_HELD = 64


def centre(df: DataFrame, vector: str, dim: int) -> list[float]:
    """The mean vector of all rows: ``dim`` numbers."""
    row = df.agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()
    return [0.0 if v is None else float(v) for v in row]


def outer_sums(df: DataFrame, keys: list[str], vector: str, pivot: list[float]) -> DataFrame:
    """keys, i, j, total: sums of z_i * z_j (i <= j) over the rows of a key.

    z is 1, the vector minus ``pivot`` and the squared norm of that.  A task adds
    up matrix products of its batches and sends one upper triangle per key, so
    the exchange grows with tasks and keys, not with rows; a hot key is spread
    over all tasks that read it.
    """
    dim = len(pivot)
    upper = np.triu_indices(dim + 2)
    own = df.select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    schema = own.select(*keys).schema.fields
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "i int", "j int", "total double"])
    shift = np.array(pivot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.Field] = []

        def rows():
            names = list(held)
            size = len(upper[0])
            columns = [pa.array([k[c] for k in names for _ in range(size)], t.type) for c, t in enumerate(types)]
            columns += [pa.array(np.tile(u, len(names)).astype("i4")) for u in upper]
            columns.append(pa.array(np.concatenate([held[k][upper] for k in names])))
            return pa.RecordBatch.from_arrays(columns, [*(t.name for t in types), "i", "j", "total"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.schema.field(c) for c in range(len(keys))]
            v = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim) - shift
            z = np.column_stack([np.ones(len(v)), v, (v * v).sum(1)])
            groups: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(keys))))):
                groups.setdefault(key, []).append(at)
            for key, at in groups.items():
                part = z[at]
                held[key] = held[key] + part.T @ part if key in held else part.T @ part
                if len(held) >= KEYS_HELD:
                    yield rows()
                    held = {}
        if held:
            yield rows()

    return own.mapInArrow(run, ddl).groupBy(*keys, "i", "j").agg(F.sum("total").alias("total"))


def shrunk_covariance(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """Mean-free covariance and Ledoit-Wolf shrinkage of ``vector`` per key, all ``dim`` values.

    Rows: keys, n, shrinkage, i, j (1-based, i <= j), covariance (shrunk).  One
    pass for the common centre and one of outer products; what reaches a key's
    last step is a triangle of ``dim + 2`` numbers a side, whatever the size of
    the group.  Vectors that are null, of another length, or hold null or
    non-finite values take no part; a key of such vectors alone has no rows.  A
    key of equal vectors has shrinkage 0.
    """
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.where(F.coalesce((F.size(v) == dim) & whole, F.lit(False)))
    pivot = np.array(centre(df, vector, dim))
    sums = outer_sums(df, keys, vector, list(pivot))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((dim + 2, dim + 2))
        m[part["i"], part["j"]] = part["total"]
        m = m + np.triu(m, 1).T
        n = m[0, 0]
        m /= n
        mean, a, inner = m[0, 1:-1], m[0, -1], m[1:-1, 1:-1]
        cov = inner - np.outer(mean, mean)
        # mean of the squared squared norm of x - mean, from |x|^2 - 2 mean.x + |mean|^2
        b = mean @ mean
        q = m[-1, -1] + 4 * mean @ inner @ mean + b * b - 4 * mean @ m[1:-1, -1] + 2 * a * b - 4 * b * b
        mu, norm = np.trace(cov) / dim, (cov * cov).sum()
        delta, beta = (norm - dim * mu * mu) / dim, (q - norm) / (dim * n)
        shrinkage = min(max(beta, 0.0), delta) / delta if delta > 1e-12 * mu * mu else 0.0
        cov = (1 - shrinkage) * cov + shrinkage * mu * np.eye(dim)
        i, j = np.triu_indices(dim)
        return pd.DataFrame(
            {**dict(zip(keys, key)), "n": int(round(n)), "shrinkage": shrinkage, "i": i + 1, "j": j + 1, "covariance": cov[i, j]}
        )

    return sums.groupBy(*keys).applyInPandas(finish, ", ".join([*schema, "n long, shrinkage double, i int, j int, covariance double"]))
