"""Exact nearest neighbours by blocked matrix products, and incremental loads of vectors.

Vectors are packed into blocks of bounded size; every pair of a query block and a row block is one task's product. Nothing
is broadcast and no pair of single rows is ever shuffled: each block pair sends on at most k rows for each query. Vectors that are null or of
another length than the queries' are left out; ties go to the lower id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notebrook.session import written

BLOCK_ROWS = 2048
#: Queries whose candidates are compared exactly at once: with nothing but copies, QUERY_ROWS * BLOCK_ROWS differences.
QUERY_ROWS = 64


def _blocks(df: DataFrame, key: str, vector: str, name: str) -> tuple[DataFrame, int]:
    """(block number, ids, vectors) and how many blocks there are."""
    count = max(1, -(-df.count() // BLOCK_ROWS))
    packed = (
        df.where(F.col(vector).isNotNull())
        .select(F.pmod(F.xxhash64(key), F.lit(count)).alias(name), F.struct(F.col(key).alias("id"), F.col(vector).alias("v")).alias("x"))
        .groupBy(name)
        .agg(F.collect_list("x").alias("x"))
        .select(name, F.transform("x", lambda x: x["id"]).alias(f"{name}_ids"), F.transform("x", lambda x: x["v"]).alias(f"{name}_rows"))
    )
    return packed, count


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, rank (from 1), neighbour, distance (Euclidean): the k nearest of all rows but the query itself."""
    q, nq = _blocks(queries, key, vector, "q")
    r, nr = _blocks(rows, key, vector, "r")
    q, r = written(q, "queries"), written(r, "rows")
    pairs = q.withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nr - 1).cast("bigint")))).join(r, "r")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qv, ri, rv in zip(b["q_ids"], b["q_rows"], b["r_ids"], b["r_rows"]):
                a = np.stack([np.asarray(v, np.float64) for v in qv])
                same = [i for i, v in enumerate(rv) if len(v) == a.shape[1]]
                if not same:
                    continue
                c, ids = np.stack([np.asarray(rv[i], np.float64) for i in same]), np.asarray(ri)[same]
                norms, others = (a * a).sum(1), (c * c).sum(1)
                d = np.maximum(norms[:, None] + others[None, :] - 2 * a @ c.T, 0)
                d[np.asarray(qi)[:, None] == ids[None, :]] = np.inf
                # all rows as near as the k-th, within the rounding of the product: copies are at the same distance, the lower ids go first
                rounding = 8 * np.finfo(float).eps * a.shape[1] * (norms + others.max())
                limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1] + rounding
                near = (d <= limit[:, None]) & np.isfinite(d)
                for start in range(0, len(a), QUERY_ROWS):
                    who, which = np.nonzero(near[start : start + QUERY_ROWS])
                    who += start
                    exact = np.sqrt(((a[who] - c[which]) ** 2).sum(1))
                    order = np.lexsort((ids[which], exact, who))
                    who, which, exact = who[order], which[order], exact[order]
                    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
                    yield pd.DataFrame({"query": np.asarray(qi)[who][keep], "neighbour": ids[which][keep], "distance": exact[keep]})

    found = pairs.select("q_ids", "q_rows", "r_ids", "r_rows").mapInPandas(products, "query bigint, neighbour bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "neighbour", "distance")


def new_vectors(incoming: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Vectors whose key is not loaded yet."""
    return incoming.join(loaded.select(key).distinct(), key, "left_anti").dropDuplicates([key])
