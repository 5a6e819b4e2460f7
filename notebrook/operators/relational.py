"""Relational operators of the corpus: nesting, unnesting, keyed updates, deletes, ingest and integrity checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notebrook.session import latest


def nest(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Parents with an array of their children's structs in order; empty where there are none."""
    kept = [c for c in children.columns if c != key and c != order]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *kept))).alias(name))
    out = parents.join(lists, key, "left")
    kind = dict(out.dtypes)[name]
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def paged(parents: DataFrame, children: DataFrame, key: str, order: str, name: str, page: int = 1000) -> DataFrame:
    """As nest, one row per page of ``page`` positions, so that no row grows with a notebook; a parent without children has one
    empty page."""
    numbered = children.withColumn("page", F.floor(F.col(order) / page))
    kept = [c for c in children.columns if c != key and c != order]
    lists = numbered.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct(order, *kept))).alias(name))
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(dict(out.dtypes)[name]))).withColumn("page", F.coalesce("page", F.lit(0)))


#: Rows of the small side up to which it is broadcast, and rows of one key that go to one task.
FEW, SALT_ROWS = 200_000, 1_000_000


def spread_join(many: DataFrame, few: DataFrame, key: str, spread: str, rows: int | None = None) -> DataFrame:
    """Inner join where one key may hold a large share of ``many``, ``few`` has one short row per key. Up to FEW rows (counted, or given as
    ``rows``) are broadcast. Beyond that the rows of ``many`` are spread by the hash of a column over as many keys as its largest
    key has lots of SALT_ROWS, for each of which the row of ``few`` is repeated."""
    if (few.count() if rows is None else rows) <= FEW:
        return many.join(F.broadcast(few), key)
    largest = many.groupBy(key).count().agg(F.max("count").alias("n")).first()["n"] or 0
    salts = -(-largest // SALT_ROWS)
    if salts <= 1:
        return many.join(few, key)
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(few, [key, "_salt"]).drop("_salt")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both sides, one row per key: the latest version wins."""
    return latest(old.unionByName(new), keys, version)


def without(df: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not removed; rows with a null key stay."""
    return df.join(removed.select(*keys).distinct(), keys, "left_anti")


def updated(df: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A column replaced where there is a change for the key; no rows are added."""
    return df.join(changes.select(*keys, F.col(column).alias("_new")), keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Appends the folders of ``key`` that are not there yet; which are there is known from their names alone."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        df = df.join(spark.read.parquet(path).select(F.col(key).cast(dict(df.dtypes)[key])).distinct(), key, "left_anti")
    df.repartition(key).write.mode("append").partitionBy(key).parquet(path)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def lowest(df: DataFrame, keys: list[str], order: list[str], n: int, salts: int = 64) -> DataFrame:
    """The n lowest rows of each group along ``order`` (unique within it). A group is cut by a hash first and each part keeps its n lowest, so that no
    task ranks more than a part of a large group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for by in ([*keys, "_salt"], keys):
        salted = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
    return salted.drop("_salt")


def borrowed(books: DataFrame, most: int, columns: int) -> DataFrame:
    """x, y, from_x, notebook_id: for each bin (x, y), x below ``columns``, the ``most`` lowest notebooks with different ends; a bin that is
    short goes on with what is left of (x + 1, y), then of the next, before those are filled themselves. books has
    notebook_id, x, y, ends."""
    once = books.groupBy("x", "y", "ends").agg(F.min("notebook_id").alias("notebook_id"))
    # a bin gives to at most ``columns`` bins, each of which takes ``most`` and passes over fewer than ``most``: the lowest are enough
    once = lowest(once, ["x", "y"], ["notebook_id", "ends"], most * (columns + 1))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        left = {x: list(zip(g["notebook_id"], g["ends"])) for x, g in rows.sort_values(["notebook_id", "ends"]).groupby("x")}
        out = []
        for x in range(columns):
            seen: set[str] = set()
            for z in range(x, columns):
                rest = []
                for book, ends in left.get(z, ()):
                    if len(seen) < most and ends not in seen:
                        seen.add(ends)
                        out.append((x, rows["y"].iloc[0], z, book))
                    else:
                        rest.append((book, ends))
                left[z] = rest
        return pd.DataFrame(out, columns=["x", "y", "from_x", "notebook_id"])

    return once.groupBy("y").applyInPandas(fill, "x int, y int, from_x int, notebook_id bigint")


def imported_modules(lines: Column) -> Column:
    """Top-level names that a cell's lines import."""
    names = F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*(?:import|from)\s+([A-Za-z_]\w*)", 1))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def ingest(records: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notebooks, cells) of code records whose kernel is not there yet. Cells keep their number as order; a cell loaded
    several times is kept once, the latest."""
    fresh = latest(records.where("kernel_id is not null and source is not null"), ["kernel_id", "cell_id"], "loaded_at")
    fresh = fresh.join(existing.select(F.col("notebook_id").alias("kernel_id")).distinct(), "kernel_id", "left_anti")
    cells = fresh.select(
        F.col("kernel_id").alias("notebook_id"), "cell_id", F.lit("code").alias("type"), F.split("source", "\r?\n").alias("content"), "loaded_at"
    )
    books = cells.groupBy("notebook_id").agg(F.count("*").alias("n_cells"), F.sum(F.size("content")).alias("n_code_lines"), F.max("loaded_at").alias("loaded_at"))
    return books, cells
