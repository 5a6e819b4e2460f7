"""Held-out passages inside corpus documents (problem 7).

MinHash containment search over size partitions. Texts are sets of word shingles (SHINGLE words). Documents are partitioned by
the number of their shingles (powers of two); the MinHash signature of a document has one value for each of the bins of its
partition, the least shingle hash that falls into the bin. Test passages are the queries: all their shingle hashes are looked up,
so a value in common means a shingle in common, and the share of a passage's shingles found that way, over the rate at which a
shingle is its bin's least, estimates how much of it the document contains.

The least case shares RUN words, i.e. RUN - SHINGLE + 1 shingles, however long both texts are. A partition has as many bins for its
largest size as make it sure, but for one case in a million (MISSED), that one of these shingles is the least of its bin: documents
of all sizes are found alike. Pairs with a value in common are verified on the texts: a whole run of RUN words must occur in both.

If the passages together have at most INDEX_LETTERS letters (summed first), their index goes to the tasks and a document is signed, looked up and
verified where it is read: nothing but results is shuffled. Larger test sets are joined on the values; the rows are the same.

Null and empty texts and passages match nothing; texts with fewer than RUN words cannot match; whole texts are read."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notebrook.session import dealt

RUN = 12
SHINGLE = 5
#: Chance that the least case shares no MinHash value, and the letters of test passages up to which their index is sent to the tasks.
MISSED, INDEX_LETTERS = 1e-6, 8_000_000
_WORD = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def bins_per_shingle(missed: float = MISSED) -> float:
    """Bins for each shingle at which the least case is missed with this chance. With c bins a shingle, a shingle is the least of its bin
    at the rate c (1 - exp(-1 / c))."""
    wanted = 1 - missed ** (1 / (RUN - SHINGLE + 1))
    low, high = 0.01, 1e6
    while high - low > 1e-3:
        c = (low + high) / 2
        low, high = (c, high) if c * -math.expm1(-1 / c) < wanted else (low, c)
    return high


def shingle_hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of list, 64-bit hash) of every shingle."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if len(owner) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))[codes]
    n = len(h) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    inside = owner[:n] == owner[SHINGLE - 1 :]
    return owner[:n][inside], out[inside]


def signed(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of list, MinHash value): the signature of each word list of at least RUN words, by its size partition."""
    owner, h = shingle_hashes([x if len(x) >= RUN else [] for x in lists])
    if not len(h):
        return owner, h
    sizes = np.bincount(owner, minlength=len(lists))
    partition = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)  # holds sizes up to 2 ** partition
    bins = np.where(sizes > 0, np.ceil(bins_per_shingle() * 2.0**partition), 0).astype(np.int64)
    first = np.r_[0, np.cumsum(bins)]
    at = first[owner] + ((h >> np.uint64(32)).astype(np.int64) * bins[owner] >> 32)
    least = np.full(first[-1], np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at, h)
    kept = np.flatnonzero(least != np.iinfo(np.uint64).max)
    return np.searchsorted(first, kept, "right") - 1, least[kept]


class Index:
    """Shingle hashes and runs of the passages, for tasks. Passages are told apart by position, not by item_id, which may repeat."""

    def __init__(self, items: list[int], passages: list[str]):
        self.items, self.passages = items, passages
        owner, h = shingle_hashes([words(p) for p in passages])
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], owner[order]
        self.runs: dict[int, frozenset] = {}

    def candidates(self, lists: list[list[str]]) -> list[tuple[int, int]]:
        """(index of list, passage) of the pairs with a MinHash value in common."""
        owner, values = signed(lists)
        low, high = (np.searchsorted(self.hashes, values, side) for side in ("left", "right"))
        hit = np.flatnonzero(high > low)
        return sorted({(int(owner[i]), int(p)) for i in hit for p in self.owners[low[i] : high[i]]})

    def of(self, passage: int) -> frozenset:
        if passage not in self.runs:
            self.runs[passage] = _runs(words(self.passages[passage]))
        return self.runs[passage]


def _runs(w: list[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1))


_FOUND = "item_id bigint, doc_id bigint, shared_runs int, item_runs int"
_ARROW = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("shared_runs", pa.int32()), ("item_runs", pa.int32())])


def _searched(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for b in batches:
        keys, lists = b.column(0).to_pylist(), [words(t) for t in b.column(1).to_pylist()]
        rows, last, runs = [], -1, frozenset()
        for i, p in index.candidates(lists):
            if i != last:
                last, runs = i, _runs(lists[i])
            mine = index.of(p)
            if n := len(mine & runs):
                rows.append((index.items[p], keys[i], n, len(mine)))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_ARROW)], schema=_ARROW)


def _values(of: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        owner, h = of([words(t) for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(h.view(np.int64))], names=["key", "sig"])


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        last, runs, shared, sizes = None, frozenset(), [], []
        for doc, passage, text in zip(b["doc_id"], b["passage"], b["text"]):
            if doc != last:
                last, runs = doc, _runs(words(text))
            mine = _runs(words(passage))
            shared.append(len(mine & runs))
            sizes.append(len(mine))
        b["shared_runs"], b["item_runs"] = shared, sizes
        yield b.loc[b["shared_runs"] > 0, ["item_id", "doc_id", "shared_runs", "item_runs"]]


def candidate_pairs(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """passage_no, doc_id: pairs that share a MinHash value, by a join of the values. tests has passage_no, passage."""
    sig = lambda df, key, text, of: df.select(F.col(key).alias("key"), text).mapInArrow(partial(_values, of), "key bigint, sig bigint")
    of_docs = sig(docs, "doc_id", "text", signed).withColumnRenamed("key", "doc_id")
    of_tests = sig(tests, "passage_no", "passage", shingle_hashes).distinct().withColumnRenamed("key", "passage_no")
    return of_docs.join(of_tests, "sig").select("passage_no", "doc_id").distinct()


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id, shared_runs, item_runs (runs of RUN words in common and in the passage)."""
    docs = dealt(documents, "doc_id", "text").where(F.col("text").isNotNull())
    tests = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    if (tests.agg(F.sum(F.length("passage")).alias("n")).first()["n"] or 0) <= INDEX_LETTERS:
        rows = tests.collect()
        index = documents.sparkSession.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["passage"] for r in rows]))
        found = docs.mapInArrow(partial(_searched, index), _FOUND)
    else:
        tests = tests.withColumn("passage_no", F.xxhash64("item_id", "passage"))
        joined = candidate_pairs(docs, tests).join(docs, "doc_id").join(tests, "passage_no").select("item_id", "doc_id", "passage", "text")
        found = joined.mapInPandas(_compared, _FOUND)
    return found.groupBy("item_id", "doc_id").agg(F.max("shared_runs").alias("shared_runs"), F.max("item_runs").alias("item_runs"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item that leaked: documents, and the largest share of its runs in one document."""
    return leaked(documents, items).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.round(F.max(F.col("shared_runs") / F.col("item_runs")), 6).alias("largest_share")
    )
