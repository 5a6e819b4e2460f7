"""Token ids of a whole corpus by a public byte-level BPE (problem 6).

Each task collects the distinct pre-tokens of a batch of texts into a byte trie and walks it depth first. A node stands for
a prefix; its state is the last token of that prefix's encoding. The encoding of a prefix is the encoding of what is
before its last token plus that token, so a node's state follows from its ancestors' states: the last token is the one
suffix token that is compatible with the state where it begins. Prefixes that words share are computed once.

Null and empty texts have an empty list of ids. Texts are encoded whole; repeated documents are encoded each."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notebrook.session import dealt

#: The pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words kept by a Python worker before it starts a new trie; bounds memory, never changes a result.
TRIE_WORDS = 400_000


class TrieEncoder:
    """The trie of one Python worker. ``ids(word)`` gives the token ids of a pre-token."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.tails = self._tails()
        self.pair: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.clear()

    def _tails(self) -> set[bytes]:
        """Every suffix of a token: a trie node can stop looking back when its path's suffix is none of these."""
        return {t[i:] for t in self.rank for i in range(len(t))}

    def clear(self) -> None:
        self.words = {}
        self.spans: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging by rank; only used on two-token strings, to decide whether the two may stand side by side."""
        rank, parts = self.rank, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pair.get((left, right))
        if known is None:
            known = self.pair[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def insert(self, words: list[str]) -> None:
        """Encode new words together: sorted, so that the walk over them is the depth-first walk over their trie and
        the states of the prefix that a word shares with the one before it are kept on the stack."""
        rank, tails, compatible, known = self.rank, self.tails, self.compatible, self.words
        coded = sorted((w.encode("utf-8", "replace"), w) for w in words)
        before, states = b"", [-1]
        for path, word in coded:
            whole = rank.get(path)
            shared, most = 0, min(len(before), len(path))
            while shared < most and before[shared] == path[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(path) + 1):
                begin, state = end - 1, -1
                while begin >= 0:
                    tail = path[begin:end]
                    if tail not in tails:
                        break
                    token = rank.get(tail)
                    if token is not None and (begin == 0 or compatible(states[begin], token)):
                        if begin or self._whole(tail, token):
                            state = token
                            break
                    begin -= 1
                states.append(state)
            before, at, ids = path, len(path), []
            if whole is not None and states[at] == whole:
                known[word] = [whole]
                continue
            while at > 0:
                ids.append(states[at])
                at -= len(self.token[states[at]])
            known[word] = ids[::-1]

    def _whole(self, piece: bytes, token: int) -> bool:
        """Whether a vocabulary entry is reached by merging its own bytes."""
        known = self.pair.get((-1, token))
        if known is None:
            known = self.pair[-1, token] = self.merged(piece) == [token]
        return known


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> TrieEncoder:
    return TrieEncoder(vocabulary)


_SPACED = re.compile(r" (?=[^\s]|[\x1c-\x1f])")


def encode_texts(texts: list[str], encoder: TrieEncoder) -> list[list[int]]:
    """Ids of each text. A space before a visible character always begins a pre-token, so texts are cut there first and
    what is between two cuts is looked up as a whole; pre-tokens not met before go through the trie together."""
    if len(encoder.spans) > TRIE_WORDS:
        encoder.clear()
    spans, split = encoder.spans, regex.compile(PATTERN).findall
    cut = [_SPACED.split(t) if t else None for t in texts]
    heads = {c[0] for c in cut if c and c[0]}
    fresh = {f" {x}" for c in cut if c for x in c[1:] if x not in spans}
    pieces = {x: split(x) for x in fresh}
    pieces_of_heads = {x: split(x) for x in heads}
    words = set(chain.from_iterable(pieces.values())).union(chain.from_iterable(pieces_of_heads.values())) - encoder.words.keys()
    if words:
        encoder.insert(list(words))
    ids = encoder.words.__getitem__
    for x, p in pieces.items():
        spans[x[1:]] = list(chain.from_iterable(map(ids, p)))
    first = {x: list(chain.from_iterable(map(ids, p))) for x, p in pieces_of_heads.items()}
    first[""] = []
    at = spans.__getitem__
    return [first[c[0]] + list(chain.from_iterable(map(at, c[1:]))) if c else [] for c in cut]


def encode_corpus(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``ids array<int>`` of every row; vocabulary is the path of a rank file that all executors see."""
    schema = f"{id_column} {dict(documents.dtypes)[id_column]}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for b in batches:
            found = encode_texts(b.column(1).to_pylist(), encoder)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(ends[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_column, "ids"])

    return dealt(documents, id_column, text_column).mapInArrow(run, schema)


def corpus_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Documents and tokens per source, for budgeting."""
    ids = encode_corpus(documents, vocabulary)
    sources = documents.select("doc_id", "source")
    return ids.select("doc_id", F.size("ids").alias("n")).join(sources, "doc_id").groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 0).alias("empty")
    )
