"""Delimited records: quote-aware assembly, strict parsing, and rows that fail kept with their reason.

``assemble`` joins the physical lines of files into records, ``parse`` separates good from bad. A null record has no fields
(``column_count``). Bad rows are never dropped; equal records under several ids are judged each."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NUMBER = re.compile(r" *([0-9]+)(?:\.0+)? *")
csv.field_size_limit(2**31 - 1)


class Invalid(Exception):
    """A record that is not a row; its argument is the reason."""


def fields(record: str) -> list[str]:
    """The fields of one record by Python's strict reader. Line breaks are data here, wherever they stand, so they are masked
    from the reader, which would end an unquoted field at them."""
    for end in ("\r\n", "\n", "\r"):
        if record.endswith(end):
            record = record[: -len(end)]
            break
    free, masked = [], record
    if "\r" in record or "\n" in record or "\0" in record:
        private = (chr(c) for c in range(0xE000, 0xF900))
        free = list(islice((c for c in private if c not in record), 3))
        masked = record.replace("\r", free[0]).replace("\n", free[1]).replace("\0", free[2])
    try:
        row = next(csv.reader([masked], strict=True), None) or [""]
    except csv.Error:
        raise Invalid("quoting") from None
    at = 0
    for f in row:  # the reader takes quotes inside an unquoted field: those are not legal here
        if masked.startswith('"', at):
            at += len(f) + f.count('"') + 2
        elif '"' in f:
            raise Invalid("quoting")
        else:
            at += len(f)
        at += 1
    if free:
        row = [f.replace(free[0], "\r").replace(free[1], "\n").replace(free[2], "\0") for f in row]
    return row


def whole_number(text: str, least: int, most: int) -> int:
    m = _NUMBER.fullmatch(text)
    if not m or len(m[1].lstrip("0")) > 19 or not least <= int(m[1]) <= most:
        raise Invalid("invalid_value")
    return int(m[1])


def code_row(record: str | None) -> tuple[int, int, str]:
    """kernel_id, cell_id, source; raises Invalid with the first reason that holds."""
    row = fields(record) if record is not None else []
    if len(row) != 3:
        raise Invalid("column_count")
    kernel, cell = whole_number(row[0], 1, 2**63 - 1), whole_number(row[1], 0, 2**31 - 1)
    if not row[2].strip():
        raise Invalid("invalid_value")
    return kernel, cell, row[2]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for record in b.column(4).to_pylist():
            try:
                out.append((*code_row(record), None))
            except Invalid as e:
                out.append((None, None, None, str(e)))
        columns = zip(*out) if out else ((), (), (), ())
        new = [pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *new], names=_PARSED)


_PARSED = ["record_id", "file_name", "line_no", "received_at", "kernel_id", "cell_id", "source", "reason"]


def parse(raw: DataFrame) -> DataFrame:
    """record_id, file_name, line_no, received_at, kernel_id, cell_id, source, reason: reason is null for a good row, the
    three columns are null for a bad one. No shuffle: each record is judged where it is read."""
    kept = raw.select("record_id", "file_name", "line_no", "received_at", "record")
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes[:4]) + ", kernel_id bigint, cell_id int, source string, reason string"
    return kept.mapInArrow(_parsed, schema)


def rejected(raw: DataFrame) -> DataFrame:
    return parse(raw).where("reason is not null").select("record_id", "reason").distinct()


def loaded(raw: DataFrame) -> DataFrame:
    """The good rows in the shape of ``code``."""
    return parse(raw).where("reason is null").select("kernel_id", "cell_id", "source", F.col("received_at").alias("loaded_at"))


#: Lines that one task assembles, and the lines that a record may have at most: a field that is not closed within them is never closed.
BLOCK_LINES, RECORD_LINES = 32_768, 4_096
#: A line that begins like a record: two short first fields, one of them a number, quoted or not. A broken record ends before the next such line.
_NUMERAL, _SHORT, _OTHER = (rf'\s*"?\s*{x}\s*"?\s*' for x in (r"[0-9]+(?:\.0+)?", r"[\w.+-]{0,24}", r'[^",()\[\]{}=]{0,24}'))
_BEGINS = re.compile(f"{_NUMERAL},{_OTHER},|{_SHORT},{_NUMERAL},|{_NUMERAL},{_NUMERAL}$")


def _line_state(line: str, inside: bool) -> str:
    """closed, open (a quoted field goes on) or broken, after a line that begins at the start of a field or inside a quoted one."""
    at, end = 0, len(line) - line.endswith("\r")
    while True:
        if inside:
            while True:
                quote = line.find('"', at)
                if quote < 0:
                    return "open"
                if line.startswith('"', quote + 1):
                    at = quote + 2
                    continue
                at = quote + 1
                break
            if at >= end:
                return "closed"
            if line[at] != ",":
                return "broken"
            at += 1
        if line.startswith('"', at):
            inside, at = True, at + 1
            continue
        inside = False
        comma, quote = line.find(",", at), line.find('"', at)
        if quote >= 0 and (comma < 0 or quote < comma):
            return "broken"
        if comma < 0:
            return "closed"
        at = comma + 1


def record_lines(lines: list[str], i: int, most: int = RECORD_LINES) -> int:
    """How many lines the record takes that starts at line i. A quoted field may go over several lines; if it is never closed, or closed by
    a quote that cannot end it, the record is broken and takes what stands before the next line that begins like a record."""
    first = lines[i]
    if '"' not in first:
        return 1
    last, state, j = min(len(lines), i + most), _line_state(first, False), i
    while state == "open" and j + 1 < last:
        j += 1
        if '"' in lines[j]:
            state = _line_state(lines[j], True)
    if state == "closed":
        return j - i + 1
    return next((k for k in range(i + 1, last) if _BEGINS.match(lines[k])), last) - i


def block_exits(lines: list[str], size: int, most: int = RECORD_LINES) -> list[tuple[int, int]]:
    """(entry, exit): where the first record after a block of ``size`` lines starts, in lines behind it, if its own first record starts at line
    ``entry`` or at one after it up to the next entry of the list. lines goes on behind the block. Ways through a block soon meet."""
    exits: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    for entry in range(min(size, most) + 1):
        i, way = entry, []
        while i < size and i not in exits:
            way.append(i)
            i += record_lines(lines, i, most)
        leaves = exits[i] if i < size else i - size
        exits.update(dict.fromkeys(way, leaves))
        if not out or out[-1][1] != leaves:
            out.append((entry, leaves))
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_name, line_no (from 0), line of text files. Lines end at LF; a CR before it stays part of the line."""
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")
    )
    # the lines of a part of a file stand together in one partition, so their numbers follow each other; one row per part is ordered over a file
    parts = raw.groupBy("file_name", "start").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file_name", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(parts, ["file_name", "start"]).select("file_name", (F.col("pos") + F.col("shift")).alias("line_no"), "line")


def assemble(lines: DataFrame) -> DataFrame:
    """file_name, line_no, record: the records of numbered lines, quote-aware, with their line breaks as they are.

    Lines are cut into blocks. Whether a block starts inside a record depends on all before it, but a block can say for each line at which
    its first record may start where the first record behind it starts; ways soon meet, so that is a short list. Only these lists are ordered
    over a file; then each block is assembled on its own. A stray quote spoils its own record only."""
    size_of_block, most = BLOCK_LINES, RECORD_LINES
    block = F.floor(F.col("line_no") / size_of_block)
    at = F.col("line_no") % size_of_block
    # a block also sees the lines behind it in which its last record may end
    seen = F.when((at < most) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    spread = lines.where(F.col("line_no").isNotNull() & F.col("line").isNotNull()).select("file_name", F.explode(seen).alias("block"), "line_no", "line")

    def numbered(rows: pd.DataFrame) -> tuple[int, list[str], int]:
        rows = rows.sort_values("line_no")
        first = int(rows["block"].iloc[0]) * size_of_block
        return first, rows["line"].tolist(), int((rows["line_no"] < first + size_of_block).sum())

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        first, text, size = numbered(rows)
        found = block_exits(text, size, most)
        return pd.DataFrame({"file_name": rows["file_name"].iloc[:1], "block": [first // size_of_block], "ways": [[{"entry": a, "leaves": b} for a, b in found]]})

    ways = spread.groupBy("file_name", "block").applyInPandas(exits, "file_name string, block bigint, ways array<struct<entry int, leaves int>>")
    ways = ways.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("x"))
    step = lambda done, b: F.struct(
        F.element_at(F.filter(b["ways"], lambda w: w["entry"] <= done["at"]), -1)["leaves"].alias("at"),
        F.concat(done["entries"], F.array(F.struct(b["block"].alias("block"), done["at"].alias("entry")))).alias("entries"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<block bigint, entry int>>").alias("entries"))
    entries = ways.select("file_name", F.inline(F.aggregate("x", start, step, lambda done: done["entries"])))

    def records(rows: pd.DataFrame) -> pd.DataFrame:
        first, text, size = numbered(rows)
        i, out = int(rows["entry"].iloc[0]), []
        while i < size:
            n = record_lines(text, i, most)
            out.append((rows["file_name"].iloc[0], first + i, "\n".join(text[i : i + n])))
            i += n
        return pd.DataFrame(out, columns=["file_name", "line_no", "record"])

    return spread.join(entries, ["file_name", "block"]).groupBy("file_name", "block").applyInPandas(records, "file_name string, line_no bigint, record string")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of raw records, parsed: the same columns as ``parse``; line_no counts from 0, received_at is null."""
    records = assemble(read_lines(spark, path))
    return parse(records.select(F.xxhash64("file_name", "line_no").alias("record_id"), "file_name", "line_no", F.lit(None).cast("timestamp").alias("received_at"), "record"))


def to_files(raw: DataFrame, path: str, page: int = 100_000) -> None:
    """The records as files of lines, in the order of line_no; a file of many lines becomes several of ``page`` line numbers."""
    text = F.regexp_replace("record", "\n$", "").alias("value")
    paged = raw.where("record is not null").select("file_name", F.floor(F.col("line_no") / page).alias("page"), "line_no", text)
    paged.repartition("file_name", "page").sortWithinPartitions("file_name", "page", "line_no").drop("line_no").write.partitionBy("file_name", "page").text(path)
