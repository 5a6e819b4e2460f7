"""Column functions over boundary vectors: ends, binary vectors, padding, labels and scores. No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_ends(ends: Column) -> Column:
    """Ends without negatives and repeats, sorted; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(ends, lambda e: e >= 0)))


def ordered_ends(ends: Column) -> Column:
    """Ends without negatives and repeats, in the order given."""
    return F.array_distinct(F.filter(ends, lambda e: e >= 0))


def valid_ends(ends: Column, limit: int) -> Column:
    """False where there is no end or one is at ``limit`` or beyond."""
    return (F.size(ends) > 0) & ~F.exists(ends, lambda e: e >= limit)


def positions(n: Column) -> Column:
    """0 .. n-1; empty for n < 1 or null."""
    return F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def to_binary(ends: Column, length: Column) -> Column:
    """1 at each end among the positions 0 .. length-1."""
    return F.transform(positions(length), lambda i: F.array_contains(ends, i).cast("int"))


def ends_to_binary(ends: Column) -> Column:
    """As to_binary, up to the last end."""
    return to_binary(ends, F.coalesce(F.array_max(ends) + 1, F.lit(0)))


def to_ends(vector: Column, threshold: float = 0.5) -> Column:
    """Positions of the values above the threshold."""
    at = F.transform(vector, lambda v, i: F.when(v > threshold, i))
    return F.filter(at, lambda i: i.isNotNull())


def above(vector: Column, threshold: float = 0.5) -> Column:
    """1 where a value reaches the threshold."""
    return F.transform(vector, lambda v: (v >= threshold).cast("int"))


def padded(vector: Column, size: int, fill: Column | None = None) -> Column:
    """Cut or filled at the end to exactly ``size`` values."""
    fill = F.lit(0) if fill is None else fill
    return F.concat(F.slice(vector, 1, size), F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - F.size(vector))))


def padding_mask(length: Column, size: int) -> Column:
    """True where a vector of that length is padding; an error column has to keep longer ones out."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i >= length)


def cut(vector: Column, length: Column, size: int) -> Column:
    """The first ``length`` values, filled up to ``size`` with zeros."""
    return padded(F.slice(vector, F.lit(1), length), size)


def count_where(a: Column, b: Column, test) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(test(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def jaccard_similarity(truth: Column, guess: Column) -> Column:
    """1 - share of differing positions among those set in either; 1 if none is set."""
    either, differ = count_where(truth, guess, lambda x, y: (x + y) > 0), count_where(truth, guess, lambda x, y: x != y)
    return F.when(either == 0, F.lit(1.0)).otherwise(1 - differ / either)


def hamming(truth: Column, guess: Column) -> Column:
    return count_where(truth, guess, lambda x, y: x != y)


def wasserstein_count(truth: Column, guess: Column) -> Column:
    """Distance of the value distributions times the length: for 0/1 vectors the difference of the numbers of ones."""
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    return F.abs(total(truth) - total(guess))


def segment_of(ends: Column, position: Column) -> Column:
    """Index of the first segment whose end is at or after the position; -1 if there is none."""
    return (F.array_position(F.transform(ends, lambda e: e >= position), True) - 1).cast("int")


def sizes_to_ends(sizes: Column) -> Column:
    """Last position of each part, given their sizes; parts without members repeat the end before and are dropped."""
    start = F.struct(F.lit(0).cast("int").alias("n"), F.array().cast("array<int>").alias("ends"))
    fold = F.aggregate(sizes, start, lambda s, x: F.struct((s["n"] + x).cast("int").alias("n"), F.concat(s["ends"], F.array((s["n"] + x - 1).cast("int"))).alias("ends")))
    return F.array_distinct(fold["ends"])


def segment_sizes(ends: Column, total: Column) -> Column:
    """Sizes of the parts that the ends cut 0 .. total-1 into; what is left over is the last part."""
    closed = F.when(F.coalesce(F.array_max(ends), F.lit(-1)) < total - 1, F.concat(ends, F.array((total - 1).cast("int")))).otherwise(ends)
    return F.transform(closed, lambda e, i: e - F.when(i > 0, F.try_element_at(closed, i)).otherwise(F.lit(-1)))


def uniform_labels(ends: Column, total: Column) -> Column:
    """1 / size of the segment, for each position."""
    return F.flatten(F.transform(segment_sizes(ends, total), lambda n: F.array_repeat(F.lit(1.0) / n, n)))


def exponential_labels(ends: Column, total: Column, rate: float = 2.0) -> Column:
    """Mass of an exponential distribution in unit steps back from the end of the segment; the first position takes the
    tail beyond it. Masses below 1e-6 are 0."""

    def segment(n):
        def mass(i):
            back = n - 1 - i
            near = F.exp(-rate * back)
            value = F.when(i == 0, F.when(n == 1, F.lit(1 - 2.718281828459045**-rate)).otherwise(near)).otherwise(near - F.exp(-rate * (back + 1)))
            return F.when(value < 1e-6, F.lit(0.0)).otherwise(value)

        return F.transform(F.sequence(F.lit(0), n - 1), mass)

    return F.flatten(F.transform(segment_sizes(ends, total), segment))


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i + 1, F.lit(n)))).otherwise(F.array())


def fenced_blocks(text: Column, language: str = "python") -> Column:
    """Bodies of the fenced blocks of a language, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\n(.*?)```"), F.lit(1))


def json_blocks(text: Column) -> Column:
    """Values of the fenced JSON objects; a block that was cut off is closed and read."""
    whole = F.regexp_extract_all(text, F.lit(r"(?s)```json(.*?)```"), F.lit(1))
    open_ = F.concat(F.regexp_extract(text, r"(?s)```json(.*?)$", 1), F.lit('"]}'))
    bodies = F.when(F.size(whole) > 0, whole).otherwise(F.array(open_))
    return F.flatten(F.filter(F.transform(bodies, lambda b: F.map_values(F.from_json(b, "map<string,array<string>>"))), lambda v: v.isNotNull()))


def split_at_comments(lines: Column) -> Column:
    """Blocks of lines, a new one at each line that starts with #."""
    empty = F.array().cast("array<string>")
    grow = lambda s, x: F.when(
        F.startswith(x, F.lit("#")) & (s["now"] != ""), F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now"))
    ).otherwise(F.struct(s["done"].alias("done"), F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit("\n"), x)).alias("now")))
    end = lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
    return F.aggregate(lines, F.struct(empty.alias("done"), F.lit("").alias("now")), grow, end)


def stages(text: Column) -> Column:
    """Bodies of the stages that a response numbers on lines of their own."""
    return F.filter(F.transform(F.split(text, r"(?m)^Stage \d+:[ \t]*\r?$"), lambda x: F.trim(x, F.lit("\r\n"))), lambda x: x != "")


def preview(lines: Column, width: int = 80) -> Column:
    """The first characters of a cell on one line."""
    joined = F.array_join(lines, " ")
    return F.when(F.length(joined) > width, F.concat(F.substring(joined, 1, width), F.lit("..."))).otherwise(joined)


def without_ranges(text: Column, ranges: Column) -> Column:
    """Text without the [begin, end) ranges, which are sorted and do not overlap."""
    step = lambda s, r: F.struct(
        F.concat(s["kept"], F.substring(text, s["at"] + 1, F.greatest(F.lit(0), r["begin"] - s["at"]))).alias("kept"), r["end"].alias("at")
    )
    return F.aggregate(ranges, F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")), step, lambda s: F.concat(s["kept"], F.substring(text, s["at"] + 1, F.length(text))))


def span_text(lines: Column, line: Column, column: Column, end_line: Column, end_column: Column, joint: str = "\n") -> Column:
    """Text of the span from (line, column) to before (end_line, end_column), counted from 0, its lines joined by ``joint``."""
    first, last = F.try_element_at(lines, line + 1), F.try_element_at(lines, end_line + 1)
    between = F.slice(lines, line + 2, F.greatest(end_line - line - 1, F.lit(0)))
    several = F.array_join(F.concat(F.array(F.substring(first, column + 1, F.length(first))), between, F.array(F.substring(last, F.lit(1), end_column))), joint)
    return F.when(line == end_line, F.substring(first, column + 1, end_column - column)).otherwise(several)


def character_span(text: Column, begin: Column, end: Column) -> Column:
    """The characters [begin, end) of a text."""
    return F.substring(text, begin + 1, end - begin)


def without_c_comments(text: Column) -> Column:
    """Code of a C-like language without // and /* */ comments, a space for each; quoted strings stay, blank lines go."""
    literal = r'("(?:\\(?:.|\n)|[^\\"])*+"|' + r"'(?:\\(?:.|\n)|[^\\'])*+')"
    marked = F.regexp_replace(text, literal + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1\x01")
    spaced = F.replace(F.regexp_replace(marked, "([\"'])\x01", "$1"), F.lit("\x01"), F.lit(" "))
    return F.array_join(F.filter(F.split(spaced, "\n"), lambda x: x.rlike(r"\S")), "\n")


def flattened(nested: Column, levels: int) -> Column:
    """An array of arrays, ``levels`` deep, as one array; null arrays inside count as empty."""
    for _ in range(levels):
        nested = F.flatten(F.filter(nested, lambda x: x.isNotNull()))
    return nested


def valid_rows(ranges: list[Column], columns: list[Column]) -> Column:
    """Whether all ranges hold or no column is null; an unknown range does not hold."""
    holds, whole = F.lit(True), F.lit(True)
    for r in ranges:
        holds = holds & F.coalesce(r, F.lit(False))
    for c in columns:
        whole = whole & c.isNotNull()
    return holds | whole
