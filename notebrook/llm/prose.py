"""Running text in comments and string literals of code (problem 4).

1. Comments and literals are cut out of every code cell by the rules of its notebook's language; neighbouring comment lines
   and literals that the language joins are one span. Commented-out code, SQL, commands, paths, patterns, markup and
   names leave no or too few words and end here.
2. Spans are deduplicated by a 128-bit hash; each distinct one is classified once by the fitted language field: its language,
   and whether it is running text (at least four words or eight Chinese or Japanese characters, most of them known).
3. The labels are joined back to all spans, weighted by bytes, to give each cell's and notebook's shares.

Cells without a notebook, or in a language without rules, have no spans. Null lines are skipped; empty cells have no
shares. Rows delivered twice count once; texts are read whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notebrook.llm.language import LANGUAGES, LanguageField, fitted, forward_backward, line_words
from notebrook.llm.syntax import with_language
from notebrook.session import dealt, written

LEAST_WORDS, LEAST_CHARACTERS = 4, 8
#: Share of a span's words that the language's lexicon must hold.
KNOWN = 0.5

# What comments and literals look like in each language.
_PYTHON = re.compile(
    r"""(?P<magic>^[ \t]*[%!?][^\n]*)|(?P<comment>\#[^\n]*)"""
    r"""|[rRbBuUfFtT]{0,2}(?P<text>(?P<q>'{3}|"{3})(?:[^\\]|\\.)*?(?:(?P=q)|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""",
    re.S | re.M,
)
_R = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<name>`[^`\n]*`)|(?P<text>[rR](?P<q>["'])(?P<d>-*)(?:\(.*?\)|\[.*?\]|\{.*?\})(?P=d)(?P=q)|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""",
    re.S,
)
_JULIA = re.compile(
    r"""(?P<block>\#=)|(?P<comment>\#[^\n]*)|(?P<char>(?<![\w)\]}'.])'(?:\\[^'\n]+|[^\\'\n])')|(?P<text>"{3}(?:[^\\]|\\.)*?(?:"{3}|\Z)|"(?:[^"\\]|\\.)*")""",
    re.S,
)
_RULES = {"python": _PYTHON, "r": _R, "julia": _JULIA}
#: Cell magics below which there is still Python.
_PYTHON_MAGICS = frozenset("%%time %%timeit %%capture %%prun %%memit %%mprun".split())

_JULIA_BLOCK = re.compile(r"#=|=#")
_NOT_WORDS = re.compile(r"[a-z]+://\S+|[^\s一-鿿぀-ヿ가-힯]*[/\\][^\s一-鿿぀-ヿ가-힯]*|[A-Za-z0-9]*_\w*(?<![一-鿿぀-ヿ가-힯])|[A-Za-z]+\d[A-Za-z0-9]*|(?<!\w)--?[A-Za-z][\w-]*|%[\w%]|\{[^{}]*\}|\w+\.\w+\(|<[^<>]*>|`[^`]*`")
_NAME = re.compile(r"[A-Za-z0-9]*_[A-Za-z0-9_]*")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[一-鿿㐀-䶿぀-ヿ]")
_SYMBOLS = re.compile(r"[=()\[\]{}<>;|&$@\\*]")
_PLACEHOLDER = re.compile(r"\{[^{}]*\}")
_MARK = re.compile(r"^(?:#+'?|=+#|#=)?[ \t]*|[ \t]*(?:=#)?$")
_LETTERS = "r'\"-"


def code_spans(code: str, language: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of every comment group and literal."""
    rules = _RULES.get(language)
    if rules is None:
        return
    if language == "python" and code.startswith("%%"):
        first, _, rest = code.partition("\n")
        if first.split()[0] not in _PYTHON_MAGICS:
            return
        code = rest
    at, group, literal, last, alone = 0, [], [], -1, False
    while True:
        m = rules.search(code, at)
        if m is None:
            break
        kind, begin, at = m.lastgroup, m.start(), m.end()
        if m.groupdict().get("text") is not None:
            kind = "text"
        if kind == "block":
            depth = 1
            while depth:
                e = _JULIA_BLOCK.search(code, at)
                if e is None:
                    at = len(code)
                    break
                depth, at = depth + (1 if e.group() == "#=" else -1), e.end()
        if kind in ("comment", "block"):
            line = code.rfind("\n", 0, begin) + 1
            own = not code[line:begin].strip()
            # a comment on a line of its own goes on with the comment before it
            if group and not (own and not code[last:begin].strip() and code.count("\n", last, begin) == 1):
                yield "comment", "\n".join(group)
                group = []
            group.append(code[begin:at])
            last = at
        elif kind == "text":
            if literal and code[literal_end:begin].strip(" \t\r\n\\") == "" and not (code.count("\n", literal_end, begin) and bare):
                literal.append(_inside(code[m.start("text") : at]))
            else:
                if literal:
                    yield "literal", "".join(literal)
                literal = [_inside(code[m.start("text") : at])]
                line = code.rfind("\n", 0, begin) + 1
                bare = not code[line:begin].strip()
            literal_end = at
    if group:
        yield "comment", "\n".join(group)
    if literal:
        yield "literal", "".join(literal)


def _inside(literal: str) -> str:
    """What stands between the quotes; line ends and tabs written as escapes are white space."""
    body = literal[3:-3] if literal[:3] in ('"""', "'''") else literal.strip(_LETTERS) if literal[:1] in "rR" else literal[1:-1]
    return body.replace("\\n", " \n").replace("\\t", " ").replace('\\"', '"').replace("\\'", "'") if "\\" in body else body


def prose_lines(text: str, kind: str) -> list[str]:
    """The lines of a span that are not code, without comment marks."""
    out = []
    for line in text.split("\n"):
        if kind == "comment":
            line = _MARK.sub("", line)
        if not line.strip():
            continue
        symbols = len(_SYMBOLS.findall(_PLACEHOLDER.sub(" ", line) if "{" in line else line))
        if symbols >= 2 and 3 * symbols >= len(line.split()) and not _CJK.search(line):
            continue
        if "=" in line and symbols >= 2 and re.match(r"\s*[\w.\[\]'\"]+\s*(?:=|<-)", line):
            continue
        out.append(line)
    return out


def plain_words(lines: list[str]) -> tuple[str, int, int, int]:
    """(text without names, paths and the like; words; Chinese and Japanese characters; tokens that are no words)."""
    text = "\n".join(lines)
    bare, others = _NOT_WORDS.subn(" ", _NAME.sub(" `` ", text))
    return bare, len(_TOKEN.findall(bare)), len(_CJK.findall(bare)), others


def candidate(text: str, kind: str) -> tuple[str, int] | None:
    """The part of a span that may be running text, and its bytes; None if it is too little or mostly something else."""
    if len(text) < LEAST_CHARACTERS:
        return None
    if kind == "literal" and text.isascii() and text.count(" ") + text.count("\n") < LEAST_WORDS - 1:
        return None
    lines = prose_lines(text, kind)
    if not lines:
        return None
    bare, words, characters, others = plain_words(lines)
    if characters < LEAST_CHARACTERS and (words < LEAST_WORDS or others > words):
        return None
    return bare, len("\n".join(lines).encode("utf-8", "replace"))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        number, pk, language, code = (c.to_pylist() for c in b.columns)
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for n, p, lang, text in zip(number, pk, language, code):
            if not text or ("#" not in text and '"' not in text and "'" not in text):
                continue
            for k, (kind, span) in enumerate(code_spans(text, lang)):
                found = candidate(span, kind)
                if found:
                    for column, value in zip(out, (n, p, k, *found)):
                        column.append(value)
        types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["notebook_number", "cell_pk", "k", "span", "n_bytes"])


def spans(cells: DataFrame, notebooks: DataFrame) -> DataFrame:
    """notebook_number, cell_pk, k (number in the cell), span, n_bytes, hash: comments and literals that may hold running text."""
    code = dealt(cells, "_id", "notebook_id", "type", "content").where("type = 'code' and content is not null").withColumn("code", F.array_join("content", "\n"))
    joined = with_language(code, notebooks, "code").select("notebook_number", "cell_pk", "language", "code")
    return joined.mapInArrow(_spans, "notebook_number bigint, cell_pk string, k int, span string, n_bytes bigint").withColumn("hash", F.md5("span"))


def span_languages(field: LanguageField, texts: list[str]) -> list[list[tuple[str, float]]]:
    """The languages of each text in which it has running text (mostly none or one), each with its share of the text's letters. A language
    with less than a quarter of the words needs LEAST_WORDS of them next to each other."""
    parsed = [[w for line in t.split("\n") for w in line_words(line)[0]] for t in texts]
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    field.forget()
    coded = [field.word_ids(x) for x in parsed]
    order = sorted((i for i in range(len(texts)) if coded[i]), key=lambda i: len(coded[i]))
    at = 0
    while at < len(order):
        # texts of about the same length are padded together, long ones in small parts
        size = max(1, min(512, 512 * 200 // max(len(coded[order[min(at + 511, len(order) - 1)]]), 1)))
        part = order[at : at + size]
        at += size
        ids = np.full((len(part), len(coded[part[-1]])), -1)
        for j, i in enumerate(part):
            ids[j, : len(coded[i])] = coded[i]
        gamma, _ = forward_backward(field.emissions(np.maximum(ids, 0)), ids >= 0, field.transitions)
        best = gamma.argmax(2)
        for j, i in enumerate(part):
            out[i] = _running_languages(field.lexicon, parsed[i], best[j, : len(coded[i])])
    return out


def _running_languages(lexicon: dict[str, int], words: list[str], labels: np.ndarray) -> list[tuple[str, float]]:
    out, letters = [], sum(map(len, words))
    for x in sorted(set(labels.tolist())):
        places = np.flatnonzero(labels == x)
        mine, name = [words[p] for p in places], LANGUAGES[x]
        if name in ("zh", "ja"):
            enough = sum(len(w) for w in mine if _CJK.match(w)) >= LEAST_CHARACTERS
        else:
            together = len(mine) >= LEAST_WORDS and bool((places[LEAST_WORDS - 1 :] - places[: 1 - LEAST_WORDS] == LEAST_WORDS - 1).any())
            enough = together or (len(mine) >= LEAST_WORDS and 4 * len(mine) >= len(words))
        if enough and sum(lexicon.get(w, 0) >> x & 1 for w in mine) >= KNOWN * len(mine):
            out.append((name, sum(map(len, mine)) / letters))
    return out


def _classified(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows = [(h, *x) for h, found in zip(hashes, span_languages(shared.value, texts)) for x in found]
        types = (("hash", pa.string()), ("lang", pa.string()), ("part", pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(types)], names=[n for n, _ in types])


def labelled_spans(cells: DataFrame, notebooks: DataFrame, field: LanguageField) -> DataFrame:
    """notebook_number, cell_pk, k, hash, n_bytes, lang of the spans with running text; the bytes of a span in several languages are shared
    among them by letters."""
    found = written(spans(cells, notebooks), "spans")  # read twice below: the code is gone through once
    # equal hashes are equal texts, so this keeps one row per hash and combines before the shuffle
    distinct = found.select("hash", "span").distinct()
    labels = distinct.mapInArrow(partial(_classified, cells.sparkSession.sparkContext.broadcast(field)), "hash string, lang string, part double")
    joined = found.select("notebook_number", "cell_pk", "k", "hash", "n_bytes").join(labels, "hash")
    return joined.withColumn("n_bytes", F.floor(F.col("n_bytes") * F.col("part"))).drop("part")


def prose_in_cells(cells: DataFrame, notebooks: DataFrame) -> DataFrame:
    return labelled_spans(cells, notebooks, fitted(cells)).select("cell_pk", "lang").distinct()


def prose_shares(cells: DataFrame, notebooks: DataFrame) -> DataFrame:
    """notebook_id, lang, spans, distinct_spans, text_bytes, code_bytes, share of the notebook's code, and stripped_bytes, the bytes of
    content_no_comment where it is there. Code that is delivered twice is equal, so sizes and spans are deduplicated, not the code."""
    labelled = labelled_spans(cells, notebooks, fitted(cells)).dropDuplicates(["cell_pk", "k", "lang"])
    text = labelled.groupBy("notebook_number", "lang", "hash").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    text = text.groupBy("notebook_number", "lang").agg(F.sum("n").alias("spans"), F.count("*").alias("distinct_spans"), F.sum("b").alias("text_bytes"))
    bytes_of = lambda c: F.octet_length(F.array_join(c, "\n"))
    sizes = cells.where("type = 'code'").select("_id", "notebook_id", bytes_of("content").alias("b"), bytes_of("content_no_comment").alias("s"))
    sizes = sizes.groupBy("_id", "notebook_id").agg(F.max("b").alias("b"), F.max("s").alias("s"))
    size = with_language(sizes, notebooks, "b", "s").groupBy("notebook_number").agg(F.sum("b").alias("code_bytes"), F.sum("s").alias("stripped_bytes"))
    return text.join(size, "notebook_number").select(
        F.col("notebook_number").alias("notebook_id"), "lang", "spans", "distinct_spans", "text_bytes", "code_bytes",
        F.round(F.col("text_bytes") / F.col("code_bytes"), 6).alias("share"), "stripped_bytes",
    )
