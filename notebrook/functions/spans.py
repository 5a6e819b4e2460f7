"""Tokens of one Python cell: spans, the flattened syntax tree, model features, and what its statements are split into.

Lines and columns of spans count from 0, columns in characters. Cells that the tokenizer or the parser rejects give nothing."""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import tokenize
import zlib
from collections.abc import Callable
from typing import NamedTuple

from notebrook.functions import code as C

_LAYOUT = (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING)


class Leaf(NamedTuple):
    line: int
    column: int
    end_line: int
    end_column: int
    kind: str
    text: str


def leaves(code: str | None, comments: bool = True) -> list[Leaf]:
    """The tokens in order, strings (formatted ones too) and comments in one piece. Kinds: name, keyword, number, string, comment, mark."""
    if not code:
        return []
    code = C.runnable_text(code)
    lines, out, open_, begun = code.split("\n"), [], 0, (0, 0)
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type == tokenize.FSTRING_START:
                open_, begun = open_ + 1, begun if open_ else t.start
            elif t.type == tokenize.FSTRING_END:
                open_ -= 1
                if not open_:
                    out.append(Leaf(begun[0] - 1, begun[1], t.end[0] - 1, t.end[1], "string", text_between(lines, begun[0] - 1, begun[1], t.end[0] - 1, t.end[1])))
            elif open_ or t.type in _LAYOUT or (t.type == tokenize.COMMENT and not comments):
                continue
            else:
                out.append(Leaf(t.start[0] - 1, t.start[1], t.end[0] - 1, t.end[1], _kind(t), t.string))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return []
    return out


def _kind(token: tokenize.TokenInfo) -> str:
    if token.type == tokenize.NAME:
        return "keyword" if keyword.iskeyword(token.string) else "name"
    return {tokenize.NUMBER: "number", tokenize.STRING: "string", tokenize.COMMENT: "comment"}.get(token.type, "mark")


def text_between(lines: list[str], line: int, column: int, end_line: int, end_column: int, joint: str = "\n") -> str:
    if line == end_line:
        return lines[line][column:end_column]
    return joint.join([lines[line][column:], *lines[line + 1 : end_line], lines[end_line][:end_column]])


def variables(code: str | None) -> list[Leaf]:
    """The leaves that are not fixed by the grammar: names, numbers, strings and comments."""
    return [x for x in leaves(code) if x.kind not in ("keyword", "mark")]


def travelled(code: str | None, pieces: Callable[[str], list[str]] = lambda text: [text]) -> list[str]:
    """The syntax tree as a sequence: each inner node between AST#kind#Left and AST#kind#Right, but for nodes with a single child; leaves as
    the pieces that a tokenizer cuts them into. Comments and docstrings are taken out before."""
    bare = C.strip_comments(code)
    tree = C.parsed(bare if bare is not None else code)
    if tree is None:
        return []
    out: list[str] = []
    todo: list[ast.AST | str] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        parts = _parts(node)
        if not any(isinstance(p, ast.AST) for p in parts):
            out.extend(x for p in parts for x in pieces(p))
            continue
        kind = type(node).__name__
        if len(parts) != 1:
            out.append(f"AST#{kind}#Left")
            todo.append(f"AST#{kind}#Right")
        for p in reversed(parts):
            todo.extend([p] if isinstance(p, ast.AST) else reversed(pieces(p)))
    return out


def _parts(node: ast.AST) -> list[ast.AST | str]:
    """Children and own words of a node."""
    if isinstance(node, ast.Constant):
        return [repr(node.value)]
    out: list[ast.AST | str] = []
    for _, value in ast.iter_fields(node):
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, (ast.AST, str)) and not isinstance(x, ast.expr_context):
                out.append(x)
    return out or [type(node).__name__]


def connected_flow(code: str | None) -> tuple[list[str], list[tuple[str, int, str, list[int]]]]:
    """(tokens, data flow): the tokens without comments and docstrings, and (name, index of its token, relation, indices of the tokens it has its
    value from) in the order of the tokens; names without a connection are left out."""
    bare = C.strip_comments(code)
    text = bare if bare is not None else code
    found, tree = leaves(text, comments=False), C.parsed(text)
    if tree is None:
        return [x.text for x in found], []
    lines = C.runnable_text(text).split("\n")
    at = {(x.line, len(lines[x.line][: x.column].encode())): i for i, x in enumerate(found)}
    place = lambda node: (node.lineno - 1, node.col_offset)
    flow: dict[tuple[str, int, str], set[int]] = {}
    for name, here, relation, _, there in C.flow_between(tree, place):
        if here in at and there in at:
            flow.setdefault((name, at[here], relation), set()).add(at[there])
    return [x.text for x in found], [(*k, sorted(v)) for k, v in sorted(flow.items(), key=lambda x: (x[0][1], x[0][2]))]


#: Special ids: begin, padding, end, unknown; words come after them.
BEGIN, PADDING, END, UNKNOWN, FIRST_WORD = 0, 1, 2, 3, 5


def hashed_id(word: str, words: int = 1000) -> int:
    """An id for a word without a vocabulary."""
    return FIRST_WORD + zlib.crc32(word.encode("utf-8", "replace")) % (words - FIRST_WORD)


class Features(NamedTuple):
    ids: list[int]
    positions: list[int]
    flow_to_code: list[tuple[int, int]]
    flow_to_flow: list[list[int]]


def features(code: str | None, most_code: int = 256, most_flow: int = 64, pieces: Callable[[str], list[str]] = lambda text: [text]) -> Features:
    """A graph-guided model's input of fixed length: token ids, then a node for each data-flow name, then padding. Positions are 0 for nodes and go on
    from the padding id for tokens; each node knows its pieces [from, to) and the nodes it has its value from."""
    tokens, flow = connected_flow(code)
    cut = [pieces(t) for t in tokens]
    ends = [0]
    for c in cut:
        ends.append(ends[-1] + len(c))
    size = most_code + most_flow
    words = [w for c in cut for w in c][: size - 2 - min(len(flow), most_flow)]
    ids = [BEGIN, *map(hashed_id, words), END]
    positions = [i + PADDING + 1 for i in range(len(ids))]
    flow = flow[: size - len(ids)]
    node_of = {f[1]: k for k, f in enumerate(flow)}
    padding = size - len(ids) - len(flow)
    return Features(
        ids + [UNKNOWN] * len(flow) + [PADDING] * padding,
        positions + [0] * len(flow) + [PADDING] * padding,
        [(ends[f[1]] + 1, ends[f[1] + 1] + 1) for f in flow],
        [[node_of[i] for i in f[3] if i in node_of] for f in flow],
    )


def attention(x: Features) -> list[tuple[int, int, int, int]]:
    """The graph-guided attention as rectangles (row from, to, column from, to) in place of a dense matrix: tokens see tokens, begin and end see
    all, a node and its tokens see each other, a node sees the nodes it has its value from."""
    nodes = sum(p > 1 for p in x.positions)
    used = sum(p != 1 for p in x.positions)
    out = [(0, nodes, 0, nodes)]
    out += [(i, i + 1, 0, used) for i, v in enumerate(x.ids) if v in (BEGIN, END)]
    for k, (a, b) in enumerate(x.flow_to_code):
        if a < nodes and b < nodes:
            out += [(nodes + k, nodes + k + 1, a, b), (a, b, nodes + k, nodes + k + 1)]
    out += [(nodes + k, nodes + k + 1, nodes + a, nodes + a + 1) for k, sources in enumerate(x.flow_to_flow) for a in sources if nodes + a < len(x.positions)]
    return out


def split_up(code: str | None) -> list[tuple[str, str | None, str, int]]:
    """(part, name, code, children): the global imports, the global functions, and the rest of the cell, each with its top-level statements."""
    tree = C.parsed(code)
    if tree is None:
        return []
    lines = C.runnable_text(code).split("\n")
    text = lambda s: "\n".join(lines[min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", []))]) - 1 : s.end_lineno])
    out: list[tuple[str, str | None, str, int]] = []
    rest = []
    for s in tree.body:
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            out.append(("import", None, ast.unparse(s), 1))
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", s.name, text(s), 1))
        else:
            rest.append(s)
    out.append(("rest", None, "\n".join(text(s) for s in rest), len(rest)))
    return out


def identifiers(code: str | None) -> list[str]:
    """The valid names of a cell that are neither keywords nor built in, each once, in the order of their first use."""
    names = (x.text for x in leaves(code, comments=False) if x.kind == "name")
    return list(dict.fromkeys(n for n in names if n.isidentifier() and not hasattr(builtins, n)))


def renamed(code: str, old: str, new: str) -> str:
    """Every occurrence of a name as a token replaced; names inside strings and comments stay."""
    lines = code.split("\n")
    for x in sorted((x for x in leaves(code) if x.kind == "name" and x.text == old), reverse=True):
        lines[x.line] = lines[x.line][: x.column] + new + lines[x.line][x.end_column :]
    return "\n".join(lines)
