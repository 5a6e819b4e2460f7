"""Helpers over the syntax tree of one Python cell, each small and pure; cells that do not parse give nothing."""

from __future__ import annotations

import ast
import builtins
import io
import tokenize
import warnings
from collections.abc import Callable, Iterator
from typing import Any

BUILTINS = frozenset(dir(builtins))
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def runnable_text(code: str) -> str:
    """Code without magics and shell lines, which are blanked so that line numbers stay."""
    return "\n".join("" if line.lstrip().startswith(("%", "!", "?")) else line for line in code.split("\n"))


def parsed(code: str | None) -> ast.Module | None:
    if not code or not code.strip():
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(runnable_text(code))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def statements(code: str | None) -> list[tuple[int, int, int, str]]:
    """(index, first line, last line, kind) of the top-level statements; lines from 1."""
    tree = parsed(code)
    return [(i, s.lineno, s.end_lineno or s.lineno, type(s).__name__) for i, s in enumerate(tree.body)] if tree else []


def strip_comments(code: str | None) -> str | None:
    """Code without comments, docstrings and blank lines; None where the tokenizer fails."""
    if code is None:
        return None
    out, before, at = [], tokenize.INDENT, (1, 0)
    try:
        for token in tokenize.generate_tokens(io.StringIO(code).readline):
            if token.start[0] > at[0]:
                at = (token.start[0], 0)
            gap = " " * (token.start[1] - at[1])
            lone_string = token.type == tokenize.STRING and before in (tokenize.INDENT, tokenize.NEWLINE, tokenize.NL, tokenize.DEDENT)
            if token.type != tokenize.COMMENT and not (lone_string and token.line.strip().startswith(token.string[:3])):
                out.append(gap + token.string)
            before, at = token.type, token.end
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return None
    return "\n".join(line.rstrip() for line in "".join(out).split("\n") if line.strip())


def _identifiers(nodes: list[ast.AST]) -> Iterator[tuple[int, int, str]]:
    """(line, column, name) of everything that reads as an identifier, attributes and keywords included."""
    for node in nodes:
        if isinstance(node, ast.Name):
            yield node.lineno, node.col_offset, node.id
        elif isinstance(node, ast.Attribute):
            yield node.end_lineno, node.end_col_offset - len(node.attr.encode()), node.attr
        elif isinstance(node, ast.keyword) and node.arg:
            yield node.lineno, node.col_offset, node.arg
        elif isinstance(node, ast.arg):
            yield node.lineno, node.col_offset, node.arg


def events(code: str | None) -> list[tuple[int, int, str, str, str | None]]:
    """(sequence, line, kind, name, other) in textual order. Kinds: def (other: function, class or variable), ref, and arg (an
    identifier handed to a call by plain name, other: the function). A name is bound before the right side of its
    assignment is read."""
    tree = parsed(code)
    if tree is None:
        return []
    found: list[tuple[int, int, int, str, str, str | None]] = []
    bound = set()
    nodes = list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, _DEFINITIONS):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            found.append((node.lineno, node.col_offset + 1, 0, "def", node.name, kind))
        elif isinstance(node, ast.Call):
            _call_events(node, found)
    for statement in tree.body:
        if isinstance(statement, ast.Assign) or isinstance(statement, ast.AnnAssign) and statement.value is not None:
            target = statement.targets[0] if isinstance(statement, ast.Assign) else statement.target
            for name in target.elts if isinstance(target, ast.Tuple) else [target]:
                if isinstance(name, ast.Name):
                    bound.add((name.lineno, name.col_offset))
                    found.append((name.lineno, name.col_offset, 0, "def", name.id, "variable"))
    found += [(line, column, 1, "ref", name, None) for line, column, name in _identifiers(nodes) if (line, column) not in bound]
    found.sort(key=lambda e: e[:3])
    return [(i, e[0], *e[3:]) for i, e in enumerate(found)]


def _call_events(call: ast.Call, found: list) -> None:
    for k in call.keywords:
        if k.arg == "inplace" and isinstance(k.value, ast.Constant) and k.value.value is True:
            if isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name):
                found.append((k.lineno, k.col_offset, 0, "def", call.func.value.id, "variable"))
    if isinstance(call.func, ast.Name):
        handed = [*call.args, *(k.value for k in call.keywords)]
        for value in handed:
            for name in (value, *ast.iter_child_nodes(value)):
                if isinstance(name, ast.Name):
                    found.append((name.lineno, name.col_offset, 2, "arg", name.id, call.func.id))


class _Uses(ast.NodeVisitor):
    """Loads and stores in the order of evaluation: right sides before left ones, function bodies and lambdas left out."""

    def __init__(self):
        self.names: list[tuple[str, str]] = []
        self.calls: list[str] = []
        self.defined: list[str] = []

    def visit_Name(self, node):
        self.names.append((node.id, "load" if isinstance(node.ctx, ast.Load) else "store"))

    def visit_Assign(self, node):
        self.visit(node.value)
        for t in node.targets:
            self.visit(t)

    def visit_AnnAssign(self, node):
        if node.value is not None:
            self.visit(node.value)
            self.visit(node.target)

    def visit_AugAssign(self, node):
        for sub in ast.walk(node.target):
            if isinstance(sub, ast.Name):
                self.names.append((sub.id, "load"))
        self.visit(node.value)
        self.visit(node.target)

    def visit_For(self, node):
        self.visit(node.iter)
        self.visit(node.target)
        for s in (*node.body, *node.orelse):
            self.visit(s)

    def _comprehension(self, node):
        for g in node.generators:
            self.visit(g.iter)
            self.visit(g.target)
            for c in g.ifs:
                self.visit(c)
        for part in ("elt", "key", "value"):
            if hasattr(node, part):
                self.visit(getattr(node, part))

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension

    def visit_FunctionDef(self, node):
        self.defined.append(node.name)
        for d in (*node.decorator_list, *node.args.defaults):
            self.visit(d)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node):
        pass

    def visit_ClassDef(self, node):
        self.defined.append(node.name)

    def visit_Import(self, node):
        self.defined += [a.asname or a.name.split(".")[0] for a in node.names]

    visit_ImportFrom = visit_Import

    def visit_Call(self, node):
        if isinstance(node.func, ast.Name):
            self.calls.append(node.func.id)
        else:
            self.visit(node.func)
        for a in (*node.args, *(k.value for k in node.keywords)):
            self.visit(a)


def produced_consumed(code: str | None) -> tuple[list[str], list[str]]:
    """Names a cell makes and names it needs, as ``name:var`` and ``name:fun``. A store of a name that the cell loaded before
    makes nothing; ``x += 1`` loads first."""
    tree = parsed(code)
    if tree is None:
        return [], []
    uses = _Uses()
    uses.visit(tree)
    made = {f"{n}:{space}" for n in uses.defined if n not in BUILTINS for space in ("var", "fun")}
    needed: set[str] = set()
    for name, how in uses.names:
        key = f"{name}:var"
        if name in BUILTINS:
            continue
        if how == "load":
            needed.add(key)
        elif key not in needed:
            made.add(key)
    needed |= {f"{n}:fun" for n in uses.calls if n not in BUILTINS}
    # a function that is only called where its name holds a plain value is the value's
    return sorted(made), sorted(needed)


def imports(code: str | None) -> list[tuple[str, str]]:
    """(name in the cell, full name) of every import."""
    tree = parsed(code)
    out = []
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Import):
            out += [(a.asname or a.name, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(a.asname or a.name, f"{node.module or ''}.{a.name}".lstrip(".")) for a in node.names]
    return out


def calls(code: str | None) -> list[str]:
    """Dotted names of the functions a cell calls."""
    tree = parsed(code)
    out = []
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Call):
            parts, f = [], node.func
            while isinstance(f, ast.Attribute):
                parts.append(f.attr)
                f = f.value
            if isinstance(f, ast.Name):
                out.append(".".join([f.id, *parts[::-1]]))
    return out


def functions(code: str | None) -> list[tuple[str, list[str], int, int]]:
    """(name, parameters, first line, last line) of module-level functions; decorated ones are left out."""
    tree = parsed(code)
    return [
        (s.name, [a.arg for a in (*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs)], s.lineno, s.end_lineno or s.lineno)
        for s in (tree.body if tree else ())
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) and not s.decorator_list
    ]


def tree_nodes(code: str | None, depth: int = 4) -> list[tuple[int, int, int, int, str]]:
    """(node, parent, depth, ordinal, kind) of the statement tree down to a depth, the root being -1."""
    tree = parsed(code)
    out: list[tuple[int, int, int, int, str]] = []

    def walk(body, parent, level):
        for ordinal, s in enumerate(body):
            me = len(out)
            out.append((me, parent, level, ordinal, type(s).__name__))
            if level < depth:
                walk([x for field in ("body", "orelse", "finalbody") for x in getattr(s, field, [])], me, level + 1)

    walk(tree.body if tree else [], -1, 1)
    return out


def dataflow(code: str | None) -> list[tuple[str, int, str, str, int]]:
    """(name, line, relation, source name, source line): computedFrom between the sides of an assignment, comesFrom between
    a use and the definitions that reach it. Branches are merged, loop bodies are gone through twice."""
    return flow_between(parsed(code), lambda node: node.lineno)


def flow_between(tree: ast.Module | None, place: Callable[[ast.AST], Any]) -> list[tuple]:
    """The rows of ``dataflow`` with the places of the names as ``place`` gives them."""
    edges: dict[tuple, None] = {}

    def loads(node) -> list[ast.Name]:
        return [n for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]

    def use(node, state):
        todo = [node]
        while todo:
            n = todo.pop()
            if isinstance(n, ast.Name):
                if isinstance(n.ctx, ast.Load):
                    for line in sorted(state.get(n.id, ())):
                        edges[n.id, place(n), "comesFrom", n.id, line] = None
            elif isinstance(n, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
                inner = dict(state)
                for g in n.generators:
                    use(g.iter, inner)
                    bind(g.target, loads(g.iter), inner)
                    for test in g.ifs:
                        use(test, inner)
                for part in (n.key, n.value) if isinstance(n, ast.DictComp) else (n.elt,):
                    use(part, inner)
            elif isinstance(n, ast.Lambda):
                use(n.body, parameters(n.args, state))
            elif isinstance(n, ast.NamedExpr):
                use(n.value, state)
                bind(n.target, loads(n.value), state)
            else:
                todo.extend(reversed(list(ast.iter_child_nodes(n))))

    def bind(target, sources, state):
        for t in ast.walk(target):
            if isinstance(t, ast.Name) and isinstance(t.ctx, ast.Store):
                for s in sources:
                    edges[t.id, place(t), "computedFrom", s.id, place(s)] = None
                state[t.id] = {place(t)}

    def parameters(args, state):
        """The state inside a function; a parameter comes from the names of its default."""
        inner = dict(state)
        positional = [*args.posonlyargs, *args.args]
        defaults = [*zip(positional[len(positional) - len(args.defaults) :], args.defaults), *zip(args.kwonlyargs, args.kw_defaults)]
        for p in (*positional, *args.kwonlyargs, args.vararg, args.kwarg):
            if p is not None:
                inner[p.arg] = {place(p)}
        for p, default in defaults:
            if default is not None:
                use(default, state)
                for s in loads(default):
                    edges[p.arg, place(p), "comesFrom", s.id, place(s)] = None
        return inner

    def define(s, state):
        """Bodies see a copy: what they bind stays inside."""
        for x in s.decorator_list:
            use(x, state)
        if isinstance(s, ast.ClassDef):
            for x in (*s.bases, *(k.value for k in s.keywords)):
                use(x, state)
            run(s.body, dict(state))
            state[s.name] = {place(s)}
        else:
            for x in (*(p.annotation for p in (*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs, s.args.vararg, s.args.kwarg) if p), s.returns):
                if x is not None:
                    use(x, state)
            inner = parameters(s.args, state)
            state[s.name] = {place(s)}
            run(s.body, {s.name: {place(s)}} | inner)

    def merge(a, b):
        return {k: a.get(k, set()) | b.get(k, set()) for k in a.keys() | b.keys()}

    def run(body, state):
        for s in body:
            if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                if s.value is not None:
                    use(s.value, state)
                    sources = loads(s.value)
                    for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                        bind(t, sources, state)
            elif isinstance(s, ast.If):
                use(s.test, state)
                state = merge(run(s.body, dict(state)), run(s.orelse, dict(state)))
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                for _ in range(2):
                    if isinstance(s, ast.While):
                        use(s.test, state)
                    else:
                        use(s.iter, state)
                        bind(s.target, loads(s.iter), state)
                    state = merge(state, run(s.body, dict(state)))
                state = run(s.orelse, state)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for item in s.items:
                    use(item.context_expr, state)
                    if item.optional_vars is not None:
                        bind(item.optional_vars, loads(item.context_expr), state)
                state = run(s.body, state)
            elif isinstance(s, (ast.Try, ast.TryStar)):
                done = run(s.body, dict(state))
                failed = merge(state, done)
                state = run(s.orelse, done)
                for h in s.handlers:
                    caught = dict(failed)
                    if h.type is not None:
                        use(h.type, caught)
                    if h.name:
                        caught[h.name] = {place(h)}
                    state = merge(state, run(h.body, caught))
                state = run(s.finalbody, state)
            elif isinstance(s, ast.Match):
                use(s.subject, state)
                after = dict(state)
                for case in s.cases:
                    inner = dict(state)
                    for p in ast.walk(case.pattern):
                        name = getattr(p, "rest" if isinstance(p, ast.MatchMapping) else "name", None)
                        if name:
                            for x in loads(s.subject):
                                edges[name, place(p), "computedFrom", x.id, place(x)] = None
                            inner[name] = {place(p)}
                    use(case.pattern, inner)
                    if case.guard is not None:
                        use(case.guard, inner)
                    after = merge(after, run(case.body, inner))
                state = after
            elif isinstance(s, _DEFINITIONS):
                define(s, state)
            else:
                use(s, state)
        return state

    run(tree.body if tree else [], {})
    return list(edges)
