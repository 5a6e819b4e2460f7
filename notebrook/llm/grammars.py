"""Syntax recognisers for the three notebook languages: Python through the interpreter's own parser, R and Julia
through small operator-precedence recognisers. Each ``*_error`` returns None for valid code, else a short reason."""

from __future__ import annotations

import ast
import re
import sys
import warnings

class Bad(Exception):
    """Not in the language."""


# ---------------------------------------------------------------- Python

_SHELL = ("%", "!", "?")


def python_source(code: str) -> str | None:
    """The part of a cell that is Python: None for a cell magic, else without line magics, shell and help lines."""
    if code.startswith("%%"):
        return None
    if "%" not in code and "!" not in code and "?" not in code:
        return code
    kept = []
    for line in code.split("\n"):
        bare = line.strip()
        if not (bare.startswith(_SHELL) or bare.endswith("?")):
            kept.append(line)
    return "\n".join(kept)


def python_error(code: str) -> str | None:
    source = python_source(code)
    if source is None or not source.strip():
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(source, "<cell>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        return getattr(e, "msg", None) or str(e) or "invalid"
    except (MemoryError, RecursionError):
        return "nested too deeply"
    return None


# ---------------------------------------------------------------- R

_R_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f\r ]+|\#[^\n]*)|(?P<nl>\n)"""
    r"""|(?P<raw>[rR](?P<q>["'])(?P<dash>-*)(?:\((?:.*?)\)(?P=dash)(?P=q)|\[(?:.*?)\](?P=dash)(?P=q)|\{(?:.*?)\}(?P=dash)(?P=q)))"""
    r"""|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
    r"""|(?P<num>(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[Li]?)"""
    r"""|(?P<sym>(?:[^\W\d_]|\.(?!\d))[\w.]*|`[^`\n]+`|_)"""
    r"""|(?P<op>%[^%\n]*%|<<-|->>|:::|<-|->|<=|>=|==|!=|&&|\|\||\|>|::|:=|\*\*|\[\[|[-+*/^<>=!&|~?:$@(){}\[\],;\\])""",
    re.S,
)
_R_ESCAPE = re.compile(r"\\(?!(?:[ntrabfv0-7\\\"'` \n]|x[0-9a-fA-F]|u(?:[0-9a-fA-F]|\{[0-9a-fA-F]+\})|U(?:[0-9a-fA-F]|\{[0-9a-fA-F]+\})))")
_R_WORDS = frozenset("if else repeat while function for next break in".split())
_R_VALUES = frozenset("TRUE FALSE NULL NA Inf NaN NA_integer_ NA_real_ NA_character_ NA_complex_".split())
_R_BINARY = {"?": 1, "=": 2, "<-": 4, "<<-": 4, ":=": 4, "->": 5, "->>": 5, "~": 6, "||": 7, "|": 7, "&&": 8, "&": 8,
             "==": 10, "!=": 10, "<": 10, ">": 10, "<=": 10, ">=": 10, "+": 11, "-": 11, "*": 12, "/": 12, "|>": 13, ":": 14, "^": 16, "**": 16}
_R_CLOSE = {"(": ")", "[": "]", "[[": "]]", "{": "}"}


def _r_tokens(code: str) -> list[tuple[str, str]]:
    out, open_, at, end = [], [], 0, len(code)
    match = _R_TOKEN.match
    while at < end:
        m = match(code, at)
        if not m:
            raise Bad(f"unexpected character {code[at]!r}")
        kind, text, at = m.lastgroup, m.group(), m.end()
        if kind == "ws" or (kind == "nl" and open_ and open_[-1] != "{"):
            continue
        if kind == "str" and "\\" in text and _R_ESCAPE.search(text[1:-1].replace("\\\\", "")):
            raise Bad("unrecognised escape in string")
        if m.group("raw"):
            kind = "str"
        elif kind == "sym" and text in _R_WORDS:
            kind = "kw"
        elif kind == "op":
            if text in _R_CLOSE:
                open_.append(text)
            elif text == "]" and open_ and open_[-1] == "[[" and code.startswith("]", at):
                text, at = "]]", at + 1
                open_.pop()
            elif text in ")]}":
                if not open_ or _R_CLOSE[open_.pop()] != text:
                    raise Bad(f"unexpected {text!r}")
        out.append((kind, text))
    if open_:
        raise Bad(f"{open_[-1]!r} is not closed")
    out.append(("end", ""))
    return out


class _R:
    def __init__(self, code: str):
        self.t, self.i, self.braces = _r_tokens(code), 0, 0

    def op(self, text: str) -> bool:
        if self.t[self.i] == ("op", text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail()

    def fail(self):
        raise Bad(f"unexpected {self.t[self.i][1] or 'end of input'!r}")

    def lines(self) -> None:
        while self.t[self.i][0] == "nl":
            self.i += 1

    def program(self, close: str = "") -> None:
        while True:
            while self.t[self.i][0] == "nl" or self.t[self.i] == ("op", ";"):
                self.i += 1
            if self.t[self.i][0] == "end" or (close and self.t[self.i] == ("op", close)):
                return
            self.expr(0, True)
            kind, text = self.t[self.i]
            if not (kind in ("nl", "end") or (kind == "op" and text in (";", close or ";"))):
                self.fail()

    def expr(self, least: int, eq: bool = False) -> None:
        self.lines()
        self.operand(eq)
        compared = False
        while True:
            kind, text = self.t[self.i]
            if kind != "op":
                return
            if text in ("(", "[", "[["):
                self.i += 1
                self.arguments(_R_CLOSE[text])
            elif text in ("$", "@"):
                self.i += 1
                self.lines()
                if self.t[self.i] == ("op", "("):
                    self.i += 1
                    self.expr(0, True)
                    self.need(")")
                elif self.t[self.i][0] in ("sym", "str"):
                    self.i += 1
                else:
                    self.fail()
            elif text in ("::", ":::"):
                self.i += 1
                if self.t[self.i][0] not in ("sym", "str"):
                    self.fail()
                self.i += 1
            else:
                power = 13 if text[0] == "%" else _R_BINARY.get(text)
                if power is None or power < least or (text == "=" and not eq):
                    return
                if power == 10:
                    if compared:
                        self.fail()
                    compared = True
                elif power < 10:
                    compared = False
                self.i += 1
                self.expr(power if power in (2, 4, 16) else power + 1, eq and power <= 2)

    def operand(self, eq: bool) -> None:
        kind, text = self.t[self.i]
        self.i += 1
        if kind in ("num", "str", "sym"):
            return
        if kind == "op":
            if text in "-+":
                return self.expr(15)
            if text == "!":
                return self.expr(9)
            if text in "~?":
                return self.expr(6 if text == "~" else 1)
            if text == "(":
                self.expr(0, True)
                return self.need(")")
            if text == "{":
                self.braces += 1
                self.program("}")
                self.need("}")
                self.braces -= 1
                return
            if text == "\\" and self.t[self.i] == ("op", "("):
                return self.function()
        elif kind == "kw":
            if text in ("next", "break"):
                return
            if text == "function":
                return self.function()
            if text == "repeat":
                return self.expr(3, True)
            if text in ("if", "while"):
                self.need("(")
                self.expr(0)
                self.need(")")
                self.expr(3, eq)
                if text == "if":
                    back = self.i
                    if self.braces:
                        self.lines()
                    if self.t[self.i] == ("kw", "else"):
                        self.i += 1
                        self.expr(3, eq)
                    else:
                        self.i = back
                return
            if text == "for":
                self.need("(")
                if self.t[self.i][0] != "sym" or self.t[self.i + 1] != ("kw", "in"):
                    self.fail()
                self.i += 2
                self.expr(0)
                self.need(")")
                return self.expr(3, eq)
        self.i -= 1
        self.fail()

    def function(self) -> None:
        self.need("(")
        while not self.op(")"):
            if self.t[self.i][0] != "sym":
                self.fail()
            self.i += 1
            if self.op("="):
                self.expr(3)
            if not self.op(","):
                self.need(")")
                break
        self.expr(3, True)

    def arguments(self, close: str) -> None:
        while not self.op(close):
            if self.op(","):
                continue
            kind, text = self.t[self.i]
            if kind in ("sym", "str") and self.t[self.i + 1] == ("op", "="):
                self.i += 2
                if self.t[self.i] not in (("op", ","), ("op", close)):
                    self.expr(3)
            else:
                self.expr(1)
            if self.t[self.i] not in (("op", ","), ("op", close)):
                self.fail()


def r_error(code: str) -> str | None:
    return _error(_R, code)


def _error(recogniser, code: str) -> str | None:
    limit = sys.getrecursionlimit()
    try:
        # no rule goes deeper than a few calls for each character; such calls take no C stack
        sys.setrecursionlimit(limit + 16 * len(code))
        recogniser(code).program()
    except Bad as e:
        return str(e)
    finally:
        sys.setrecursionlimit(limit)
    return None


# ---------------------------------------------------------------- Julia

_J_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r ]+|\#(?!=)[^\n]*)|(?P<nl>\n)"""
    r"""|(?P<num>0[xX][0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|(?:\d[\d_]*(?:\.(?![.\w*/+^-])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eEf][+-]?\d+)?)"""
    r"""|(?P<word>[^\W\d](?:\w|!(?!=))*)"""
    r"""|(?P<op>\.\.\.|\.?(?:>>>=|<<=|>>=|>>>|===|!==|-->|÷=|⊻=|\+=|-=|\*=|/=|\\=|\^=|%=|\|=|&=|//|<<|>>|<=|>=|==|!=|=>|->|\|>|<\||<:|>:|&&|\|\||:=|[-+*/\\^%<>=!~&|÷×⋅∘≤≥≠≈∈∉⊆∪∩⊻√→])|::|[:.,;?$@(){}\[\]])""",
)
_J_CHAR = re.compile(r"'(?:\\(?:x[0-9a-fA-F]{1,2}|u[0-9a-fA-F]{1,4}|U[0-9a-fA-F]{1,8}|[0-7]{1,3}|.)|[^\\'\n])'", re.S)
_J_UNARY = frozenset("+ - ! ~ √ & <: >: :: .+ .- .! .~ $ →".split())
_J_NOT_BINARY = frozenset("! √ .! ( ) { } [ ] , ; @ $ . ? .√".split())
_J_STOP = frozenset("end else elseif catch finally".split())
_J_CLOSE = {"(": ")", "[": "]", "{": "}"}
_J_BLOCKS = frozenset("begin quote let if while for function macro try struct mutable abstract primitive module baremodule do".split())


def _j_quoted(code: str, at: int, mark: str, plain: bool) -> int:
    """The end of a string or command that opened before ``at``; looks into $(...) unless it is a string macro."""
    end = len(code)
    while at < end:
        c = code[at]
        if c == "\\":
            at += 2
        elif code.startswith(mark, at):
            return at + len(mark)
        elif c == "$" and not plain and code.startswith("(", at + 1):
            depth, at = 1, at + 2
            while depth and at < end:
                c = code[at]
                if c == '"':
                    at = _j_quoted(code, at + 1, '"', False)
                    continue
                depth += (c == "(") - (c == ")")
                at += 1
            if depth:
                break
        else:
            at += 1
    raise Bad("string is not closed")


def _j_tokens(code: str) -> list[tuple[str, str, bool]]:
    """(kind, text, white space before)."""
    out: list[tuple[str, str, bool]] = []
    at, end, space = 0, len(code), True
    while at < end:
        c = code[at]
        if c == '"' or c == "`":
            macro = bool(out) and out[-1][0] == "word" and not space
            mark = c * 3 if code.startswith(c * 3, at) else c
            at = _j_quoted(code, at + len(mark), mark, macro)
            if macro:
                out.pop()
                while at < end and code[at].isalpha():
                    at += 1
            out.append(("str", c, space))
            space = False
            continue
        if c == "'":
            if out and not space and (out[-1][0] in ("num", "word", "str") or out[-1][1] in (")", "]", "}", "'")):
                out.append(("post", "'", False))
                at += 1
                continue
            m = _J_CHAR.match(code, at)
            if not m:
                raise Bad("invalid character literal")
            out.append(("str", "'", space))
            at, space = m.end(), False
            continue
        if code.startswith("#=", at):
            depth, at = 1, at + 2
            while depth:
                m = re.compile(r"#=|=#").search(code, at)
                if not m:
                    raise Bad("comment is not closed")
                depth, at = depth + (1 if m.group() == "#=" else -1), m.end()
            space = True
            continue
        m = _J_TOKEN.match(code, at)
        if not m:
            raise Bad(f"unexpected character {c!r}")
        kind, text, at = m.lastgroup, m.group(), m.end()
        if kind == "ws":
            space = True
            continue
        out.append((kind, text, space))
        space = kind == "nl"
    out.append(("end", "", True))
    return out


class _Julia:
    def __init__(self, code: str):
        self.t, self.i, self.open, self.ternary = _j_tokens(code), 0, [""], [0]

    def fail(self):
        raise Bad(f"unexpected {self.t[self.i][1].strip() or 'end of input'!r}")

    def peek(self) -> tuple[str, str, bool]:
        t = self.t[self.i]
        if self.open[-1]:
            while t[0] == "nl":
                self.i += 1
                t = self.t[self.i]
        return t

    def lines(self) -> None:
        while self.t[self.i][0] == "nl":
            self.i += 1

    def take(self, text: str) -> bool:
        t = self.peek()
        if t[1] == text and t[0] in ("op", "word"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail()

    def enter(self, mark: str) -> None:
        self.open.append(mark)
        self.ternary.append(0)

    def leave(self) -> None:
        self.open.pop()
        self.ternary.pop()

    def program(self) -> None:
        self.statements(())
        if self.t[self.i][0] != "end":
            self.fail()

    def statements(self, stops) -> None:
        while True:
            kind, text, _ = self.t[self.i]
            if kind == "nl" or text == ";" and kind == "op":
                self.i += 1
                continue
            if kind == "end" or kind == "word" and text in _J_STOP:
                return
            self.statement()
            kind, text, _ = self.t[self.i]
            if not (kind in ("nl", "end") or text == ";" or kind == "word" and text in stops):
                self.fail()

    def block(self, *stops: str) -> str:
        """Statements up to one of the words in stops, which is taken and returned."""
        self.enter("")
        self.statements(stops)
        self.leave()
        kind, text, _ = self.t[self.i]
        if kind != "word" or text not in stops:
            self.fail()
        self.i += 1
        return text

    def statement(self) -> None:
        kind, text, _ = self.peek()
        if kind == "word":
            if text in ("using", "import", "export", "public"):
                self.i += 1
                return self.names()
            if text in ("const", "global", "local"):
                self.i += 1
                return self.statement()
        self.listed()

    def listed(self) -> None:
        self.expr()
        while self.peek()[1] == "," and self.peek()[0] == "op":
            self.i += 1
            if self.peek()[0] in ("end", "nl") or self.peek()[1] == "=":
                if self.peek()[1] != "=":
                    self.fail()
                self.i += 1
            self.lines()
            self.expr()

    def names(self) -> None:
        """A.B: c, d as e."""
        while True:
            while self.take(".") or self.take("..."):
                pass
            self.take("@")
            t = self.peek()
            if t[0] == "word" and t[1] not in _J_STOP or t[0] == "op" and t[1] not in "()[]{},;:":
                self.i += 1
            else:
                self.fail()
            while self.take("."):
                self.take("@")
                if self.peek()[0] != "word":
                    self.fail()
                self.i += 1
            if self.take("as"):
                self.i += 1
            if not (self.take(",") or self.take(":")):
                return
            self.lines()

    def expr(self) -> None:
        self.operand()
        while True:
            kind, text, space = self.peek()
            if kind == "op":
                if text == "?" :
                    if not space:
                        self.fail()
                    self.i += 1
                    self.ternary[-1] += 1
                    self.lines()
                    self.expr()
                    self.lines()
                    self.ternary[-1] -= 1
                    self.need(":")
                    self.lines()
                    self.expr()
                    continue
                if text == "...":
                    self.i += 1
                    continue
                if text == ":" and space and self.ternary[-1]:
                    return
                if text == ":" and self.open[-1] == "[" and self.t[self.i + 1][1] in (",", "]") :
                    return
                if text in _J_NOT_BINARY:
                    return
                if self.open[-1] == "[" and space and not self.t[self.i + 1][2] and text in ("-", "+", ":", "~"):
                    return
                self.i += 1
                self.lines()
                self.operand()
            elif kind == "word" and text in ("in", "isa", "where", "∈"):
                self.i += 1
                self.operand()
            else:
                return

    def operand(self) -> None:
        kind, text, _ = self.peek()
        self.i += 1
        if kind == "num":
            nxt = self.t[self.i]
            if not nxt[2] and (nxt[0] == "word" and nxt[1] not in _J_STOP and nxt[1] not in ("in", "for", "if") or nxt[1] == "("):
                return self.operand()
            return self.postfix()
        if kind == "str":
            return self.postfix()
        if kind == "word":
            if text in _J_STOP or text in ("do", "in", "where", "using", "import", "export"):
                if text == "end" and self.open[-1] == "[":
                    return self.postfix()
                self.i -= 1
                self.fail()
            if text in _J_BLOCKS and not (text == "begin" and self.open[-1] == "[") and self.compound(text):
                return self.postfix()
            if text == "return":
                k, x, _ = self.peek()
                if k in ("nl", "end") or x in (";", ")", "]", ":") or k == "word" and x in _J_STOP:
                    return
                return self.listed() if not self.open[-1] else self.expr()
            return self.postfix()
        if kind == "op":
            if text in _J_CLOSE:
                self.items(text)
                return self.postfix()
            if text == "@":
                return self.macro()
            if text == ":":
                nk, nx, nspace = self.t[self.i]
                if nx in (",", "]", ")") and nk == "op":
                    return
                if nspace:
                    self.fail()
                if nx == "(":
                    return self.operand()
                if nk in ("word", "num", "str", "op"):
                    self.i += 1
                    return self.postfix()
                self.fail()
            nk, nx, nspace = self.peek()
            if (text == "!" or text not in _J_NOT_BINARY | {":"}) and nk in ("op", "nl", "end") and (nx in (",", ")", "]", "") or nk == "nl"):
                return  # an operator as a value
            if text in _J_UNARY:
                if nk in ("nl", "end"):
                    self.fail()
                return self.operand()
            if nx == "(" and not nspace and text not in _J_NOT_BINARY and text not in ("?", ".", "="):
                return self.postfix()
        self.i -= 1
        self.fail()

    def postfix(self) -> None:
        while True:
            kind, text, space = self.t[self.i] if not self.open[-1] else self.peek()
            if kind == "post":
                self.i += 1
            elif kind == "op" and text == "." :
                self.i += 1
                k, x, sp = self.t[self.i]
                if k in ("word", "str") and not sp:
                    self.i += 1
                elif x == "(":
                    self.i += 1
                    self.items("(")
                elif x in (":", "$", "@"):
                    return self.operand()
                else:
                    self.fail()
            elif kind == "op" and text in _J_CLOSE and not space:
                self.i += 1
                self.items(text)
            elif kind == "word" and text == "do":
                self.i += 1
                self.enter("")
                while self.t[self.i][0] != "nl" and self.t[self.i][1] != ";":
                    self.expr()
                    if not self.take(","):
                        break
                self.leave()
                self.block("end")
            else:
                return

    def items(self, mark: str) -> None:
        """Inside a bracket that has been opened, up to and with its end."""
        close = _J_CLOSE[mark]
        self.enter(mark)
        fresh = True
        while True:
            kind, text, space = self.peek()
            if kind == "op" and text == close:
                self.i += 1
                break
            if kind == "op" and text in ",;":
                if text == "," and fresh is True:
                    self.fail()
                self.i += 1
                fresh = True if text == "," else None
                continue
            if kind == "end":
                raise Bad(f"{mark!r} is not closed")
            if not fresh and fresh is not None and not (mark != "(" and space):
                self.fail()
            self.expr()
            fresh = False
            while self.take("for"):
                self.expr()
                while self.take(","):
                    self.expr()
                if self.take("if"):
                    self.expr()
        self.leave()

    def macro(self) -> None:
        t = self.t[self.i]
        if t[2] or not (t[0] == "word" or t[1] == "." or t[1].startswith(".")):
            self.fail()
        self.i += 1
        while self.t[self.i][1] == "." and not self.t[self.i][2]:
            self.i += 2
        if self.t[self.i][1] in _J_CLOSE and not self.t[self.i][2]:
            mark = self.t[self.i][1]
            self.i += 1
            self.items(mark)
            return self.postfix()
        while True:
            kind, text, _ = self.t[self.i] if self.open[-1] != "(" else self.peek()
            if kind in ("nl", "end") or kind == "op" and text in (")", "]", "}", ",", ";") or kind == "word" and text in _J_STOP | {"for"} and (text in _J_STOP or self.open[-1]):
                return
            self.statement() if not self.open[-1] else self.expr()

    def compound(self, word: str) -> bool:
        """The rest of a block that began with word; False if the word is a name here."""
        self.enter("")
        try:
            if word in ("begin", "quote"):
                self.block("end")
            elif word in ("if", "while"):
                self.expr()
                stop = self.block("end") if word == "while" else self.block("elseif", "else", "end")
                while stop == "elseif":
                    self.expr()
                    stop = self.block("elseif", "else", "end")
                if stop == "else":
                    self.block("end")
            elif word in ("for", "let"):
                if word == "for" or self.t[self.i][0] != "nl":
                    self.expr()
                    while self.take(","):
                        self.lines()
                        self.expr()
                self.block("end")
            elif word in ("function", "macro"):
                self.expr()
                self.block("end")
            elif word == "try":
                stop = self.block("catch", "finally", "end")
                while stop != "end":
                    if stop == "catch" and self.t[self.i][0] == "word" and self.t[self.i][1] not in _J_STOP:
                        self.i += 1
                    stop = self.block("catch", "else", "finally", "end")
            elif word in ("mutable", "abstract", "primitive"):
                if self.t[self.i][1] not in ("struct", "type"):
                    return False
                self.i += 1
                self.expr()
                if word == "primitive":
                    self.expr()
                self.block("end")
            elif word in ("struct", "module", "baremodule"):
                self.expr()
                self.block("end")
            else:
                return False
            return True
        finally:
            self.leave()


def julia_error(code: str) -> str | None:
    return _error(_Julia, code)


GRAMMARS = {"python": python_error, "r": r_error, "julia": julia_error}

# Marks by which a language is told from the others, each with its weight.
LANGUAGE_MARKS = {
    "python": re.compile(r"^\s*(?:import|from|def|class|elif|with|lambda)\b|\bNone\b|\bself\b|:\s*$|'[^'\n]{2,}'", re.M),
    "r": re.compile(r"<-|%>%|\blibrary\(|\bfunction\s*\(|\$\w|\bTRUE\b|\bFALSE\b|\bc\("),
    "julia": re.compile(r"^\s*(?:using|end|function \w)\b|\.[-+*/]=?|\bnothing\b|@\w+|=>|::", re.M),
}


def ranked(code: str) -> list[str]:
    """The grammars, by how many of their marks the code has."""
    counts = {name: len(mark.findall(code)) for name, mark in LANGUAGE_MARKS.items()}
    return sorted(GRAMMARS, key=lambda name: (-counts[name], name))


def diagnose(code: str, language: str | None) -> tuple[bool, str | None, list[str]]:
    """(valid in its language, reason if not, the grammars that take the code, best-ranked first). A language without a
    grammar, and code of white space only, are valid and no grammar is asked."""
    name = (language or "").lower()
    if name not in GRAMMARS or not code.strip():
        return True, None, []
    errors = {other: GRAMMARS[other](code) for other in ranked(code)}
    reason = errors[name]
    return reason is None, reason and reason[:120], [other for other, error in errors.items() if error is None]
