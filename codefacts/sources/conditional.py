"""Conditional directives: expressions with three-valued logic, and which spans of a file are compiled.

A value is a pair (kind, content); the kinds are truth (True, False or None for not known), number, string, version, unknown and
error. Comparisons bind loosest, then + - or xor, then * / div mod and shl shr, then signs and not. A file's directives are
read in order, so one file is one row in and its spans are rows out: a narrow map.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .pascal import LEXER, _mapped

UNKNOWN, ERROR = ("unknown", None), ("error", None)
WIDEST = 1 << 63
TOKEN = re.compile(r"\s+|(?P<string>'(?:[^']|'')*')|(?P<version>\d+\.\d+)|(?P<number>\$[0-9A-Fa-f]+|\d+)|(?P<name>[A-Za-z_][\w.]*)|(?P<symbol><=|>=|<>|[-+*/()=<>])|(?P<other>.)")
SPANS = "path string, directive string, start_line int, end_line int, activity string"
VALUES = "path string, line int, expression string, kind string, value string"
# Sizes of the built-in types on a 32-bit platform, in bytes.
SIZES = {
    "byte": 1, "shortint": 1, "boolean": 1, "ansichar": 1, "char": 2, "widechar": 2, "word": 2, "smallint": 2, "integer": 4, "cardinal": 4, "longint": 4, "longword": 4, "single": 4,
    "pointer": 4, "nativeint": 4, "nativeuint": 4, "int64": 8, "uint64": 8, "double": 8, "currency": 8, "comp": 8, "extended": 10,
}


@dataclass
class Environment:
    """What is defined, what constants are worth, and whether names beyond these are known not to be."""

    defined: set[str] = field(default_factory=set)
    constants: dict[str, tuple] = field(default_factory=dict)
    closed: bool = True

    def is_defined(self, name: str) -> tuple:
        return "truth", True if name.lower() in self.defined else False if self.closed else None


def number(n: int) -> tuple:
    return ("number", n) if -WIDEST <= n < WIDEST else ERROR


def both_numbers(a: tuple, b: tuple) -> bool:
    return a[0] == b[0] == "number"


def kleene(op: str, a, b):
    if op == "and":
        return False if a is False or b is False else None if a is None or b is None else True
    if op == "or":
        return True if a is True or b is True else None if a is None or b is None else False
    return None if a is None or b is None else a != b


def combined(op: str, a: tuple, b: tuple) -> tuple:
    """a op b: errors win, then unknown values; and, or, xor work on truths and on bits."""
    if ERROR in (a, b):
        return ERROR
    if op in ("*", "/", "div", "mod"):
        if UNKNOWN in (a, b) or not both_numbers(a, b):
            return ERROR
        if op == "*":
            return number(a[1] * b[1])
        if b[1] == 0:
            return ERROR
        if op == "/":
            return UNKNOWN
        whole = abs(a[1]) // abs(b[1]) * (1 if (a[1] < 0) == (b[1] < 0) else -1)
        return number(whole) if op == "div" else number(a[1] - whole * b[1])
    if UNKNOWN in (a, b):
        return UNKNOWN
    if op in ("and", "or", "xor"):
        if a[0] == b[0] == "truth":
            return "truth", kleene(op, a[1], b[1])
        return number({"and": int.__and__, "or": int.__or__, "xor": int.__xor__}[op](a[1], b[1])) if both_numbers(a, b) else ERROR
    if op == "+" and a[0] == b[0] == "string":
        return "string", a[1] + b[1]
    if op in ("+", "-"):
        return number(a[1] + b[1] if op == "+" else a[1] - b[1]) if both_numbers(a, b) else ERROR
    if not both_numbers(a, b) or not 0 <= b[1] < 64:
        return ERROR
    if op == "shr":
        return number(a[1] >> b[1])
    bits = a[1] << b[1] & (1 << 64) - 1
    return number(bits - (1 << 64) if bits >= WIDEST else bits)


def compared(op: str, a: tuple, b: tuple) -> tuple:
    """A truth: values of one kind compare, a version with a number too; anything unknown gives a truth that isn't known."""
    if ERROR in (a, b):
        return ERROR
    if UNKNOWN in (a, b) or a == ("truth", None) or b == ("truth", None):
        return "truth", None
    if {a[0], b[0]} == {"version", "number"}:
        a, b = (x if x[0] == "version" else ("version", (x[1], 0)) for x in (a, b))
    if a[0] != b[0] or a[0] == "truth" and op not in ("=", "<>"):
        return ERROR
    x, y = a[1], b[1]
    return "truth", {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op] if a[0] != "truth" or op in ("=", "<>") else None


class Reader:
    def __init__(self, text: str, env: Environment):
        self.tokens = [(m.lastgroup, m[0]) for m in TOKEN.finditer(text) if m.lastgroup]
        self.at, self.env, self.malformed = 0, env, False

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def take(self, *wanted: str) -> str:
        kind, text = self.peek()
        if text.lower() in wanted and kind in ("symbol", "name"):
            self.at += 1
            return text.lower()
        return ""

    def value(self) -> tuple:
        out = self.comparison()
        return ERROR if self.malformed or self.at < len(self.tokens) else out

    def comparison(self) -> tuple:
        left = self.sum()
        while op := self.take("=", "<>", "<", "<=", ">", ">="):
            left = compared(op, left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.product()
        while op := self.take("+", "-", "or", "xor"):
            left = combined(op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.sign()
        while op := self.take("*", "/", "div", "mod", "and", "shl", "shr"):
            left = combined(op, left, self.sign())
        return left

    def sign(self) -> tuple:
        if self.take("not"):
            v = self.sign()
            return ("truth", None if v[1] is None else not v[1]) if v[0] == "truth" else number(~v[1]) if v[0] == "number" else v if v in (UNKNOWN, ERROR) else ERROR
        if self.take("-"):
            v = self.sign()
            return number(-v[1]) if v[0] == "number" else v if v in (UNKNOWN, ERROR) else ERROR
        self.take("+")
        return self.atom()

    def argument(self) -> str:
        if not self.take("("):
            self.malformed = True
            return ""
        kind, text = self.peek()
        self.at += 1
        if not self.take(")"):
            self.malformed = True
        return text

    def atom(self) -> tuple:
        kind, text = self.peek()
        self.at += 1
        low = text.lower()
        if kind == "number":
            return number(int(text[1:], 16) if text[0] == "$" else int(text))
        if kind == "version":
            return "version", tuple(map(int, text.split(".")))
        if kind == "string":
            return "string", text[1:-1].replace("''", "'")
        if text == "(":
            v = self.comparison()
            if not self.take(")"):
                self.malformed = True
            return v
        if kind != "name":
            self.malformed = True
            return ERROR
        if low in ("true", "false"):
            return "truth", low == "true"
        if low == "defined":
            name = self.argument()
            return UNKNOWN if "." in name else self.env.is_defined(name)
        if low == "declared":
            name = self.argument().lower()
            return "truth", True if name in self.env.constants else None
        if low == "sizeof":
            size = SIZES.get(self.argument().lower())
            return UNKNOWN if size is None else number(size)
        if low in ("length", "ord"):
            arg = self.argument()
            v = ("string", arg[1:-1].replace("''", "'")) if arg[:1] == "'" else self.env.constants.get(arg.lower(), UNKNOWN)
            if v[0] != "string":
                return v if low == "ord" and v[0] == "number" else UNKNOWN if v == UNKNOWN else ERROR
            return number(len(v[1])) if low == "length" else number(ord(v[1])) if len(v[1]) == 1 else ERROR
        return self.env.constants.get(low, UNKNOWN)


def evaluate(text: str, env: Environment) -> tuple:
    return Reader(text, env).value()


def as_text(v: tuple) -> str | None:
    kind, x = v
    return None if x is None else ".".join(map(str, x)) if kind == "version" else str(x).lower() if kind == "truth" else str(x)


DIRECTIVE = re.compile(r"^(?:\{\$|\(\*\$)\s*(ifdef|ifndef|if|elseif|else|endif|ifend|define|undef)\b\s*(.*?)\s*(?:\}|\*\))$", re.I | re.S)


def directives(text: str):
    """(name, argument, line) of the conditional directives, comments and strings left out."""
    line = 1
    for m in LEXER.finditer(text):
        if m.lastgroup == "directive" and (d := DIRECTIVE.match(m[0])):
            yield d[1].lower(), d[2], line
        line += m[0].count("\n")


def active(truth) -> str:
    return "active" if truth is True else "inactive" if truth is False else "unknown"


def spans_of(text: str, env: Environment) -> list[tuple]:
    """(directive, start_line, end_line, activity) of each branch, from its directive to the next of the same level.

    Definitions count where they are known to be compiled; one in an unknown span makes its name's state unknown.
    """
    here = Environment(set(env.defined), dict(env.constants), env.closed)
    doubtful: set[str] = set()
    stack: list[list] = []  # taken so far, own truth, directive, line, activity
    out = []

    def outer(depth: int):
        state = True
        for s in stack[:depth]:
            state = kleene("and", state, s[1])
        return state

    def truth_of(name: str, arg: str):
        if name in ("ifdef", "ifndef"):
            word = (arg.split() or [""])[0].lower()
            t = None if word in doubtful else here.is_defined(word)[1]
            return (None if t is None else not t) if name == "ifndef" else t
        v = evaluate(arg, here)
        return v[1] if v[0] == "truth" else None

    for name, arg, line in directives(text):
        if name in ("define", "undef"):
            word, state = (arg.split() or [""])[0].lower(), outer(len(stack))
            if state is None:
                doubtful.add(word)
            elif state:
                doubtful.discard(word)
                (here.defined.add if name == "define" else here.defined.discard)(word)
        elif name in ("if", "ifdef", "ifndef"):
            t = truth_of(name, arg)
            stack.append([t, t, name, line])
        elif stack:
            taken, _, opened, start = top = stack[-1]
            out.append((opened, start, line, active(outer(len(stack)))))
            if name in ("endif", "ifend"):
                stack.pop()
                continue
            free = None if taken is None else not taken
            t = free if name == "else" else kleene("and", free, truth_of("if", arg))
            top[:] = [kleene("or", taken, t), t, name, line]
    last = text.count("\n") + 1
    for depth in range(len(stack), 0, -1):
        out.append((stack[depth - 1][2], stack[depth - 1][3], last, active(outer(depth))))
    return sorted(out, key=lambda s: (s[1], s[2]))


def activity(files: DataFrame, env: Environment = Environment()) -> DataFrame:
    """(path, directive, start_line, end_line, activity) of files (path, text)."""
    return _mapped(files, SPANS, lambda text: spans_of(text, env))


def expressions(files: DataFrame, env: Environment = Environment()) -> DataFrame:
    """(path, line, expression, kind, value) of the $IF and $ELSEIF directives of files (path, text)."""
    rows = lambda text: [(line, arg, v[0], as_text(v)) for name, arg, line in directives(text) if name in ("if", "elseif") for v in [evaluate(arg, env)]]
    return _mapped(files, VALUES, rows)
