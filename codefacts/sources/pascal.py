"""Pascal source as tables: tokens, and the nodes that a structure recogniser finds in them.

One file is one row in and many rows out; nothing looks across files, so both are narrow maps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEXER = re.compile(
    r"(?P<comment>//[^\n]*|\{[^$][^}]*\}|\{\}|\(\*(?!\$).*?\*\))|(?P<directive>\{\$[^}]*\}|\(\*\$.*?\*\))|(?P<string>(?:'(?:[^'\n]|'')*'?|\#\$?[0-9A-Fa-f]+)+)"
    r"|(?P<number>\$[0-9A-Fa-f]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>&?[^\W\d]\w*)|(?P<symbol>:=|<=|>=|<>|\.\.|[^\s\w])|(?P<space>\s+)|(?P<other>.)",
    re.S,
)
TOKENS = "path string, ord int, kind string, text string, start int, end int, line int, column int"
NODES = "path string, node_id int, parent_id int, kind string, name string, routine string, routine_kind string, ord int, line int, column int, end_line int, detail string"
OPENERS = {"begin", "case", "asm", "try", "repeat"}
ROUTINES = {"procedure", "function", "constructor", "destructor"}
SECTIONS = {"type", "const", "var", "threadvar", "resourcestring", "label"}


def lex(text: str) -> Iterator[tuple[str, str, int, int, int, int]]:
    """(kind, text, start, end, line, column), white space left out."""
    line, begin = 1, 0
    for m in LEXER.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind != "space":
            yield kind, value, m.start(), m.end(), line, m.start() - begin + 1
        if "\n" in value:
            line += value.count("\n")
            begin = m.start() + value.rindex("\n") + 1


class Recogniser:
    """Nodes of one file, by one pass over its tokens. Unfinished constructs end with the file."""

    def __init__(self, text: str):
        self.t = [x for x in lex(text) if x[0] not in ("comment", "directive")]
        self.nodes: list[list] = []
        self.at = 0

    def low(self, k: int = 0) -> str:
        return self.t[self.at + k][1].lower() if 0 <= self.at + k < len(self.t) else ""

    def add(self, kind: str, name: str | None, parent: int | None, routine: tuple = (None, None), order: int = 0, token: int | None = None, detail: str | None = None) -> int:
        _, _, _, _, line, column = self.t[min(self.at if token is None else token, len(self.t) - 1)]
        self.nodes.append([len(self.nodes), parent, kind, name, routine[0], routine[1], order, line, column, line, detail])
        return len(self.nodes) - 1

    def close(self, node: int) -> None:
        self.nodes[node][9] = self.t[min(self.at, len(self.t) - 1)][4]

    def skip_to(self, *stops: str) -> None:
        depth = 0
        while self.at < len(self.t) and not (depth == 0 and self.low() in stops):
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(self.low(), 0)
            self.at += 1

    def run(self) -> list[list]:
        section = ""
        while self.at < len(self.t):
            w = self.low()
            if w in SECTIONS:
                section = w
                self.at += 1
            elif w in ("interface", "implementation", "initialization", "finalization", "uses", "begin") and not (w == "interface" and self.low(-1) == "="):
                section = ""
                self.at += 1
            elif w in ROUTINES:
                section = ""
                self.routine()
            elif section == "type" and self.t[self.at][0] == "name" and self.low(1) == "=":
                self.type()
            elif section == "const" and self.t[self.at][0] == "name" and self.low(1) in ("=", ":"):
                self.add("constant", self.t[self.at][1], None)
                self.skip_to(";")
            else:
                self.at += 1
        return self.nodes

    def type(self) -> None:
        name, word = self.t[self.at][1], self.low(2) if self.low(2) != "packed" else self.low(3)
        if word not in ("class", "record", "interface") or self.low(3) in (";", "of"):
            self.skip_to(";")
            return
        node = self.add(word, name, None)
        self.at += 3
        if self.low() == "(":
            self.at += 1
            self.skip_to(")")
            self.at += 1
            if self.low() == ";":
                self.close(node)
                return
        while self.at < len(self.t) and self.low() != "end":
            if self.low() in ROUTINES:
                kind = self.low()
                self.at += 1
                member, start = self.t[self.at][1] if self.at < len(self.t) else "", self.at
                self.skip_to(";")
                words = []
                while self.low(1) in ("override", "virtual", "reintroduce", "overload", "abstract", "static", "dynamic", "stdcall", "cdecl", "inline"):
                    self.at += 1
                    words.append(self.low())
                    self.at += 1
                self.add("method", member, node, (f"{name}.{member}", kind), token=start, detail=" ".join(words))
            elif self.t[self.at][0] == "name" and self.low(1) in (":", ","):
                while self.t[self.at][0] == "name" and self.low(1) == ",":
                    self.add("field", self.t[self.at][1], node)
                    self.at += 2
                self.add("field", self.t[self.at][1], node)
                self.skip_to(";", "end")
                continue
            self.at += 1
        self.close(node)

    def routine(self) -> None:
        kind = self.low()
        start = self.at
        self.at += 1
        name = ""
        while self.at < len(self.t) and (self.t[self.at][0] == "name" or self.low() == "."):
            name += self.t[self.at][1]
            self.at += 1
        own = (name, kind)
        variables: list[tuple[str, int]] = []
        if self.low() == "(":
            depth, expects = 0, True
            while self.at < len(self.t):
                w = self.low()
                depth += (w == "(") - (w == ")")
                if depth == 1 and w in ("(", ";"):
                    expects = True
                elif w == ":":
                    expects = False
                elif expects and self.t[self.at][0] == "name" and w not in ("const", "var", "out"):
                    variables.append((self.t[self.at][1], self.at))
                self.at += 1
                if depth == 0:
                    break
        self.skip_to(";")
        self.at += 1
        while self.low() in ("override", "overload", "virtual", "reintroduce", "stdcall", "cdecl", "inline", "static", "abstract"):
            self.at += 2
        if self.low() in ("forward", "external") or self.low() not in (*SECTIONS, "begin", "asm", *ROUTINES):
            return  # a header without a body
        node = self.add("routine", name, None, own, token=start)
        section = ""
        while self.at < len(self.t) and self.low() not in ("begin", "asm"):
            if self.low() in ROUTINES:
                self.routine()
                continue
            if self.low() in SECTIONS:
                section = self.low()
            elif section == "var" and self.t[self.at][0] == "name" and self.low(1) in (",", ":"):
                variables.append((self.t[self.at][1], self.at))
                if self.low(1) == ":":
                    self.skip_to(";")
            elif self.low() in ("implementation", "initialization", "finalization"):
                return
            self.at += 1
        for v, k in variables:
            self.add("local", v, node, own, token=k)
        self.body(node, own)
        self.close(node)

    def body(self, routine: int, own: tuple) -> None:
        """Statements from `begin` to its `end`; order counts statements inside their block."""
        stack: list[list] = []  # word, node, statements so far
        fresh = False
        while self.at < len(self.t):
            w, kind = self.low(), self.t[self.at][0]
            top = stack[-1] if stack else None
            if w in OPENERS and self.low(-1) != ".":
                if top and w != "begin":
                    top[2] += 1
                node = self.add(w, None, top[1] if top else routine, own, top[2] if top else 0)
                stack.append([w, node, 0])
                fresh = True
            elif w in ("except", "finally") and top:
                self.close(top[1])
                stack.append([w, self.add(w, None, top[1], own), 0])
                fresh = True
            elif w == "end" and top:
                last = stack.pop()
                self.close(last[1])
                if last[0] in ("except", "finally") and stack:
                    self.close(stack[-1][1])
                    stack.pop()
                if not stack:
                    return
                fresh = True
            elif w == "until" and top and top[0] == "repeat":
                self.close(stack.pop()[1])
            elif w in (";", "then", "else", "do"):
                fresh = True
            elif top:
                if fresh and w not in ("on", "else"):
                    top[2] += 1
                    self.statement(top, own)
                    fresh = False
                elif w == "on" and top[0] == "except":
                    self.add("on", self.t[self.at + 1][1] if self.at + 1 < len(self.t) else None, top[1], own, top[2])
                if kind == "name" and w in ("raise", "with", "inherited"):
                    self.add(w, None, top[1], own, top[2], detail="first" if self.low(-1) in (";", "begin", "try", "except", "finally", "then", "else", "do", "repeat") else None)
            self.at += 1

    def statement(self, top: list, own: tuple) -> None:
        """A statement node; creations and frees of a variable carry its name."""
        target, k = "", 0
        while self.at + k < len(self.t) and (self.t[self.at + k][0] == "name" or self.low(k) == "."):
            target += self.t[self.at + k][1]
            k += 1
        kind, name = "statement", None
        if self.low(k) == ":=":
            call, j = "", k + 1
            while self.at + j < len(self.t) and (self.t[self.at + j][0] == "name" or self.low(j) == "."):
                call += self.t[self.at + j][1]
                j += 1
            kind, name = ("create" if call.lower().endswith(".create") else "assign"), target
        elif target.lower() == "freeandnil" and self.low(k) == "(":
            kind, name = "free", self.t[self.at + k + 1][1] if self.at + k + 1 < len(self.t) else None
        elif target.lower().endswith((".free", ".destroy")):
            kind, name = "free", target.rpartition(".")[0]
        self.add(kind, name, top[1], own, top[2], detail=self.low())


def _mapped(files: DataFrame, ddl: str, rows_of) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(path, *r) for r in rows_of(text or "")]
                cols = list(zip(*rows, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return files.select("path", "text").mapInArrow(run, ddl)


def tokens(files: DataFrame) -> DataFrame:
    """(path, ord, kind, text, start, end, line, column) of files (path, text)."""
    return _mapped(files, TOKENS, lambda text: [(k, *x) for k, x in enumerate(lex(text))])


def nodes(files: DataFrame) -> DataFrame:
    """The nodes that the recogniser finds in files (path, text)."""
    return _mapped(files, NODES, lambda text: Recogniser(text).run() if text.strip() else [])
