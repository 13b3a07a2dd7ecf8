"""Control-flow graphs of Pascal routines as tables: blocks, their statements, and edges.

The body of each routine is read once, statement by statement. A `finally` part is laid out anew for every way that leaves its
try (on, by an exception, by exit, break or continue), so that no path mixes two of them. Every block inside a try may raise:
it has an exceptional edge to the handler or the finally part, or to the exit. One file is one row in; nothing looks across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .pascal import _mapped, lex

BLOCKS = "path string, routine string, block int, kind string"
STATEMENTS = "path string, routine string, block int, ord int, kind string, start int, end int, line int, text string"
EDGES = "path string, routine string, src int, dst int, kind string"
ENDS = {"end", "else", "until", "except", "finally"}
HEADS = {"procedure", "function", "constructor", "destructor"}
DECLARES = {"var", "const", "type", "label", "threadvar"}


class Routine:
    """The graph of one body. Block 0 is the entry, block 1 the exit."""

    def __init__(self, name: str, tokens: list, at: int, params: list[tuple[str, str]]):
        self.name, self.t, self.at, self.variables = name, tokens, at, params
        self.kinds, self.statements, self.edges = ["entry", "exit"], [[], []], []
        self.here: int | None = 0
        self.loops: list[tuple[int, int, int]] = []
        self.tries: list[dict] = []

    def low(self, k: int = 0) -> str:
        return self.t[self.at + k][1].lower() if 0 <= self.at + k < len(self.t) else ""

    def block(self, kind: str = "normal") -> int:
        self.kinds.append(kind)
        self.statements.append([])
        new = len(self.kinds) - 1
        if self.tries:
            self.edge(new, self.thrown(), "exception")
        return new

    def edge(self, src: int | None, dst: int, kind: str = "next") -> None:
        if src is not None and (src, dst, kind) not in self.edges:
            self.edges.append((src, dst, kind))

    def enter(self, block: int, kind: str = "next") -> None:
        self.edge(self.here, block, kind)
        self.here = block

    def add(self, kind: str, first: int, last: int) -> None:
        if self.here is None:
            self.here = self.block("unreachable")
        if first <= last < len(self.t):
            self.statements[self.here].append((kind, first, last))

    def until(self, *stops: str) -> tuple[int, int]:
        """The tokens before a stop word at depth 0; the stop word is the next."""
        first, depth = self.at, 0
        while self.at < len(self.t) and not (depth <= 0 and self.low() in stops):
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(self.low(), 0)
            self.at += 1
        return first, self.at - 1

    # ---- exceptions and finally parts

    def thrown(self) -> int:
        """Where an exception goes from here."""
        if not self.tries:
            return 1
        frame = self.tries[-1]
        if frame["thrown"] is None:
            if frame["handler"] is not None:
                frame["thrown"] = frame["handler"]
            else:
                here, self.here = self.here, None
                frame["thrown"] = self.laid_out(len(self.tries) - 1, lambda: self.thrown(), "exception")
                self.here = here
        return frame["thrown"]

    def laid_out(self, depth: int, target, kind: str) -> int:
        """A copy of a frame's finally part that goes on to target; its first block."""
        frame, at, tries, loops = self.tries[depth], self.at, self.tries, self.loops
        self.tries = tries[:depth]
        first = self.block("finally")
        self.here, self.at = first, frame["finally"]
        self.list_until("end")
        self.edge(self.here, target(), kind)
        self.at, self.tries, self.loops = at, tries, loops
        return first

    def leave(self, depth: int, target: int, kind: str) -> None:
        """Go to target through the finally parts of the frames above depth."""
        inner = [k for k in range(len(self.tries) - 1, depth - 1, -1) if self.tries[k]["handler"] is None]
        here = self.here
        for k in inner:
            at, tries = self.at, self.tries
            self.tries = tries[:k]
            self.here = here
            self.enter(self.block("finally"), kind)
            self.at = tries[k]["finally"]
            self.list_until("end")
            here, self.at, self.tries = self.here, at, tries
        self.edge(here, target, kind)
        self.here = None

    # ---- statements

    def list_until(self, *stops: str) -> None:
        while self.at < len(self.t) and self.low() not in stops:
            if self.low() == ";":
                self.at += 1
            elif self.low() in ENDS:
                return
            else:
                self.statement()

    def statement(self) -> None:
        w = self.low()
        if w in ("if", "while", "for", "case", "repeat", "try", "with", "begin", "asm"):
            getattr(self, f"{w}_")()
        elif w == "raise":
            first, last = self.until(";", *ENDS)
            self.add("raise", first, last)
            self.edge(self.here, self.thrown(), "raise")
            self.here = None
        elif w in ("exit", "break", "continue") and self.low(1) in (";", "(", *ENDS):
            first, last = self.until(";", *ENDS)
            self.add(w, first, last)
            if w == "exit":
                self.leave(0, 1, "exit")
            elif self.loops:
                out, again, depth = self.loops[-1]
                self.leave(depth, out if w == "break" else again, w)
        else:
            first, last = self.until(";", *ENDS)
            if last < first:
                self.at += 1
                return
            self.add("statement", first, last)

    def begin_(self) -> None:
        self.at += 1
        self.list_until("end")
        self.at += 1

    def asm_(self) -> None:
        first, last = self.until("end")
        self.add("asm", first, last)
        self.at += 1

    def one(self) -> None:
        """The statement of a branch, which may be empty."""
        if self.low() != ";" and self.low() not in ENDS:
            self.statement()

    def branch(self, src: int | None, kind: str) -> int:
        new = self.block()
        self.edge(src, new, kind)
        self.here = new
        return new

    def if_(self) -> None:
        first, last = self.until("then")
        self.add("if", first, last)
        test = self.here
        self.at += 1
        self.branch(test, "true")
        self.one()
        after_true, after_false, kind = self.here, test, "false"
        if self.low() == "else":
            self.at += 1
            self.branch(test, "false")
            self.one()
            after_false, kind = self.here, "next"
        if after_true is None and after_false is None:
            self.here = None
            return
        self.here = self.block()
        self.edge(after_true, self.here)
        self.edge(after_false, self.here, kind)

    def loop(self, kind: str) -> None:
        self.enter(self.block("loop"))
        head = self.here
        first, last = self.until("do")
        self.add(kind, first, last)
        self.at += 1
        after = self.block()
        self.edge(head, after, "false")
        self.loops.append((after, head, len(self.tries)))
        self.branch(head, "true")
        self.one()
        self.edge(self.here, head, "back")
        self.loops.pop()
        self.here = after

    def while_(self) -> None:
        self.loop("while")

    def for_(self) -> None:
        self.loop("for")

    def repeat_(self) -> None:
        self.at += 1
        body, test, after = self.block("loop"), self.block(), self.block()
        self.enter(body)
        self.loops.append((after, test, len(self.tries)))
        self.list_until("until")
        self.loops.pop()
        self.enter(test)
        first, last = self.until(";", *(ENDS - {"until"}))
        self.add("until", first, last)
        self.edge(test, after, "true")
        self.edge(test, body, "false")
        self.here = after

    def case_(self) -> None:
        first, last = self.until("of")
        self.add("case", first, last)
        test, after, whole = self.here, self.block(), False
        self.at += 1
        while self.at < len(self.t) and self.low() != "end":
            if self.low() == ";":
                self.at += 1
                continue
            if self.low() == "else":
                self.at += 1
                whole = True
                self.branch(test, "default")
                self.list_until("end")
            else:
                self.until(":", "end", "else")
                if self.low() != ":":
                    continue
                self.at += 1
                self.branch(test, "case")
                self.one()
            self.edge(self.here, after)
        self.at += 1
        if not whole:
            self.edge(test, after, "default")
        self.here = after

    def with_(self) -> None:
        first, last = self.until("do")
        self.add("with", first, last)
        self.at += 1
        self.one()

    def part_of_try(self) -> tuple[int, str]:
        """Where the except or finally word of the try at hand stands, and which it is."""
        depth, k = 0, self.at + 1
        while k < len(self.t):
            w = self.t[k][1].lower()
            if w in ("begin", "case", "asm", "try") and self.t[k - 1][1] != ".":
                depth += 1
            elif w == "end":
                if depth == 0:
                    return k, w
                depth -= 1
            elif w in ("except", "finally") and depth == 0:
                return k, w
            k += 1
        return len(self.t), ""

    def try_(self) -> None:
        at, word = self.part_of_try()
        handler = None
        if word == "except":
            handler = self.block("handler")
        self.tries.append({"handler": handler, "finally": at + 1, "thrown": None})
        self.at += 1
        self.enter(self.block())
        self.list_until("except", "finally", "end")
        frame = self.tries.pop()
        if word == "finally":
            self.at = at + 1
            if self.here is not None:
                self.enter(self.block("finally"))
            start = self.at
            if self.here is None:
                depth = 0
                while self.at < len(self.t) and not (depth == 0 and self.low() == "end"):
                    depth += (self.low() in ("begin", "case", "asm", "try")) - (self.low() == "end")
                    self.at += 1
            else:
                self.list_until("end")
            frame["finally"] = start
        elif word == "except":
            after = self.block()
            self.edge(self.here, after)
            self.at, self.here, caught = at + 1, handler, False
            while self.at < len(self.t) and self.low() != "end":
                if self.low() == "on":
                    first, last = self.until("do")
                    self.at += 1
                    self.branch(handler, "handles")
                    self.add("on", first, last)
                    self.one()
                    self.edge(self.here, after)
                    self.here = None
                elif self.low() == "else":
                    self.at += 1
                    caught = True
                    self.branch(handler, "handles")
                    self.list_until("end")
                    self.edge(self.here, after)
                    self.here = None
                elif self.low() == ";":
                    self.at += 1
                else:
                    caught = True
                    self.list_until("end", "on", "else")
                    self.edge(self.here, after)
                    self.here = None
            if self.t[at + 1 : at + 2] and self.low() == "end" and at + 1 == self.at:
                caught = True  # an empty handler
                self.edge(handler, after)
            if not caught:
                self.edge(handler, self.thrown(), "raise")
            self.here = after
        self.at += 1

    def run(self) -> Routine:
        self.enter(self.block())
        self.begin_()
        self.edge(self.here, 1)
        return self


def routines(text: str) -> list[Routine]:
    """The graphs of all routines with a body, nested ones too, in the order of their bodies."""
    t = [x for x in lex(text) if x[0] not in ("comment", "directive")]
    found, open_, k = [], [], 0
    while k < len(t):
        w = t[k][1].lower()
        if w in HEADS and (k == 0 or t[k - 1][1] not in (":=", "(", ",", "=")):
            name, j = "", k + 1
            while j < len(t) and (t[j][0] == "name" or t[j][1] == "."):
                name += t[j][1]
                j += 1
            variables, names, depth = [], [], 0
            while j < len(t) and not (depth == 0 and t[j][1] == ";"):
                if t[j][1] in "()":
                    depth += 1 if t[j][1] == "(" else -1
                elif depth and t[j][0] == "name" and t[j][1].lower() not in ("const", "var", "out") and t[j + 1 : j + 2] and t[j + 1][1] in (",", ":"):
                    names.append((t[j][1], t[j - 1][1].lower() if t[j - 1][1].lower() == "out" else ""))
                elif depth and t[j][1] == ":" and t[j + 1 : j + 2]:
                    variables += [(n, t[j + 1][1]) for n, out in names if not out]
                    names = []
                j += 1
            open_.append((name, variables))
            k = j
        elif w == "var" and open_:
            j, names = k + 1, []
            while j + 1 < len(t) and t[j][0] == "name" and t[j + 1][1] in (",", ":") and t[j][1].lower() not in HEADS:
                names.append(t[j][1])
                if t[j + 1][1] == ":":
                    open_[-1][1].extend((n, t[j + 2][1]) for n in names if j + 2 < len(t))
                    names = []
                    while j < len(t) and t[j][1] != ";":
                        j += 1
                    j += 1
                else:
                    j += 2
            k = j - 1
        elif w == "begin" and open_:
            name, variables = open_.pop()
            r = Routine(name, t, k, variables).run()
            found.append(r)
            k = r.at - 1
        elif w in ("forward", "external") and open_:
            open_.pop()
        elif w in ("implementation", "initialization", "end"):
            open_ = []
        k += 1
    return found


def text_of(t: list, first: int, last: int) -> str:
    return " ".join(x[1] for x in t[first : last + 1])


def blocks(files: DataFrame) -> DataFrame:
    """(path, routine, block, kind) of files (path, text)."""
    return _mapped(files, BLOCKS, lambda text: [(r.name, k, kind) for r in routines(text) for k, kind in enumerate(r.kinds)])


def edges(files: DataFrame) -> DataFrame:
    """(path, routine, src, dst, kind)."""
    return _mapped(files, EDGES, lambda text: [(r.name, *e) for r in routines(text) for e in r.edges])


def statements(files: DataFrame) -> DataFrame:
    """(path, routine, block, ord, kind, start, end, line, text): a finally part's statements stand in each of its copies."""
    return _mapped(files, STATEMENTS, lambda text: [(r.name, b, k, kind, r.t[x][2], r.t[y][3], r.t[x][4], text_of(r.t, x, y)) for r in routines(text) for b, s in enumerate(r.statements) for k, (kind, x, y) in enumerate(s)])
