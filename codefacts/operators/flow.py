"""Rules that follow the control flow of a routine: use after free, unchecked nil, transactions.

Data flow stays inside a routine, so each file is analysed where it is read: a narrow map over sources, with a worklist over
the blocks of one routine at a time. Transactions need only an ordered list of operations, so they are aggregates.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.sources.cfg import Routine, routines
from codefacts.sources.pascal import _mapped

FINDINGS = "path string, rule string, severity string, line int, column int, message string"
OPERATIONS = "path string, routine string, ord int, receiver string, op string, guarded boolean, in_handler boolean, line int, column int"
# Methods of database components that begin and end transactions.
TRANSACTION_METHODS = {
    "starttransaction": "start", "begintrans": "start", "commit": "commit", "commitretaining": "commit", "committrans": "commit",
    "rollback": "rollback", "rollbackretaining": "rollback", "rollbacktrans": "rollback", "intransaction": "test",
}


class Effects:
    """What one statement does to variables: names in lower case, with the place of each token."""

    def __init__(self, t: list, kind: str, first: int, last: int):
        self.frees, self.assigns, self.reads, self.tests, self.uses = [], [], [], [], []
        self.guard: tuple[str, bool] | None = None
        words = [x[1].lower() for x in t[first : last + 1]]
        get = lambda k: words[k] if 0 <= k < len(words) else ""
        taken = set()
        for k, w in enumerate(words):
            if t[first + k][0] != "name" or k in taken or get(k - 1) == ".":
                continue
            if w == "freeandnil" and get(k + 1) == "(" and get(k + 3) == ")":
                self.frees.append((get(k + 2), "nil"))
                taken.add(k + 2)
            elif w == "assigned" and get(k + 1) == "(" and get(k + 3) == ")":
                self.tests.append(get(k + 2))
                taken.add(k + 2)
            elif get(k + 1) == "." and get(k + 2) in ("free", "destroy") and get(k + 3) in ("", ";"):
                self.frees.append((w, "dangling"))
            elif get(k + 1) == ":=" and (k == 0 or kind == "for" and k == 1) or kind == "for" and k == 1 and get(2) == "in":
                self.assigns.append(w)
            elif (get(k + 1) in ("=", "<>") and get(k + 2) == "nil") or (get(k - 1) in ("=", "<>") and get(k - 2) == "nil"):
                self.tests.append(w)
            else:
                self.reads.append(w)
                if get(k + 1) in (".", "^"):
                    self.uses.append((w, t[first + k]))
        self.nils = [words[0]] if get(1) == ":=" and words[2:] == ["nil"] else []
        self.raises_if_nil = [words[2]] if get(0) == "raiseifnil" and get(1) == "(" else []
        self.at = t[first]
        if kind in ("if", "while", "until"):
            self.guard = guard_of([w for w in words[1:]])


def guard_of(words: list[str]) -> tuple[str, bool] | None:
    """The variable that a condition tests against nil, and whether it is true when the variable isn't nil."""
    yes = True
    while words and words[0] == "not":
        words, yes = words[1:], not yes
    while len(words) > 2 and words[0] == "(" and words[-1] == ")":
        words = words[1:-1]
    if len(words) == 4 and words[0] == "assigned":
        return words[2], yes
    if len(words) == 3 and "nil" in (words[0], words[2]) and words[1] in ("=", "<>"):
        return (words[0] if words[2] == "nil" else words[2]), yes == (words[1] == "<>")
    return None


def solved(r: Routine, start: dict, step, refine, join) -> None:
    """Forward data flow to a fixed point. step(block's effects, state) changes a state, refine(kind, effects, state) an edge's."""
    effects = [[Effects(r.t, *s) for s in block] for block in r.statements]
    out_edges: dict[int, list] = {}
    for a, b, kind in r.edges:
        out_edges.setdefault(a, []).append((b, kind))
    states, work = {0: start}, deque([0])
    while work:
        block = work.popleft()
        state = dict(states[block])
        for e in effects[block]:
            step(e, state)
        last = effects[block][-1] if effects[block] else None
        for to, kind in out_edges.get(block, ()):
            out = dict(state)
            if last is not None and last.guard and kind in ("true", "false"):
                refine(last.guard[0], (kind == "true") == last.guard[1], out)
            met = out if to not in states else join(states[to], out)
            if states.get(to) != met:
                states[to] = met
                work.append(to)


def freed_findings(r: Routine) -> set[tuple]:
    """May-analysis of freed variables: nil after FreeAndNil, dangling after Free; on paths that differ, dangling."""
    found = set()

    def step(e: Effects, state: dict) -> None:
        place = (e.at[4], e.at[5])
        for name in e.reads:
            if name in state:
                found.add((*place, name, "use after free"))
        for name in e.tests:
            if state.get(name) == "dangling":
                found.add((*place, name, "use after free"))
        for name, how in e.frees:
            if name in state:
                found.add((*place, name, "double free"))
            state[name] = how
        for name in e.assigns:
            state.pop(name, None)

    def refine(name: str, not_nil: bool, state: dict) -> None:
        if not_nil and state.get(name) == "nil":
            del state[name]

    solved(r, {}, step, refine, lambda a, b: a | {k: v if a.get(k, v) == v else "dangling" for k, v in b.items()})
    return found


def use_after_free(files: DataFrame) -> DataFrame:
    """Findings of files (path, text): a freed variable is used, tested while it dangles, or freed again."""
    rows = lambda text: [("use-after-free", "error", line, column, f"{what}: {name}") for r in routines(text) for line, column, name, what in sorted(freed_findings(r))]
    return _mapped(files, FINDINGS, rows)


def nil_findings(r: Routine, kinds: frozenset[str]) -> set[tuple]:
    """Must-analysis: a variable is safe where every path has checked or assigned it."""
    tracked = {n.lower() for n, kind in r.variables if kind.lower() in kinds}
    found = set()

    def step(e: Effects, state: dict) -> None:
        for name, token in e.uses:
            if state.get(name) is False and (name, "dangling") not in e.frees:
                found.add((token[4], token[5], name))
        for name in e.raises_if_nil:
            if name in state:
                state[name] = True
        for name, _ in e.frees:
            if name in state:
                state[name] = False
        for name in e.assigns:
            if name in state:
                state[name] = name not in e.nils

    def refine(name: str, not_nil: bool, state: dict) -> None:
        if not_nil and name in state:
            state[name] = True

    solved(r, dict.fromkeys(sorted(tracked), False), step, refine, lambda a, b: {k: a.get(k, False) and b.get(k, False) if k in a else b[k] for k in a | b})
    return found


def unchecked_nil(files: DataFrame, nillable: tuple[str, ...] = ()) -> DataFrame:
    """Findings of files (path, text): a parameter or local of a nillable type is used before a check. Off unless asked for.

    Nillable are the classes and interfaces that the file declares, and the types named.
    """
    import re

    declares = re.compile(r"(\w+)\s*=\s*(?:class|interface)\b", re.I)

    def rows(text):
        kinds = frozenset(n.lower() for n in (*declares.findall(text), *nillable))
        return [("unchecked-nil", "warning", line, column, f"{name} may be nil") for r in routines(text) for line, column, name in sorted(nil_findings(r, kinds))]

    return _mapped(files, FINDINGS, rows)


def operations(files: DataFrame) -> DataFrame:
    """(path, routine, ord, receiver, op, guarded, in_handler, line, column): calls that begin, end or test a transaction, in order.

    guarded: below an `if`. in_handler: in an except or finally part.
    """

    def rows(text):
        out = []
        for r in routines(text):
            n, seen = 0, set()
            spans = handler_spans(r)
            guarded = guarded_tokens(r)
            for first in sorted({k for s in r.statements for _, x, y in s for k in range(x, y + 1)}):
                method = r.t[first][1].lower()
                if r.t[first][0] == "name" and method in TRANSACTION_METHODS and first >= 2 and r.t[first - 1][1] == "." and first not in seen:
                    seen.add(first)
                    out.append((r.name, n, r.t[first - 2][1].lower(), TRANSACTION_METHODS[method], first in guarded, any(a <= first <= z for a, z in spans), r.t[first - 2][4], r.t[first - 2][5]))
                    n += 1
        return out

    return _mapped(files, OPERATIONS, rows)


def handler_spans(r: Routine) -> list[tuple[int, int]]:
    """Token ranges of the except and finally parts of the routine."""
    used = [k for s in r.statements for _, x, y in s for k in (x, y)]
    if not used:
        return []
    spans, stack = [], []
    for k in range(min(used), min(len(r.t), r.at + 1)):
        w = r.t[k][1].lower()
        if w in ("begin", "case", "asm", "try") and r.t[k - 1][1] != ".":
            stack.append((w, k))
        elif w in ("except", "finally"):
            stack.append((w, k))
        elif w == "end" and stack:
            word, at = stack.pop()
            if word in ("except", "finally"):
                spans.append((at, k))
                if stack:
                    stack.pop()
    return spans


def guarded_tokens(r: Routine) -> set[int]:
    """Tokens of statements that stand in a branch of an `if`."""
    out: set[int] = set()
    branches = {b for a, b, kind in r.edges if kind in ("true", "false") and r.statements[a] and r.statements[a][-1][0] == "if"}
    joins = {b for b in range(len(r.kinds)) if sum(dst == b for _, dst, _ in r.edges) > 1}
    for start in branches - joins:
        work, seen = [start], set()
        while work:
            b = work.pop()
            if b in seen or b in joins or b == 1:
                continue
            seen.add(b)
            out |= {k for _, x, y in r.statements[b] for k in range(x, y + 1)}
            work += [dst for src, dst, kind in r.edges if src == b and kind != "exception"]
    return out


def transactions(ops: DataFrame) -> DataFrame:
    """Findings over operations: no rollback in a handler, ending a transaction one doesn't own, no commit, a nested start."""
    by = ["path", "routine", "receiver"]
    is_ = lambda op: F.col("op") == op
    told = ops.groupBy(*by).agg(
        F.count_if(is_("start")).alias("starts"),
        F.bool_and(F.when(is_("start"), F.col("guarded"))).alias("all_guarded"),
        F.coalesce(F.bool_or(is_("rollback") & F.col("in_handler")), F.lit(False)).alias("rolled"),
        F.coalesce(F.bool_or(is_("commit") & ~F.col("in_handler")), F.lit(False)).alias("committed"),
    )
    first = F.row_number().over(Window.partitionBy(*by, "op").orderBy("ord"))
    open_starts = F.row_number().over(Window.partitionBy(*by, "op", "guarded").orderBy("ord"))
    o = ops.withColumns({"nth": first, "nth_open": open_starts}).join(told, by)
    one = lambda test, rule, severity, message: F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.format_string(message, "receiver").alias("message")))
    hits = F.array_compact(F.array(
        one(is_("start") & ~F.col("rolled"), "transaction-no-rollback", "error", "%s is not rolled back in a handler"),
        one(F.col("op").isin("commit", "rollback") & ~F.col("guarded") & ((F.col("starts") == 0) | F.coalesce("all_guarded", F.lit(True))), "transaction-ownership-violation", "error", "%s is ended without being owned"),
        one(is_("start") & (F.col("nth") == 1) & ~F.col("committed"), "transaction-no-commit", "warning", "%s is never committed"),
        one(is_("start") & ~F.col("guarded") & (F.col("nth_open") > 1), "transaction-nested-start", "warning", "%s is started again"),
    ))
    return o.select("path", "line", "column", F.explode(hits).alias("h")).select("path", "h.rule", "h.severity", "line", "column", "h.message")
