"""Control-flow graphs, flow rules and conditional expressions on plain values."""

import pytest

from codefacts.operators.flow import freed_findings, guard_of, nil_findings
from codefacts.sources.cfg import routines
from codefacts.sources.conditional import Environment, evaluate, spans_of


def paths(r, limit=200):
    """Statement texts along all paths from entry to exit that take no edge twice."""
    out, work = set(), [(0, (), ())]
    while work and len(out) < limit:
        block, said, used = work.pop()
        said = (*said, *(r.t[x][1] for _, x, _ in r.statements[block]))
        if block == 1:
            out.add(" ".join(said))
        work += [(dst, said, (*used, (src, dst, kind))) for src, dst, kind in r.edges if src == block and (src, dst, kind) not in used]
    return out


@pytest.mark.parametrize(
    "body, want",
    [
        ("a; b", {"a b"}),
        ("if c then a else b; d", {"if a d", "if b d"}),
        ("if c then a; d", {"if a d", "if d"}),
        ("case c of 1: a; 2, 3: b; else d end; e", {"case a e", "case b e", "case d e"}),
        ("try a; finally f end; b", {"a f b", "a f"}),
        ("try exit; finally f end; b", {"exit f"}),
        ("try raise; except on E do h; end; b", {"raise on h b", "raise"}),
        ("try a; except h; end; b", {"a b", "a h b"}),
        ("while c do begin if d then break; a end; b", {"while b", "while if break b", "while if a while b"}),
        ("repeat a until c; b", {"a until b", "a until a until b"}),
        ("with x do a; goto l", {"with a goto"}),
        ("", {""}),
    ],
)
def test_paths(body, want):
    got = paths(routines(f"procedure T; begin {body} end;")[0])
    assert {p for p in got if p.count("until") < 2} == {p for p in want if p.count("until") < 2}, got


def test_every_block_of_a_routine_ends():
    """Broken sources end, nested routines have graphs of their own, and edges stay inside."""
    for text in ("procedure T; begin try a", "procedure T; begin if", "procedure A; procedure B; begin x end; begin y end;", "begin end.", "procedure T; begin case x of 1: end", "procedure T; begin try finally", "procedure T; begin repeat until"):
        for r in routines(text):
            assert all(0 <= a < len(r.kinds) and 0 <= b < len(r.kinds) for a, b, _ in r.edges)
    assert [r.name for r in routines("procedure A; procedure B; begin x end; begin y end;")] == ["B", "A"]


def test_freed_on_some_paths():
    found = lambda body: sorted((x[2], x[3]) for r in routines(f"procedure T(L: TList);\nbegin {body} end;") for x in freed_findings(r))
    assert found("L.Free; L := nil; L.Add(1)") == []
    assert found("if c then L.Free; L.Add(1)") == [("l", "use after free")]
    assert found("L.Free; L.Free") == [("l", "double free")]
    assert found("FreeAndNil(L); if L <> nil then L.Add(1)") == []
    assert found("L.Free; if Assigned(L) then x") == [("l", "use after free")]
    assert found("while c do begin L.Add(1); L.Free end") == [("l", "double free"), ("l", "use after free")] or found("while c do begin L.Add(1); L.Free end") == [("l", "use after free")]
    assert found("X.L := 1; s := 'L'; L.Free") == []


def test_unchecked_on_some_paths():
    found = lambda body: sorted({x[2] for r in routines(f"procedure T(P: TThing; N: Integer); var Q: TThing; begin {body} end;") for x in nil_findings(r, frozenset({"tthing"}))})
    assert found("P.Go") == ["p"] and found("N.Go") == []
    assert found("if P <> nil then P.Go") == [] and found("if P = nil then exit; P.Go") == [] and found("if not Assigned(P) then exit; P.Go") == []
    assert found("if c then P := Make; P.Go") == ["p"] and found("P := Make; P.Go; P.Free; P.Go") == ["p"]
    assert found("RaiseIfNil(P); P.Go") == [] and found("Q := nil; Q.Go") == ["q"] and found("P.Free") == []


def test_guards():
    words = lambda s: s.lower().split()
    assert guard_of(words("Assigned ( X )")) == ("x", True) and guard_of(words("not Assigned ( X )")) == ("x", False)
    assert guard_of(words("X = nil")) == ("x", False) and guard_of(words("nil <> X")) == ("x", True) and guard_of(words("( X <> nil )")) == ("x", True)
    assert guard_of(words("X = nil or Y")) is None and guard_of([]) is None


def test_expressions():
    env = Environment({"a"}, {"n": ("number", 5)})
    for text, want in (("N shl 62", ("number", 1 << 62)), ("1 shr 64", ("error", None)), ("not true", ("truth", False)), ("true or Foo", ("unknown", None)), ("defined(x.y)", ("unknown", None)), ("", ("error", None)), ("1 2", ("error", None)), ("'a''b' = 'a''b'", ("truth", True)), ("$FF and 15", ("number", 15)), ("-9223372036854775807 - 2", ("error", None)), ("ord('A') + 1", ("number", 66)), ("true < false", ("error", None))):
        assert evaluate(text, env) == want, text
    assert evaluate("defined(zz)", Environment(closed=False)) == ("truth", None)


def test_spans():
    env = Environment({"a"})
    assert spans_of("", env) == [] and spans_of("{$ENDIF}{$ELSE}", env) == []
    assert spans_of("{$IFDEF A}{$IFDEF B}\n{$ELSE}\n{$ENDIF}{$ENDIF}", env) == [("ifdef", 1, 2, "inactive"), ("ifdef", 1, 3, "active"), ("else", 2, 3, "active")]
    assert spans_of("{$IF foo}\n{$DEFINE Q}{$ENDIF}{$IFDEF Q}\n{$ENDIF}", env)[1] == ("ifdef", 2, 3, "unknown")
    assert spans_of("s := '{$IFDEF A}'; // {$IFDEF A}", env) == []
