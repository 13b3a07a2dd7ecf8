"""Tokens, nodes and rules of Pascal source."""

import pytest

from codefacts.operators import relational, rules
from codefacts.sources import pascal

UNIT = """unit Demo;
interface
type
  TThing = class(TObject)
    FList: TStringList;
    FSafe: TStringList;
    constructor Create;
    destructor Destroy; override;
  end;
  Point2 = record
    A: Integer;
  end;
  Walker = interface
    procedure Go;
  end;
const
  MaxLen = 5;
  GOOD_ONE = 'it''s // not a comment';
implementation
constructor TThing.Create;
begin
  FList := TStringList.Create;
  FSafe := TStringList.Create;
  inherited Create;
end;
destructor TThing.Destroy;
begin
  FreeAndNil(FSafe);
  raise Exception.Create('x');
end;
procedure Work(const aName: string);
var
  list: TStringList;
  i: Integer;
begin
  list := TStringList.Create;
  list.Add('x');
  try
    with list do
      Clear; // check:ignore
  finally
    list.Free;
  end;
  try
    Work('a');
  except
  end;
  try
    Work('b');
  except
    i := 0;
  end;
end;
end.
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("demo.pas", UNIT), ("empty.pas", ""), ("null.pas", None), ("cut.pas", "procedure X; begin try")], "path string, text string")


def test_tokens(files):
    t = pascal.tokens(files).where("path = 'demo.pas'").collect()
    assert "".join(UNIT.split()) == "".join("".join(r["text"] for r in t).split())
    assert all(UNIT[r["start"] : r["end"]] == r["text"] and UNIT[: r["start"]].count("\n") + 1 == r["line"] for r in t)
    assert [r["text"] for r in t if r["kind"] == "string"][0] == "'it''s // not a comment'"


def test_rules(files):
    n = pascal.nodes(files).cache()
    found = rules.check(n).where("path = 'demo.pas'")
    lines = {}
    for r in found.collect():
        lines.setdefault(r["rule"], []).append(r["line"])
    line = lambda text: UNIT[: UNIT.index(text)].count("\n") + 1
    assert lines["type-prefix"] == [line("Point2")]
    assert lines["interface-prefix"] == [line("Walker")]
    assert lines["constant-naming"] == [line("MaxLen")]
    assert sorted(lines["local-variable-naming"]) == [line("aName"), line("  list: T")]
    assert lines["field-not-freed"] == [line("FList := ")]
    assert lines["inherited-order"] == [line("inherited Create")]
    assert lines["inherited-missing"] == [line("destructor TThing.Destroy;")]
    assert lines["raise-in-destructor"] == [line("  raise")]
    assert lines["with-statement"] == [line("    with")]
    assert lines["resource-leak-unprotected"] == [line("list.Add")]
    assert len(lines["empty-except"]) == 1 and len(lines["bare-except"]) == 1


def test_suppressions(files):
    s = rules.suppressions(pascal.tokens(files), "check")
    assert [tuple(r) for r in s.collect()] == [("demo.pas", UNIT[: UNIT.index("// check")].count("\n") + 1, None)]
    found = rules.with_statement(pascal.nodes(files))
    assert relational.without_suppressed(found, s.selectExpr("path", "line - 1 AS line", "rule").select("line", "rule"), "line").count() == 0
