"""Rules over Pascal nodes: each is a plan that gives findings (path, rule, severity, line, column, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import naming


def _found(rows: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
    return rows.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "line", "column", message.alias("message"))


def with_statement(n: DataFrame) -> DataFrame:
    return _found(n.where("kind = 'with'"), "with-statement", "warning", F.lit("with hides where names come from"))


def type_prefix(n: DataFrame) -> DataFrame:
    bad = n.where(F.col("kind").isin("class", "record") & ~F.col("name").rlike("^[TE]"))
    return _found(bad, "type-prefix", "hint", F.format_string("type %s should begin with T or E", "name"))


def interface_prefix(n: DataFrame) -> DataFrame:
    return _found(n.where((F.col("kind") == "interface") & ~F.col("name").rlike("^I")), "interface-prefix", "hint", F.format_string("interface %s should begin with I", "name"))


def constant_naming(n: DataFrame, style: str = "UPPER_CASE") -> DataFrame:
    good = F.col("name").rlike("^[A-Z0-9_]+$") if style == "UPPER_CASE" else F.col("name").rlike("^\\p{Lu}")
    better = naming.upper_snake(F.col("name")) if style == "UPPER_CASE" else naming.pascal(F.col("name"))
    return _found(n.where((F.col("kind") == "constant") & ~good), "constant-naming", "hint", F.format_string("constant %s should be %s", F.col("name"), better))


def local_variable_naming(n: DataFrame, style: str = "PascalCase") -> DataFrame:
    return _found(n.where((F.col("kind") == "local") & naming.breaks_style(F.col("name"), style)), "local-variable-naming", "hint", F.format_string(f"%s should be {style}", "name"))


def _handlers(n: DataFrame) -> DataFrame:
    """except nodes with what stands in them."""
    inside = n.where("parent_id IS NOT NULL").groupBy("path", F.col("parent_id").alias("node_id")).agg(F.bool_or(F.col("kind") == "on").alias("has_on"), F.bool_or(F.col("kind") != "on").alias("has_statement"), F.bool_or(F.col("kind") == "raise").alias("has_raise"))
    return n.where("kind = 'except'").join(inside, ["path", "node_id"], "left").fillna(False, ["has_on", "has_statement", "has_raise"])


def empty_except(n: DataFrame) -> DataFrame:
    return _found(_handlers(n).where("NOT has_on AND NOT has_statement"), "empty-except", "warning", F.lit("exceptions are swallowed"))


def bare_except(n: DataFrame) -> DataFrame:
    h = _handlers(n).where("NOT has_on AND has_statement AND NOT has_raise")
    spans = n.where("kind = 'raise'").select("path", F.col("line").alias("at"))
    raised = h.join(spans, "path").where("at BETWEEN line AND end_line").select("path", "node_id").distinct()
    return _found(h.join(raised, ["path", "node_id"], "left_anti"), "bare-except", "warning", F.lit("an except without on catches everything"))


def raise_in_destructor(n: DataFrame) -> DataFrame:
    """A raise of a destructor outside every try that has an except part."""
    raised = n.where("kind = 'raise' AND routine_kind = 'destructor'")
    guarded = n.where("kind = 'try'").join(n.where("kind = 'except'").select("path", F.col("parent_id").alias("node_id")), ["path", "node_id"], "left_semi")
    spans = guarded.select("path", "routine", F.col("line").alias("from_line"), F.col("end_line").alias("to_line"))
    inside = raised.join(spans, ["path", "routine"]).where("line BETWEEN from_line AND to_line").select("path", "node_id").distinct()
    return _found(raised.join(inside, ["path", "node_id"], "left_anti"), "raise-in-destructor", "warning", F.lit("a destructor should not raise"))


def _special(n: DataFrame) -> DataFrame:
    return n.where("kind = 'routine' AND routine_kind IN ('constructor', 'destructor')")


def inherited_missing(n: DataFrame) -> DataFrame:
    """Constructors and destructors that never call inherited, unless declared reintroduce."""
    calls = n.where("kind = 'inherited'").select("path", "routine").distinct()
    fresh = n.where("kind = 'method' AND detail LIKE '%reintroduce%'").select("path", "routine").distinct()
    own = _special(n).join(calls, ["path", "routine"], "left_anti").join(fresh, ["path", "routine"], "left_anti")
    return _found(own, "inherited-missing", "hint", F.format_string("%s does not call inherited", "routine"))


def inherited_order(n: DataFrame) -> DataFrame:
    """inherited should be the first statement of a constructor and the last of a destructor."""
    body = n.where("kind = 'begin'").join(n.where("kind = 'routine'").select("path", F.col("node_id").alias("parent_id")), ["path", "parent_id"], "left_semi").select("path", F.col("node_id").alias("parent_id"))
    inside = n.join(body, ["path", "parent_id"], "left_semi").where("routine_kind IN ('constructor', 'destructor')")
    ends = inside.groupBy("path", "routine").agg(F.max("ord").alias("last_ord"))
    call = n.where("kind = 'inherited'").join(_special(n).select("path", "routine"), ["path", "routine"], "left_semi")
    direct = inside.where("kind = 'inherited' AND detail = 'first'").join(ends, ["path", "routine"]).where("(routine_kind = 'constructor' AND ord = 1) OR (routine_kind = 'destructor' AND ord = last_ord)")
    bad = call.join(direct.select("path", "routine").distinct(), ["path", "routine"], "left_anti")
    return _found(bad, "inherited-order", "hint", F.lit("inherited comes first in constructors and last in destructors"))


def resource_leak_unprotected(n: DataFrame) -> DataFrame:
    """Statements between a creation and the try whose finally frees it, in one block: they may raise and leak."""
    created = n.where("kind = 'create'").select("path", "parent_id", F.col("ord").alias("c_ord"), F.lower("name").alias("var"))
    freed = n.where("kind = 'free'").select("path", F.lower("name").alias("var"), F.col("parent_id").alias("finally_id"))
    ends = n.where("kind = 'finally'").select("path", F.col("node_id").alias("finally_id"), F.col("parent_id").alias("try_id"))
    tries = n.where("kind = 'try'").select("path", F.col("node_id").alias("try_id"), "parent_id", F.col("ord").alias("t_ord"))
    guard = freed.join(ends, ["path", "finally_id"]).join(tries, ["path", "try_id"]).select("path", "parent_id", "var", "t_ord")
    pairs = created.join(guard, ["path", "parent_id", "var"]).where("t_ord > c_ord").groupBy("path", "parent_id", "var", "c_ord").agg(F.min("t_ord").alias("t_ord"))
    between = n.where("kind IN ('statement', 'assign', 'create')").join(pairs, ["path", "parent_id"]).where("ord > c_ord AND ord < t_ord AND detail = var")
    return _found(between, "resource-leak-unprotected", "error", F.format_string("%s is used before try protects it", "var"))


def field_not_freed(n: DataFrame) -> DataFrame:
    """Fields that a class creates in a constructor and that its destructors never free."""
    owner = lambda c: F.lower(F.substring_index(c, ".", 1))
    fields = n.where("kind = 'field'").join(n.where("kind = 'class'").select("path", F.col("node_id").alias("parent_id"), F.lower("name").alias("class")), ["path", "parent_id"])
    fields = fields.select("path", "class", F.lower("name").alias("field")).distinct()
    made = n.where("kind = 'create' AND routine_kind = 'constructor'").withColumns({"class": owner(F.col("routine")), "field": F.lower("name")}).join(fields, ["path", "class", "field"], "left_semi")
    freed = n.where("kind = 'free' AND routine_kind = 'destructor'").select("path", owner(F.col("routine")).alias("class"), F.lower("name").alias("field")).distinct()
    left = made.join(freed, ["path", "class", "field"], "left_anti").groupBy("path", "class", "field").agg(F.min(F.struct("line", "column")).alias("at"))
    left = left.select("path", "field", F.col("at.line").alias("line"), F.col("at.column").alias("column"))
    return _found(left, "field-not-freed", "warning", F.format_string("field %s is created but never freed", "field"))


RULES = [
    with_statement, type_prefix, interface_prefix, constant_naming, local_variable_naming, empty_except, bare_except, raise_in_destructor,
    inherited_missing, inherited_order, resource_leak_unprotected, field_not_freed,
]


def check(n: DataFrame) -> DataFrame:
    """Findings of all rules over nodes; write or cache nodes first, as each rule reads them."""
    out = RULES[0](n)
    for rule in RULES[1:]:
        out = out.unionByName(rule(n))
    return out


def suppressions(tokens: DataFrame, marker: str) -> DataFrame:
    """(path, line, rule) from comments `// marker:ignore [rule]` and `// marker:ignore-next-line [rule]`; no rule is null."""
    c = tokens.where("kind = 'comment'")
    get = lambda k: F.regexp_extract("text", rf"^//\s*{marker}:(ignore-next-line|ignore)\b(.*)$", k)
    return c.where(get(1) != "").select("path", (F.col("line") + F.when(get(1) == "ignore", 0).otherwise(1)).alias("line"), naming.rule_of_comment(get(2)).alias("rule"))


#: Rules on names, which program and package files are spared.
NAMING_RULES = ("type-prefix", "interface-prefix", "constant-naming", "local-variable-naming")


def lint(files: DataFrame, marker: str, overrides: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Findings of files (path, text) in the order of their places: (path, rule, severity, line, column, message, scope).

    One plan: nodes and tokens of each file, all rules, severities after overrides (rule, override; `off` drops), the routine around
    each finding, suppressions by comments, a baseline of digests (key). Nodes are written once, as every rule reads them.
    """
    from codefacts.operators.graph import materialize
    from codefacts.operators.intervals import innermost
    from codefacts.operators.relational import without_baseline
    from codefacts.sources import pascal

    n = materialize(pascal.nodes(files))
    found = check(n).where(~(F.col("path").rlike("(?i)\\.(dpr|dpk)$") & F.col("rule").isin(*NAMING_RULES)))
    if overrides is not None:
        found = found.join(F.broadcast(overrides.select("rule", "override")), "rule", "left").where(F.coalesce("override", F.lit("")) != "off").withColumn("severity", F.coalesce("override", "severity")).drop("override")
    scopes = n.where("kind = 'routine'").select("path", F.col("line").alias("start"), F.col("end_line").alias("end"), "name", "node_id")
    found = innermost(found, scopes, "path", "line", ["path", "rule", "line", "column", "message"], ordinal="node_id").withColumnRenamed("in_name", "scope")
    hush = suppressions(pascal.tokens(files), marker).groupBy("path", "line").agg(F.bool_or(F.col("rule").isNull()).alias("__all"), F.collect_set("rule").alias("__rules"))
    found = found.join(hush, ["path", "line"], "left").where(~(F.coalesce("__all", F.lit(False)) | F.coalesce(F.array_contains("__rules", F.col("rule")), F.lit(False))))
    if baseline is not None:
        found = without_baseline(found, baseline, F.sha2(F.concat_ws(":", "path", "rule", "message"), 256))
    return found.select("path", "rule", "severity", "line", "column", "message", "scope").orderBy("path", "line", "column", "rule")
