"""Symbols, references and hierarchies over tables of declarations, occurrences, calls and types.

declarations (path, id, parent, name, kind, start, end, ord), occurrences (path, name, start, end, line), calls (caller, callee, start, end),
types (name, parent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL_KINDS = ("unit", "type", "routine", "method", "field", "property", "variable", "constant")


def eligible(d: DataFrame) -> DataFrame:
    """Declarations that are symbols; variables and constants only at the root."""
    return d.where(F.col("kind").isin(*SYMBOL_KINDS) & (~F.col("kind").isin("variable", "constant") | F.col("parent").isNull()))


def workspace_symbols(d: DataFrame, query: str, limit: int = 10_000) -> DataFrame:
    """(path, name, kind, container, start, end): symbols whose name holds the query, letter case aside, each place once, in document order.

    More than `limit` is an error, not a cut list.
    """
    hits = eligible(d).where(F.lower("name").contains(query.lower()))
    first = F.row_number().over(Window.partitionBy("path", "start", "end").orderBy("ord"))
    hits = hits.withColumn("__nth", first).where("__nth = 1")
    if hits.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} symbols")
    owner = d.select("path", F.col("id").alias("parent"), F.col("name").alias("__owner"))
    unit = d.where("kind = 'unit'").groupBy("path").agg(F.min_by("name", "ord").alias("__unit"))
    told = hits.join(owner, ["path", "parent"], "left").join(unit, "path", "left")
    container = F.coalesce("__owner", F.when(F.col("kind") != "unit", F.col("__unit")))
    return told.select("path", "name", "kind", container.alias("container"), "start", "end").orderBy("path", "start", F.desc("end"))


def document_symbols(d: DataFrame, path: str, depth: int = 32) -> DataFrame:
    """(level, outline, name, kind, start, end) of one file: the tree of symbols, each below its parent, in document order."""
    own = eligible(d.where(F.col("path") == path)).select("id", "parent", "name", "kind", "start", "end", "ord")
    place = lambda: F.lpad(F.col("start").cast("string"), 10, "0")
    level = own.where("parent IS NULL").select("id", F.lit(0).alias("level"), place().alias("outline"), "name", "kind", "start", "end")
    out = level
    for k in range(1, depth + 1):
        up = level.select(F.col("id").alias("parent"), F.col("outline").alias("__above"))
        level = own.join(up, "parent").select("id", F.lit(k).alias("level"), F.concat_ws(".", "__above", place()).alias("outline"), "name", "kind", "start", "end")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("level", "outline", "name", "kind", "start", "end").orderBy("outline")


def references(occurrences: DataFrame, bindings: DataFrame, symbol, withheld: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """(path, start, end): proven occurrences of a symbol: those whose binding (path, start, symbol) is it, without withheld files
    (path); in one file, if path is given (highlights)."""
    own = bindings.where(F.col("symbol") == F.lit(symbol)).select("path", "start")
    found = occurrences.join(own, ["path", "start"]).select("path", "start", "end").distinct()
    if withheld is not None:
        found = found.join(withheld.select("path").distinct(), "path", "left_anti")
    return found.where(F.col("path") == path) if path else found


def absent(docs: DataFrame, needles: list[str], text: str = "text") -> Column:
    """Whether none of the needles is a whole identifier of a text, letter case aside."""
    tokens = F.transform(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda t: F.lower(t))
    return ~F.arrays_overlap(tokens, F.array(*[F.lit(n.lower()) for n in needles]))


def incoming_calls(calls: DataFrame, routine) -> DataFrame:
    """(caller, n, ranges): who calls a routine, with the places of the calls in order, each once."""
    place = F.struct("start", "end")
    return calls.where(F.lower("callee") == str(routine).lower()).groupBy("caller").agg(F.countDistinct(place).alias("n"), F.array_sort(F.collect_set(place)).alias("ranges"))


def outgoing_calls(calls: DataFrame, routine) -> DataFrame:
    place = F.struct("start", "end")
    return calls.where(F.lower("caller") == str(routine).lower()).groupBy("callee").agg(F.countDistinct(place).alias("n"), F.array_sort(F.collect_set(place)).alias("ranges"))


def callees(calls: DataFrame, routine) -> DataFrame:
    """(callee): a row for each call, repeated calls too."""
    return calls.where(F.col("caller") == F.lit(routine)).select("callee")


def callers(calls: DataFrame, routine) -> DataFrame:
    return calls.where(F.col("callee") == F.lit(routine)).select("caller")


def enclosing_caller(points: DataFrame, routines: DataFrame, identity: list[str]) -> DataFrame:
    """points (path, at) with the name of the smallest routine (path, name, start, end) that holds them; of equal sizes the later one."""
    hit = points.join(routines, "path").where("start <= at AND at < end")
    best = hit.groupBy(*identity).agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), -F.col("start"), F.col("name"))).alias("routine"))
    return points.join(best, identity, "left")


def innermost_blocks(points: DataFrame, statements: DataFrame, identity: list[str]) -> DataFrame:
    """identity and block: every block of the shortest statements (path, block, start, end) that hold a point; copies of a statement give several."""
    hit = points.join(statements, "path").where("start <= at AND at < end")
    rank = F.rank().over(Window.partitionBy(*identity).orderBy(F.col("end") - F.col("start")))
    return hit.withColumn("__rank", rank).where("__rank = 1").select(*identity, "block").distinct()


def supertypes(types: DataFrame, name: str) -> DataFrame:
    """(name): the direct ancestor of a type."""
    return types.where((F.lower("name") == name.lower()) & F.col("parent").isNotNull()).select(F.col("parent").alias("name")).distinct()


def subtypes(types: DataFrame, name: str) -> DataFrame:
    return types.where((F.lower("parent") == name.lower()) & (F.lower("name") != name.lower())).select("name").distinct()


def ranked_overloads(routines: DataFrame) -> DataFrame:
    """routines (name, is_definition, section, start) with `rank`: declarations before definitions, interface before implementation before
    the rest, then by place."""
    section = F.when(F.col("section") == "interface", 0).when(F.col("section") == "implementation", 1).otherwise(2)
    return routines.withColumn("rank", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.col("is_definition").cast("int"), section, "start")))


def folding_ranges(ranges: DataFrame, n: int) -> DataFrame:
    """(path, start_line, end_line, kind): folds (path, start_line, end_line, kind, preference), one for each first line (the preferred,
    then the longer), clipped to the fold around them, and of each file the n longest."""
    one = F.row_number().over(Window.partitionBy("path", "start_line").orderBy("preference", F.desc("end_line"), "kind"))
    once = ranges.where("end_line > start_line").withColumn("__nth", one).where("__nth = 1").drop("__nth")
    outer = once.select("path", F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    around = once.join(outer, "path").where("__s < start_line AND start_line <= __e").groupBy("path", "start_line").agg(F.min("__e").alias("__bound"))
    clipped = once.join(around, ["path", "start_line"], "left").withColumn("end_line", F.least("end_line", F.coalesce("__bound", "end_line"))).where("end_line > start_line")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.col("end_line") - F.col("start_line")), "start_line"))
    return clipped.withColumn("__nth", rank).where(F.col("__nth") <= n).select("path", "start_line", "end_line", "kind")


# ---- checks that a compiler makes too


def duplicates(d: DataFrame, scope: list[str]) -> DataFrame:
    """The second and further declarations of one name in a scope."""
    nth = F.row_number().over(Window.partitionBy(*scope, F.lower("name")).orderBy("start"))
    return d.withColumn("__nth", nth).where("__nth > 1").drop("__nth")


def without_definition(declared: DataFrame, defined: DataFrame, key: list[str]) -> DataFrame:
    """Declarations that no definition answers."""
    return declared.join(defined.select(*key).distinct(), key, "left_anti")


def differing_definitions(declared: DataFrame, defined: DataFrame, key: list[str], signature: str) -> DataFrame:
    """Declarations whose name has definitions, none with the same signature."""
    named = declared.join(defined.select(*key).distinct(), key, "left_semi")
    return named.join(defined.select(*key, signature).distinct(), [*key, signature], "left_anti")


def never_referenced(members: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Private members (path, name, start) with no occurrence but their own in their file."""
    used = occurrences.select("path", F.lower("name").alias("__low"), F.col("start").alias("__at"))
    m = members.withColumn("__low", F.lower("name"))
    hit = m.join(used, ["path", "__low"]).where("__at <> start").select("path", "name", "start").distinct()
    return members.join(hit, ["path", "name", "start"], "left_anti")


def hidden_members(members: DataFrame, types: DataFrame) -> DataFrame:
    """(type_name, member, base, code): members (type_name, member, is_virtual, overrides) that hide one of an ancestor: W1010 if that is virtual
    and the member doesn't override it, else W1009."""
    from .graph import ancestry

    up = ancestry(types)
    low = members.select(F.lower("type_name").alias("name"), F.lower("member").alias("__m"), "type_name", "member", "overrides")
    base = members.select(F.lower("type_name").alias("ancestor"), F.lower("member").alias("__m"), F.col("type_name").alias("base"), F.col("is_virtual").alias("__virtual"))
    hit = low.join(up, "name").join(base, ["ancestor", "__m"]).where("NOT overrides")
    near = F.row_number().over(Window.partitionBy("name", "__m").orderBy("level"))
    return hit.withColumn("__nth", near).where("__nth = 1").select("type_name", "member", "base", F.when(F.col("__virtual"), "W1010").otherwise("W1009").alias("code"))


def marked_uses(uses: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, line, name, code): uses (path, line, name) of symbols with a hint directive (name, directive): deprecated, library, platform, experimental."""
    codes = {"deprecated": "W1000", "library": "W1001", "platform": "W1002", "experimental": "W1003"}
    code = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("directive"))
    m = marks.select(F.lower("name").alias("__low"), code.alias("code"))
    return uses.withColumn("__low", F.lower("name")).join(m, "__low").select("path", "line", "name", "code")


def switched(findings: DataFrame, switches: DataFrame) -> DataFrame:
    """findings (path, at, code, severity) after the positional switches (path, at, code, state): off drops, error promotes, by the last before."""
    from .intervals import state_as_of

    keyed = lambda df: df.withColumn("__key", F.concat_ws(":", "path", "code"))
    told = state_as_of(keyed(findings), keyed(switches).select("__key", "at", "state"), "__key", "at", "state", F.lit("on"), ["path", "code", "severity"])
    return told.where("state <> 'off'").select("path", "at", "code", F.when(F.col("state") == "error", F.lit("error")).otherwise(F.col("severity")).alias("severity"))


def unused_imports(imports: DataFrame, occurrences: DataFrame, exported: DataFrame, effects: DataFrame) -> DataFrame:
    """(path, unit): imports (path, unit) none of whose exported names (unit, name) occur in the file, and whose unit has no side effects (unit)."""
    used = occurrences.select("path", F.lower("name").alias("__low")).join(exported.select("unit", F.lower("name").alias("__low")), "__low").select("path", "unit").distinct()
    return imports.join(used, ["path", "unit"], "left_anti").join(effects.select("unit"), "unit", "left_anti").select("path", "unit")
