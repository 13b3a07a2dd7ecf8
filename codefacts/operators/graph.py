"""Graph operators over edge tables: components, closure, shortest paths, dominators, fix-points.

Loops run on the driver but hold no rows there: each round is a DataFrame plan whose result is written to the shared
checkpoint folder, and only a count or a checksum comes back.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset, as in local tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='codefacts-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._round_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete a round's table once no plan reads it."""
    path = getattr(df, "_round_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _print_of(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches, itself included.

    Alternating large-star and small-star rounds; a round moves each node at most to one smaller neighbour, so a hub
    costs rows in proportion to its degree. Self-loops and null ends are left out; an empty table gives no rows.
    """
    a, b = F.greatest(src, dst), F.least(src, dst)
    pairs = materialize(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(a.alias("u"), b.alias("v")).distinct())
    before = _print_of(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, pairs = pairs, materialize(small)
        forget(old)
        after = _print_of(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, hops): every node each start reaches, itself included, with the fewest edges. starts (start).

    Semi-naive: a round joins only the pairs found in the one before, and pairs already known are dropped by an anti join.
    """
    e = edges.select("src", "dst")  # a round drops what repeats; a distinct here would shuffle all edges each round
    known = materialize(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct())
    front = known
    for hop in count(1):
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = materialize(step.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        if hop % 10 == 0:
            known = materialize(known)
    raise AssertionError


def must_pass(edges: DataFrame, entry, exit_) -> DataFrame:
    """(node): nodes other than the entry without which the exit can't be reached from the entry.

    All of them lie on any one path, so a shortest one is taken. A node of it can be gone round when some way off the path
    leaves before it and comes back after it; every node off the path keeps only the first step it can be reached from, so
    the rows grow with the nodes and edges that the entry reaches, not with pairs of nodes.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    kind = edges.schema["src"].dataType.simpleString()
    if entry == exit_:
        return edges.sparkSession.createDataFrame([], f"node {kind}")
    start = edges.sparkSession.createDataFrame([(entry,)], f"start {kind}")
    inside = reachable(edges, start).select(F.col("node").alias("src"))
    e = materialize(edges.join(inside, "src", "left_semi").where("src <> dst").distinct())
    path = path_avoiding(e, entry, exit_)
    off = materialize(e.join(path.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    known = front = materialize(path.select("node", F.col("step").alias("first")))
    while not front.isEmpty():
        step = front.join(off, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("first").alias("first")).withColumnRenamed("dst", "node")
        best = known.withColumnRenamed("first", "__old")
        front = materialize(step.join(best, "node", "left").where("__old IS NULL OR first < __old").select("node", "first"))
        old, known = known, materialize(known.unionByName(front).groupBy("node").agg(F.min("first").alias("first")))
        forget(old)
    # The first step from which a way off the path leads to each step; a later step reached from before a node goes round it.
    back = known.join(e, F.col("node") == F.col("src")).select("dst", "first").join(path.withColumnRenamed("node", "dst"), "dst").groupBy("step").agg(F.min("first").alias("first"))
    later = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    told = path.join(back, "step", "left").withColumn("__round", F.coalesce(F.min("first").over(later) < F.col("step"), F.lit(False)))
    return told.where("step > 0 AND NOT __round").select("node")


def dominators(edges: DataFrame, entry) -> DataFrame:
    """(node, dominator): strict dominators of every node that the entry reaches.

    A node's dominators are itself and what all its predecessors share; sets only shrink, so rounds end. One row a node.
    """
    start = edges.sparkSession.createDataFrame([(entry,)], edges.select(F.col("src").alias("start")).schema)
    inside = materialize(reachable(edges, start).select("node"))
    e = materialize(edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").where((F.col("src") != F.col("dst")) & (F.col("dst") != F.lit(entry))).select("src", "dst").distinct())
    root = inside.where(F.col("node") == F.lit(entry)).select("node", F.array("node").alias("doms"))
    states = materialize(root)
    while True:
        sent = e.join(states, F.col("src") == F.col("node")).groupBy("dst").agg(F.collect_list("doms").alias("sets"))
        shared = F.aggregate(F.slice("sets", 2, F.size("sets")), F.element_at("sets", 1), lambda a, b: F.array_intersect(a, b))
        new = materialize(root.unionByName(sent.select(F.col("dst").alias("node"), F.array_sort(F.array_union(shared, F.array("dst"))).alias("doms"))))
        same = new.exceptAll(states).isEmpty() and states.exceptAll(new).isEmpty()
        states = new
        if same:
            return states.select("node", F.explode("doms").alias("dominator")).where("node <> dominator")


def spread(edges: DataFrame, seeds: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(node): seeds and the nodes with an edge to one found before, for at most max_rounds rounds (callers of factories)."""
    known = materialize(seeds.select("node").distinct())
    front = known
    for _ in range(max_rounds):
        step = edges.join(front, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")).distinct()
        front = materialize(step.join(known, "node", "left_anti"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def lattice_states(edges: DataFrame, effects: DataFrame, entry, join: str = "may") -> DataFrame:
    """(block, name, state): forward data-flow to a fixed point. effects (block, name, sets): 1 sets the fact, 0 clears it.

    `may` joins by maximum (any path), `must` by minimum over the predecessors reached (all paths). States are those
    at a block's start.
    """
    names = effects.select("name").distinct()
    e = materialize(edges.select("src", "dst").distinct())
    start = materialize(names.select(F.lit(entry).alias("block"), "name", F.lit(0).alias("state")))
    states = start
    pick = F.max if join == "may" else F.min
    while True:
        out = states.join(effects, ["block", "name"], "left").select("block", "name", F.coalesce("sets", "state").alias("state"))
        sent = out.join(e, F.col("block") == F.col("src")).select(F.col("dst").alias("block"), "name", "state")
        new = materialize(sent.unionByName(start).groupBy("block", "name").agg(pick("state").alias("state")))
        same = new.exceptAll(states).isEmpty() and states.exceptAll(new).isEmpty()
        states = new
        if same:
            return states


def path_avoiding(edges: DataFrame, from_, to, avoid: DataFrame | None = None, not_leaving: tuple[str, ...] = ()) -> DataFrame:
    """(step, node): a shortest path from `from_` to `to` round the nodes of avoid (node); no rows if there is none. Equal ends ask
    for a cycle. Edges of the kinds not_leaving (edges have `kind`) aren't taken from the first node.

    Breadth first, level by level: each node found keeps the smallest node it was found from, and the path is read back along
    these, one look-up a step. Ends in avoid don't count as avoided.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    first = edges.where(F.col("src") == F.lit(from_))
    if not_leaving:
        first = first.where(~F.col("kind").isin(*not_leaving))
    e = edges.select("src", "dst").distinct()
    if avoid is not None:
        keep = avoid.where((F.col("node") != F.lit(from_)) & (F.col("node") != F.lit(to))).select("node").distinct()
        e = e.join(keep.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = first.join(keep.select(F.col("node").alias("dst")), "dst", "left_anti")
    e = materialize(e)
    found = materialize(first.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("back"), F.lit(1).alias("hop")))
    front = found
    for hop in count(2):
        if front.isEmpty() or not found.where(F.col("node") == F.lit(to)).isEmpty():
            break
        step = front.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("src").alias("back"))
        front = materialize(step.select(F.col("dst").alias("node"), "back", F.lit(hop).alias("hop")).join(found, "node", "left_anti"))
        found = materialize(found.unionByName(front))
    path, at = [], found.where(F.col("node") == F.lit(to)).select("back", "hop").first()
    if at is not None:
        path = [(at["hop"], to)]
        while at["hop"] > 1:
            path.append((at["hop"] - 1, at["back"]))
            at = found.where((F.col("node") == F.lit(at["back"])) & (F.col("hop") == at["hop"] - 1)).select("back", "hop").first()
        path.append((0, from_))
    return spark.createDataFrame(sorted(path), f"step int, node {kind}")


def must_pass_any(edges: DataFrame, entry, exit_, nodes: DataFrame) -> bool:
    """Whether every path from the entry to the exit meets one of nodes (node). Without any path, or with an end in nodes, it does."""
    hit = nodes.where((F.col("node") == F.lit(entry)) | (F.col("node") == F.lit(exit_)))
    if not hit.isEmpty():
        return True
    free = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")
    start = edges.sparkSession.createDataFrame([(entry,)], edges.select(F.col("src").alias("start")).schema)
    return reachable(free.select("src", "dst"), start).where(F.col("node") == F.lit(exit_)).isEmpty()


def blocks_between(edges: DataFrame, from_, to) -> DataFrame:
    """(node): what lies on some path: reached from `from_`, and reaching `to`."""
    one = lambda x: edges.sparkSession.createDataFrame([(x,)], edges.select(F.col("src").alias("start")).schema)
    ahead = reachable(edges, one(from_)).select("node")
    back = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), one(to)).select("node")
    return ahead.join(back, "node", "left_semi")


def uses_closure(imports: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, uses, known): all units that a unit reaches over imports (unit, uses), itself left out, and whether the closure is known:
    it isn't if any member has no source in units (unit)."""
    e = imports.select(F.col("unit").alias("src"), F.col("uses").alias("dst"))
    reach = reachable(e, units.select(F.col("unit").alias("start"))).where("hops > 0 AND node <> start")
    there = units.select(F.col("unit").alias("node"), F.lit(True).alias("there"))
    told = reach.join(there, "node", "left").groupBy("start").agg(F.array_sort(F.collect_list("node")).alias("uses"), F.bool_and(F.coalesce("there", F.lit(False))).alias("known"))
    return units.join(told, units["unit"] == told["start"], "left").select("unit", F.when(F.coalesce("known", F.lit(True)), F.coalesce("uses", F.array().cast("array<string>"))).alias("uses"), F.coalesce("known", F.lit(True)).alias("known"))


def bottom_up(calls: DataFrame, own: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(proc, can): a fact that a routine has itself (own) or by calling one that has it. calls (caller, callee), own (proc, can).

    Callers take over their callees' facts round by round: without cycles, after as many rounds as calls are deep; with them,
    at most max_rounds.
    """
    e = calls.select("caller", "callee").distinct()
    facts = materialize(own.select("proc", F.col("can").cast("boolean").alias("can")))
    for _ in range(max_rounds):
        taken = e.join(facts.where("can"), F.col("callee") == F.col("proc"), "left_semi").select(F.col("caller").alias("proc")).distinct().withColumn("__by", F.lit(True))
        new = materialize(facts.join(taken, "proc", "left").select("proc", (F.col("can") | F.coalesce("__by", F.lit(False))).alias("can")))
        if new.exceptAll(facts).isEmpty():
            break
        facts = new
    return facts


def definite_assignment(blocks: DataFrame, edges: DataFrame, entry) -> DataFrame:
    """(block, assigned): whether a variable is assigned on every way to a block's start. blocks (block, assigns), edges (src, dst, kind).

    All blocks but the entry begin as assigned, and states only fall. An exceptional edge carries what held at the start of its
    block, any other what holds at its end.
    """
    e = materialize(edges.select("src", "dst", (F.col("kind") == "exception").alias("__thrown")).distinct())
    b = blocks.select("block", F.col("assigns").cast("boolean").alias("assigns"))
    states = materialize(b.select("block", "assigns", (F.col("block") != F.lit(entry)).alias("state")))
    while True:
        sent = e.join(states, F.col("src") == F.col("block")).select(F.col("dst").alias("block"), F.when(F.col("__thrown"), F.col("state")).otherwise(F.col("state") | F.col("assigns")).alias("__in"))
        met = sent.groupBy("block").agg(F.bool_and("__in").alias("__in"))
        new = materialize(states.join(met, "block", "left").select("block", "assigns", F.when(F.col("block") == F.lit(entry), F.lit(False)).otherwise(F.coalesce("__in", F.lit(True))).alias("state")))
        if new.exceptAll(states).isEmpty():
            return new.select("block", F.col("state").alias("assigned"))
        states = new


def ancestry(types: DataFrame, max_levels: int = 20) -> DataFrame:
    """(name, ancestor, level): all ancestors of each type (name, parent), in lower case, up to max_levels; a cycle ends where it closes."""
    t = types.select(F.lower("name").alias("name"), F.lower("parent").alias("parent")).distinct()
    up = materialize(t.where("parent IS NOT NULL").select("name", F.col("parent").alias("ancestor"), F.lit(1).alias("level")))
    all_, front = up, up
    for level in range(2, max_levels + 1):
        step = front.join(t.select(F.col("name").alias("ancestor"), F.col("parent").alias("__up")), "ancestor").where("__up IS NOT NULL AND __up <> name")
        front = materialize(step.select("name", F.col("__up").alias("ancestor"), F.lit(level).alias("level")).join(all_, ["name", "ancestor"], "left_anti"))
        if front.isEmpty():
            break
        all_ = all_.unionByName(front)
    return all_


def descends(pairs: DataFrame, types: DataFrame, max_levels: int = 20) -> DataFrame:
    """pairs (name, base) with `descends`: true if base is the type or an ancestor; null if a chain leaves the known types; else false."""
    up = ancestry(types, max_levels)
    known = types.select(F.lower("name").alias("name")).distinct()
    open_ = up.join(known.select(F.col("name").alias("ancestor")), "ancestor", "left_anti").select("name").distinct().withColumn("__open", F.lit(True))
    hit = up.select(F.col("name").alias("__n"), F.col("ancestor").alias("__b")).distinct().withColumn("__hit", F.lit(True))
    p = pairs.withColumns({"__n": F.lower("name"), "__b": F.lower("base")})
    p = p.join(hit, ["__n", "__b"], "left").join(open_.withColumnRenamed("name", "__n"), "__n", "left").join(known.select(F.col("name").alias("__n"), F.lit(True).alias("__known")), "__n", "left")
    told = F.when((F.col("__n") == F.col("__b")) | F.col("__hit"), F.lit(True)).when(F.col("__known").isNull() | F.col("__open"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return p.select(*pairs.columns, told.alias("descends"))
