"""Queries over the fact store's tables: members and their records, importers, fact rows, observations, retention.

Pages are by key: each takes what follows a cursor and one row more, which says whether there is a next page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paging import page_after

LIVE = 1


def member_records(members: DataFrame, records: DataFrame, columns: list[str], source_key=None) -> DataFrame:
    """Members (source_key, record_id) with columns of their live record; of one source key, if it is given."""
    m = members if source_key is None else members.where(F.col("source_key") == F.lit(source_key))
    return m.join(records.where(F.col("lifecycle") == LIVE).select("record_id", *columns), "record_id").select("source_key", "record_id", *columns)


def importers(members: DataFrame, targets: DataFrame, target, after: tuple | None = None, n: int = 256) -> DataFrame:
    """(phase, source_key): members whose record names the target (phase 1), then those whose imports have no bound (phase 2,
    dependency 3), in pages of n. A member of phase 1 isn't repeated."""
    named = targets.where((F.col("target_key") == F.lit(target)) & F.col("dependency").isin(1, 2)).select("record_id", F.lit(1).alias("phase"))
    loose = targets.where(F.col("dependency") == 3).select("record_id", F.lit(2).alias("phase"))
    best = named.unionByName(loose).groupBy("record_id").agg(F.min("phase").alias("phase"))
    found = members.join(best, "record_id").groupBy("source_key").agg(F.min("phase").alias("phase")).select("phase", "source_key")
    return page_after(found, ["phase", "source_key"], after, n) if after else found.orderBy("phase", "source_key").limit(n)


def members_with_rows(members: DataFrame, records: DataFrame, rows: DataFrame, kinds: tuple[int, ...], key: Column) -> DataFrame:
    """(source_key): members whose artifact has a fact row of one of the kinds whose index key fits."""
    hits = rows.where(F.col("row_kind").isin(*kinds) & key).select("artifact_ref").distinct()
    live = records.where(F.col("lifecycle") == LIVE).join(hits, "artifact_ref", "left_semi").select("record_id")
    return members.join(live, "record_id", "left_semi").select("source_key").distinct()


def key_contains(key: str, query: str) -> Column:
    """Whether an index key holds the query, byte by byte; keys beyond ASCII can't be compared and are kept."""
    k = F.col(key)
    return (F.instr(k, query) > 0) | (F.char_length(k) != F.octet_length(k))


def members_of_artifact(members: DataFrame, records: DataFrame, artifact) -> DataFrame:
    return members.join(records.where((F.col("artifact_ref") == F.lit(artifact)) & (F.col("lifecycle") == LIVE)).select("record_id"), "record_id", "left_semi").select("source_key")


def members_observing(members: DataFrame, records: DataFrame, observed: DataFrame, content: DataFrame, path) -> DataFrame:
    """(source_key): members whose evidence holds an observation of the path: who is stale once it changes."""
    seen = observed.join(content.where(F.col("path") == F.lit(path)).select("observation"), "observation", "left_semi").select("evidence_ref").distinct()
    own = records.where(F.col("lifecycle") == LIVE).join(seen, "evidence_ref", "left_semi").select("record_id")
    return members.join(own, "record_id", "left_semi").select("source_key").distinct()


def live_hits(rows: DataFrame, artifacts: DataFrame, keys: list, after: tuple | None, n: int) -> DataFrame:
    """(index_key, artifact_ref, ordinal): fact rows of live artifacts under some index keys, a page of n."""
    hits = rows.where(F.col("index_key").isin(*keys)).join(artifacts.where(F.col("lifecycle") == LIVE).select("artifact_ref"), "artifact_ref", "left_semi").select("index_key", "artifact_ref", "ordinal")
    by = ["index_key", "artifact_ref", "ordinal"]
    return page_after(hits, by, after, n) if after else hits.orderBy(*by).limit(n)


def fact_rows(rows: DataFrame, artifact, from_ordinal: int, n: int) -> DataFrame:
    """A batch of an artifact's rows in order, each with a checksum of its content."""
    own = rows.where((F.col("artifact_ref") == F.lit(artifact)) & (F.col("ordinal") >= from_ordinal)).orderBy("ordinal").limit(n)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("ordinal", "row_kind", "index_key", "payload")]
    return own.withColumn("checksum", F.sha2(F.concat_ws("|", *parts), 256))


def observations_of(observed: DataFrame, content: DataFrame, evidence) -> DataFrame:
    """(ordinal, observation, path) of one evidence set, in order."""
    return observed.where(F.col("evidence_ref") == F.lit(evidence)).join(content, "observation").select("ordinal", "observation", "path").orderBy("ordinal")


def without_retired(children: DataFrame, parents: DataFrame, key: str, retired: Column) -> DataFrame:
    """Children whose parent isn't retired."""
    return children.join(parents.where(retired).select(key).distinct(), key, "left_anti")


def snapshot_members(members: DataFrame, records: DataFrame, snapshot, from_ordinal: int, n: int) -> DataFrame:
    """(ordinal, source_key, state): members of a snapshot in order; state 1 if their record is sealed (lifecycle 2), else 2, null if it is missing."""
    own = members.where((F.col("snapshot_id") == F.lit(snapshot)) & (F.col("ordinal") >= from_ordinal))
    state = F.when(F.col("lifecycle").isNull(), F.lit(None)).when(F.col("lifecycle") == 2, 1).otherwise(2)
    return own.join(records.select("record_id", "lifecycle"), "record_id", "left").select("ordinal", "source_key", state.alias("state")).orderBy("ordinal").limit(n)


def store_status(namespaces: DataFrame, retired: DataFrame, leases: DataFrame, now: int, ttl: int) -> DataFrame:
    """One row: namespaces, retired scopes, live leases."""
    counts = [namespaces.agg(F.count("*").alias("namespaces")), retired.agg(F.count("*").alias("retired")), leases.agg(F.count_if(F.col("renewed_unix_seconds") >= now - ttl).alias("live_leases"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three rows of one row each


def changes_since(log: DataFrame, generation: int, keep: int = 4096) -> DataFrame:
    """(path, generation): paths changed after a generation, each with its last one; one row of nulls if the log, cut to its `keep` last
    changes, no longer reaches back that far."""
    newest = log.orderBy(F.desc("generation"), F.desc("path")).limit(keep)
    told = newest.agg(F.min("generation").alias("__from"), F.count("*").alias("__n"))
    lost = told.where((F.col("__n") == keep) & (F.col("__from") > generation + 1)).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("generation"))
    since = newest.where(F.col("generation") > generation).groupBy("path").agg(F.max("generation").alias("generation"))
    return since.join(F.broadcast(lost.select(F.lit(1).alias("__lost"))), F.lit(True), "left_anti").unionByName(lost)


def recent_namespaces(namespaces: DataFrame, n: int = 256) -> DataFrame:
    return namespaces.orderBy(F.desc("last_used"), "namespace_id").limit(n)


def ordered_digest(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n, digest): a digest over a group's items in order, and how many there are."""
    listed = F.array_sort(F.collect_list(F.col(item).cast("string")))
    return rows.groupBy(group).agg(F.count(item).alias("n"), F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


def coverage(members: DataFrame) -> DataFrame:
    """One row: members (state, ordinal, reason) in all, fresh, pending, refused, deferred, and the first reason given."""
    is_ = lambda s: F.count_if(F.col("state") == s).alias(s)
    return members.agg(F.count("*").alias("members"), *map(is_, ("fresh", "pending", "refused", "deferred")), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("ordinal"))).alias("first_reason"))


def gaps(found: DataFrame, keep: int = 32) -> DataFrame:
    """(gap, n_more): the first `keep` distinct gaps in order of appearance (gap, ordinal), and how many more there are."""
    once = found.groupBy("gap").agg(F.min("ordinal").alias("ordinal"))
    whole = Window.partitionBy()
    return once.select("gap", F.row_number().over(whole.orderBy("ordinal", "gap")).alias("nth"), F.count("*").over(whole).alias("n")).where(F.col("nth") <= keep).select("gap", "nth", (F.greatest(F.col("n") - keep, F.lit(0))).alias("n_more"))


def partitioned_candidates(members: DataFrame, postings: DataFrame, imports: DataFrame, names: list[str], target: str) -> DataFrame:
    """(member, verdict) for a search of references: selected (it has the names and imports the target, or is it), excluded, unverified
    (not indexed yet) or refused (it can't be indexed). members (member, state), postings (member, name), imports (member, uses)."""
    wanted = sorted({n.lower() for n in names})
    has = postings.where(F.lower("name").isin(wanted)).groupBy("member").agg(F.countDistinct(F.lower("name")).alias("__n")).where(F.col("__n") == len(wanted)).select("member", F.lit(True).alias("__has"))
    uses = imports.where(F.lower("uses") == target.lower()).select("member").distinct().withColumn("__uses", F.lit(True))
    told = members.join(has, "member", "left").join(uses, "member", "left")
    near = F.coalesce("__has", F.lit(False)) & (F.coalesce("__uses", F.lit(False)) | (F.lower("member") == target.lower()))
    verdict = F.when(F.col("state") == "refused", "refused").when(F.col("state") != "fresh", "unverified").when(near, "selected").otherwise("excluded")
    return told.select("member", verdict.alias("verdict"))
