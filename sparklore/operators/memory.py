"""Lifecycle of memory records: listing, adding, searching, updating, sessions, curation. ``now`` is always a parameter.

Records have id, project, content, category, status, importance, access_count, created_at, last_accessed_at and tags (a JSON array).
Writers return the whole new table; nothing is changed in place.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import records as M
from . import retrieval as R
from .graph import components, cut

#: Distance below which a new record repeats one, weight of use in a search, least score that closes a task.
DUPLICATE_DISTANCE, USE_WEIGHT, CLOSING_SCORE = 0.12, 0.1, 0.03
#: Importance of what a session leaves, by category.
IMPORTANCE = {"decision": 3.0, "bug": 3.0, "context": 2.0, "progress": 2.0, "code": 2.0, "todo": 1.0, "general": 1.0}
PROFILE = "__developer__"


def tag_list(tags: Column) -> Column:
    return F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))


def listed(notes: DataFrame, project: str, category: str | None = None, limit: int = 50, resolved: bool = False) -> DataFrame:
    """Records of a project, newest first."""
    found = notes.filter(F.col("project") == project)
    found = found if category is None else found.filter(F.col("category") == category)
    found = found if resolved else found.filter("status = 'active'")
    return found.orderBy(F.desc("created_at"), "id").limit(limit)


def with_tag(notes: DataFrame, tag: str, prefix: bool = False) -> DataFrame:
    """Records with a tag, or with one that starts so; the text is literal."""
    return notes.filter(F.exists(tag_list(F.col("tags")), lambda x: x.startswith(tag) if prefix else x == tag))


def age(created: Column, last: Column, now: str) -> tuple[Column, Column]:
    """Whole days since creation (else the last access, else none have passed), never below 0, and their bucket."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.coalesce(created, last, F.lit(now).cast("timestamp")))
    days = F.greatest(F.floor(seconds / 86400), F.lit(0))
    return days, F.when(days <= 7, "fresh").when(days <= 30, "recent").when(days <= 90, "aging").otherwise("stale")


def scored(notes: DataFrame, now: str) -> DataFrame:
    """Adds score, the effective one, with standing tags counted."""
    return notes.withColumn("score", M.effective_score(F.col("importance"), F.col("access_count"), F.col("last_accessed_at"), now, tag_list(F.col("tags"))))


def search(notes: DataFrame, vectors: DataFrame | None, terms: list[str], query: list[float] | None, n: int, now: str, project: str | None = None, category: str | None = None, resolved: bool = False, over: int = 30) -> DataFrame:
    """(id, score): dense and lexical lists fused by rank, and use on top. Filters come before either list's limit; without a project,
    reserved ones are dropped from the lists afterwards. ``vectors`` has id and embedding."""
    kept = notes if resolved else notes.filter("status = 'active'")
    kept = kept if project is None else kept.filter(F.col("project") == project)
    kept = kept if category is None else kept.filter(F.col("category") == category)
    lists = []
    if terms:
        lists.append(R.ranked(R.top(R.bm25(kept, "id", "content", terms), over, F.desc("score"), F.col("id")), F.desc("score"), F.col("id")).select("id", "rank"))
    if vectors is not None and query is not None:
        near = R.knn(vectors.join(kept.select("id"), "id", "left_semi"), query, over, "id")
        lists.append(R.ranked(near, F.col("distance"), F.col("id")).select("id", "rank"))
    if not lists:
        return kept.limit(0).select("id", F.lit(0.0).alias("score"))
    ranks = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    if project is None:
        ranks = ranks.join(kept.filter("not startswith(project, '__')").select("id"), "id", "left_semi")
    fused = ranks.groupBy("id").agg(F.sum(1.0 / (R.RRF_K + F.col("rank"))).alias("fused"))
    final = scored(kept.join(fused, "id"), now).select("id", F.round(F.col("fused") + USE_WEIGHT * F.col("score"), 6).alias("score"))
    return R.top(final, n, F.desc("score"), F.col("id"))


def add(existing: DataFrame, batch: DataFrame, threshold: float = DUPLICATE_DISTANCE) -> DataFrame:
    """(project, id, outcome, of, distance) of new records (project, id, embedding) in order of id: a record whose nearest one of the
    project, old or added before it, is below ``threshold`` is a duplicate of it; others are added.

    A project's vectors are compared in one task, in blocks; projects are bounded by what people write down.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["new", "id"], ignore_index=True)
        v = np.stack(frame["embedding"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
        old = int((~frame["new"]).sum())
        kept, rows = list(range(old)), []
        for i in range(old, len(frame)):
            best, near = -1, np.inf
            for a in range(0, len(kept), 4096):
                d = 1 - v[kept[a : a + 4096]] @ v[i]
                k = int(d.argmin())
                if d[k] < near:
                    best, near = kept[a + k], float(d[k])
            repeated = near < threshold
            rows.append((frame["project"][i], frame["id"][i], "duplicate" if repeated else "added", frame["id"][best] if repeated else None, round(near, 6) if repeated else None))
            if not repeated:
                kept.append(i)
        return pd.DataFrame(rows, columns=["project", "id", "outcome", "of", "distance"])

    both = existing.select("project", "id", "embedding", F.lit(False).alias("new")).unionByName(batch.select("project", "id", "embedding", F.lit(True).alias("new")))
    return both.groupBy("project").applyInPandas(fold, "project string, id string, outcome string, of string, distance double")


def updated(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, content, tags, outcome) of ``changes`` (id, content or null, tags or null): unchanged content is kept and not embedded again,
    changed content is, and an unknown id is an error."""
    old = notes.select("id", F.col("content").alias("_content"), F.col("tags").alias("_tags"))
    joined = changes.join(old, "id", "left")
    differs = F.col("content").isNotNull() & (F.sha2("content", 256) != F.sha2("_content", 256))
    outcome = F.when(F.col("_content").isNull(), "unknown").when(differs, "embedded").otherwise("kept")
    return joined.select("id", F.coalesce("content", "_content").alias("content"), F.coalesce("tags", "_tags").alias("tags"), outcome.alias("outcome"))


def resolved(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """``notes`` with the status of the given ids (column id) set to resolved."""
    hit = notes.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), "resolved").otherwise(F.col("status"))).drop("_hit")


def accessed(notes: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """``notes`` with one more access, now, of the given ids."""
    hit = notes.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    last = F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("last_accessed_at"))
    return hit.withColumn("access_count", F.col("access_count") + F.coalesce(F.col("_hit").cast("long"), F.lit(0))).withColumn("last_accessed_at", last).drop("_hit")


def touched_projects(registry: DataFrame, touched: DataFrame) -> DataFrame:
    """The registry (name, created_at, last_session_at) after sessions of ``touched`` (name, at): known projects keep created_at."""
    newest = touched.groupBy("name").agg(F.max("at").alias("_last"), F.min("at").alias("_first"))
    both = registry.join(newest, "name", "full_outer")
    return both.select("name", F.coalesce("created_at", "_first").alias("created_at"), F.coalesce("_last", "last_session_at").alias("last_session_at"))


def renamed(notes: DataFrame, old: str, new: str, merge: bool = False) -> DataFrame:
    """``notes`` with a project renamed, in the id's suffix too. A target that has records is refused unless ``merge``."""
    for name in (old, new):
        check_project(name)
    if old == new:
        raise ValueError("old and new project names are the same")
    if not merge and not notes.filter(F.col("project") == new).isEmpty():
        raise ValueError(f"project {new!r} already holds records; merge to combine them")
    own = F.col("project") == old
    moved = F.regexp_replace("id", "__" + re.escape(old) + "$", f"__{new}")
    return notes.withColumn("id", F.when(own, moved).otherwise(F.col("id"))).withColumn("project", F.when(own, new).otherwise(F.col("project")))


def check_project(name: str) -> None:
    """Names are 1 to 128 letters, digits, ``._-``; two leading underscores are reserved."""
    if not re.fullmatch(r"[\w.-]{1,128}", name) or name.startswith("__"):
        raise ValueError(f"bad project name {name!r}")


def check_arguments(importance: float | None = None, tags: list[str] | None = None, reason: str | None = None) -> None:
    """Bounds of a host's request: importance 0 to 5, 32 tags, a reason of 500 characters."""
    if importance is not None and not 0 <= importance <= 5:
        raise ValueError("importance is from 0 to 5")
    if tags is not None and len(tags) > 32:
        raise ValueError("at most 32 tags")
    if reason is not None and len(reason) > 500:
        raise ValueError("a reason has at most 500 characters")


def guarded(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, project, outcome) of requests (id, project): not_found, foreign_record, or ok where the record is the project's own."""
    owner = notes.select("id", F.col("project").alias("_owner"))
    outcome = F.when(F.col("_owner").isNull(), "not_found").when(F.col("_owner") != F.col("project"), "foreign_record").otherwise("ok")
    return requests.join(owner, "id", "left").select("id", "project", outcome.alias("outcome"))


def is_draft(notes: DataFrame, most: float = 1.0) -> Column:
    """A stop hook's draft: a ``sid:`` tag, little importance, and no task or decision."""
    return F.exists(tag_list(notes["tags"]), lambda x: x.startswith("sid:")) & (notes["importance"] <= most) & ~notes["category"].isin("todo", "bug", "decision")


def stale_drafts(notes: DataFrame, now: str, days: int = 14) -> DataFrame:
    """(id, project, age_days) of active drafts unchanged for more than ``days``."""
    idle, _ = age(F.col("created_at"), F.lit(None).cast("timestamp"), now)
    return notes.filter((F.col("status") == "active") & is_draft(notes) & (idle > days)).select("id", "project", idle.alias("age_days"))


def session_start(notes: DataFrame, project: str, n: int, profile: str = PROFILE, n_profile: int = 10) -> DataFrame:
    """(section, id): the newest notes of the developer's profile, and of the project."""
    parts = [listed(notes, who, limit=many).select(F.lit(section).alias("section"), "id") for section, who, many in (("profile", profile, n_profile), ("project", project, n))]
    return parts[0].unionByName(parts[1])


def prime(notes: DataFrame, project: str, profile: str = PROFILE, n: int = 8, n_profile: int = 10, scan: int = 40) -> DataFrame:
    """(section, id, place): the profile with standing rules first and then by importance, and the project's newest records that are no
    drafts, out of the newest ``scan``."""
    standing = M.is_always_on(F.col("importance"), tag_list(F.col("tags")))
    order = {"profile": Window.orderBy(F.desc("_standing"), F.desc("importance"), F.desc("created_at"), "id"), "project": Window.orderBy(F.desc("created_at"), "id")}
    own, other = listed(notes, profile, limit=n_profile).withColumn("_standing", standing), listed(notes, project, limit=scan)
    other = other.filter(~(F.exists(tag_list(F.col("tags")), lambda x: x.startswith("sid:")) & (F.col("importance") < 2) & ~F.col("category").isin("todo", "bug", "decision"))).orderBy(F.desc("created_at"), "id").limit(n)
    parts = [df.select(F.lit(section).alias("section"), "id", (F.row_number().over(order[section]) - 1).alias("place")) for section, df in (("profile", own), ("project", other))]
    return parts[0].unionByName(parts[1])


def standing_rules(notes: DataFrame, projects: list[str]) -> DataFrame:
    """(id, importance): the rules of the given projects that must outlive a compaction, most important first."""
    kept = notes.filter(F.col("project").isin(projects) & (F.col("status") == "active") & M.is_always_on(F.col("importance"), tag_list(F.col("tags"))))
    return kept.select("id", "importance").orderBy(F.desc("importance"), "id")


def session_end(notes: DataFrame, project: str, completed: list[list[str]], now: str) -> DataFrame:
    """(item, id, score): the open bug or task that each completed item (its terms) closes: the best one not closed before with a score
    of at least CLOSING_SCORE."""
    spark, closed, rows = notes.sparkSession, [], []
    for item, terms in enumerate(completed):
        hits = [search(notes, None, terms, None, 10, now, project, category) for category in ("bug", "todo")]
        best = hits[0].unionByName(hits[1]).filter(~F.col("id").isin(closed)).orderBy(F.desc("score"), "id").first()
        if best is not None and best["score"] >= CLOSING_SCORE:
            closed.append(best["id"])
            rows.append((item, best["id"], best["score"]))
    return spark.createDataFrame(rows, "item int, id string, score double")


def by_tag_upsert(notes: DataFrame, incoming: DataFrame) -> DataFrame:
    """(project, tag, id, action, tags) of incoming records (project, tag, content, tags as arrays), one for each project and tag: the
    newest record with the tag is updated and its tags are kept first, otherwise one is created."""
    tagged = notes.select("project", "id", "created_at", F.col("tags").alias("_old"), F.explode(F.array_distinct(tag_list(F.col("tags")))).alias("tag"))
    newest = tagged.groupBy("project", "tag").agg(F.max_by(F.struct("id", "_old"), F.struct("created_at", "id")).alias("_e"))
    joined = incoming.join(newest, ["project", "tag"], "left")
    merged = F.array_distinct(F.concat(tag_list(F.col("_e._old")), "tags"))
    made = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", "project", "tag", "content"), 256), 1, 16), F.lit("__"), "project")
    return joined.select("project", "tag", F.coalesce("_e.id", made).alias("id"), F.when(F.col("_e.id").isNull(), "created").otherwise("updated").alias("action"), merged.alias("tags"))


def curate(notes: DataFrame, now: str, threshold: float = 0.8, stale_days: int = 90, stale_importance: float = 2.0) -> DataFrame:
    """(id, reason, kept): records to archive, near duplicates and stale ones, of all that are active and not immune.

    Records are compared in list order (newest first); of a similar pair the one with more importance, then use, then a newer
    date stays, and the other takes no further part. Equal sets of tokens are one class, pairs of classes come from an exact
    join, and each connected group of classes is folded in one task without expanding its copies into pairs.
    """
    active = notes.filter((F.col("status") == "active") & ~M.is_always_on(F.col("importance"), tag_list(F.col("tags"))))
    # numbered as they lie: numbers in order would take a project's records, texts and all, through one task
    keyed = cut(active.select("id", "project", "importance", "access_count", "created_at", "last_accessed_at", M.token_text(F.col("content")).alias("_t"), F.monotonically_increasing_id().alias("_key")))
    rows, base = keyed.drop("_t"), keyed.select("project", "_key", "_t").filter("_t <> ''")
    members = cut(M.members_of(base, "_key", "project"))
    pairs = cut(M.pairs_of(base, members, threshold, "_key", "project").select("project", "a", "b"))
    name = lambda c: F.concat_ws("\x1f", "project", F.col(c).cast("string"))
    linked = cut(components(pairs.select(name("a").alias("a"), name("b").alias("b"))))
    many = members.groupBy("project", "representative").agg(F.count(F.lit(1)).alias("n"))
    groups = members.join(many, ["project", "representative"]).withColumn("_class", name("representative")).join(linked, F.col("_class") == F.col("node"), "left")
    groups = groups.filter("n > 1 or node is not null").select("project", "_key", F.col("representative").alias("klass"), F.coalesce("root", "_class").alias("group"))
    near = pairs.select("project", F.col("a").alias("klass"), F.col("b").alias("other")).union(pairs.select("project", "b", "a")).groupBy("project", "klass").agg(F.collect_list("other").alias("near"))
    full = groups.join(rows.select("project", "_key", "id", "importance", "access_count", "created_at"), ["project", "_key"]).join(near, ["project", "klass"], "left")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["created_at", "id"], ascending=[False, True], ignore_index=True)
        rank = list(zip((frame["importance"] * 100).astype(int), frame["access_count"], frame["created_at"], strict=True))
        by_class: dict[int, list[int]] = {}
        for i, k in enumerate(frame["klass"]):
            by_class.setdefault(int(k), []).append(i)
        near = {int(k): {int(k), *(map(int, x) if x is not None else ())} for k, x in zip(frame["klass"], frame["near"], strict=True)}
        gone: dict[int, int] = {}
        for i in range(len(frame)):
            if i in gone:
                continue
            alive = {c: [j for j in by_class.get(c, []) if j not in gone] for c in near[int(frame["klass"][i])]}
            by_class.update(alive)
            for j in heapq.merge(*alive.values()):
                if j <= i or j in gone:
                    continue
                if rank[i] >= rank[j]:
                    gone[j] = i
                else:
                    gone[i] = j
                    break
        return pd.DataFrame([(frame["id"][j], frame["id"][i]) for j, i in gone.items()], columns=["id", "kept"])

    # so few bytes would be joined to one task, and the time goes by groups
    dealt = full.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project", "group")
    double = cut(dealt.groupBy("project", "group").applyInPandas(fold, "id string, kept string"))
    idle = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_accessed_at")) / 86400)
    stale = rows.filter((F.col("importance") <= stale_importance) & (idle >= stale_days)).join(double, "id", "left_anti")
    return double.select("id", F.lit("duplicate").alias("reason"), "kept").unionByName(stale.select("id", F.lit("stale").alias("reason"), F.lit(None).cast("string").alias("kept")))


def recall(notes: DataFrame, project: str, query: str, now: str, limit: int = 3, budget: int = 1200, excluded: tuple[str, ...] = (), candidates: int = 40, floor: float = 5.0) -> DataFrame:
    """(id, score) of what a host is reminded of: records of the project that hold at least two of the query's words by their stems (half
    of them, if that is more) and score ``floor`` or more, no drafts and no plain remarks, best first; whole records up to ``budget`` characters, one that does not
    fit is skipped. Less than two words ask for nothing."""
    from ..functions import text as T

    spark = notes.sparkSession
    asked = spark.range(1).select(F.filter(T.query_tokens(F.lit(query)), lambda x: ~x.isin(*T.STOP_WORDS)).alias("t")).first()["t"]
    empty = spark.createDataFrame([], "id string, score double")
    if len(asked) < 2:
        return empty
    kept = notes.filter((F.col("project") == project) & (F.col("status") == "active") & ~F.col("id").isin(list(excluded) or [""]))
    noise = F.exists(tag_list(F.col("tags")), lambda x: (x == "auto-session") | x.startswith("sid:")) | ((F.col("importance") < 2) & (F.col("category") == "general"))
    stems = [spark.range(1).select(T.stem(F.lit(x)).alias("s")).first()["s"] for x in asked]  # sixteen at most
    found = R.top(R.bm25(kept, "id", "content", stems, prefix=True), candidates, F.desc("score"), F.col("id")).filter(F.col("score") >= floor)
    need = max(2, (len(asked) + 1) // 2)
    eligible = kept.filter(~noise & (T.matched_tokens(F.col("content"), F.array(*map(F.lit, asked))) >= need)).select("id", F.length("content").alias("n"))
    ranked = found.join(eligible, "id")
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["n"] <= budget) & (F.size(acc["ids"]) < limit)
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    # at most ``candidates`` rows are gathered
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "n"))).alias("rows"))
    chosen = rows.select(F.explode(F.aggregate("rows", state, step, lambda acc: acc["ids"])).alias("id"))
    return ranked.join(chosen, "id").select("id", "score").orderBy(F.desc("score"), "id")
