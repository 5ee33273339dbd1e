"""Writes over whole sets, each giving the next versions of its tables and what it recorded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillmill.functions import terms, text
from quillmill.operators import dml
from quillmill.operators.reads import first_per
from quillmill.runtime import cut_lineage


def natural_id(*parts: Column) -> Column:
    """An id of 32 hexadecimal digits from what makes the row unique, so that a repeated write makes no second row."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


def _lemma(term: Column, lang: Column) -> Column:
    """The term without one leading function word of its language; unchanged where the language is not given or nothing is left."""
    bare = terms.normalize_term(term, lang)
    return F.when(lang.isNotNull() & terms.leading_particle(term, lang).isNotNull() & (bare != ""), bare).otherwise(term)


@dataclass
class Upserted:
    outcomes: DataFrame
    entries: DataFrame
    aliases: DataFrame
    revisions: DataFrame


def upsert(entries: DataFrame, aliases: DataFrame, proposals: DataFrame, now: int) -> Upserted:
    """proposals(project_id, source_term, type, target_term, source_lang, target_lang) against a glossary, as one set.

    Both sides lose one leading function word first. A proposal meets the first entry (by age) of its project with the
    same source term (`matched`), else the first (by source term) with the same canonical form (`folded`: its spelling
    becomes a source alias where it differs by more than case), else it makes an entry; those of one canonical form
    make one, named by the best of them, and the others are folded into it. While an entry is proposed, a type of
    `term` rises to a specific one and a target that mirrors the source is filled in; each such change leaves a
    revision. A null language strips nothing; blank source terms are left out; among several proposals for one entry
    the smallest specific type and the smallest target count.
    """
    said = proposals.where(text.strip(F.col("source_term")) != "").select(
        "project_id", _lemma(F.col("source_term"), F.col("source_lang")).alias("source_term"), F.coalesce("type", F.lit("term")).alias("type"),
        _lemma(terms.optional_string(F.col("target_term")), F.col("target_lang")).alias("target"))
    ranked = F.concat(F.when(F.col("type") == "term", "1").otherwise("0"), "type")
    p = said.groupBy("project_id", "source_term").agg(F.min(ranked).alias("kind"), F.min(F.when(F.col("target") != F.col("source_term"), F.col("target"))).alias("target"))
    p = p.withColumn("key", terms.canonical_form(F.col("source_term")))
    known = entries.where("source_term IS NOT NULL").withColumn("key", terms.canonical_form(F.col("source_term"))).select("project_id", "source_term", "key", "created_at", "id")
    exact = first_per(known, ["project_id", "source_term"], F.col("created_at"), F.col("id")).select("project_id", "source_term", F.col("id").alias("exact_id"))
    alike = first_per(known.where("key <> ''"), ["project_id", "key"], F.col("source_term"), F.col("id")).select("project_id", "key", F.col("id").alias("alike_id"))
    met = cut_lineage(p.join(exact, ["project_id", "source_term"], "left").join(alike, ["project_id", "key"], "left").withColumn("held_id", F.coalesce("exact_id", "alike_id")))
    fresh = met.where("held_id IS NULL").withColumn("family", F.coalesce(F.nullif("key", F.lit("")), "source_term"))
    head = fresh.groupBy("project_id", "family").agg(F.min(F.struct(F.substring("kind", 1, 1), "source_term")).alias("m"), F.min("kind").alias("kind"), F.min("target").alias("target"))
    head = cut_lineage(head.select("project_id", "family", F.col("m.source_term").alias("head"), natural_id(F.col("project_id"), F.lit("entry"), F.col("m.source_term")).alias("new_id"), "kind", "target"))
    outcomes = cut_lineage(
        met.where("held_id IS NOT NULL").select("project_id", "source_term", F.col("held_id").alias("entry_id"), F.when(F.col("exact_id").isNotNull(), "matched").otherwise("folded").alias("action"))
        .unionByName(fresh.join(head.select("project_id", "family", "head", "new_id"), ["project_id", "family"]).select("project_id", "source_term", F.col("new_id").alias("entry_id"), F.when(F.col("source_term") == F.col("head"), "created").otherwise("folded").alias("action"))))
    made = {"id": F.col("new_id"), "source_term": F.col("head"), "target_term": F.coalesce("target", "head"), "type": F.substring("kind", 2, 99), "status": F.lit("proposed"), "source_known": F.lit(True), "created_at": F.lit(now), "updated_at": F.lit(now), "project_id": F.col("project_id")}
    new_rows = head.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema])
    wishes = met.where("held_id IS NOT NULL").groupBy(F.col("held_id").alias("id")).agg(F.min("kind").alias("_kind"), F.min("target").alias("_target"))
    j = entries.join(wishes, "id", "left")
    soft = (F.col("status") == "proposed") & F.col("_kind").isNotNull()
    up = F.coalesce(soft & (F.col("type") == "term") & F.col("_kind").startswith("0"), F.lit(False))
    fill = F.coalesce(soft & (F.col("target_term") == F.col("source_term")) & F.col("_target").isNotNull(), F.lit(False))
    value = {"type": F.when(up, F.substring("_kind", 2, 99)).otherwise(F.col("type")), "target_term": F.when(fill, F.col("_target")).otherwise(F.col("target_term")), "updated_at": F.when(up | fill, F.lit(now)).otherwise(F.col("updated_at"))}
    after = j.select(*[value.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in entries.schema]).unionByName(new_rows)
    reason = F.when(up & fill, "type and target").when(up, "type").otherwise("target")
    revisions = j.where(up | fill).select(F.col("id").alias("entry_id"), F.col("target_term").alias("prev_target_term"), F.when(fill, F.col("_target")).otherwise(F.col("target_term")).alias("new_target_term"), reason.alias("reason"), F.lit(now).cast("long").alias("created_at"))
    names = entries.select(F.col("id").alias("entry_id"), F.col("source_term").alias("_own")).unionByName(head.select(F.col("new_id").alias("entry_id"), F.col("head").alias("_own")))
    folded = outcomes.where("action = 'folded'").join(names, "entry_id").where("lower(source_term) <> lower(_own)").select("entry_id", F.lit("source").alias("side"), F.col("source_term").alias("text"))
    more = folded.join(aliases.select("entry_id", "side", "text"), ["entry_id", "side", "text"], "left_anti")
    return Upserted(outcomes, after, aliases.select("entry_id", "side", "text").unionByName(more), revisions)


@dataclass
class Merged:
    entries: DataFrame
    aliases: DataFrame
    mentions: DataFrame
    revisions: DataFrame


def pointed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of losers, by entry_id, as rows of their winner."""
    moved = groups.where("id <> winner").select(F.col("id").alias("entry_id"), "winner")
    return rows.join(moved, "entry_id", "left").withColumn("entry_id", F.coalesce("winner", "entry_id")).drop("winner").select(*rows.columns)


def merge(entries: DataFrame, aliases: DataFrame, mentions: DataFrame, groups: DataFrame, now: int, reason: str = "merge") -> Merged:
    """groups(id, winner): losers go; their spellings and aliases become aliases of the winner, less its own terms; their mentions point to it.

    One revision for each winner that took something in. Groups without a loser change nothing.
    """
    from quillmill.operators import resolution

    left, names = resolution.merge(entries, aliases, groups)
    moved = groups.where("id <> winner").select(F.col("id").alias("entry_id"), "winner")
    took = moved.select(F.col("winner").alias("id")).distinct().withColumn("_took", F.lit(True))
    j = left.join(took, "id", "left")
    after = j.select(*[(F.when(F.col("_took"), F.lit(now)).otherwise(F.col(c)).cast("long") if c == "updated_at" else F.col(c)).alias(c) for c in entries.columns])
    revisions = j.where("_took").select(F.col("id").alias("entry_id"), F.col("target_term").alias("prev_target_term"), F.col("target_term").alias("new_target_term"), F.lit(reason).alias("reason"), F.lit(now).cast("long").alias("created_at"))
    return Merged(after, names, pointed(mentions, groups), revisions)


def attach(links: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """links(project_id, lore_id, mode, priority), requests(project_id, lore_id, mode, priority?, place) -> (links, events).

    Idempotent: a link that is there gets the mode, and the priority where one is given, and no event. A new one
    without a priority goes behind the last of its project, in the order of `place`; requests that repeat count once,
    by their first place. A mode other than `read_only` or `writable` is turned down.
    """
    asked = requests.where("mode IN ('read_only', 'writable') AND project_id IS NOT NULL AND lore_id IS NOT NULL")
    asked = first_per(asked.select("project_id", "lore_id", F.col("mode").alias("_mode"), F.col("priority").alias("_priority"), "place"), ["project_id", "lore_id"], F.col("place"))
    held = links.join(asked, ["project_id", "lore_id"], "left").select("project_id", "lore_id", F.coalesce("_mode", "mode").alias("mode"), F.coalesce("_priority", "priority").alias("priority"))
    fresh = asked.join(links.select("project_id", "lore_id"), ["project_id", "lore_id"], "left_anti")
    top = held.select("project_id", "priority").unionByName(fresh.where("_priority IS NOT NULL").select("project_id", F.col("_priority").alias("priority"))).groupBy("project_id").agg(F.max("priority").alias("_top"))
    behind = F.row_number().over(W.partitionBy("project_id", F.col("_priority").isNull()).orderBy("place", "lore_id"))
    new = fresh.join(top, "project_id", "left").select("project_id", "lore_id", F.col("_mode").alias("mode"), F.coalesce("_priority", F.coalesce("_top", F.lit(-1)) + behind).cast("int").alias("priority"))
    events = dml.event(new, F.col("project_id"), now, "lore.attached", F.struct("lore_id", "mode", "priority"))
    return held.unionByName(new), events


def detach(links: DataFrame, gone: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Links without those of gone(project_id, lore_id), and an event for each that was there."""
    ids = gone.select("project_id", "lore_id").distinct()
    hit = links.join(ids, ["project_id", "lore_id"], "left_semi")
    return links.join(ids, ["project_id", "lore_id"], "left_anti"), dml.event(hit, F.col("project_id"), now, "lore.detached", F.struct("lore_id"))


def rewrite_segments(segments: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """changes(id, source_text?, target_text?, status?, inline_skeleton?); null means unchanged, a new source renews its hash."""
    fields = [c for c in ("source_text", "target_text", "status", "inline_skeleton") if c in changes.columns]
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in fields])
    j = segments.join(c, "id", "left")
    touched = F.lit(False)
    for x in fields:
        touched = touched | (F.col(f"_{x}").isNotNull() & ~F.col(f"_{x}").eqNullSafe(F.col(x)))
    value = {x: F.coalesce(f"_{x}", x) for x in fields}
    value["updated_at"] = F.when(touched, F.lit(now)).otherwise(F.col("updated_at"))
    if "source_text" in fields:
        value["source_hash"] = F.when(F.col("_source_text").isNotNull(), F.sha2("_source_text", 256)).otherwise(F.col("source_hash"))
    return j.select(*[(value[x] if x in value else F.col(x)).alias(x) for x in segments.columns])


def update_projects(projects: DataFrame, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """changes(id, name?, budget_usd?, context_max_segments?, context_max_chars?) -> (projects, events, rejected).

    A blank name and a negative number turn the whole change down; an event lists what really changed.
    """
    fields = [c for c in ("name", "budget_usd", "context_max_segments", "context_max_chars") if c in changes.columns]
    bad = F.lit(False)
    for x in fields:
        bad = bad | F.coalesce(text.strip(F.col(x)) == "" if x == "name" else F.col(x) < 0, F.lit(False))
    c = changes.where(~bad).select("id", *[F.col(x).alias(f"_{x}") for x in fields])
    j = projects.join(c, "id", "left")
    differs = {x: F.col(f"_{x}").isNotNull() & ~F.col(f"_{x}").eqNullSafe(F.col(x)) for x in fields}
    changed = F.filter(F.array(*[F.when(differs[x], F.lit(x)) for x in fields]), lambda v: v.isNotNull())
    told = j.withColumn("changed", changed).where(F.size("changed") > 0)
    events = dml.event(told, F.col("id"), now, "project.updated", F.struct("changed"))
    return j.select(*[(F.coalesce(f"_{x}", x) if x in fields else F.col(x)).alias(x) for x in projects.columns]), events, changes.where(bad)


# Kinds and states of intake runs.
RUN_KINDS, RUN_STATES = ("book_intake", "chapter_pre_pass"), ("completed", "cancelled", "aborted", "rate_limited", "failed")


def record_runs(runs: DataFrame, links: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """incoming(project_id, kind, status, started_at, entries) -> (runs, links to entries, rejected); ids are natural, so a repeated run counts once."""
    ok = F.coalesce(F.col("kind").isin(*RUN_KINDS) & F.col("status").isin(*RUN_STATES), F.lit(False))
    rows = incoming.where(ok).withColumn("id", natural_id(F.col("project_id"), F.lit("run"), F.col("kind"), F.col("started_at").cast("string")))
    new = rows.join(runs.select("id"), "id", "left_anti").dropDuplicates(["id"])
    each = new.select(F.col("id").alias("run_id"), F.explode("entries").alias("entry_id")).distinct()
    return runs.unionByName(new.select(*runs.columns)), links.unionByName(each.join(links, ["run_id", "entry_id"], "left_anti")), incoming.where(~ok)


def create_projects(projects: DataFrame, incoming: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """incoming(name, kind, source_lang, target_lang, source_path, ...) -> (projects, events); a project of one path and pair of languages is made once."""
    rows = incoming.withColumn("id", natural_id(F.lit("project"), F.col("source_path"), F.col("source_lang"), F.col("target_lang"))).withColumn("created_at", F.lit(now).cast("long"))
    new = rows.dropDuplicates(["id"]).join(projects.select("id"), "id", "left_anti")
    filled = new.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in projects.schema])
    return projects.unionByName(filled), dml.event(filled, F.col("id"), now, "project.created", F.struct("name", "kind"))
