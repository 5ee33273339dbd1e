"""Translation of segments as staged tables.

Every stage is a DataFrame: what each segment must heed, its prompt and content key, what the ledger already holds,
calls for groups of short segments, single calls for the rest, checks, and the next version of the segments. Models
are plain functions of a prompt, called in Arrow batches; a call that fails or answers badly costs only its own items.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillmill.functions import terms, text
from quillmill.operators import calls, dml, matching
from quillmill.runtime import cut_lineage

Model = Callable[[str], str]

# How many items a group holds, and how long and marked an item of a group may be.
GROUP_ITEMS, GROUP_CHARS, GROUP_MARKS = 50, 240, 8


def bound_entries(entries: DataFrame) -> DataFrame:
    """Entries that bind a translation: no proposals, and with a source term to be found by."""
    return entries.where("status <> 'proposed' AND source_term <> ''")


def constraints(segments: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(segment_id, entry_id, rank, source_term, target_term, hard) of each entry that a source text mentions."""
    bound = bound_entries(entries)
    hits = matching.mentions(matching.source_texts(segments), matching.entry_terms(bound, aliases, "source")).select("segment_id", "entry_id").distinct()
    info = bound.select(F.col("id").alias("entry_id"), F.when(F.col("status") == "locked", 0).otherwise(1).alias("rank"), "source_term", "target_term", ((F.col("status") == "locked") & F.col("source_known")).alias("hard"))
    return hits.join(info, "entry_id")


def prompts(segments: DataFrame, held: DataFrame, entries: DataFrame, projects: DataFrame, model: str) -> DataFrame:
    """Segments with `rules` (the terms to heed, locked ones first), `system` and the `cache_key` of their own call."""
    lines = held.groupBy("segment_id").agg(F.array_sort(F.collect_set(F.struct("rank", "source_term", "target_term"))).alias("r"))
    rule = lambda x: F.concat(F.when(x["rank"] == 0, "must: ").otherwise("use: "), x["source_term"], F.lit(" = "), x["target_term"])
    lines = lines.select(F.col("segment_id").alias("id"), F.transform("r", rule).alias("rules"))
    style = F.col("style") if "style" in projects.columns else F.lit(None).cast("string")
    about = projects.select(F.col("id").alias("project_id"), "source_lang", "target_lang", style.alias("style"))
    hashes = calls.glossary_hash(entries)
    j = segments.join(lines, "id", "left").join(about, "project_id").join(hashes, "project_id", "left")
    j = j.withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    task = F.concat(F.lit("Translate from "), "source_lang", F.lit(" to "), "target_lang", F.lit('. Keep marks such as [[T0]] as they are. Answer as JSON: {"target": "..."}'))
    j = j.withColumn("system", F.concat_ws("\n", task, terms.optional_string(F.col("style")), F.when(F.size("rules") > 0, F.array_join("rules", "\n"))))
    return j.withColumn("cache_key", terms.call_key(F.lit(model), F.col("system"), F.col("source_text"), F.coalesce("glossary_hash", F.lit("")))).drop("glossary_hash", "style")


def group_eligible() -> Column:
    """Short, lightly marked and pending."""
    return (F.col("status") == "pending") & (F.length("source_text") <= GROUP_CHARS) & (F.size(text.placeholders(F.col("source_text"))) <= GROUP_MARKS)


def groups(items: DataFrame) -> DataFrame:
    """items(project_id, cache_key, chapter_id, idx, id, ...) -> (chapter_id, group, project_id, rules, items): at most GROUP_ITEMS in their order."""
    place = F.row_number().over(W.partitionBy("chapter_id").orderBy("idx", "id")) - 1
    g = items.withColumn("group", F.floor(place / GROUP_ITEMS))
    return g.groupBy("project_id", "chapter_id", "group").agg(
        F.array_sort(F.collect_list(F.struct("idx", "id", "cache_key", "source_text"))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))


def group_prompt(rules: list[str], texts: list[str]) -> str:
    return json.dumps({"task": "translate every item", "terms": rules, "items": [{"id": k, "text": t} for k, t in enumerate(texts)]}, ensure_ascii=False)


def _answers(response: str | None) -> dict[int, str]:
    """Targets by number; whatever is no such answer gives none."""
    try:
        got = json.loads(response or "")
        return {int(x["id"]): x["target"] for x in got["items"] if isinstance(x.get("target"), str) and x["target"].strip()}
    except (ValueError, TypeError, KeyError, AttributeError):
        return {}


def call_groups(grouped: DataFrame, model: Model) -> DataFrame:
    """(project_id, cache_key, target): one call a group; items without an answer give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for project, rules, items in zip(pdf["project_id"], pdf["rules"], pdf["items"]):
                try:
                    response = model(group_prompt(list(rules), [x["source_text"] for x in items]))
                except Exception:
                    response = None
                got = _answers(response)
                rows += [(project, x["cache_key"], got[k]) for k, x in enumerate(items) if k in got]
            yield pd.DataFrame(rows, columns=["project_id", "cache_key", "target"])

    return grouped.select("project_id", "rules", "items").mapInPandas(run, "project_id string, cache_key string, target string")


@dataclass
class Translated:
    """What a run gives: outcomes per segment, the segments' next version, new ledger rows and events."""

    outcomes: DataFrame
    segments: DataFrame
    ledger: DataFrame
    events: DataFrame


KEY = ["project_id", "cache_key"]


def _same_marks() -> Column:
    return F.array_sort(text.placeholders(F.col("target"))) == F.array_sort(text.placeholders(F.col("source_text")))


def translate(segments: DataFrame, entries: DataFrame, aliases: DataFrame, projects: DataFrame, ledger: DataFrame, name: str, single: Model, group: Model | None, now: int) -> Translated:
    """L05/L06 over all pending segments; ledger(project_id, cache_key, target) holds earlier answers.

    Paths: `trivial` (nothing to translate: the source stands), `cached`, `grouped`, `single`, `failed`. Equal items of
    a project share one call. An item that a group does not answer, or answers without its marks, is called alone; a
    failed one stays pending. Targets lose orphan apostrophes where their language has none. A target that misses a
    locked term or a mark is flagged; `missed` counts the terms, locked or not, that it lacks.
    """
    pending = segments.where("status = 'pending' AND source_text IS NOT NULL")
    live = pending.where(~text.is_trivially_empty(F.col("source_text")))
    heeded = cut_lineage(constraints(live, entries, aliases))
    work = cut_lineage(prompts(live.select("id", "project_id", "chapter_id", "idx", "status", "source_text"), heeded, entries, projects, name))
    held = ledger.groupBy(*KEY).agg(F.min("target").alias("target")).withColumn("path", F.lit("cached"))
    first = F.min(F.struct("chapter_id", "idx", "id", "source_text", "system", "rules", group_eligible().alias("eligible"))).alias("m")
    missed = cut_lineage(work.groupBy(*KEY).agg(first).select(*KEY, "m.*").join(held.select(*KEY), KEY, "left_anti"))
    done = held
    todo = missed
    if group is not None:
        answered = call_groups(groups(missed.where("eligible")), group).join(missed.select(*KEY, "source_text"), KEY)
        answered = cut_lineage(answered.where(_same_marks()).select(*KEY, "target").withColumn("path", F.lit("grouped")))
        done = done.unionByName(answered)
        todo = missed.join(answered.select(*KEY), KEY, "left_anti")
    alone = todo.select(*KEY, F.to_json(F.struct("system", F.col("source_text").alias("user"))).alias("prompt"))
    fresh = cut_lineage(calls.parse(calls.call(alone, single)).select(*KEY, "target", F.when(F.col("fault").isNull(), "single").otherwise("failed").alias("path")))
    said = work.join(done.unionByName(fresh), KEY, "left").withColumn("target", text.strip_orphan_apostrophes(F.col("target"), F.col("target_lang")))
    said = cut_lineage(said.select("id", *KEY, "source_text", "target", F.coalesce("path", F.lit("failed")).alias("path")))
    used = matching.mentions(said.select(F.col("id").alias("segment_id"), "project_id", F.col("target").alias("text")), matching.entry_terms(bound_entries(entries), aliases, "target")).select("segment_id", "entry_id").distinct()
    lost = heeded.join(used, ["segment_id", "entry_id"], "left_anti").groupBy(F.col("segment_id").alias("id")).agg(F.count("*").alias("missed"), F.bool_or("hard").alias("hard"))
    checked = said.join(lost, "id", "left").withColumn("marks_kept", _same_marks())
    status = F.when(F.col("target").isNull(), "pending").when(F.coalesce("hard", F.lit(False)) | ~F.col("marks_kept"), "flagged").otherwise("translated")
    outcomes = checked.select("id", *KEY, "path", "target", status.alias("status"), F.when(F.col("target").isNotNull(), F.coalesce("missed", F.lit(0))).otherwise(0).alias("missed"))
    trivial = pending.where(text.is_trivially_empty(F.col("source_text"))).select("id", "project_id", F.lit(None).cast("string").alias("cache_key"), F.lit("trivial").alias("path"), F.col("source_text").alias("target"), F.lit("translated").alias("status"), F.lit(0).cast("long").alias("missed"))
    outcomes = cut_lineage(outcomes.unionByName(trivial))
    new = outcomes.where("target IS NOT NULL").select("id", F.col("target").alias("_target"), F.col("status").alias("_status"))
    value = {"target_text": F.coalesce("_target", "target_text"), "status": F.coalesce("_status", "status"), "updated_at": F.when(F.col("_status").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")) if "updated_at" in segments.columns else None}
    after = segments.join(new, "id", "left").select(*[(value[c] if c in value else F.col(c)).alias(c) for c in segments.columns])
    told = outcomes.where("path <> 'trivial'")
    kind = F.when(F.col("target").isNull(), "segment.failed").when(F.col("status") == "flagged", "segment.flagged").otherwise("segment.translated")
    events = dml.event(told, F.col("project_id"), now, kind, F.struct(F.col("id").alias("segment_id"), (F.col("path") == "cached").alias("cache_hit"), "missed"))
    kept = done.where("path = 'grouped'").unionByName(fresh.where("target IS NOT NULL")).select(*KEY, "target")
    return Translated(outcomes, after, kept, events)


def proposals(answers: DataFrame) -> DataFrame:
    """answers(project_id, response) -> (project_id, source_term, type, target_term, seen): proposed terms that hold up.

    The response lists them under `new_terms`; unknown types count as `term`, blank targets as none.
    """
    body = F.from_json(terms.recover_json(F.col("response")), "new_terms array<struct<source:string,target:string,type:string>>")
    each = answers.select("project_id", F.explode(body["new_terms"]).alias("x"))
    source = text.strip(F.col("x.source"))
    kind = F.lower(text.strip(F.col("x.type")))
    known = ("character", "place", "organization", "event", "item", "date_or_time", "phrase", "term", "other")
    rows = each.select("project_id", source.alias("source_term"), F.when(kind.isin(*known), kind).otherwise("term").alias("type"), terms.optional_string(F.col("x.target")).alias("target_term"))
    return rows.where(terms.candidate_fault(F.col("source_term")).isNull()).groupBy("project_id", "source_term", "type", "target_term").agg(F.count("*").alias("seen"))
