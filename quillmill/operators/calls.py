"""The call pipeline around a pluggable, deterministic model."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillmill.functions import terms, text

Model = Callable[[str], str]


def echo_model(prompt: str) -> str:
    """A stand-in that answers alike for alike prompts: JSON with the text in brackets."""
    return json.dumps({"target": f"<{prompt}>", "used_entries": [], "notes": hashlib.sha256(prompt.encode()).hexdigest()[:8]}, ensure_ascii=False)


def worklist(segments: DataFrame, model: str, glossary_hash: Column) -> DataFrame:
    """Pending segments with something to translate, and the content key of their call."""
    live = segments.where((F.col("status") == "pending") & ~text.is_trivially_empty(F.col("source_text")))
    return live.withColumn("cache_key", terms.call_key(F.lit(model), F.col("project_id"), F.col("source_text"), glossary_hash))


def misses(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """One item per key that the ledger does not hold; equal items share a call."""
    once = work.groupBy("project_id", "cache_key").agg(F.min(F.struct("id", "source_text")).alias("m")).select("project_id", "cache_key", F.col("m.source_text").alias("prompt"))
    return once.join(ledger.select("project_id", "cache_key").distinct(), ["project_id", "cache_key"], "left_anti")


def call(items: DataFrame, model: Model) -> DataFrame:
    """(project_id, cache_key, response); a raising model gives a null response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str) -> str | None:
            try:
                return model(p)
            except Exception:
                return None

        for pdf in batches:
            yield pd.DataFrame({"project_id": pdf["project_id"], "cache_key": pdf["cache_key"], "response": [one(p) for p in pdf["prompt"]]})

    return items.select("project_id", "cache_key", "prompt").mapInPandas(run, "project_id string, cache_key string, response string")


def parse(responses: DataFrame) -> DataFrame:
    """Q02: target and notes of each response, or the reason why there is none."""
    body = terms.recover_json(F.col("response"))
    f = F.from_json(body, "target string, notes string")
    fault = F.when(F.col("response").isNull(), "failed").when(body.isNull(), "no JSON").when(f["target"].isNull(), "no target")
    return responses.select("project_id", "cache_key", f["target"].alias("target"), f["notes"].alias("notes"), fault.alias("fault"))


def glossary_hash(entries: DataFrame) -> DataFrame:
    """One hash per project over its terms in order; ids and times do not count."""
    row = F.struct(F.coalesce("source_term", F.lit("")).alias("s"), F.col("target_term").alias("t"), F.col("type").alias("y"), F.col("status").alias("u"), F.coalesce("gender", F.lit("")).alias("g"), "source_known")
    # a tree of two levels: hashes of entries are gathered by their first four digits, then the hashes of those groups
    h = entries.select("project_id", F.sha2(F.to_json(row), 256).alias("h")).withColumn("g", F.substring("h", 1, 4))
    join = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    return h.groupBy("project_id", "g").agg(F.concat(F.first("g"), join("h")).alias("h")).groupBy("project_id").agg(F.substring(join("h"), 1, 32).alias("glossary_hash"))


def chunk_prompts(chunks: DataFrame) -> DataFrame:
    """chunks(project_id, chunk, position, text) -> one prompt per chunk, paragraphs in order."""
    part = F.array_sort(F.collect_list(F.struct("position", "text")))
    return chunks.groupBy("project_id", "chunk").agg(F.array_join(F.transform(part, lambda x: x["text"]), "\n\n").alias("prompt"), F.count("*").alias("paragraphs"))


class ScriptedModel:
    """Answers from a queue first, then a fixed answer, then a function of the prompt; counts its calls.

    The queue serves tests on one worker; across workers only the fixed answer and the function are deterministic.
    """

    def __init__(self, queue: list[str] | None = None, fixed: str | None = None, responder: Model = echo_model):
        self.queue, self.fixed, self.responder, self.calls = list(queue or []), fixed, responder, 0

    def __call__(self, prompt: str) -> str:
        self.calls += 1
        if self.queue:
            return self.queue.pop(0)
        return self.fixed if self.fixed is not None else self.responder(prompt)


def schedule(items: DataFrame, key: str, order: list[str], cost: Column, cap: Column) -> DataFrame:
    """Items of a batch in order, with the running cost before each and whether it is still submitted.

    An item goes out while the total before it is not strictly above the cap.
    """
    from quillmill.operators.ordered import running, sliced

    summed = running(sliced(items, [key], order), [key], order, {"spent": ("sum", cost)}, inclusive=False).drop("_slice")
    return summed.withColumn("spent", F.coalesce("spent", F.lit(0).cast("decimal(28,6)"))).withColumn("submitted", F.col("spent") <= cap)
