"""Problem 6: fill containers of a fixed capacity with items, with as little room left as possible.

Method: mixture-controlled packing. The chapters of a project are its source queues, each with a target share of
the tokens: given by the caller, or its share of all tokens of the project. Each window (helper call) is filled by
deficit round-robin: a queue earns its share of the capacity, spends it on its largest items that fit the room (the
queue with the largest deficit first; a queue that cannot yet pay for its next item waits, so small items are kept for
the ends of windows), and carries what is left over into the next window, without a cap; the rest of the window is
then topped up with the largest waiting item that fits, on the account of its queue. Every window of every level is
filled that way.

A project is dealt to shards of about SHARD_ITEMS items, so a hot project spreads over many tasks. Windows that are
full are closed; the items of the emptiest ones, at most SHARD_ITEMS / FAN_IN of them a shard, are carried with the
deficits of the queues to the next level, where FAN_IN shards share one. So no level hands a task more than
about SHARD_ITEMS items, whatever the sizes; the last level closes every window. Only a segment larger than the
capacity is divided: into whole windows and a remainder that is packed like any other item.

Defined results: a segment's size is its characters div 4, at least 1 (a null text counts 1); repeated ids
count once; segments of a project without a capacity of at least 1 are not packed; ties go by id; given shares
that are null or negative count as 0, and a queue without a share is served by topping up alone.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillmill.runtime import cut_lineage

SHARD_ITEMS = 4000
FAN_IN = 16
#: Counts of at most so many projects are broadcast (two short columns a project); beyond, rows are joined under salts.
BROADCAST_PROJECTS = 100_000
SALTS = 64
#: Before the last level a window with no more than this share of it empty is never opened again.
SLACK = 0.02


class _Sizes:
    """Waiting items of one queue by size: the largest that fits is found by bisection."""

    def __init__(self):
        self.sizes: list[int] = []
        self.items: dict[int, list] = {}
        self.tokens = 0

    def add(self, size: int, item) -> None:
        held = self.items.get(size)
        if not held:
            insort(self.sizes, size)
            held = self.items[size] = []
        held.append(item)
        self.tokens += size

    def largest(self, most: float) -> int:
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int):
        held = self.items[size]
        item = held.pop()
        if not held:
            del self.items[size]
            self.sizes.remove(size)
        self.tokens -= size
        return item


def pack(items: list[tuple[str, str, int, int]], capacity: int, shares: dict[str, float], deficits: dict[str, float], most_left: int = 0):
    """items (queue, id, part, size), all within capacity -> (windows, items left, deficits).

    At most `most_left` items are left, those of the emptiest windows; their windows count as never opened.
    """
    queues: dict[str, _Sizes] = {}
    every: dict[int, set[str]] = {}
    for q, i, part, size in sorted(items, key=lambda x: (x[0], x[3], x[1], x[2]), reverse=True):
        queues.setdefault(q, _Sizes()).add(size, (q, i, part, size))
        every.setdefault(size, set()).add(q)
    sizes = sorted(every)
    waiting = sum(q.tokens for q in queues.values())
    credit = {q: deficits.get(q, 0.0) for q in {*queues, *deficits}}
    live = sorted(queues)
    windows, big = [], sum(2 * x[3] > capacity for x in items)

    def draw(q: str, size: int):
        item = queues[q].take(size)
        if size not in queues[q].items:
            every[size].discard(q)
            if not every[size]:
                del every[size]
                sizes.remove(size)
        credit[q] -= size
        return item

    while waiting > 0:
        room, window = capacity, []
        live = [q for q in live if queues[q].tokens]
        for q in live:
            credit[q] += shares.get(q, 0.0) * capacity
        # no two items over half of the capacity share a window: once they alone fill what is to come, each opens one
        if big * capacity >= waiting:
            size = sizes[-1]
            window.append(draw(max(every[size], key=lambda x: (credit[x], x)), size))
            room -= size
        for q in sorted(live, key=lambda x: (-credit[x], x)):
            while room:
                size = queues[q].largest(room)
                if not size or size > credit[q]:
                    break
                window.append(draw(q, size))
                room -= size
        while room:
            k = bisect_right(sizes, room)
            if not k:
                break
            size = sizes[k - 1]
            q = max(every[size], key=lambda x: (credit[x], x))
            window.append(draw(q, size))
            room -= size
        waiting -= capacity - room
        big -= sum(2 * x[3] > capacity for x in window)
        windows.append((room, window, live))
    left: list[tuple] = []
    opened = set()
    for k in sorted(range(len(windows)), key=lambda k: (-windows[k][0], k)) if most_left else ():
        room, window, earned = windows[k]
        if room <= SLACK * capacity or len(left) + len(window) > most_left:
            break
        opened.add(k)
        left += window
        for q in earned:
            credit[q] -= shares.get(q, 0.0) * capacity
        for q, _, _, size in window:
            credit[q] += size
    return [w for k, (_, w, _) in enumerate(windows) if k not in opened], left, credit


def _packer(level: int, last: bool, most_left: int, fan_in: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        project, capacity, shard = pdf["project_id"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        real, account = pdf[pdf["id"].notna()], pdf[pdf["id"].isna()]
        carried = account.groupby("queue")["deficit"].sum().to_dict()
        shares = account.groupby("queue")["share"].max().to_dict()
        items = list(zip(real["queue"], real["id"], real["part"].astype(int), real["size"].astype(int)))
        done, rest, credit = pack(items, capacity, shares, carried, 0 if last else most_left)
        rows = [(project, capacity, shard, level, k, q, i, p, s, None, shares.get(q)) for k, w in enumerate(done) for q, i, p, s in w]
        if not last:
            rows += [(project, capacity, shard // fan_in, level, -1, q, i, p, s, None, None) for q, i, p, s in rest]
            still = {q for q, _, _, _ in rest}
            rows += [(project, capacity, shard // fan_in, level, -1, q, None, 0, 0, float(d), shares.get(q)) for q, d in credit.items() if d or q in still]
        out = pd.DataFrame(rows, columns=["project_id", "capacity", "shard", "level", "window", "queue", "id", "part", "size", "deficit", "share"])
        return out.astype({"part": "int32", "size": "int32", "window": "int32", "shard": "int32", "level": "int32", "capacity": "int32", "deficit": "float64", "share": "float64"})

    return run


PACKED = "project_id string, capacity int, shard int, level int, window int, queue string, id string, part int, size int, deficit double, share double"


def _dealt(cut: DataFrame) -> DataFrame:
    """The items with their shard; no project is gathered by the join with its count."""
    counts = cut_lineage(cut.groupBy("project_id").agg(F.ceil(F.count("*") / SHARD_ITEMS).cast("int").alias("shards")))
    if counts.count() <= BROADCAST_PROJECTS:
        met = cut.join(F.broadcast(counts), "project_id")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = cut.withColumn("salt", F.pmod(F.hash("id", "part"), F.lit(SALTS))).join(salted, ["project_id", "salt"])
    return met.withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.col("shards")).cast("int"))


def _accounts(dealt: DataFrame, shares: DataFrame | None) -> DataFrame:
    """A row for each queue of each shard: its target share of the project's tokens and an empty deficit."""
    held = cut_lineage(dealt.groupBy("project_id", "capacity", "shard", "queue").agg(F.sum("size").alias("tokens")))
    if shares is None:
        queues = held.groupBy("project_id", "queue").agg(F.sum("tokens").alias("tokens"))
        totals = queues.groupBy("project_id").agg(F.sum("tokens").alias("total"))
        wanted = queues.join(totals, "project_id").select("project_id", "queue", (F.col("tokens") / F.col("total")).alias("share"))
    else:
        wanted = shares.where("project_id IS NOT NULL AND chapter_id IS NOT NULL").groupBy("project_id", F.col("chapter_id").alias("queue")).agg(F.greatest(F.lit(0.0), F.coalesce(F.max("share"), F.lit(0.0))).alias("share"))
    return held.join(wanted, ["project_id", "queue"], "left").select("project_id", "capacity", "shard", "queue", F.coalesce("share", F.lit(0.0)).alias("share"))


def helper_calls(segments: DataFrame, options: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """(project_id, call_id, chapter_id, segment_id, part, tokens, capacity, target_share): every segment in one call.

    `shares`(project_id, chapter_id, share) are the target proportions of a project's chapters in each call; without
    them a chapter's target is its share of the tokens of the project.
    """
    caps = options.where("chunk_max_tokens >= 1").select("project_id", F.col("chunk_max_tokens").alias("capacity"))
    size = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("source_text", F.lit(""))) / 4)).cast("int")
    sized = (
        segments.where("id IS NOT NULL").select("project_id", F.coalesce("chapter_id", F.lit("")).alias("queue"), "id", size.alias("size"))
        .groupBy("id").agg(F.min(F.struct("project_id", "queue", "size")).alias("r")).select("id", "r.*")
        .join(caps, "project_id")
    )
    parts = F.ceil(F.col("size") / F.col("capacity")).cast("int")
    cut = sized.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumn("size", F.when(F.col("part") < F.col("parts") - 1, F.col("capacity")).otherwise(F.col("size") - F.col("capacity") * (F.col("parts") - 1)).cast("int"))
    dealt = cut_lineage(_dealt(cut_lineage(cut.select("project_id", "capacity", "queue", "id", "part", "size"))))
    most = dealt.agg(F.coalesce(F.max("shards"), F.lit(0))).first()[0]
    depth = 1 + (math.ceil(round(math.log(most, FAN_IN), 9)) if most > 1 else 0)
    nothing = lambda kind: F.lit(None).cast(kind)
    left = dealt.select("project_id", "capacity", "shard", F.lit(0).alias("level"), F.lit(-1).alias("window"), "queue", "id", "part", "size", nothing("double").alias("deficit"), nothing("double").alias("share")).unionByName(
        _accounts(dealt, shares).select("project_id", "capacity", "shard", F.lit(0).alias("level"), F.lit(-1).alias("window"), "queue", nothing("string").alias("id"), F.lit(0).alias("part"), F.lit(0).alias("size"), F.lit(0.0).alias("deficit"), "share")
    )
    closed = None
    for level in range(depth):
        last = level == depth - 1
        out = left.groupBy("project_id", "shard").applyInPandas(_packer(level, last, SHARD_ITEMS // FAN_IN, FAN_IN), PACKED)
        if not last:
            out = cut_lineage(out)
            left = out.where("window < 0")
        done = out.where("window >= 0")
        closed = done if closed is None else closed.unionByName(done)
    call = F.concat_ws("-", F.substring(F.md5("project_id"), 1, 8), "level", "shard", "window")
    return closed.select("project_id", call.alias("call_id"), F.col("queue").alias("chapter_id"), F.col("id").alias("segment_id"), "part", F.col("size").alias("tokens"), "capacity", F.col("share").alias("target_share"))


def call_shares(calls: DataFrame) -> DataFrame:
    """(project_id, call_id, chapter_id, tokens, share, target_share, fill): what each chapter has of each call."""
    held = calls.groupBy("project_id", "call_id", "chapter_id").agg(F.sum("tokens").alias("tokens"), F.max("target_share").alias("target_share"), F.max("capacity").alias("capacity"))
    whole = held.groupBy("project_id", "call_id").agg(F.sum("tokens").alias("all_tokens"))
    return held.join(whole, ["project_id", "call_id"]).select(
        "project_id", "call_id", "chapter_id", "tokens", F.round(F.col("tokens") / F.col("all_tokens"), 6).alias("share"), F.round("target_share", 6).alias("target_share"),
        F.round(F.col("all_tokens") / F.col("capacity"), 6).alias("fill"))
