"""Queries for ordered operators (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.operators import ordered, reads
from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql


@query("w01_context_window", sql("seg", """
    , s AS (SELECT id, chapter_id, idx, length(source_text) AS n, row_number() OVER (PARTITION BY chapter_id ORDER BY idx, id) AS r FROM seg),
    f AS (SELECT id, chapter_id, idx, r, 0 AS k, 0 AS total, false AS stopped, []::INTEGER[] AS kept FROM s
          UNION ALL
          SELECT f.id, f.chapter_id, f.idx, f.r, f.k + 1, CASE WHEN f.stopped OR p.n > 400 OR f.total + p.n > 400 THEN f.total ELSE f.total + p.n END,
                 f.stopped OR (p.n <= 400 AND f.total + p.n > 400), CASE WHEN f.stopped OR p.n > 400 OR f.total + p.n > 400 THEN f.kept ELSE list_prepend(p.idx, f.kept) END
          FROM f JOIN s p ON p.chapter_id = f.chapter_id AND p.r = f.r - f.k - 1 WHERE f.k < 3)
    SELECT id, chapter_id, idx, arg_max(kept, k) AS context, CAST(arg_max(total, k) AS INTEGER) AS context_chars FROM f GROUP BY 1, 2, 3"""))
def w01(t: Tables) -> DataFrame:
    return ordered.preceding_context(t.segment.select("id", "chapter_id", "idx", "source_text"), 3, 400)


_TOK = "greatest(1, length(source_text) // 4)"


@query("w03_w04_greedy_chunks", sql("book", f"""
    , s AS (SELECT id, project_id, {_TOK} AS n, row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, idx, id) AS r FROM book WHERE length(source_text) > 0),
    f AS (SELECT project_id, r, id, n AS total, 0 AS chunk FROM s WHERE r = 1
          UNION ALL SELECT s.project_id, s.r, s.id, CASE WHEN f.total + s.n > 1500 THEN s.n ELSE f.total + s.n END, CASE WHEN f.total + s.n > 1500 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN s ON s.project_id = f.project_id AND s.r = f.r + 1)
    SELECT id, project_id, CAST(chunk AS INTEGER) AS chunk FROM f"""))
def w03(t: Tables) -> DataFrame:
    rows = reads.book_order(t.segment.where("length(source_text) > 0").select("id", "project_id", "chapter_id", "idx", F.greatest(F.lit(1), F.floor(F.length("source_text") / 4)).alias("tokens")), t.chapter)
    return ordered.greedy_chunks(rows, "project_id", ["spine_idx", "idx", "id"], F.col("tokens"), 1500).select("id", "project_id", "chunk")


@query("w05_runs", sql("seg", r"""
    , e AS (SELECT id, chapter_id, idx, length(source_text) <= 240 AND status = 'pending' AS e FROM seg),
    b AS (SELECT *, CASE WHEN NOT e OR lag(e) OVER w IS NULL OR NOT lag(e) OVER w THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY chapter_id ORDER BY idx, id)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY chapter_id ORDER BY idx, id ROWS UNBOUNDED PRECEDING) AS island FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, island ORDER BY idx, id) AS n FROM g)
    SELECT id, chapter_id, CAST(island AS BIGINT) AS island, CAST((n - 1) // 50 AS BIGINT) AS part FROM r"""))
def w05(t: Tables) -> DataFrame:
    s = t.segment.select("id", "chapter_id", "idx", "status", "source_text")
    return ordered.runs(s, ["chapter_id"], ["idx", "id"], (F.length("source_text") <= 240) & (F.col("status") == "pending"), 50).select("id", "chapter_id", "island", "part")


@query("w06_run_lengths", sql("event", """
    , c AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c FROM event WINDOW w AS (PARTITION BY project_id ORDER BY id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY project_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT project_id, CAST(run AS BIGINT) AS run, kind, min(id) AS first, count(*) AS rows FROM r GROUP BY 1, 2, 3"""))
def w06(t: Tables) -> DataFrame:
    return ordered.run_lengths(t.event, ["project_id"], ["id"], "kind")


@query("w07_breaker", sql("event", """
    , o AS (SELECT project_id, id, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY project_id ORDER BY id) AS rn FROM event),
    g AS (SELECT *, rn - sum(f) OVER (PARTITION BY project_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS isl FROM o),
    k AS (SELECT *, sum(f) OVER (PARTITION BY project_id, isl ORDER BY id ROWS UNBOUNDED PRECEDING) AS streak FROM g)
    SELECT project_id, min(id) AS tripped_at FROM k WHERE f = 1 AND streak >= 3 GROUP BY 1"""))
def w07(t: Tables) -> DataFrame:
    return ordered.breaker(t.event, "project_id", "id", F.col("kind") == "error", 3)


@query("w08_budget_cut", sql("calls", """
    , r AS (SELECT c.project_id, c.created_at, c.id, sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18, 6))) OVER (PARTITION BY c.project_id ORDER BY c.created_at, c.id ROWS UNBOUNDED PRECEDING) AS total FROM calls c)
    SELECT DISTINCT ON (project_id) project_id, created_at, id, CAST(total AS DOUBLE) AS total FROM r WHERE total > 0.05 ORDER BY project_id, created_at, id"""))
def w08(t: Tables) -> DataFrame:
    cost = F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(18,6)")
    out = ordered.running_cut(t.call.select("project_id", "created_at", "id", "cost_usd"), "project_id", ["created_at", "id"], cost, F.lit(0.05).cast("decimal(18,6)"))
    return out.withColumn("total", F.col("total").cast("double"))


@query("w09_spread_sample", sql("book", """
    , n AS (SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, idx, id) - 1 AS k, count(*) OVER (PARTITION BY project_id) AS n FROM book),
    z AS (SELECT *, n - 10 AS zone, greatest(1, floor((n - 10) / 5)) AS step, k - 5 AS pl FROM n)
    SELECT id, project_id, CAST(k AS INTEGER) AS position FROM z WHERE n <= 14 OR k < 5 OR k >= n - 5 OR (pl >= step AND pl < zone AND pl % step = 0 AND pl / step <= 4)"""))
def w09(t: Tables) -> DataFrame:
    rows = reads.book_positions(t.segment.select("id", "project_id", "chapter_id", "idx"), t.chapter)
    return ordered.spread_sample(rows, "project_id", "position", 5, 4, 5).select("id", "project_id", "position")


@query("w10_sample_text", sql("book", """
    , s AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, idx, id) AS r, CASE WHEN length(source_text) > 1500 THEN substring(source_text, 1, 1500) || '…' ELSE source_text END AS block FROM book),
    c AS (SELECT *, sum(length(block) + CASE WHEN r = 1 THEN 0 ELSE 7 END) OVER (PARTITION BY project_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS total FROM s WHERE r <= 40)
    SELECT project_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS sample FROM c WHERE total <= 12000 GROUP BY 1"""))
def w10(t: Tables) -> DataFrame:
    """The first 40 blocks of each book, clipped, up to a total of 12,000 characters: a report of fixed size."""
    from pyspark.sql import Window as W

    rows = reads.book_positions(t.segment.select("id", "project_id", "chapter_id", "idx", "source_text"), t.chapter).where("position <= 40")
    block = F.when(F.length("source_text") > 1500, F.concat(F.substring("source_text", 1, 1500), F.lit("…"))).otherwise(F.col("source_text"))
    s = rows.select("project_id", F.col("position").alias("r"), block.alias("block"))
    c = s.withColumn("total", F.sum(F.length("block") + F.when(F.col("r") == 1, 0).otherwise(7)).over(W.partitionBy("project_id").orderBy("r").rowsBetween(W.unboundedPreceding, 0))).where("total <= 12000")
    return c.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("sample"))


@query("w14_latest_event", sql("event", "SELECT project_id, arg_max(payload, id) AS payload, max(id) AS id FROM event WHERE kind = 'purchase' GROUP BY 1"))
def w14(t: Tables) -> DataFrame:
    return t.event.where("kind = 'purchase'").groupBy("project_id").agg(F.max_by("payload", "id").alias("payload"), F.max("id").alias("id"))


@query("w17_token_split", sql("traces", """
    , c AS (SELECT DISTINCT ON (id) * FROM llm_call ORDER BY id, loaded_at DESC), j AS (SELECT t.id, t.call_id, greatest(1, coalesce(length(t.target), 0)) AS w, c.completion_tokens AS total FROM traces t JOIN c ON c.id = t.call_id WHERE c.completion_tokens IS NOT NULL)
    SELECT id, CAST(floor(total * w / sum(w) OVER (PARTITION BY call_id)) AS BIGINT) AS share FROM j"""))
def w17(t: Tables) -> DataFrame:
    j = t.trace.select("id", "call_id", "target").join(t.call.where("completion_tokens IS NOT NULL").select(F.col("id").alias("call_id"), "completion_tokens"), "call_id")
    return ordered.proportional(j, "call_id", F.col("completion_tokens"), F.greatest(F.lit(1), F.coalesce(F.length("target"), F.lit(0)))).select("id", "share")


@query("w18_batch_speed", sql("calls", """
    SELECT project_id, count(*) AS attempted, max(created_at) - min(created_at) AS elapsed, CASE WHEN max(created_at) = min(created_at) THEN NULL ELSE round(count(*)::DOUBLE / (max(created_at) - min(created_at)), 9) END AS per_second FROM calls GROUP BY 1"""))
def w18(t: Tables) -> DataFrame:
    span = F.max("created_at") - F.min("created_at")
    return t.call.groupBy("project_id").agg(F.count("*").alias("attempted"), span.alias("elapsed"), F.when(span != 0, F.round(F.count("*") / span, 9)).alias("per_second"))
