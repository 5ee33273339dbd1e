"""Skeleton envelopes of segments (S25): JSON in two shapes, a bare list of tokens or an object around it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = "struct<tag:string,kind:string,attrs:map<string,string>>"
ENVELOPE = f"struct<skeleton:array<{TOKEN}>,host_path:string,host_part:int,host_total_parts:int>"


def decode(json_text: Column) -> Column:
    """struct(tokens, host_path, host_part, host_total_parts); null, blank and broken text give no tokens."""
    bare = F.ltrim(json_text).startswith("[")
    env = F.from_json(json_text, ENVELOPE)
    none = F.array().cast(f"array<{TOKEN}>")
    tokens = F.coalesce(F.when(bare, F.from_json(json_text, f"array<{TOKEN}>")).otherwise(env["skeleton"]), none)
    pick = lambda c, d: F.coalesce(F.when(~bare, env[c]), F.lit(d)).alias(c)
    return F.struct(tokens.alias("tokens"), pick("host_path", ""), pick("host_part", 0), pick("host_total_parts", 1))


def encode(tokens: Column, host_path: Column, host_part: Column, host_total_parts: Column) -> Column:
    return F.to_json(F.struct(tokens.alias("skeleton"), host_path.alias("host_path"), host_part.alias("host_part"), host_total_parts.alias("host_total_parts")))
