"""Hits and ingest statistics as text for people and as JSON, made by expressions on the hits' DataFrame."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipeline import IngestStats

PREVIEW = 200


def preview(hits: DataFrame) -> DataFrame:
    """(line): one text for each hit, best first: score to four places, place, and the first 200 characters on one line."""
    place = F.concat(F.coalesce("source_path", F.lit("-")), F.coalesce(F.concat(F.lit(":"), F.col("start_line").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.col("name"), F.lit(")")), F.lit("")))
    body = F.regexp_replace(F.substring("content", 1, PREVIEW), r"\s+", " ")
    cut = F.when(F.length("content") > PREVIEW, F.concat(body, F.lit("..."))).otherwise(body)
    return hits.orderBy(F.desc("score"), "chunk_id").select(F.concat_ws("  ", F.format_number("score", 4), place, cut).alias("line"))


def as_json(hits: DataFrame) -> DataFrame:
    """(json): each hit as a JSON object, best first, nulls left out."""
    return hits.orderBy(F.desc("score"), "chunk_id").select(F.to_json(F.struct(*hits.columns)).alias("json"))


def stats_text(stats: IngestStats) -> str:
    lines = [f"{k.replace('_', ' ')}: {v if not isinstance(v, float) else round(v, 3)}" for k, v in dataclasses.asdict(stats).items() if k != "errors" and v is not None]
    return "\n".join(lines + [f"error: {e['file_path']}: {e['error']}" for e in stats.errors])


def stats_json(stats: IngestStats) -> str:
    return json.dumps(dataclasses.asdict(stats))
