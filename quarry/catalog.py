"""All queries of the inventory engine, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import captions, feed, galleries, normalize, photo_cache, photos, posts, shots, sticker_blocks, stickers, sync, vehicle_posts
from quarry.streaming import incremental, submissions

_FAMILIES = (captions, feed, normalize, sync, photos, photo_cache, galleries, shots, posts, stickers, sticker_blocks, vehicle_posts, incremental, submissions)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _FAMILIES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _FAMILIES for k, s in m.ORACLES.items()}
