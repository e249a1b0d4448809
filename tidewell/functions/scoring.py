"""Score expressions (F4, F5, F8-F10, F14-F16, I23, I24). Ages are days before an explicit now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_before(now: Column, ts: Column) -> Column:
    return (F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / 86_400_000.0


def weighted(semantic: Column, keyword: Column, w: float = 0.7) -> Column:
    return semantic * w + keyword * (1 - w)


def boosted(score: Column, kind: Column, factor: float = 1.15) -> Column:
    return F.when(kind == "code", score * factor).otherwise(score)


def aging(days: Column, exempt: Column) -> Column:
    """Factor that lowers old, unvalidated scores: none for 60 days, then a tenth each month, half at most."""
    decay = F.least(F.lit(0.5), (F.floor(days / 30) - 1) * 0.1)
    return F.when((days > 30) & ~exempt, 1 - decay).otherwise(F.lit(1.0))


def recency_blend(score: Column, days: Column, boost: float = 0.3) -> Column:
    return score * (1 - boost) + F.exp(-days / 30) * boost


def retention(days: Column, stability: Column, accesses: Column) -> Column:
    """Forgetting curve: e-folding over stability days, stretched by half for each access."""
    return F.exp(-days / (stability * (1 + 0.5 * accesses)))


def working_score(salience: Column, recency: Column, frequency: Column, emotion: Column) -> Column:
    return 0.4 * salience + 0.3 * recency + 0.2 * F.least(F.lit(1.0), frequency / 10) + 0.1 * emotion


def emotion(success: Column, duration_ms: Column) -> Column:
    return F.when(~success, 1.0).when(duration_ms > 10_000, 0.7).when(duration_ms > 5_000, 0.5).otherwise(0.3)


#: Salience of tools; others have DEFAULT_SALIENCE.
SALIENCE = {
    "error": 0.9,
    "start_session": 0.8,
    "end_session": 0.8,
    "consolidation": 0.85,
    "record_adr": 0.85,
    "record_pattern": 0.85,
    "record_tech_debt": 0.85,
    "index_codebase": 0.7,
    "hybrid_search": 0.5,
    "find_symbol": 0.5,
    "search_graph": 0.5,
    "search_docs": 0.5,
    "context_briefing": 0.5,
    "remember": 0.7,
    "batch_remember": 0.7,
    "promote_memory": 0.6,
    "recall": 0.4,
    "list_memories": 0.2,
    "get_adrs": 0.2,
    "get_patterns": 0.2,
    "get_tech_debt": 0.2,
    "get_index_status": 0.2,
    "get_project_stats": 0.2,
    "review_memories": 0.2,
}
DEFAULT_SALIENCE = 0.3


def salience(tool: Column, success: Column, table: dict[str, float] = SALIENCE) -> Column:
    """the tool's salience, 0.3 more for failures, 1 at most."""
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    base = F.coalesce(F.try_element_at(known, tool), F.lit(DEFAULT_SALIENCE))
    return F.when(success, base).otherwise(F.least(F.lit(1.0), base + 0.3))


def cached_confidence(confidence: Column, days: Column) -> Column:
    return confidence * F.exp(-0.1 * days)


def cost(prompt: Column, completion: Column, written: Column, read: Column, input_price: Column, output_price: Column, batch: Column) -> Column:
    """Price of a call; cache writes cost 1.25 and reads 0.1 of the input price, a batch half of all."""
    full = (prompt * input_price + completion * output_price + written * input_price * 1.25 + read * input_price * 0.1) / 1_000_000
    return F.when(batch, full * 0.5).otherwise(full)
