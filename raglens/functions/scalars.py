"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = ["faithfulness", "context_precision", "context_recall", "answer_relevance", "answer_correctness"]
KEY_METRICS = ["faithfulness", "context_recall", "context_precision", "answer_correctness"]
ISO = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"


def sanitize_score(x: str | Column) -> Column:
    """NULL for what is missing, NaN or infinite, or no number; 0.0 stays."""
    x = F.col(x) if isinstance(x, str) else x
    x = x.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def is_ok(status: str = "status") -> Column:
    """A NULL status counts as ok."""
    return F.coalesce(F.col(status), F.lit("ok")) != "error"


def to_epoch(iso: str | Column) -> Column:
    """ISO date or time to epoch seconds; NULL for anything else."""
    iso = F.col(iso) if isinstance(iso, str) else iso
    return F.when(iso.rlike(ISO), F.unix_seconds(F.try_to_timestamp(iso)))


def is_blank(x: str | Column) -> Column:
    """NULL, or nothing but white space of any kind."""
    x = F.col(x) if isinstance(x, str) else x
    return ~F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))


def stripped(x: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rounded(x: Column, digits: int = 9) -> Column:
    return F.round(x.cast("double"), digits)
