"""Column functions on confidences, bands, calibration and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: calibration and band limits
MIN_VOLUME, MOST_POINTS = 3, 15.0
SNAPSHOT_LOW, SNAPSHOT_HIGH = 0.6, 0.8
POLICY_LOW, POLICY_HIGH = 0.50, 0.75
LABEL_CONFIDENCE, FALLBACK_CONFIDENCE = 0.66, 0.50
DEFAULT_DOCUMENT_TYPE, DEFAULT_LANGUAGE, CONTEXT_PREFIX = "veterinary_record", "unknown", "ctx_v1:"


def unit(x: Column) -> Column:
    """A number held between 0 and 1; null and not-a-number are 0."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))


def snapshot_band(x: Column) -> Column:
    """low, mid or high by the snapshot limits; null for null."""
    return F.when(x.isNull(), F.lit(None)).when(x < SNAPSHOT_LOW, "low").when(x < SNAPSHOT_HIGH, "mid").otherwise("high")


def policy_tone(x: Column) -> Column:
    """low, med or high by the policy limits."""
    return F.when(x < POLICY_LOW, "low").when(x < POLICY_HIGH, "med").otherwise("high")


def kept_confidence(x: Column) -> Column:
    """Of the confidences that extractors pass only two are kept."""
    return F.when(x >= LABEL_CONFIDENCE, F.lit(LABEL_CONFIDENCE)).otherwise(F.lit(FALLBACK_CONFIDENCE))


def review_adjustment(accepts: Column, edits: Column) -> Column:
    """Percentage points that past reviews add to a confidence: a smoothed share of accepts, 0 below the least volume, one decimal, half to even."""
    a, e = F.greatest(F.lit(0), accepts), F.greatest(F.lit(0), edits)
    points = ((a + 1.0) / (a + e + 2.0) - 0.5) * 2.0 * MOST_POINTS
    return F.when(a + e < MIN_VOLUME, F.lit(0.0)).otherwise(F.bround(points, 1))


def mapped_confidence(candidate: Column, adjustment: Column) -> Column:
    return unit(candidate + adjustment / 100.0)


def context_key(document_type: Column, language: Column) -> Column:
    """Digest of the context's canonical JSON; blanks and nulls count as the defaults."""
    named = lambda x, default: F.coalesce(F.nullif(F.lower(F.trim(x)), F.lit("")), F.lit(default))
    packed = F.to_json(F.struct(F.lit("v1").alias("context_version"), named(document_type, DEFAULT_DOCUMENT_TYPE).alias("document_type"), named(language, DEFAULT_LANGUAGE).alias("language")))
    return F.concat(F.lit(CONTEXT_PREFIX), F.sha2(packed, 256))


def mapping_id(explicit: Column, anchor: Column, reason: Column, key: Column) -> Column:
    """An explicit id, else one made from the anchor, else a fallback one if a reason says so, else null."""
    text = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(text(explicit), F.concat(F.lit("anchor::"), F.lower(text(anchor))), F.when(F.contains(F.lower(reason), F.lit("fallback")), F.concat(F.lit("fallback::"), key)))


def source_hint(page: Column, snippet: Column, most: int = 80) -> Column:
    """Where a value was read, for display."""
    return F.nullif(F.concat_ws(" | ", F.concat(F.lit("page:"), page.cast("string")), F.concat(F.lit("snippet:"), F.substring(F.trim(snippet), 1, most))), F.lit(""))
