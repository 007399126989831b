"""Column expressions on file paths and file times (all evaluated in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """Path without scheme and authority, percent escapes decoded once as UTF-8,
    runs of slashes made one, no trailing slash. A ``%`` that begins no escape
    stays as it is, ``+`` is no space. Null stays null."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    # patterns run only where there is something to replace
    safe = F.regexp_replace(F.regexp_replace(bare, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    decoded = F.when(bare.contains("%"), F.url_decode(safe)).otherwise(bare)
    single = F.when(decoded.contains("//"), F.regexp_replace(decoded, "/+", "/")).otherwise(decoded)
    return F.when(single.endswith("/"), F.substring(single, F.lit(1), F.length(single) - 1)).otherwise(single)


def directory(canonical: Column) -> Column:
    """All but the last segment of a canonical path."""
    return F.regexp_replace(canonical, "/[^/]*$", "")


def is_service_path(canonical: Column) -> Column:
    """A segment begins with ``_`` or ``.`` and holds no ``=``."""
    return canonical.rlike(r"(^|/)[_.][^/=]*(/|$)")


def epoch_seconds(value: Column) -> Column:
    """Whole seconds of a time in milliseconds, or in seconds where below 10^11."""
    return F.when(value < 100_000_000_000, value).otherwise(F.floor(value / 1000)).cast("long")
