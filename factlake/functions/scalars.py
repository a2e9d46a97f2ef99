"""Scalar expressions on identities, times, texts and tags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.schema import CORROBORATED, IMPORTANCE

# --- identity ---------------------------------------------------------------

# Reason codes of a malformed author identity.
IDENTITY_ERRORS = (
    "EMPTY", "NO_SEPARATOR", "EMPTY_PREFIX", "EMPTY_SUFFIX", "EXTRA_SEPARATOR",
)


def trimmed(text: Column) -> Column:
    """Text without white space at either end (any white space, not only blanks)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def parse_agent_id(agent: Column) -> Column:
    """``engineer/agent-type`` -> struct(created_by, engineer, agent_type, error).

    ``auto/...`` marks an autonomous author and has no engineer.  A malformed
    identity gives NULL parts and a reason in ``error``.
    """
    text = trimmed(agent)
    prefix = F.substring_index(text, "/", 1)
    slashes = F.length(text) - F.length(F.replace(text, F.lit("/")))
    suffix = F.split_part(text, F.lit("/"), F.lit(2))
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", "EMPTY")
        .when(slashes == 0, "NO_SEPARATOR")
        .when(prefix == "", "EMPTY_PREFIX")
        .when(F.endswith(text, F.lit("/")) & (slashes == 1), "EMPTY_SUFFIX")
        .when(slashes > 1, "EXTRA_SEPARATOR")
    )
    valid = error.isNull()
    return F.struct(
        F.when(valid, text).alias("created_by"),
        F.when(valid & (prefix != "auto"), prefix).alias("engineer"),
        F.when(valid, suffix).alias("agent_type"),
        error.alias("error"),
    )


# --- time -------------------------------------------------------------------

def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(int(days)))


def day_start(as_of: Column) -> Column:
    return F.date_trunc("day", as_of)


def _elapsed_micros(ts: Column, as_of: Column) -> Column:
    return F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))


def _elapsed(ts: Column, as_of: Column, young: str, suffix: str) -> Column:
    # Ages count whole milliseconds, floored per unit.
    millis = F.floor(_elapsed_micros(ts, as_of) / F.lit(1000))
    minute, hour, day = 60_000, 3_600_000, 86_400_000

    def whole(unit: int, letter: str) -> Column:
        count = F.floor(millis / F.lit(unit)).cast("string")
        return F.concat(count, F.lit(letter + suffix))

    return (
        F.when(millis < minute, young)
        .when(millis < hour, whole(minute, "m"))
        .when(millis < day, whole(hour, "h"))
        .when(millis >= day, whole(day, "d"))
    )


def relative_time(ts: Column, as_of: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago``, ``2d ago``; the future is ``just now``."""
    return _elapsed(ts, as_of, "just now", " ago")


def age(ts: Column, as_of: Column) -> Column:
    """``<1m``, ``5m``, ``3h``, ``2d``."""
    return _elapsed(ts, as_of, "<1m", "")


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 in UTC with milliseconds (the session's zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


# --- text -------------------------------------------------------------------

def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: characters outside the basic plane count two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def short_id(memory_id: Column) -> Column:
    return F.substring(memory_id, 1, 6)


def truncate_text(text: Column, width: int) -> Column:
    """One line of at most ``width`` characters, cut texts ending in ``...``."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    cut = F.concat(F.substring(line, 1, width - 3), F.lit("..."))
    return F.when(F.length(line) <= width, line).otherwise(cut)


def format_score(similarity: Column) -> Column:
    """Two decimals of the binary value; its exact ties (eighths) round up."""
    eighths = similarity * 8
    nudged = F.when(eighths == F.floor(eighths), similarity + 1e-9).otherwise(similarity)
    return F.call_function("format_number", nudged, F.lit("0.00"))


# --- tags and importance ------------------------------------------------------

def clean_tags(tags: Column) -> Column:
    """Tags trimmed, blank ones dropped, nothing left -> NULL."""
    kept = F.filter(F.transform(tags, trimmed), lambda tag: tag != "")
    return F.when(F.size(kept) > 0, kept)


def parse_tags(csv: Column) -> Column:
    return clean_tags(F.split(csv, ","))


def format_tags(tags: Column) -> Column:
    joined = F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]"))
    return F.when(F.size(tags) > 0, joined).otherwise("")


def append_corroborated(tags: Column) -> Column:
    """The tags and the corroboration mark, repeated if it was there already."""
    no_tags = F.array().cast("array<string>")
    return F.concat(F.coalesce(tags, no_tags), F.array(F.lit(CORROBORATED)))


def contains_all(tags: Column, wanted: Column) -> Column:
    """Every wanted tag is present; NULL tags contain nothing (not even no tags)."""
    return F.size(F.array_except(wanted, tags)) == 0


def is_importance(value: Column) -> Column:
    return value.isin(*IMPORTANCE)


def pin_on_critical(importance: Column) -> Column:
    return F.coalesce(importance, F.lit("normal")) == "critical"
