"""Expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in double; null if whole is 0 or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def zero_ratio(part: Column, whole: Column) -> Column:
    """As ratio(), but 0 where there is nothing to divide by."""
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def is_not_true(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))


def in_scope(tenant: Column, own: str | None, everything: bool = False, shared: bool = False) -> Column:
    """Rows of one tenant, null being a tenant of its own; shared adds those of no tenant; everything lifts the limit."""
    if everything:
        return F.lit(True)
    mine = tenant.eqNullSafe(F.lit(own))
    return mine | tenant.isNull() if shared else mine


def label(value: Column, blank_too: bool = False) -> Column:
    """A group's name for display; grouping itself stays on the raw value."""
    return F.when(value.isNull() | (F.lit(blank_too) & (value == "")), "unknown").otherwise(value)


def lower_plain(text: Column) -> Column:
    """Lower case, white space collapsed; null counts as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def token_cost(tokens: Column, rate_per_1k: Column) -> Column:
    return F.round(F.coalesce(tokens, F.lit(0)) / F.lit(1000.0) * rate_per_1k, 6)


def usage_reported(stage: Column, prompt: Column, completion: Column) -> Column:
    """Embedding calls report prompt tokens only, all others both kinds."""
    known = lambda c: F.coalesce(c >= 0, F.lit(False))
    return known(prompt) & ((stage == "embedding") | known(completion))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for null, empty, unequally long, non-finite or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.try_divide(dot(a, b), norm)
    return F.when((F.size(a) == F.size(b)) & (norm > 0) & ~F.isnan(value), value)


def kappa(both: Column, left: Column, right: Column, total: Column) -> tuple[Column, Column]:
    """Observed and expected agreement of two yes/no judges from the counts of both yes, left yes, right yes and all."""
    observed = ratio(total - left - right + 2 * both, total)
    expected = ratio(left, total) * ratio(right, total) + ratio(total - left, total) * ratio(total - right, total)
    return observed, expected


# What stands before a credential, in order of replacement.
_WORDS = r"api[_-]?key|authorization|password|secret|access[_-]?token|refresh[_-]?token|token"
REDACTIONS = [
    (rf'(?i)("(?:[\w-]+_)?(?:{_WORDS})"\s*:\s*)"(?:\\.|[^"\\])*"', '$1"[REDACTED]"'),
    (r"(?i)(bearer\s+)([^\s,;]+)", "$1[REDACTED]"),
    (rf"(?i)({_WORDS})(\s*[:=]\s*)([^\s,;]+)", "$1$2[REDACTED]"),
]


def redacted(text: Column, longest: int = 2000) -> Column:
    """text without credentials, cut to longest characters with a note."""
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("...[truncated]"))).otherwise(text)
