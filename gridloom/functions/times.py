"""Clock formats, ticks of 100 ns, back-off, and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = 10_000_000


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    s = F.floor(ms / 1000)
    return F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000


def clock(ms: Column) -> Column:
    """HH:mm:ss; hours may pass 24."""
    h, m, s, _ = _parts(ms)
    return F.format_string("%02d:%02d:%02d", h, m, s)


def srt_time(ms: Column) -> Column:
    h, m, s, rest = _parts(ms)
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, rest)


def playback_time(ms: Column) -> Column:
    """mm:ss, from an hour on h:mm:ss; cut towards zero, so what is less than a second before the start is 00:00. Null for null."""
    whole = lambda unit: F.call_function("div", ms, F.lit(unit))
    h, m, s = whole(3_600_000), whole(60_000) % 60, whole(1_000) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).when(ms.isNotNull(), F.format_string("%02d:%02d", m, s))


def ticks_to_seconds(ticks: Column) -> Column:
    return F.bround(ticks / TICKS, 3)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def backoff_seconds(attempt: Column, base: float = 1.0, cap: float = 60.0, jitter: Column | None = None, retry_after: Column | None = None) -> Column:
    """base doubled with each attempt up to cap, plus a share of jitter (0 to 0.5); a longer Retry-After wins, capped too."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(cap))
    wait = wait * (1 + (F.lit(0.0) if jitter is None else clamp(jitter, 0.0, 0.5)))
    return wait if retry_after is None else F.greatest(wait, F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(cap))).otherwise(0.0))


def http_error(status: Column) -> Column:
    """The error code of an HTTP status."""
    return (
        F.when(status == 400, "BadRequest").when(status.isin(401, 403), "Auth").when(status == 404, "InvalidConfig").when(status == 408, "Timeout")
        .when(status == 429, "RateLimited").when(status.between(500, 599), "ServiceUnavailable").otherwise("Unknown")
    )


def retryable(code: Column) -> Column:
    return code.isin("Timeout", "RateLimited", "ServiceUnavailable", "Network")


def confidence(avg_logprob: Column) -> Column:
    return F.bround(clamp(F.exp(avg_logprob), 0.0, 1.0), 4)
