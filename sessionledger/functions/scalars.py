"""Scalar rules: identities, ages, ratios, pace and turn readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import safe_id

from .guards import SAFE, bounded_label, full

# Freshness limits in seconds.
MEASUREMENT_FRESH = 120
TIMING_FRESH = 12
QUOTA_FRESH = 600
HOST_SLACK = 20
SKEW = 2


# ---------------------------------------------------------------- identities
def hashed(prefix: str, *parts: Column, length: int = 64) -> Column:
    """sha256 hex of ``prefix`` and the parts joined with ':'."""
    text = F.concat_ws(":", *([F.lit(prefix)] if prefix else []), *[p.cast("string") for p in parts])
    digest = F.sha2(text, 256)
    return digest if length == 64 else F.substring(digest, 1, length)


def session_binding(harness: Column, kind: Column, value: Column) -> Column:
    ok = kind.isin("id", "path") & (value != "")
    return F.when(ok, hashed("", harness, kind, value))


def session_key(session: Column) -> Column:
    """Key of a log whose id is safe to look up by."""
    return F.when(safe_id(session, 128).isNotNull(), hashed("session-v1", session))


def turn_key(session: Column, turn: Column) -> Column:
    return hashed("turn-v1", session, turn, length=24)


def group_key(message_id: Column) -> Column:
    return hashed("", message_id, length=16)


def account_key(account: Column) -> Column:
    return F.when(F.length(account).between(1, 256), hashed("account-v1", account))


def route_key(*route: Column) -> Column:
    """One key per collection route; a missing part differs from an empty one."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in route])), 256)


def generation(binding: Column) -> Column:
    """The first 13 hex digits of a binding as an integer below 2^52."""
    return F.conv(F.substring(binding, 1, 13), 16, 10).cast("bigint")


def thread_key(host: Column, thread: Column) -> Column:
    return F.concat_ws(":", host.cast("string"), thread.cast("string"))


def completion_episode(gen: Column, status_gen: Column, route: Column) -> Column:
    base = F.concat_ws(
        ":", F.coalesce(gen, F.lit(0)).cast("string"), F.coalesce(status_gen, F.lit(0)).cast("string")
    )
    return F.when(F.coalesce(route, F.lit("")) == "", base).otherwise(F.concat_ws(":", base, route))


def alias_pick(key: Column, pool: list[str]) -> Column:
    """Stable choice from ``pool`` by a 32-bit rolling hash of ASCII ``key``."""
    codes = F.transform(F.split(key, ""), lambda ch: F.ascii(ch).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: (acc * 31 + c) % (1 << 32))
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (h % len(pool) + 1).cast("int"))


# ---------------------------------------------------------------------- ages
def age_seconds(at: Column, now, tolerance=0) -> Column:
    """Non-negative age; unknown for a stamp <= 0 or past the tolerance."""
    age = F.lit(now) - at
    return F.when((at > 0) & (age >= -F.lit(tolerance)), F.greatest(age, F.lit(0.0)))


def is_stale(age: Column, limit=MEASUREMENT_FRESH) -> Column:
    return age > limit


def timing_freshness(interval: Column) -> Column:
    return F.greatest(interval * 3.0, F.lit(float(TIMING_FRESH)))


def host_max_age(interval: Column) -> Column:
    usable = interval.between(2, 60)
    return F.when(usable, interval).otherwise(5) + HOST_SLACK


def receipt_timeout(heartbeat: Column) -> Column:
    """Seconds after which a silent snapshot is dropped."""
    return F.when(heartbeat.between(1, 60), heartbeat + 2).otherwise(6)


# -------------------------------------------------------------------- ratios
def percent(value: Column) -> Column:
    return F.when(value.between(0, 100), value)


def exact_partition(total: Column, cached: Column, uncached: Column, written: Column) -> Column:
    rest = total - cached - uncached
    ok = (cached <= total) & (uncached <= total - cached) & (rest == F.coalesce(written, F.lit(0)))
    return F.coalesce(ok, F.lit(False))


def cache_percent(total: Column, cached: Column, uncached: Column, written: Column) -> Column:
    ok = exact_partition(total, cached, uncached, written) & (total > 0)
    return F.when(ok, cached * 100.0 / total)


def uncached_view(total: Column, cached: Column, uncached: Column, written: Column) -> Column:
    return F.when(exact_partition(total, cached, uncached, written), uncached)


def context_percent_view(context: Column, window: Column, reported: Column) -> Column:
    valid = (window > 0) & (context <= window)
    return F.when(valid, F.coalesce(percent(reported), context * 100.0 / window))


# ---------------------------------------------------------------------- pace
def pacing_window(windows: Column, limit: int | None = None) -> Column:
    """The one flagged window, when its fields are valid; none of more than
    ``limit`` windows, where one is given."""
    flagged = F.filter(windows, lambda w: F.coalesce(w.pacing, F.lit(False)))
    few = F.lit(True) if limit is None else F.size(windows) <= limit
    one = F.when(few & (F.size(flagged) == 1), F.element_at(flagged, 1))
    ok = (
        one.duration_s.between(1, 31_622_400)
        & full(one.kind, "[a-z0-9_]{1,24}")
        & bounded_label(one.label, 40).isNotNull()
    )
    return F.when(ok, one)


def time_remaining(resets_at: Column, duration: Column, now) -> Column:
    left = resets_at - F.lit(now)
    return F.when((left > 0) & (left <= duration), left * 100.0 / duration)


def pace_reading(difference: Column) -> Column:
    """Symmetric rounding to a tenth."""
    size = F.floor(F.abs(difference) * 10 + F.lit(1e-9) + F.lit(0.5)) / 10.0
    return F.when((difference < 0) & (size != 0), -size).otherwise(size)


def pace_band(reading: Column) -> Column:
    return (
        F.when(reading.isNull(), "unknown")
        .when(reading >= 0, "surplus")
        .when(reading >= -5, "caution")
        .when(reading > -10, "warning")
        .otherwise("deficit")
    )


# --------------------------------------------------------------------- turns
def turn_elapsed(
    active: Column, stale: Column, started: Column, observed: Column, last: Column, now
) -> Column:
    """Running turn: start to now, or to the observation once stale. An
    explicitly inactive source shows its last duration."""
    until = F.when(stale, observed).otherwise(F.lit(now))
    run = F.greatest(F.floor(until - started), F.lit(0)).cast("bigint")
    return F.when(active & started.isNotNull(), run).when(~active, last)


def turn_total(complete: Column, total: Column, active: Column, elapsed: Column) -> Column:
    running = F.when(F.coalesce(active, F.lit(False)), F.coalesce(elapsed, F.lit(0))).otherwise(0)
    value = total + running
    return F.when(F.coalesce(complete, F.lit(False)) & (value <= SAFE), value)


def implied_start_ok(stamp_us: Column, duration_ms: Column, start: Column, previous_end: Column) -> Column:
    """The end record's own duration agrees with the saved start."""
    implied = F.floor((stamp_us - duration_ms * 1000) / 1_000_000)
    ok = (
        (stamp_us >= duration_ms * 1000)
        & (F.abs(implied - start) <= SKEW)
        & F.coalesce(implied + SKEW >= previous_end, F.lit(True))
    )
    return F.coalesce(ok, F.lit(False))


def next_change_at(now, *instants: Column) -> Column:
    """Earliest instant after ``now`` at which a freshness flag can change."""
    later = F.filter(F.array(*instants), lambda x: x > F.lit(now))
    return F.array_min(later)
