"""Cross-field rules over telemetry samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as g
from ..functions import scalars as sc

#: Fixed values.
NUMBERS = [
    "input", "output_tokens", "cache_read", "cache_write", "context", "window", "usage_seq", "total_input",
    "total_output", "total_cache_read", "total_cache_write", "total_uncached_input", "compactions",
    "context_percent",
]
#: Fixed values.
OUTCOMES = [
    "subagent_running", "subagent_completed", "subagent_interrupted", "subagent_failed", "subagent_unknown",
]
CONTRACT = [
    "seq", "event", "phase", "tool", "model", "result", *NUMBERS,
    "subagent_starts", "subagent_stops", "subagent_seq",
    "subagent_total", "subagent_done", "subagent_status_seq", *OUTCOMES, "usage_source",
]


def allowlist(df: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """Only contract columns pass; a missing one is unknown, an extra one drops."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(f) if f in have else F.lit(None).alias(f) for f in fields])


def _blank(df: DataFrame, when: Column, names: list[str]) -> DataFrame:
    """Set ``names`` to NULL together where ``when`` holds."""
    bad = F.coalesce(when, F.lit(False))
    return df.withColumns({n: F.when(~bad, F.col(n)) for n in names})


def usage_coherence(df: DataFrame, now_us) -> DataFrame:
    """Numbers that contradict each other become unknown as a group."""
    c = F.col
    claims = c("usage_seq").isNotNull() | c("usage_source").isNotNull()
    stale = claims & F.coalesce(c("usage_seq") > F.lit(now_us), F.lit(True))
    df = _blank(df, stale, [*NUMBERS, "usage_source"])
    df = _blank(df, c("context_percent") > 100, ["context_percent"])
    df = _blank(
        df,
        c("total_cache_read") > c("total_input"),
        ["total_input", "total_cache_read", "total_uncached_input"],
    )
    # A NULL comparison must not hide a zero window.
    over = (c("window") == 0) | F.coalesce(c("context") > c("window"), F.lit(False))
    return _blank(df, over, ["context", "window", "context_percent"])


def _within(name: str, limit: int | None) -> Column:
    """The count is there, and at most ``limit`` if one is given."""
    return F.col(name).isNotNull() if limit is None else F.col(name) <= limit


def outcome_partition(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Completion counts hold only when stamped; the breakdown only when it also
    adds up. Counts above ``limit``, where one is given, are unknown."""
    c = F.col
    done = (
        (c("subagent_done") <= c("subagent_total"))
        & _within("subagent_total", limit)
        & (c("subagent_status_seq") > 0)
        & (c("subagent_status_seq") <= c("seq"))
    )
    done = F.coalesce(done, F.lit(False))
    total = c(OUTCOMES[0])
    small = _within(OUTCOMES[0], limit)
    for name in OUTCOMES[1:]:
        total = total + c(name)
        small = small & _within(name, limit)
    whole = done & small & (total == c("subagent_total")) & (c("subagent_completed") == c("subagent_done"))
    df = df.withColumns({"_done": done, "_whole": F.coalesce(whole, F.lit(False))})
    df = _blank(df, ~c("_done"), ["subagent_total", "subagent_done", "subagent_status_seq"])
    return _blank(df, ~c("_whole"), OUTCOMES).drop("_done", "_whole")


def hook_counters_valid(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Counters hold when both are there and stamped. Counts above ``limit``,
    where one is given, are unknown."""
    c = F.col
    ok = (
        _within("subagent_starts", limit)
        & _within("subagent_stops", limit)
        & F.coalesce(c("subagent_seq") <= c("seq"), F.lit(True))
        & (((c("subagent_starts") == 0) & (c("subagent_stops") == 0)) | c("subagent_seq").isNotNull())
    )
    ok = F.coalesce(ok, F.lit(False))
    return _blank(df, ~ok, ["subagent_starts", "subagent_stops", "subagent_seq"])


def turn_timing_valid(df: DataFrame, limit_s) -> DataFrame:
    """Keep timing rows whose fields agree; the total needs ``complete``."""
    c = F.col
    df = df.withColumns(
        {
            "freshness_seconds": F.coalesce(c("freshness_seconds"), F.lit(12.0)),
            "last_outcome": g.enum_guard(c("last_outcome"), ["completed", "aborted"]),
            "total_finished_duration_s": F.when(c("complete"), c("total_finished_duration_s")),
        }
    )
    ok = (
        (c("observed_at_s") > 0)
        & (c("observed_at_s") <= F.lit(limit_s))
        & c("complete").isNotNull()
        & F.coalesce((c("started_at_s") > 0) & (c("started_at_s") <= c("observed_at_s")), F.lit(True))
        & (F.coalesce(c("active"), F.lit(False)) == c("started_at_s").isNotNull())
        & (~c("complete") | c("total_finished_duration_s").isNotNull())
        & F.coalesce(c("last_duration_s") <= c("total_finished_duration_s"), F.lit(True))
        & (c("last_duration_s").isNull() == c("last_outcome").isNull())
        & c("freshness_seconds").between(12, 180)
    )
    return df.filter(F.coalesce(ok, F.lit(False)))


def telemetry_view(df: DataFrame, now_us) -> DataFrame:
    """The whole contract: row guards, then every cross-field rule."""
    c = F.col
    rows = df.filter((c("seq") <= F.lit(now_us)) & c("event").isin(*g.EVENTS) & c("phase").isin(*g.PHASES))
    rows = rows.withColumns(
        {
            "tool": g.normalise_tool(c("tool")),
            "model": g.safe_model(c("model")),
            "result": g.enum_guard(c("result"), ["finished", "error", "cancelled"]),
            "usage_source": g.enum_guard(
                c("usage_source"), ["codex-rollout", "pi-extension", "claude-transcript"]
            ),
        }
    )
    return usage_coherence(outcome_partition(hook_counters_valid(rows)), now_us)


def revalidate_remote(df: DataFrame, now_us, sampled_at_us: str) -> DataFrame:
    """Samples from a peer pass the contract again. Their times may lead the
    later of our clock and the sample by one second of skew and the seven
    seconds a snapshot may take."""
    return telemetry_view(df, F.greatest(F.lit(now_us), F.col(sampled_at_us)) + 8_000_000)


def usage_reading(df: DataFrame, now_us) -> DataFrame:
    """Adds the shown usage of a thread: ratios, and whether it is stale.

    A sample from the future, or a usage stamp past its sample, shows nothing.
    """
    c = F.col
    stamp = F.coalesce(c("usage_seq"), c("seq"))
    ok = F.coalesce((c("seq") > 0) & (c("seq") <= F.lit(now_us)) & (stamp > 0) & (stamp <= c("seq")), F.lit(False))
    put = lambda v: F.when(ok, v)
    part = [c(n) for n in ("total_input", "total_cache_read", "total_uncached_input", "total_cache_write")]
    return df.withColumns(
        {
            "shown_context_percent": put(sc.context_percent_view(c("context"), c("window"), c("context_percent"))),
            "shown_input": put(c("total_input")),
            "shown_uncached": put(sc.uncached_view(*part)),
            "shown_cache_percent": put(sc.cache_percent(*part)),
            "shown_compactions": put(c("compactions")),
            "shown_stale": F.coalesce(ok & (F.lit(now_us) - stamp > sc.MEASUREMENT_FRESH * 1_000_000), F.lit(False)),
        }
    )
