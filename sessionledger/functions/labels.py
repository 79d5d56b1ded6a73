"""Readable columns for report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _text(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def age_label(age: Column) -> Column:
    return (
        F.when(age.isNull(), "age unknown")
        .when(age < 60, F.concat(_text(F.floor(age)), F.lit("s ago")))
        .when(age < 3600, F.concat(_text(F.floor(age / 60)), F.lit("m ago")))
        .otherwise(F.concat(_text(F.floor(age / 3600)), F.lit("h ago")))
    )


def _two(value: Column) -> Column:
    return F.lpad(_text(value), 2, "0")


def duration_label(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull(), DASH)
        .when(seconds < 60, F.concat(_text(seconds), F.lit("s")))
        .when(
            seconds < 3600,
            F.concat(_text(F.floor(seconds / 60)), F.lit("m "), _two(seconds % 60), F.lit("s")),
        )
        .otherwise(
            F.concat(
                _text(F.floor(seconds / 3600)), F.lit("h "), _two(F.floor(seconds % 3600 / 60)), F.lit("m")
            )
        )
    )


def reset_label(seconds: Column) -> Column:
    hours = F.when(seconds < 3600, F.lit("<1")).otherwise(_text(F.floor(seconds % 86400 / 3600)))
    return F.concat(_text(F.floor(seconds / 86400)), F.lit("d "), hours, F.lit("h"))


def tokens_label(value: Column) -> Column:
    """Whole below a thousand, then tenths of K, M and B without a bare '.0'."""

    def scaled(scale: int, unit: str) -> Column:
        tenths = F.floor((value * 10 + scale // 2) / F.lit(scale)).cast("bigint")
        whole = _text(F.floor(tenths / 10))
        return F.when(tenths % 10 == 0, F.concat(whole, F.lit(unit))).otherwise(
            F.concat(whole, F.lit("."), _text(tenths % 10), F.lit(unit))
        )

    return (
        F.when(value.isNull(), DASH)
        .when(value >= 10**9, scaled(10**9, "B"))
        .when(value >= 10**6, scaled(10**6, "M"))
        .when(value >= 10**3, scaled(10**3, "K"))
        .otherwise(_text(value))
    )


def percent_label(value: Column) -> Column:
    return (
        F.when(value.isNull(), DASH)
        .when((value > 99) & (value < 100), ">99%")
        .when((value > 0) & (value < 1), "<1%")
        .otherwise(F.concat(_text(F.floor(value + 0.5)), F.lit("%")))
    )


def _tenth(value: Column, trim: bool) -> Column:
    tenths = F.floor(F.abs(value) * 10 + 0.5).cast("bigint")
    text = F.concat(_text(F.floor(tenths / 10)), F.lit("."), _text(tenths % 10))
    return F.when(tenths % 10 == 0, _text(F.floor(tenths / 10))).otherwise(text) if trim else text


def pace_label(reading: Column) -> Column:
    sign = F.when(reading > 0, "+").when(reading < 0, "−").otherwise("")
    return F.when(reading.isNull(), DASH).otherwise(F.concat(sign, _tenth(reading, False), F.lit("%")))


def pace_text(remaining: Column, expected: Column) -> Column:
    text = F.concat(_tenth(remaining, True), F.lit("% left · "), _tenth(expected, True), F.lit("% expected"))
    return F.coalesce(text, F.lit("Pace unavailable"))


def connection_label(state: Column) -> Column:
    return (
        F.when(state == "setup_needed", "Setup needed")
        .when(state == "connecting", "Connecting")
        .when(state == "connected", "Connected")
        .otherwise("Unreachable")
    )


def child_label(done: Column, total: Column, outcomes: dict[str, Column]) -> Column:
    """``outcomes`` maps running, interrupted, failed and unknown to counts;
    all NULL when the breakdown is not coherent."""
    known = None
    parts = [F.concat(_text(done), F.lit(" completed"))]
    for name, count in outcomes.items():
        word = "unavailable" if name == "unknown" else name
        parts.append(F.when(count > 0, F.concat(_text(count), F.lit(f" {word}"))))
        known = count.isNotNull() if known is None else known & count.isNotNull()
    unresolved = F.when(
        ~known & (total > done), F.concat(_text(total - done), F.lit(" unresolved"))
    )
    line = F.concat_ws(" · ", parts[0], *[F.when(known, p) for p in parts[1:]], unresolved)
    return F.when(done.isNull(), "Subagent status unavailable").otherwise(line)


def timing_label(active: Column, elapsed: Column, outcome: Column, total: Column) -> Column:
    lead = F.when(active, "Wall-clock turn ").otherwise("Last wall-clock turn ")
    cut = F.when(~active & (outcome == "aborted"), " · interrupted").otherwise("")
    tail = F.when(total.isNull(), "Total unavailable").otherwise(
        F.concat(F.lit("Total turn time "), duration_label(total))
    )
    text = F.concat(lead, duration_label(elapsed), F.coalesce(cut, F.lit("")), F.lit("\n"), tail)
    return F.when(elapsed.isNull(), "Turn time unavailable").otherwise(text)
