"""Column guards: a valid value, or NULL for unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = 9_007_199_254_740_991

# Fixed values of the log formats.
EVENTS = [
    "session", "turn", "tool-start", "tool-end", "thinking", "output", "compact-start", "compact-end",
    "compact-failed", "idle", "interrupt", "end", "model", "subagent-start", "subagent-stop",
]
#: Fixed values.
PHASES = [
    "ready", "working", "tool", "thinking", "output", "compacting", "idle", "interrupted", "ended",
]
#: Fixed values.
TOOLS = [
    "Bash", "bash", "apply_patch", "read", "write", "edit", "grep", "find", "ls", "exec_command",
    "write_stdin", "exec", "web", "mcp-tool", "custom-tool",
]
STATES = ["working", "blocked", "done", "idle", "unknown"]


def full(col: Column, pattern: str) -> Column:
    """Whole-string regex match; NULL stays NULL."""
    return col.rlike(rf"\A(?:{pattern})\z")


def safe_counter(text: Column, top: int = SAFE) -> Column:
    """Integer in [0, top] from the JSON text of a number.

    Booleans, floats, signs, spaces and exponents are unknown, so the raw text
    must be read, not a coerced number.
    """
    digits = full(text, "0|[1-9][0-9]{0,15}")
    value = F.when(digits, text.try_cast("bigint"))
    return F.when(value <= top, value)


def bounded(value: Column, top: int) -> Column:
    return F.when(value.between(0, top), value)


def enum_guard(col: Column, values: list[str]) -> Column:
    return F.when(col.isin(*values), col)


def normalise_tool(col: Column) -> Column:
    return (
        F.when(col.isNull() | (col == ""), F.lit(None).cast("string"))
        .when(col.isin(*TOOLS), col)
        .when(col.startswith("mcp"), F.lit("mcp-tool"))
        .otherwise(F.lit("custom-tool"))
    )


def safe_model(col: Column) -> Column:
    part = "[A-Za-z0-9][A-Za-z0-9_.:-]*"
    ok = (
        full(col, f"{part}(/{part})?")
        & (F.octet_length(col) <= 64)
        & ~col.contains("..")
        & ~col.contains(":/")
    )
    return F.when(ok, col)


def safe_id(col: Column, n: int) -> Column:
    return F.when(full(col, "[A-Za-z0-9_-]+") & (F.length(col) <= n), col)


def hex_id(col: Column, n: int) -> Column:
    return F.when(full(col, f"[0-9a-f]{{{n}}}"), col)


def clean_text(col: Column, fallback: str, n: int = 160) -> Column:
    bare = F.regexp_replace(F.coalesce(col, F.lit(fallback)), r"[\x00-\x1f\x7f]", "")
    return F.substring(bare, 1, n)


def is_plain_path(col: Column) -> Column:
    return col.startswith("/") & ~col.rlike(r"(^|/)\.\.(/|\z)")


def path_leaf(col: Column, n: int = 80) -> Column:
    """Last component of an absolute path without parent steps, else ''."""
    trimmed = F.regexp_replace(col, r"/+\z", "")
    leaf = F.regexp_replace(F.substring_index(trimmed, "/", -1), r"[\x00-\x1f\x7f-\x{9f}]", "")
    return F.when(is_plain_path(col), F.substring(leaf, 1, n)).otherwise("")


def checkout_leaf(worktree: Column, worktree_class: Column, cwd: Column, cwd_class: Column) -> Column:
    """Worktree leaf when both paths share a category, else the cwd leaf."""
    own = F.when(worktree_class == cwd_class, path_leaf(worktree)).otherwise("")
    leaf = F.when(own == "", path_leaf(cwd)).otherwise(own)
    odd = leaf.isin(".", "..") | leaf.contains("\\")
    return F.when(odd, "").otherwise(leaf)


def bounded_label(col: Column, n: int) -> Column:
    """1 to n characters, none of them a control character."""
    ok = F.length(col).between(1, n) & ~col.rlike(r"[\x00-\x1f\x7f-\x{9f}]")
    return F.when(ok, col)


def valid_email(col: Column) -> Column:
    ok = full(col, r"[^@\s<>]+@[^@\s<>]+\.[^@\s<>.]+") & (F.length(col) <= 254)
    return F.when(ok, col)


def not_future(value: Column, now, tolerance=0) -> Column:
    """NULL stamps past ``now + tolerance`` (same unit as ``value``)."""
    return F.when(value <= F.lit(now) + F.lit(tolerance), value)


def rfc3339_us(col: Column) -> Column:
    """Microseconds of a strict RFC 3339 stamp; a zone is required.

    Fractions are truncated, impossible days and instants before 1970 are
    unknown. Independent of the session time zone.
    """
    shape = (
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
        r"(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"
    )
    part = lambda i, n: F.substring(col, i, n).cast("bigint")
    day = F.unix_date(F.try_to_date(F.substring(col, 1, 10), "yyyy-MM-dd")).cast("bigint")
    fraction = F.rpad(F.substring(F.regexp_extract(col, r"\.([0-9]+)", 1), 1, 6), 6, "0")
    zone = F.regexp_extract(col, r"([+-][0-9]{2}:[0-9]{2})\z", 1)
    offset = F.when(
        zone != "",
        (F.substring(zone, 2, 2).cast("bigint") * 3600 + F.substring(zone, 5, 2).cast("bigint") * 60)
        * F.when(zone.startswith("-"), -1).otherwise(1),
    ).otherwise(0)
    second = day * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2) - offset
    micros = second * 1_000_000 + fraction.cast("bigint")
    return F.when(full(col, shape), F.when(second >= 0, micros))
