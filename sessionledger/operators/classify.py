"""What one log record is, by column expressions over its parsed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as g
from ..functions.scalars import hashed
from ..plans import Run, running

# Fixed values of the transcript text grammar.
WRAPPERS = [
    "command-name", "local-command-stdout", "local-command-stderr", "bash-input", "bash-stdout",
    "bash-stderr", "task-notification",
]
INTERRUPTS = ["[Request interrupted by user]", "[Request interrupted by user for tool use]"]
STATUS_WORDS = {"completed": "completed", "failed": "errored", "killed": "interrupted", "blocked": "unknown"}
ORIGINS = ["human", "task-notification", "peer", "coordinator"]
SPAWNS = ["async_launched", "teammate_spawned", "remote_launched", "forked"]
_TAG = "<([a-z0-9_-]{1,32})>"
_SPACE = " \t\r\n"


# ---------------------------------------------------------------- identities
def identity_filter(df: DataFrame, record_session: str, span: int | None = None) -> DataFrame:
    """match / absent / mismatch per record; ``poisoned`` from the first
    mismatch of the session on."""
    named = F.col(record_session)
    state = (
        F.when(named.isNull(), "absent")
        .when(named == F.col("session_id").cast("string"), "match")
        .otherwise("mismatch")
    )
    rows = df.withColumn("identity", state)
    return running(
        rows, ["session_id"], "ord", {"poisoned": Run("max", F.col("identity") == "mismatch")}, span
    )


def drop_forked(df: DataFrame) -> DataFrame:
    """Copied history feeds no metric."""
    return df.filter(~F.col("forked"))


def drop_synthetic(df: DataFrame) -> DataFrame:
    """Responses made by the client itself feed no usage."""
    return df.filter(~F.col("synthetic"))


# ---------------------------------------------------------------------- text
def lead_tag(text: Column) -> Column:
    """Known leading tag, 'other' for an unknown one, 'none' without one."""
    name = F.regexp_extract(text, rf"\A{_TAG}", 1)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(name == "", "none")
        .when(name.isin(*WRAPPERS), name)
        .otherwise("other")
    )


def notification_fields(text: Column) -> Column:
    """``(task, status)`` of a notification text, raw.

    Elements ``<name>value</name>`` are read one after another while they
    follow each other with only white space between; a second ``task-id``
    loses the id, and nothing past a complete pair is read.
    """
    body = F.substring(text, F.lit(len("<task-notification>") + 1), F.length(text))
    pattern = rf"[{_SPACE}]*{_TAG}((?s:.*?))</\1>"
    parts = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(pattern), 0).alias("whole"),
        F.regexp_extract_all(body, F.lit(pattern), 1).alias("name"),
        F.regexp_extract_all(body, F.lit(pattern), 2).alias("value"),
    )
    none = F.lit(None).cast("string")
    first = F.struct(
        F.lit(1).alias("at"),
        F.lit(True).alias("open"),
        none.alias("task"),
        none.alias("status"),
        F.lit(False).alias("seen"),
    )

    def read(acc, part):
        size = F.length(part["whole"])
        next_to = F.substring(body, acc.at, size) == part["whole"]
        is_task = part["name"] == "task-id"
        again = is_task & acc.seen
        task = F.when(again, none).when(is_task, part["value"]).otherwise(acc.task)
        seen = acc.seen | is_task
        status = F.when((part["name"] == "status") & acc.status.isNull(), part["value"]).otherwise(acc.status)
        going = F.struct(
            (acc.at + size).alias("at"),
            (~again & ~(seen & status.isNotNull())).alias("open"),
            task.alias("task"),
            status.alias("status"),
            seen.alias("seen"),
        )
        stop = F.struct(
            acc.at.alias("at"), F.lit(False).alias("open"), acc.task.alias("task"),
            acc.status.alias("status"), acc.seen.alias("seen"),
        )
        return F.when(acc.open & next_to, going).otherwise(stop)

    read_all = F.aggregate(parts, first, read)
    closing = "</task-notification>"
    first_close = F.locate(closing, text)
    rest = F.substring(text, first_close + len(closing), F.length(text))
    trailing = (first_close > 0) & rest.rlike(rf"[^{_SPACE}]")
    task = F.when(~trailing, g.safe_id(read_all.task, 128))
    return F.struct(task.alias("task"), read_all.status.alias("status"))


def classify_text(df: DataFrame, text: str, blocks: str | None = None) -> DataFrame:
    """Adds ``lead``, ``interrupt``, hashed ``task`` and ``task_status``.

    Whole texts are read. ``blocks`` counts text blocks of the record; with a
    second one the task id is lost.
    """
    t = F.col(text)
    lead = lead_tag(t)
    note = F.when(lead == "task-notification", notification_fields(t))
    task = note.task
    if blocks is not None:
        task = F.when(F.col(blocks) <= 1, task)
    raw = note.status
    status = raw
    word = F.lit("unknown")
    for name, mapped in STATUS_WORDS.items():
        word = F.when(status == name, mapped).otherwise(word)
    return df.withColumns(
        {
            "lead": lead,
            "interrupt": F.coalesce(t.isin(*INTERRUPTS), F.lit(False)),
            "task": F.when(task.isNotNull(), hashed("", task)),
            "task_status": F.when(lead == "task-notification", F.when(raw.isNull(), "unknown").otherwise(word)),
        }
    )


# ---------------------------------------------------------------- iterations
def select_iteration(iterations: Column, top: Column) -> Column:
    """Usage of one response: its last real iteration, else the top level.

    Advisor and compaction iterations are passed over; the remaining last one
    counts only when it is a message with four counters summing above zero.
    Both arguments carry ``input, output, cache_read, cache_write``.
    """
    real = F.filter(iterations, lambda i: ~F.coalesce(i.type, F.lit("")).isin("advisor_message", "compaction"))
    last = F.when(F.size(real) > 0, F.element_at(real, -1))
    total = last.input + last.output + last.cache_read + last.cache_write
    use = last.type.isin("message", "fallback_message") & (total > 0) & (total <= g.SAFE)
    names = ["input", "output", "cache_read", "cache_write"]
    picked = F.struct(*[last.getField(n).alias(n) for n in names])
    return F.when(F.coalesce(use, F.lit(False)), picked).otherwise(
        F.struct(*[top.getField(n).alias(n) for n in names])
    )


def has_compaction(iterations: Column) -> Column:
    return F.coalesce(F.exists(iterations, lambda i: i.type == "compaction"), F.lit(False))


# -------------------------------------------------------------------- records
def classify_record(df: DataFrame) -> DataFrame:
    """Normalise a parsed transcript record: fields that belong to another kind
    are cleared and ``bad`` marks an assistant record that cannot be counted."""
    c = F.col
    kind = g.enum_guard(c("type"), ["assistant", "user", "attachment", "system", "queue-operation"])
    is_a, is_u = kind == "assistant", kind == "user"
    only = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v)
    stop = F.when(c("stop_reason").isNull(), F.lit("null")).when(
        c("stop_reason").isin("end_turn", "tool_use"), c("stop_reason")
    ).otherwise("other")
    origin = F.when(c("origin").isNull(), F.lit(None)).when(c("origin").isin(*ORIGINS), c("origin")).otherwise("other")
    message = g.safe_id(c("message_id"), 128)
    bad = is_a & (
        ~c("has_message") | message.isNull() | c("stamp").isNull() | ~c("stop_present") | c("iterations_bad")
    )
    end = (kind == "system") & (c("subtype") == "turn_duration")
    return df.select(
        "session_id",
        "ord",
        "stamp",
        kind.alias("kind"),
        only(kind == "system", g.enum_guard(
            c("subtype"),
            ["compact_boundary", "microcompact_boundary", "turn_duration", "stop_hook_summary", "local_command"],
        )).alias("subtype"),
        only(is_a, message).alias("message_id"),
        only(is_a, stop).alias("stop"),
        only(is_a, g.safe_model(c("model"))).alias("model"),
        F.coalesce(is_a & (c("model") == "<synthetic>"), F.lit(False)).alias("synthetic"),
        only(is_u, origin).alias("origin"),
        only(kind == "queue-operation", g.enum_guard(c("operation"), ["enqueue", "dequeue", "remove"])).alias("operation"),
        only(is_u, g.safe_id(c("agent_id"), 128)).alias("child_key"),
        F.coalesce(is_u & c("tool_status").isin(*SPAWNS), F.lit(False)).alias("spawn"),
        only(end, c("duration_ms")).alias("elapsed_ms"),
        F.coalesce(bad, F.lit(False)).alias("bad"),
    )


def classify_turn_role(df: DataFrame) -> DataFrame:
    """``role`` of a record in its turn, first rule that applies.

    An unrecognised origin outranks the metadata flag, because recognised
    origins carry that flag too.
    """
    c = F.col
    user, queued = c("kind") == "user", (c("kind") == "attachment") & c("queued")
    system = c("kind") == "system"
    shape = c("lead").isin("none", "command-name", "task-notification", "other")
    role = (
        F.when(c("interrupt") | c("interrupted") | c("aborted"), "abort")
        .when(c("kind") == "assistant", "assistant")
        .when(c("kind") == "queue-operation", "queue")
        .when(system & (c("subtype") == "turn_duration"), "end")
        .when(system & (c("subtype") == "stop_hook_summary"), "silent")
        .when(user & c("origin").isin(*ORIGINS), "trigger")
        .when(queued & (c("mode") == "task-notification"), "trigger")
        .when(user & c("origin").isNotNull(), "unknown")
        .when(user & (c("meta") | c("tool") | c("summary")), "ignored")
        .when(user & c("lead").isNull(), "unknown")
        .when(user & shape, "trigger")
        .otherwise("ignored")
    )
    return df.withColumn("role", role)
