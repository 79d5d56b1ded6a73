"""Session logs: newline-delimited JSON in, ordered records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import guards as g
from ..functions.scalars import turn_key
from ..operators import classify as cl

SEGMENT = 1 << 40
_ROW = (1 << 33) - 1
SESSION_FROM_NAME = {"A": r"-([A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*)\.jsonl$", "B": r"([A-Za-z0-9_-]+)\.jsonl$"}


def log_order(lines: DataFrame) -> DataFrame:
    """Add ``file`` and ``ord``, the place of a line in its log.

    ``ord`` is the segment number of a written part (0 for a plain file), then
    the byte offset of the split, then the row number in its task. A split of
    full size is alone in its task, so rows never reach the next split's start
    and the order holds however a file is cut.
    """
    meta = F.col("_metadata")
    part = F.regexp_extract(meta.file_name, r"^part-([0-9]+)", 1)
    segment = F.when(part != "", part.cast("bigint")).otherwise(0)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    return lines.select(
        "value",
        meta.file_path.alias("file"),
        meta.file_modification_time.alias("modified"),
        (segment * SEGMENT + meta.file_block_start + row).alias("ord"),
    )


def read_session_log(spark: SparkSession, path: str, fmt: str = "B", pattern: str | None = None) -> DataFrame:
    """Lines of every log under ``path`` with the session id of the file name.

    Blank lines are skipped; unreadable lines stay, to be marked by the parser.
    """
    name = pattern or SESSION_FROM_NAME[fmt]
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    rows = log_order(lines).filter(F.length("value") > 0)
    session = F.regexp_extract("file", name, 1)
    return rows.withColumn("session_id", F.when(session != "", session))


def read_log_segments(spark: SparkSession, path: str, session_path: str = "$.sessionId") -> DataFrame:
    """Lines of shared segment files (many sessions each), as written by
    :func:`write_log_segments`; the log's session id is inside the record."""
    rows = log_order(spark.read.text(path)).filter(F.length("value") > 0)
    return rows.withColumn("session_id", F.get_json_object("value", session_path))


def write_log_segments(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``value`` rows so that part number and row order follow
    ``(session_id, ord)``. Range partitioning splits a hot session over parts."""
    (
        lines.repartitionByRange("session_id", "ord")
        .sortWithinPartitions("session_id", "ord")
        .select("value")
        .write.mode(mode)
        .text(path)
    )


# ------------------------------------------------------------------- variants
# One cast lays a parsed line out as a struct whose leaves stay variants, so each
# level is walked once and a leaf's own JSON type can still be told.
_TEXT_BLOCKS = "array<struct<type:string,text:string>>"
_ITERATION = (
    "struct<type:string,input_tokens:bigint,output_tokens:bigint,"
    "cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
)
_USAGE = {
    "input": "input_tokens",
    "output": "output_tokens",
    "cache_read": "cache_read_input_tokens",
    "cache_write": "cache_creation_input_tokens",
}


def _leaves(*names: str) -> str:
    return ",".join(f"{n}:variant" for n in names)


def laid_out(value: str, shape: str) -> Column:
    """The line as ``shape``; NULL when it is no JSON object."""
    return F.try_variant_get(F.try_parse_json(value), "$", shape)


def _text(leaf: Column) -> Column:
    return F.when(F.schema_of_variant(leaf) == "STRING", F.try_variant_get(leaf, "$", "string"))


def _count(leaf: Column) -> Column:
    """An integer literal in the exact range; text, booleans and floats are not."""
    whole = F.schema_of_variant(leaf) == "BIGINT"
    return F.when(whole, g.bounded(F.try_variant_get(leaf, "$", "bigint"), g.SAFE))


def _set(leaf: Column) -> Column:
    """Present and not null."""
    return leaf.isNotNull() & ~F.coalesce(F.is_variant_null(leaf), F.lit(False))


def _true(leaf: Column) -> Column:
    yes = F.when(F.schema_of_variant(leaf) == "BOOLEAN", F.try_variant_get(leaf, "$", "boolean"))
    return F.coalesce(yes, F.lit(False))


def _texts(leaf: Column) -> Column:
    """Texts of a string value, or of the ``text`` blocks of an array."""
    blocks = F.try_variant_get(leaf, "$", _TEXT_BLOCKS)
    texts = F.transform(
        F.filter(blocks, lambda b: (b.type == "text") & b.text.isNotNull()), lambda b: b.text
    )
    return F.coalesce(texts, F.array_compact(F.array(_text(leaf))))


# ------------------------------------------------------------------- format B
TRANSCRIPT_SHAPE = (
    "struct<"
    + _leaves(
        *"type subtype sessionId session_id uuid timestamp isMeta isCompactSummary forkedFrom".split(),
        *"interruptedMessageId isAbortedMidStream operation durationMs".split(),
        *"pendingBackgroundAgentCount pendingWorkflowCount origin toolUseResult".split(),
    )
    + ",message:struct<"
    + _leaves("id", "model", "stop_reason", "content")
    + ",usage:struct<"
    + _leaves(*_USAGE.values(), "iterations")
    + ">>,attachment:struct<"
    + _leaves("type", "commandMode", "prompt")
    + ">>"
)
_TOOL_SHAPE = "struct<" + _leaves("status", "agentId", "resumedAgentId", "success", "totalDurationMs") + ">"


def parse_transcript(lines: DataFrame, horizon_us=None) -> DataFrame:
    """Transcript records from ``value`` lines with ``session_id`` and ``ord``.

    JSON is parsed once per line, which also refuses repeated keys. Stamps past
    ``horizon_us`` are unknown.
    """
    s, m, use = F.col("s"), F.col("s.message"), F.col("s.message.usage")
    rows = lines.withColumn("s", laid_out("value", TRANSCRIPT_SHAPE))
    # Tool results are objects on a minority of lines.
    tool = F.col("tool")
    rows = rows.withColumn(
        "tool", F.when(F.col("s.toolUseResult").isNotNull(), F.try_variant_get("s.toolUseResult", "$", _TOOL_SHAPE))
    )
    stamp = g.rfc3339_us(F.col("stamp_text"))
    if horizon_us is not None:
        stamp = g.not_future(stamp, horizon_us)
    rows = rows.withColumns(
        {"type": _text(s.type), "named": _text(s.sessionId), "stamp_text": _text(s.timestamp), "attached": _text(s.attachment.type)}
    )
    identity = (
        F.when(s.sessionId.isNull(), "absent")
        .when(F.col("named") == F.col("session_id").cast("string"), "match")
        .otherwise("mismatch")
    )
    iterations = F.transform(
        F.try_variant_get(use.iterations, "$", f"array<{_ITERATION}>"),
        lambda i: F.struct(i.type.alias("type"), *[i.getField(k).alias(n) for n, k in _USAGE.items()]),
    )
    user, queued = F.col("type") == "user", F.coalesce(F.col("attached") == "queued_command", F.lit(False))
    texts = F.when(user, _texts(m.content)).when(queued, _texts(s.attachment.prompt))
    off = (F.schema_of_variant(s.isCompactSummary) == "BOOLEAN") & ~_true(s.isCompactSummary)
    no_id = lambda leaf: _set(leaf) & g.safe_id(_text(leaf), 128).isNull()
    pending = lambda leaf: leaf.isNotNull() & ~_count(leaf).eqNullSafe(F.lit(0))
    stop = m.stop_reason
    return rows.select(
        "session_id",
        "ord",
        s.isNull().alias("unreadable"),
        stamp.alias("stamp"),
        "type",
        _text(s.subtype).alias("subtype"),
        F.when(s.isNotNull(), identity).otherwise("absent").alias("identity"),
        _text(F.col("s.session_id")).alias("named_session"),
        _text(s.uuid).alias("uuid"),
        _set(s.forkedFrom).alias("forked"),
        _true(s.isMeta).alias("meta"),
        (_set(s.isCompactSummary) & ~F.coalesce(off, F.lit(False))).alias("summary"),
        m.isNotNull().alias("has_message"),
        _text(m.id).alias("message_id"),
        _text(m.model).alias("model"),
        _text(stop).alias("stop_reason"),
        F.coalesce(F.is_variant_null(stop) | (F.schema_of_variant(stop) == "STRING"), F.lit(False)).alias("stop_present"),
        *[_count(use.getField(k)).alias(n) for n, k in _USAGE.items()],
        iterations.alias("iterations"),
        (_set(use.iterations) & F.try_variant_get(use.iterations, "$", "array<variant>").isNull()).alias("iterations_bad"),
        texts.alias("texts"),
        F.when(
            _set(s.origin), F.coalesce(_text(F.try_variant_get(s.origin, "$.kind", "variant")), F.lit("other"))
        ).alias("origin"),
        _set(s.toolUseResult).alias("tool"),
        _text(tool.status).alias("tool_status"),
        _text(tool.agentId).alias("agent_id"),
        no_id(tool.agentId).alias("agent_bad"),
        _text(tool.resumedAgentId).alias("resumed_id"),
        no_id(tool.resumedAgentId).alias("resumed_bad"),
        _true(tool.success).alias("success"),
        _count(tool.totalDurationMs).isNotNull().alias("tool_timed"),
        _set(s.interruptedMessageId).alias("interrupted"),
        _true(s.isAbortedMidStream).alias("aborted_stream"),
        queued.alias("queued"),
        _text(s.attachment.commandMode).alias("mode"),
        _text(s.operation).alias("operation"),
        _count(s.durationMs).alias("duration_ms"),
        (pending(s.pendingBackgroundAgentCount) | pending(s.pendingWorkflowCount)).alias("pending_work"),
    )


def transcript_records(parsed: DataFrame) -> DataFrame:
    """Records every usage, child and turn operator reads, one per line.

    A line that is no JSON object poisons its session like a foreign record.
    """
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = parsed.withColumns(
        {
            "text": F.when(F.size("texts") > 0, F.element_at("texts", 1)),
            "blocks": F.size("texts"),
            "any_interrupt": no(F.exists("texts", lambda t: t.isin(*cl.INTERRUPTS))),
        }
    )
    rows = cl.classify_text(rows, "text", "blocks")
    rows = rows.withColumns(
        {
            "kind": g.enum_guard(c("type"), ["assistant", "user", "attachment", "system", "queue-operation"]),
            "interrupt": no(c("type") == "user") & c("any_interrupt"),
            "interrupted": c("interrupted"),
            "aborted": no(c("type") == "assistant") & c("aborted_stream"),
            "origin": F.when(c("type") == "user", c("origin")),
            "tool": no(c("type") == "user") & c("tool"),
        }
    )
    rows = cl.classify_turn_role(rows)
    user = no(c("kind") == "user")
    a = c("kind") == "assistant"
    message = F.when(a, g.safe_id(c("message_id"), 128))
    synthetic = no(a & (c("model") == "<synthetic>"))
    broken = no(a & (~c("has_message") | message.isNull() | c("stamp").isNull() | ~c("stop_present") | c("iterations_bad")))
    launch = user & no(c("tool_status") == "async_launched")
    sync = user & ~launch & c("tool_timed")
    agent = g.safe_id(c("agent_id"), 128)
    resumed = F.when(c("success"), g.safe_id(c("resumed_id"), 128))
    note = (user & no(c("origin") == "task-notification")) | (
        no(c("kind") == "attachment") & c("queued") & no(c("mode") == "task-notification")
    )
    child = (
        F.when(launch | sync, F.sha2(agent, 256))
        .when(user & resumed.isNotNull(), F.sha2(resumed, 256))
        .when(note, c("task"))
    )
    event = (
        F.when(launch & agent.isNotNull(), "launch")
        .when(sync & agent.isNotNull(), "sync")
        .when(user & resumed.isNotNull(), "resume")
        .when(note, c("task_status"))
    )
    child_lost = (
        (user & c("tool") & ((c("agent_bad") & (launch | sync)) | c("resumed_bad"))) | (note & c("task").isNull())
    )
    masks = (
        (user & no(c("tool_status").isin(*cl.SPAWNS)))
        | (user & resumed.isNotNull())
        | (note & no(c("task_status") == "unknown"))
    )
    top = F.struct("input", "output", "cache_read", "cache_write")
    ended = no((c("kind") == "system") & (c("subtype") == "turn_duration"))
    return rows.select(
        "session_id", "ord", "stamp", "kind",
        (broken | no(c("identity") == "absent") & c("kind").isNotNull()).alias("bad"),
        (c("forked") & no(c("identity") == "match")).alias("forked"),
        synthetic.alias("synthetic"),
        (c("unreadable") | no(c("identity") == "mismatch")).alias("mismatch"),
        message.alias("message_id"),
        *[F.when(a, c(n)).alias(n) for n in ("input", "output", "cache_read", "cache_write")],
        F.when(a, cl.select_iteration(F.coalesce("iterations", F.array().cast("array<struct<type:string,input:bigint,output:bigint,cache_read:bigint,cache_write:bigint>>")), top)).alias("selected"),
        F.when(a & c("stop_reason").isNotNull(), F.when(c("stop_reason").isin("end_turn", "tool_use"), c("stop_reason")).otherwise("other")).alias("stop"),
        F.when(a, g.safe_model(c("model"))).alias("model"),
        F.when(c("kind") == "system", c("subtype")).alias("subtype"),
        (no(a) & cl.has_compaction(c("iterations"))).alias("compaction_iteration"),
        child.alias("child_key"),
        F.when(child.isNotNull(), event).alias("child_event"),
        child_lost.alias("child_lost"),
        "role",
        F.when(c("role") == "trigger", F.when(g.safe_id(c("uuid"), 128).isNotNull(), turn_key(c("session_id"), c("uuid")))).alias("key"),
        ((c("role") == "trigger") & ((user & no(c("origin") != "human")) | no(c("kind") == "attachment"))).alias("injected"),
        (user & no(c("lead") == "command-name")).alias("command"),
        no(a & c("stop_reason").isNotNull() & (c("stop_reason") != "tool_use")).alias("final_stop"),
        no(c("lead").isin("local-command-stdout", "local-command-stderr")).alias("local_output"),
        no((c("kind") == "system") & (c("subtype") == "local_command")).alias("local_command"),
        (no(c("kind") == "attachment") & c("queued") & no(c("mode") == "prompt")).alias("prompt"),
        no(c("operation").isin("dequeue", "remove")).alias("take"),
        F.when(ended, c("duration_ms")).alias("elapsed_ms"),
        (ended & c("pending_work")).alias("background"),
        masks.alias("masks"),
    )


# ------------------------------------------------------------------- format A
ROLLOUT_SHAPE = (
    "struct<"
    + _leaves("type", "timestamp")
    + ",payload:struct<"
    + _leaves("type", "turn_id", "started_at", "completed_at")
    + ",info:struct<"
    + _leaves("model_context_window")
    + ",last_token_usage:struct<"
    + _leaves("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "total_tokens")
    + ">,total_token_usage:struct<"
    + _leaves("input_tokens", "output_tokens", "cached_input_tokens")
    + ">>>>"
)


def parse_rollout(lines: DataFrame) -> DataFrame:
    """Rollout records with the columns the format A operators read."""
    s, p = F.col("s"), F.col("s.payload")
    last, total = F.col("s.payload.info.last_token_usage"), F.col("s.payload.info.total_token_usage")
    rows = lines.withColumn("s", laid_out("value", ROLLOUT_SHAPE)).withColumns(
        {"outer": _text(F.col("s.type")), "inner": _text(F.col("s.payload.type")), "turn": _text(F.col("s.payload.turn_id"))}
    )
    event, inner = F.coalesce(F.col("outer") == "event_msg", F.lit(False)), F.col("inner")
    ends = event & inner.isin("task_complete", "turn_aborted")
    no = lambda x: F.coalesce(x, F.lit(False))
    return rows.select(
        "session_id",
        "ord",
        s.isNull().alias("unreadable"),
        g.rfc3339_us(_text(s.timestamp)).alias("stamp"),
        F.when(event, inner).otherwise(F.col("outer")).alias("a_type"),
        p.info.isNotNull().alias("has_info"),
        last.isNotNull().alias("has_last"),
        _count(last.input_tokens).alias("input"),
        _count(last.output_tokens).alias("output"),
        _count(last.cached_input_tokens).alias("cache_read"),
        _count(last.cache_write_input_tokens).alias("cache_write"),
        _count(last.total_tokens).alias("context"),
        _count(total.input_tokens).alias("t_input"),
        _count(total.output_tokens).alias("t_output"),
        _count(total.cached_input_tokens).alias("t_cache_read"),
        _count(p.info.model_context_window).alias("window"),
        no(event & (inner == "task_started")).alias("opens"),
        no(ends).alias("closes"),
        F.when(g.safe_id(F.col("turn"), 128).isNotNull(), turn_key(F.col("session_id"), F.col("turn"))).alias("key"),
        _count(p.started_at).alias("start"),
        F.when(ends, _count(p.completed_at)).alias("end"),
        F.when(ends, F.when(inner == "turn_aborted", "aborted").otherwise("completed")).alias("outcome"),
    )


_CHILD_SHAPE = (
    "struct<"
    + _leaves("type")
    + ",payload:struct<"
    + _leaves("type", "thread_id", "completed_at_ms", "occurred_at_ms", "agent_path", "kind")
    + ",item:struct<"
    + _leaves("type", "agent_path", "kind")
    + ">>>"
)
#: What a child record says and the event it is.
CHILD_KINDS = {
    "started": "launch",
    "interacted": "resume",
    "completed": "completed",
    "interrupted": "interrupted",
    "errored": "errored",
    "failed": "errored",
}
CHILD_ROOT = "/root/"


def read_rollout_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every rollout log under ``path``, one log a file; the session id stands behind the
    time in its name, where there is one."""
    return read_session_log(spark, path, "A", r"rollout-(?:[0-9-]{10}T[0-9-]{8}-)?([A-Za-z0-9_-]+)\.jsonl$")


def rollout_children(lines: DataFrame, now_us: int) -> DataFrame:
    """Child events of rollout logs, one row per line that has one or breaks the roster, and the
    first line of each log so that logs without children are there too.

    ``child_lost`` marks lines after which the roster is unknown: unreadable ones, and events
    whose path, kind, time or thread cannot be trusted. The rest have ``child_key``,
    ``child_event`` and ``child_stamp``; use :func:`child_outcomes` with ``strict``.
    """
    s, p, item = F.col("s"), F.col("s.payload"), F.col("s.payload.item")
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = lines.withColumn("s", laid_out("value", _CHILD_SHAPE)).withColumn("inner", F.when(_text(s.type) == "event_msg", _text(p.type)))
    done = no((F.col("inner") == "item_completed") & (_text(item.type) == "SubAgentActivity"))
    live = no(F.col("inner") == "sub_agent_activity")
    rows = rows.select(
        "session_id", "ord", s.isNull().alias("unreadable"), (done | live).alias("event"),
        (done & ~no(_text(p.thread_id) == F.col("session_id").cast("string"))).alias("foreign"),
        F.when(done, _text(item.agent_path)).otherwise(_text(p.agent_path)).alias("path"),
        F.when(done, _text(item.kind)).otherwise(_text(p.kind)).alias("what"),
        (F.when(done, _count(p.completed_at_ms)).otherwise(_count(p.occurred_at_ms)) * 1000).alias("at"),
    )
    names = F.split(F.substring("path", F.lit(len(CHILD_ROOT) + 1), F.length("path")), "/")
    good = (
        ~F.col("foreign")
        & no(F.col("path").startswith(CHILD_ROOT) & (F.octet_length("path") <= 512))
        & no(F.forall(names, lambda n: g.safe_id(n, 512).isNotNull()))
        & no(F.col("what").isin(*CHILD_KINDS))
        & no(F.col("at").between(1, now_us))
    )
    events = F.create_map(*[F.lit(x) for pair in CHILD_KINDS.items() for x in pair])
    rows = rows.withColumn("good", F.col("event") & good)
    child = rows.filter("event OR unreadable").select(
        "session_id", "ord",
        F.when(F.col("good"), F.sha2("path", 256)).alias("child_key"),
        F.when(F.col("good"), events[F.col("what")]).alias("child_event"),
        F.when(F.col("good"), F.col("at")).alias("child_stamp"),
        (~F.col("good")).alias("child_lost"),
    )
    none = F.lit(None).cast
    heads = lines.groupBy("session_id").agg(F.min("ord").alias("ord")).select(
        "session_id", "ord", none("string").alias("child_key"), none("string").alias("child_event"),
        none("long").alias("child_stamp"), F.lit(False).alias("child_lost"),
    )
    fixed = {n: F.lit(False) for n in ("bad", "forked", "mismatch")}
    return child.unionByName(heads).withColumns({"kind": F.lit("event"), **fixed})


# -------------------------------------------------------------- whole-file rules
def verify_header(lines: DataFrame, fmt: str = "B", limit: int | None = None) -> DataFrame:
    """Keep logs whose first line names the session and, where ``limit`` is
    given, has no more bytes."""
    first = lines.groupBy("file", "session_id").agg(F.min_by("value", "ord").alias("_h"))
    if fmt == "A":
        ok = (F.get_json_object("_h", "$.type") == "session_meta") & (
            F.get_json_object("_h", "$.payload.id") == F.col("session_id")
        )
    else:
        ok = F.get_json_object("_h", "$.sessionId") == F.col("session_id")
    if limit is not None:
        ok = ok & (F.octet_length("_h") <= limit)
    good = first.filter(ok).select("file")
    return lines.join(good, "file", "left_semi")


def unique_binding(files: DataFrame) -> DataFrame:
    """Sessions with exactly one file; none or several is unknown."""
    return (
        files.groupBy("session_id")
        .agg(F.count_distinct("file").alias("files"), F.max("file").alias("file"))
        .filter("files = 1")
        .select("session_id", "file")
    )


def file_heads(records: DataFrame, bound: int | None = None) -> DataFrame:
    """What the records of a file, or the first ``bound`` of them where that is
    given, say about another session.

    Input: dir, session_id, ord, modified, named, malformed. State is
    ``named`` with the first name, ``unknown`` when a malformed record comes
    first or the bound runs out, and ``ended`` when the file stops before.
    """
    head = records
    if bound is not None:
        w = Window.partitionBy("dir", "session_id").orderBy("ord")
        head = records.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= bound)
    speaks = F.col("malformed") | F.col("named").isNotNull()
    agg = head.groupBy("dir", "session_id").agg(
        F.min_by(F.struct("malformed", "named"), F.when(speaks, F.col("ord"))).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
    )
    modified = records.groupBy("dir", "session_id").agg(F.max("modified").alias("modified"))
    silent = F.lit("ended") if bound is None else F.when(F.col("_n") < bound, "ended").otherwise("unknown")
    state = (
        F.when(F.col("_s").isNull(), silent)
        .when(F.col("_s.malformed"), "unknown")
        .otherwise("named")
    )
    return agg.join(modified, ["dir", "session_id"]).select(
        "dir", "session_id", "modified", state.alias("state"), F.when(state == "named", F.col("_s.named")).alias("named")
    )


PARTS = 32  # of a directory's files


def predecessor_check(heads: DataFrame) -> DataFrame:
    """Verdict per file: ``unknown`` when a file of the directory at least as
    new names this session or cannot be read, ``growing`` when one has named
    nothing yet, else ``clear``.

    Only each directory's newest two candidates per state matter (one of them
    may be the file itself), so no pairs of files are formed. They are one row a
    directory, repeated for each of ``PARTS`` parts of its files, so that a
    directory of any size is spread.
    """
    c = F.col
    naming = (
        heads.filter((c("state") == "named") & (c("named") != c("session_id")))
        .groupBy("dir", c("named").alias("session_id"))
        .agg(F.max("modified").alias("_by"))
    )
    # The group limit runs before the shuffle: two rows per task, directory and state.
    w = Window.partitionBy("dir", "state").orderBy(c("modified").desc(), "session_id")
    held = lambda state, r: (c("state") == state) & (c("_r") == r)
    top = (
        heads.filter(c("state").isin("unknown", "ended"))
        .withColumn("_r", F.row_number().over(w))
        .filter(c("_r") <= 2)
        .groupBy("dir")
        .agg(*[F.max(F.when(held(s, r), F.struct("session_id", "modified"))).alias(f"{s}{r}") for s in ("unknown", "ended") for r in (1, 2)])
    )
    top = top.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def newest(state):
        return F.when(c(f"{state}1.session_id") != c("session_id"), c(f"{state}1.modified")).otherwise(
            c(f"{state}2.modified")
        )

    salted = heads.join(naming, ["dir", "session_id"], "left").withColumn("_salt", F.pmod(F.hash("session_id"), F.lit(PARTS)))
    j = salted.join(top, ["dir", "_salt"], "left")
    no = lambda x: F.coalesce(x, F.lit(False))
    m = c("modified")
    verdict = (
        F.when(no(c("_by") >= m) | no(newest("unknown") >= m), "unknown")
        .when(no(newest("ended") >= m), "growing")
        .otherwise("clear")
    )
    return j.select("dir", "session_id", verdict.alias("verdict"))
