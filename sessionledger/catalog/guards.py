"""Guard and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import F0_SQL, F1_SQL, NOW_US, f0, f1, table, with_ctes
from ..functions import guards as g
from ..functions import labels as lb
from ..functions import scalars as sc
from .registry import query

SAFE = g.SAFE


def cols(df, *keep, **made):
    return df.select(*keep, *[c.alias(n) for n, c in made.items()])


# ------------------------------------------------------------------- numbers
_COUNTER_TEXT = """CASE ord % 9 WHEN 0 THEN CAST(k AS {s}) WHEN 1 THEN concat('-', CAST(k AS {s})) WHEN 2 THEN '1e5'
  WHEN 3 THEN 'true' WHEN 4 THEN '4.0' WHEN 5 THEN '99999999999999999' WHEN 6 THEN '9007199254740991'
  WHEN 7 THEN '9007199254740992' ELSE concat(' ', CAST(k AS {s})) END"""


@query(
    "safe_counter",
    with_ctes(
        F0_SQL,
        f"x AS (SELECT ord, {_COUNTER_TEXT.format(s='VARCHAR')} AS t FROM f0)",
        f"""y AS (SELECT ord, t, CASE WHEN regexp_full_match(t, '0|[1-9][0-9]{{0,15}}') THEN TRY_CAST(t AS BIGINT) END AS v FROM x)""",
        body=f"SELECT ord, CASE WHEN v <= {SAFE} THEN v END AS counter, CASE WHEN v <= 50 THEN v END AS small FROM y",
    ),
)
def _(spark, d):
    t = f0(spark, d).select("ord", F.expr(_COUNTER_TEXT.format(s="STRING")).alias("t"))
    return cols(t, "ord", counter=g.safe_counter(F.col("t")), small=g.safe_counter(F.col("t"), 50))


@query(
    "enum_guard",
    with_ctes(
        F1_SQL,
        body="SELECT ord, CASE WHEN kind IN ('assistant','system') THEN kind END AS kind, CASE WHEN stop IN ('end_turn','tool_use') THEN stop END AS stop FROM f1",
    ),
)
def _(spark, d):
    return cols(
        f1(spark, d),
        "ord",
        kind=g.enum_guard(F.col("kind"), ["assistant", "system"]),
        stop=g.enum_guard(F.col("stop"), ["end_turn", "tool_use"]),
    )


_TOOL = """CASE k % 6 WHEN 0 THEN 'Bash' WHEN 1 THEN 'mcp__files' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN event_type ELSE 'grep' END"""


@query(
    "normalise_tool",
    with_ctes(
        F0_SQL,
        f"x AS (SELECT ord, {_TOOL} AS t FROM f0)",
        body="""SELECT ord, CASE WHEN t IS NULL OR t = '' THEN NULL WHEN t IN ('Bash', 'grep') THEN t
  WHEN t LIKE 'mcp%' THEN 'mcp-tool' ELSE 'custom-tool' END AS tool FROM x""",
    ),
)
def _(spark, d):
    return cols(f0(spark, d).select("ord", F.expr(_TOOL).alias("t")), "ord", tool=g.normalise_tool(F.col("t")))


_MODEL = """CASE p_partkey % 7 WHEN 0 THEN replace(p_name, ' ', '/') WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name
  WHEN 3 THEN replace(p_name, ' ', '..') WHEN 4 THEN concat('a', ':/', replace(p_name, ' ', '')) WHEN 5 THEN concat(replace(p_name, ' ', '/'), '/x')
  ELSE concat(repeat('m', 60), replace(p_name, ' ', '.')) END"""


@query(
    "safe_model",
    f"""WITH x AS (SELECT p_partkey, {_MODEL} AS m FROM part) SELECT p_partkey,
  CASE WHEN regexp_full_match(m, '[A-Za-z0-9][A-Za-z0-9_.:-]*(/[A-Za-z0-9][A-Za-z0-9_.:-]*)?') AND strlen(m) <= 64
    AND NOT contains(m, '..') AND NOT contains(m, ':/') THEN m END AS model FROM x""",
)
def _(spark, d):
    return cols(
        table(spark, d, "part").select("p_partkey", F.expr(_MODEL).alias("m")),
        "p_partkey",
        model=g.safe_model(F.col("m")),
    )


_ID = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') WHEN 2 THEN replace(c_name, '#', '-') ELSE '' END"


@query(
    "safe_id",
    f"""WITH x AS (SELECT c_custkey, {_ID} AS i FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(i, '[A-Za-z0-9_-]+') AND length(i) <= 128 THEN i END AS id,
 CASE WHEN regexp_full_match(i, '[A-Za-z0-9_-]+') AND length(i) <= 10 THEN i END AS short_id FROM x""",
)
def _(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.expr(_ID).alias("i"))
    return cols(x, "c_custkey", id=g.safe_id(F.col("i"), 128), short_id=g.safe_id(F.col("i"), 10))


@query(
    "hex_id",
    """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(sha256(c_name)) WHEN c_custkey % 3 = 1 THEN substr(sha256(c_name), 1, 24)
  ELSE sha256(c_name) END AS h FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(h, '[0-9a-f]{64}') THEN h END AS full_key,
  CASE WHEN regexp_full_match(h, '[0-9a-f]{24}') THEN h END AS turn_key FROM x""",
)
def _(spark, d):
    h = F.sha2("c_name", 256)
    x = table(spark, d, "customer").select(
        "c_custkey",
        F.expr("c_custkey % 3").alias("m"),
        h.alias("h0"),
    )
    x = x.withColumn(
        "h",
        F.when(F.col("m") == 0, F.upper("h0")).when(F.col("m") == 1, F.substring("h0", 1, 24)).otherwise(F.col("h0")),
    )
    return cols(x, "c_custkey", full_key=g.hex_id(F.col("h"), 64), turn_key=g.hex_id(F.col("h"), 24))


# ---------------------------------------------------------------------- text
@query(
    "clean_text",
    r"""SELECT doc_id, substr(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), 1, 160) AS title FROM documents""",
)
def _(spark, d):
    return cols(table(spark, d, "documents"), "doc_id", title=g.clean_text(F.col("text"), "Untitled"))


_PATH = """CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('/home/', substr(url, 9), '/') WHEN 2 THEN concat('/srv/../', url)
  WHEN 3 THEN concat('/work/', replace(url, ':', '')) ELSE concat('/', repeat('x', 90)) END"""


@query(
    "path_leaf",
    f"""WITH x AS (SELECT page_id, {_PATH} AS p FROM pages), y AS (SELECT page_id, p, p LIKE '/%' AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AS ok,
  list_last(string_split(rtrim(p, '/'), '/')) AS leaf FROM x)
SELECT page_id, CASE WHEN ok THEN substr(leaf, 1, 80) ELSE '' END AS leaf FROM y""",
)
def _(spark, d):
    x = table(spark, d, "pages").select("page_id", F.expr(_PATH).alias("p"))
    return cols(x, "page_id", leaf=g.path_leaf(F.col("p")))


@query(
    "bounded_label",
    r"""SELECT conv_id, turn, CASE WHEN length(text) BETWEEN 1 AND 80 AND NOT regexp_matches(text, '[\x00-\x1f\x7f-\x{9f}]') THEN text END AS short_label,
 CASE WHEN length(text) BETWEEN 1 AND 200 AND NOT regexp_matches(text, '[\x00-\x1f\x7f-\x{9f}]') THEN length(text) END AS n FROM conversations""",
)
def _(spark, d):
    x = table(spark, d, "conversations")
    return cols(
        x,
        "conv_id",
        "turn",
        short_label=g.bounded_label(F.col("text"), 80),
        n=F.length(g.bounded_label(F.col("text"), 200)).cast("long"),
    )


_MAIL = """CASE doc_id % 6 WHEN 0 THEN concat('u', CAST(doc_id AS {s}), '@', source, '.org') WHEN 1 THEN concat('u@', source) WHEN 2 THEN 'a b@c.d'
  WHEN 3 THEN concat('<', source, '@x.y>') WHEN 4 THEN concat('a@b@', source, '.z') ELSE substr(text, 1, 40) END"""


@query(
    "valid_email",
    f"""WITH x AS (SELECT doc_id, {_MAIL.format(s='VARCHAR')} AS m FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(m, '[^@\\s<>]+@[^@\\s<>]+\\.[^@\\s<>.]+') AND length(m) <= 254 THEN m END AS email FROM x""",
)
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.expr(_MAIL.format(s="STRING")).alias("m"))
    return cols(x, "doc_id", email=g.valid_email(F.col("m")))


_STAMP_S = """CASE ord % 8 WHEN 0 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") WHEN 1 THEN date_format(t, "yyyy-MM-dd HH:mm:ss.SSS'+02:30'")
  WHEN 2 THEN date_format(t, "yyyy-MM-dd't'HH:mm:ss'-11:00'") WHEN 3 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
  WHEN 4 THEN date_format(t, "yyyy-'02-30T'HH:mm:ss'Z'") WHEN 5 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss.'z'") WHEN 6 THEN '1969-12-31T23:59:59Z'
  ELSE date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'789z'") END"""


@query(
    "rfc3339_us",
    with_ctes(
        F0_SQL,
        """x AS (SELECT ord, stamp, stamp // 1000000 * 1000000 AS sec FROM f0)""",
        body="""SELECT ord, CASE ord % 8 WHEN 0 THEN stamp WHEN 1 THEN stamp // 1000 * 1000 - 9000000000 WHEN 2 THEN sec + 39600000000
  WHEN 7 THEN stamp END AS us FROM x""",
    ),
)
def _(spark, d):
    x = f0(spark, d).select("ord", F.timestamp_micros("stamp").alias("t")).select("ord", F.expr(_STAMP_S).alias("s"))
    return cols(x, "ord", us=g.rfc3339_us(F.col("s")))


@query(
    "reject_future",
    with_ctes(
        F0_SQL,
        body=f"""SELECT ord, CASE WHEN stamp <= {NOW_US - 10 * 86400000000} THEN stamp END AS usage_stamp,
  CASE WHEN stamp <= {NOW_US - 10 * 86400000000 + 1000000} THEN stamp END AS timing_stamp FROM f0""",
    ),
)
def _(spark, d):
    now = NOW_US - 10 * 86400000000
    s = F.col("stamp")
    return cols(
        f0(spark, d), "ord", usage_stamp=g.not_future(s, now), timing_stamp=g.not_future(s, now, 1_000_000)
    )


# ---------------------------------------------------------------- identities
@query(
    "identity_keys",
    with_ctes(
        F1_SQL,
        """b AS (SELECT ord, session_id, message_id, uuid, sha256('agent' || ':' || 'id' || ':' || session_id) AS bind FROM f1)""",
        body="""SELECT ord, bind, CAST(('0x' || substr(bind, 1, 13)) AS BIGINT) AS generation,
  substr(sha256('turn-v1:' || session_id || ':' || uuid), 1, 24) AS turn_key,
  substr(sha256(message_id), 1, 16) AS group_key, sha256('account-v1:' || session_id) AS account_key,
  sha256('["h' || session_id % 16 || '","ssh"]') AS route_key, CASE WHEN uuid <> 'u-dup' THEN sha256('session-v1:' || uuid) END AS session_key FROM b""",
    ),
)
def _(spark, d):
    x = f1(spark, d)
    sid = F.col("session_id").cast("string")
    bind = sc.session_binding(F.lit("agent"), F.lit("id"), sid)
    host = F.concat(F.lit("h"), (F.col("session_id") % 16).cast("string"))
    return cols(
        x,
        "ord",
        bind=bind,
        generation=sc.generation(bind),
        turn_key=sc.turn_key(sid, F.col("uuid")),
        group_key=F.when(F.col("message_id").isNotNull(), sc.group_key(F.col("message_id"))),
        account_key=sc.account_key(sid),
        route_key=sc.route_key(host, F.lit("ssh")),
        # An id with a dot is not safe.
        session_key=sc.session_key(F.expr("CASE WHEN uuid = 'u-dup' THEN 'u.dup' ELSE uuid END")),
    )


@query(
    "thread_keys",
    """SELECT o_orderkey, o_custkey % 16 || ':' || o_custkey AS thread_key,
  (o_orderkey % 5) || ':' || (o_orderkey % 3) || CASE WHEN o_orderkey % 2 = 0 THEN ':' || o_orderpriority ELSE '' END AS episode FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return cols(
        o,
        "o_orderkey",
        thread_key=sc.thread_key(F.col("o_custkey") % 16, F.col("o_custkey")),
        episode=sc.completion_episode(
            F.col("o_orderkey") % 5, F.col("o_orderkey") % 3, F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END")
        ),
    )


_POOL = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove"]


@query(
    "alias_pick",
    f"""WITH x AS (SELECT c_custkey, c_mktsegment || ':' || c_name AS key FROM customer)
SELECT c_custkey, ({_POOL})[(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS HUGEINT))),
  lambda a, b: (a * 31 + b) % 4294967296) % {len(_POOL)} + 1)::BIGINT] AS alias FROM x""",
)
def _(spark, d):
    key = F.concat_ws(":", "c_mktsegment", "c_name")
    return cols(table(spark, d, "customer"), "c_custkey", alias=sc.alias_pick(key, _POOL))


# --------------------------------------------------------------- ages, ratios
@query(
    "freshness",
    with_ctes(
        F0_SQL,
        f"""x AS (SELECT ord, stamp / 1e6 AS at_s, k, {NOW_US // 1_000_000 - 10 * 86400} - stamp / 1e6 AS age FROM f0),
y AS (SELECT *, CASE WHEN at_s > 0 AND age >= -1 THEN greatest(age, 0.0) END AS a FROM x)""",
        body="""SELECT ord, round(a, 3) AS age, a > 120 AS stale, a > 600 AS quota_stale, greatest(k * 3.0, 12.0)::DOUBLE AS timing_limit,
  CAST(CASE WHEN k BETWEEN 2 AND 60 THEN k ELSE 5 END + 20 AS BIGINT) AS host_limit,
  CAST(CASE WHEN k BETWEEN 1 AND 60 THEN k + 2 ELSE 6 END AS BIGINT) AS receipt_limit FROM y""",
    ),
)
def _(spark, d):
    now = NOW_US // 1_000_000 - 10 * 86400
    age = sc.age_seconds(F.col("stamp") / 1e6, now, 1)
    k = F.col("k")
    return cols(
        f0(spark, d),
        "ord",
        age=F.round(age, 3),
        stale=sc.is_stale(age),
        quota_stale=sc.is_stale(age, sc.QUOTA_FRESH),
        timing_limit=sc.timing_freshness(k).cast("double"),
        host_limit=sc.host_max_age(k).cast("long"),
        receipt_limit=sc.receipt_timeout(k).cast("long"),
    )


@query(
    "ratios",
    with_ctes(
        F1_SQL,
        """x AS (SELECT ord, input + cache_read AS total, cache_read AS cached, input - CASE WHEN k % 3 = 0 THEN cache_write ELSE 0 END AS uncached,
   CASE WHEN k % 4 > 0 THEN cache_write END AS written, input AS context, k * 4 AS win, CASE WHEN k % 5 = 0 THEN k * 2 END AS reported FROM f1),
y AS (SELECT *, coalesce(cached <= total AND uncached <= total - cached AND total - cached - uncached = coalesce(written, 0), false) AS part FROM x)""",
        body="""SELECT ord, round(CASE WHEN part AND total > 0 THEN cached * 100.0 / total END::DOUBLE, 6) AS cache_percent,
 CASE WHEN part THEN uncached END AS uncached,
 CASE WHEN win > 0 AND context <= win THEN round(coalesce(CASE WHEN reported BETWEEN 0 AND 100 THEN reported END, context * 100.0 / win)::DOUBLE, 6) END AS view_percent,
 CASE WHEN win > 0 AND context <= win THEN (context * 100 + win // 2) // win END AS percent_b,
 CAST(CASE WHEN win * 100 > 0 AND context * 80 <= win * 100 THEN CASE WHEN win * 100 <= 12000 THEN 100 ELSE
   100 - round(greatest(win * 100 - 12000 - greatest(context * 80 - 12000, 0), 0) * 100.0 / (win * 100 - 12000)) END END AS BIGINT) AS percent_a FROM y""",
    ),
)
def _(spark, d):
    from ..operators.usage import context_percent_a, context_percent_b

    x = f1(spark, d).selectExpr(
        "ord",
        "input + cache_read AS total",
        "cache_read AS cached",
        "input - CASE WHEN k % 3 = 0 THEN cache_write ELSE 0 END AS uncached",
        "CASE WHEN k % 4 > 0 THEN cache_write END AS written",
        "input AS context",
        "k * 4 AS win",
        "CASE WHEN k % 5 = 0 THEN k * 2 END AS reported",
    )
    part = [F.col(n) for n in ("total", "cached", "uncached", "written")]
    c, w = F.col("context"), F.col("win")
    return cols(
        x,
        "ord",
        cache_percent=F.round(sc.cache_percent(*part), 6),
        uncached=sc.uncached_view(*part),
        view_percent=F.round(sc.context_percent_view(c, w, F.col("reported")), 6),
        percent_b=context_percent_b(c, w),
        percent_a=context_percent_a(c * 80, w * 100),
    )


# ---------------------------------------------------------------- turn scalars
@query(
    "turn_readings",
    with_ctes(
        F1_SQL,
        f"""x AS (SELECT ord, CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END AS active, k % 2 = 0 AS stale,
  CASE WHEN k % 5 > 0 THEN stamp // 1000000 END AS started, stamp // 1000000 + k AS observed, k AS last, k % 7 > 0 AS complete, k * 3 AS total, stamp FROM f1),
y AS (SELECT *, CASE WHEN active AND started IS NOT NULL THEN greatest(CASE WHEN stale THEN observed ELSE {NOW_US // 1000000} END - started, 0)
   WHEN NOT active THEN last END AS elapsed FROM x)""",
        body="""SELECT ord, elapsed, CASE WHEN complete THEN total + CASE WHEN active THEN coalesce(elapsed, 0) ELSE 0 END END AS total,
 coalesce(abs(CAST(floor((stamp - last * 100000) / 1000000.0) AS BIGINT) - started) <= 2 AND CAST(floor((stamp - last * 100000) / 1000000.0) AS BIGINT) + 2 >= started - 1, false) AS implied_ok FROM y""",
    ),
)
def _(spark, d):
    x = f1(spark, d).selectExpr(
        "ord",
        "CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END AS active",
        "k % 2 = 0 AS stale",
        "CASE WHEN k % 5 > 0 THEN stamp div 1000000 END AS started",
        "stamp div 1000000 + k AS observed",
        "k AS last",
        "k % 7 > 0 AS complete",
        "k * 3 AS total",
        "stamp",
    )
    c = F.col
    elapsed = sc.turn_elapsed(c("active"), c("stale"), c("started"), c("observed"), c("last"), NOW_US // 1000000)
    return cols(
        x,
        "ord",
        elapsed=elapsed,
        total=sc.turn_total(c("complete"), c("total"), c("active"), elapsed),
        implied_ok=sc.implied_start_ok(c("stamp"), c("last") * 100, c("started"), c("started") - 1),
    )


@query(
    "next_change_at",
    with_ctes(
        F0_SQL,
        """x AS (SELECT ord, k, list_filter([stamp // 1000000, stamp // 1000000 + 120, stamp // 1000000 + k * 86400], lambda t: t > 1705276800) AS l FROM f0)""",
        body="SELECT ord, CASE WHEN len(l) > 0 THEN list_min(l) END AS next_at FROM x",
    ),
)
def _(spark, d):
    s = F.expr("stamp div 1000000")
    return cols(
        f0(spark, d), "ord", next_at=sc.next_change_at(1705276800, s, s + 120, s + F.col("k") * 86400)
    )


# -------------------------------------------------------------------- labels
@query(
    "report_labels",
    with_ctes(
        F0_SQL,
        """x AS (SELECT ord, k, event_type, stamp // 1000000 % (k * k * 60 + 1) AS s, stamp // 1000000 % 100 * CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 1037 ELSE 10370001 END AS n,
  CASE WHEN k % 9 = 0 THEN NULL ELSE (ord % 1000) / 10.0 - 0.4 END AS pc, CASE WHEN k % 11 = 0 THEN NULL ELSE (ord % 400) / 10.0 - 20 END AS pd FROM f0),
tk AS (SELECT *, CASE WHEN n >= 1000000000 THEN 1000000000 WHEN n >= 1000000 THEN 1000000 ELSE 1000 END AS sc FROM x),
t2 AS (SELECT *, (n * 10 + sc // 2) // sc AS te, CAST(floor(abs(pd) * 10 + 0.5) AS BIGINT) AS pt FROM tk)""",
        body="""SELECT ord, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' ELSE s // 3600 || 'h ago' END AS age,
 CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's'
   ELSE s // 3600 || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS duration,
 s // 86400 || 'd ' || CASE WHEN s < 3600 THEN '<1' ELSE (s % 86400 // 3600)::VARCHAR END || 'h' AS reset,
 CASE WHEN n < 1000 THEN n::VARCHAR ELSE te // 10 || CASE WHEN te % 10 = 0 THEN '' ELSE '.' || te % 10 END
   || CASE sc WHEN 1000 THEN 'K' WHEN 1000000 THEN 'M' ELSE 'B' END END AS tokens,
 CASE WHEN pc IS NULL THEN '—' WHEN pc > 99 AND pc < 100 THEN '>99%' WHEN pc > 0 AND pc < 1 THEN '<1%' ELSE CAST(floor(pc + 0.5) AS BIGINT) || '%' END AS percent,
 CASE WHEN pd IS NULL THEN '—' ELSE CASE WHEN pd > 0 THEN '+' WHEN pd < 0 THEN '−' ELSE '' END || pt // 10 || '.' || pt % 10 || '%' END AS pace,
 CASE event_type WHEN 'view' THEN 'Connected' WHEN 'click' THEN 'Connecting' WHEN 'error' THEN 'Unreachable' ELSE 'Setup needed' END AS connection,
 CASE WHEN k % 5 = 0 THEN 'Turn time unavailable' ELSE CASE WHEN k % 2 = 0 THEN 'Wall-clock turn ' ELSE 'Last wall-clock turn ' END || CASE WHEN k < 60 THEN k || 's' ELSE '1m ' || lpad((k - 60)::VARCHAR, 2, '0') || 's' END
   || CASE WHEN k % 2 = 1 AND k % 3 = 0 THEN ' · interrupted' ELSE '' END || chr(10) || 'Total unavailable' END AS timing,
 k % 4 || ' completed' || CASE WHEN k % 7 = 0 THEN CASE WHEN k % 6 > 0 THEN ' · ' || k % 6 || ' unresolved' ELSE '' END
   ELSE CASE WHEN k % 2 > 0 THEN ' · 1 running' ELSE '' END || CASE WHEN k % 3 > 0 THEN ' · ' || k % 3 || ' unavailable' ELSE '' END END AS children
 FROM t2""",
    ),
)
def _(spark, d):
    x = f0(spark, d).selectExpr(
        "ord",
        "k",
        "event_type",
        "(stamp div 1000000) % (k * k * 60 + 1) AS s",
        "(stamp div 1000000) % 100 * CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 1037 ELSE 10370001 END AS n",
        "CASE WHEN k % 9 = 0 THEN NULL ELSE (ord % 1000) / 10.0D - 0.4D END AS pc",
        "CASE WHEN k % 11 = 0 THEN NULL ELSE (ord % 400) / 10.0D - 20D END AS pd",
    )
    c, k = F.col, F.col("k")
    known = lambda v: F.when(k % 7 != 0, v)
    state = (
        F.when(c("event_type") == "view", "connected")
        .when(c("event_type") == "click", "connecting")
        .when(c("event_type") == "error", "unreachable")
        .otherwise("setup_needed")
    )
    return cols(
        x,
        "ord",
        age=lb.age_label(c("s")),
        duration=lb.duration_label(c("s")),
        reset=lb.reset_label(c("s")),
        tokens=lb.tokens_label(c("n")),
        percent=lb.percent_label(c("pc")),
        pace=lb.pace_label(c("pd")),
        connection=lb.connection_label(state),
        timing=lb.timing_label(
            k % 2 == 0,
            F.when(k % 5 != 0, k),
            F.when(k % 3 == 0, "aborted"),
            F.lit(None).cast("long"),
        ),
        children=lb.child_label(
            k % 4,
            k % 4 + k % 6,
            {"running": known(k % 2), "interrupted": known(k * 0), "failed": known(k * 0), "unknown": known(k % 3)},
        ),
    )
