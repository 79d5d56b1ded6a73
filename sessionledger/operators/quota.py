"""Account quota: sanitising, newest observation, public rows and pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as g
from ..functions import scalars as sc

# Plan names a provider reports.
PLANS = [
    "free", "go", "plus", "pro", "prolite", "team", "self_serve_business_prolite",
    "self_serve_business_usage_based", "business", "ent26", "enterprise_cbp_automation",
    "enterprise_cbp_usage_based", "enterprise", "edu", "edu_plus", "edu_pro", "unknown",
]
WEEK_S = 604_800
WEEK_MIN = 10_080
PASS_TYPE = "codexRateLimits"
LIMIT_ID = "codex"


def quota_sanitise(df: DataFrame, now, fresh=sc.QUOTA_FRESH) -> DataFrame:
    """Keep current observations and null what is out of bounds or past.

    A past reset clears the balance and the reset; a past expiry clears the
    pass count and the expiry only.
    """
    c = F.col
    age = F.lit(now) - c("sampled_at")
    rows = df.filter((c("sampled_at") > 0) & age.between(-1, fresh)).withColumns(
        {
            "plan": g.enum_guard(c("plan"), PLANS),
            "weekly_remaining": g.bounded(c("weekly_remaining"), 100),
            "weekly_resets_at": g.bounded(c("weekly_resets_at"), g.SAFE),
            "reset_count": g.bounded(c("reset_count"), 10_000),
            "reset_expires_at": g.bounded(c("reset_expires_at"), g.SAFE),
            "lifetime_tokens": g.bounded(c("lifetime_tokens"), g.SAFE),
            "peak_daily_tokens": g.bounded(c("peak_daily_tokens"), g.SAFE),
        }
    )
    ahead = F.coalesce(c("weekly_resets_at") > F.lit(now), F.lit(False))
    valid = F.coalesce(c("reset_expires_at") > F.lit(now), F.lit(True))
    return rows.withColumns(
        {
            "weekly_remaining": F.when(ahead, c("weekly_remaining")),
            "weekly_resets_at": F.when(ahead, c("weekly_resets_at")),
            "reset_count": F.when(valid, c("reset_count")),
            "reset_expires_at": F.when(valid, c("reset_expires_at")),
        }
    )


def newest_per_account(df: DataFrame, key: str = "account_key", tie: str = "seq") -> DataFrame:
    """Newest observation per account; of equal stamps the first wins."""
    rest = [n for n in df.columns if n != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col("sampled_at"), -F.col(tie)))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def all_observations(cache: DataFrame, remote: DataFrame) -> DataFrame:
    """Cached and remote observations together, repeats kept."""
    return cache.unionByName(remote, allowMissingColumns=True)


def account_rows(accounts: DataFrame, observations: DataFrame) -> DataFrame:
    """One public row per mapped account; without a current observation it is
    unavailable and carries no values. Unmapped observations drop out before
    the newest is chosen."""
    mapped = observations.join(accounts.select("account_key"), "account_key", "left_semi")
    j = accounts.join(newest_per_account(mapped), "account_key", "left")
    have = F.col("sampled_at").isNotNull()
    return j.select(
        "account_key",
        "provider",
        "label",
        F.when(have, "available").otherwise("unavailable").alias("status"),
        "plan",
        "sampled_at",
        "reset_count",
        "reset_expires_at",
        F.when(have, 100 - F.col("weekly_remaining")).alias("used_percent"),
        F.col("weekly_resets_at").alias("resets_at"),
        F.when(have, F.lit(WEEK_S)).cast("long").alias("duration_s"),
    )


def account_view(rows: DataFrame, now, fresh=sc.QUOTA_FRESH) -> DataFrame:
    """Balance, pass count and reset as shown at ``now``."""
    c = F.col
    age = sc.age_seconds(c("sampled_at"), now, 1)
    current = F.coalesce((c("status") == "available") & (age <= fresh), F.lit(False))
    duration_ok = c("duration_s").between(1, 31_622_400)
    used = F.when(current & duration_ok, sc.percent(c("used_percent")))
    reset = F.when(current & duration_ok & (c("resets_at") > F.lit(now)), c("resets_at"))
    balance = F.when(reset.isNotNull(), 100 - used)
    passes = F.when(
        current
        & c("reset_count").between(0, 10_000)
        & F.coalesce(c("reset_expires_at") > F.lit(now), F.lit(True)),
        c("reset_count"),
    )
    expected = sc.time_remaining(reset, c("duration_s"), now)
    reading = sc.pace_reading(balance - expected)
    return rows.select(
        "account_key",
        balance.alias("remaining"),
        expected.alias("time_remaining"),
        reading.alias("pace"),
        sc.pace_band(reading).alias("band"),
        passes.alias("reset_count"),
        reset.alias("reset_at"),
        F.when(reset.isNotNull(), c("duration_s")).alias("duration_s"),
    )


# ---------------------------------------------------------------- raw replies
_WINDOW = "struct<windowDurationMins:string,usedPercent:string,resetsAt:string>"
_BUCKET = f"struct<limitId:string,planType:string,primary:{_WINDOW},secondary:{_WINDOW}>"
REPLY_SCHEMA = (
    f"struct<accountId:string,rateLimitsByLimitId:map<string,{_BUCKET}>,rateLimits:{_BUCKET},"
    "rateLimitResetCredits:struct<availableCount:string,credits:array<struct<id:string,status:string,resetType:string,expiresAt:string>>>,"
    "summary:struct<lifetimeTokens:string,peakDailyTokens:string>,"
    "dailyUsageBuckets:array<struct<startDate:string,tokens:string>>>"
)


def parse_reply(text: Column) -> Column:
    """Numbers stay text, so a boolean or float can be told from an integer."""
    return F.from_json(text, REPLY_SCHEMA)


def read_quota(df: DataFrame, now, limit_id: str = LIMIT_ID) -> DataFrame:
    """Source row of a parsed rate-limit reply ``r``: the named bucket, else the
    default one, and the single seven-day window of its two."""
    r = F.col("r")
    bucket = F.coalesce(F.try_element_at(r.rateLimitsByLimitId, F.lit(limit_id)), r.rateLimits)
    rows = df.withColumn("b", bucket).filter(
        F.col("b").isNotNull() & F.coalesce(F.col("b.limitId") == limit_id, F.lit(True))
        & F.length("r.accountId").between(1, 256)
    )
    week = F.filter(
        F.array("b.primary", "b.secondary"),
        lambda w: F.coalesce(w.windowDurationMins == str(WEEK_MIN), F.lit(False)),
    )
    w = F.when(F.size(week) == 1, F.element_at(week, 1))
    used, reset = g.safe_counter(w.usedPercent, 100), g.safe_counter(w.resetsAt)
    both = used.isNotNull() & (reset > F.lit(now))
    return rows.select(
        "seq",
        F.col("r.accountId").alias("account"),
        sc.account_key(F.col("r.accountId")).alias("account_key"),
        g.enum_guard(F.col("b.planType"), PLANS).alias("plan"),
        F.when(both, 100 - used).alias("weekly_remaining"),
        F.when(both, reset).alias("weekly_resets_at"),
    )


def credits_summary(df: DataFrame, now, pass_type: str = PASS_TYPE) -> DataFrame:
    """Available passes and their earliest expiry, per parsed reply.

    The expiry is known only when the listed passes equal the count, with
    distinct ids and valid expiries; any expired one makes the count unknown.
    """
    credits = F.col("r.rateLimitResetCredits")
    count = g.safe_counter(credits.availableCount, 10_000)
    listed = F.filter(
        credits.credits,
        lambda x: F.coalesce((x.status == "available") & (x.resetType == pass_type), F.lit(False)),
    )
    ids = F.transform(listed, lambda x: x.id)
    times = F.transform(listed, lambda x: g.safe_counter(x.expiresAt))
    sound = (
        (F.size(listed) == count)
        & ~F.exists(ids, lambda i: i.isNull() | (i == ""))
        & (F.size(F.array_distinct(ids)) == F.size(ids))
        & ~F.exists(listed, lambda x: x.expiresAt.isNotNull() & g.safe_counter(x.expiresAt).isNull())
    )
    sound = F.coalesce(sound, F.lit(False))
    known = F.filter(times, lambda t: t.isNotNull())
    expired = sound & F.exists(known, lambda t: t <= F.lit(now))
    return df.select(
        "seq",
        F.when(~expired, count).alias("reset_count"),
        F.when(sound & ~expired, F.array_min(known)).alias("reset_expires_at"),
    )


def daily_usage(df: DataFrame, today: str, k: int = 30, cap: int | None = None) -> DataFrame:
    """Token counts of the last ``k`` distinct days per account.

    One repeated, invalid or future date, or one bad number, makes the whole
    list unknown. Missing days are never filled. Input rows: account_key, date
    and tokens as text. The last days are a group limit applied per task. An
    account of more than ``cap`` rows, where one is given, is unknown too.
    """
    c = F.col
    date = F.when(g.full(c("date"), "[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(c("date"), "yyyy-MM-dd"))
    rows = df.select(
        "account_key",
        F.when((date <= F.lit(today).cast("date")) & (F.year(date) >= 1), date).alias("day"),
        g.safe_counter(c("tokens")).alias("tokens"),
    )
    per_day = rows.groupBy("account_key", "day").agg(
        F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("_bad")
    )
    verdict = per_day.groupBy("account_key").agg(
        F.bool_or((c("n") > 1) | c("day").isNull() | (c("_bad") > 0)).alias("_broken"),
        F.sum("n").alias("_rows"),
    )
    ok = ~c("_broken")
    if cap is not None:
        ok = ok & (c("_rows") <= cap)
    w = Window.partitionBy("account_key").orderBy(c("day").desc())
    kept = per_day.withColumn("_r", F.row_number().over(w)).filter(c("_r") <= k)
    return kept.join(verdict.filter(ok), "account_key", "left_semi").select(
        "account_key", c("day").cast("string").alias("date"), "tokens"
    )


def account_activity(df: DataFrame) -> DataFrame:
    """Lifetime and peak daily tokens of the newest valid observation."""
    rows = df.withColumns(
        {n: g.bounded(F.col(n), g.SAFE) for n in ("lifetime_tokens", "peak_daily_tokens")}
    )
    return newest_per_account(rows).select("account_key", "lifetime_tokens", "peak_daily_tokens")


def top_accounts(df: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` newest observations."""
    return df.orderBy(F.col("sampled_at").desc(), "seq").limit(k)


def account_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("account_key")


def identity_map(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Valid address per mapped account; the last row wins."""
    good = rows.withColumn("email", g.valid_email(F.col("email"))).filter("email IS NOT NULL")
    j = good.join(accounts.select("account_key"), "account_key", "left_semi")
    return j.groupBy("account_key").agg(F.max_by("email", "seq").alias("email"))
