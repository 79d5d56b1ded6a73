"""Snapshots in pages under a hash tree: page, host, fleet.

A snapshot document holds a whole fleet, so it grows with it. Here an instant
is a table of pages, each with at most ``page`` agents of one host, and a
digest per page, host and instant. Two instants are compared from the top: only
hosts whose digests differ are opened, and of these only pages that differ.

An agent's page is a prefix of the hash of its id, as long as the size of its
host asks for, so an agent that comes or goes leaves all other pages alone
until the host has doubled. The digest of a node is the bitwise xor of the
SHA-256 words of its children, each taken with its place: it is combined before
the shuffle and needs no list, however many children there are. It finds
changes; it is no proof against forgery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import Run, running, scratch_path
from ..plans.scan import CHUNK

PAGE = 1000
FIELDS = ["agent", "status", "project"]
NODE = ["at", "host"]
LEAF = [*NODE, "bits", "page", "part"]
_HASH_BITS = 60
_SALT = 64
_REPEAT = 4096


def _words(*parts: Column) -> Column:
    """Four 64-bit words of a SHA-256 over parts that are told apart."""
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])), 256)
    half = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
    return F.struct(*[(F.shiftleft(half(2 * i), 32).bitwiseOR(half(2 * i + 1))).alias(f"w{i}") for i in range(4)])


def _xor(words: str) -> Column:
    return F.concat_ws(".", *[F.hex(F.bit_xor(F.col(f"{words}.w{i}"))) for i in range(4)])


def paged(agents: DataFrame, page: int = PAGE) -> DataFrame:
    """(at, host, bits, page, part, agents, hash): pages of at most ``page`` rows.

    Input: at, host, agent, status, project; other columns are not read. Equal
    rows are one entry with their number ``n``. A row of no agent names a host,
    which keeps an empty page if it has no others. Hash pages are filled to a
    half at most when the host is laid out; what chance or many entries of one
    agent put in beyond ``page`` goes on in further parts. A NULL host is a
    host of its own.
    """
    rows = agents.groupBy(*NODE, *FIELDS).agg(F.count(F.lit(1)).alias("n"))
    place = F.xxhash64("agent").bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
    rows = rows.withColumns({"_place": place, "_salt": F.pmod(F.xxhash64(*FIELDS), F.lit(_SALT))})
    size = rows.groupBy(*NODE).agg(F.count("agent").alias("_rows"))
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_rows") * 2 / F.lit(page)))).cast("int")
    # One row per host meets all of its agents: dealt over salts, so a hot host is not one task.
    dealt = size.select(
        F.col("at").alias("_at"), F.col("host").alias("_host"), bits.alias("bits"),
        F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)).cast("array<bigint>")).alias("_s"),
    )
    same = F.col("at").eqNullSafe(F.col("_at")) & F.col("host").eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_s"))
    placed = rows.join(dealt, same).withColumn("page", F.expr(f"shiftright(_place, {_HASH_BITS} - bits)"))
    order = Window.partitionBy(*NODE, "bits", "page").orderBy(*FIELDS)
    numbered = placed.withColumn("part", F.floor((F.row_number().over(order) - 1) / F.lit(page)).cast("int"))
    entry = F.when(F.col("agent").isNotNull(), F.struct(*FIELDS, "n"))
    pages = numbered.groupBy(*LEAF).agg(F.array_sort(F.collect_list(entry)).alias("agents"))
    return pages.withColumn("hash", F.sha2(F.to_json("agents"), 256))


def write_paged(agents: DataFrame, path: str, page: int = PAGE, mode: str = "error") -> None:
    """``path/pages``, and from what was written ``path/hosts`` and ``path/fleets``."""
    spark = agents.sparkSession
    paged(agents, page).write.mode(mode).parquet(f"{path}/pages")
    pages = spark.read.parquet(f"{path}/pages")
    leaf = pages.select(*NODE, _words(*[F.col(c) for c in [*LEAF[1:], "hash"]]).alias("_w"), _held().alias("_rows"))
    hosts = leaf.groupBy(*NODE).agg(F.count(F.lit(1)).alias("pages"), F.sum("_rows").cast("bigint").alias("agents"), _xor("_w").alias("hash"))
    hosts.write.mode(mode).parquet(f"{path}/hosts")
    child = spark.read.parquet(f"{path}/hosts").withColumn("_w", _words(F.col("host"), F.col("hash")))
    fleets = child.groupBy("at").agg(F.count(F.lit(1)).alias("hosts"), F.sum("agents").cast("bigint").alias("agents"), _xor("_w").alias("hash"))
    fleets.write.mode(mode).parquet(f"{path}/fleets")


def _held() -> Column:
    return F.aggregate("agents", F.lit(0).cast("bigint"), lambda a, x: a + x.n)


def read_level(spark: SparkSession, path: str, level: str) -> DataFrame:
    """``pages``, ``hosts`` or ``fleets``."""
    return spark.read.parquet(f"{path}/{level}")


def explode_pages(pages: DataFrame) -> DataFrame:
    """One row per agent, repeated as often as it was given; a host without
    agents keeps one row. Repeats are dealt out in slices, never in one list."""
    a = pages.select(*NODE, F.explode_outer("agents").alias("a"))
    n = F.coalesce(F.col("a.n"), F.lit(1).cast("bigint"))
    step = F.lit(_REPEAT).cast("bigint")
    slices = a.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, step)))
    each = slices.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(step, n - F.col("_from")))))
    return each.select(*NODE, *[F.col(f"a.{f}").alias(f) for f in FIELDS])


# ---------------------------------------------------------------- what changed
def instants(fleets: DataFrame) -> DataFrame:
    """(at, prev): every instant with the one before it, NULL for the first."""
    one = fleets.select("at", F.lit(0).alias("_all"))
    return running(one, ["_all"], "at", {"prev": Run("last", F.col("at"), before=True)}).drop("_all", CHUNK)


def _differing(level: DataFrame, opened: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """Nodes of both instants of ``opened`` whose hash the other lacks:
    (at, prev, _of: the instant that holds it, *key)."""
    both = opened.withColumn("_of", F.explode(F.array_compact(F.array("at", "prev"))))
    held = level.withColumnRenamed("at", "_of")
    same = F.col("l._of") == F.col("o._of")
    for c in on:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    nodes = held.alias("l").join(both.alias("o"), same).select("o.at", "o.prev", "l._of", *[f"l.{c}" for c in key], "l.hash")
    # A node that both instants hold alike is there twice, any other once.
    odd = nodes.groupBy("at", "prev", *key, "hash").agg(F.count(F.lit(1)).alias("_n"), F.min("_of").alias("_of"))
    return odd.filter("_n = 1").drop("_n", "hash")


def open_nodes(spark: SparkSession, path: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts and pages that differ within ``pairs`` (at, prev), from the top down.

    Digests alone are read here, no agents. Each level is written, as the next
    one and the caller read it."""
    fleets, hosts, pages = (read_level(spark, path, x) for x in ("fleets", "hosts", "pages"))
    now, old = fleets.select("at", F.col("hash").alias("_now")), fleets.select(F.col("at").alias("prev"), F.col("hash").alias("_old"))
    opened = pairs.join(now, "at").join(old, "prev", "left").filter(~F.col("_now").eqNullSafe(F.col("_old"))).select("at", "prev")
    out = scratch_path(spark, "open")
    _differing(hosts.select(*NODE, "hash"), opened, [], ["host"]).write.parquet(f"{out}/hosts")
    differ = spark.read.parquet(f"{out}/hosts")
    into = differ.select("at", "prev", "host").distinct()
    _differing(pages.select(*LEAF, "hash"), into, ["host"], LEAF[1:]).write.parquet(f"{out}/pages")
    return differ, spark.read.parquet(f"{out}/pages")


def snapshot_changes(spark: SparkSession, path: str, pairs: DataFrame | None = None) -> DataFrame:
    """(at, host, agent, status, project, n_before, n_now): entries that an
    instant and the one before it hold a different number of times.

    ``pairs`` (at, prev) says what to compare, all neighbours by default; with
    a NULL ``prev`` all is new. Agents are read of differing pages only. A host
    without agents has no entries, so its coming and going tells nothing here.
    """
    pairs = instants(read_level(spark, path, "fleets")) if pairs is None else pairs
    _, opened = open_nodes(spark, path, pairs)
    pages = read_level(spark, path, "pages").select(*LEAF, "agents").withColumnRenamed("at", "_of")
    same = F.col("p._of") == F.col("o._of")
    for c in LEAF[1:]:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}"))
    held = pages.alias("p").join(opened.alias("o"), same).select("o.at", "p._of", "p.host", F.explode("p.agents").alias("a"))
    now = F.col("_of") == F.col("at")
    keys = ["at", "host", *FIELDS]
    rows = held.select("at", "_of", "host", *[F.col(f"a.{f}").alias(f) for f in FIELDS], F.col("a.n").alias("n"))
    count = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("bigint")
    return rows.groupBy(*keys).agg(count(~now).alias("n_before"), count(now).alias("n_now")).filter("n_before <> n_now")
