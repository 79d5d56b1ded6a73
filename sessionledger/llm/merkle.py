"""Merkle manifest of a table with nested-interval labels.

Rows are leaves, ranked within their group; a node covers an interval of leaf
ranks. Every ``FAN`` consecutive nodes of a level are a *run* and become the
node above them, until a group has one node, its subroot. The subroots are the
leaves of one more such tree, whose top is the root.

A node lies in the run of the level above whose interval contains its own.
Intervals of level k begin at multiples of ``FAN ** k``, so containment is
equality of (group, bucket) per level. Runs are joined with the run that contains them from
the top downwards and take over its ancestors; a run contains ``FAN`` at most, so
no key of these joins is hot. Siblings are what the intervals of a run's members
leave of its own interval without the node's: those that end before it
begins are on the left, those that begin behind its end on the right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, landed

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: lower-case hex sha256 of the parts set end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def folded(start: Column, proof: Column) -> Column:
    """The root that ``start`` and its siblings give."""
    return F.aggregate(proof, start, lambda h, s: digest(s["left"], h, s["right"]))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` plus ``lo``, the place in the group by ``order`` from 0, and ``n``, the group's size.

    Rows are sorted over range partitions, so a group of any size spreads over
    tasks; only one count per task and group is summed up. Rows that are equal
    in group and order come in any order."""
    sorted_ = rows.withColumn("_tie", F.rand(17)).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    kept = landed(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    all_ = Window.partitionBy(group)
    past = all_.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        kept.groupBy(group, "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .select(
            F.col(group).alias("_g"), F.col("_part").alias("_p"),
            (F.coalesce(F.sum("_n").over(past), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(all_).alias("n"),
        )
    )
    return (
        kept.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
        .withColumn("lo", F.col("_at") + F.col("_shift"))
        .drop("_part", "_at", "_g", "_p", "_shift")
    )


def gathered(nodes: DataFrame, level: int) -> DataFrame:
    """The runs of level ``level`` over ``nodes`` (g, n, lo, hi, h, more): (g, n, bucket, lo, hi, h, members)."""
    return (
        nodes.groupBy("g", "n", F.floor(F.col("lo") / F.lit(FAN**level)).alias("bucket"))
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "h", "more"))).alias("members"))
        .select(
            "g", "n", "bucket",
            F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"),
            F.sha2(F.concat_ws("", F.transform("members", lambda m: m["h"])), 256).alias("h"), "members",
        )
    )


def grown(leaves: DataFrame, most: int, name: str) -> list[DataFrame]:
    """All runs over ``leaves``, level by level from 1; ``most`` is the largest group's size."""
    levels, nodes = [], leaves
    while FAN ** len(levels) < most:
        level = len(levels) + 1
        # Groups that have one node at the level below are done.
        runs = gathered(nodes.filter(F.col("n") > FAN ** (level - 1)), level)
        levels.append(landed(runs, f"{name}{level}"))
        nodes = levels[-1].select("g", "n", "lo", "hi", "h", F.lit(None).cast("string").alias("more"))
    return levels


def siblings(members: Column, lo: Column, hi: Column) -> Column:
    """The run's members without the interval ``[lo, hi)``: hashes to the left and to the right."""
    join = lambda keep: F.concat_ws("", F.transform(F.filter(members, keep), lambda m: m["h"]))
    return F.struct(join(lambda m: m["hi"] <= lo).alias("left"), join(lambda m: m["lo"] >= hi).alias("right"))


def attached(levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame | None:
    """The runs of level 1 plus ``above`` (siblings at their own level and over it), ``subroot`` and
    ``root``. ``tops``: (g, above, subroot, root) of the groups' subroots."""
    over = None
    for level in range(len(levels), 0, -1):
        runs = levels[level - 1]
        whole = F.col("n") <= FAN**level  # the run covers its group
        t = tops.select(F.col("g").alias("_g"), "above", "subroot", "root")
        got = runs.filter(whole).join(t, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
        if over is not None:
            up = over.select(F.col("g").alias("_g"), F.col("bucket").alias("_b"), F.col("members").alias("_m"), "above", "subroot", "root")
            inside = F.col("g").eqNullSafe(F.col("_g")) & (F.floor(F.col("bucket") / FAN) == F.col("_b"))
            step = F.array(siblings(F.col("_m"), F.col("lo"), F.col("hi")))
            got = got.unionByName(
                runs.filter(~whole).join(up, inside).withColumn("above", F.concat(step, F.col("above"))).drop("_g", "_b", "_m")
            )
        over = landed(got, f"{name}-up{level}") if level > 1 else got
    return over


def proven(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """Every leaf's (g, lo, h, more, proof, subroot, root)."""
    alone = leaves.filter("n = 1").join(tops.select(F.col("g").alias("_g"), "above", "subroot", "root"), F.col("g").eqNullSafe(F.col("_g")))
    alone = alone.select("g", "lo", "h", "more", F.col("above").alias("proof"), "subroot", "root")
    runs = attached(levels, tops, name)
    if runs is None:
        return alone
    each = runs.withColumn("m", F.explode("members"))
    step = F.array(siblings(F.col("members"), F.col("m.lo"), F.col("m.hi")))
    return alone.unionByName(
        each.select("g", "m.lo", "m.h", "m.more", F.concat(step, F.col("above")).alias("proof"), "subroot", "root")
    )


def manifest(rows: DataFrame, leaf_hash: Column, group: str, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``rows``: ``order``, ``group``, the columns ``keep``, ``leaf``,
    ``subroot``, ``root`` and ``proof`` (per level, from the leaf's to the root's, the hashes
    of the siblings to the left and to the right, set end to end).

    Leaves of a group ascend by ``order`` (NULL first), those of equal order by hash;
    repeated rows are leaves of their own. The NULL group is a group and
    comes first; groups are ordered bytewise by their text. A group
    of one leaf has that as its subroot. A table without rows gives none. Only
    ``order``, ``group``, ``keep`` and what ``leaf_hash`` names are read.
    """
    if {order, group, *keep} & {"leaf", "subroot", "root", "proof"}:
        raise ValueError("leaf, subroot, root and proof are names of the result")
    more = F.struct(F.col(order).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    named = landed(rows.select(F.col(group).alias("g"), F.col(order).alias("k"), leaf_hash.alias("h"), more.alias("more")), "leaves")
    leaves = ranked(named, "g", ["k", "h"], "ranked").select("g", "n", "lo", (F.col("lo") + 1).alias("hi"), "h", "more")
    groups = leaves.groupBy("g").agg(F.max("n").alias("n"))
    most, count = groups.agg(F.max("n"), F.count("*")).first()
    levels = grown(leaves, most or 0, "tree")
    # Subroots: the run that covers its group, or the only leaf.
    subroots = leaves.filter("n = 1").select("g", "h")
    for runs in levels:
        subroots = subroots.unionByName(runs.filter(F.col("lo").eqNullSafe(0) & (F.col("hi") == F.col("n"))).select("g", "h"))
    crown = ranked(subroots.select(F.lit(0).alias("one"), F.col("g").cast("string").alias("t"), "g", "h"), "one", ["t"], "subroots")
    crown = crown.select(F.lit(0).alias("g"), "n", "lo", (F.col("lo") + 1).alias("hi"), "h", F.col("g").alias("more"))
    crown_levels = grown(crown, count, "crown")
    top = crown_levels[-1].select("g", "h") if crown_levels else crown.select("g", "h")
    tops = top.select("g", F.array().cast(STEPS).alias("above"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    tops = landed(proven(crown, crown_levels, tops, "crown").select(F.col("more").alias("g"), F.col("proof").alias("above"), F.col("h").alias("subroot"), "root"), "tops")
    out = proven(leaves, levels, tops, "tree")
    kept = [F.col(f"more.c{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("more.k").alias(order), F.col("g").alias(group), *kept, F.col("h").alias("leaf"), "subroot", "root", "proof")


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), 256)


def tampered(rows: DataFrame, name: str = "tampered") -> DataFrame:
    """``documents`` plus the leaf of the row with its text's A-Z lower-cased where 3 divides the
    crc32 of ``doc_id``, else NULL; a NULL ``doc_id`` has no such number."""
    low = F.translate("text", UPPER, LOWER)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return rows.withColumn(name, F.when(hit, leaf(*[F.col(c) for c in FIELDS[:-1]], low)))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS) + ")"
_AROUND = """string_agg(h, '') over (partition by {key} level, i // 8 order by i rows between unbounded preceding and 1 preceding) as l,
    string_agg(h, '') over (partition by {key} level, i // 8 order by i rows between 1 following and unbounded following) as r"""
#: Trees level by level, proofs from the nodes with the same number over 8.
ORACLE = f"""
with recursive given as (
  select doc_id, lang, {_LEAF} as leaf,
    case when {CRC32_SQL.format(hex="hex(encode(doc_id::varchar))")} % 3 = 0
      then {_LEAF.replace("text::varchar", f"translate(text, '{UPPER}', '{LOWER}')")} end as other
  from documents),
leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from given),
nodes as (
  select lang, 0 as level, i, leaf as h, n from leaves
  union all
  select lang, level + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from nodes where n > 1 group by lang, level, i // 8, n),
subroots as (
  select lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from nodes where n = 1),
crown as (
  select 0 as level, i, h, n from subroots
  union all
  select level + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from crown where n > 1 group by level, i // 8, n),
around as (select lang, level, i, {_AROUND.format(key="lang,")} from nodes where n > 1),
crowned as (select level, i, {_AROUND.format(key="")} from crown where n > 1),
steps as (
  select x.lang, x.i, a.level as nr, coalesce(l, '') as l, coalesce(r, '') as r
  from leaves x join around a on x.lang is not distinct from a.lang and a.i = x.i // (8 ** a.level)::bigint
  union all
  select x.lang, x.i, 1000 + a.level, coalesce(l, ''), coalesce(r, '')
  from leaves x join subroots s on x.lang is not distinct from s.lang join crowned a on a.i = s.i // (8 ** a.level)::bigint),
proofs as (select lang, i, string_agg(l || r, '' order by nr) as said, list(l || '|' || r order by nr) as steps from steps group by lang, i),
roots as (select h as root from crown where n = 1),
whole as (
  select x.doc_id, x.leaf, s.h as subroot, root, sha256(coalesce(p.said, '')) as proof_sha256,
    list_reduce([coalesce(x.other, x.leaf)] || coalesce(p.steps, []), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) as folded_root
  from leaves x join subroots s on x.lang is not distinct from s.lang
    left join proofs p on x.lang is not distinct from p.lang and x.i = p.i, roots)
select *, folded_root = root as verified from whole"""
