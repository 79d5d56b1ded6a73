"""Rows shuffled over micro-batches: the ordered folds equal their batch twins, and what is refused is told."""

import random

import pytest
from pyspark.sql import functions as F

from sessionledger.streaming import ordered as od
from sessionledger.streaming import runs as ru

from .test_streams import batches, few_partitions, rows_of  # noqa: F401

SLACK = 40
SCHEMA = "session_id string, ord long, arrival long, stamp long, generation long, output long"


def sent(spark, n, seed, disorder=SLACK):
    """Rows of a hot, a NULL and some small keys, each up to ``disorder`` behind its place."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        stamp = rng.choice([None, i, i - rng.randrange(30), 10**6])
        rows.append((key, i, i + rng.randrange(disorder), stamp, rng.choice([None, i // 50, i // 50, 3]), rng.choice([None, 1, 7])))
    return spark.createDataFrame(rows, SCHEMA)


def streamed(spark, df, fold, parts, name, slack=SLACK):
    """One file a micro-batch, in order of arrival."""
    path = ru.land_segments(df.withColumn("one", F.lit(1)), "one", "arrival", parts=parts, files=1)
    stream = ru.stream_segments(spark, path, df.withColumn("one", F.lit(1)).schema, files_per_trigger=1)
    return ru.run_to_table(od.ordered_stream(stream, "session_id", fold, slack), name)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_marks_equal_batch(spark, parts):
    df = sent(spark, 600, 1)
    events = streamed(spark, df, od.marks(10**5), parts, f"marks{parts}").persist()
    got = od.standing(events, "session_id").select("session_id", "ord", "accepted", "newest")
    assert rows_of(got) == rows_of(ru.late_and_future(df, F.lit(10**5)))
    assert od.refused(events, "session_id").count() == 0
    assert batches(spark, f"marks{parts}") == parts
    if parts > 1:  # most rows are told for good before the end
        assert events.filter("settled").count() > 300


def test_generations_equal_batch(spark):
    df = sent(spark, 500, 2)
    got = od.generation_totals(streamed(spark, df, od.GENERATIONS, 4, "generations"), "session_id")
    want = df.groupBy("session_id", "generation").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("output").alias("output"), F.min("ord").alias("first_ord")
    )
    assert rows_of(got) == rows_of(want)


def test_refused_rows_are_told(spark):
    """Every row is either told once or refused with its reason, however far behind it comes."""
    df = sent(spark, 400, 3, disorder=200)
    again = df.filter("ord % 7 = 0").withColumn("arrival", F.col("arrival") + 3)
    lost = df.limit(2).withColumn("ord", F.lit(None).cast("long"))
    all_rows = df.unionByName(again).unionByName(lost)
    events = streamed(spark, all_rows, od.marks(10**5), 6, "refused", slack=10).persist()
    told = od.standing(events, "session_id")
    out = od.refused(events, "session_id")
    assert told.count() + out.count() == all_rows.count()
    reasons = {r.refused: r["count"] for r in out.groupBy("refused").count().collect()}
    assert reasons["unordered"] == 2 and reasons["late"] and reasons["repeat"]
    assert rows_of(told.select("session_id", "ord")) == rows_of(told.select("session_id", "ord").distinct())
    # What was let in is marked as the batch form marks those rows alone.
    let_in = df.join(told.select(F.col("session_id").alias("_s"), F.col("ord").alias("_o")), F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("ord") == F.col("_o")), "left_semi")
    assert rows_of(told.select("session_id", "ord", "accepted", "newest")) == rows_of(ru.late_and_future(let_in, F.lit(10**5)))
