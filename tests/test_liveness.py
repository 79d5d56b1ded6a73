"""The liveness stream tells every stretch, closed or open, in any split into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from sessionledger.operators.fleet import liveness_gaps
from sessionledger.streaming import liveness as lv
from sessionledger.streaming import runs as ru

from .test_oracles import check
from .test_streams import few_partitions, landed_in, rows_of  # noqa: F401

DAY = 86400


def plain(samples, gap):
    out = {}
    for host, at in sorted(samples):
        stretches = out.setdefault(host, [])
        if stretches and at - stretches[-1][1] <= gap:
            stretches[-1][1:] = [at, stretches[-1][2] + 1]
        else:
            stretches.append([at, at, 1])
    return out


def test_joined():
    rng = random.Random(1)
    for _ in range(300):
        times = [rng.randrange(60) for _ in range(rng.randrange(1, 25))]
        want = plain([(0, t) for t in times], 3)[0]
        parts = [[t, t, 1] for t in times]
        cut = rng.randrange(len(parts))
        assert lv.joined(lv.joined(parts[:cut], 3) + lv.joined(parts[cut:], 3), 3) == want


@pytest.mark.parametrize("parts", [1, 4])
def test_open_and_closed_stretches(spark, parts):
    """Late samples, within what the watermark allows, join stretches across micro-batches."""
    rng = random.Random(parts)
    samples = []
    for host in range(6):
        at = (100 + rng.randrange(5)) * DAY  # the watermark begins at the epoch
        for _ in range(80):
            at += rng.choice([0, 1, 1, 2, 9]) * DAY
            samples.append((host, at))
    end = max(t for _, t in samples)
    samples += [(h, end - rng.randrange(2) * DAY) for h in (0, 1)] + [(1, end)] * 200
    samples.sort(key=lambda s: s[1] + rng.randrange(8) * DAY)
    rows = [(str(h), i, h, t) for i, (h, t) in enumerate(samples)]
    df = spark.createDataFrame([*rows, ("x", len(rows), None, 5), ("x", len(rows), 1, None)], "session_id string, ord long, host long, at long")
    df = df.withColumn("ts", F.timestamp_seconds("at"))
    gap = 3 * DAY
    # Each micro-batch is one file, whatever the host.
    one = df.withColumn("session_id", F.lit("all"))
    changes = ru.run_to_table(lv.host_liveness(landed_in(spark, one, parts), gap, "20 days"), f"live{parts}")
    got = lv.live_now(changes, gap)
    want = [(h, a, b + gap, n, b + gap > end - 20 * DAY) for h, s in plain(samples, gap).items() for a, b, n in s]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[4] for w in want) and not all(w[4] for w in want)
    batch = liveness_gaps(df.filter("host IS NOT NULL AND at IS NOT NULL").withColumnRenamed("at", "sampled_at"), gap)
    keep = ["host", "live_from", "unreachable_at", "samples"]
    assert rows_of(got.select(keep)) == rows_of(batch.select(keep))


def test_registered(spark, duck):
    check(spark, duck, "host_liveness")
