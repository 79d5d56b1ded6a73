"""Count scans, exchanges and joins in the plan of queries.

``python tools/plan.py SF [-v] [-n] [name...]``: the final adaptive plan, or with
``-n`` the planned one without running; ``-v`` prints it.
"""

import re
import sys

sys.path.insert(0, "/root/repo")
from pyspark.sql import SparkSession  # noqa: E402

from sessionledger.catalog import QUERIES  # noqa: E402

spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "8g")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
sf, show, dry = sys.argv[1], "-v" in sys.argv, "-n" in sys.argv
names = [a for a in sys.argv[2:] if not a.startswith("-")]
d = f"/root/testdata/sf{sf}"
for name in names or QUERIES:
    df = QUERIES[name](spark, d)
    if not dry:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    n = lambda p: len(re.findall(p, final))
    print(
        f"{name:24} scans={n('FileScan')} exch={n(r'Exchange hashpartitioning')} single={n('Exchange SinglePartition')} "
        f"range={n('Exchange rangepartitioning')} reused={n('ReusedExchange')} bhj={n('BroadcastHashJoin')} smj={n('SortMergeJoin')} "
        f"nlj={n('BroadcastNestedLoop')} cart={n('CartesianProduct')} py={n('MapInArrow|ArrowEvalPython|FlatMapGroups')}",
        flush=True,
    )
    if show:
        print(final)
