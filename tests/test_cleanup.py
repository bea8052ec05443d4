"""Cleanup with one target for the whole store."""

from pyspark.sql import functions as F

from radlake.operators import catalog as C


def test_store_total_by_ranges(spark):
    rows = [(k, k * 37 % 1000 // 2, 5 + k % 7) for k in range(1000)]
    files = spark.createDataFrame(rows, "id int, mtime long, size long")
    got = C.until_freed(files, "size", ["mtime", "id"], 3000, cutoff=F.lit(400))
    want, freed = [], 0
    for i, t, n in sorted((r for r in rows if r[1] < 400), key=lambda r: (r[1], r[0])):
        if freed >= 3000:
            break
        freed += n
        want.append((i, freed))
    assert sorted((r.id, r.freed) for r in got.collect()) == sorted(want)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert C.until_freed(files.limit(0), "size", ["mtime", "id"], 3000).count() == 0
