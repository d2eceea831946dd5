"""Pairs of documents that arrive in any order of their ids."""

from treeloom.operators.ted import Leaf
from treeloom.streaming.pairs import keep_pairs


def test_each_pair_once_whatever_the_order(spark, tmp_path):
    schema = "id long, doc struct<v:double>"
    rows = {i: float(i + 1) for i in range(6)}
    frame = lambda ids: spark.createDataFrame([(i, (rows[i],)) for i in ids], schema)
    known = frame([1, 4])
    batches = [[5, 0], [3], [2, 1]]  # 1 is known already, and comes again
    for k, ids in enumerate(batches):
        frame(ids).write.parquet(str(tmp_path / f"in{k}"))
        arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}"))
        before = known
        assert keep_pairs(arrivals, lambda b=before: b, (Leaf("s", "v", "num"),), str(tmp_path / f"out{k}"), str(tmp_path / f"check{k}")).awaitTermination(60)
        got = sorted((r.a_id, r.b_id) for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect())
        have = {r.id for r in known.collect()} | set(ids)
        assert got == sorted((a, b) for a in have for b in have if a < b and (a in ids or b in ids))
        known = frame(sorted(have))
