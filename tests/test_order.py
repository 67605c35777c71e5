from pyspark.sql import functions as F

from precis.operators import order as O


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_index_is_exact_permutation(spark):
    idx = O.with_index(_ids(spark, 1000), "doc_id", 42, buckets=7).collect()
    assert sorted(r.idx for r in idx) == list(range(1000))
    import hashlib
    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"{i}|42".encode()).hexdigest(), i))
    assert [r.doc_id for r in sorted(idx, key=lambda r: r.idx)] == order


def test_index_independent_of_buckets(spark):
    a = {r.doc_id: r.idx for r in O.with_index(_ids(spark, 500), "doc_id", 3, buckets=1).collect()}
    b = {r.doc_id: r.idx for r in O.with_index(_ids(spark, 500), "doc_id", 3, buckets=13).collect()}
    assert a == b


def test_split_sizes_and_disjoint(spark):
    train, val = O.split_fixed(_ids(spark, 1000), "doc_id", 128, 42)
    t, v = {r.doc_id for r in train.collect()}, {r.doc_id for r in val.collect()}
    assert len(v) == 128 and len(t) == 872 and not (t & v)


def test_batches_drop_remainder(spark):
    b = O.batch_rows(_ids(spark, 1000), "doc_id", 128, 5).collect()
    assert len(b) == 7 * 128
    sizes = {}
    for r in b:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert set(sizes.values()) == {128}


def test_shards(spark):
    c = O.assign_shards(_ids(spark, 1000), "doc_id", 64, "contiguous").collect()
    assert all(r.shard == r.doc_id // 64 for r in c)
    s = O.assign_shards(_ids(spark, 1000), "doc_id", 64, "strided").collect()
    assert all(r.shard == r.doc_id % 16 for r in s)


def test_index_by_id_with_many_buckets(spark):
    got = O.with_index_by_id(_ids(spark, 3000).repartition(5), "doc_id", buckets=5000).collect()
    assert all(r.idx == r.doc_id for r in got) and len(got) == 3000


def test_index_by_string_id(spark):
    ids = [f"id-{i}" for i in range(300)] + ["a", "z", "z"]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    got = sorted((r.idx, r.doc_id) for r in O.with_index_by_id(df, "doc_id", buckets=16).collect())
    assert [i for _, i in got] == sorted(ids) and [n for n, _ in got] == list(range(len(ids)))


def test_nth_key_is_the_nth_smallest(spark):
    rows = [(i,) for i in range(300)] + [(7,)] * 40
    keyed = spark.createDataFrame(rows, "id int").select(O.order_key("id", 5).alias("k"))
    want = sorted(r[0] for r in keyed.collect())
    for n in (1, 2, 150, 340):
        assert O.nth_key(keyed, "k", n, digits=1, few=4) == want[n - 1] == O.nth_key(keyed, "k", n)
    seven = want.index(spark.range(1).select(O.order_key(F.lit(7), 5)).first()[0]) + 1
    assert O.nth_key(keyed, "k", seven + 40, digits=1, few=4) == want[seven + 39]
    assert O.nth_key(keyed, "k", 341) is None and O.nth_key(keyed, "k", 0) is None
    assert O.nth_key(keyed.where("false"), "k", 1) is None


def test_batched_splits_equal_the_stepwise_operators_in_one_exchange(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("idx"))
    for val in (0, 70, 500, 900):
        got = {tuple(r) for r in O.batched_splits(df, "id", val, 16, 9).select("split", "id", "batch_id", "pos", "batch_order").collect()}
        train, first = O.split_fixed(df.drop("idx"), "id", val, 9)
        want = {("validation", *r) for r in O.batch_rows(first, "id", 16, 10).select("id", "batch_id", "pos", "batch_order").collect()}
        want |= {("train", *r) for r in O.batch_rows(train, "id", 16, 12).select("id", "batch_id", "pos", "batch_order").collect()}
        assert got == want, val
    again = df.union(df.where("id = '3'")).union(spark.createDataFrame([(None, 2)], "id string, idx int"))
    sides = O.batched_splits(again, "id", 200, 1, 9).select("id", "split").distinct().groupBy("id").count()
    assert sides.where("count > 1").count() == 0
    assert O.batched_splits(again, "id", 200, 1, 9).count() == 502
    assert O.batched_splits(df.where("false"), "id", 70, 16, 9).count() == 0
