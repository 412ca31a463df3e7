import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import delivery as D

T0 = datetime(2025, 1, 1)


def spelled(h, rng):
    return rng.choice([h, h.upper(), "sha256:" + h, "SHA256:" + h.upper(), f" {h}", h + "\n", h[:9].upper() + h[9:]])


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    hashes = [f"{rng.getrandbits(256):064x}" for _ in range(40)]
    rows = []
    for i in range(n):
        h = hashes[0] if rng.random() < .33 else rng.choice(hashes)
        rows.append((i, None if rng.random() < .05 else spelled(h, rng), None if rng.random() < .05 else T0 + timedelta(hours=rng.randrange(8)), h, i % 3, "r", None, 2.0))
    # names that the operator might use itself
    schema = "delivery_id long, fingerprint string, detected_at timestamp, n string, first int, row string, at string, k0 double"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def test_against_brute_force(spark):
    rows, df = table(spark)
    first, repeats, keep = {}, set(), set()
    for r in sorted(rows):
        k = (r[3], r[2])
        if r[1] is None or r[2] is None:
            keep.add(r[0])
        elif k in first:
            repeats.add((first[k], r[0]))
        else:
            first[k] = r[0]
            keep.add(r[0])
    assert {tuple(x) for x in D.repeats(df, D.message_key(), "delivery_id").collect()} == repeats
    out = D.keep_one(df, D.message_key(), "delivery_id")
    assert out.columns == df.columns and {r.delivery_id for r in out.collect()} == keep


def test_hot_keys_by_share(spark):
    rows = [(i, "ab" * 32, T0) for i in range(3000)] + [(5000 + i, f"{i:064x}", T0) for i in range(3000)]
    df = spark.createDataFrame(rows, "delivery_id long, fingerprint string, detected_at timestamp")
    assert D.keep_one(df, D.message_key(), "delivery_id").count() == 3001
    assert D.repeats(df, D.message_key(), "delivery_id").agg(F.min("first"), F.max("first"), F.count("*")).first()[:] == (0, 0, 2999)


def test_empty_ties_and_merge(spark):
    df = spark.createDataFrame([], "delivery_id long, fingerprint string, detected_at timestamp")
    assert D.keep_one(df, D.message_key(), "delivery_id").count() == 0 == D.repeats(df, D.message_key(), "delivery_id").count()
    same = spark.createDataFrame([(1, "aa", T0), (1, "AA", T0), (None, "aa", T0), (3, "", T0), (4, " ", T0)], df.schema)
    assert D.repeats(same, D.message_key(), "delivery_id").count() == 0
    assert sorted(r[0] for r in D.keep_one(same, D.message_key(), "delivery_id").collect()) == [1, 3, 4]
    assert sorted(r[0] for r in D.merge_new(same.where("delivery_id = 1"), same.where("delivery_id > 2"), D.message_key(), "delivery_id").collect()) == [1, 3, 4]
