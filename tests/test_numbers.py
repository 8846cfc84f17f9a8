"""Token numbers of any length."""

import random

from tests.helpers import message_frame
from pyspark.sql import functions as F

from parapet.functions import checks, numbers
from parapet.operators import pii as ops


def test_arithmetic_and_order(spark):
    rng = random.Random(1)
    values = [0, 1, 9, 10**15 - 1, 10**15, 10**15 + 1, 10**30 - 1, 10**30, 10**38 - 1, 10**45 + 7, 7 * 10**60]
    values += [rng.randrange(10 ** rng.randrange(1, 70)) for _ in range(60)]
    data = [(str(v).zfill(rng.randrange(1, 5)), rng.choice([0, 1, -1, 5, -7, 1000, -1000])) for v in values]
    d = spark.createDataFrame(data, "s string, k long").withColumn("n", numbers.from_digits(F.col("s")))
    rows = d.select("s", "k", numbers.to_string(numbers.plus(F.col("n"), F.col("k"))).alias("sum"), "n").orderBy("n").collect()
    assert [int(r["s"]) for r in rows] == sorted(values)
    assert all(int(r["sum"]) == max(0, int(r["s"]) + r["k"]) for r in rows)
    assert spark.range(1).select(numbers.from_digits(F.lit("1٢"))).first()[0] is None


def test_long_literals_neither_vanish_nor_end_the_job(spark):
    nines, long = "9" * 38, "1" + "0" * 44
    rows = [(1, "t", 0, "user", [f"[PII_EMAIL_{nines}] a@x.org b@x.org"]), (2, "t", 0, "user", [f"[PII_EMAIL_{long}] c@x.org"]),
            (3, "t", 0, "user", ["d@x.org then [PII_EMAIL_5] e@x.org"])]
    d = message_frame(spark, rows)
    found = ops.tokenize_pii(ops.text_rows(d.drop("tenant_id", "role"))).vault.collect()
    got = {(r["request_id"], r["value"]): r["token"] for r in found}
    assert got[1, "a@x.org"] == f"[PII_EMAIL_{int(nines) + 1}]" and got[1, "b@x.org"] == f"[PII_EMAIL_{int(nines) + 2}]"
    assert got[2, "c@x.org"] == f"[PII_EMAIL_{int(long) + 1}]"
    assert got[3, "d@x.org"] == "[PII_EMAIL_6]"


def test_score_rounding(spark):
    scores = [0.125, 0.285, 0.575, 1.005, 0.0, 0.005, 0.015, 0.625, 0.375, 1.0, 0.995, 2.675, 0.001, 12.345]
    d = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r[0] for r in d.select(checks.two_decimals(F.col("s"))).collect()][:-1] == [f"{s:.2f}" for s in scores][:-1]
