"""JSON validity and number kinds against Python's own parser."""

import json
import random

from pyspark.sql import functions as F

from parapet.functions import checks

FIXED = ["1", "-0", "01", "+1", "1.", ".5", "1e5", "1E-2", "-1.5e+3", "1e", "NaN", "-NaN", "Infinity", "-Infinity", "nan", "1" * 60, "-" + "9" * 25,
         "1-2", "1 2", '"1.0 NaN"', '"a\\"1"', '"open', 'true', 'tru', 'null', '[1, NaN, "x", {"a": 1e400}]', '{"a": 1, "a": 2.5}', '{"a":1} x', "", " ",
         '{"a": [1.0, {"b": Infinity}], "c": "\\u00e9\\n", "d": 12345678901234567890123}', "{'a': 1}", '{"a" : 1 ,}', "NaNs", "x1", "1x", "1e5.0", "--1"]


def kind(text):
    try:
        v = json.loads(text)
    except ValueError:
        return None
    for name, of in (("boolean", bool), ("integer", int), ("float", float), ("string", str), ("array", list), ("object", dict)):
        if isinstance(v, of):
            return name
    return "null"


def test_kinds_equal_the_parsers(spark):
    rng = random.Random(3)
    bits = ["1", "0", ".", "e", "-", "+", "NaN", "Infinity", '"', "\\", "{", "}", "[", "]", ":", ",", " ", "a", "5"]
    texts = FIXED + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))) for _ in range(1500)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    shape = checks.json_shape(F.col("t"))
    got = {r["i"]: r["kind"] for r in d.select("i", F.when(shape.isNotNull(), checks.json_type(shape)).alias("kind")).collect()}
    assert {texts[i]: k for i, k in got.items()} == {t: kind(t) for t in texts}


def test_schema_reads_numbers_by_their_spelling(spark):
    schema = {"properties": {"n": {"type": "number"}, "i": {"type": "integer"}}}
    cases = {'{"n": NaN}': None, '{"i": NaN}': "i", '{"i": ' + "8" * 50 + "}": None, '{"n": -Infinity, "i": 3}': None, '{"i": 1.0}': "i", '{"i": true}': None,
             '{"i": "7"}': "i", '{"i": 1e2}': "i"}
    d = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["e"] for r in d.select("t", checks.schema_error(F.col("t"), schema).alias("e")).collect()}
    assert got == {t: k and f"field '{k}' expected type integer" for t, k in cases.items()}
