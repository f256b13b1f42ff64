"""Canonical JSON against json.dumps."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from framewarden.functions.canonical import canonical_json, settings_hash
from framewarden.profiles import PROFILES, config_hash

KIND = (
    "s struct<z:double,name:string,deep:struct<b:boolean,a:bigint,empty:struct<x:int>>,list:array<double>,m:map<string,array<string>>,`a b`:int>"
)


def given(x):
    """A dictionary without its fields that are None."""
    return {k: given(v) if isinstance(v, dict) and k != "m" else v for k, v in x.items() if v is not None}


def test_json_and_hash_equal_the_library(spark):
    schema = spark.createDataFrame([], KIND).schema
    kind = schema["s"].dataType
    pick = random.Random(3)
    numbers = [0.0, -0.0, 1.0, -23.0, 0.1, 1e-4, 9.9e-5, 1e-5, 123456789.5, 1e15, 1e16, 1.5e300, -2.5e-7, 1e7, 12345678.0, 3e22, 0.001, 100.0]
    numbers += [round(pick.uniform(-1e6, 1e6), pick.randint(0, 6)) for _ in range(60)]
    words = ["", "plain", 'q"\\/', "é日😀", "\n\t\x01\x7f\x80", "a b"]
    rows = []
    for x in numbers:
        deep = pick.choice([None, {"b": True, "a": pick.randint(-9, 2**60), "empty": pick.choice([None, {"x": None}, {"x": 3}])}])
        m = pick.choice([None, {}, {"k": ["v", None], "B": [], "é": pick.choices(words, k=3)}])
        rows.append({"z": x, "name": pick.choice([None, *words]), "deep": deep, "list": pick.choice([None, [], pick.sample(numbers, 3)]), "m": m, "a b": pick.choice([None, 5])})
    frame = spark.createDataFrame([(r,) for r in rows], schema)
    got = frame.select(canonical_json(F.col("s"), kind).alias("j"), settings_hash(F.col("s"), kind).alias("h")).collect()
    want = [json.dumps(given(r), sort_keys=True) for r in rows]
    assert [r.j for r in got] == want
    assert [r.h for r in got] == [hashlib.sha256(w.encode()).hexdigest()[:8] for w in want]


def test_rows_of_settings_have_the_profiles_hashes(spark):
    from framewarden.profiles import settings_rows

    rows = settings_rows(spark)
    kind = rows.schema["settings"].dataType
    got = {r.profile: r.h for r in rows.select("profile", settings_hash(F.col("settings"), kind).alias("h")).collect()}
    assert got == {name: config_hash(name) for name in PROFILES}
