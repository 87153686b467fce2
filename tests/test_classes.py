"""Events that hold the same keys are decided together: few of them reach the walk, and what they lack in payload costs nothing."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_cascade import START, decide, frame, model

from tideline.functions import payload as pl
from tideline.operators import chains, items

DAY = 24 * 3600 * 1_000_000


def crowd(rng, n, hours, keys_of):
    times = sorted(rng.random() * hours * 3600 for _ in range(n))
    return [{"id": i, "event_id": f"e{i}", "at": START + timedelta(seconds=int(t)), "fp": "//", "keys": keys_of(t)} for i, t in enumerate(times)]


def hourly(t):
    return [("item_impression", f"h{int(t // 3600) + n}", 3, False) for n in (0, 1)]


def test_a_crowd_on_a_chain_is_walked_once(spark):
    """Impressions of the items of their hour and the next one; all of them together would be cut into slices, each waiting for the last."""
    rows = crowd(random.Random(3), 1500, 60, hourly)
    df = frame(spark, rows).select(F.col("id").cast("long").alias("id"), F.col("arrival").alias("order"), F.unix_micros("at").alias("us"), "fp", F.lit(False).alias("again"), "keys")
    decided, passes = chains.decide(df, DAY, 400)
    assert {r["id"] for r in decided.where("kept").collect()} == {i for i, o in model(rows).items() if o[0] == "inserted"}
    assert passes == 1


@pytest.mark.parametrize("limit", [10_000, 150])
def test_classes_over_many_lifetimes(spark, limit):
    """Marks lapse within a cell of time, through other classes too, and keys that are only marked block others."""
    rng = random.Random(limit)

    def keys_of(t):
        some = rng.choice([[("a", 3)], [("a", 3), ("b", 3)], [("b", 3)], [("c", 3), ("b", 3)]])
        return [("purchase_line", k, layer, False) for k, layer in some]

    rows = crowd(rng, 600, 130, keys_of)
    assert decide(spark, rows, limit=limit) == model(rows)


def test_absent_members_are_not_looked_up_by_path(spark):
    """A path that leads nowhere ends in an exception inside, for every event and member."""
    rows = spark.createDataFrame([('{"items":[{"item_id":" a","surface":null},{"sku":1}],"surface":" s ","order_id":7}',)], "p string").select(
        F.parse_json("p").alias("properties"), F.lit("item_impression").alias("event_name")
    )
    lined = items.with_lines(rows).select(items.key_fields(F.col("lines"), F.col("properties")).alias("k"))
    names = ("item_id", "surface", "order_id", "variant_id")
    assert [tuple(k[n] for n in names) for k in lined.first()["k"]] == [("a", "", "7", ""), ("", "s", "7", "")]
    plan = lined._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" in plan and "$.items" not in plan and "$.surface" not in plan


def test_members_of_anything(spark):
    texts = ['{"a":null,"b":1}', "[1]", '"a"', "null", "{}", '{"a":{"a":2}}', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    both = rows.select(pl.members(F.col("v"), ("a", "c"))["a"].alias("one"), pl.member(F.col("v"), "$.a").alias("two"))
    got = both.select(*[F.concat_ws("/", F.col(c).isNull().cast("string"), F.to_json(c)).alias(c) for c in both.columns]).collect()
    assert [r["one"] for r in got] == [r["two"] for r in got]
