"""Steps that several tables or columns read are made once, and stay compiled."""

from pyspark.sql import functions as F

from tideline.functions.once import once
from tideline.functions.text import WHITE, trimmed
from tideline.operators import dedup


def test_lambda_leaves_the_generator_compiled(spark):
    rows = spark.range(3).select("id", F.array("id", F.lit(9)).alias("a"))
    made = once(rows, {"n": F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x), "id": F.col("id") + 1})
    plan = made._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "lambda" not in generate
    assert sorted(map(tuple, made.select("id", "n").collect())) == [(1, 9), (2, 10), (3, 11)]


def test_cuts_keep_payloads_whole(spark, tmp_path):
    rows = spark.range(50).select(F.parse_json(F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}"))).alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "v"))
    import pyarrow.parquet as pq

    (file,) = (tmp_path / "v").glob("*.parquet")
    assert "typed_value" not in str(pq.ParquetFile(file).schema)


def test_named_text_is_trimmed_like_any(spark):
    texts = [None, "", " ", "a", " a", "a ", "a　", "\x85a", "a b", "é", "é ", "aé", "\t\n", "a\x00", "\x00a", WHITE, f"{WHITE}x{WHITE}", "~", "!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(trimmed("t").alias("named"), trimmed(F.col("t")).alias("other")).collect()
    assert [r.named for r in both] == [r.other for r in both]


def test_only_explained_candidates_are_joined(spark):
    def row(n, key):
        return (n, key)

    rows = spark.createDataFrame([row(0, "a"), row(1, "a"), row(2, "b")], "n int, key string").select(
        F.timestamp_seconds(F.col("n")).alias("at"), F.lit("f").alias("fp"), F.concat(F.lit("e"), "n").alias("event_id"),
        F.struct(F.timestamp_seconds(F.col("n")).alias("received_at"), "n").alias("arrival"),
        F.array(F.struct(F.lit("exact").alias("kind"), "key", F.lit(1).alias("layer"), F.lit(True).alias("unique"))).cast(dedup.KEYS).alias("keys"),
    )
    kept = dedup.cascade(rows)
    assert [(r.arrival["n"], r.kind, r.existing_event_id) for r in dedup.explained(rows, kept).collect()] == [(1, "exact", "e0")]
    assert dedup.explain_drops(rows, kept).count() == 3
