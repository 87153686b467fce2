"""How the costly queries deal and read their tables."""

from tideline.operators import designs, lookups
from tideline.plans import base
from tideline.plans.catalog import load_all
from tideline.sources import adapters

SF = "/root/testdata/sf0.001"


def test_one_row_group_is_dealt_to_tasks_of_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapters, "SPREAD_BYTES", 1000, raising=False)
    rows = adapters.read(spark, SF, "events")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    # as many splits as cores, by bytes; the rows lie in one of them
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        sizes = adapters.read_spread(spark, str(tmp_path), "events").rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == rows.count() and max(sizes) <= rows.count() / 8


def test_lines_of_several_categories_are_read_in_one_pass(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "n int, category_ids array<string>")
    found = lookups.by_category(rows, ["a", "b"]).select("n", "category").collect()
    assert sorted(map(tuple, found)) == [(1, "a"), (1, "b")]
    plan = load_all()["category_lines"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(lines") == 1


def test_levels_are_rolled_up_without_multiplying_rows(spark):
    columns = [*designs.LEVELS[0][1], "item_id"]
    rows = [tuple(f"{c}{i % m}" for c, m in zip(columns, (1, 2, 2, 3, 2, 2, 1, 4))) + (i, 1, None) for i in range(48)]
    ddl = ", ".join(f"{c} string" for c in columns) + ", score long, event_count long, last_event_time timestamp"
    found = designs.item_scores_by_level(spark.createDataFrame(rows, ddl))
    assert {r["level_rank"]: r["s"] for r in found.groupBy("level_rank").agg({"score": "sum"}).withColumnRenamed("sum(score)", "s").collect()} == dict.fromkeys(range(6), sum(range(48)))
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def _plan(spark, name):
    return load_all()[name].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_no_join_condition(spark):
    joins = [line for line in _plan(spark, "item_lines").splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "variant" in line]


def test_lookups_read_only_the_members_they_need(spark):
    for name in ("order_line_lookup", "item_history", "surface_lines"):
        plan = _plan(spark, name)
        assert "order_line_id" in plan and "rendered_at" not in plan


def test_events_are_dealt_before_they_are_checked(spark):
    for name in ("eligible_subjects", "subject_reconciliation", "normalization_counts"):
        below = _plan(spark, name).split("Repartition")[1:]
        assert below and not [part for part in below if "Filter" in part.split("Relation")[0]]


def test_stored_daily_rows_are_made_once(spark):
    assert "Repartition" not in _plan(spark, "daily_upsert")


def test_levels_are_ranked_once(spark):
    assert "row_number" not in _plan(spark, "top_items_with_fallback")


def test_audit_makes_its_facts_once(spark, monkeypatch):
    made, facts = [], base.facts
    monkeypatch.setattr(base, "facts", lambda *given: made.append(given) or facts(*given))
    load_all()["constraint_audit"].run(spark, SF)
    assert len(made) == 1
