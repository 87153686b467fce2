"""The set-based cascade against a plain sequential model, and the debounce against a loop."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.operators import chains, dedup

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
TTL = timedelta(hours=24)


def model(rows, marks=(), stored=()):
    """Row by row: checked keys, stored table, marks set only by what was kept."""
    live = {(k, v): at for k, v, at in marks}
    table = {(k, v): (event_id, fp) for k, v, event_id, fp in stored}
    out = {}
    for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
        checked = sorted((k for k in row["keys"] if k[2] is not None), key=lambda k: (k[2], k[0]))
        hit = next((k for k in checked if (k[0], k[1]) in live and row["at"] - live[k[0], k[1]] < TTL), None)
        if hit:
            layer = hit[2]
            kinds = sorted(k[0] for k in checked if k[2] == layer and (k[0], k[1]) in live and row["at"] - live[k[0], k[1]] < TTL)
            out[row["id"]] = ("dropped", kinds[0])
            continue
        order = {"exact": 0, "logical": 1, "idempotency": 2}
        owned = sorted((k for k in row["keys"] if k[3] and (k[0], k[1]) in table), key=lambda k: order[k[0]])
        if owned:
            _, fp = table[owned[0][0], owned[0][1]]
            if fp != row["fp"]:
                out[row["id"]] = ("conflict", None)
                continue
            out[row["id"]] = ("duplicate", owned[0][0])
        else:
            out[row["id"]] = ("inserted", None)
            for k in row["keys"]:
                if k[3]:
                    table[k[0], k[1]] = (row["event_id"], row["fp"])
        for k in row["keys"]:
            at = live.get((k[0], k[1]))
            if at is None or row["at"] - at >= TTL:
                live[k[0], k[1]] = row["at"]
    return out


def make_row(rng, number, hot):
    idem = f"i{rng.randrange(6)}" if rng.random() < 0.5 else ""
    logical = f"l{rng.randrange(6)}" if rng.random() < 0.5 else ""
    event_id = "hot" if hot and rng.random() < 0.4 else f"e{rng.randrange(14)}"
    keys = [("exact", event_id, 1, True)]
    if idem:
        keys.append(("idempotency", idem, 2, True))
    if logical:
        keys.append(("logical", logical, None if idem else 2, True))
    if not idem and not logical and rng.random() < 0.7:
        keys.append(("semantic", f"s{rng.randrange(5)}", 2, False))
    for line in range(rng.randrange(3)):
        keys.append(("purchase_line", f"p{rng.randrange(8)}", 3, False))
    # The fingerprint contains the strong keys, as the stored one does.
    fp = f"{idem}/{logical}/{rng.randrange(2)}"
    at = START + timedelta(hours=rng.randrange(80), seconds=rng.randrange(3))
    return {"id": number, "event_id": event_id, "at": at, "fp": fp, "keys": list(dict.fromkeys(keys))}


def frame(spark, rows):
    data = [(r["id"], r["event_id"], r["at"], r["fp"], r["keys"]) for r in rows]
    df = spark.createDataFrame(data, f"id int, event_id string, at timestamp, fp string, keys {dedup.KEYS}")
    return df.withColumn("arrival", F.struct("at", "id"))


def decide(spark, rows, marks=None, stored=None, **how):
    df = frame(spark, rows)
    m = spark.createDataFrame(list(marks), "kind string, key string, at timestamp") if marks else None
    s = spark.createDataFrame(list(stored), "kind string, key string, event_id string, fp string") if stored else None
    kept = dedup.cascade(df, TTL, m, s, **how)
    why = dedup.explain_drops(df, kept, TTL, m, s).withColumn("outcome", dedup.outcome())
    kinds = {"event_id": "exact", "logical_event_id": "logical", "idempotency_key": "idempotency"}
    out = {}
    for r in why.select("arrival.id", "kind", "outcome", "existing_field").collect():
        if r["kind"]:
            out[r["id"]] = ("dropped", r["kind"])
        elif r["outcome"] == "conflict":
            out[r["id"]] = ("conflict", None)
        elif r["outcome"] == "inserted":
            out[r["id"]] = ("inserted", None)
        else:
            out[r["id"]] = ("duplicate", kinds[r["existing_field"]])
    accepted = {r["id"]: r["inserted"] for r in kept.select("id", "inserted").collect()}
    assert accepted == {i: o[0] == "inserted" for i, o in out.items() if o[0] in ("inserted", "duplicate")}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cascade_matches_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows = [make_row(rng, i, hot=seed == 3) for i in range(120)]
    assert decide(spark, rows) == model(rows)


def test_cascade_with_earlier_runs(spark):
    rng = random.Random(7)
    rows = [make_row(rng, i, hot=False) for i in range(60)]
    marks = [("exact", "e1", START - timedelta(hours=2)), ("semantic", "s2", START - timedelta(hours=23))]
    stored = [("exact", "e3", "e3", "//0"), ("idempotency", "i2", "old", "i2//1"), ("logical", "l4", "older", "/l4/0")]
    assert decide(spark, rows, marks, stored) == model(rows, marks, stored)


def test_batches_that_come_in_swapped_order(spark):
    """A mark of an earlier batch blocks what comes later, although it is newer."""
    rng = random.Random(11)
    rows = [make_row(rng, i, hot=False) for i in range(60)]
    marks = [("purchase_line", "p1", START + timedelta(hours=90)), ("semantic", "s2", START + timedelta(hours=200)), ("exact", "e3", START + timedelta(hours=40))]
    expected = model(rows, marks)
    assert decide(spark, rows, marks) == expected
    blocked = [r for r in rows if any(k[:2] == ("purchase_line", "p1") for k in r["keys"])]
    assert blocked and all(expected[r["id"]][0] != "inserted" for r in blocked)


def test_a_long_chain_settles(spark):
    """Every event shares one line key with the next, so every second one stays."""
    rows = [
        {"id": i, "event_id": f"e{i}", "at": START + timedelta(seconds=i), "fp": f"//{i}", "keys": [("exact", f"e{i}", 1, True), ("purchase_line", f"p{i}", 3, False), ("purchase_line", f"p{i + 1}", 3, False)]}
        for i in range(14)
    ]
    assert {i for i, o in decide(spark, rows).items() if o[0] == "inserted"} == set(range(0, 14, 2))


@pytest.mark.parametrize("seed, limit", [(21, 1000), (22, 15), (23, 4)])
def test_components_alone_match_the_sequential_model(spark, seed, limit):
    rng = random.Random(seed)
    rows = [make_row(rng, i, hot=seed == 23) for i in range(120)]
    marks = [("exact", "e1", START - timedelta(hours=2)), ("semantic", "s2", START + timedelta(hours=50))]
    stored = [("exact", "e3", "e3", "//0"), ("idempotency", "i2", "old", "i2//1"), ("logical", "l4", "older", "/l4/0")]
    assert decide(spark, rows, marks, stored, rounds=0, limit=limit) == model(rows, marks, stored)


def chain_rows(n, every):
    """Events that share a line key with the next one, `every` apart."""
    return [
        {"id": i, "event_id": f"e{i}", "at": START + i * every, "fp": f"//{i}", "keys": [("exact", f"e{i}", 1, True), ("purchase_line", f"p{i}", 3, False), ("purchase_line", f"p{i + 1}", 3, False)]}
        for i in range(n)
    ]


def chain_passes(spark, rows, limit):
    df = frame(spark, rows).select(F.col("id").cast("long").alias("id"), F.col("arrival").alias("order"), F.unix_micros("at").alias("us"), "fp", F.lit(False).alias("again"), "keys")
    decided, passes = chains.decide(df, int(TTL.total_seconds()) * 1_000_000, limit)
    assert {r["id"]: r["kept"] for r in decided.collect()} == {i: o[0] == "inserted" for i, o in model(rows).items()}
    return passes


def test_passes_over_long_chains(spark):
    rows = chain_rows(2500, timedelta(seconds=1))
    assert chain_passes(spark, rows, 10_000) == 1
    # seven slices of odd length hand the change on from one to the next
    assert chain_passes(spark, rows, 401) <= 8
    # links that expire between slices
    assert chain_passes(spark, chain_rows(300, timedelta(hours=24)), 40) == 2


def test_debounce_of_a_null_key(spark):
    rows = [(1, None, START), (2, None, START + timedelta(seconds=0.1)), (3, None, START + timedelta(seconds=2)), (4, "a", START)]
    df = spark.createDataFrame(rows, "id int, key string, t timestamp")
    got = dedup.debounce(df, ["key"], "t", timedelta(seconds=1), ["t", "id"])
    assert {r.id: r.kept for r in got.collect()} == {1: True, 2: False, 3: True, 4: True}


def test_a_dropped_event_blocks_nobody(spark):
    """e1 repeats e0's logical id; e2 shares e1's event id only and must stay."""
    at = [START + timedelta(minutes=i) for i in range(3)]
    rows = [
        {"id": 0, "event_id": "a", "at": at[0], "fp": "/x/0", "keys": [("exact", "a", 1, True), ("logical", "x", 2, True)]},
        {"id": 1, "event_id": "b", "at": at[1], "fp": "/x/0", "keys": [("exact", "b", 1, True), ("logical", "x", 2, True)]},
        {"id": 2, "event_id": "b", "at": at[2], "fp": "//0", "keys": [("exact", "b", 1, True)]},
    ]
    assert decide(spark, rows) == {0: ("inserted", None), 1: ("dropped", "logical"), 2: ("inserted", None)}


@pytest.mark.parametrize("spacing", [0.05, 0.4, 30.0])
def test_debounce_matches_a_loop(spark, spacing):
    rng = random.Random(5)
    rows, at = [], 0.0
    for i in range(600):
        at += rng.random() * 2 * spacing
        rows.append((i, rng.choice(["a", "a", "b"]), START + timedelta(seconds=round(at, 3))))
    rows += [(1000 + i, "single", START + timedelta(seconds=10 * i)) for i in range(5)]
    expected, last = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[i] = key not in last or t - last[key] >= timedelta(seconds=1)
        if expected[i]:
            last[key] = t
    df = spark.createDataFrame(rows, "id int, key string, t timestamp")
    got = dedup.debounce(df, ["key"], "t", timedelta(seconds=1), ["t", "id"])
    assert {r["id"]: r["kept"] for r in got.collect()} == expected


@pytest.mark.parametrize("spacing, levels", [(0.4, 1), (0.7, 2), (400.0, 3)])
def test_debounce_composes_blocks_level_by_level(spark, monkeypatch, spacing, levels):
    """Points over thousands of blocks: runs in which every point is close to the next across blocks, gaps, null keys."""
    rng, rows = random.Random(11), []
    for key, n in (("a", 900), (None, 300)):
        at = 0.0
        for _ in range(n):
            at += spacing * rng.choice([0.5, 1.0, 1.0, 1.3]) if spacing < 1 or rng.random() < 0.7 else rng.random()
            rows.append((len(rows), key, START + timedelta(seconds=round(at, 3))))
    if levels == 2:
        rows += [(len(rows) + i, "a", START + timedelta(seconds=70 * 60 + 0.9 * i)) for i in range(200)]
    expected, last = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[i] = key not in last or t - last[key] >= timedelta(seconds=1)
        if expected[i]:
            last[key] = t
    seen, composed = [], dedup._composed
    monkeypatch.setattr(dedup, "_composed", lambda *a: seen.append(composed(*a)) or seen[0])
    df = spark.createDataFrame(rows, "id int, key string, t timestamp")
    got = dedup.debounce(df, ["key"], "t", timedelta(seconds=1), ["t", "id"])
    assert {r["id"]: r["kept"] for r in got.collect()} == expected
    assert len(seen[0]) == levels
    assert all(level.selectExpr("max(size(_blocks))").first()[0] <= 64 for level in seen[0])
    assert seen[0][-1].groupBy("key" if "key" in seen[0][-1].columns else "_k0").count().where("count > 1").isEmpty()
