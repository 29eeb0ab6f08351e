"""Lineage, forecasts, letter vectors, the archive, sketches, bucket merges and runs that go on."""

import math
import os
import random
import statistics
import zlib
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import archive, forecast, lineage, merge, sketches, vectors
from tallyloom.plans import audit
from tallyloom.plans.resume import Resumable, fingerprint
from tallyloom.sources.buckets import Bucketed


def test_newest_versions_of_long_chains_and_cycles(spark):
    rows = [(f"a{i}", f"a{i + 1}" if i < 999 else None) for i in range(1000)]
    rows += [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("into", "c1"), ("self", "self"), ("lost", "nowhere"), (None, "a0"), ("two", "a990"), ("two", "c0")]
    got = {r["link_id"]: (r["newest_id"], r["distance"], r["in_cycle"]) for r in lineage.newest(spark.createDataFrame(rows, "link_id string, superseded_by string").repartition(3)).collect()}
    assert all(got[f"a{i}"] == ("a999", 999 - i, False) for i in range(1000))
    assert all(got[k] == (None, None, True) for k in ("c0", "c1", "c2", "into", "self"))
    assert got["lost"] == ("lost", 0, False) and got["two"] == ("a999", 10, False) and len(got) == 1000 + 7
    assert lineage.newest(spark.createDataFrame([], "link_id string, superseded_by string")).count() == 0
    assert lineage.newest(spark.createDataFrame([("x", None)], "link_id string, superseded_by string")).first()["newest_id"] == "x"


def test_forecast_by_exponential_smoothing(spark):
    draw, rows = random.Random(2), []
    for v in ("hot", "weekly", "few", None):
        for i in range({"hot": 400, "weekly": 12, "few": 2}.get(v, 5)):
            rows.append((v, date(2026, 1, 1) + timedelta(days=7 * i if v == "weekly" else i % 90), round(draw.uniform(1, 9), 2)))
    rows += [("weekly", None, 1.0), ("weekly", date(2026, 1, 1), None), ("hot", date(2026, 1, 1), 3.0)]
    got = {r["vendor"]: r for r in forecast.recurring(spark.createDataFrame(rows, "vendor string, date date, amount double"), alpha=0.3).collect()}
    assert got.keys() == {"hot", "weekly"}
    end = max(d for _, d, x in rows if d and x is not None)
    for v in got:
        daily = Counter()
        for w, d, x in rows:
            if w == v and d and x is not None:
                daily[d] += x
        days, level, squares = sorted(daily), None, 0.0
        for d in days:
            squares += 0 if level is None else (daily[d] - level) ** 2
            level = daily[d] if level is None else level + 0.3 * (daily[d] - level)
        spread = 1.2815515655446004 * math.sqrt(squares / (len(days) - 1))
        following = days[-1] + timedelta(days=math.ceil(statistics.median((b - a).days for a, b in zip(days, days[1:], strict=False))))
        assert (got[v]["forecast"], got[v]["low"], got[v]["high"]) == (pytest.approx(level), pytest.approx(level - spread), pytest.approx(level + spread))
        assert got[v]["next_day"] == following and got[v]["is_late"] == ((end - following).days > 5)


def brute_vector(name, size):
    framed = f" {name.lower().strip(' ')} "
    n = Counter(zlib.crc32(framed[i : i + 3].encode()) % size for i in range(len(framed) - 2))
    norm = math.sqrt(sum(x * x for x in n.values()))
    return {c: x / norm for c, x in n.items()}


@pytest.mark.parametrize("size", [vectors.SIZE, 64])
def test_alike_names_against_all_pairs(spark, size):
    draw = random.Random(6)
    parts = ["acme", "tools", "blue", "bird", "café", "north", "wind", "the", "shop", "x"]
    names = sorted({" ".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(120)} | {"Acme Tools", "ab", "a"})
    df = spark.createDataFrame([(n,) for n in [*names, names[0], None, "  "]], "vendor string")
    v = {n: brute_vector(n, size) for n in names}
    want = {(a, b): s for a in names for b in names if a < b and (s := sum(x * v[b].get(c, 0) for c, x in v[a].items())) >= 0.6 - 1e-9}
    got = {(r["a"], r["b"]): r["cosine"] for r in vectors.alike(df, size=size).collect()}
    assert got == {k: pytest.approx(s) for k, s in want.items()} and len(got) > 50
    if size > 64:
        assert vectors.candidates(vectors.vectors_of(df, "vendor"), 0.6).count() < len(names) * (len(names) - 1) / 4


def test_one_changed_entry_is_found_from_the_root(spark):
    log = spark.range(5000).selectExpr("id AS entry", "timestamp_seconds(1600000000 + id DIV 3) AS at", "concat('what ', id) AS what", "CASE WHEN id % 7 > 0 THEN id END AS n")
    kept = archive.nodes(archive.sealed(log, ["at", "entry"]))
    assert [r["n"] for r in kept.groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect()] == [5000, 313, 20, 2, 1]
    forged = log.withColumn("what", F.when(F.col("entry") == 3210, "other").otherwise(F.col("what")))
    found, read = archive.changed(kept, archive.nodes(archive.sealed(forged, ["at", "entry"])))
    assert [r["pos"] for r in found.collect()] == [3210] and read == 5
    same, read = archive.changed(kept, archive.nodes(archive.sealed(log.repartition(5), ["at", "entry"])))
    assert same.count() == 0 and read == 1
    sealed = archive.sealed(log, ["at", "entry"])
    young = merge.purge(sealed, "at", F.lit("2020-09-13 12:40:00").cast("timestamp"))
    assert 0 < young.count() < 5000 and archive.still_proved(kept, young)
    assert not archive.still_proved(kept, young.withColumn("archive_digest", F.when(F.col("entry") == 4999, "0").otherwise(F.col("archive_digest"))))
    assert archive.nodes(archive.sealed(log.limit(0), ["at", "entry"])).count() == 0


def test_sketches_merge_to_the_whole(spark):
    rows = spark.range(20_000).selectExpr("date_add(DATE'2026-01-01', CAST(id % 10 AS int)) AS day", "CAST(pmod(xxhash64(id), 100000) AS double) AS s", "concat('e', id % 3000) AS e", "id % 3000 < 600 AS hit")
    daily = sketches.daily_latency(rows, F.col("day"), F.col("s"))
    got, values = sketches.merged_latency(daily).first(), sorted(r["s"] for r in rows.collect())
    for q in (50, 90, 99):
        rank = sum(v <= got[f"p{q}"] for v in values) / len(values)
        assert got["n"] == 20_000 and abs(rank - q / 100) <= 0.0266
    assert sketches.merged_latency(daily.where("false")).first()["p50"] is None
    cover = sketches.merged_coverage(sketches.daily_coverage(rows, F.col("day"), F.col("e"), F.col("hit"))).first()
    assert cover["entities"] == pytest.approx(3000, rel=0.05) and cover["covered"] == pytest.approx(600, rel=0.05) and cover["coverage"] == pytest.approx(0.2, rel=0.1)


def files_of(folder):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_merges_rewrite_only_their_buckets(spark, tmp_path):
    table = Bucketed(spark, str(tmp_path / "t"), ["id"], 16)
    table.create(spark.range(1000).selectExpr("id", "id AS v").unionByName(spark.createDataFrame([(None, -1)], "id long, v long")))
    before = files_of(tmp_path / "t")
    new = spark.createDataFrame([(5, 50), (2000, 7), (None, 9)], "id long, v long")
    touched = table.merge(new, lambda old, n: merge.upsert(old, n, ["id"]))
    after = files_of(tmp_path / "t")
    assert {d for d, _ in before.keys() ^ after.keys()} == {f"{tmp_path}/t/bucket={b}" for b in touched} and len(touched) <= 3
    assert {r["id"]: r["v"] for r in table.read().collect()} == {i: i for i in range(1000)} | {5: 50, 2000: 7, None: 9}
    assert table.merge(new.limit(0), lambda old, n: old) == [] and files_of(tmp_path / "t") == after
    lone = Bucketed(spark, str(tmp_path / "u"), ["id"], 4)
    lone.create(spark.createDataFrame([(1, 1)], "id long, v long").unionByName(spark.range(50, 60).selectExpr("id", "id AS v")))
    lone.merge(lone.read(), lambda old, n: old.where("id = 1"))
    assert [r["id"] for r in lone.read().collect()] == [1]
    with pytest.raises(ValueError):
        table.merge(new, lambda old, n: spark.range(100).selectExpr("id", "id AS v"))


def test_a_failed_run_goes_on_where_it_failed(spark, tmp_path):
    calls = []

    def stage(name, work):
        return (name, "1", lambda df: calls.append(name) or work(df))

    def broken(df):
        raise RuntimeError("the third stage fails")

    one, two, four = stage("one", lambda d: d.withColumn("v", F.col("id") * 2)), stage("two", lambda d: d.where("v % 3 = 0")), stage("four", lambda d: d.agg(F.sum("v").alias("s")))
    start, run = spark.range(100), Resumable(spark, str(tmp_path / "run"))
    with pytest.raises(RuntimeError):
        run.run(start, [one, two, ("three", "1", broken), four])
    assert calls == ["one", "two"]
    out, ran = Resumable(spark, str(tmp_path / "run")).run(start.repartition(7), [one, two, stage("three", lambda d: d), four])
    assert ran == ["three", "four"] and out.first()["s"] == sum(2 * i for i in range(100) if 2 * i % 3 == 0)
    assert run.run(start, [one, two, stage("three", lambda d: d), four])[1] == []
    assert run.run(spark.range(101), [one, two, stage("three", lambda d: d), four])[1] == ["one", "two"]  # row 100 falls out in two
    assert fingerprint(start) == fingerprint(start.orderBy(F.desc("id"))) != fingerprint(start.unionByName(spark.createDataFrame([(5,)], "id long")))


def test_lineage_and_alerts_of_an_audit(spark):
    flags = spark.createDataFrame([("f1", "t1"), ("f2", "t2"), ("f3", "t9")], "flag_id string, txn_id string")
    txns = spark.createDataFrame([("t1", "bank", date(2026, 1, 1)), ("t2", "card", date(2026, 1, 2))], "txn_id string, source string, date date")
    links = spark.createDataFrame([("l1", "t1", "m1", "email", "tier1_exact", True), ("l2", "t1", "c1", "calendar_event", "tier3_fuzzy", True), ("l3", "t2", "m2", "email", "tier1_exact", False)], "link_id string, source_id string, target_id string, target_type string, match_tier string, is_current boolean")
    got = sorted((tuple(r)[:3] + (r["linked_id"],) for r in audit.lineage(flags, links, txns).collect()), key=str)
    assert got == [("f1", "t1", "bank", "c1"), ("f1", "t1", "bank", "m1"), ("f2", "t2", "card", None), ("f3", "t9", None, None)]
    fired = audit.alerts(spark.createDataFrame([(0.3, 5, None)], "rate double, n int, gap double"), {"rate": (">", 0.2), "n": ("<", 5), "gap": (">", 1)}).collect()
    assert {r["metric"]: r["firing"] for r in fired} == {"rate": True, "n": False, "gap": None}
