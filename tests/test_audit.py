from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.config import AuditRules
from tallyloom.operators import access, anomaly, context, datagen, feedback, metrics, quality, reconcile, severity
from tallyloom.plans import audit
from tallyloom.schemas import CONSENT, LINK, PREFERENCE
from tallyloom.sources import files
from tallyloom.sources.store import Store
from tallyloom.streaming import incremental


def test_completeness(spark):
    df = spark.createDataFrame([("v", 1.0, "d", "s")] * 3 + [(None, 1.0, "d", "s"), ("v", 1.0, "d", None)], "vendor string, amount double, date string, source string")
    r = quality.completeness(df).first()
    assert (r["total_records"], r["missing_vendor"], r["missing_source"], r["completeness_score"]) == (5, 1, 1, 0.9)
    assert quality.completeness(df.limit(0)).first()["completeness_score"] == 0.0
    assert quality.completeness(df.drop("vendor")).first()["missing_vendor"] == 5


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1, "x1"), ("a", 1, "x2"), ("b", 2, "x3"), ("b", 2, "x4"), ("c", 3, "x5"), (None, 4, "x6"), (None, 4, "x7")], "vendor string, amount int, id string")
    r = quality.duplicate_summary(df, ["vendor", "amount"]).first()
    assert (r["duplicate_count"], r["duplicate_groups"]) == (6, 2)
    assert {tuple(g["ids"]) for g in quality.duplicate_groups(df, ["vendor", "amount"], "id").collect()} == {("x1", "x2"), ("x3", "x4")}
    assert quality.duplicate_summary(df, ["nothing"]).first()["duplicate_count"] == 0


def test_outliers(spark):
    df = spark.createDataFrame([(i, 100.0 + i % 3) for i in range(20)] + [(99, 10000.0)], "id int, amount double")
    assert [r["id"] for r in anomaly.global_outliers(df, "amount").where("is_outlier").collect()] == [99]
    assert anomaly.global_outliers(df.limit(1), "amount").first()["z_score"] == 0.0


def test_combined_score(spark):
    df = spark.createDataFrame([("a", True, False, False, False), ("b", True, True, False, True), ("c", None, False, False, False)], "txn_id string, is_anomaly_if boolean, is_vendor_outlier boolean, is_amount_outlier boolean, is_time_series_deviation boolean")
    assert {r["txn_id"]: r["anomaly_score"] for r in anomaly.combined_score(df).collect()} == {"a": 30, "b": 80, "c": 0}


def test_isolation_forest_finds_the_odd_ones(spark):
    rows = [(f"t{i}", 100.0 + i % 7, "2026-01-05", f"v{i % 3}") for i in range(300)] + [("odd", 1e9, "2026-01-31", "zzz")]
    df = spark.createDataFrame(rows, "txn_id string, amount double, date string, vendor string").withColumn("date", F.to_date("date"))
    out = anomaly.isolation_forest(df, "txn_id", "amount", "date", "vendor", below=0.0)
    assert out.where("txn_id = 'odd'").first()["is_anomaly_if"]
    assert out.count() == 301 and anomaly.isolation_forest(df.limit(0), "txn_id", "amount", "date", "vendor").count() == 0


@pytest.mark.parametrize(("scores", "want", "target"), [([0.92, 0.65], "resolve", "c0"), ([0.80, 0.78], "escalate", None), ([0.75], "resolve", "c0"), ([0.5, 0.9], "resolve", "c1"), ([0.8, 0.8], "escalate", None)])
def test_ambiguity(spark, scores, want, target):
    df = spark.createDataFrame([("s", [f"c{i}" for i in range(len(scores))], scores)], "source_entity_id string, candidate_ids array<string>, candidate_scores array<double>")
    r = severity.resolve_ambiguity(df).first()
    assert (r["decision"], r["target_id"]) == (want, target)


def test_severity(spark):
    cases = [("a", "v", 6000.0, True, False, False, False), ("b", "v", 100.0, True, False, False, False), ("c", "v", 100.0, True, True, False, False), ("d", "v", 20.0, False, True, False, False), ("e", "w", 100.0, False, True, True, True), ("f", "v", 10.0, False, False, False, False), ("g", None, None, True, True, False, False)]
    df = spark.createDataFrame(cases, "txn_id string, vendor string, amount double, is_unmatched boolean, is_incomplete boolean, is_duplicate boolean, email_approval boolean")
    got = {r["txn_id"]: (r["score"], r["severity"]) for r in severity.audit_severity(df, AuditRules(whitelisted=("w",))).collect()}
    assert got == {"a": (70, "CRITICAL"), "c": (80, "CRITICAL"), "e": (50, "INFO"), "g": (80, "CRITICAL")}
    texts = {r["txn_id"]: r["explanation"] for r in severity.audit_severity(df).collect()}
    assert texts["a"] == "Flagged because: No matching bank transaction found for $6000.0 to v; Transaction amount $6000.0 exceeds high-value threshold."


def test_tool_severity(spark):
    df = spark.createDataFrame([(20000.0, True, True), (5000.0, True, True), (1.0, False, False)], "amount double, is_unmatched boolean, is_incomplete boolean")
    assert [(r["score"], r["severity"], r["confidence"]) for r in severity.tool_severity(df).collect()] == [(100, "CRITICAL", 1.0), (80, "CRITICAL", 0.67), (0, "INFO", 0.0)]


def test_audit_and_flags(spark):
    df = spark.createDataFrame([("t1", "v", 9000.0, "2026-01-01"), ("t2", "v", 10.0, "2026-01-01"), ("t3", None, 70.0, "2026-01-02"), ("t4", "u", 70.0, "2026-01-03")], "txn_id string, vendor string, amount double, date string")
    scored = audit.audit(df, df.where("txn_id = 't4'").select("txn_id"), ["vendor", "date"])
    got = {r["txn_id"]: r["severity"] for r in scored.collect()}
    assert got == {"t1": "CRITICAL", "t3": "INFO"}  # t2 is small information, t4 lacks only its match
    flags = audit.audit_flags(scored, "run", F.lit("2026-02-01").cast("timestamp"))
    assert flags.select("flag_id").distinct().count() == 2


def test_orphans(spark):
    df = spark.createDataFrame([(1, "v", "a"), (1, "v", "b"), (2, "v", "a"), (2, "v", "a"), (3, None, "a")], "amount int, vendor string, source string")
    assert reconcile.orphans(df, ["amount", "vendor"]).count() == 2


def test_receipts(spark):
    found = spark.createDataFrame([("r1", "AWS", 100.0, "2025-02-01"), ("r2", "None", 5.0, "2025-02-01")], "receipt_id string, vendor string, amount double, date string")
    txns = spark.createDataFrame([("t1", "AWS", 100.0, "2025-02-03"), ("t2", "AWS", 104.0, "2025-02-01"), ("t3", "AWS", 100.0, "2025-02-09")], "txn_id string, vendor string, amount double, date string")
    got = {r["receipt_id"]: (r["txn_id"], r["confidence"], r["date_delta_days"]) for r in reconcile.receipts(found, txns).collect()}
    assert got == {"r1": ("t2", 0.984, 0), "r2": (None, 0.0, None)}


def test_approvals(spark):
    rows = [("a", 2, "bob", "LGTM, please pay"), ("a", 1, "ann", "hello"), ("a", 3, "cy", "approved"), ("b", 1, "dee", None)]
    df = spark.createDataFrame(rows, "thread string, at int, sender string, body string")
    got = {r["thread_id"]: (r["approved"], r["approver"], r["keyword"]) for r in context.approvals(df, "thread", ["at"], "sender", "body").collect()}
    assert got == {"a": (True, "bob", "lgtm"), "b": (False, None, None)}


def test_confusion(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "txn_id string")
    r = metrics.confusion(ids("abc"), ids("bcd"), total=10).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 6) and r["f1"] == pytest.approx(2 / 3)
    assert metrics.confusion(ids(""), ids("")).first()["precision"] is None


def test_corruptions_and_their_detection(spark):
    clean = spark.range(4000).selectExpr("concat('T', id) AS txn_id", "concat('V', id % 40) AS vendor", "CAST(id AS double) AS amount", "date_add(DATE'2026-01-01', CAST(id % 50 AS int)) AS date")
    holes = datagen.missing_fields(clean)
    truth = holes.where("size(nulled) > 0").select("txn_id")
    assert 0.12 < truth.count() / 4000 < 0.18
    found = holes.where("vendor IS NULL OR amount IS NULL OR date IS NULL").select("txn_id")
    assert metrics.confusion(found, truth, total=4000).first()["f1"] == 1.0
    copies = datagen.duplicates(clean)
    assert copies.where("copy_of IS NOT NULL").count() == copies.count() - 4000 > 600
    cards, bank = datagen.orphans(clean, clean.withColumn("txn_id", F.concat(F.lit("B"), "txn_id")))
    assert cards.where("is_phantom").count() == 50 and bank.count() == 3990 and cards.where("is_phantom").agg(F.min("amount")).first()[0] >= 5000


def test_feedback_tuning(spark):
    rows = [("v1", "amount_outlier x", "false_positive")] * 9 + [("v1", "amount_outlier x", "approved")] + [("v2", "other", "approved")] * 5
    flags = spark.createDataFrame(rows, "vendor string, explanation string, human_decision string")
    rules, whitelist = feedback.tuned(flags)
    assert [r["vendor"] for r in whitelist.collect()] == ["v1"] and rules.sigma_global == 2.5


def test_feedback_tuning_lists_all_noisy_vendors(spark):
    flags = spark.range(10_500).select(F.format_string("v%05d", "id").alias("vendor"), F.lit("other").alias("explanation"), F.lit("false_positive").alias("human_decision"))
    rules, whitelist = feedback.tuned(flags, AuditRules(whitelisted=("old", "v00001")))
    assert sorted(r["vendor"] for r in whitelist.collect()) == ["old", *(f"v{i:05d}" for i in range(10_500))]
    last = severity.whitelisted(spark.createDataFrame([("v10499",), ("v99999",), (None,)], "vendor string"), whitelist)
    got = last.select("vendor", severity.escalated(F.lit("WARNING"), F.lit(500.0), F.col("vendor"), rules, F.col("is_whitelisted")).alias("s")).collect()
    assert {r["vendor"]: r["s"] for r in got} == {"v10499": "INFO", "v99999": "WARNING", None: "WARNING"}
    assert len(last._jdf.queryExecution().optimizedPlan().toString()) < 20_000  # no list of names in the plan


def test_whitelist_in_the_audit(spark):
    row = ("e", "w", 100.0, False, True, True, True)
    df = spark.createDataFrame([row], "txn_id string, vendor string, amount double, is_unmatched boolean, is_incomplete boolean, is_duplicate boolean, email_approval boolean")
    listed = severity.whitelisted(df, spark.createDataFrame([("w",)], "vendor string"))
    assert [r["severity"] for r in severity.audit_severity(listed).collect()] == ["INFO"]
    assert [r["severity"] for r in severity.audit_severity(df).collect()] == ["WARNING"]


def test_ties_between_links_go_to_the_least_id(spark):
    rows = [(f"L{i:03d}", "t1", "transaction", 0.9, True) for i in range(20)] + [("L999", "t1", "transaction", None, True), ("A", "t1", "transaction", 0.95, False), ("B", "t2", "transaction", None, True)]
    links = spark.createDataFrame(rows, "link_id string, source_id string, source_type string, confidence double, is_current boolean").repartition(3)
    assert {(r["txn_id"], r["link_id"]) for r in feedback.best_link(links).collect()} == {("t1", "L000"), ("t2", "B")}


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0.95,), (0.9,), (0.7,), (0.5,), (0.1,), (None,)], "c double")
    assert [r["b"] for r in df.select(metrics.confidence_band(F.col("c")).alias("b")).collect()] == ["high", "high", "medium", "ambiguous", "none", "none"]


def test_confusion_of_every_set_at_once(spark):
    rows = [(s, i) for s in ("a", "b", None) for i in range(12)] + [("a", 3)]
    every = spark.createDataFrame(rows, "s string, txn_id int")
    got = {r["s"]: r for r in metrics.confusion_by(every.where("txn_id % 3 = 0"), every.where("txn_id % 2 = 0"), every, "s").collect()}
    assert got.keys() == {"a", "b", None}
    for s in got:
        own = every.where(F.col("s").eqNullSafe(F.lit(s)))
        one = metrics.confusion(own.where("txn_id % 3 = 0"), own.where("txn_id % 2 = 0"), total=12).first()
        assert all(got[s][c] == one[c] for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"))


def test_small_reports(spark):

    one = spark.createDataFrame([(i,) for i in range(3)], "txn_id int")
    two = spark.createDataFrame([(i,) for i in range(12)], "txn_id int")
    assert metrics.coverage(one, two).first()["coverage"] == 0.25 and metrics.coverage(one.limit(0), two.limit(0)).first()["coverage"] == 0.0
    assert reconcile.match_rate(two, one).first()["match_rate"] == 0.25
    dated = spark.createDataFrame([("bank", datetime(2026, 1, d)) for d in (1, 2, 3)] + [("card", datetime(2026, 1, 2)), (None, datetime(2026, 1, 2))], "source string, date timestamp")
    assert reconcile.in_range(dated, "bank", "2026-01-02", "2026-01-03").count() == 2


def rolling(values, rows=3):
    out = []
    for i, v in enumerate(values):
        known = [x for x in values[max(0, i - rows + 1) : i + 1] if x is not None]
        mean = sum(known) / len(known) if known else None
        pct = None if v is None or mean is None else (float("inf") if v else None) if mean == 0 else abs(v - mean) / abs(mean) * 100
        out.append((mean, pct is not None and pct > 20))
    return out


def test_rolling_deviation_counts_the_first_rows(spark):
    values = [100.0, 150.0, 100.0, None, 0.0, 5.0, -5.0, 100.0]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(values)] + [("few", 0, 1.0), ("few", 1, 9.0)], "vendor string, at int, amount double")
    got = {(r["vendor"], r["at"]): (r["rolling_mean"], r["is_deviation"]) for r in anomaly.rolling_deviation(df, ["at"], "amount", ["vendor"]).collect()}
    for i, (mean, off) in enumerate(rolling(values)):
        assert got["v", i] == (pytest.approx(mean), off)
    assert got["few", 0] == got["few", 1] == (None, False)


@pytest.mark.parametrize(("n", "parts"), [(500, "7"), (3, "8"), (2, "4"), (1, "2"), (0, "2")])
def test_rolling_deviation_over_all_rows(spark, n, parts):
    from tallyloom.operators import ordered

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = [float(i * 7919 % 101) if i % 11 else None for i in range(n)]
        df = spark.createDataFrame([(i // 5 if i > 3 else None, i, x) for i, x in enumerate(values)], "day int, id int, amount double").repartition(3)
        got = {r["id"]: (r["rolling_mean"], r["is_deviation"]) for r in ordered.rolling_deviation(df, ["day", "id"], "amount").collect()}
        assert got.keys() == set(range(n))
        for i, (mean, off) in enumerate(rolling(values)):
            assert got[i] == ((pytest.approx(mean), off) if n >= 3 else (None, False))
        held = ordered.with_halo(ordered.ranged(df, ["day", "id"]), ["day", "id"], 2).groupBy("__part").agg(F.count_if("__halo").alias("halo"), F.count_if(~F.col("__halo")).alias("own")).collect()
        assert sum(r["own"] for r in held) == n and all(r["halo"] <= 2 for r in held) and (n < 500 or max(r["own"] for r in held) < n / 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join(spark, strict):
    import random

    from tallyloom.operators import ordered

    draw = random.Random(5)
    make = lambda k, n: [(draw.choice(["hot"] * 6 + ["a", "b", None]), draw.choice([None, *range(60)]), f"{k}{i}", draw.choice([None, 1.0, 2.0])) for i in range(n)]
    left, right = make("l", 300), make("r", 120)
    schema = "vendor string, at int, id string, amount double"
    got = {r["id"]: (r["last_id"], r["last_amount"]) for r in ordered.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "vendor", "at", "id", ["id", "amount"], strict).collect()}
    assert len(got) == 300
    for v, at, i, _ in left:
        rows = [(t, r, x) for w, t, r, x in right if w == v and v is not None and at is not None and t is not None and (t < at if strict else t <= at)]
        assert got[i] == (max(rows)[1:] if rows else (None, None)), i


def test_recency_of_a_hot_vendor(spark):
    from tallyloom.operators import ordered

    df = spark.range(2000).selectExpr("concat('v', CASE WHEN id % 4 > 0 THEN 0 ELSE id END) AS vendor", "id AS txn_id", "date_add(DATE'2026-01-01', CAST(id DIV 10 AS int)) AS date", "CAST(id % 7 AS double) AS amount")
    rows = {r["txn_id"]: r for r in ordered.recency(df, "vendor", "date", "txn_id", "amount").collect()}
    hot = [i for i in range(2000) if i % 4]
    for i in hot:
        before = [j for j in hot if j // 10 < i // 10]
        want = (1.0, (i % 7 - before[-1] % 7) / (before[-1] % 7) if before[-1] % 7 else None) if before else (None, None)
        assert (rows[i]["days_since"], rows[i]["amount_change"]) == (want[0], pytest.approx(want[1]) if want[1] is not None else None)
    assert all(rows[i]["days_since"] is None for i in range(4, 2000, 4))


def store_with_links(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    t = datetime(2026, 1, 1)
    store.replace("entity_links", spark.createDataFrame([("l1", "t1", "m1", "transaction", "email", "deterministic", "tier1_exact", 1.0, "k", "1.0", t, t, None, True, None), ("l2", "t2", "m1", "transaction", "email", "deterministic", "tier1_exact", 1.0, "k", "1.0", t, t, t, False, None)], LINK))
    store.replace("user_consents", spark.createDataFrame([("u1", "read", False, datetime(2026, 1, 1), None), ("u1", "read", True, datetime(2026, 1, 2), None), ("u2", "read", True, t, datetime(2026, 1, 3)), ("u3", "read", True, t, None)], CONSENT))
    store.replace("user_preferences", spark.createDataFrame([("u3", "opt_out", "true", t)], PREFERENCE))
    return store


def test_governed_reads(spark, tmp_path):
    store = store_with_links(spark, tmp_path)
    api = access.Queries(store, "tester", F.lit("2026-02-01").cast("timestamp"))
    assert [(r["other_id"], r["other_type"]) for r in api.linked_entities("m1", "email", "u1").collect()] == [("t1", "transaction")]
    for user in ("u2", "u3", "nobody"):
        with pytest.raises(access.ConsentRequired):
            api.linked_entities("m1", "email", user)
    with pytest.raises(ValueError):
        api.write_feedback("l1", "maybe", "human", "", "u1")
    api.write_feedback("l1", "rejected", "human", "x" * 2000, "u1")
    assert len(store.read("link_feedback").first()["reason"]) == 1000
    assert sorted(r["method"] for r in store.read("access_audit_log").collect()) == ["linked_entities", "write_feedback"] and len(store.read("access_audit_log").first()["entity_hash"]) == 12
    api.erase("m1")
    assert store.read("entity_links").count() == 0 and store.read("link_feedback").count() == 0
    assert store.read("deletion_audit").first()["rows_deleted"] == 3


def test_nested_payloads(spark):
    m = '{"id":"1","receivedDateTime":"2026-01-01T00:00:00Z","sender":{"emailAddress":{"address":"a@b.c"}},"toRecipients":[{"emailAddress":{"address":"x@y.z"}},{"emailAddress":{}}],"subject":"s","bodyPreview":"%s"}' % ("p" * 300)
    e = '{"id":"1","start":{"dateTime":"2026-01-01T00:00:00"},"end":{"dateTime":"2026-01-01T01:00:00"},"organizer":{"emailAddress":{"address":"o"}},"attendees":[{"emailAddress":{}}]}'
    r = files.messages(spark.createDataFrame([(m,), ('{"id":"2"}',)], "value string")).collect()
    assert len(r) == 1 and r[0]["recipients"] == ["x@y.z"] and len(r[0]["body_preview"]) == 255
    assert files.calendar(spark.createDataFrame([(e,)], "value string")).first()["attendees"] is None


def test_paged_source(spark):
    def fetch(offset, count):
        return [(i,) for i in range(offset, min(1201, offset + count))], 1201

    df = files.paged(spark, fetch, "id long")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 1201 and df.distinct().count() == 1201


def test_streams_take_files_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    spark.range(5).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    go = lambda: incremental.take_new(spark, str(src), schema, lambda b, _: seen.append(b.count()), str(tmp_path / "state")).awaitTermination()
    go()
    spark.range(7).write.mode("append").parquet(str(src))
    go()
    assert sum(seen) == 12


def test_source_choice():
    assert files.choose("smb", None) == "fixture" and files.choose(None, "t") == "live" and files.choose(None, None) == "fixture"
    with pytest.raises(PermissionError):
        files.choose(None, None, secure=True)


def test_receipts_write_no_pairs(spark, monkeypatch):
    """Near rows of many names: what a receipt meets is never written, and the best of it is found."""
    written, inner = [], reconcile.cut
    monkeypatch.setattr(reconcile, "cut", lambda df: written.append(df.count()) or inner(df))
    day = date(2026, 1, 1)
    found = spark.createDataFrame([(f"r{k}", f"v{k % 5}", 100.0 + k / 100, day) for k in range(200)], "receipt_id string, vendor string, amount double, date date")
    txns = spark.createDataFrame([(f"t{k:03d}", f"w{k % 7}", 100.0 + k / 100, day) for k in range(200)], "txn_id string, vendor string, amount double, date date")
    got = {r["receipt_id"]: r["date_delta_days"] for r in reconcile.receipts(found, txns).collect()}
    assert got == {f"r{k}": 0 for k in range(200)} and sum(written) <= 200


def test_nearest_transactions_of_a_cell_against_loops(monkeypatch):
    import random
    from datetime import timedelta

    import pyarrow as pa

    from tallyloom.functions.similarity import sequence_ratio

    monkeypatch.setattr(reconcile, "LOOKUPS", 7)
    draw = random.Random(4)
    for _ in range(30):
        name, amount = (lambda: draw.choice(["almond", "almont", "blush", None])), (lambda: draw.choice([0.0, 100.0, 101.0, 104.0, 104.5]))
        asked = [(name(), amount(), draw.randrange(12)) for _ in range(draw.randrange(1, 12))]
        held = [(f"t{k:02d}", name(), amount(), draw.randrange(3, 9)) for k in range(draw.randrange(1, 25))]
        held = list({h[1:]: h for h in held}.values())  # of equal rows the last id, as the cell gets them
        one = pa.table({"r_vendor": pa.array([a for a, _, _ in asked], pa.string()), "r_amount": pa.array([a for _, a, _ in asked]), "r_day": pa.array([a for _, _, a in asked])})
        two = pa.table({"txn_id": pa.array([h[0] for h in held]), "vendor": pa.array([h[1] for h in held], pa.string()), "amount": pa.array([h[2] for h in held]), "day": pa.array([h[3] for h in held])})
        got = {a: (s, held[b][0]) for a, b, s, _, _ in zip(*(c.tolist() for c in reconcile._nearest(one, two, 4, 0.05)), strict=True)}
        for k, (v, x, d) in enumerate(asked):
            near = [((1 - (abs(a - x) / x if x else 0.0)) * 0.4 + (1 - abs(e - d) / 4) * 0.3 + sequence_ratio(n, v) * 0.3, t) for t, n, a, e in held if abs(e - d) <= 4 and x * (1 - 0.05) <= a <= x * (1 + 0.05)]
            assert got.get(k) == (max(near) if near else None)
