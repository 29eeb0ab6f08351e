"""Escalation from all findings, recurring vendors, batches, missing receipts, pairs for a closer look, lineage graphs."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import escalation, reconcile
from tallyloom.plans import audit

SIGNALS = "txn_id string, is_unmatched boolean, anomaly_score int, email_approval boolean, receipt_found boolean"


def test_severity_of_every_combination(spark):
    rows = [(f"{u}{a}{e}{r}", u, a, e, r) for u in (True, False, None) for a in (70, 71, None) for e in (True, False, None) for r in (True, False, None)]
    got = {r["txn_id"]: r for r in escalation.contextual_severity(spark.createDataFrame(rows, SIGNALS)).collect()}
    for k, u, a, e, r in rows:
        parts = [(40, "No matching bank transaction found")] * bool(u) + [(30, "Anomaly score 71")] * (a == 71) + [(20, "No email approval located")] * (not e) + [(10, "Receipt not found")] * (not r)
        score = sum(w for w, _ in parts)
        text = "Flagged because: " + ", ".join(f"({i}) {x}" for i, (_, x) in enumerate(parts, 1)) + "." if parts else None
        assert (got[k]["score"], got[k]["explanation"]) == (score, text)
        assert got[k]["severity"] == ("CRITICAL" if score >= 70 else "WARNING" if score >= 50 else "INFO")
    assert escalation.contextual_severity(spark.createDataFrame([], SIGNALS)).count() == 0


def test_recurring_vendors_settle_by_one_level(spark):
    history = [("rent", 100.0 + (m % 2), date(2024, m, 3)) for m in range(1, 7)] + [("new", 100.0, date(2024, 1, d)) for d in range(1, 20)] + [("zero", 0.0, date(2024, m, 1)) for m in (1, 2, 3)] + [(None, 1.0, date(2024, 1, 1)), ("rent", None, date(2024, 9, 1)), ("rent", 900.0, None)]
    asked = [("a", "rent", 100.0, "CRITICAL"), ("b", "rent", 104.0, "WARNING"), ("c", "rent", 106.0, "WARNING"), ("d", "new", 100.0, "CRITICAL"), ("e", None, 100.0, "WARNING"), ("f", "zero", 0.0, "WARNING"), ("g", "rent", None, "INFO"), ("h", "rent", 100.0, "INFO")]
    out = escalation.settled(spark.createDataFrame(asked, "txn_id string, vendor string, amount double, severity string"), spark.createDataFrame(history, "vendor string, amount double, date date"))
    got = {r["txn_id"]: (r["severity"], r["is_settled"]) for r in out.collect()}
    assert got == {"a": ("WARNING", True), "b": ("INFO", True), "c": ("WARNING", False), "d": ("CRITICAL", False), "e": ("WARNING", False), "f": ("WARNING", False), "g": ("INFO", False), "h": ("INFO", True)}
    assert out.columns == ["txn_id", "vendor", "amount", "severity", "is_settled"]


def test_batches_hold_every_uncertain_row_once(spark):
    rows = [(f"t{i:04d}", i % 101) for i in range(3000)]
    out = escalation.uncertain(spark.createDataFrame(rows, "txn_id string, score int").repartition(5), ["txn_id"], size=50).collect()
    batches = [[r["txn_id"] for r in b["rows"]] for b in sorted(out, key=lambda b: b["batch"])]
    assert [x for b in batches for x in b] == [k for k, s in rows if 40 <= s <= 60]
    assert all(len(b) == 50 for b in batches[:-1]) and 0 < len(batches[-1]) <= 50 and [b["batch"] for b in sorted(out, key=lambda b: b["batch"])] == list(range(len(batches)))
    assert escalation.uncertain(spark.createDataFrame([], "txn_id string, score int"), ["txn_id"]).count() == 0


def test_missing_receipts_by_every_window(spark):
    draw, now = random.Random(4), date(2024, 3, 1)
    txns = [(f"t{i}", draw.choice(["a", "b", "aws", None]), draw.choice([None, 0.0, round(draw.uniform(1, 60), 2)]), draw.choice([None, now - timedelta(days=draw.randrange(60))])) for i in range(400)]
    found = [(f"r{i}", draw.choice([None, 0.0, -3.0, round(draw.uniform(1, 60), 2)]), draw.choice([None, now - timedelta(days=draw.randrange(60))])) for i in range(60)]
    t, f = spark.createDataFrame(txns, "txn_id string, vendor string, amount double, date date"), spark.createDataFrame(found, "receipt_id string, amount double, date date")
    fits = {k: any(a is not None and d and x is not None and e and abs((d - e).days) <= 7 and x * 0.95 <= a <= x * 1.05 for _, x, e in found) for k, _, a, d in txns}
    assert {r["txn_id"]: r["receipt_found"] for r in reconcile.with_receipt(t, f).collect()} == fits and 20 < sum(fits.values()) < 300
    want = {k for k, v, a, d in txns if a is not None and d and (now - d).days > 7 and v != "aws" and not fits[k]}
    exempt = spark.createDataFrame([("aws",), ("aws",), (None,)], "vendor string")
    got = [r["txn_id"] for r in escalation.missing_receipts(t, f, F.lit(now), exempt).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    assert {r["txn_id"] for r in escalation.missing_receipts(t, f, F.lit(now)).collect()} == {k for k, v, a, d in txns if a is not None and d and (now - d).days > 7 and not fits[k]}
    assert escalation.missing_receipts(t, f.limit(0), F.lit(now)).count() == len([1 for _, _, a, d in txns if a is not None and d and (now - d).days > 7])


def test_receipts_prefer_other_names_where_these_score_more(spark):
    """A vendor's own far row never hides a nearer row of a like name; rows without names take part."""
    from tallyloom.functions.similarity import sequence_ratio

    draw, day = random.Random(9), date(2024, 5, 1)
    name = lambda: draw.choice(["almond azure", "almond azur", "Almond Azure ", "blush", "blusk", "", None])
    txns = [(f"t{i:03d}", name(), draw.choice([0.0, 100.0, 101.0, 104.0]), day + timedelta(days=draw.randrange(20))) for i in range(150)]
    found = [(f"r{i:03d}", name(), draw.choice([0.0, 100.0, 103.0, None]), day + timedelta(days=draw.randrange(25))) for i in range(80)]
    schema = "{} string, vendor string, amount double, date date"
    got = {r["receipt_id"]: (r["txn_id"], r["confidence"]) for r in reconcile.receipts(spark.createDataFrame(found, schema.format("receipt_id")), spark.createDataFrame(txns, schema.format("txn_id"))).collect()}
    for k, v, x, d in found:
        best = max(((1 - (abs(a - x) / x if x else 0.0)) * 0.4 + (1 - abs((e - d).days) / 7) * 0.3 + 0.3 * (sequence_ratio(n, v) if n is not None and v is not None else 0.0), t) for t, n, a, e in txns if x is not None and abs((e - d).days) <= 7 and x * 0.95 <= a <= x * 1.05) if any(x is not None and abs((e - d).days) <= 7 and x * 0.95 <= a <= x * 1.05 for _, _, a, e in txns) else (0.0, None)
        assert got[k] == (best[1], pytest.approx(best[0], abs=0.0011))


def test_pairs_for_a_closer_look(spark):
    schema = "txn_id string, vendor string, amount double, date date"
    one = spark.createDataFrame([("a", "x", 1.0, date(2024, 1, 1)), ("b", "x", 2.0, date(2024, 1, 2)), ("b", "z", 2.0, date(2024, 1, 2)), ("c", None, None, None)], schema)
    two = spark.createDataFrame([("p", "y", 1.5, date(2024, 1, 3)), ("q", "x", 2.0, date(2024, 1, 2)), ("r", None, None, None)], schema)
    pairs = spark.createDataFrame([("a", "p", 0.85), ("b", "q", 0.6), ("a", "q", 0.9), ("c", "r", 0.5), ("c", "gone", None)], "source_1_id string, source_2_id string, confidence double")
    got = {(r["source_1_id"], r["source_2_id"]): r["reasons"] for r in reconcile.low_confidence(pairs, one, two).collect()}
    assert got == {("a", "p"): ["vendor name mismatch", "amount mismatch", "date mismatch"], ("b", "q"): [], ("c", "r"): ["date mismatch"]}


def test_graph_around_flags(spark):
    flags = spark.createDataFrame([("f1", "t1", "INFO"), ("f2", "t1", "CRITICAL"), ("f3", "t2", "INFO")], "flag_id string, txn_id string, severity string")
    links = spark.createDataFrame([("t1", "m1", "tier1", True), ("t1", "m2", "tier2", True), ("t1", "m3", "tier2", False)], "source_id string, target_id string, match_tier string, is_current boolean")
    txns = spark.createDataFrame([("t1", "bank"), ("t3", "bank")], "txn_id string, source string")
    got = sorted(tuple(r) for r in audit.lineage_edges(flags, links, txns).collect())
    assert got == sorted([("bank", "t1", "recorded"), ("t1", "m1", "matched by tier1"), ("t1", "m2", "matched by tier2"), ("t1", "f1", "flagged"), ("t1", "f2", "flagged"), ("t2", "f3", "flagged"), ("f1", "INFO", "classified"), ("f2", "CRITICAL", "classified"), ("f3", "INFO", "classified")])


def test_graph_of_repeated_rows_is_freed_of_repeats_by_kind(spark):
    """Each edge once, also of links, transactions and flags that repeat; no row is multiplied before repeats go."""
    flags = spark.createDataFrame([("f1", "t1", "INFO"), ("f1", "t1", "INFO"), ("f1", "t2", "INFO"), ("f2", None, "INFO"), ("f3", "gone", None)], "flag_id string, txn_id string, severity string")
    links = spark.createDataFrame([("t1", "m1", "tier1", True), ("t1", "m1", "tier1", True), ("t2", "m1", None, True), ("gone", "m2", "tier1", True), ("t9", "m9", "tier1", True)], "source_id string, target_id string, match_tier string, is_current boolean")
    txns = spark.createDataFrame([("t1", "bank"), ("t1", "bank"), ("t1", "card"), ("t2", None), ("t9", "bank")], "txn_id string, source string")
    out = audit.lineage_edges(flags, links, txns)
    want = [("bank", "t1", "recorded"), ("card", "t1", "recorded"), ("t1", "m1", "matched by tier1"), ("t2", "m1", None), ("gone", "m2", "matched by tier1"), ("t1", "f1", "flagged"), ("t2", "f1", "flagged"), ("gone", "f3", "flagged"), ("f1", "INFO", "classified"), ("f2", "INFO", "classified")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
