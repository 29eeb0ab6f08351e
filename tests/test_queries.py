"""Every query with SQL gives the rows of its SQL, on small tables made here."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry

SLOW = {"pipeline"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, at = random.Random(2), tmp_path_factory.mktemp("tables")
    t0 = datetime(2024, 1, 1)
    names = ["almond azure", "blush bisque", "almond azur", "chiffon coral", "blush bisk"]
    rows = {
        "orders": ([(i, draw.randrange(1, 60), "O", round(draw.uniform(10, 500000), 2), t0 - timedelta(days=draw.randrange(12000)), "1") for i in range(1, 400)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(draw.randrange(1, 60), draw.randrange(1, 200), draw.randrange(1, 9), draw.randrange(1, 4), i * 1500.5, t0 - timedelta(days=i * 37 % 12000)) for i in range(300)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp"),
        "events": ([(i, draw.randrange(1, 9), t0 + timedelta(hours=draw.randrange(720)), draw.choice(["click", "purchase", "view"]), round(draw.uniform(1, 100), 3), "{}") for i in range(400)], "event_id long, user_id long, ts timestamp, event_type string, value double, props string"),
        "part": ([(i, draw.choice(names), "Brand#1", draw.choice(["TIN", "BRASS"]), draw.randrange(1, 50), 1.0) for i in range(1, 120)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, f"S{i}", 1, 0.0) for i in range(1, 20)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "customer": ([(i, f"Customer {i}", 1, 0.0, draw.choice(["BUILDING", "AUTOMOBILE", "MACHINERY"])) for i in range(1, 60)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "documents": ([(i, f"text {i} mail me{i}@x.org, call 415-555-0{i:03d} or 4111 1111 1111 1111", "en", "s", 10) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long"),
        "conversations": ([(c, t, draw.choice(["user", "system"]), draw.choice(["the end", "from with", "nothing", "with the"])) for c in range(12) for t in range(5)], "conv_id long, turn long, role string, text string"),
        "embeddings": ([(i, [draw.random() for _ in range(8)], 0) for i in range(40)], "vec_id long, embedding array<float>, label int"),
        "pages": ([(i, f"http://{h}.example.com/{p}/x?y", "<p>hi</p>") for i, (h, p) in enumerate((h, p) for h in ("www", "m", "a.www") for p in ("en", "es", ""))], "page_id long, url string, html string"),
        "benchmark": ([(1, "x")], "item_id long, text string"), "labels": ([(1, 1, 0)], "doc_id long, quality int, toxic int"), "region": ([(1, "r")], "r_regionkey int, r_name string"), "nation": ([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    con = duckdb.connect()
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).toPandas()  # the types hold
        spark.createDataFrame(data, schema).toArrow()
        import pyarrow.parquet as pq

        pq.write_table(spark.createDataFrame(data, schema).toArrow(), at / f"{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), con


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    import pandas as pd

    return sorted(str([None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k not in SLOW))
def test_against_sql(spark, tables, name):
    at, con = tables
    got, want = entry.queries()[name](spark, at).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_without_sql_has_a_test_of_its_own():
    """The training-data operators are tested in tests/llm."""
    assert {k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"} == {"r10_isolation_forest", "c9_sequence_ratio", "j4_weighted", "j10_receipts", "a13_latency_sketch", "a16_coverage_sketch"}


def test_sequence_ratio_and_visible_text(spark, tables):
    import difflib

    at, con = tables
    want = {k: round(difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio(), 3) for k, a, b in con.sql("SELECT p_partkey, p_name, p_type FROM part").fetchall()}
    assert {r["p_partkey"]: r["score"] for r in entry.queries()["c9_sequence_ratio"](spark, at).collect()} == want
    assert {r["text"] for r in entry.queries()["c14_visible_text"](spark, at).collect()} == {"hi"}


def test_weighted_tier(spark, tables):
    from tallyloom.functions.similarity import weighted_ratio
    from tallyloom.plans import canonical as C

    at, _ = tables
    source, target = (d.collect() for d in C.part_entities(spark, at))
    want = {}
    for s in source:
        scores = [x for t in target if abs((s["day"] - t["day"]).days) <= 3 and (x := weighted_ratio(s["fuzzy"], t["fuzzy"]) / 100) >= 0.8]
        if scores:
            want[s["entity_id"]] = (pytest.approx(max(scores)), "fuzzy:subject:%.2f" % scores[0] if len(scores) == 1 else "ambiguous")
    got = {r["source_id"]: (r["confidence"], r["linkage_key"]) for r in entry.queries()["j4_weighted"](spark, at).collect()}
    assert got == want and len(got) > 20


def test_isolation_forest_of_all_rows(spark, tables):
    from tallyloom.operators import anomaly
    from tallyloom.plans import canonical as C

    rows = anomaly.isolation_forest(C.gold(spark, tables[0]), "txn_id", "amount", "date", "vendor").collect()
    scores = sorted(r["isolation_score"] for r in rows)
    cut = rows[0]["decision_score"] + rows[0]["isolation_score"]
    assert len(rows) == 399 and 0 < scores[0] and scores[-1] < 1 and scores[int(0.93 * 399)] <= cut <= scores[int(0.97 * 399)]
    assert all(r["decision_score"] == pytest.approx(cut - r["isolation_score"]) and r["is_anomaly_if"] == (r["decision_score"] < -0.5) for r in rows)
    loose = anomaly.isolation_forest(C.gold(spark, tables[0]), "txn_id", "amount", "date", "vendor", below=0.0)
    assert 10 <= loose.where("is_anomaly_if").count() <= 20


def test_receipts_of_every_transaction(spark, tables):
    from tallyloom.functions.similarity import sequence_ratio

    at, con = tables
    rows = con.sql("SELECT o_orderkey, 'Vendor ' || (o_custkey % 50), o_totalprice, CAST(o_orderdate AS date) FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0").fetchall()
    want = {}
    for k, v, a, d in rows:
        r, day = a * 1.01, d + timedelta(days=2)
        near = [(t, x, y, e) for t, x, y, e in rows if abs((e - day).days) <= 7 and r * 0.95 <= y <= r * 1.05]
        want[f"R{k}"] = max(((1 - abs(y - r) / r) * 0.4 + (1 - abs((e - day).days) / 7) * 0.3 + 0.3 * sequence_ratio(x, v), f"T{t}") for t, x, y, e in near)
    got = {r["receipt_id"]: r for r in entry.queries()["j10_receipts"](spark, at).collect()}
    assert got.keys() == want.keys() and len(got) > 250
    assert all(got[k]["txn_id"] == t and got[k]["confidence"] == pytest.approx(s, abs=0.001) for k, (s, t) in want.items())


def test_evidence_and_ambiguity_of_all_rows(spark, tables):
    at, con = tables
    count = lambda name: entry.queries()[name](spark, at).select("txn_id" if name[0] == "j" else "source").distinct().count()
    days = "(SELECT DISTINCT DATE '2024-01-01' + CAST(conv_id % 30 AS int) AS d, contains(lower({}), 'the') AS a, contains(lower({}), 'and') AS b, contains(lower({}), 'with') AS c FROM conversations)"
    for name, text in (("j11_email_evidence", "text"), ("j12_event_evidence", "text")):
        hit = con.sql(f"SELECT count(*) FROM events e WHERE EXISTS (FROM {days.replace('{}', text)} m WHERE abs(CAST(e.ts AS date) - m.d) <= 3 AND CASE e.event_id % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END)").fetchall()[0][0]
        assert count(name) == hit > 60
    assert count("w6_ambiguity") == con.sql("SELECT count(DISTINCT o_custkey) FROM orders").fetchall()[0][0] > 50


def test_evidence_of_repeated_transactions(spark):
    from tallyloom.operators import context

    t0 = datetime(2024, 1, 1).date()
    txns = [("t1", "The", t0), ("t1", "The", t0), ("t1", "and", t0 + timedelta(days=4)), ("t2", "the", t0), ("t3", "", t0), ("t4", "the", None), (None, "the", t0), ("t5", None, t0)]
    mails = [(f"m{i}", i % 7, t0 + timedelta(days=i % 9), ["the x", "land", None, "y"][i % 4], ["and", "THE end", "z"][i % 3]) for i in range(40)]
    want = []
    for ident in {t[0] for t in txns}:
        hits = []
        for _, v, d in (t for t in txns if t[0] == ident and t[1] and t[2]):
            for m, pos, day, s, b in mails:
                s = (s or "").lower()
                if abs((d - day).days) <= 3 and (v.lower() in s or v.lower() in b.lower()):
                    hits.append((pos, m, 0.9 if v.lower() in s else 0.7))
        want += [(ident, k + 1, m) for k, (_, m, _) in enumerate(sorted(hits)[:5])]
    out = context.email_evidence(spark.createDataFrame(txns, "txn_id string, vendor string, date date"), spark.createDataFrame(mails, "message_id string, pos long, received_at date, subject string, body_preview string"))
    assert sorted(((r["txn_id"], r["rank"], r["message_id"]) for r in out.collect()), key=str) == sorted(want, key=str)
