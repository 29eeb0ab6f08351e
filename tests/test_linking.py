import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.config import RULES, FuzzyRule
from tallyloom.functions.similarity import weighted_ratio
from tallyloom.operators import datagen, etl, matching, merge, reconcile
from tallyloom.plans import unify
from tallyloom.schemas import LINK
from tallyloom.sources.store import Store, identifier


def test_rules_are_checked():
    with pytest.raises(ValueError):
        FuzzyRule(("a",), {}, -1)
    with pytest.raises(ValueError):
        FuzzyRule(("a",), {}, 3, 1.5)
    assert RULES["email", "calendar_event"].fuzzy.min_similarity_score == 0.75


def test_scenario(spark):
    m = matching.match_all(*datagen.matching_scenario(spark))
    links = {r["source_id"]: (r["target_id"], r["match_tier"], r["confidence"]) for r in m.links.collect()}
    assert links["t1"] == ("m1", "tier2_composite", 0.90)
    assert links["t3"][:2] == ("m3", "tier3_fuzzy") and links["t3"][2] >= 0.8
    assert links["m6"][0] == "c1" and links["t6"][0] == "c2"
    amb = {r["source_entity_id"]: r["candidate_ids"] for r in m.ambiguous.collect()}
    assert amb["t4"] == ["m4", "m5"]
    gone = {(r["entity_id"], r["target_type"]) for r in m.unmatched.collect()}
    assert ("t5", "email") in gone and ("m7", "transaction") in gone
    assert not any(e.startswith("c") for e, _ in gone)


def test_fuzzy_tier_against_loops(spark):
    draw = random.Random(4)
    names = ["acme tools", "acme tool shop", "blue cafe", "blue bird cafe", "north wind", "northwind traders"]
    rule = RULES["transaction", "email"]
    s = [(f"s{i}", i, date(2026, 1, 1) + timedelta(days=draw.randrange(12)), draw.choice(names)) for i in range(30)]
    t = [(f"t{i}", i, date(2026, 1, 1) + timedelta(days=draw.randrange(12)), draw.choice(names)) for i in range(30)]
    make = lambda rows: spark.createDataFrame([(*r, "subject") for r in rows], "entity_id string, pos long, day date, fuzzy string, fuzzy_field string")
    links, ambiguous = matching.tier3(make(s), make(t), rule)
    got = {r["source_id"]: [r["target_id"]] for r in links.collect()} | {r["source_id"]: r["candidate_ids"] for r in ambiguous.collect()}
    want = defaultdict(list)
    for i, _, d, a in s:
        for j, _, e, b in t:
            if abs((d - e).days) <= 3 and weighted_ratio(a, b) / 100 >= 0.8:
                want[i].append(j)
    assert got == dict(want)


def test_window_pairs_are_an_equi_join(spark):
    e = spark.createDataFrame([("a", 1, date(2026, 1, 1), "x", "f")], "entity_id string, pos long, day date, fuzzy string, fuzzy_field string")
    plan = matching.window_pairs(e, e, 3, 0.8, "edit")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cross_source_against_loops(spark):
    draw = random.Random(9)

    def rows(k):
        return [(f"{k}{i}", i, f"v{draw.randrange(3)}" if draw.random() < 0.9 else None, float(draw.choice([100, 101, 104, 110, -5, 0])), datetime(2026, 1, 1) + timedelta(hours=draw.randrange(24 * 40))) for i in range(60)]

    a, b = rows("a"), rows("b")
    make = lambda r: spark.createDataFrame(r, "txn_id string, pos long, vendor string, amount double, date timestamp")
    got = {(r["source_1_id"], r["source_2_id"], r["confidence"]) for r in reconcile.cross_source(make(a), make(b)).collect()}
    taken, want = set(), set()
    for i, _, v, x, d in a:
        for j, _, w, y, e in b:
            gap = abs((d - e).days)
            if j in taken or v is None or v != w or x == 0 or abs(x - y) / x > 0.05 or gap > 3:
                continue
            taken.add(j)
            want.add((i, j, 0.95 if gap == 0 and x == y else 0.85))
            break
    assert got == want


def plain_greedy(pairs):
    used, taken, out = set(), set(), set()
    for a, b in pairs:
        if a not in used and b not in taken:
            used.add(a)
            taken.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("rounds", [1, 2, 6])
def test_rounds_of_first_choices_are_the_greedy_pairs(spark, rounds):
    """A dense knot: all amounts and days are close, so that pairs wait for each other."""
    a, b = ([(f"{k}{i:02d}", i, "v", 100.0, datetime(2026, 1, 1) + timedelta(days=i // 8)) for i in range(24)] for k in "ab")
    make = lambda r: spark.createDataFrame(r, "txn_id string, pos long, vendor string, amount double, date timestamp")
    got = [(r["source_1_id"], r["source_2_id"]) for r in reconcile.cross_source(make(a), make(b), rounds=rounds).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_greedy((x[0], y[0]) for x in a for y in b if abs((x[4] - y[4]).days) <= 3)


def test_cross_source_of_a_vendor_that_is_active_daily(spark):
    """100,000 rows of one vendor; single pairs need no Python, and inputs are read once."""
    sides = [spark.range(50_000).selectExpr(f"concat('{k}', id) AS txn_id", "id AS pos", "'hot' AS vendor", f"CAST(10 + pmod(xxhash64(id, {n}), 9000) AS double) AS amount", f"timestamp_seconds(1577836800 + 86400 * (id DIV 10) + pmod(xxhash64(id, {n + 2}), 86400)) AS date") for n, k in enumerate("ab")]
    got = {(r["source_1_id"], r["source_2_id"]) for r in reconcile.cross_source(*sides).collect()}
    by_day, want = defaultdict(list), []
    for r in sides[1].collect():
        by_day[r["date"].date()].append(r)
    for x in sides[0].orderBy("pos").collect():
        near = [y for d in range(-4, 5) for y in by_day[x["date"].date() + timedelta(days=d)]]
        want += [(x["txn_id"], y["txn_id"]) for y in sorted(near, key=lambda y: y["pos"]) if abs(x["amount"] - y["amount"]) / x["amount"] <= 0.05 and abs((x["date"] - y["date"]).days) <= 3]
    assert got == plain_greedy(want) and len(got) > 10_000


def test_weighted_bound_holds(spark):
    draw, signs = random.Random(8), "abcdefgh  "
    texts = sorted({" ".join("".join(draw.choice(signs) for _ in range(draw.randrange(1, 30))).split()) for _ in range(150)} - {""})
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    from tallyloom.functions.similarity import letter_facts, weighted_bound

    facts = rows.withColumn("f", letter_facts(F.col("t")))
    got = facts.alias("a").crossJoin(facts.alias("b")).select(F.col("a.t").alias("x"), F.col("b.t").alias("y"), weighted_bound(F.col("a.f"), F.col("b.f")).alias("bound")).collect()
    assert all(weighted_ratio(r["x"], r["y"]) / 100 <= r["bound"] + 1e-9 for r in got)
    assert sum(r["bound"] < 0.8 for r in got) > len(got) / 4


def test_rare_letter_groups_find_every_mention(spark):
    draw = random.Random(3)
    names = ["the one", "the two", "san", "x", "é", "of", "", "the onex"] + ["".join(draw.choice("abcxé ") for _ in range(draw.randrange(1, 7))) for _ in range(60)]
    texts = ["".join(draw.choice("abcxé ") for _ in range(60)) for _ in range(40)] + ["see the one of san", None]
    entities = spark.createDataFrame([(f"e{i:02d}", f"canonical {i}", t) for i, t in enumerate(texts)], "entity_id string, canonical_name string, aliases string")
    got = {r["name"]: r["entity_id"] for r in reconcile.known_entities(spark.createDataFrame([(n,) for n in names], "name string"), entities).collect()}
    for n in set(names):
        hits = [f"e{i:02d}" for i, t in enumerate(texts) if n in (t or "")]
        assert got[n] == (hits[0] if hits else "unknown_" + n.replace(" ", "_").lower()), n


def test_validation(spark):
    raw = spark.createDataFrame([("t1", "a", 1.0, "2026-01-01", " Acme "), (None, "a", None, "2026-01-01", None), ("t3", "a", float("nan"), "2026-01-01", "x")], "transaction_id string, account_id string, amount double, date string, merchant_name string")
    out = etl.transform(raw, "transaction", "batch")
    got = [r["error"] for r in out.collect()]
    assert got == [None, "missing transaction_id, amount", "amount is not finite"]
    assert out.where("error IS NULL").first()["merchant_name"] == "Acme"
    with pytest.raises(etl.RejectedRecords, match="2 records"):
        etl.accepted(out)
    assert etl.accepted(out, strict=False).count() == 1


def links_frame(spark, rows):
    full = [(i, s, t, "transaction", "email", "deterministic", tier, 0.9, "k", "1.0", datetime(2026, 1, 1), datetime(2026, 1, 1 + n), None, cur, None) for n, (i, s, t, tier, cur) in enumerate(rows)]
    return spark.createDataFrame(full, LINK)


def test_history_merge(spark):
    current = links_frame(spark, [("l1", "s1", "t1", "tier2_composite", True), ("l2", "s2", "t2", "tier2_composite", True), ("l3", "s3", "t3", "tier1_exact", False)])
    proposed = links_frame(spark, [("n1", "s1", "t1", "tier2_composite", True), ("n2", "s2", "t2", "tier3_fuzzy", True), ("n4", "s4", "t4", "tier1_exact", True)])
    got = {r["link_id"]: (r["action"], r["is_current"], r["superseded_by"]) for r in merge.scd2(current, proposed).collect()}
    assert got == {"l1": ("kept", True, None), "l2": ("closed", False, "n2"), "l3": ("kept", False, None), "n2": ("inserted", True, None), "n4": ("inserted", True, None)}


def test_null_keys_are_equal(spark):
    old = spark.createDataFrame([("e1", None, 1)], "id string, target string, v int")
    new = spark.createDataFrame([("e1", None, 2), ("e2", None, 3), ("e2", None, 3)], "id string, target string, v int")
    assert sorted(map(tuple, merge.insert_absent(old, new, ["id", "target"]).collect())) == [("e1", None, 1), ("e2", None, 3)]
    assert sorted(r["v"] for r in merge.upsert(old, new.dropDuplicates(), ["id", "target"]).collect()) == [2, 3]


def test_erasure_finds_feedback_and_candidates(spark):
    tables = {
        "entity_links": links_frame(spark, [("l1", "s1", "t1", "tier1_exact", True), ("l2", "s2", "t2", "tier1_exact", True)]),
        "link_feedback": spark.createDataFrame([("f1", "l1"), ("f2", "l2")], "feedback_id string, link_id string"),
        "ambiguous_matches": spark.createDataFrame([("a1", "s9", ["t1", "t5"]), ("a2", "s8", ["t6"])], "ambiguity_id string, source_entity_id string, candidate_ids array<string>"),
        "unmatched_entities": spark.createDataFrame([("t1",), ("t2",)], "entity_id string"),
    }
    after, counts = merge.erase(tables, "t1")
    assert {k: v.count() for k, v in after.items()} == dict.fromkeys(tables, 1)
    assert counts.agg(F.sum("rows_deleted")).first()[0] == 4


def raw(spark, extra=()):
    t, e, c = datagen.matching_scenario(spark)
    t = t.select("transaction_id", F.lit("acc").alias("account_id"), F.lit(10.0).alias("amount"), "date", "merchant_name", "name", "pos")
    e = e.select("message_id", "received_at", F.lit("a@b.c").alias("sender"), F.array(F.lit("x@y.z")).alias("recipients"), "subject", "pos")
    c = c.select("event_id", "start_time", F.col("start_time").alias("end_time"), F.lit("o").alias("organizer"), "subject", "pos")
    return {"transactions": t, "emails": e, "calendar_events": c}


def test_unification_runs_twice(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    first = unify.run(store, raw(spark), "full_refresh", "r1")
    assert first == "r1"
    links = {r["source_id"]: r["target_id"] for r in store.read("entity_links").where("is_current").collect()}
    assert links["t1"] == "m1" and links["m6"] == "c1"
    before = store.read("entity_links").count()
    unify.run(store, raw(spark), "full_refresh", "r2")
    assert store.read("entity_links").count() == before
    assert store.read("transactions").count() == 6
    assert {(r["run_id"], r["status"]) for r in store.read("run_log").collect()} == {("r1", "success"), ("r2", "success")}
    assert store.acquire("pipeline", "other")
    assert unify.run(store, raw(spark)) == "skipped"
    store.release("pipeline", "other")


def test_a_failed_run_is_recorded(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    bad = raw(spark)
    bad["transactions"] = bad["transactions"].withColumn("account_id", F.lit(None).cast("string"))
    with pytest.raises(etl.RejectedRecords):
        unify.run(store, bad, "full_refresh", "r1")
    row = store.read("run_log").first()
    assert row["status"] == "failed" and row["error"].startswith("RejectedRecords: 6 records")
    assert store.acquire("pipeline", "next")


def test_identifiers():
    assert identifier("gold.transactions") == "gold.transactions"
    for bad in ("a;b", "1a", "a b", "a--", ""):
        with pytest.raises(ValueError):
            identifier(bad)


def test_edit_pairs_meet_by_parts_without_loss(spark):
    """Every pair that reaches the score is found, over many lengths and least scores."""
    from tallyloom.functions.similarity import edit_similarity

    draw = random.Random(12)
    texts = ["", "a", "ab", *("".join(draw.choice("abc ") for _ in range(draw.randrange(1, 26))) for _ in range(60))]
    for base in texts[10:40]:
        changed = list(base)
        for _ in range(draw.randrange(1, 6)):
            at = draw.randrange(len(changed) + 1)
            changed[at : at + draw.randrange(2)] = [draw.choice("abcé")] * draw.randrange(2)
        texts.append("".join(changed))
    rows = [(f"e{k}", k, date(2026, 1, 1) + timedelta(days=draw.randrange(9)), t, "f") for k, t in enumerate(texts)]
    e = spark.createDataFrame(rows, "entity_id string, pos long, day date, fuzzy string, fuzzy_field string")
    for least in (0.0, 0.3, 0.6, 0.75, 0.8, 0.9, 1.0):
        got = {(r["source_id"], r["target_id"]) for r in matching.window_pairs(e, e, 2, least, "edit").collect()}
        a, b = e.alias("a"), e.alias("b")
        near = a.crossJoin(b).where((F.abs(F.datediff("a.day", "b.day")) <= 2) & (edit_similarity(F.col("a.fuzzy"), F.col("b.fuzzy")) >= least))
        assert got == {(r[0], r[1]) for r in near.select("a.entity_id", "b.entity_id").collect()}


def test_edit_pairs_of_one_day_are_few(spark):
    """Unlike texts of one day and length don't meet: each meets its own near copy and few others."""
    import hashlib

    name = lambda k: hashlib.md5(str(k).encode()).hexdigest()[:20]
    make = lambda change: spark.createDataFrame([(change(name(k)), date(2026, 1, 1)) for k in range(400)], "t string, d date")
    one, two = make(lambda t: t).toDF("s_text", "s_day"), make(lambda t: "zz" + t[2:]).toDF("t_text", "t_day")
    met = matching._met_by_parts(one, two, 3, 0.8).distinct()
    assert met.count() < 1000 and met.where("substring(s_text, 3) = substring(t_text, 3)").count() == 400


def test_candidates_of_one_text_and_day_are_listed_once(spark, monkeypatch):
    """Many rows of one text and day: the lists are written once each, and a repeated id has the candidates of all its rows."""
    written, inner = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: written.append(df) or inner(df))
    make = lambda rows: spark.createDataFrame(rows, "entity_id string, pos long, day date, fuzzy string, fuzzy_field string")
    day = date(2026, 1, 1)
    s = make([*((f"s{k}", k, day, "large ring", "f") for k in range(100)), ("twice", 1, day, "hot bolt", "f"), ("twice", 2, day, "hot bold", "g")])
    t = make([*((f"t{k:02d}", k, day, "large ring", "f") for k in range(50)), ("b", 90, day, "hot bolt", "h")])
    links, ambiguous = matching.tier3(s, t, RULES["transaction", "email"], "edit")
    got = {r["source_id"]: r["candidate_ids"] for r in ambiguous.collect()}
    assert got == {f"s{k}": [f"t{i:02d}" for i in range(50)] for k in range(100)} | {"twice": ["b", "b"]} and links.count() == 0
    assert all(df.count() <= 3 for df in written)
