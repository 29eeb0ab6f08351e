"""Control tables, the store's atomic changes, paging by links, rules on disk."""

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom import config
from tallyloom.functions.similarity import sequence_ratio
from tallyloom.operators import control, feedback, reconcile, severity
from tallyloom.schemas import WORKFLOW_STATE
from tallyloom.session import shared_folder
from tallyloom.sources import files
from tallyloom.sources.store import Store

NOW = datetime(2026, 3, 1)


def test_readers_never_see_an_empty_or_mixed_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = lambda n: spark.range(3).select(F.lit(str(n)).alias("version"))
    store.replace_all({"one": rows(0), "two": rows(0)})
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            parts = store.parts()
            seen.append((sorted(parts), [len(v) for v in parts.values()]))

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 6):
        store.replace_all({"one": rows(n), "two": rows(n)})
    stop.set()
    reader.join()
    assert len(seen) > 5 and all(x == (["one", "two"], [1, 1]) for x in seen)
    before = store.read("one")
    store.append("one", rows(9))
    assert store.read("one").count() == 6 and before.count() == 3
    assert store.expire(3600) == 0 and store.expire(-1) == 10 and store.read("one").count() == 6 and store.read("two").count() == 3
    assert store.read("run_log").count() == 0


def test_a_failed_change_leaves_all_tables_as_they_were(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.replace_all({"one": spark.range(2), "two": spark.range(2)})
    with pytest.raises(Exception):  # noqa: B017
        store.replace_all({"one": spark.range(5), "two": spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))})
    assert store.read("one").count() == store.read("two").count() == 2


def test_of_two_writers_the_second_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.replace("one", spark.range(2))
    seen = store._latest()
    store.replace("one", spark.range(3))
    with pytest.raises(Exception):  # noqa: B017
        store._publish({"one": []}, seen)
    assert store.read("one").count() == 3


def test_lock(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.acquire("a", "x") and store.acquire("a", "x") and not store.acquire("a", "y")
    store.release("a", "y")
    assert not store.acquire("a", "y")
    store.release("a", "x")
    assert store.acquire("a", "y", ttl=-1.0) and store.acquire("a", "z")
    assert not store.acquire("a", "y")


def test_pages_that_name_the_next(spark):
    def fetch(link):
        box, n = link.split("/")
        return [(box, int(n) * 10 + k) for k in range(3)], f"{box}/{int(n) + 1}" if int(n) < 4 else None

    schema = "box string, n long"
    assert files.linked_pages(spark, fetch, ["a/0", "b/2"], schema).count() == 24
    two = files.linked_pages(spark, fetch, ["a/0", "b/4"], schema, max_pages=2)
    assert sorted(map(tuple, two.collect())) == [("a", 0), ("a", 1), ("a", 2), ("a", 10), ("a", 11), ("a", 12), ("b", 40), ("b", 41), ("b", 42)]


def test_routing_and_dispatch(spark):
    names = {"bank_transactions": "bank", "receipts": "receipts"}
    assert files.routed("SELECT * FROM gold.RECEIPTS r", names) == "receipts" and files.routed("SELECT 1", names, "cards") == "cards"
    with pytest.raises(LookupError):
        files.routed("SELECT 1", names)
    loaded = []
    loaders = {"demo": {"some_cards": lambda: loaded.append(1) or spark.range(4), "unused": lambda: loaded.append(2)}}
    assert files.dispatch(spark, "SELECT count(*) AS n FROM Some_Cards", "demo", loaders).first()["n"] == 4 and loaded == [1]
    assert control.resolved(spark, "some_cards").count() == 4 and control.resolved(spark, "x", spark.range(2)).count() == 2
    assert control.resolved(spark, "nowhere", load=lambda n: spark.range(1)).count() == 1
    with pytest.raises(LookupError):
        control.resolved(spark, "nowhere")


def test_numbering_is_gapless_in_order(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, 1, 1, 2, 3, 9]), draw.randrange(10**6)) for _ in range(500)]
    df = spark.createDataFrame(rows, "d int, x int").repartition(7)
    got = [(r["d"], r["x"]) for r in sorted(files.numbered(df, ["d", "x"], "n", "%d").collect(), key=lambda r: int(r["n"]))]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(int(r["n"]) for r in files.numbered(df, ["d", "x"], "n", "%d").collect()) == list(range(1, 501))
    limited = files.between(df.withColumn("d", F.timestamp_seconds("d")), limit=3, column="d", ident="x").collect()
    assert [r["x"] for r in limited] == sorted(x for d, x in rows if d is None)[:3]


def test_trail_and_states(spark, tmp_path):
    rows = spark.createDataFrame([("r", 2, "a", {"k": 1}, ["f"]), ("r", 1, "b", None, None), ("s", 1, "c", {"k": 2}, [])], "audit_run_id string, log_sequence_number long, agent_name string, input_data map<string,int>, decision_chain array<string>")
    store = Store(spark, f"file://{tmp_path}")
    store.append("audit_trail", control.trail_entries(rows))
    out = control.trail_of(store.read("audit_trail"), "r").collect()
    assert [(r["agent_name"], r["input_data"], r["decision_chain"]) for r in out] == [("b", None, None), ("a", '{"k":1}', '["f"]')]
    stored = control.StoredStates(store)
    assert stored.get("r") is None
    stored.put("r", {"workflow_status": "in_progress", "completed_agents": ["a"]})
    stored.put("r", {"workflow_status": "completed", "completed_agents": ["a", "b"], "intermediate_results": "{}"})
    assert stored.get("r")["workflow_status"] == "completed" and stored.get("r")["completed_agents"] == ["a", "b"] and store.read("workflow_state").count() == 1
    clock = [0.0]
    memory = control.MemoryStates(10.0, lambda: clock[0])
    memory.put("r", {"x": 1})
    assert memory.get("r") == {"x": 1} and memory.get("s") is None
    clock[0] = 10.0
    assert memory.get("r") is None
    assert control.workflow_upsert(spark.createDataFrame([], WORKFLOW_STATE), rows.select("audit_run_id").distinct(), F.lit(NOW)).where("workflow_status = 'in_progress' AND size(pending_agents) = 0").count() == 2


def test_log_retention_and_predicates(spark):
    log = spark.createDataFrame([("r", "link", i, False, NOW - timedelta(days=i)) for i in (5, 40, 3)] + [("r", "commit", None, True, NOW), ("s", "link", 1, None, None)], "run_id string, operation string, id long, committed boolean, created_at timestamp")
    kept = control.expired_logs({"intent_log": log, "other": log}, F.lit(NOW))
    assert set(kept) == {"intent_log"} and sorted((r["id"] or 0) for r in kept["intent_log"].collect()) == [0, 1, 3, 5]
    assert [(r["id"], r["committed"]) for r in control.intents(log, "r").collect()] == [(3, True), (5, True), (40, True)]
    assert [(r["id"], r["committed"]) for r in control.intents(log, "s").collect()] == [(1, False)]
    notes = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, processed boolean")
    assert {r["id"] for r in control.unprocessed(notes).collect()} == {"b", "c"}
    u = spark.createDataFrame([("1", "transaction", "email"), ("2", "transaction", "calendar_event"), ("3", "email", "email")], "entity_id string, entity_type string, target_type string")
    assert control.waiting(u, "transaction").count() == 2 and control.waiting(u, "transaction", "email").count() == 1
    old, new = spark.createDataFrame([("u", "p", "a", 5), ("v", "p", "b", 5)], "user_hash string, preference string, value string, updated_at int"), spark.createDataFrame([("u", "p", "c", 5), ("v", "p", "d", 4)], "user_hash string, preference string, value string, updated_at int")
    assert {(r["user_hash"], r["value"]) for r in control.latest_by(old, new, ["user_hash", "preference"], "updated_at").collect()} == {("u", "c"), ("v", "b")}


def test_limits_have_a_total_order(spark):
    rows = spark.range(300).select(F.format_string("t%03d", "id").alias("txn_id"), (F.col("id") % 2).alias("score"))
    got = control.listed(rows, "deviations", [F.desc("score"), F.col("txn_id")]).collect()
    assert [r["txn_id"] for r in got] == [f"t{k:03d}" for k in range(1, 40, 2)]
    found = control.enriched(rows, rows.select("txn_id", F.lit(1).alias("x")), [F.desc("score"), F.col("txn_id")])
    assert found.count() == 300 and found.where("x = 1").count() == 20
    assert control.enriched(rows, rows.select("txn_id", F.lit(1).alias("x")), [], None).where("x = 1").count() == 300


def test_literals_and_numbers():
    from tallyloom.sources.store import literal, number

    assert literal("it's") == "it''s" and number("1.5") == 1.5
    for bad in ("a; drop", "a -- b", "/* x"):
        with pytest.raises(ValueError):
            literal(bad)
    for bad in ("x", "nan", "inf"):
        with pytest.raises(ValueError):
            number(bad)


def test_rules_are_written_and_read(tmp_path):
    path = str(tmp_path / "deep" / "rules.json")
    assert config.load_rules(path) == config.AUDIT
    rules = config.replace(config.AUDIT, whitelisted=("v",), sigma_global=2.5) if hasattr(config, "replace") else config.AuditRules(whitelisted=("v",), sigma_global=2.5)
    config.save_rules(rules, path)
    config.save_rules(rules, path)
    assert config.load_rules(path) == rules


def test_tuning_of_the_last_week(spark):
    flags = spark.createDataFrame([("v", "amount_outlier", "false_positive", NOW - timedelta(days=1)), ("w", "x", "approved", NOW), ("w", "x", "false_positive", NOW - timedelta(days=8))], "vendor string, explanation string, human_decision string, created_at timestamp")
    rules, whitelist = feedback.tuned(flags, now=F.lit(NOW))
    assert [r["vendor"] for r in whitelist.collect()] == ["v"] and rules.sigma_global == config.AUDIT.sigma_global + 0.5
    assert feedback.recent(flags, F.lit(NOW)).count() == 2


def test_repeated_ids_are_duplicates(spark):
    rows = [("a", "v", 1.0, NOW, "x"), ("a", "w", 2.0, NOW, "x"), ("b", "u", 3.0, NOW, "x"), ("c", "u", 3.0, NOW, "x"), ("d", None, 3.0, NOW, "x"), ("e", None, 3.0, NOW, "x")]
    out = severity.signals(spark.createDataFrame(rows, "txn_id string, vendor string, amount double, date timestamp, source string"), spark.createDataFrame([], "txn_id string"), ["vendor", "date", "source"])
    assert sorted((r["txn_id"], r["is_duplicate"]) for r in out.collect()) == [("a", True), ("a", True), ("b", True), ("c", True), ("d", False), ("e", False)]


def test_a_vendor_that_is_active_daily_falls_apart_by_amounts(spark):
    at = datetime(2026, 1, 1)
    make = lambda k: spark.createDataFrame([(f"{k}{d}_{m}", d * 10 + m, "v", 10.0 * 2**m, at + timedelta(days=d)) for d in range(40) for m in range(8)], "txn_id string, pos long, vendor string, amount double, date timestamp")
    one, two = make("a"), make("b")
    sizes = []
    pairs = reconcile.candidates(one, two).withColumns({"d0": F.to_date(F.least("a_date", "b_date")), "d1": F.to_date(F.greatest("a_date", "b_date")), "m0": F.least("a_amount", "b_amount"), "m1": F.greatest("a_amount", "b_amount")})
    for low, high in (("d0", "d1"), ("m0", "m1")):
        sizes.append(reconcile.islands(pairs, ["vendor"], low, high, "k").select("k").distinct().count())
    assert sizes == [1, 8]
    got = {(r["source_1_id"], r["source_2_id"]) for r in reconcile.cross_source(one, two).collect()}
    assert got == {(f"a{d}_{m}", f"b{d}_{m}") for d in range(40) for m in range(8)}
    repeated = one.unionByName(one.where("pos = 0"))
    assert reconcile.left_over(repeated, reconcile.cross_source(one, two), "source_1_id").count() == 1


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(Session())


def test_appends_of_two_writers_both_stay(spark, tmp_path):
    store, other = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    row = lambda k: spark.createDataFrame([("me", "m", k)], "actor string, method string, entity_hash string")
    store.append("access_audit_log", row("a"))
    latest, turns = store._latest, []

    def overtaken():
        seen = latest()
        if not turns:
            turns.append(1)
            other.append("access_audit_log", row("b"))
        return seen

    store._latest = overtaken
    store.append("access_audit_log", row("c"))
    assert sorted(r["entity_hash"] for r in other.read("access_audit_log").collect()) == ["a", "b", "c"]
    store._latest, store._publish = latest, lambda changed, seen: (_ for _ in ()).throw(OSError("no room"))
    with pytest.raises(OSError, match="no room"):
        store.append("access_audit_log", row("d"))


def test_receipts_meet_by_amount_steps_without_loss(spark):
    draw, day = random.Random(3), datetime(2024, 1, 1)
    amounts = [0.0, -5.0, 1e-9, 0.01, 95.0, 100.0, 105.0, 1e12, *(100 * 1.05**k for k in range(-4, 5)), *(draw.uniform(0.5, 300) for _ in range(120))]
    txns = [(f"t{k}", f"v{k % 3}", a, day) for k, a in enumerate(amounts)] + [("tn", "v", None, day), ("td", "v", 100.0, None)]
    found = [(f"r{k}", f"v{k % 3}", a, day) for k, a in enumerate(amounts)] + [("rn", "v", None, day), ("rd", "v", 100.0, None)]
    schema = "{} string, vendor string, amount double, date timestamp"
    got = {r["receipt_id"]: (r["txn_id"], r["confidence"]) for r in reconcile.receipts(spark.createDataFrame(found, schema.format("receipt_id")), spark.createDataFrame(txns, schema.format("txn_id"))).collect()}

    def best(r, vendor, amount):
        near = [((1 - (abs(a - amount) / amount if amount else 0.0)) * 0.4 + 0.3 + 0.3 * sequence_ratio(v, vendor), t) for t, v, a, d in txns if d is not None and a is not None and amount * 0.95 <= a <= amount * 1.05]
        return max(near, default=(0.0, None))

    want = {r: best(r, v, a) if a is not None and d is not None else (0.0, None) for r, v, a, d in found}
    assert {k: (t, pytest.approx(s, abs=0.0006)) for k, (s, t) in want.items()} == got
    assert want["r1"] == (0.0, None) and got["r0"][0] == "t0"
