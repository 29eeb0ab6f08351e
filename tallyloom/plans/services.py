"""Queries over sources and governed reads: services, payloads, fixtures and stores that are derived from the given tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import access, control, etl, feedback, metrics, reconcile, severity
from tallyloom.plans import audit as A
from tallyloom.plans import canonical as C
from tallyloom.plans.extended import _folder
from tallyloom.plans.queries import _FLAGS, _SIGNALS, ORACLES, _flags, query
from tallyloom.sources import files, readers
from tallyloom.sources.store import Store

# -------------------------------------------------------------------------------------------------------- sources


def _pages(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> tuple[str, int]:
    """(folder, number of rows): the rows as JSON lines, one folder for each page of a service."""
    folder = _folder(spark, name)
    numbered = files.numbered(rows, order, "__n", "%d").withColumn("__page", F.floor((F.col("__n").cast("bigint") - 1) / files.PAGE))
    lines = numbered.select("__page", F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.repartition("__page").write.partitionBy("__page").text(folder)
    return folder, rows.count()


def _page(folder: str, page: int) -> list[dict]:
    """Rows of one page, read where the task runs."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{folder}/__page={page}")
    found = [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name.startswith("part-")]
    return [json.loads(line) for p in found for line in system.open_input_stream(p).read().decode().splitlines()]


@query("SELECT c_custkey, c_name FROM customer")
def s1_paged_service(spark, sf):
    """Customers from a service that gives 500 rows for an offset."""
    folder, total = _pages(spark, C.table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], "pages")
    return files.paged(spark, lambda offset, n: ([(r["c_custkey"], r["c_name"]) for r in _page(folder, offset // files.PAGE)] if n else [], total), "c_custkey bigint, c_name string")


@query("""WITH n AS (SELECT event_id, user_id, event_type, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS page FROM events)
    SELECT 'm' || event_id AS message_id, 'u' || user_id || '@example.com' AS sender, event_type AS subject FROM n WHERE page // 8 < 2""")
def s3_linked_pages(spark, sf):
    """Events as messages of eight mailboxes, whose pages name the next one; the page cap, here two pages, is the feature."""
    e = C.table(spark, sf, "events").selectExpr("event_id", "user_id", "event_type")
    folder, total = _pages(spark, e, ["event_id"], "mailboxes")
    pages = -(-total // files.PAGE)

    def fetch(link: str) -> tuple[list[tuple], str | None]:
        k = int(link)
        rows = [(json.dumps({"id": f"m{r['event_id']}", "receivedDateTime": "2024-01-01T00:00:00Z", "sender": {"emailAddress": {"address": f"u{r['user_id']}@example.com"}}, "toRecipients": [{"emailAddress": {"address": "x@example.com"}}], "subject": r["event_type"]}),) for r in _page(folder, k)]
        return rows, str(k + 8) if k + 8 < pages else None

    raw = files.linked_pages(spark, fetch, [str(k) for k in range(min(8, pages))], "value string", max_pages=2)
    return files.messages(raw).select("message_id", "sender", "subject")


@query("SELECT 'T' || o_orderkey AS transaction_id, round(o_totalprice, 2) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Vendor ' || (o_custkey % 50) AS merchant_name FROM orders")
def s2_fixture(spark, sf):
    """Orders as fixture files, JSON arrays of some thousand records each."""
    o, folder = C.table(spark, sf, "orders"), _folder(spark, "fixtures")
    record = F.to_json(F.expr("struct(concat('T', o_orderkey) AS transaction_id, 'a' AS account_id, o_totalprice AS amount, date_format(o_orderdate, 'yyyy-MM-dd') AS date, concat('Vendor ', o_custkey % 50) AS merchant_name)"))
    arrays = o.groupBy(F.floor(F.col("o_orderkey") / 4000).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))  # 4,000 keys at most
    arrays.write.partitionBy("file").text(folder)
    assert files.choose("smb", None) == "fixture"
    return files.fixture(spark, folder, "transaction").select("transaction_id", F.round("amount", 2).alias("amount"), "date", "merchant_name")


@query("SELECT conv_id || '-' || turn AS message_id, role || '@example.com' AS sender, substr(text, 1, 255) AS body_preview, conv_id::varchar AS thread_id FROM conversations WHERE turn % 3 <> 1")
def s5_messages(spark, sf):
    """Turns as nested messages of a mail service; every third has no recipient and goes."""
    t = C.table(spark, sf, "conversations")
    address = "struct(struct({0} AS address) AS emailAddress)"
    to = f"CASE WHEN turn % 3 = 1 THEN array({address.format('CAST(NULL AS string)')}) ELSE array({address.format(chr(39) + 'x@example.com' + chr(39))}) END"
    raw = t.selectExpr(f"to_json(struct(concat(conv_id, '-', turn) AS id, '2024-01-01T00:00:00Z' AS receivedDateTime, {address.format('concat(role, ' + chr(39) + '@example.com' + chr(39) + ')')} AS sender, {to} AS toRecipients, 'turn' AS subject, text AS bodyPreview, CAST(conv_id AS string) AS conversationId)) AS value")
    return files.messages(raw).select("message_id", "sender", "body_preview", "thread_id")


@query("""SELECT 'e' || event_id AS event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS starts, event_type AS subject, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id || '@example.com' END AS attendees, CASE WHEN event_id % 5 = 0 THEN 'room ' || (user_id % 7) END AS location FROM events""")
def s6_calendar(spark, sf):
    """Events as nested entries of a calendar service; attendees without an address go, and an empty list is null."""
    raw = C.table(spark, sf, "events").selectExpr("""to_json(struct(concat('e', event_id) AS id, struct(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") AS dateTime) AS start, struct(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") AS dateTime) AS end, event_type AS subject,
        array(struct(struct(CASE WHEN event_id % 2 = 0 THEN concat('u', user_id, '@example.com') END AS address) AS emailAddress), struct(struct(CAST(NULL AS string) AS address) AS emailAddress)) AS attendees,
        CASE WHEN event_id % 5 = 0 THEN struct(concat('room ', user_id % 7) AS displayName) END AS location)) AS value""")
    return files.calendar(raw).select("event_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("starts"), "subject", F.array_join("attendees", ",").alias("attendees"), "location")


@query(f"WITH {C.GOLD} SELECT vendor, count(*) AS n, round(sum(amount), 2) AS total FROM gold WHERE source = 'bank' GROUP BY 1")
def s11_dispatch(spark, sf):
    """A query text over the views of one mode; views that it doesn't name are not loaded."""

    def unused() -> DataFrame:
        raise AssertionError("this view is not named")

    sql = "SELECT vendor, count(*) AS n, round(sum(amount), 2) AS total FROM gold_rows WHERE source = 'bank' GROUP BY vendor"
    return files.dispatch(spark, sql, "warehouse", {"warehouse": {"gold_rows": lambda: C.gold(spark, sf), "receipts": unused}})


@query(f"""WITH {C.GOLD} SELECT 'bank' AS view, count(*) FILTER (source = 'bank') AS n FROM gold UNION ALL SELECT 'receipts', count(*) FILTER (source <> 'bank') FROM gold UNION ALL SELECT 'cards', count(*) FROM gold""")
def s13_routed(spark, sf):
    """Query texts that name a table in passing; what names none goes to the card expenses."""
    g = C.gold(spark, sf)
    views = {"bank": g.where("source = 'bank'"), "receipts": g.where("source <> 'bank'"), "cards": g}
    texts = ["SELECT * FROM Bank_Statements", "select 1 from RECEIPTS r", "SELECT now()"]
    named = [files.routed(t, {"bank_statement": "bank", "receipt": "receipts"}, "cards") for t in texts]
    return views[named[0]].select(F.lit(named[0]).alias("view")).unionByName(views[named[1]].select(F.lit(named[1]).alias("view"))).unionByName(views[named[2]].select(F.lit(named[2]).alias("view"))).groupBy("view").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT 'BANK_' || lpad((row_number() OVER (ORDER BY o_orderdate, 'C' || o_custkey, o_totalprice))::varchar, 6, '0') AS txn_id, 'C' || o_custkey AS vendor, o_totalprice AS amount, o_orderdate AS date FROM orders)
    SELECT txn_id, vendor, NULL::varchar AS vendor_id, amount, strftime(date, '%Y-%m-%d') AS date, 'debit' AS category, 'bank' AS source FROM b
    UNION ALL SELECT 'E' || event_id, 'U' || user_id, NULL, value, strftime(ts, '%Y-%m-%d'), event_type, 'credit_card' FROM events UNION ALL SELECT 'R' || c_custkey, c_name, NULL, c_acctbal, '2024-01-01', NULL, 'receipt' FROM customer""")
def s15_gold_shapes(spark, sf):
    """Bank, card and receipt rows in one shape; bank rows are numbered over all rows."""
    bank = C.table(spark, sf, "orders").selectExpr("o_orderdate AS transaction_date", "concat('C', o_custkey) AS description", "o_totalprice AS amount", "'debit' AS type")
    card = C.table(spark, sf, "events").selectExpr("concat('E', event_id) AS expense_id", "concat('U', user_id) AS merchant", "value AS amount", "ts AS expense_date", "event_type AS category")
    receipt = C.table(spark, sf, "customer").selectExpr("concat('R', c_custkey) AS receipt_id", "c_name AS vendor_name", "c_acctbal AS amount", "'2024-01-01' AS receipt_date")
    rows = files.gold(bank, "bank").unionByName(files.gold(card, "credit_card")).unionByName(files.gold(receipt, "receipt"))
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(f"WITH {C.GOLD} SELECT txn_id, strftime(date, '%Y-%m-%d') AS date FROM gold WHERE date >= DATE '1995-01-01' ORDER BY gold.date, txn_id LIMIT 500")
def s16_since(spark, sf):
    """An audit's scan: the first rows since a day; the limit is the feature."""
    return files.between(C.gold(spark, sf), since="1995-01-01", limit=500).select("txn_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(f"WITH {C.GOLD} SELECT txn_id, 'bank' AS scan FROM gold WHERE source = 'bank' AND date BETWEEN DATE '1994-03-01' AND DATE '1996-03-01' UNION ALL SELECT txn_id, 'all' FROM gold WHERE date <= DATE '1996-03-01'")
def s17_ranges(spark, sf):
    """Inclusive ranges, of one source and open at one end."""
    g = C.gold(spark, sf)
    bank = reconcile.in_range(g, "bank", "1994-03-01", "1996-03-01").select("txn_id", F.lit("bank").alias("scan"))
    return bank.unionByName(files.between(g, until="1996-03-01").select("txn_id", F.lit("all").alias("scan")))


@query(f"WITH {C.GOLD} SELECT 'given' AS way, count(*) AS n FROM gold UNION ALL SELECT 'view', count(*) FROM gold WHERE source = 'bank' UNION ALL SELECT 'load', count(*) FROM orders")
def s18_resolved(spark, sf):
    """An operator's input from a frame, a registered view or a loader, in this order."""
    g = C.gold(spark, sf)
    g.where("source = 'bank'").createOrReplaceTempView("resolved_rows")
    ways = {"given": control.resolved(spark, "resolved_rows", g), "view": control.resolved(spark, "resolved_rows"), "load": control.resolved(spark, "orders_not_registered", load=lambda _: C.table(spark, sf, "orders"))}
    rows = [d.select(F.lit(k).alias("way")) for k, d in ways.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("way").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name <> 'x''; DROP TABLE customer; --'")
def f15_parameters(spark, sf):
    """Values travel as parameters, whatever they hold."""
    files.register(spark, {"customer_rows": C.table(spark, sf, "customer")})
    return files.query(spark, "SELECT c_custkey, c_mktsegment FROM customer_rows WHERE c_mktsegment = :segment AND c_name <> :name", segment="BUILDING", name="x'; DROP TABLE customer; --")


# ------------------------------------------------------------------------------------- validation, keys, functions


@query(f"WITH {C.GOLD} SELECT txn_id AS transaction_id, amount IS NOT NULL AND date IS NOT NULL AS accepted FROM gold")
def f6_batch(spark, sf):
    """A batch without the hard failure: good records pass, and of the others it is known which they are."""
    raw = C.gold(spark, sf).selectExpr("txn_id AS transaction_id", "'a' AS account_id", "amount", "date", "vendor AS merchant_name")
    silver = etl.transform(raw, "transaction", "batch")
    return etl.accepted(silver, strict=False).select("transaction_id", F.lit(True).alias("accepted")).unionByName(silver.where("error IS NOT NULL").select("transaction_id", F.lit(False).alias("accepted")))


@query(r"""WITH c AS (SELECT conv_id || '-' || turn AS message_id, 'Call 415-555-0' || lpad((conv_id % 1000)::varchar, 3, '0') AS subject, 'ssn 123-45-6789, card 4111 1111 1111 1111, ' || role || '@example.com: ' || text AS body FROM conversations),
    m AS (SELECT message_id, unnest([subject, body]) AS t, unnest(['subject', 'body_preview']) AS field FROM c), n AS (SELECT message_id, field, regexp_replace(regexp_replace(t, '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g'), '\b(?:\d{4}[- ]?){3}\d{4}\b', '[CC]', 'g') AS t FROM m)
    SELECT message_id, field, substr(regexp_replace(regexp_replace(t, '\b\+?1?\s*\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b', '[PHONE]', 'g'), '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g'), 1, 255) AS masked FROM n""")
def f4_masked_texts(spark, sf):
    """Subjects and previews of silver emails: masked before they are cut."""
    raw = C.table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS message_id", "'2024-01-01T00:00:00Z' AS received_at", "'a@b.c' AS sender", "array('x@y.z') AS recipients", "concat('Call 415-555-0', lpad(conv_id % 1000, 3, '0')) AS subject", "concat('ssn 123-45-6789, card 4111 1111 1111 1111, ', role, '@example.com: ', text) AS body_preview")
    silver = etl.transform(raw, "email", "batch")
    return silver.unpivot("message_id", ["subject", "body_preview"], "field", "masked")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) AS known FROM orders")
def f13_known_keys(spark, sf):
    """Existence guards in bulk: which keys of two columns a table has."""
    wanted = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(3).alias("l_linenumber"))
    return readers.known(C.table(spark, sf, "lineitem"), wanted, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("o_orderkey"), "known")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN lower(c_name) || '@example.com' END AS address FROM customer")
def c5_addresses(spark, sf):
    c = C.table(spark, sf, "customer")
    raw = F.concat(F.lit("\t "), F.upper("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.lit("@Example.com ")).otherwise(F.lit(" at home")))
    return c.select("c_custkey", T.email_address(raw).alias("address"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, abs(date_diff('day', o_orderdate::date, l_shipdate::date)) <= 30 AS near, o_totalprice = l_extendedprice AS equal,
    coalesce((o_totalprice = 0 AND l_extendedprice = 0) OR abs(o_totalprice - l_extendedprice) / nullif(greatest(abs(o_totalprice), abs(l_extendedprice)), 0) <= 0.25, false) AS close FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def c6_c7_windows(spark, sf):
    """Date windows and amount tolerances of every line against its order."""
    pairs = C.table(spark, sf, "lineitem").join(C.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("o_totalprice"), F.col("l_extendedprice")
    return pairs.select("l_orderkey", "l_linenumber", "l_partkey", T.within_days(F.col("o_orderdate"), F.col("l_shipdate"), 30).alias("near"), T.amounts_agree(a, b).alias("equal"), T.amounts_agree(a, b, 0.25).alias("close"))


# ------------------------------------------------------------------------------------------------ audits, metrics

_KEPT = "NOT (nf = 1 AND un AND coalesce(amount, 0) < 5000) AND NOT (score < 50 AND coalesce(amount, 0) < 50)"
_MONEY = "'$' || coalesce(amount, 0.0::double)::varchar"
_WHY = f"""'Flagged because: ' || concat_ws('; ', CASE WHEN un THEN 'No matching bank transaction found for ' || {_MONEY} || ' to ' || coalesce(vendor, 'Unknown') END, CASE WHEN inc THEN 'Transaction ' || txn_id || ' is missing required fields' END,
    CASE WHEN dup THEN 'Transaction ' || txn_id || ' appears to be a duplicate' END, CASE WHEN amount >= 5000 THEN 'Transaction amount ' || {_MONEY} || ' exceeds high-value threshold' END, CASE WHEN pos % 9 = 0 THEN 'email_approval_found' END) || '.'"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    g = C.gold(spark, sf)
    return A.audit(g, g.where("pos % 4 = 0").select("txn_id"), ["vendor", "date", "source"], g.where("pos % 9 = 0").select("txn_id"))


@query(f"""WITH {_SIGNALS} SELECT sha256('audit' || chr(31) || txn_id) AS flag_id, txn_id, vendor, amount, CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 50 THEN 'WARNING' ELSE 'INFO' END AS severity, round(least(nf / 3.0::double, 1.0), 6) AS confidence, {_WHY} AS explanation FROM sc WHERE {_KEPT}""")
def k21_flags(spark, sf):
    """Flag rows of an audit as they are inserted, with their explanations."""
    return severity.flags(_scored(spark, sf), "audit", F.lit("2024-03-01").cast("timestamp")).select("flag_id", "txn_id", "vendor", "amount", "severity", F.round("confidence", 6).alias("confidence"), "explanation")


@query(f"""WITH {C.LINKS}, {_SIGNALS}, k AS (SELECT txn_id, pos, source, date FROM sc WHERE {_KEPT})
    SELECT sha256('audit' || chr(31) || txn_id) AS flag_id, txn_id, source, strftime(date, '%Y-%m-%d') AS date, link_id, target_id AS linked_id FROM k LEFT JOIN (SELECT * FROM cur WHERE is_current) c ON c.k = k.pos""")
def r12_flag_lineage(spark, sf):
    """Every flag with its transaction and the records that this is linked to."""
    cur, _ = C.links(spark, sf)
    flagged = severity.flags(_scored(spark, sf), "audit", F.lit("2024-03-01").cast("timestamp"))
    links = cur.withColumn("source_id", F.concat(F.lit("T"), F.col("source_id").substr(2, 20)))
    return A.lineage(flagged, links, C.gold(spark, sf)).select("flag_id", "txn_id", "source", F.date_format("date", "yyyy-MM-dd").alias("date"), "link_id", "linked_id")


@query(f"""WITH {_SIGNALS}, m AS (SELECT count(*) AS flags, count(*) FILTER (score >= 70) / count(*)::double AS critical_share FROM sc WHERE {_KEPT})
    SELECT 'flags' AS metric, flags::double AS value, 10.0::double AS threshold, flags > 10 AS firing FROM m UNION ALL SELECT 'critical_share', round(critical_share, 6), 0.2, critical_share < 0.2 FROM m""")
def audit_alerts(spark, sf):
    m = _scored(spark, sf).agg(F.count("*").alias("flags"), F.try_divide(F.count_if(F.col("severity") == "CRITICAL"), F.count("*")).alias("critical_share"))
    return A.alerts(m, {"flags": (">", 10), "critical_share": ("<", 0.2)}).withColumn("value", F.round("value", 6))


@query(f"""WITH {_FLAGS}, s AS (SELECT 2.0 + 0.5 * count(*) AS sigma FROM (SELECT explanation FROM f GROUP BY 1 HAVING count(*) FILTER (d = 'false_positive') > 0.5 * count(*) AND contains(explanation, 'amount_outlier')))
    SELECT vendor, sigma::double AS sigma FROM (SELECT vendor FROM f GROUP BY 1 HAVING count(*) FILTER (d = 'false_positive') > 0.8 * count(*)), s""")
def r11_tuned(spark, sf):
    """What a review of the flags changes: the whitelist, a table, and the global sigma."""
    rules, listed = feedback.tuned(_flags(spark, sf))
    return listed.withColumn("sigma", F.lit(rules.sigma_global))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS receipts, count(*) AS transactions, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::double, 6) AS coverage FROM orders")
def a16_coverage(spark, sf):
    o = C.table(spark, sf, "orders")
    return metrics.coverage(o.where("o_orderstatus = 'F'"), o).withColumn("coverage", F.round("coverage", 6))


@query(f"SELECT (SELECT count(*) FROM events WHERE event_type = 'purchase') AS rows, count(*) AS matched, round(count(*) / (SELECT count(*) FROM events WHERE event_type = 'purchase')::double, 3) AS match_rate FROM ({ORACLES['j8_cross_source']})")
def j8_match_rate(spark, sf):
    one, two = C.event_sides(spark, sf)
    return reconcile.match_rate(one, reconcile.cross_source(one, two))


# -------------------------------------------------------------------------------------------------- governed reads

_USER = "reader"
_WAITING = "u AS (SELECT 'E' || event_id AS entity_id, CASE WHEN event_id % 2 = 0 THEN 'transaction' ELSE 'email' END AS entity_type, CASE WHEN event_id % 3 = 0 THEN 'email' ELSE 'calendar_event' END AS target_type, ts AS created_at FROM events)"


def _governed(spark: SparkSession, sf: str, *tables: str) -> access.Queries:
    """The governed methods over a store that holds the named tables and a user who has consented."""
    at, known = F.lit("2024-03-01").cast("timestamp"), {}
    e = C.table(spark, sf, "events")
    known["entity_links"] = lambda: C.links(spark, sf)[0]
    known["unmatched_entities"] = lambda: e.selectExpr("concat('E', event_id) AS entity_id", "CASE WHEN event_id % 2 = 0 THEN 'transaction' ELSE 'email' END AS entity_type", "CASE WHEN event_id % 3 = 0 THEN 'email' ELSE 'calendar_event' END AS target_type", "CAST(ts AS timestamp) AS created_at")
    known["ambiguous_matches"] = lambda: C.table(spark, sf, "orders").selectExpr("concat('A', o_orderkey) AS ambiguity_id", "concat('T', o_orderkey) AS source_entity_id", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'resolved' ELSE 'dismissed' END AS status")
    known["emails"] = lambda: C.table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS message_id", "role AS sender", "text AS body_preview")
    known["run_log"] = lambda: e.where("event_type <> 'view'").selectExpr("concat('run', event_id) AS run_id", "'incremental' AS run_type", "event_type AS status", "CAST(ts AS timestamp) AS start_time")
    consent = spark.range(1).select(F.lit(_USER).alias("user_hash"), F.lit("processing").alias("consent_type"), F.lit(True).alias("granted"), F.lit("2024-01-01").cast("timestamp").alias("granted_at"))
    store = Store(spark, _folder(spark, "store"))
    store.replace_all({"user_consents": consent} | {name: known[name]() for name in tables})
    return access.Queries(store, "auditor", at)


def _second(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"WITH {_WAITING} SELECT entity_id, target_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM u WHERE entity_type = 'transaction' AND u.created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def api_unlinked(spark, sf):
    """Unlinked transactions of a period, both of its ends included."""
    return _governed(spark, sf, "unmatched_entities").unlinked_entities("transaction", _USER, "2024-01-05", "2024-01-20").select("entity_id", "target_type", _second("created_at").alias("created_at"))


@query("SELECT 'A' || o_orderkey AS ambiguity_id, 'T' || o_orderkey AS source_entity_id FROM orders WHERE o_orderstatus = 'O'")
def api_ambiguous(spark, sf):
    return _governed(spark, sf, "ambiguous_matches").ambiguous_matches(_USER).select("ambiguity_id", "source_entity_id")


@query(f"WITH {C.LINKS}, w AS (SELECT arg_min(target_id, k) AS e FROM cur WHERE is_current) SELECT e AS entity_id, source_id AS other_id, link_id FROM cur, w WHERE is_current AND target_id = e")
def api_linked(spark, sf):
    """All records that one email is linked to: the email of the first link."""
    q = _governed(spark, sf, "entity_links")
    first = C.links(spark, sf)[0].where("is_current").agg(F.min_by("target_id", F.col("link_id").substr(2, 20).cast("bigint"))).first()[0]
    return q.linked_entities(first or "", "email", _USER).select("entity_id", "other_id", "link_id")


@query("SELECT conv_id || '-' || turn AS message_id, role AS sender FROM conversations")
def api_entities(spark, sf):
    return _governed(spark, sf, "emails").entities("email").select("message_id", "sender")


@query("WITH w AS (SELECT min(conv_id || '-' || turn) AS i FROM conversations) SELECT conv_id || '-' || turn AS message_id, md5(text) AS body FROM conversations, w WHERE conv_id || '-' || turn = i")
def api_entity(spark, sf):
    """One record by its id."""
    q = _governed(spark, sf, "emails")
    ident = C.table(spark, sf, "conversations").agg(F.min(F.concat_ws("-", "conv_id", "turn"))).first()[0]
    return q.entity(ident or "", "email", _USER).select("message_id", F.md5("body_preview").alias("body"))


@query("SELECT 'run' || event_id AS run_id, event_type AS status FROM events WHERE event_type <> 'view' ORDER BY ts DESC, 'run' || event_id DESC LIMIT 1")
def api_last_run(spark, sf):
    return _governed(spark, sf, "run_log").last_run().select("run_id", "status")


@query(f"""WITH {C.LINKS}, l AS (SELECT arg_min(link_id, k) AS link FROM cur WHERE is_current), a AS (SELECT 'write_feedback' AS method, link AS what FROM l UNION ALL SELECT 'unlinked_entities', 'email' UNION ALL SELECT 'ambiguous_matches', 'pending')
    SELECT method, substr(sha256(what), 1, 12) AS entity_hash, 'auditor' AS actor, (SELECT link FROM l) AS feedback_on FROM a""")
def api_access_log(spark, sf):
    """What three governed calls leave behind: their rows in the access log, and the feedback that one of them wrote."""
    q = _governed(spark, sf, "unmatched_entities", "ambiguous_matches", "entity_links")
    link = q.store.read("entity_links").where("is_current").agg(F.min_by("link_id", F.col("link_id").substr(2, 20).cast("bigint"))).first()[0]
    q.write_feedback(link or "", "confirmed", "human", "seen", _USER)
    q.unlinked_entities("email", _USER)
    q.ambiguous_matches(_USER)
    noted = q.store.read("link_feedback").select(F.col("link_id").alias("feedback_on"))
    return q.store.read("access_audit_log").select("method", "entity_hash", "actor").crossJoin(F.broadcast(noted))  # one row
