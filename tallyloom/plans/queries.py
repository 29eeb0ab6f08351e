"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import FuzzyRule, PairRule
from tallyloom.functions import markup
from tallyloom.functions import similarity as S
from tallyloom.functions import text as T
from tallyloom.operators import access, anomaly, context, control, datagen, etl, feedback, matching, merge, metrics, quality, reconcile, severity
from tallyloom.plans import audit as A
from tallyloom.plans import canonical as C
from tallyloom.schemas import WORKFLOW_STATE
from tallyloom.session import shared_folder
from tallyloom.sources import readers
from tallyloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------------------------------------------------ quality


@query(f"""WITH {C.GOLD} SELECT count(*) AS total_records, count(*) - count(vendor) AS missing_vendor, count(*) - count(amount) AS missing_amount, count(*) - count(date) AS missing_date, count(*) - count(source) AS missing_source,
    round(1 - (4 * count(*) - count(vendor) - count(amount) - count(date) - count(source)) / (4.0 * count(*)), 3) AS completeness_score FROM gold""")
def a1_completeness(spark, sf):
    return quality.completeness(C.gold(spark, sf))


@query(f"WITH {C.GOLD} SELECT round(1 - (4 * count(*) - count(vendor) - count(amount) - count(date) - count(source)) / (4.0 * count(*)), 3) AS completeness_score, round(1 - (4 * count(*) - count(vendor) - count(amount) - count(date) - count(source)) / (4.0 * count(*)), 3) >= 0.9 AS passed FROM gold")
def f11_quality_gate(spark, sf):
    return quality.passes_gate(C.gold(spark, sf))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, array_to_string(list_sort(list(l_partkey))[1:5], ',') AS ids FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a2_duplicate_groups(spark, sf):
    return quality.duplicate_groups(C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], "l_partkey").withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {C.GOLD}, g AS (SELECT vendor, date, source, count(*) AS n FROM gold GROUP BY ALL HAVING count(*) > 1) SELECT CAST(sum(n) AS bigint) AS duplicate_count, count(*) FILTER (vendor IS NOT NULL AND date IS NOT NULL) AS duplicate_groups FROM g")
def a2_duplicate_summary(spark, sf):
    return quality.duplicate_summary(C.gold(spark, sf), ["vendor", "date", "source"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def w3_duplicate_rows(spark, sf):
    return quality.duplicate_rows(C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'category' AS field, 'Missing field' AS problem UNION ALL SELECT 'vendor', 'Type mismatch: expected float, got string'")
def f10_conformity(spark, sf):
    return quality.conformity(C.gold(spark, sf), {"txn_id": "str", "vendor": "float", "amount": "float", "date": "datetime", "category": "str", "pos": "int", "source": "anything"})


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 24 WHEN c_mktsegment = 'AUTOMOBILE' THEN 168 ELSE 48 END AS max_age_hours, 1.0::double AS domain_confidence FROM customer")
def f17_domain_freshness(spark, sf):
    return quality.domain_freshness(C.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"default": (48, 1000.0), "BUILDING": (24, 5000.0), "AUTOMOBILE": (168, 10000.0)}).drop("c_mktsegment")


# ------------------------------------------------------------------------------------------------------ anomaly


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS date) AS d, floor(value) AS v, event_type FROM events)
    SELECT event_id, event_type FROM e QUALIFY min(event_type) OVER (PARTITION BY user_id, d, v) = max(event_type) OVER (PARTITION BY user_id, d, v)""")
def a3_orphans(spark, sf):
    e = C.table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("d"), F.floor("value").alias("v"), "event_type")
    return reconcile.orphans(e, ["user_id", "d", "v"], "event_type").select("event_id", "event_type")


@query("""WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, round((value - m) / s, 6) AS z_score, abs((value - m) / s) > 2 AS is_outlier FROM events, m""")
def a4_global_outliers(spark, sf):
    return anomaly.global_outliers(C.table(spark, sf, "events").select("event_id", "value"), "value").select("event_id", F.round("z_score", 6).alias("z_score"), "is_outlier")


@query("""WITH p AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY user_id)
    SELECT event_id, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 6) AS z_score, CASE WHEN s > 0 THEN abs((value - m) / s) > 3 ELSE false END AS is_outlier FROM events JOIN p USING (user_id)""")
def a5_vendor_outliers(spark, sf):
    e = C.table(spark, sf, "events").select("event_id", "user_id", "value")
    return anomaly.vendor_outliers(e, anomaly.vendor_profiles(e, "user_id", "value"), "user_id", "value").select("event_id", F.round("z_score", 6).alias("z_score"), "is_outlier")


@query("""WITH r AS (SELECT event_id, value, CASE WHEN count(*) OVER (PARTITION BY user_id) >= 3 THEN avg(value) OVER w END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT event_id, round(m, 6) AS rolling_mean, coalesce(CASE WHEN m <> 0 THEN abs(value - m) / abs(m) * 100 > 20 ELSE value <> 0 END, false) AS is_deviation FROM r""")
def w1_rolling_deviation(spark, sf):
    return anomaly.rolling_deviation(C.table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["ts", "event_id"], "value", ["user_id"]).select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"), "is_deviation")


@query("""WITH s AS (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS c, event_id % 7 = 0 AS d FROM events)
    SELECT event_id, 30 * a::int + 30 * b::int + 20 * c::int + 20 * d::int AS anomaly_score,
           array_to_string(list_filter([CASE WHEN a THEN 'isolation_forest' END, CASE WHEN b THEN 'vendor_outlier' END, CASE WHEN c THEN 'amount_outlier' END, CASE WHEN d THEN 'time_series_deviation' END], lambda x: x IS NOT NULL), ',') AS reasons,
           30 * a::int + 30 * b::int + 20 * c::int + 20 * d::int > 70 AS high_risk FROM s""")
def r4_combined_score(spark, sf):
    e = C.table(spark, sf, "events").selectExpr("event_id", "event_id % 2 = 0 AS is_anomaly_if", "event_id % 3 = 0 AS is_vendor_outlier", "event_id % 5 = 0 AS is_amount_outlier", "event_id % 7 = 0 AS is_time_series_deviation")
    return anomaly.combined_score(e).select("event_id", "anomaly_score", F.array_join("reasons", ",").alias("reasons"), "high_risk")


@query()
def r10_isolation_forest(spark, sf):
    return anomaly.isolation_forest(C.gold(spark, sf), "txn_id", "amount", "date", "vendor").select("txn_id", "isolation_score", "is_anomaly_if")


@query("""WITH d AS (SELECT DISTINCT 'U' || user_id AS vendor, CAST(ts AS date) AS day FROM events WHERE event_type = 'purchase'), g AS (SELECT vendor, day, day - lag(day) OVER (PARTITION BY vendor ORDER BY day) AS gap FROM d),
    p AS (SELECT vendor, count(*) AS n, quantile_cont(gap, 0.5) AS gap, max(day) AS last FROM g GROUP BY vendor)
    SELECT vendor, n, gap::double AS gap, ((SELECT max(day) FROM d) - last) > gap + 5 AS is_late FROM p WHERE n >= 3""")
def recurring_late(spark, sf):
    one, _ = C.event_sides(spark, sf)
    return anomaly.seasonal_naive(one, "vendor", "date").drop("last")


# ------------------------------------------------------------------------------------------------- text and ETL


@query(r"""WITH n AS (SELECT p_partkey, lower('The ' || p_name || ', Inc. & ' || p_brand) AS s FROM part),
    a AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(s, '\b(llc|inc|corp|ltd|co)\b\.?', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM n)
    SELECT p_partkey, trim(regexp_replace(regexp_replace(s, '\b(the|a|and|&)\b', '', 'g'), '\s+', ' ', 'g')) AS merchant FROM a""")
def c3_merchant(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", T.merchant(F.concat(F.lit("The "), "p_name", F.lit(", Inc. & "), "p_brand")).alias("merchant"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('Fwd: ' || p_name || ' $1,' || p_size || '00.50 (' || p_type || ')'), '^(re|fwd|fw)\s*:\s*', ''), '\$[\d,]+(?:\.\d{1,2})?', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS subject FROM part""")
def c4_subject(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", T.subject(F.concat(F.lit("Fwd: "), "p_name", F.lit(" $1,"), F.col("p_size").cast("string"), F.lit("00.50 ("), "p_type", F.lit(")"))).alias("subject"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace('ssn 123-45-6789 ' || text, '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g'), '\b(?:\d{4}[- ]?){3}\d{4}\b', '[CC]', 'g') AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\b\+?1?\s*\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b', '[PHONE]', 'g'), '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g')) AS masked_md5 FROM m""")
def c12_masking(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", F.md5(T.masked(F.concat(F.lit("ssn 123-45-6789 "), "text"))).alias("masked_md5"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS user_hash FROM customer")
def c16_user_hash(spark, sf):
    return C.table(spark, sf, "customer").select("c_custkey", T.user_hash(F.col("c_name")).alias("user_hash"))


_EXPANDED = " ".join(f"WHEN regexp_matches(name, '(?i){p}') THEN regexp_replace(name, '(?i){p}', '{full}')" for p, full in T.EXPANSIONS)
_STATEMENTS = ("WHOLEFDS MKT #0523", "WHOLEFDS", "SQ *WFM #05", "STARBUCKS STORE 123", "DELTA AIR LINES 006", "UBER * TRIP", "LYFT *RIDE", "MARRIOTT SF DOWNTOWN", "AIRBNB * HM", "AIRBNB INC", "AWS EMEA LLC", "WEWORK 12", "DOORDASH *X", "INTUIT * QUICKBOOKS", "COSTCO WHSE #1", "TRADER JOE S #127", "Plain name")
_STATEMENT_LIST = ", ".join(f"'{x}'" for x in _STATEMENTS)


@query(f"""WITH n AS (SELECT p_partkey, ([{_STATEMENT_LIST}])[1 + p_partkey % {len(_STATEMENTS)}] || ' ' || p_partkey AS name FROM part)
    SELECT p_partkey, CASE WHEN name LIKE 'Plain%' THEN name {_EXPANDED} ELSE name END AS expanded FROM n""")
def c2_statement_names(spark, sf):
    """All sixteen expansions, and names that are not raw."""
    name = F.concat(F.element_at(F.array(*map(F.lit, _STATEMENTS)), (1 + F.col("p_partkey") % len(_STATEMENTS)).cast("int")), F.lit(" "), F.col("p_partkey").cast("string"))
    return C.table(spark, sf, "part").select("p_partkey", T.expanded_name(name).alias("expanded"))


_MESSAGES = ("'Bearer ' || md5(k) || ' failed' || chr(10) || 'second line'", "'sent Basic QWx' || md5(k) || '== to host'", "'by dapi' || md5(k) || ' today'", "'api_key = ' || md5(k) || ' left'", "'got eyJ' || md5(k) || '.' || md5(k) || '.' || md5(k)", "'blob ' || md5(k) || md5(k) || ' end'", "repeat('long ' || k || ' ', 100)", "'plain ' || k")
_CASES = " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MESSAGES))
_REDACT = "split_part(m, chr(10), 1)"
for _pattern in T.SECRETS:
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern}', '[REDACTED]', 'g')"


@query(f"""WITH k AS (SELECT event_id, event_id::varchar AS k FROM events), m AS (SELECT event_id, CASE event_id % {len(_MESSAGES)} {_CASES} END AS m FROM k), r AS (SELECT event_id, 'ValueError: ' || {_REDACT} AS r FROM m)
    SELECT event_id, CASE WHEN length(r) > 500 THEN substr(r, 1, 497) || '...' ELSE r END AS message FROM r""")
def c13_redaction(spark, sf):
    """All six kinds of secrets, long messages and plain ones."""
    rows = C.table(spark, sf, "events").selectExpr("event_id", "CAST(event_id AS string) AS k").selectExpr("event_id", f"CASE event_id % {len(_MESSAGES)} {_CASES} END AS m")
    return rows.select("event_id", T.redacted(F.lit("ValueError"), F.col("m")).alias("message"))


@query("SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_amount, (isodow(o_orderdate) - 1)::double AS weekday, day(o_orderdate)::double AS day, (('0x' || substr(md5('V' || o_custkey), 1, 8))::bigint % 1000)::double AS vendor_bucket FROM orders")
def c18_calendar_features(spark, sf):
    o = C.table(spark, sf, "orders")
    f = T.calendar_features(F.col("o_totalprice"), F.col("o_orderdate"), F.concat(F.lit("V"), F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", *f).withColumn("log_amount", F.round("log_amount", 6))


@query()
def c9_sequence_ratio(spark, sf):
    p = C.table(spark, sf, "part")
    return p.select("p_partkey", S.sequence_ratio_udf("p_name", "p_type").alias("score"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?(-->|$)|<script.*?(</script>|$)|<style.*?(</style>|$)', ' ', 'g') AS s FROM pages),
    b AS (SELECT page_id, CASE WHEN regexp_matches(s, '(?i)<body[^>]*>') THEN regexp_extract(s, '(?is)<body[^>]*>(.*?)(</body|$)', 1) ELSE s END AS b FROM s),
    t AS (SELECT page_id, regexp_replace(b, '<[A-Za-z/!][^>]*(>|$)', ' ', 'g') AS t FROM b)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '&amp;?', '&amp;', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM t""")
def c14_visible_text(spark, sf):
    """The SQL knows the references that the pages hold."""
    return C.table(spark, sf, "pages").select("page_id", markup.visible_text(F.col("html")).alias("text"))


@query(f"""WITH {C.GOLD} SELECT txn_id, concat_ws(',', CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN date IS NULL THEN 'date' END) AS missing, concat_ws(',', CASE WHEN vendor IS NOT NULL THEN 'merchant_name' END) AS present FROM gold""")
def f1_required_fields(spark, sf):
    raw = C.gold(spark, sf).select(F.col("txn_id").alias("transaction_id"), F.lit("a").alias("account_id"), "amount", "date", F.col("vendor").alias("merchant_name"))
    return raw.select(F.col("transaction_id").alias("txn_id"), F.array_join(etl.missing_fields(raw, "transaction"), ",").alias("missing"), F.array_join(etl.present_fields(raw, "transaction"), ",").alias("present"))


@query(f"""WITH {C.GOLD} SELECT txn_id AS transaction_id, round(amount, 2) AS amount, strftime(date, '%Y-%m-%d') AS date, vendor AS merchant_name,
    CASE WHEN amount IS NULL OR date IS NULL THEN 'missing ' || concat_ws(', ', CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN date IS NULL THEN 'date' END) END AS error FROM gold""")
def f3_transform_transactions(spark, sf):
    raw = C.gold(spark, sf).select(F.col("txn_id").alias("transaction_id"), F.lit("a").alias("account_id"), "amount", "date", F.concat(F.lit("  "), "vendor", F.lit(" ")).alias("merchant_name"))
    return etl.transform(raw, "transaction", "batch").select("transaction_id", F.round("amount", 2).alias("amount"), F.date_format("date", "yyyy-MM-dd").alias("date"), "merchant_name", "error")


@query("""SELECT conv_id || '-' || turn AS message_id, sha256(lower(role || '@Example.com')) AS sender, CASE WHEN turn % 2 = 0 THEN 'no recipients' END AS error FROM conversations""")
def f4_transform_emails(spark, sf):
    raw = C.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.lit("2024-01-01T00:00:00Z").alias("received_at"), F.concat("role", F.lit("@Example.com ")).alias("sender"), F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x@y.z"))).alias("recipients"), F.col("text").alias("body_preview"))
    return etl.transform(raw, "email", "batch").select("message_id", "sender", "error")


@query("""SELECT 'e' || event_id AS event_id, CASE WHEN event_id % 4 = 0 THEN 'ends before it starts' END AS error FROM events""")
def f5_transform_events(spark, sf):
    raw = C.table(spark, sf, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.col("ts").alias("start_time"), F.expr("CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts + INTERVAL 1 HOUR END").alias("end_time"), F.lit("o").alias("organizer"), F.col("event_type").alias("subject"))
    return etl.transform(raw, "calendar_event", "batch").select("event_id", "error")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def f7_watermark(spark, sf):
    return etl.newer_than(C.table(spark, sf, "events").withColumnRenamed("ts", "ingested_at"), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT user_id, event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC, event_id DESC) = 1")
def k10_silver_upsert(spark, sf):
    e = C.table(spark, sf, "events")
    one = [e.where(f"event_id % 2 = {k}").selectExpr("user_id", "event_id", "value", "struct(ts, event_id % 2, event_id) AS ingested_at") for k in (0, 1)]
    return etl.upsert_latest(one[0], one[1], "user_id").select("user_id", "event_id", F.round("value", 4).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1")
def w4_first_wins(spark, sf):
    l = C.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "struct(l_linenumber, l_partkey, l_suppkey) AS pos")
    return etl.first_by(l, "l_orderkey", "pos").drop("pos")


# ------------------------------------------------------------------------------------------------------ matching

_RULE = PairRule("transaction", "email", ("transaction_id", "message_id"), ("merchant_name", "subject", "date"), FuzzyRule(("subject",), {}, 3, 0.80))
_TIER1 = "SELECT source_id, target_id, 'transaction_id:' || exact AS linkage_key FROM (SELECT s.source_id, t.target_id, s.exact, row_number() OVER (PARTITION BY s.source_id ORDER BY t.pos, t.target_id) AS n FROM s JOIN t USING (exact)) WHERE n = 1"
_TIER2 = "SELECT source_id, target_id FROM (SELECT s.source_id, t.target_id, row_number() OVER (PARTITION BY s.source_id ORDER BY t.pos, t.target_id) AS n FROM s JOIN t ON s.name = t.name AND s.day = t.day WHERE s.name <> '') WHERE n = 1"
_BAND = "SELECT s.source_id, t.target_id, t.pos, round(1 - levenshtein(s.name, t.name) / greatest(length(s.name), length(t.name), 1)::double, 9) AS score FROM s JOIN t ON abs(s.day - t.day) <= 3 WHERE 1 - levenshtein(s.name, t.name) / greatest(length(s.name), length(t.name), 1)::double >= 0.8"


@query(f"WITH {C.PARTS} {_TIER1}")
def j1_exact(spark, sf):
    return matching.tier1(*C.part_entities(spark, sf), "transaction_id").select("source_id", "target_id", "linkage_key")


@query(f"WITH {C.PARTS} {_TIER2}")
def j2_composite(spark, sf):
    return matching.tier2(*C.part_entities(spark, sf), _RULE.composite).select("source_id", "target_id")


@query(f"WITH {C.PARTS}, b AS ({_BAND}) SELECT source_id, min(target_id) AS target_id, round(min(score), 6) AS confidence, 'fuzzy:subject:' || printf('%.2f', min(score)) AS linkage_key FROM b GROUP BY source_id HAVING count(*) = 1")
def j4_fuzzy_links(spark, sf):
    links, _ = matching.tier3(*C.part_entities(spark, sf), _RULE, "edit")
    return links.select("source_id", "target_id", F.round("confidence", 6).alias("confidence"), "linkage_key")


@query(f"WITH {C.PARTS}, b AS ({_BAND}) SELECT source_id, string_agg(target_id, ',' ORDER BY pos, target_id) AS candidates FROM b GROUP BY source_id HAVING count(*) > 1")
def j4_fuzzy_ambiguous(spark, sf):
    _, ambiguous = matching.tier3(*C.part_entities(spark, sf), _RULE, "edit")
    return ambiguous.select("source_id", F.array_join("candidate_ids", ",").alias("candidates"))


@query(f"""WITH {C.PARTS}, one AS ({_TIER1}), two AS ({_TIER2}), b AS ({_BAND}), three AS (SELECT source_id, count(*) AS n FROM b GROUP BY source_id)
    SELECT s.source_id, CASE WHEN one.source_id IS NOT NULL THEN 'tier1_exact' WHEN two.source_id IS NOT NULL THEN 'tier2_composite' WHEN three.n = 1 THEN 'tier3_fuzzy' WHEN three.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome
    FROM s LEFT JOIN one USING (source_id) LEFT JOIN two USING (source_id) LEFT JOIN three USING (source_id)""")
def j5_cascade(spark, sf):
    m = matching.cascade(*C.part_entities(spark, sf), _RULE, scorer="edit")
    return m.links.select("source_id", F.col("match_tier").alias("outcome")).unionByName(m.ambiguous.select(F.col("source_entity_id").alias("source_id"), F.lit("ambiguous").alias("outcome"))).unionByName(m.unmatched.select(F.col("entity_id").alias("source_id"), F.lit("unmatched").alias("outcome")))


@query(f"""WITH {C.PARTS}, one AS ({_TIER1}), two AS ({_TIER2}), b AS ({_BAND}), three AS (SELECT source_id, count(*) AS n FROM b GROUP BY source_id),
    o AS (SELECT s.source_id, CASE WHEN one.source_id IS NOT NULL THEN 1 WHEN two.source_id IS NOT NULL THEN 2 WHEN three.n = 1 THEN 3 WHEN three.n > 1 THEN 4 ELSE 5 END AS o FROM s LEFT JOIN one USING (source_id) LEFT JOIN two USING (source_id) LEFT JOIN three USING (source_id))
    SELECT 'transaction' AS source_type, 'email' AS target_type, count(*) AS entities, count(*) FILTER (o = 1) AS tier1_exact, count(*) FILTER (o = 2) AS tier2_composite, count(*) FILTER (o = 3) AS tier3_fuzzy, count(*) FILTER (o = 4) AS ambiguous, count(*) FILTER (o = 5) AS unmatched,
           round(count(*) FILTER (o <= 3) / count(*)::double, 6) AS match_rate, round(count(*) FILTER (o = 4) / count(*)::double, 6) AS ambiguity_rate, round(count(*) FILTER (o = 5) / count(*)::double, 6) AS unmatched_rate FROM o""")
def a8_match_metrics(spark, sf):
    out = matching.match_metrics(matching.cascade(*C.part_entities(spark, sf), _RULE, scorer="edit"))
    return out.withColumns({c: F.round(c, 6) for c in ("match_rate", "ambiguity_rate", "unmatched_rate")})


@query()
def j4_weighted(spark, sf):
    links, ambiguous = matching.tier3(*C.part_entities(spark, sf), _RULE, "weighted")
    return links.select("source_id", "confidence", "linkage_key").unionByName(ambiguous.select("source_id", F.array_max("candidate_scores").alias("confidence"), F.lit("ambiguous").alias("linkage_key")))


# ------------------------------------------------------------------------------------------------------ merges


@query(f"""WITH {C.LINKS}, j AS (SELECT cur.*, pro.link_id AS p_id, pro.match_tier AS p_tier FROM cur LEFT JOIN pro ON cur.source_id = pro.source_id AND cur.target_id = pro.target_id AND cur.is_current)
    SELECT link_id, source_id, match_tier, CASE WHEN is_current AND p_id IS NOT NULL AND p_tier <> match_tier THEN 'closed' ELSE 'kept' END AS action, is_current AND NOT (p_id IS NOT NULL AND p_tier <> match_tier) AS is_current, CASE WHEN p_id IS NOT NULL AND p_tier <> match_tier THEN p_id END AS superseded_by FROM j
    UNION ALL SELECT link_id, source_id, match_tier, 'inserted', true, NULL FROM pro WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.is_current AND cur.source_id = pro.source_id AND cur.match_tier = pro.match_tier)""")
def k5_scd2_merge(spark, sf):
    return merge.scd2(*C.links(spark, sf)).select("link_id", "source_id", "match_tier", "action", "is_current", "superseded_by")


@query(f"WITH {C.LINKS} SELECT source_id, link_id FROM pro UNION ALL SELECT source_id, link_id FROM cur WHERE source_id NOT IN (SELECT source_id FROM pro)")
def k1_upsert(spark, sf):
    cur, pro = C.links(spark, sf)
    return merge.upsert(cur, pro, ["source_id"], preserve=("created_at",)).select("source_id", "link_id")


@query(f"WITH {C.LINKS} SELECT source_id, link_id FROM cur UNION ALL SELECT source_id, link_id FROM pro WHERE source_id NOT IN (SELECT source_id FROM cur)")
def k8_insert_absent(spark, sf):
    cur, pro = C.links(spark, sf)
    return merge.insert_absent(cur, pro, ["source_id"]).select("source_id", "link_id")


@query(f"WITH {C.LINKS} SELECT link_id, is_current AND k % 4 <> 0 AS is_current, is_current AND k % 4 = 0 AS closed FROM cur")
def k3_soft_delete(spark, sf):
    cur, _ = C.links(spark, sf)
    gone = cur.where("CAST(substring(link_id, 2) AS bigint) % 4 = 0").select("link_id")
    return merge.soft_delete(cur, gone, F.lit("2024-03-01").cast("timestamp")).select("link_id", "is_current", F.col("effective_to").isNotNull().alias("closed"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def k15_purge(spark, sf):
    return merge.purge(C.table(spark, sf, "events"), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id")


@query(f"WITH {C.LINKS}, w AS (SELECT target_id AS e FROM cur WHERE k = (SELECT min(k) FROM cur)) SELECT 'entity_links' AS \"table\", count(*) AS rows_deleted FROM cur, w WHERE target_id = e OR source_id = e UNION ALL SELECT 'link_feedback', count(*) FROM cur, w WHERE (target_id = e OR source_id = e) AND k % 2 = 0")
def k17_erasure(spark, sf):
    cur, _ = C.links(spark, sf)
    who = cur.orderBy(F.expr("CAST(substring(link_id, 2) AS bigint)")).select("target_id").first()
    notes = cur.where("CAST(substring(link_id, 2) AS bigint) % 2 = 0").select(F.concat(F.lit("F"), "link_id").alias("feedback_id"), "link_id")
    return merge.erase({"entity_links": cur, "link_feedback": notes}, who["target_id"] if who else "")[1]


# ------------------------------------------------------------------------------------------------------ severity

_SIGNALS = f"""{C.GOLD}, sig AS (SELECT *, pos % 4 = 0 OR coalesce(amount >= 5000, false) AS un, vendor IS NULL OR amount IS NULL OR date IS NULL AS inc, coalesce(vendor IS NOT NULL AND date IS NOT NULL AND count(*) OVER (PARTITION BY vendor, date, source) > 1, false) AS dup FROM gold),
    sc AS (SELECT *, 50 * un::int + 30 * inc::int + 40 * dup::int + 20 * (coalesce(amount, 0) >= 5000)::int - 20 * (pos % 9 = 0)::int AS score, un::int + inc::int + dup::int + (coalesce(amount, 0) >= 5000)::int + (pos % 9 = 0)::int AS nf FROM sig WHERE un OR inc OR dup)"""


@query(f"""WITH {_SIGNALS} SELECT txn_id, score, CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 50 THEN 'WARNING' ELSE 'INFO' END AS severity FROM sc
    WHERE NOT (nf = 1 AND un AND coalesce(amount, 0) < 5000) AND NOT (score < 50 AND coalesce(amount, 0) < 50)""")
def r2_audit(spark, sf):
    g = C.gold(spark, sf)
    scored = A.audit(g, g.where("pos % 4 = 0").select("txn_id"), ["vendor", "date", "source"], g.where("pos % 9 = 0").select("txn_id"))
    return scored.select("txn_id", "score", "severity")


@query(f"""WITH {_SIGNALS} SELECT CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 50 THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS n FROM sc
    WHERE NOT (nf = 1 AND un AND coalesce(amount, 0) < 5000) AND NOT (score < 50 AND coalesce(amount, 0) < 50) GROUP BY 1""")
def a15_severity_histogram(spark, sf):
    return metrics.severity_histogram(r2_audit(spark, sf))


@query(f"""WITH {C.GOLD} SELECT txn_id, 50 * (pos % 2 = 0)::int + 30 * (vendor IS NULL)::int + 20 * coalesce((amount > 10000)::int, 0) AS score,
    CASE WHEN 50 * (pos % 2 = 0)::int + 30 * (vendor IS NULL)::int + 20 * coalesce((amount > 10000)::int, 0) >= 70 THEN 'CRITICAL' WHEN 50 * (pos % 2 = 0)::int + 30 * (vendor IS NULL)::int + 20 * coalesce((amount > 10000)::int, 0) >= 50 THEN 'WARNING' ELSE 'INFO' END AS severity,
    round(least(((pos % 2 = 0)::int + (vendor IS NULL)::int + coalesce((amount > 10000)::int, 0)) / 3.0, 1.0)::double, 2) AS confidence FROM gold""")
def r1_tool_severity(spark, sf):
    g = C.gold(spark, sf).withColumns({"is_unmatched": F.col("pos") % 2 == 0, "is_incomplete": F.col("vendor").isNull()})
    return severity.tool_severity(g).select("txn_id", "score", "severity", "confidence")


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS s, o_totalprice / 1000 AS a FROM orders)
    SELECT o_orderkey, CASE WHEN s = 'CRITICAL' AND a > 1000 THEN s WHEN s = 'INFO' AND a < 50 THEN 'AUTO_APPROVED' ELSE s END AS status FROM f""")
def r3_escalation(spark, sf):
    f = C.table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS s", "o_totalprice / 1000 AS a")
    return f.select("o_orderkey", severity.escalated(F.col("s"), F.col("a"), F.lit("v")).alias("status"))


@query(f"WITH {_SIGNALS} SELECT DISTINCT txn_id FROM sc")
def u1_suspicious(spark, sf):
    g = C.gold(spark, sf)
    s = severity.signals(g, g.where("pos % 4 = 0").select("txn_id"), ["vendor", "date", "source"])
    return severity.suspicious(g, [s.where(c) for c in ("is_unmatched", "is_incomplete", "is_duplicate")]).select("txn_id")


_AMBIGUITY = """WITH a AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 600000, 2) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 600000, 2) DESC, 'O' || o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    p AS (SELECT o_custkey, max(n) AS n, max(s) FILTER (r = 1) AS a, max(s) FILTER (r = 2) AS b, max('O' || o_orderkey) FILTER (r = 1) AS id FROM a GROUP BY o_custkey)
    SELECT o_custkey AS source, round(CASE WHEN n = 1 THEN 0 ELSE a - b END, 6) AS gap, CASE WHEN n = 1 OR a - b >= 0.15 THEN 'resolve' ELSE 'escalate' END AS decision, CASE WHEN n = 1 OR a - b >= 0.15 THEN id END AS target_id FROM p"""


@query(_AMBIGUITY)
def w6_ambiguity(spark, sf):
    o = C.table(spark, sf, "orders").selectExpr("o_custkey AS source", "struct(o_orderkey, concat('O', o_orderkey) AS i, round(o_totalprice / 600000, 2) AS s) AS c").groupBy("source").agg(F.sort_array(F.collect_list("c")).alias("c"))
    amb = o.select("source", F.col("c.i").alias("candidate_ids"), F.col("c.s").alias("candidate_scores"))
    return severity.resolve_ambiguity(amb).select("source", F.round("gap", 6).alias("gap"), "decision", "target_id")


# ---------------------------------------------------------------------------------------- reconciliation, evidence


@query("""WITH a AS (SELECT * FROM events WHERE event_type = 'purchase'), b AS (SELECT * FROM events WHERE event_type = 'click')
    SELECT 'E' || a.event_id AS source_1_id, 'E' || b.event_id AS source_2_id FROM a JOIN b USING (user_id)
    WHERE a.value <> 0 AND abs(a.value - b.value) / a.value <= 0.05 AND abs(floor((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)) <= 3""")
def j8_candidates(spark, sf):
    return reconcile.candidates(*C.event_sides(spark, sf)).select(F.col("a_id").alias("source_1_id"), F.col("b_id").alias("source_2_id"))


@query("""WITH RECURSIVE a AS (SELECT * FROM events WHERE event_type = 'purchase'), b AS (SELECT * FROM events WHERE event_type = 'click'),
    c AS (SELECT user_id, a.event_id AS x, b.event_id AS y, a.value AS amount, b.value AS other, CAST(abs(floor((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)) AS int) AS diff, row_number() OVER (PARTITION BY user_id ORDER BY a.event_id, b.event_id) AS n
          FROM a JOIN b USING (user_id) WHERE a.value <> 0 AND abs(a.value - b.value) / a.value <= 0.05 AND abs(floor((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)) <= 3),
    g AS (SELECT DISTINCT user_id, 0::bigint AS n, false AS taken, []::bigint[] AS used, []::bigint[] AS gone FROM c
          UNION ALL SELECT g.user_id, c.n, NOT (list_contains(used, x) OR list_contains(gone, y)), CASE WHEN list_contains(used, x) OR list_contains(gone, y) THEN used ELSE list_append(used, x) END, CASE WHEN list_contains(used, x) OR list_contains(gone, y) THEN gone ELSE list_append(gone, y) END
          FROM g JOIN c ON c.user_id = g.user_id AND c.n = g.n + 1)
    SELECT 'E' || x AS source_1_id, 'E' || y AS source_2_id, CASE WHEN diff = 0 AND amount = other THEN 0.95 ELSE 0.85 END::double AS confidence, diff AS date_diff, round(amount, 6) AS amount, 'U' || user_id AS vendor FROM c JOIN g USING (user_id, n) WHERE g.taken""")
def j8_cross_source(spark, sf):
    return reconcile.cross_source(*C.event_sides(spark, sf)).withColumn("amount", F.round("amount", 6))


@query("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT 'No Such Name'), k AS (SELECT s_suppkey, split_part(p_name, ' ', 1) AS canonical_name, p_name AS aliases FROM supplier JOIN part ON s_suppkey = p_partkey),
    h AS (SELECT n.name, 'K' || lpad(s_suppkey::varchar, 9, '0') AS entity_id, canonical_name, row_number() OVER (PARTITION BY n.name ORDER BY 'K' || lpad(s_suppkey::varchar, 9, '0')) AS r FROM n JOIN k ON n.name = canonical_name OR contains(aliases, n.name))
    SELECT n.name, coalesce(h.entity_id, 'unknown_' || lower(replace(n.name, ' ', '_'))) AS entity_id, coalesce(h.canonical_name, n.name) AS canonical_name, CASE WHEN h.entity_id IS NULL THEN 0.0 ELSE 0.95 END::double AS confidence FROM n LEFT JOIN h ON n.name = h.name AND h.r = 1""")
def j9_known_entities(spark, sf):
    p, s = C.table(spark, sf, "part"), C.table(spark, sf, "supplier")
    first = F.split("p_name", " ")[0]
    names = p.select(first.alias("name")).distinct().unionByName(spark.createDataFrame([("No Such Name",)], "name string"))
    known = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.concat(F.lit("K"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("entity_id"), first.alias("canonical_name"), F.col("p_name").alias("aliases"))
    return reconcile.known_entities(names, known)


@query()
def j10_receipts(spark, sf):
    g = C.gold(spark, sf).where("vendor IS NOT NULL AND amount IS NOT NULL AND date IS NOT NULL")
    found = g.selectExpr("concat('R', pos) AS receipt_id", "vendor", "amount * 1.01 AS amount", "date_add(date, 2) AS date")
    return reconcile.receipts(found, g)


_EVIDENCE = r"""t AS (SELECT 'E' || event_id AS txn_id, CAST(ts AS date) AS d, CASE event_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'AND' ELSE 'with' END AS v FROM events),
    m AS (SELECT conv_id || '-' || turn AS message_id, conv_id * 1000 + turn AS pos, DATE '2024-01-01' + CAST(conv_id % 30 AS int) AS d, regexp_extract(text, '^[^.!?\n]*') AS s, text AS b FROM conversations)"""


def _evidence(spark, sf):
    t = C.table(spark, sf, "events").selectExpr("concat('E', event_id) AS txn_id", "CAST(ts AS date) AS date", "CASE event_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'AND' ELSE 'with' END AS vendor")
    m = C.table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS message_id", "concat(conv_id, '-', turn) AS event_id", "conv_id * 1000 + turn AS pos", "date_add(DATE'2024-01-01', CAST(conv_id % 30 AS int)) AS received_at", "date_add(DATE'2024-01-01', CAST(conv_id % 30 AS int)) AS start_time", r"regexp_extract(text, '^[^.!?\\n]*', 0) AS subject", "text AS body_preview")
    return t, m


@query(f"""WITH {_EVIDENCE}, h AS (SELECT txn_id, message_id, CASE WHEN contains(lower(s), lower(v)) THEN 0.9 ELSE 0.7 END::double AS confidence, row_number() OVER (PARTITION BY txn_id ORDER BY pos, message_id) AS rank FROM t JOIN m ON abs(t.d - m.d) <= 3 WHERE contains(lower(s), lower(v)) OR contains(lower(b), lower(v)))
    SELECT txn_id, message_id, confidence, rank FROM h WHERE rank <= 5""")
def j11_email_evidence(spark, sf):
    return context.email_evidence(*_evidence(spark, sf))


@query(f"""WITH {_EVIDENCE}, h AS (SELECT txn_id, message_id AS event_id, row_number() OVER (PARTITION BY txn_id ORDER BY pos, message_id) AS rank FROM t JOIN m ON abs(t.d - m.d) <= 3 WHERE contains(lower(b), lower(v))) SELECT * FROM h WHERE rank <= 5""")
def j12_event_evidence(spark, sf):
    t, m = _evidence(spark, sf)
    return context.event_evidence(t, m.withColumn("subject", F.col("body_preview")))


_KEYWORDS = ", ".join(f"'{k}'" for k in T.APPROVALS)


@query(f"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN text || ' We ' || (['approved', 'PAID it', 'agree', 'will see'])[1 + conv_id % 4] ELSE text END AS body FROM conversations),
    k AS (SELECT conv_id, turn, role, list_filter([{_KEYWORDS}], lambda x: contains(lower(body), x))[1] AS k FROM c),
    f AS (SELECT conv_id, arg_min(role, turn) AS approver, min(turn) AS approved_at, arg_min(k, turn) AS keyword FROM k WHERE k IS NOT NULL GROUP BY conv_id)
    SELECT c.conv_id AS thread_id, f.conv_id IS NOT NULL AS approved, approver, approved_at::varchar AS approved_at, keyword FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id)""")
def w8_approvals(spark, sf):
    body = F.expr("CASE WHEN turn % 3 = 0 THEN concat(text, ' We ', element_at(array('approved', 'PAID it', 'agree', 'will see'), cast(1 + conv_id % 4 AS int))) ELSE text END")
    return context.approvals(C.table(spark, sf, "conversations").withColumn("body", body), "conv_id", ["turn"], "role", "body").withColumn("approved_at", F.col("approved_at").cast("string"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: v.embedding[i]::double * q.e[i]::double)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::double * x::double)) * list_sum(list_transform(q.e, lambda x: x::double * x::double))), 6) AS score FROM embeddings v, q ORDER BY 2 DESC, 1 LIMIT 10""")
def r13_semantic_search(spark, sf):
    v = C.table(spark, sf, "embeddings")
    q = v.orderBy("vec_id").select("embedding").first()[0]
    return context.semantic_search(v, q).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {C.LINKS}, b AS (SELECT source_id AS entity_id, target_id AS other_id, link_id FROM cur WHERE is_current UNION ALL SELECT target_id, source_id, link_id FROM cur WHERE is_current) SELECT entity_id, other_id, link_id FROM b WHERE entity_id IN (SELECT 'C' || c_custkey FROM customer)""")
def j14_other_end(spark, sf):
    cur, _ = C.links(spark, sf)
    wanted = C.table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("email").alias("entity_type"))
    return access.other_end(cur, wanted).select("entity_id", "other_id", "link_id")


# ------------------------------------------------------------------------------------- readers, feedback, metrics


@query("SELECT o_orderkey AS txn_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'V' || o_custkey WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'Unknown' END AS vendor, o_totalprice AS amount FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01 00:00:00'")
def s7_gold_scan(spark, sf):
    t = C.table(spark, sf, "orders").selectExpr("o_orderkey AS transaction_id", "CASE WHEN o_orderkey % 7 <> 0 THEN concat('V', o_custkey) END AS merchant_name", "CASE WHEN o_orderkey % 2 = 0 THEN 'raw' END AS name", "o_totalprice AS amount", "o_orderdate AS date", "NULL AS category", "'o' AS source", "'a' AS account_id", "o_orderdate AS ingested_at")
    return readers.gold_transactions(t, F.lit("1995-01-01 00:00:00").cast("timestamp")).select("txn_id", "vendor", "amount")


@query(f"WITH {C.LINKS} SELECT DISTINCT source_id AS txn_id FROM cur WHERE is_current")
def s8_linked_ids(spark, sf):
    return readers.linked_ids(C.links(spark, sf)[0])


@query(f"WITH {C.LINKS} SELECT o_orderkey, EXISTS (SELECT 1 FROM cur WHERE is_current AND source_id = 'S' || o_orderkey) AS reconciliation_matched FROM orders")
def j13_match_status(spark, sf):
    t = C.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("txn_id"))
    return readers.match_status(t, readers.linked_ids(C.links(spark, sf)[0])).select("o_orderkey", "reconciliation_matched")


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run FROM events WHERE event_type IN ('click', 'purchase')")
def s10_last_run(spark, sf):
    runs = C.table(spark, sf, "events").selectExpr("CASE event_type WHEN 'click' THEN 'success' WHEN 'purchase' THEN 'partial' ELSE 'failed' END AS status", "ts AS start_time")
    return readers.last_run(runs).select(F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query(f"WITH {C.LINKS} SELECT match_tier, count(*) AS n FROM cur WHERE is_current GROUP BY 1")
def a14_links_per_tier(spark, sf):
    return metrics.links_per_tier(C.links(spark, sf)[0])


@query(f"WITH {C.GOLD} SELECT source, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last FROM gold GROUP BY 1")
def a16_source_summary(spark, sf):
    return metrics.source_summary(C.gold(spark, sf)).select("source", "n", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


@query("""WITH c AS (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS tp, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0) AS fp, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) AS fn, count(*) AS n FROM orders)
    SELECT tp, fp, fn, n - tp - fp - fn AS tn, round(tp / (tp + fp)::double, 6) AS precision, round(tp / (tp + fn)::double, 6) AS recall, round((n - fp - fn) / n::double, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn)::double, 6) AS f1 FROM c""")
def a6_confusion(spark, sf):
    o = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn_id"))
    out = metrics.confusion(o.where("txn_id % 3 = 0"), o.where("txn_id % 2 = 0"), everything=o)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1")})


@query("""WITH n AS (SELECT event_type AS source_type, coalesce(CASE WHEN event_id % 5 <> 0 THEN 'email' END, 'unknown') AS target_type, count(*) AS n FROM events WHERE value < 20 GROUP BY 1, 2), t AS (SELECT event_type AS source_type, count(*) AS total FROM events GROUP BY 1)
    SELECT source_type, target_type, n, round(n / total::double, 6) AS rate FROM n JOIN t USING (source_type)""")
def a10_unmatched_rate(spark, sf):
    e = C.table(spark, sf, "events")
    u = e.where("value < 20").selectExpr("event_type AS entity_type", "CASE WHEN event_id % 5 <> 0 THEN 'email' END AS target_type")
    return metrics.unmatched_rate(u, e.groupBy(F.col("event_type").alias("entity_type")).agg(F.count("*").alias("total"))).withColumn("rate", F.round("rate", 6))


_FLAGS = "f AS (SELECT 'V' || (o_custkey % 40) AS vendor, CASE WHEN o_orderkey % 2 = 0 THEN 'amount_outlier' ELSE 'other' END || (o_custkey % 3) AS explanation, CASE WHEN o_custkey % 40 < 3 OR o_orderkey % 4 = 0 THEN 'false_positive' ELSE 'approved' END AS d FROM orders)"


def _flags(spark, sf):
    return C.table(spark, sf, "orders").selectExpr("concat('V', o_custkey % 40) AS vendor", "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'amount_outlier' ELSE 'other' END, o_custkey % 3) AS explanation", "CASE WHEN o_custkey % 40 < 3 OR o_orderkey % 4 = 0 THEN 'false_positive' ELSE 'approved' END AS human_decision")


@query(f"WITH {_FLAGS} SELECT vendor, count(*) AS flags, count(*) FILTER (d = 'false_positive') AS false_positives, round(count(*) FILTER (d = 'false_positive') / count(*)::double, 6) AS fp_rate, count(*) FILTER (d = 'false_positive') / count(*)::double > 0.8 AS whitelist FROM f GROUP BY 1")
def a11_vendor_false_positives(spark, sf):
    return feedback.vendor_false_positives(_flags(spark, sf)).withColumn("fp_rate", F.round("fp_rate", 6))


@query(f"WITH {_FLAGS} SELECT explanation, count(*) AS flags, count(*) FILTER (d = 'false_positive') AS false_positives, round(count(*) FILTER (d = 'false_positive') / count(*)::double, 6) AS fp_rate, count(*) FILTER (d = 'false_positive') / count(*)::double > 0.5 AND contains(explanation, 'amount_outlier') AS raise_sigma FROM f GROUP BY 1")
def a12_rule_false_positives(spark, sf):
    return feedback.rule_false_positives(_flags(spark, sf)).withColumn("fp_rate", F.round("fp_rate", 6))


@query(f"WITH {C.LINKS} SELECT 'S' || k AS entity_id FROM cur WHERE is_current AND k % 6 = 2")
def r7_feedback(spark, sf):
    cur, _ = C.links(spark, sf)
    notes = cur.selectExpr("link_id", "CASE WHEN CAST(substring(link_id, 2) AS bigint) % 6 = 2 THEN 'rejected' ELSE 'confirmed' END AS signal", "false AS processed")
    empty = spark.createDataFrame([], "entity_id string, entity_type string, target_type string, reason_code string, run_id string, created_at timestamp")
    return feedback.process(cur, empty, notes, F.lit("2024-03-01").cast("timestamp")).unmatched.select("entity_id")


@query("SELECT count(*) AS handled, count(*) FILTER (event_type = 'click') AS rejected, round(count(*) FILTER (event_type = 'click') / count(*)::double, 6) AS rejection_rate, round(avg(epoch(TIMESTAMP '2024-03-01') - epoch(ts)), 3) AS mean_latency_s FROM events")
def a13_feedback_metrics(spark, sf):
    f = C.table(spark, sf, "events").selectExpr("CASE WHEN event_type = 'click' THEN 'rejected' ELSE 'confirmed' END AS signal", "ts AS created_at")
    return feedback.feedback_metrics(f, F.lit("2024-03-01").cast("timestamp")).select("handled", "rejected", F.round("rejection_rate", 6).alias("rejection_rate"), F.round("mean_latency_s", 3).alias("mean_latency_s"))


@query("""WITH c AS (SELECT user_id, arg_max(event_type <> 'click', event_id) AS ok FROM events GROUP BY user_id) SELECT 'U' || user_id AS user_hash, ok AND user_id % 10 <> 0 AS allowed FROM c""")
def f12_consent(spark, sf):
    e = C.table(spark, sf, "events")
    con = e.selectExpr("concat('U', user_id) AS user_hash", "event_type <> 'click' AS granted", "event_id AS granted_at", "CAST(NULL AS timestamp) AS expires_at")
    pref = e.where("user_id % 10 = 0").selectExpr("concat('U', user_id) AS user_hash", "'opt_out' AS preference", "'true' AS value", "event_id AS updated_at")
    return access.consents(con, pref, F.lit("2024-03-01").cast("timestamp"))


def _draw(ident: str, seed: int) -> str:
    """SQL of ``datagen.draw``."""
    return f"(('0x' || substr(md5({ident} || '#{seed}'), 1, 8))::bigint / 4294967296.0::double)"


@query(f"""WITH {C.GOLD}, d AS (SELECT *, {_draw('txn_id', 1)} < 0.15 AS hit, {_draw('txn_id', 2)} AS kind FROM gold),
    k AS (SELECT *, hit AND (kind < 0.5 OR kind >= 0.8) AS v, hit AND kind >= 0.5 AND kind < 0.8 AS a, hit AND kind >= 0.8 AS e FROM d)
    SELECT txn_id, pos, CASE WHEN NOT v THEN vendor END AS vendor, CASE WHEN NOT a THEN amount END AS amount, strftime(CASE WHEN NOT e THEN date END, '%Y-%m-%d') AS date, source, concat_ws(',', CASE WHEN v THEN 'vendor' END, CASE WHEN a THEN 'amount' END, CASE WHEN e THEN 'date' END) AS nulled FROM k""")
def g1_missing_fields(spark, sf):
    return datagen.missing_fields(C.gold(spark, sf)).withColumn("nulled", F.array_join("nulled", ",")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(f"""WITH {C.GOLD}, p AS (SELECT *, unnest(range(1, CASE WHEN {_draw('txn_id', 4)} < 0.5 THEN 3 ELSE 4 END)) AS copy FROM gold WHERE {_draw('txn_id', 3)} < 0.10)
    SELECT txn_id, vendor, round(amount, 2) AS amount, NULL AS copy_of FROM gold UNION ALL
    SELECT txn_id || '_dup' || copy, vendor, round(amount + CASE WHEN {_draw('txn_id', 5)} < 0.5 THEN round({_draw('txn_id', 6)} * 10 - 5, 2) ELSE 0 END, 2), txn_id FROM p""")
def g2_duplicates(spark, sf):
    return datagen.duplicates(C.gold(spark, sf)).select("txn_id", "vendor", F.round("amount", 2).alias("amount"), "copy_of")


@query(f"""WITH {C.GOLD}, p AS (SELECT 'PHANTOM_' || lpad(i::varchar, 4, '0') AS p FROM range(50) r(i))
    SELECT txn_id, vendor, round(amount, 2) AS amount, false AS is_phantom FROM gold WHERE source = 'credit_card' UNION ALL
    SELECT p, 'Phantom Vendor ' || substr(p, 9, 4), round(5000 + {_draw('p', 7)} * 10000, 2), true FROM p""")
def g3_orphans(spark, sf):
    g = C.gold(spark, sf)
    cards, _ = datagen.orphans(g.where("source = 'credit_card'"), g.where("source = 'bank'"))
    return cards.select("txn_id", "vendor", F.round("amount", 2).alias("amount"), "is_phantom")


@query(f"""WITH {C.GOLD}, g AS (SELECT * FROM gold WHERE source = 'bank' ORDER BY {_draw('txn_id', 8)}, txn_id LIMIT 10) SELECT txn_id FROM gold WHERE source = 'bank' AND txn_id NOT IN (SELECT txn_id FROM g)""")
def g3_bank(spark, sf):
    g = C.gold(spark, sf)
    return datagen.orphans(g.where("source = 'credit_card'"), g.where("source = 'bank'"))[1].select("txn_id")


# ---------------------------------------------------------------------------------------------- control tables


def _decisions(spark, sf):
    return A.audit(C.gold(spark, sf), C.gold(spark, sf).where("pos % 4 = 0").select("txn_id"), ["vendor", "date", "source"], C.gold(spark, sf).where("pos % 9 = 0").select("txn_id"))


@query(f"""WITH {_SIGNALS}, k AS (SELECT txn_id, score, CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 50 THEN 'WARNING' ELSE 'INFO' END AS severity FROM sc WHERE NOT (nf = 1 AND un AND coalesce(amount, 0) < 5000) AND NOT (score < 50 AND coalesce(amount, 0) < 50))
    SELECT 'run' AS audit_run_id, row_number() OVER (ORDER BY txn_id) AS log_sequence_number, 'escalation' AS agent_name, txn_id, score::varchar AS score, severity FROM k""")
def k22_audit_trail(spark, sf):
    """Audit-trail entries of all decisions, their payloads read back from JSON."""
    trail = A.logged(_decisions(spark, sf), "run", F.lit("2024-03-01").cast("timestamp"))
    read = lambda c, k: F.get_json_object(c, f"$.{k}").alias(k)
    return trail.select("audit_run_id", "log_sequence_number", "agent_name", read("input_data", "txn_id"), read("output_summary", "score"), read("output_summary", "severity"))


@query("""WITH s AS (SELECT 'R' || user_id AS run, arg_max(event_type, event_id) AS status FROM events WHERE event_type <> 'view' GROUP BY 1), n AS (SELECT 'R' || user_id AS run, 'completed' AS status FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT run AS audit_run_id, status AS workflow_status, 'final' AS current_agent FROM n UNION ALL SELECT run, status, 'first' FROM s WHERE run NOT IN (SELECT run FROM n)""")
def k23_workflow_state(spark, sf):
    e = C.table(spark, sf, "events")
    at, none = F.lit("2024-03-01").cast("timestamp"), spark.createDataFrame([], WORKFLOW_STATE)
    old = control.workflow_upsert(none, e.where("event_type <> 'view'").groupBy(F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("audit_run_id")).agg(F.max_by("event_type", "event_id").alias("workflow_status"), F.lit("first").alias("current_agent")), at)
    new = e.where("event_type = 'view'").select(F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("audit_run_id")).distinct().withColumns({"workflow_status": F.lit("completed"), "current_agent": F.lit("final")})
    return control.workflow_upsert(old, new, at).select("audit_run_id", "workflow_status", "current_agent")


@query("SELECT 'U' || user_id AS user_hash, event_type AS preference, arg_max(props, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1, 2")
def k19_preferences(spark, sf):
    """The latest row of each user and preference, even events upserted with odd ones."""
    rows = C.table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_hash"), F.col("event_type").alias("preference"), F.col("props").alias("value"), F.col("event_id").alias("updated_at"))
    return control.latest_by(rows.where("updated_at % 2 = 0"), rows.where("updated_at % 2 = 1"), ["user_hash", "preference"], "updated_at")


@query("""SELECT 'intent_log' AS "table", count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY UNION ALL SELECT 'access_audit_log', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' - INTERVAL 2555 DAY""")
def k16_log_retention(spark, sf):
    e, o = C.table(spark, sf, "events").select(F.col("ts").alias("created_at")), C.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    one = control.expired_logs({"intent_log": e}, F.lit("2024-02-01").cast("timestamp"), intent_days=20)["intent_log"]
    two = control.expired_logs({"access_audit_log": o}, F.lit("2001-01-01").cast("timestamp"))["access_audit_log"]
    return one.agg(F.lit("intent_log").alias("table"), F.count("*").alias("n")).unionByName(two.agg(F.lit("access_audit_log").alias("table"), F.count("*").alias("n")))


@query(f"WITH {C.LINKS} SELECT link_id, source_id FROM cur WHERE is_current AND source_id IN (SELECT 'S' || l_orderkey FROM lineitem)")
def j15_links_of(spark, sf):
    wanted = C.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("source_id"))
    return control.links_of(C.links(spark, sf)[0], wanted).select("link_id", "source_id")


@query(f"""WITH {_SIGNALS}, k AS (SELECT txn_id, score FROM sc WHERE NOT (nf = 1 AND un AND coalesce(amount, 0) < 5000) AND NOT (score < 50 AND coalesce(amount, 0) < 50)),
    f AS (SELECT txn_id FROM k ORDER BY score DESC, txn_id LIMIT 20), e AS (SELECT txn_id, amount * 2 AS evidence_score FROM gold)
    SELECT k.txn_id, round(CASE WHEN f.txn_id IS NOT NULL THEN evidence_score END, 4) AS evidence_score FROM k LEFT JOIN f USING (txn_id) LEFT JOIN e USING (txn_id)""")
def j17_enrichment(spark, sf):
    """All suspicious transactions; the evidence of the twenty of highest score is looked up."""
    evidence = C.gold(spark, sf).select("txn_id", (F.col("amount") * 2).alias("evidence_score"))
    return control.enriched(_decisions(spark, sf), evidence, [F.desc("score"), F.col("txn_id")]).select("txn_id", F.round("evidence_score", 4).alias("evidence_score"))


@query(f"WITH {C.LINKS} SELECT source_id AS txn_id, link_id FROM cur WHERE is_current")
def j18_best_link(spark, sf):
    """Each source has one good current link and a worse one."""
    cur, _ = C.links(spark, sf)
    worse = cur.withColumns({"link_id": F.concat(F.lit("W"), "link_id"), "confidence": F.lit(0.6)})
    return feedback.best_link(cur.unionByName(worse)).select("txn_id", "link_id")


@query(f"WITH {C.LINKS} SELECT 'L' || k AS link_id, 'flagged' AS signal, 'why' AS reason FROM cur WHERE is_current AND k % 5 = 0")
def r6_flag_feedback(spark, sf):
    cur, _ = C.links(spark, sf)
    flagged = C.table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("txn_id"), F.lit("why").alias("explanation"))
    return severity.flag_feedback(flagged, cur, F.lit("2024-03-01").cast("timestamp")).select("link_id", "signal", "reason")


@query(f"WITH {C.LINKS} SELECT link_id, 'confirmed' AS signal, 'resolved to ' || target_id AS reason FROM cur WHERE is_current AND k % 2 = 0")
def r9_confirmed(spark, sf):
    cur, _ = C.links(spark, sf)
    resolved = cur.selectExpr("source_id AS source_entity_id", "target_id", "CASE WHEN CAST(substring(link_id, 2) AS bigint) % 2 = 0 THEN 'resolve' ELSE 'escalate' END AS decision")
    return feedback.confirmed(resolved, cur, F.lit("2024-03-01").cast("timestamp")).select("link_id", "signal", "reason")


@query("WITH f AS (SELECT 'V' || (user_id % 5) AS vendor, value > 30 AS fp FROM events WHERE ts > TIMESTAMP '2024-01-13 00:00:00') SELECT vendor, count(*) AS flags, count(*) FILTER (fp) AS false_positives FROM f GROUP BY 1")
def a11_recent_week(spark, sf):
    flags = C.table(spark, sf, "events").selectExpr("concat('V', user_id % 5) AS vendor", "CASE WHEN value > 30 THEN 'false_positive' ELSE 'approved' END AS human_decision", "ts AS created_at")
    return feedback.vendor_false_positives(feedback.recent(flags, F.lit("2024-01-20 09:00:00").cast("timestamp"))).select("vendor", "flags", "false_positives")


@query("""WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS n FROM lineitem), p AS (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
    SELECT a.l_orderkey AS txn_id, l_partkey, l_suppkey FROM a LEFT JOIN p USING (l_orderkey) WHERE n > coalesce(c, 0)""")
def u3_left_over(spark, sf):
    """Rows with repeated ids: of each id as many go as have been paired."""
    l = C.table(spark, sf, "lineitem")
    pairs = l.where("l_linenumber = 1").select(F.col("l_orderkey").alias("source_1_id"))
    return reconcile.left_over(l.select(F.col("l_orderkey").alias("txn_id"), "l_partkey", "l_suppkey"), pairs, "source_1_id")


@query(f"WITH {C.LINKS} SELECT DISTINCT 'T' || o_orderkey AS txn_id FROM orders WHERE o_orderstatus = 'F'")
def s9_unmatched_ids(spark, sf):
    u = C.table(spark, sf, "orders").selectExpr("concat('T', o_orderkey) AS entity_id", "CASE WHEN o_orderstatus = 'F' THEN 'transaction' ELSE 'email' END AS entity_type")
    return readers.unmatched_ids(u)


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_audit FROM events WHERE event_type = 'purchase'")
def s19_last_audit(spark, sf):
    runs = C.table(spark, sf, "events").selectExpr("CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS workflow_status", "ts AS created_at")
    return readers.last_audit(runs).select(F.date_format("last_audit", "yyyy-MM-dd HH:mm:ss").alias("last_audit"))


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ts)) <= 24 * 3600 AS is_fresh FROM events WHERE event_type = 'click'")
def f13_is_fresh(spark, sf):
    runs = C.table(spark, sf, "events").selectExpr("CASE event_type WHEN 'click' THEN 'success' ELSE 'failed' END AS status", "ts AS start_time")
    return readers.is_fresh(runs, F.lit("2024-02-01 00:00:00").cast("timestamp")).select(F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"), "is_fresh")


@query("SELECT l_orderkey AS run_id, 'link' AS operation, l_linenumber::bigint AS id, l_orderkey % 2 = 0 AS committed FROM lineitem WHERE l_orderkey IN (SELECT min(l_orderkey) FROM lineitem)")
def s22_intents(spark, sf):
    """The plan of one run; runs of even number have left their commit marker."""
    l = C.table(spark, sf, "lineitem")
    planned = l.selectExpr("CAST(l_orderkey AS string) AS run_id", "'link' AS operation", "CAST(l_linenumber AS bigint) AS id", "false AS committed")
    marks = l.where("l_orderkey % 2 = 0").selectExpr("CAST(l_orderkey AS string) AS run_id", "'commit' AS operation", "CAST(NULL AS bigint) AS id", "true AS committed").distinct()
    run = str(l.agg(F.min("l_orderkey")).first()[0])
    return control.intents(planned.unionByName(marks), run).select(F.col("run_id").cast("bigint").alias("run_id"), "operation", "id", "committed")


@query("SELECT 'E' || event_id AS entity_id, CASE WHEN event_type = 'click' THEN 'new' ELSE 'old' END AS reason_code FROM events")
def k7_put_unmatched(spark, sf):
    rows = C.table(spark, sf, "events").selectExpr("concat('E', event_id) AS entity_id", "event_type AS entity_type", "'email' AS target_type", "'old' AS reason_code")
    return control.put_unmatched(rows, rows.where("entity_type = 'click'").withColumn("reason_code", F.lit("new"))).select("entity_id", "reason_code")


@query("WITH o AS (SELECT 'C' || o_custkey AS s, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT DISTINCT 'C' || o_custkey AS s FROM orders WHERE o_orderstatus <> 'F') SELECT s AS source_entity_id, 'pending' AS status FROM o UNION ALL SELECT s, 'resolved' FROM n WHERE s NOT IN (SELECT s FROM o)")
def k9_add_ambiguous(spark, sf):
    rows = C.table(spark, sf, "orders").selectExpr("concat('C', o_custkey) AS source_entity_id", "'email' AS target_type", "CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE 'resolved' END AS status")
    old = rows.where("status = 'pending'").dropDuplicates(control.AMBIGUOUS_KEY)
    return control.add_ambiguous(old, rows.where("status = 'resolved'")).select("source_entity_id", "status")


@query("SELECT event_type AS entity_type, CASE WHEN event_type IN ('click', 'view') THEN '2024-03-01' ELSE strftime(max(ts), '%Y-%m-%d') END AS day, CASE WHEN event_type IN ('click', 'view') THEN 'run' ELSE 'before' END AS last_run_id FROM events GROUP BY 1 UNION SELECT x, '2024-03-01', 'run' FROM (VALUES ('click'), ('view')) v(x)")
def k12_watermarks(spark, sf):
    marks = C.table(spark, sf, "events").groupBy(F.col("event_type").alias("entity_type")).agg(F.max("ts").cast("timestamp").alias("last_ingested_at")).withColumn("last_run_id", F.lit("before"))
    return incremental.advanced(marks, ["click", "view"], "run", F.lit("2024-03-01").cast("timestamp")).select("entity_type", F.date_format("last_ingested_at", "yyyy-MM-dd").alias("day"), "last_run_id")


@query("SELECT strftime(max(ts), '%Y-%m-%d') AS after_a_run, strftime(DATE '2024-03-01' - 90, '%Y-%m-%d') AS at_first FROM events WHERE event_type = 'purchase'")
def f8_start_date(spark, sf):
    marks = C.table(spark, sf, "events").selectExpr("CASE event_type WHEN 'purchase' THEN 'transaction' ELSE 'email' END AS entity_type", "CAST(ts AS timestamp) AS last_ingested_at")
    at = F.lit("2024-03-01").cast("timestamp")
    first = incremental.start_date(marks.where("false"), at).select(F.date_format("start_date", "yyyy-MM-dd").alias("at_first"))
    return incremental.start_date(marks, at).select(F.date_format("start_date", "yyyy-MM-dd").alias("after_a_run")).crossJoin(first)


@query(f"WITH {C.LINKS} SELECT link_id, source_id FROM cur WHERE k = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 1)")
def s20_point(spark, sf):
    cur, _ = C.links(spark, sf)
    k = C.table(spark, sf, "orders").where("o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 1").agg(F.min("o_orderkey")).first()[0]
    return readers.point(cur, source_id=f"S{k}", is_current=True).select("link_id", "source_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at, CASE event_type WHEN 'click' THEN round(0.0001 * event_id, 4) WHEN 'view' THEN round(0.0005 * event_id, 4) ELSE 0 END::double AS cost FROM events")
def c15_c21_times_and_costs(spark, sf):
    e = C.table(spark, sf, "events")
    at = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", T.with_midnight(at).alias("at"), T.token_cost(F.col("event_type"), F.col("event_id"), {"click": 0.0001, "view": 0.0005}).cast("double").alias("cost"))


@query("""WITH d AS (SELECT o_orderpriority AS p, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS tp, count(*) FILTER (o_orderkey % 3 = 0) AS f, count(*) FILTER (o_orderkey % 2 = 0) AS t FROM orders GROUP BY 1), s AS (SELECT tp / f::double AS p, tp / t::double AS r, 2 * tp / (f + t)::double AS f1 FROM d)
    SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1, count(*) FILTER (f1 >= 0.8) AS passed, count(*) AS datasets FROM s""")
def a7_macro_average(spark, sf):
    o = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn_id"), "o_orderpriority")
    each = metrics.confusion_by(o.where("txn_id % 3 = 0"), o.where("txn_id % 2 = 0"), o, "o_orderpriority")
    return metrics.macro_average(each).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "passed", "datasets")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def streaming_incremental(spark, sf):
    """All events taken once through a stream with a checkpoint; the batches' counts by type."""
    at = f"{shared_folder(spark)}/tallyloom-stream-{spark.sql('SELECT uuid()').first()[0]}"
    schema = C.table(spark, sf, "events").schema
    incremental.take_new(spark, sf, schema, lambda batch, _: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{at}/out"), f"{at}/state", glob="events.parquet").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.sum("n").alias("n"))
