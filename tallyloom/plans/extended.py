"""More queries over the driver's tables: orders over all rows, streams, merges of buckets, lineage and what the contract
specifies without doing it, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import archive, datagen, feedback, forecast, lineage, matching, merge, metrics, ordered, sketches, vectors
from tallyloom.plans import canonical as C
from tallyloom.plans.queries import query
from tallyloom.session import cut, delete, shared_folder
from tallyloom.sources.buckets import Bucketed
from tallyloom.streaming import feedback_stream, incremental


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tallyloom-{name}-{spark.sql('SELECT uuid()').first()[0]}"


# --------------------------------------------------------------------------------------------- order over all rows


@query("""WITH r AS (SELECT event_id, value, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, count(*) OVER () AS n FROM events)
    SELECT event_id, round(CASE WHEN n >= 3 THEN m END, 6) AS rolling_mean, coalesce(n >= 3 AND CASE WHEN m <> 0 THEN abs(value - m) / abs(m) * 100 > 20 ELSE value <> 0 END, false) AS is_deviation FROM r""")
def w1_rolling_deviation_global(spark, sf):
    """The contract's own form: one order over all rows."""
    e = C.table(spark, sf, "events").select("event_id", "ts", "value")
    return ordered.rolling_deviation(e, ["ts", "event_id"], "value").select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"), "is_deviation")


@query("""WITH u AS (SELECT user_id, ts, 0 AS side, event_id, value, true AS mine FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, ts, -1, event_id, value, false FROM events WHERE event_type = 'click'),
    f AS (SELECT *, last_value(CASE WHEN NOT mine THEN event_id END IGNORE NULLS) OVER w AS last_event_id, last_value(CASE WHEN NOT mine THEN value END IGNORE NULLS) OVER w AS last_value FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, last_event_id, round(last_value, 6) AS last_value FROM f WHERE mine""")
def as_of_clicks(spark, sf):
    """Of every purchase the user's last click at or before it."""
    e = C.table(spark, sf, "events").select("user_id", "ts", "event_id", "value", "event_type")
    out = ordered.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", "ts", "event_id", ["event_id", "value"])
    return out.select("event_id", "last_event_id", F.round("last_value", 6).alias("last_value"))


@query("""WITH d AS (SELECT user_id, ts, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), p AS (SELECT user_id, ts, lag(ts) OVER w AS before, lag(v) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT event_id, round((epoch_us(e.ts) - epoch_us(before)) / 86400000000.0, 6) AS days_since, round(CASE WHEN b <> 0 THEN (value - b) / abs(b) END, 6) AS amount_change FROM events e JOIN p USING (user_id, ts)""")
def vendor_recency(spark, sf):
    e = C.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return ordered.recency(e, "user_id", "ts", "event_id", "value").select("event_id", F.round("days_since", 6).alias("days_since"), F.round("amount_change", 6).alias("amount_change"))


@query("""WITH RECURSIVE d AS (SELECT 'U' || user_id AS vendor, CAST(ts AS date) AS day, sum(value) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
    s AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY day) AS k, day - lag(day) OVER (PARTITION BY vendor ORDER BY day) AS gap FROM d),
    f AS (SELECT vendor, k, x AS level, 0.0::double AS sq FROM s WHERE k = 1 UNION ALL SELECT s.vendor, s.k, f.level + 0.5 * (s.x - f.level), f.sq + (s.x - f.level) * (s.x - f.level) FROM f JOIN s ON s.vendor = f.vendor AND s.k = f.k + 1),
    g AS (SELECT vendor, count(*) AS days, max(day) AS last, quantile_cont(gap, 0.5) AS gap FROM s GROUP BY vendor),
    o AS (SELECT g.*, f.level, 1.2815515655446004 * sqrt(f.sq / (g.days - 1)) AS spread, last + CAST(ceil(g.gap) AS int) AS next FROM g JOIN f ON f.vendor = g.vendor AND f.k = g.days WHERE g.days >= 3)
    SELECT vendor, days, round(level + 1e-9, 4) AS forecast, round(level - spread + 1e-9, 4) AS low, round(level + spread + 1e-9, 4) AS high, strftime(next, '%Y-%m-%d') AS next_day, (SELECT max(day) FROM d) - next > 5 AS is_late FROM o""")
def recurring_forecast(spark, sf):
    one, _ = C.event_sides(spark, sf)
    out = forecast.recurring(one)
    return out.select("vendor", "days", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("forecast", "low", "high")), F.date_format("next_day", "yyyy-MM-dd").alias("next_day"), "is_late")


# -------------------------------------------------------------------------------------------------------- streams


def _streamed(spark: SparkSession, sf: str, work, name: str, rows: DataFrame | None = None, at: str = "ts") -> DataFrame:
    """What ``work(stream)`` has put out after all rows, in several files, and one row ten years later, which closes all windows."""
    table = C.table(spark, sf, "events") if rows is None else rows
    table = table.withColumn(at, F.col(at).cast("timestamp"))
    folder = _folder(spark, name)
    table.repartitionByRange(max(4, spark.sparkContext.defaultParallelism), at, F.xxhash64(*table.columns)).write.parquet(f"{folder}/in")  # rows of one time go to several files too
    files = len(spark.read.schema(table.schema).parquet(f"{folder}/in").inputFiles())
    end = table.agg((F.max(at) + F.expr("INTERVAL 10 YEARS")).cast(table.schema[at].dataType).alias(at))
    end.select(*(F.col(at) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema)).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", (files + 1) // 2).parquet(f"{folder}/in")
    out = work(stream)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    delete(spark, f"{folder}/state")
    delete(spark, f"{folder}/in")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_windows(spark, sf):
    """Daily windows of a stream with a watermark."""
    out = _streamed(spark, sf, lambda s: incremental.windowed_counts(s, "ts", "1 day", "60 days", ["event_type"], "value"), "windows")
    return out.where("event_type IS NOT NULL").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def st_sessions(spark, sf):
    """Sessions of a user: events at most twelve hours apart."""
    out = _streamed(spark, sf, lambda s: incremental.sessions(s, "ts", "12 hours", "60 days", "user_id"), "sessions")
    return out.where("user_id IS NOT NULL").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_first_seen(spark, sf):
    out = _streamed(spark, sf, lambda s: incremental.first_seen(s, "ts", "60 days", ["user_id", "event_type"]), "first-seen")
    return out.where("user_id IS NOT NULL").select("user_id", "event_type")


@query(f"WITH {C.LINKS} SELECT 'L' || k AS link_id, source_id AS entity_id FROM cur WHERE is_current AND k % 6 = 2")
def st_feedback(spark, sf):
    """The links that feedback closes, from a stateful stream: as the batch form's."""
    cur, _ = C.links(spark, sf)
    notes = cur.selectExpr("link_id", "CASE WHEN CAST(substring(link_id, 2) AS bigint) % 6 = 2 THEN 'rejected' ELSE 'confirmed' END AS signal", "created_at + INTERVAL 1 HOUR AS created_at")
    out = _streamed(spark, sf, feedback_stream.actions, "feedback", feedback_stream.events(cur, notes), "at")
    return out.where("action = 'closed'").select("link_id", "entity_id")


# -------------------------------------------------------------------------------------- merges, lineage, archive


@query(f"WITH {C.LINKS} SELECT source_id, link_id FROM pro WHERE k % 50 = 0 UNION ALL SELECT source_id, link_id FROM cur WHERE source_id NOT IN (SELECT source_id FROM pro WHERE k % 50 = 0)")
def k1_bucket_merge(spark, sf):
    """An upsert that rewrites only the buckets of its keys; the feature is that few rows change."""
    cur, pro = C.links(spark, sf)
    table = Bucketed(spark, _folder(spark, "links"), ["source_id"], 16)
    table.create(cur)
    table.merge(pro.where("CAST(substring(link_id, 2) AS bigint) % 50 = 0"), lambda old, new: merge.upsert(old, new, ["source_id"], preserve=("created_at",)))
    return table.read().select("source_id", "link_id")


@query("""WITH RECURSIVE v AS (SELECT o_custkey, o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders), up AS (SELECT id, id AS reached, next, 0 AS d FROM v UNION ALL SELECT up.id, v.id, v.next, d + 1 FROM up JOIN v ON up.next = v.id)
    SELECT 'L' || id AS link_id, 'L' || arg_max(reached, d) AS newest_id, max(d)::bigint AS distance, false AS in_cycle FROM up GROUP BY id""")
def r12_newest_versions(spark, sf):
    """A customer's orders as versions, each superseded by the next one."""
    from pyspark.sql import Window

    o = C.table(spark, sf, "orders")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    links = o.select(F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("link_id"), F.concat(F.lit("L"), following.cast("string")).alias("superseded_by"))
    return lineage.newest(links)


def _archive_sql(levels: int = 6) -> str:
    entry = " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("event_id", "event_type", "user_id"))
    steps = [f"l0 AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, sha256({entry}) AS digest FROM events)"]
    for k in range(levels):
        steps.append(f"l{k + 1} AS (SELECT pos // 16 AS pos, CASE WHEN (SELECT count(*) FROM l{k}) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM l{k} GROUP BY pos // 16)")
    return "WITH " + ", ".join(steps) + f" SELECT digest AS root, (SELECT count(*) FROM events) AS entries FROM l{levels}"


@query(_archive_sql())
def k16_archive_root(spark, sf):
    """The root of the hash tree over a log (here: the events), and how many entries it seals."""
    log = C.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    nodes = archive.nodes(archive.sealed(log, ["event_id"]))
    top = nodes.agg(F.max("level").alias("level"), F.count_if(F.col("level") == 0).alias("entries"))
    return nodes.join(F.broadcast(top), "level").select(F.col("digest").alias("root"), "entries")  # one row


# --------------------------------------------------------------------------------------------- vectors, sketches


@query(r"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, unnest(list_transform(range(1, length(name) + 1), lambda i: substr(' ' || lower(trim(name)) || ' ', i, 3))) AS g FROM n),
    c AS (SELECT name, g, count(*)::double AS n FROM g GROUP BY 1, 2), v AS (SELECT name, g, n / sqrt(sum(n * n) OVER (PARTITION BY name)) AS w FROM c)
    SELECT a.name AS a, b.name AS b, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.g = b.g AND a.name < b.name GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.6 - 1e-9""")
def alike_names(spark, sf):
    """Part names whose letter-group vectors are alike; with so few groups no two of them share a component by chance."""
    return vectors.alike(C.table(spark, sf, "part"), "p_name", 0.6, 1 << 31).withColumn("cosine", F.round("cosine", 6))


@query()
def a13_latency_sketch(spark, sf):
    """Quantiles of the time from order to shipping, from one sketch a day."""
    o, l = C.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), C.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return sketches.merged_latency(sketches.daily_latency(rows, F.to_date("o_orderdate"), seconds))


@query()
def a16_coverage_sketch(spark, sf):
    """Distinct users of all days, and those with a purchase, from one sketch a day."""
    e = C.table(spark, sf, "events")
    return sketches.merged_coverage(sketches.daily_coverage(e, F.to_date("ts"), F.col("user_id"), F.col("event_type") == "purchase"))


@query(f"""WITH {C.LINKS} SELECT CASE WHEN k % 20 < 6 THEN 'high' WHEN k % 20 < 11 THEN 'medium' WHEN k % 20 < 14 THEN 'ambiguous' ELSE 'none' END AS band, count(*) AS n FROM cur GROUP BY 1""")
def a14_confidence_bands(spark, sf):
    """Links by confidence band; their confidence here follows from their number, 1 - (k % 20) / 2 hundredths at a time."""
    cur, _ = C.links(spark, sf)
    k = F.col("link_id").substr(F.lit(2), F.lit(20)).cast("bigint") % 20
    confidence = F.when(k < 6, 0.95).when(k < 11, 0.7).when(k < 14, 0.5).otherwise(0.3)
    return cur.select(metrics.confidence_band(confidence).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------- matching and decisions over given tables


_STATEMENTS = ("WHOLEFDS MKT #0523", "STARBUCKS STORE 12345", "DELTA AIR LINES 006", "UBER * TRIP", "MARRIOTT SF DOWNTOWN", "AWS EMEA LLC", "TRADER JOE S #127", "Amazon.com*12345", "Uber Technologies, Inc.", "SQ *WFM #0523")
_MERCHANTS = ("whole foods market", "starbucks", "delta", "uber", "marriott", "amazon web services", "trader joes", "amazon com 12345", "uber technologies", "sq whole foods")


@query(f"SELECT p_partkey, ({list(_MERCHANTS)})[1 + p_partkey % {len(_MERCHANTS)}] AS merchant FROM part")
def c2_expansion(spark, sf):
    """Statement names of known merchants, one on every part, in their normal form."""
    name = F.element_at(F.array(*map(F.lit, _STATEMENTS)), (1 + F.col("p_partkey") % len(_STATEMENTS)).cast("int"))
    return C.table(spark, sf, "part").select("p_partkey", T.merchant(name).alias("merchant"))


_SIDES = """t AS (SELECT 't' || o_orderkey AS id, o_orderkey AS pos, 'name ' || o_custkey AS name, CAST(o_orderdate AS date) AS day FROM orders),
    m AS (SELECT 'm' || o_orderkey AS id, o_orderkey AS pos, 'name ' || o_custkey AS name, CAST(o_orderdate AS date) + CAST(o_orderkey % 2 AS int) AS day FROM orders WHERE o_orderkey % 3 > 0),
    c AS (SELECT 'c' || o_orderkey AS id, o_orderkey AS pos, 'name ' || o_custkey AS name, CAST(o_orderdate AS date) + CAST(o_orderkey % 2 AS int) AS day FROM orders WHERE o_orderkey % 5 < 2)"""
_FIRST = "SELECT a.id, arg_min(b.id, (b.pos, b.id)) AS other FROM {a} a JOIN {b} b USING (name, day) GROUP BY a.id"
_MATCHED = f"""WITH {_SIDES}, te AS ({_FIRST.format(a="t", b="m")}), tc AS ({_FIRST.format(a="t", b="c")}), free AS (SELECT * FROM m WHERE id NOT IN (SELECT other FROM te)), ec AS ({_FIRST.format(a="free", b="c")})"""


def _three_kinds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as transactions, most of them as emails and some as events, on their day or a day later."""
    o = C.table(spark, sf, "orders").selectExpr("o_orderkey AS pos", "concat('name ', o_custkey) AS name", "CAST(o_orderdate AS date) AS day")
    later = o.withColumn("day", F.expr("date_add(day, CAST(pos % 2 AS int))"))
    return (
        o.selectExpr("pos", "concat('t', pos) AS transaction_id", "name AS merchant_name", "CAST(NULL AS string) AS name", "day AS date"),
        later.where("pos % 3 > 0").selectExpr("pos", "concat('m', pos) AS message_id", "name AS subject", "CAST(day AS timestamp) AS received_at"),
        later.where("pos % 5 < 2").selectExpr("pos", "concat('c', pos) AS event_id", "name AS subject", "CAST(day AS timestamp) AS start_time"),
    )


def _all_pairs(spark: SparkSession, sf: str) -> matching.Matches:
    """All three passes with rules that leave the fuzzy tier nothing but equal names of other days out of its window."""
    from dataclasses import replace

    from tallyloom.config import RULES

    strict = {k: replace(r, fuzzy=replace(r.fuzzy, date_window_days=0, min_similarity_score=1.0)) for k, r in RULES.items()}
    return matching.match_all(*_three_kinds(spark, sf), rules=strict, scorer="edit")


@query(f"{_MATCHED} SELECT 'email' AS target_type, id AS source_id, other AS target_id FROM te UNION ALL SELECT 'calendar_event', id, other FROM tc UNION ALL SELECT 'calendar_event', id, other FROM ec")
def j6_all_pairs(spark, sf):
    return _all_pairs(spark, sf).links.select("target_type", "source_id", "target_id")


@query(f"""{_MATCHED} SELECT id AS entity_id, 'email' AS target_type FROM t WHERE id NOT IN (SELECT id FROM te) UNION ALL SELECT id, 'calendar_event' FROM t WHERE id NOT IN (SELECT id FROM tc)
    UNION ALL SELECT id, 'transaction' FROM free WHERE id NOT IN (SELECT id FROM ec)""")
def j7_unmatched(spark, sf):
    return _all_pairs(spark, sf).unmatched.select("entity_id", "target_type")


@query("""WITH d AS (SELECT o_orderkey, (['approved', 'rejected', 'false_positive', 'needs_more_info', 'other'])[1 + o_orderkey % 5] AS d FROM orders)
    SELECT o_orderkey, CASE d WHEN 'approved' THEN 'confirmed' WHEN 'rejected' THEN 'rejected' WHEN 'false_positive' THEN 'rejected' WHEN 'needs_more_info' THEN 'flagged' END AS signal FROM d""")
def r8_decisions(spark, sf):
    """The signal of a decision on every order."""
    d = F.expr("element_at(array('approved', 'rejected', 'false_positive', 'needs_more_info', 'other'), cast(1 + o_orderkey % 5 AS int))")
    return C.table(spark, sf, "orders").select("o_orderkey", feedback.signal_of(d).alias("signal"))


_ROLES = "CASE WHEN c_custkey % 10 < 3 THEN 'same day' WHEN c_custkey % 10 < 6 THEN 'later' WHEN c_custkey % 10 < 8 THEN 'two' ELSE 'lone' END"


@query(f"SELECT {_ROLES} AS planned, CASE {_ROLES} WHEN 'same day' THEN 'tier2_composite' WHEN 'later' THEN 'tier3_fuzzy' WHEN 'two' THEN 'ambiguous' ELSE 'unmatched' END AS outcome, count(*) AS n FROM customer GROUP BY 1, 2")
def g4_scenario(spark, sf):
    """A made-up business of as many customers as there are: each case ends as it was planned."""
    from tallyloom.config import RULES

    planned = C.table(spark, sf, "customer").selectExpr("c_custkey AS pos", f"{_ROLES} AS planned")
    txns, emails = map(cut, datagen.business(planned))
    rule = RULES["transaction", "email"]
    fields = tuple(dict.fromkeys(rule.fuzzy.field_map.get(f, f) for f in rule.fuzzy.fields))
    m = matching.cascade(matching.prepare(txns, "transaction", rule.fuzzy.fields, "transaction_id"), matching.prepare(emails, "email", fields, "message_id"), rule, scorer="edit")
    outcome = m.links.select("source_id", F.col("match_tier").alias("outcome")).unionByName(m.ambiguous.select(F.col("source_entity_id").alias("source_id"), F.lit("ambiguous").alias("outcome"))).unionByName(m.unmatched.select(F.col("entity_id").alias("source_id"), F.lit("unmatched").alias("outcome")))
    return outcome.join(planned.withColumn("source_id", F.concat(F.lit("t"), F.col("pos").cast("string"))), "source_id").groupBy("planned", "outcome").agg(F.count("*").alias("n"))
