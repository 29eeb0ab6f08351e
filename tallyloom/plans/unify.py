"""A unification run: raw records to silver, matching, and the merge into the link history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import RETENTION_DAYS
from tallyloom.functions import text as T
from tallyloom.operators import etl, feedback, matching, merge
from tallyloom.sources.store import Store
from tallyloom.streaming.incremental import advanced

_TABLE = {"transaction": "transactions", "email": "emails", "calendar_event": "calendar_events"}
_KEY = {"transaction": "transaction_id", "email": "message_id", "calendar_event": "event_id"}
_AGE = {"entity_links": "created_at", "unmatched_entities": "created_at", "ambiguous_matches": "created_at", "run_log": "start_time", "link_feedback": "created_at"}


def run(store: Store, raw: dict[str, DataFrame], run_type: str = "incremental", run_id: str | None = None, scorer: str = "weighted") -> str:
    """One run over raw transactions, emails and calendar_events; returns the run's id, or "skipped" if one is going on."""
    run_id, spark = run_id or uuid.uuid4().hex, store.spark
    if not store.acquire("pipeline", run_id):
        return "skipped"
    now, started = F.current_timestamp(), spark.sql("SELECT current_timestamp() AS t").first()["t"]
    try:
        store.append("run_log", spark.createDataFrame([(run_id, run_type, "in_progress", started)], "run_id string, run_type string, status string, start_time timestamp"))
        store.replace_all({t: merge.purge(store.read(t), c, F.timestamp_add("DAY", F.lit(-RETENTION_DAYS[t]), now)) for t, c in _AGE.items()})
        done = feedback.process(store.read("entity_links"), store.read("unmatched_entities"), store.read("link_feedback"), F.lit(started), run_id)
        store.replace_all({"entity_links": done.links, "unmatched_entities": done.unmatched, "link_feedback": done.feedback})

        marks = {r["entity_type"]: r["last_ingested_at"] for r in store.read("watermarks").collect()} if run_type == "incremental" else {}
        silver = {k: etl.accepted(etl.transform(raw[_TABLE[k]], k, "batch", F.lit(started))) for k in _TABLE}
        store.replace_all({_TABLE[k]: etl.upsert_latest(store.read(_TABLE[k]), d, _KEY[k]) for k, d in silver.items()})
        fresh = {k: etl.newer_than(d, F.lit(marks[k]) if marks.get(k) else None) for k, d in silver.items()}
        ready = {k: d.withColumn("pos", F.xxhash64(_KEY[k])) if "pos" not in raw[_TABLE[k]].columns else d.join(raw[_TABLE[k]].select(_KEY[k], "pos"), _KEY[k]) for k, d in fresh.items()}
        found = matching.match_all(ready["transaction"], ready["email"], ready["calendar_event"], run_id, scorer=scorer)

        links = found.links.withColumns({"created_at": F.lit(started), "effective_from": F.lit(started), "effective_to": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string"), "is_current": F.lit(True)})
        staged = {"entity_links": links, "unmatched_entities": found.unmatched.withColumn("created_at", F.lit(started)), "ambiguous_matches": found.ambiguous.withColumn("created_at", F.lit(started))}
        plan = links.select(F.lit(run_id).alias("run_id"), F.lit("link").alias("operation"), F.to_json(F.struct("source_id", "target_id", "match_tier")).alias("payload"), F.lit(False).alias("committed"), F.lit(started).alias("created_at"))
        store.append("intent_log", plan.withColumn("id", F.xxhash64("payload")))
        store.replace_all(
            {
                "entity_links": merge.scd2(store.read("entity_links"), _typed(store, "entity_links", staged["entity_links"])).drop("action"),
                "unmatched_entities": merge.insert_absent(store.read("unmatched_entities"), staged["unmatched_entities"], ["entity_id", "entity_type", "target_type"]),
                "ambiguous_matches": merge.insert_absent(store.read("ambiguous_matches"), staged["ambiguous_matches"], ["source_entity_id", "target_type"]),
                "watermarks": advanced(store.read("watermarks"), list(_TABLE), run_id, F.lit(started)),
            }
        )
        store.append("intent_log", spark.createDataFrame([(run_id, "commit", True)], "run_id string, operation string, committed boolean").withColumn("created_at", now))
        _finish(store, run_id, "success", None)
        return run_id
    except Exception as e:
        line = spark.createDataFrame([(type(e).__name__, str(e))], "k string, m string").select(T.redacted(F.col("k"), F.col("m"))).first()[0]
        _finish(store, run_id, "failed", line)
        raise
    finally:
        store.release("pipeline", run_id)


def _typed(store: Store, table: str, df: DataFrame) -> DataFrame:
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in store.read(table).schema.fields))


def _finish(store: Store, run_id: str, status: str, error: str | None) -> None:
    own = F.col("run_id") == run_id
    store.replace("run_log", store.read("run_log").withColumns({"status": F.when(own, F.lit(status)).otherwise(F.col("status")), "end_time": F.when(own, F.current_timestamp()).otherwise(F.col("end_time")), "error": F.when(own, F.lit(error)).otherwise(F.col("error"))}))
