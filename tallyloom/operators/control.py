"""Control tables: audit trail, workflow state, consents, retention, intents, and the lookups over them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tallyloom.config import AUDIT_RETENTION_DAYS
from tallyloom.operators import merge
from tallyloom.schemas import AUDIT_TRAIL, WORKFLOW_STATE

# The columns of an audit-trail entry that hold JSON, and how many rows the lists of findings show.
PAYLOADS = ("input_data", "output_summary", "decision_chain")
LISTED = {"matched_pairs": 100, "unmatched": 50, "orphans": 50, "duplicate_groups": 10, "duplicate_ids": 5, "isolation": 100, "outliers": 50, "deviations": 20, "scored": 100, "evidence": 5, "enrichment": 20}
#: Keys of unmatched entities and of ambiguous matches.
UNMATCHED_KEY, AMBIGUOUS_KEY = ["entity_id", "entity_type", "target_type"], ["source_entity_id", "target_type"]


def trail_entries(entries: DataFrame) -> DataFrame:
    """Rows for the audit trail: structs, arrays and maps of the payload columns as JSON, absent columns null.

    ``log_sequence_number`` is the caller's: it orders the entries of a run.
    """

    def column(name: str) -> Column:
        if name not in entries.columns:
            return F.lit(None)
        c = F.col(name)
        return F.when(c.isNotNull(), F.to_json(c)) if name in PAYLOADS and isinstance(entries.schema[name].dataType, StructType | ArrayType | MapType) else c

    return entries.select(*(column(f.name).cast(f.dataType).alias(f.name) for f in AUDIT_TRAIL.fields))


def trail_of(trail: DataFrame, run_id: str) -> DataFrame:
    """Entries of one run in order."""
    return trail.where(F.col("audit_run_id") == run_id).orderBy("log_sequence_number")


def workflow_upsert(states: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """The states with those of ``new`` in place of older ones of the same run; absent columns get their defaults."""
    defaults = {"workflow_status": F.lit("in_progress"), "completed_agents": F.array().cast("array<string>"), "pending_agents": F.array().cast("array<string>"), "intermediate_results": F.lit("{}"), "created_at": at, "updated_at": at}
    rows = new.select(*((F.coalesce(F.col(f.name).cast(f.dataType), defaults[f.name]) if f.name in new.columns and f.name in defaults else F.col(f.name) if f.name in new.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in WORKFLOW_STATE.fields))
    return merge.upsert(states, rows, ["audit_run_id"])


def workflow_of(states: DataFrame, run_id: str) -> DataFrame:
    """The latest state of a run: one row or none."""
    return states.where(F.col("audit_run_id") == run_id).orderBy(F.desc("updated_at")).limit(1)


def latest_by(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key, of old and new together the latest: consents by user and type, preferences by user and name.

    Of rows of one time the new one wins.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "__new"]
    chosen = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "__new")).alias("__r"))
    return chosen.select(*(F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in old.columns))


def expired_logs(tables: dict[str, DataFrame], now: Column, intent_days: int = 30, audit_days: int = AUDIT_RETENTION_DAYS) -> dict[str, DataFrame]:
    """What stays of the logs: intents for ``intent_days``, access and deletion logs for ``audit_days``.

    A purge of its own: the pipeline's retention never touches these tables.
    """
    ages = {"intent_log": ("created_at", intent_days), "access_audit_log": ("at", audit_days), "deletion_audit": ("deleted_at", audit_days)}
    return {name: merge.purge(df, ages[name][0], F.timestamp_add("DAY", F.lit(-ages[name][1]), now)) for name, df in tables.items() if name in ages}


def intents(log: DataFrame, run_id: str) -> DataFrame:
    """The planned operations of a run by id; ``committed`` is true once the run has left its commit marker."""
    own = log.where(F.col("run_id") == run_id)
    marked = F.broadcast(own.where("operation = 'commit'").agg((F.count("*") > 0).alias("__done")))  # one row
    return own.where("operation <> 'commit'").crossJoin(marked).withColumn("committed", F.coalesce("committed", F.lit(False)) | F.col("__done")).drop("__done").orderBy("id")


def put_unmatched(unmatched: DataFrame, rows: DataFrame) -> DataFrame:
    """Unmatched entities with ``rows`` in place of older ones of their key."""
    return merge.upsert(unmatched, rows.dropDuplicates(UNMATCHED_KEY), UNMATCHED_KEY)


def add_ambiguous(ambiguous: DataFrame, rows: DataFrame) -> DataFrame:
    """Ambiguous matches with those of ``rows`` whose source and target type are new."""
    return merge.insert_absent(ambiguous, rows, AMBIGUOUS_KEY)


def waiting(unmatched: DataFrame, entity_type: str, target_type: str | None = None) -> DataFrame:
    """Unmatched entities of a type, on demand towards one target type."""
    rows = unmatched.where(F.col("entity_type") == entity_type)
    return rows if target_type is None else rows.where(F.col("target_type") == target_type)


def ambiguous_by(ambiguous: DataFrame, status: str = "pending") -> DataFrame:
    return ambiguous.where(F.col("status") == status)


def unprocessed(feedback: DataFrame) -> DataFrame:
    return feedback.where(~F.coalesce("processed", F.lit(False)))


def links_of(links: DataFrame, sources: DataFrame, ident: str = "source_id") -> DataFrame:
    """Current links of the given sources."""
    return links.where("is_current").join(sources.select(F.col(ident).alias("source_id")), "source_id", "left_semi").select(*links.columns)


def enriched(suspicious: DataFrame, enrichment: DataFrame, order: list[Column], most: int | None = LISTED["enrichment"]) -> DataFrame:
    """Suspicious transactions with their enrichment (nulls where there is none), looked up for the first ``most`` alone.

    ``order`` ranks them and ends with the id, so that the choice is the same in every run; no limit with None.
    """
    first = suspicious if most is None else suspicious.orderBy(*order).limit(most)
    found = enrichment.join(first.select("txn_id"), "txn_id", "left_semi").dropDuplicates(["txn_id"])
    return suspicious.join(found, "txn_id", "left")


def listed(findings: DataFrame, kind: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """The first findings of a kind, as many as its list shows or ``limit``; ``order`` is total.

    Operators return all findings; only a report is cut.
    """
    return findings.orderBy(*order).limit(LISTED[kind] if limit is None else limit)


def resolved(spark: SparkSession, name: str, given: DataFrame | None = None, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """An operator's input: the frame that was passed, else the registered view of that name, else what ``load`` gives."""
    if given is not None:
        return given
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if load is None:
        raise LookupError(f"no frame, view or table {name!r}")
    return load(name)


class MemoryStates:
    """Run states in the driver, gone after ``ttl`` seconds."""

    def __init__(self, ttl: float = 86_400.0, clock: Callable[[], float] = time.time) -> None:
        self.ttl, self.clock, self.held = ttl, clock, {}

    def put(self, run_id: str, state: dict) -> None:
        self.held[run_id] = (self.clock() + self.ttl, state)

    def get(self, run_id: str) -> dict | None:
        until, state = self.held.get(run_id, (0.0, None))
        if state is not None and until <= self.clock():
            del self.held[run_id]
            return None
        return state


class StoredStates:
    """Run states in the store's ``workflow_state`` table."""

    def __init__(self, store) -> None:
        self.store = store

    def put(self, run_id: str, state: dict) -> None:
        row = self.store.spark.createDataFrame([(run_id, *(state.get(f.name) for f in WORKFLOW_STATE.fields[1:6]))], StructType(WORKFLOW_STATE.fields[:6]))
        self.store.replace("workflow_state", workflow_upsert(self.store.read("workflow_state"), row, F.current_timestamp()))

    def get(self, run_id: str) -> dict | None:
        row = workflow_of(self.store.read("workflow_state"), run_id).first()
        return None if row is None else {f.name: row[f.name] for f in WORKFLOW_STATE.fields[1:6]}
