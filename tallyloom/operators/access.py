"""Governed reads: consent, the query methods, and the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import ENTITY_ID
from tallyloom.functions import text as T
from tallyloom.operators import merge
from tallyloom.operators.feedback import feedback_row
from tallyloom.schemas import VALUES


class ConsentRequired(PermissionError):
    """The user has not consented, the consent has run out, or the user has opted out."""


def consents(df: DataFrame, preferences: DataFrame | None, at: Column) -> DataFrame:
    """(user_hash, allowed): the latest consent is granted and not expired, and the user has not opted out."""
    last = df.groupBy("user_hash").agg(F.max_by(F.struct("granted", "expires_at"), "granted_at").alias("c"))
    ok = F.col("c.granted") & (F.col("c.expires_at").isNull() | (F.col("c.expires_at") > at))
    out = last.select("user_hash", F.coalesce(ok, F.lit(False)).alias("allowed"))
    if preferences is None:
        return out
    latest = preferences.where("preference = 'opt_out'").groupBy("user_hash").agg((F.max_by("value", "updated_at") == "true").alias("out"))
    return out.join(latest, "user_hash", "left").select("user_hash", (F.col("allowed") & ~F.coalesce("out", F.lit(False))).alias("allowed"))


def other_end(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(entity_id, entity_type, other_id, other_type, link_id, match_tier, confidence): current links at either end.

    ``wanted``: (entity_id, entity_type). Two equi-joins instead of one with OR; a link from an entity to itself comes once.
    """
    live = links.where("is_current")
    rest = ["link_id", "match_tier", "confidence"]
    forward = live.select(F.col("source_id").alias("entity_id"), F.col("source_type").alias("entity_type"), F.col("target_id").alias("other_id"), F.col("target_type").alias("other_type"), *rest)
    back = live.where("NOT (source_id <=> target_id AND source_type <=> target_type)").select(F.col("target_id").alias("entity_id"), F.col("target_type").alias("entity_type"), F.col("source_id").alias("other_id"), F.col("source_type").alias("other_type"), *rest)
    return forward.unionByName(back).join(wanted.select("entity_id", "entity_type").distinct(), ["entity_id", "entity_type"], "left_semi")


def access_row(actor: str, method: str, entity: Column, at: Column) -> list[Column]:
    return [F.lit(actor).alias("actor"), F.lit(method).alias("method"), T.user_hash(entity, 12).alias("entity_hash"), at.alias("at")]


class Queries:
    """The governed methods over a store; every gated read checks consent first and leaves a row in the access log."""

    def __init__(self, store, actor: str, at: Column | None = None) -> None:
        self.store, self.actor, self.at = store, actor, at if at is not None else F.current_timestamp()

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def gate(self, user_hash: str) -> None:
        allowed = consents(self.store.read("user_consents"), self.store.read("user_preferences"), self.at).where((F.col("user_hash") == user_hash) & F.col("allowed"))
        if allowed.isEmpty():
            raise ConsentRequired(user_hash)

    def _logged(self, method: str, entity: str) -> None:
        self.store.append("access_audit_log", self.spark.range(1).select(*access_row(self.actor, method, F.lit(entity), self.at)))

    def linked_entities(self, entity_id: str, entity_type: str, user_hash: str) -> DataFrame:
        self.gate(user_hash)
        wanted = self.spark.createDataFrame([(entity_id, entity_type)], "entity_id string, entity_type string")
        self._logged("linked_entities", entity_id)
        return other_end(self.store.read("entity_links"), wanted)

    def unlinked_entities(self, entity_type: str, user_hash: str, start: str | None = None, end: str | None = None, target_type: str | None = None) -> DataFrame:
        self.gate(user_hash)
        rows = self.store.read("unmatched_entities").where(F.col("entity_type") == entity_type)
        rows = rows if target_type is None else rows.where(F.col("target_type") == target_type)
        rows = rows if start is None else rows.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
        self._logged("unlinked_entities", entity_type)
        return rows if end is None else rows.where(F.col("created_at") <= F.lit(end).cast("timestamp"))

    def ambiguous_matches(self, user_hash: str, status: str = "pending") -> DataFrame:
        self.gate(user_hash)
        self._logged("ambiguous_matches", status)
        return self.store.read("ambiguous_matches").where(F.col("status") == status)

    def write_feedback(self, link_id: str, signal: str, source: str, reason: str, user_hash: str) -> None:
        self.gate(user_hash)
        if signal not in VALUES["feedback_signal"] or source not in VALUES["feedback_source"]:
            raise ValueError(f"unknown signal or source: {signal}, {source}")
        self._logged("write_feedback", link_id)
        self.store.append("link_feedback", self.spark.range(1).select(*feedback_row(F.lit(link_id), F.lit(signal), F.lit(source), F.lit(reason), self.at)))

    def last_run(self) -> DataFrame:
        """The run that started last; of several, the one of greatest id."""
        return self.store.read("run_log").agg(F.max_by(F.struct("run_id", "run_type", "status", "start_time", "end_time"), F.struct("start_time", "run_id")).alias("r")).select("r.*")

    def entity(self, entity_id: str, entity_type: str, user_hash: str) -> DataFrame:
        self.gate(user_hash)
        if entity_type not in ENTITY_ID:
            raise ValueError(entity_type)
        self._logged("entity", entity_id)
        return self.store.read(entity_type + "s").where(F.col(ENTITY_ID[entity_type]) == entity_id).limit(1)

    def entities(self, entity_type: str) -> DataFrame:
        if entity_type not in ("email", "calendar_event"):
            raise ValueError(entity_type)
        return self.store.read(entity_type + "s")

    def erase(self, entity_id: str) -> None:
        """Delete an entity from all tables and record how many rows went."""
        names = ("entity_links", "unmatched_entities", "ambiguous_matches", "link_feedback")
        after, counts = merge.erase({n: self.store.read(n) for n in names}, entity_id)
        record = counts.agg(F.sum("rows_deleted").alias("rows_deleted")).select(T.user_hash(F.lit(entity_id)).alias("entity_id"), F.lit(self.actor).alias("requested_by"), "rows_deleted", self.at.alias("deleted_at"))
        self.store.append("deletion_audit", record)
        self.store.replace_all(after)
