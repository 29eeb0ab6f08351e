"""Schemas of records and control tables, value sets, and required and optional fields."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

_TYPES: dict[str, DataType] = {
    "string": StringType(), "double": DoubleType(), "long": LongType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(),
    "array<string>": ArrayType(StringType()), "array<double>": ArrayType(DoubleType()), "decimal": DecimalType(10, 4),
}


def _schema(fields: str) -> StructType:
    """A schema of ``name type`` pairs; unlike DDL it needs no running session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


_ETL = ", source string, ingested_at timestamp, raw_file_ref string"
TRANSACTION = _schema("transaction_id string, account_id string, amount double, date date, merchant_name string, name string, payment_channel string, category array<string>" + _ETL)
EMAIL = _schema("message_id string, received_at timestamp, sender string, recipients array<string>, subject string, body_preview string, thread_id string" + _ETL)
CALENDAR_EVENT = _schema("event_id string, start_time timestamp, end_time timestamp, organizer string, subject string, attendees array<string>, location string" + _ETL)
RECORDS = {"transaction": TRANSACTION, "email": EMAIL, "calendar_event": CALENDAR_EVENT}

LINK = _schema(
    "link_id string, source_id string, target_id string, source_type string, target_type string, match_type string, match_tier string, confidence double, linkage_key string, rule_version string, "
    "created_at timestamp, effective_from timestamp, effective_to timestamp, is_current boolean, superseded_by string"
)
UNMATCHED = _schema("entity_id string, entity_type string, target_type string, reason_code string, run_id string, created_at timestamp")
AMBIGUOUS = _schema("ambiguity_id string, source_entity_id string, source_type string, target_type string, candidate_ids array<string>, candidate_scores array<double>, status string, resolved_by string, created_at timestamp")
FEEDBACK = _schema("feedback_id string, link_id string, signal string, source string, reason string, created_at timestamp, processed boolean")
RUN_LOG = _schema("run_id string, run_type string, status string, start_time timestamp, end_time timestamp, error string")
WATERMARK = _schema("entity_type string, last_ingested_at timestamp, last_run_id string")
INTENT = _schema("id long, run_id string, operation string, payload string, committed boolean, created_at timestamp")
DELETION_AUDIT = _schema("entity_id string, requested_by string, rows_deleted long, deleted_at timestamp")
CONSENT = _schema("user_hash string, consent_type string, granted boolean, granted_at timestamp, expires_at timestamp")
PREFERENCE = _schema("user_hash string, preference string, value string, updated_at timestamp")
ACCESS_AUDIT = _schema("actor string, method string, entity_hash string, at timestamp")
FLAG = _schema("flag_id string, txn_id string, vendor string, amount double, audit_run_id string, severity string, confidence double, explanation string, evidence string, created_at timestamp")
AUDIT_TRAIL = _schema(
    "audit_run_id string, log_sequence_number long, agent_name string, tool_called string, timestamp timestamp, execution_time_ms long, input_data string, output_summary string, llm_model string, llm_tokens_used long, llm_cost_dollars decimal, "
    "error_message string, error_stack_trace string, decision_chain string"
)
WORKFLOW_STATE = _schema("audit_run_id string, workflow_status string, current_agent string, completed_agents array<string>, pending_agents array<string>, intermediate_results string, created_at timestamp, updated_at timestamp")
TABLES = {
    "entity_links": LINK, "unmatched_entities": UNMATCHED, "ambiguous_matches": AMBIGUOUS, "link_feedback": FEEDBACK, "run_log": RUN_LOG, "watermarks": WATERMARK, "intent_log": INTENT,
    "deletion_audit": DELETION_AUDIT, "user_consents": CONSENT, "user_preferences": PREFERENCE, "access_audit_log": ACCESS_AUDIT, "flags": FLAG, "audit_trail": AUDIT_TRAIL, "workflow_state": WORKFLOW_STATE,
    "transactions": TRANSACTION, "emails": EMAIL, "calendar_events": CALENDAR_EVENT,
}

# Field lists and enumerations of the record contract.
REQUIRED = {"transaction": ("transaction_id", "account_id", "amount", "date"), "email": ("message_id", "received_at", "sender", "recipients"), "calendar_event": ("event_id", "start_time", "end_time", "organizer")}
OPTIONAL = {"transaction": ("merchant_name", "name", "payment_channel", "category"), "email": ("subject", "body_preview", "thread_id"), "calendar_event": ("subject", "attendees", "location")}
VALUES = {
    "entity_type": ("transaction", "email", "calendar_event"),
    "match_type": ("deterministic", "embedding", "llm_inferred"),
    "match_tier": ("tier1_exact", "tier2_composite", "tier3_fuzzy"),
    "run_type": ("full_refresh", "incremental"),
    "run_status": ("in_progress", "success", "failed", "partial", "skipped"),
    "reason_code": ("no_shared_key", "ambiguous_merchant", "no_candidate_found"),
    "ambiguity_status": ("pending", "resolved", "dismissed"),
    "feedback_signal": ("confirmed", "rejected", "flagged"),
    "feedback_source": ("autonomous", "human"),
}
#: Accepted Spark types for the names that a caller may expect.
ACCEPTED = {"float": ("double", "float"), "int": ("bigint", "int", "smallint", "tinyint"), "str": ("string",), "datetime": ("timestamp", "timestamp_ntz", "date")}
