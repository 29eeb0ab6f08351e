"""Supporting evidence: messages and events around a transaction, approvals in threads, semantic search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.text import APPROVALS
from tallyloom.operators.reconcile import rarest
from tallyloom.session import cut


def _near(transactions: DataFrame, others: DataFrame, other_date: str, ident: str, days: int, text: Column) -> DataFrame:
    """Each vendor and day of the transactions, once, with the others within ``days`` that may name the vendor.

    Joined by day and the vendor's rarest group of three letters among the texts; only ids and letters are multiplied,
    and the caller verifies the whole name. How rare a group is, is judged by one text in sixteen: that decides on keys
    alone, and every text is searched. Groups that are no vendor's key go in a semi-join before the shuffle.
    """
    around = F.explode(F.sequence(F.date_sub("__d", days), F.date_add("__d", days)))
    wanted = cut(_keyed(transactions).select("__v", "__d").distinct())
    dated = others.withColumn("__day", F.to_date(other_date))
    groups = dated.select(F.col(ident).alias("__id"), "__day", F.explode(T.grams(text)).alias("__g"))
    judged = dated.where(F.pmod(F.xxhash64(ident), F.lit(16)) == 0).select(F.explode(T.grams(text)).alias("__g"))
    vendors = cut(rarest(wanted.select("__v").distinct(), "__v", judged, whole=False))
    held = groups.join(vendors.select("__g").distinct(), "__g", "left_semi")
    keys = wanted.join(vendors, "__v").select("__v", "__d", "__g", around.alias("__day"))
    met = keys.join(held, ["__day", "__g"]).select("__v", "__d", "__day", "__id").distinct().withColumnRenamed("__day", "__on")
    return met.join(dated, (F.col("__id") == F.col(ident)) & (F.col("__on") == F.col("__day"))).drop("__id", "__on")


def _keyed(transactions: DataFrame) -> DataFrame:
    return transactions.where("vendor <> ''").select("txn_id", F.lower("vendor").alias("__v"), F.to_date("date").alias("__d"))


def email_evidence(transactions: DataFrame, emails: DataFrame, days: int = 3, most: int = 5) -> DataFrame:
    """(txn_id, message_id, confidence, rank): messages within ``days`` that name the vendor; 0.9 in the subject, else 0.7."""
    in_subject, in_body = (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.col("__v")) for c in ("subject", "body_preview"))
    both = F.lower(F.concat_ws("\n", "subject", "body_preview"))
    hits = _near(transactions, emails, "received_at", "message_id", days, both).where(in_subject | in_body).withColumn("confidence", F.when(in_subject, 0.9).otherwise(0.7))
    return _first(transactions, hits.select("__v", "__d", "pos", "message_id", "confidence"), "pos", "message_id", most).select("txn_id", "message_id", "confidence", "rank")


def event_evidence(transactions: DataFrame, events: DataFrame, days: int = 3, most: int = 5) -> DataFrame:
    """(txn_id, event_id, rank): events within ``days`` whose subject names the vendor."""
    hits = _near(transactions, events, "start_time", "event_id", days, F.lower("subject")).where(F.contains(F.lower(F.coalesce("subject", F.lit(""))), F.col("__v")))
    return _first(transactions, hits.select("__v", "__d", "pos", "event_id"), "pos", "event_id", most).select("txn_id", "event_id", "rank")


def _first(transactions: DataFrame, hits: DataFrame, order: str, ident: str, most: int) -> DataFrame:
    """The first hits of each vendor and day, given to its transactions, and of those the first of each transaction."""

    def first(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, ident))).where(F.col("rank") <= most)

    return first(_keyed(transactions).join(first(hits, "__v", "__d").drop("rank"), ["__v", "__d"]), "txn_id")


def approvals(emails: DataFrame, thread: str, at: list[str], sender: str, body: str, keywords: tuple[str, ...] = APPROVALS) -> DataFrame:
    """(thread_id, approved, approver, approved_at, keyword): the first message of each thread that holds a keyword.

    Within a message the order of the keywords decides.
    """
    text = F.lower(F.coalesce(F.col(body), F.lit("")))
    found: Column = F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords])
    rows = emails.select(F.col(thread).alias("thread_id"), F.struct(*at).alias("o"), F.col(sender).alias("s"), F.col(at[0]).alias("t"), found.alias("k"))
    hit = F.min_by(F.struct("s", "t", "k"), F.when(F.col("k").isNotNull(), F.col("o")))
    return rows.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.count_if(F.col("k").isNotNull()).alias("n"), hit.alias("h")).select(
        "thread_id", (F.col("n") > 0).alias("approved"), F.when(F.col("n") > 0, F.col("h.s")).alias("approver"), F.when(F.col("n") > 0, F.col("h.t")).alias("approved_at"), F.when(F.col("n") > 0, F.col("h.k")).alias("keyword")
    )


def semantic_search(vectors: DataFrame, query: list[float], k: int = 10, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` vectors of greatest cosine with ``query``; one pass and a top-k, nothing is shuffled."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    score = F.try_divide(dot, norm * float(sum(x * x for x in query) ** 0.5))
    return vectors.select(ident, score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), ident).limit(k)
