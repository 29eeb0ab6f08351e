"""File sources: record fixtures, nested messages and events, and the demo CSV files in one gold shape."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType, StringType

from tallyloom.schemas import RECORDS
from tallyloom.session import cut

PAGE = 500
_RAW = {"transaction": ("date",), "email": ("received_at",), "calendar_event": ("start_time", "end_time")}


def raw_schema(kind: str) -> StructType:
    """Fixture schema: times as text, no ETL columns."""
    fields = RECORDS[kind].fields[:-3]
    return StructType([StructField(f.name, StringType()) if f.name in _RAW[kind] else f for f in fields])


def fixture(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON array of records with ``pos`` in file order and ``raw_file_ref``."""
    rows = spark.read.schema(raw_schema(kind)).option("multiLine", True).json(path)
    return rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("raw_file_ref", F.col("_metadata.file_path"))


def choose(mode: str | None, token: str | None, secure: bool = False) -> str:
    """Where records come from: ``fixture`` for a stub mode or without a token, else ``live``; secure mode needs a token."""
    if mode in ("smb", "rich", "true"):
        return "fixture"
    if token:
        return "live"
    if secure:
        raise PermissionError("secure mode needs a token")
    return "fixture"


# Nested payload of the message and calendar services.
MESSAGE = "id string, receivedDateTime string, sender struct<emailAddress:struct<address:string>>, toRecipients array<struct<emailAddress:struct<address:string>>>, subject string, bodyPreview string, conversationId string"
EVENT = "id string, start struct<dateTime:string>, end struct<dateTime:string>, organizer struct<emailAddress:struct<address:string>>, subject string, attendees array<struct<emailAddress:struct<address:string>>>, location struct<displayName:string>"


def messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Flat email rows of nested JSON; rows without sender or recipients are dropped, previews cut to 255 characters."""
    m = raw.select(F.from_json(column, MESSAGE).alias("m"))
    to = F.filter(F.transform("m.toRecipients", lambda r: r["emailAddress"]["address"]), lambda x: x.isNotNull())
    flat = m.select(
        F.col("m.id").alias("message_id"), F.to_timestamp("m.receivedDateTime").alias("received_at"), F.col("m.sender.emailAddress.address").alias("sender"), to.alias("recipients"), F.col("m.subject").alias("subject"),
        F.substring("m.bodyPreview", 1, 255).alias("body_preview"), F.col("m.conversationId").alias("thread_id"),
    )
    return flat.where("size(recipients) > 0 AND sender <> ''")


def calendar(raw: DataFrame, column: str = "value") -> DataFrame:
    """Flat event rows; attendees without an address are dropped, an empty list is null."""
    e = raw.select(F.from_json(column, EVENT).alias("e"))
    who = F.filter(F.transform("e.attendees", lambda r: r["emailAddress"]["address"]), lambda x: x.isNotNull())
    return e.select(
        F.col("e.id").alias("event_id"), F.to_timestamp("e.start.dateTime").alias("start_time"), F.to_timestamp("e.end.dateTime").alias("end_time"), F.col("e.organizer.emailAddress.address").alias("organizer"), F.col("e.subject").alias("subject"),
        F.when(F.size(who) > 0, who).alias("attendees"), F.col("e.location.displayName").alias("location"),
    )


class PagedSource(DataSource):
    """Records of a paged service, one partition a page. ``fetch`` is a function (offset, count) -> (rows, total)."""

    fetch: Callable[[int, int], tuple[list[tuple], int]]
    rows_schema: str

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.rows_schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(type(self).fetch)


class _PageReader(DataSourceReader):
    def __init__(self, fetch: Callable) -> None:
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        total = self.fetch(0, 0)[1]
        return [InputPartition(k) for k in range(max(1, -(-total // PAGE)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value * PAGE, PAGE)[0]


def paged(spark: SparkSession, fetch: Callable[[int, int], tuple[list[tuple], int]], schema: str) -> DataFrame:
    """A frame over a paged service; pages are read by the executors when an action runs."""
    source = type("Paged", (PagedSource,), {"fetch": staticmethod(fetch), "rows_schema": schema, "name": classmethod(lambda cls: "paged")})
    spark.dataSource.register(source)
    return spark.read.format("paged").load()


class _ChainReader(DataSourceReader):
    def __init__(self, fetch: Callable, starts: list[str], most: int | None) -> None:
        self.fetch, self.starts, self.most = fetch, starts, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        link, pages = partition.value, 0
        while link and (self.most is None or pages < self.most):
            rows, link = self.fetch(link)
            yield from rows
            pages += 1


def linked_pages(spark: SparkSession, fetch: Callable[[str], tuple[list[tuple], str | None]], starts: list[str], schema: str, max_pages: int | None = None) -> DataFrame:
    """A frame over services whose pages name the next one: ``fetch(link) -> (rows, next link)``.

    Each start (a mailbox, a calendar) is a partition of its own; ``max_pages`` ends every chain.
    """

    class Linked(PagedSource):
        rows_schema = schema

        @classmethod
        def name(cls) -> str:
            return "linked_pages"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _ChainReader(fetch, starts, max_pages)

    spark.dataSource.register(Linked)
    return spark.read.format("linked_pages").load()


# ------------------------------------------------------------------------------------------------ demo files


def numbered(df: DataFrame, order: list[str], name: str, pattern: str) -> DataFrame:
    """Add ``name``: the place of the row in ``order``, from 1, formatted.

    Rows are dealt out by ranges of ``order`` and written once, counted by range, and numbered within their range.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))  # one row a partition
    start = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(sizes.withColumn("__start", start), "__part").withColumn(name, F.format_string(pattern, F.col("__start") + nth)).drop("__part", "__size", "__start")


def gold(df: DataFrame, kind: str) -> DataFrame:
    """txn_id, vendor, amount, date, category, source of card, bank or receipt rows; ``vendor_id`` is null."""
    if kind == "bank":
        df = numbered(df, ["transaction_date", "description", "amount"], "txn_id", "BANK_%06d")
        cols = {"vendor": "description", "amount": "amount", "date": "transaction_date", "category": "type"}
    elif kind == "credit_card":
        df, cols = df.withColumn("txn_id", F.col("expense_id")), {"vendor": "merchant", "amount": "amount", "date": "expense_date", "category": "category"}
    else:
        df, cols = df.withColumn("txn_id", F.col("receipt_id")), {"vendor": "vendor_name", "amount": "amount", "date": "receipt_date", "category": None}
    pick = {k: F.col(v) if v in df.columns else F.lit(None) for k, v in cols.items()}
    return df.select("txn_id", pick["vendor"].cast("string").alias("vendor"), F.lit(None).cast("string").alias("vendor_id"), pick["amount"].cast("double").alias("amount"), F.to_timestamp(pick["date"]).alias("date"), pick["category"].cast("string").alias("category"), F.lit(kind).alias("source"))


def between(df: DataFrame, since: str | None = None, until: str | None = None, limit: int | None = None, column: str = "date", ident: str = "txn_id") -> DataFrame:
    """Inclusive date range, and optionally the first rows by date, then id."""
    df = df if since is None else df.where(F.col(column) >= F.lit(since).cast("timestamp"))
    df = df if until is None else df.where(F.col(column) <= F.lit(until).cast("timestamp"))
    return df if limit is None else df.orderBy(column, ident).limit(limit)


def register(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Temp views by name, for ``query``."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """SQL over the registered views; values are passed as named parameters, never pasted into the text."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def routed(sql: str, names: dict[str, str], default: str | None = None) -> str:
    """The view for a query text: that of the first name that the lower-cased text holds, else ``default``."""
    text = sql.lower()
    for name, view in names.items():
        if name in text:
            return view
    if default is None:
        raise LookupError("the query names no known table")
    return default


def dispatch(spark: SparkSession, sql: str, mode: str, loaders: dict[str, dict[str, Callable[[], DataFrame]]]) -> DataFrame:
    """Run a query over the views of a mode (warehouse, demo files, fixtures); a mode loads only the views that are named."""
    register(spark, {name: load() for name, load in loaders[mode].items() if re.search(rf"\b{re.escape(name)}\b", sql, re.IGNORECASE)})
    return query(spark, sql)
