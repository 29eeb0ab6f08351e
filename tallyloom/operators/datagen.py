"""Labelled corruption of clean transactions; a hash of the id decides, so every run gives the same rows."""

from __future__ import annotations

import hashlib
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(ident: str, seed: int) -> Column:
    """Uniform in [0, 1) from the id: the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.col(ident).cast("string"), F.lit(f"#{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def missing_fields(df: DataFrame, ident: str = "txn_id", rate: float = 0.15, vendor: str = "vendor", amount: str = "amount", date: str = "date") -> DataFrame:
    """Null out fields of ``rate`` of the rows: half vendor, 30 % amount, 20 % vendor and date; ``nulled`` has the truth."""
    hit, kind = draw(ident, 1) < rate, draw(ident, 2)
    v, a, d = hit & ((kind < 0.5) | (kind >= 0.8)), hit & (kind >= 0.5) & (kind < 0.8), hit & (kind >= 0.8)
    nulled = F.array_compact(F.array(F.when(v, F.lit("vendor")), F.when(a, F.lit("amount")), F.when(d, F.lit("date"))))
    return df.withColumns({"nulled": nulled, vendor: F.when(~v, F.col(vendor)), amount: F.when(~a, F.col(amount)), date: F.when(~d, F.col(date))})


def duplicates(df: DataFrame, ident: str = "txn_id", rate: float = 0.10, amount: str = "amount") -> DataFrame:
    """Append two or three copies of ``rate`` of the rows, half of them with amounts off by up to 5; ``copy_of`` has the truth."""
    copies = F.when(draw(ident, 4) < 0.5, 2).otherwise(3)
    picked = df.where(draw(ident, 3) < rate).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    off = F.when(draw(ident, 5) < 0.5, F.round(draw(ident, 6) * 10 - 5, 2)).otherwise(0.0)
    made = picked.withColumns({"copy_of": F.col(ident).cast("string"), amount: F.col(amount) + off, ident: F.concat(F.col(ident).cast("string"), F.lit("_dup"), F.col("copy").cast("string"))}).drop("copy")
    return df.withColumns({"copy_of": F.lit(None).cast("string"), ident: F.col(ident).cast("string")}).unionByName(made)


def orphans(cards: DataFrame, bank: DataFrame, phantom: int = 50, dropped: int = 10, ident: str = "txn_id") -> tuple[DataFrame, DataFrame]:
    """(cards with phantom rows of 5,000 to 15,000, bank without ``dropped`` rows)."""
    spark = cards.sparkSession
    rows = spark.range(phantom).select(F.format_string("PHANTOM_%04d", F.col("id")).alias("__p"))
    amount = F.round(5000 + draw("__p", 7) * 10000, 2)
    values = {"amount": amount, "vendor": F.concat(F.lit("Phantom Vendor "), F.substring("__p", 9, 4)), ident: F.col("__p")}
    made = rows.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cards.schema.fields))
    gone = bank.orderBy(draw(ident, 8), ident).limit(dropped).select(ident)
    return cards.withColumn("is_phantom", F.lit(False)).unionByName(made.withColumn("is_phantom", F.lit(True))), bank.join(gone, ident, "left_anti")


def _name(k: int) -> str:
    """A made-up name of two long words, unlike those of other numbers."""
    letters = hashlib.md5(f"name {k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghklmnoprs"))
    return f"{letters[:9].capitalize()} {letters[9:19].capitalize()}"


def scenario(spark, composite: int = 8, fuzzy: int = 20, boundary: int = 8, ambiguous: int = 6, lone: int = 10, planned: int = 5, stays: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, emails, events) of a made-up business, as many of each case as asked for.

    composite: one name and day in transaction and email; fuzzy: an email one or two days later; boundary: an email three
    days later, or, every second one, four; ambiguous: two emails near the day; lone: no email; planned: an email and an
    event without a transaction; stays: a transaction and an event.
    """
    start, t, e, c = date(2026, 3, 10), [], [], []

    def add(merchant: str, day: int, emails: list[int], raw: bool = False) -> None:
        k = len(t)
        t.append((k, f"t{k:03d}", None if raw else merchant, f"{merchant.upper()} 0{k:03d}" if raw else None, start + timedelta(days=day)))
        for later in emails:
            e.append((len(e), f"m{len(e):03d}", merchant, datetime.combine(start, time(9)) + timedelta(days=day + later)))

    for i in range(composite):
        add(_name(i), i, [0])
    for i in range(fuzzy):
        add(_name(100 + i), i, [1 + i % 2])
    for i in range(boundary):
        add(_name(200 + i), i, [3 + i % 2])
    for i in range(ambiguous):
        add(_name(300 + i), i, [1, 2])
    for i in range(lone):
        add(_name(400 + i), i, [])
    for i in range(stays):
        add(_name(500 + i), i, [])
        c.append((len(c), f"c{len(c):03d}", _name(500 + i), datetime.combine(start, time(15)) + timedelta(days=i)))
    for i in range(planned):
        e.append((len(e), f"m{len(e):03d}", _name(600 + i), datetime.combine(start, time(9)) + timedelta(days=i)))
        c.append((len(c), f"c{len(c):03d}", _name(600 + i), datetime.combine(start, time(14)) + timedelta(days=i)))
    return (
        spark.createDataFrame(t, "pos int, transaction_id string, merchant_name string, name string, date date"),
        spark.createDataFrame(e, "pos int, message_id string, subject string, received_at timestamp"),
        spark.createDataFrame(c, "pos int, event_id string, subject string, start_time timestamp"),
    )


def matching_scenario(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A small hand-made set (transactions, emails, events) with composite, fuzzy, boundary, ambiguous and lone rows."""
    t = [("t1", "Acme Tools", None, "2026-03-10"), ("t2", None, "STARBUCKS STORE 12345", "2026-03-11"), ("t3", "Northwind Traders", None, "2026-03-12"), ("t4", "Bluebird Cafe", None, "2026-03-13"), ("t5", None, "PAYROLL 8831", "2026-03-14"), ("t6", "Lakeside Hotel", None, "2026-03-15")]
    e = [("m1", "Re: Acme Tools", "2026-03-10 09:00:00"), ("m2", "Starbucks", "2026-03-11 10:00:00"), ("m3", "Northwind Traders invoice", "2026-03-15 10:00:00"), ("m4", "Bluebird Cafe lunch", "2026-03-12 10:00:00"), ("m5", "Bluebird Cafe order", "2026-03-13 11:00:00"), ("m6", "Quarterly planning", "2026-03-20 11:00:00"), ("m7", "Lakeside Hotel booking", "2026-03-19 11:00:00")]
    c = [("c1", "Quarterly planning", "2026-03-20 14:00:00"), ("c2", "Lakeside Hotel", "2026-03-15 15:00:00")]
    txns = spark.createDataFrame([(i, *x) for i, x in enumerate(t)], "pos int, transaction_id string, merchant_name string, name string, date string").withColumn("date", F.to_date("date"))
    emails = spark.createDataFrame([(i, *x) for i, x in enumerate(e)], "pos int, message_id string, subject string, received_at string").withColumn("received_at", F.to_timestamp("received_at"))
    events = spark.createDataFrame([(i, *x) for i, x in enumerate(c)], "pos int, event_id string, subject string, start_time string").withColumn("start_time", F.to_timestamp("start_time"))
    return txns, emails, events


def business(planned: DataFrame, days: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(transactions, emails) of a made-up business of any size, from (pos, planned): what becomes of each transaction.

    ``same day``: an email of its name on its day; ``later``: one two days later; ``two``: two emails near it; ``lone``: none.
    Names are made of a digest and unlike each other; days are dealt out over ``days``.
    """
    letters = F.translate(F.md5(F.concat(F.lit("name "), F.col("pos").cast("string"))), "0123456789", "ghklmnoprs")
    rows = planned.withColumns({"merchant": F.concat(F.substring(letters, 1, 9), F.lit(" "), F.substring(letters, 10, 10)), "day": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("pos") % days).cast("int"))})
    later = F.when(F.col("planned") == "same day", F.array(F.lit(0))).when(F.col("planned") == "later", F.array(F.lit(2))).when(F.col("planned") == "two", F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    mails = rows.select("pos", "merchant", "day", F.posexplode(later).alias("k", "after"))
    return (
        rows.select("pos", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("transaction_id"), F.col("merchant").alias("merchant_name"), F.lit(None).cast("string").alias("name"), F.col("day").alias("date")),
        mails.select((F.col("pos") * 2 + F.col("k")).alias("pos"), F.concat(F.lit("m"), F.col("pos").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("message_id"), F.col("merchant").alias("subject"), F.date_add("day", F.col("after")).cast("timestamp").alias("received_at")),
    )
