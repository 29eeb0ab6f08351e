"""Reconciliation between sources, orphans, known-entity lookup and receipts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import AUDIT, CONFIDENCE_BANDS
from tallyloom.functions import text as T
from tallyloom.functions.similarity import sequence_ratios
from tallyloom.session import cut

PAIR = "source_1_id string, source_2_id string, confidence double, date_diff int, amount double, vendor string"
#: Lookups of receipts that are made abreast; ratios of names that a worker keeps.
LOOKUPS, NAMES = 1 << 20, 1 << 18
_RATIOS: dict[tuple[str | None, str | None], float] = {}


def in_range(df: DataFrame, source: str, start: str, end: str) -> DataFrame:
    return df.where((F.col("source") == source) & F.col("date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def floor_days(a, b):
    """Absolute whole days, floored before the sign is taken off, as for differences of instants."""
    return F.abs(F.floor((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400_000_000))).cast("int")


def candidates(one: DataFrame, two: DataFrame, tolerance: float = AUDIT.amount_tolerance, days: int = AUDIT.date_window_days) -> DataFrame:
    """Pairs of one vendor within the amount and date windows; null vendors never match.

    The days around each row of the first source are exploded, so a vendor with very many rows is joined day by day.
    """
    around = F.explode(F.sequence(F.date_sub(F.to_date("date"), days + 1), F.date_add(F.to_date("date"), days + 1)))
    a = one.select(F.col("txn_id").alias("a_id"), F.col("pos").alias("a_pos"), "vendor", F.col("amount").alias("a_amount"), F.col("date").alias("a_date"), around.alias("day"))
    b = two.select(F.col("txn_id").alias("b_id"), F.col("pos").alias("b_pos"), "vendor", F.col("amount").alias("b_amount"), F.col("date").alias("b_date"), F.to_date("date").alias("day"))
    both = a.join(b, ["vendor", "day"]).withColumn("date_diff", floor_days(F.col("a_date"), F.col("b_date")))
    close = F.try_divide(F.abs(F.col("a_amount") - F.col("b_amount")), F.col("a_amount")) <= tolerance
    return both.where(close & (F.col("date_diff") <= days)).drop("day")


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    taken, used, out = set(), set(), []
    for r in group.sort_values(["a_pos", "b_pos"]).itertuples():
        if r.a_id in used or r.b_id in taken:
            continue
        used.add(r.a_id)
        taken.add(r.b_id)
        exact = r.date_diff == 0 and r.a_amount == r.b_amount
        out.append((r.a_id, r.b_id, 0.95 if exact else 0.85, r.date_diff, r.a_amount, r.vendor))
    return pd.DataFrame(out, columns=["source_1_id", "source_2_id", "confidence", "date_diff", "amount", "vendor"])


def islands(pairs: DataFrame, by: list[str], low: str, high: str, name: str) -> DataFrame:
    """Add ``name``: within ``by``, pairs whose intervals [low, high] overlap, directly or through others, share a number."""
    order = Window.partitionBy(*by).orderBy(low, high)
    spans = pairs.select(*by, low, high).distinct()
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("__new", F.coalesce((F.col(low) > before).cast("int"), F.lit(0))).withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return pairs.join(numbered, [*by, low, high])


def agreed(pairs: DataFrame) -> DataFrame:
    """Add ``chosen`` (the pair stands first for both its rows) and ``gone`` (one of its rows is in a chosen pair).

    Pairs are ordered by the rows' positions, first source first: going through them in that order, a pair that is the
    first of both its rows is always taken, whatever happens elsewhere.
    """
    by_a, by_b, order = Window.partitionBy("a_id"), Window.partitionBy("b_id"), F.struct("a_pos", "b_pos", "a_id", "b_id")
    first = pairs.withColumn("__b", F.min(order).over(by_b)).withColumn("chosen", (F.col("__b") == order) & (F.min(order).over(by_a) == order))
    return first.withColumn("__a", F.max("chosen").over(by_a)).withColumn("gone", F.max("chosen").over(by_b) | F.col("__a")).drop("__a", "__b")


def cross_source(one: DataFrame, two: DataFrame, tolerance: float = AUDIT.amount_tolerance, days: int = AUDIT.date_window_days, rounds: int = 6) -> DataFrame:
    """One-to-one pairs, greedily in row order: each row takes the first partner that is still free.

    Candidates are found once. In each round the pairs that are the first choice of both their rows are taken, and all
    pairs of these rows go; a pair without rivals is a row of the first round, and few rounds settle nearly all. What
    ``rounds`` leave are dense knots, where each choice waits for the one before. These are parted where no interval of
    days, and within that none of amounts, overlaps, and once more, as pairs that share a row overlap in both; each part
    is gone through in order. A knot that never parts is one group.
    """
    rest, found = candidates(one, two, tolerance, days), []
    for _ in range(rounds):
        marked = cut(agreed(rest))
        found.append(marked.where("chosen").dropDuplicates(["a_id"]))
        rest = marked.where("NOT gone").drop("chosen", "gone")
        if rest.isEmpty():
            break
    exact = (F.col("date_diff") == 0) & (F.col("a_amount") == F.col("b_amount"))
    pairs = reduce(DataFrame.unionByName, found).select(
        F.col("a_id").alias("source_1_id"), F.col("b_id").alias("source_2_id"), F.when(exact, 0.95).otherwise(0.85).alias("confidence"), "date_diff", F.col("a_amount").alias("amount"), "vendor"
    )
    return pairs if len(found) < rounds or rest.isEmpty() else pairs.unionByName(knots(rest))


def knots(pairs: DataFrame) -> DataFrame:
    """Greedy pairs of connected candidates, group by group."""
    a_day, b_day = F.to_date("a_date"), F.to_date("b_date")
    found = pairs.withColumns({"d0": F.least(a_day, b_day), "d1": F.greatest(a_day, b_day), "m0": F.least("a_amount", "b_amount"), "m1": F.greatest("a_amount", "b_amount")})
    by = ["vendor"]
    for k, (low, high) in enumerate([("d0", "d1"), ("m0", "m1"), ("d0", "d1"), ("m0", "m1")]):
        found = cut(islands(found, by, low, high, f"island{k}"))
        by = [*by, f"island{k}"]
    return found.groupBy(*by).applyInPandas(_greedy, PAIR)


def left_over(df: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows without a partner, as a multiset difference; ``side``: source_1_id or source_2_id.

    Of rows with one id, as many go as there are pairs of it, the first in order of their columns; the rest stays.
    """
    taken = pairs.groupBy(F.col(side).alias("__id")).agg(F.count("*").alias("__taken"))
    nth = F.row_number().over(Window.partitionBy("txn_id").orderBy(*(c for c in df.columns if c != "txn_id")))
    ranked = df.withColumn("__nth", nth).join(taken, F.col("txn_id") == F.col("__id"), "left")
    return ranked.where(F.col("__nth") > F.coalesce("__taken", F.lit(0))).select(*df.columns)


def match_rate(one: DataFrame, pairs: DataFrame) -> DataFrame:
    return one.agg(F.count("*").alias("rows")).crossJoin(pairs.agg(F.count("*").alias("matched"))).select("rows", "matched", F.coalesce(F.round(F.try_divide("matched", "rows"), 3), F.lit(0.0)).alias("match_rate"))


def orphans(df: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """Rows whose (non-null) key occurs in exactly one source. Least and greatest source decide it: no sets are gathered."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    per = Window.partitionBy(*keys)
    return df.withColumns({"__a": F.min(source).over(per), "__b": F.max(source).over(per)}).where("__a = __b").drop("__a", "__b")


def rarest(names: DataFrame, name: str, held: DataFrame, whole: bool = True) -> DataFrame:
    """Add ``__g``: of a name's letter groups the one that the fewest rows of ``held`` (``__g``) have.

    Any group will do as the key of a join before ``contains``; the rarest makes the fewest candidates. Where ``held`` is
    of all texts (``whole``), names with a group that no row has can be contained in none and are left out.
    """
    counts = held.groupBy("__g").agg(F.count("*").alias("__n"))
    own = names.select(name, F.explode(T.own_grams(F.col(name))).alias("__g")).join(counts, "__g", "left")
    least = own.groupBy(name).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__g")).alias("__k"))
    return (least.where("__k.n > 0") if whole else least).select(name, "__k.__g")


def known_entities(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """(name, entity_id, canonical_name, confidence): by canonical name or a mention in the aliases; else unknown_<slug>, 0.

    Two equi-joins, by the canonical name and by the name's rarest letter group in the aliases; names are asked for once.
    """
    asked = names.select(F.col(name).alias("name")).distinct()
    by_name = asked.join(entities.select("entity_id", "canonical_name"), F.col("name") == F.col("canonical_name"))
    aliases = F.coalesce("aliases", F.lit(""))
    mentions = entities.select("entity_id", "canonical_name", "aliases", F.explode(T.grams(aliases)).alias("__g"))
    by_alias = rarest(asked, "name", mentions).join(mentions, "__g").where(F.contains(aliases, F.col("name")))
    first = F.min(F.struct("entity_id", "canonical_name"))
    found = by_name.select("name", "entity_id", "canonical_name").unionByName(by_alias.select("name", "entity_id", "canonical_name")).groupBy("name").agg(first.alias("__e")).select("name", "__e.*")
    return asked.join(found, "name", "left").select("name", F.coalesce("entity_id", T.unknown_slug(F.col("name"))).alias("entity_id"), F.coalesce("canonical_name", "name").alias("canonical_name"), F.when(F.col("entity_id").isNotNull(), 0.95).otherwise(0.0).alias("confidence"))


def _steps(amount: Column, tolerance: float) -> Column:
    """Step of a positive amount on a scale of which the window of one amount covers two steps at most."""
    return F.log(F.when(amount > 0, amount)) / max(math.log((1 + tolerance) / (1 - tolerance)), 1e-6)


def _within(asked: DataFrame, transactions: DataFrame, days: int, tolerance: float, *same: Column) -> DataFrame:
    """Rows of ``asked`` (r_amount, r_date) with the transactions (amount, day) within the windows, by day and amount step."""
    zero = F.lit(-(1 << 62)).cast("bigint")
    low, high = (F.floor(_steps(F.col("r_amount") * (1 + s * tolerance), tolerance) + s * 1e-6).cast("bigint") for s in (-1, 1))
    near = F.when(F.col("r_amount") > 0, F.sequence(low, high)).when(F.col("r_amount") == 0, F.array(zero))
    around = asked.select("*", F.explode(F.sequence(F.date_sub("r_date", days), F.date_add("r_date", days))).alias("__day")).select("*", F.explode(near).alias("__near"))
    stepped = transactions.withColumn("__step", F.when(F.col("amount") == 0, zero).otherwise(F.floor(_steps(F.col("amount"), tolerance)).cast("bigint")))
    on = [F.col("__day") == F.col("day"), F.col("__near") == F.col("__step"), F.col("amount").between(F.col("r_amount") * (1 - tolerance), F.col("r_amount") * (1 + tolerance)), *same]
    return around.join(stepped, reduce(lambda a, b: a & b, on)).drop("__day", "__near", "__step")


def _days(day: Column, days: int) -> Column:
    """Number of the stretch of days, as long as a window, that a day lies in: a window covers two at most."""
    return F.floor(F.unix_date(day) / (2 * days + 1)).cast("bigint")


def _name_parts(pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
    """Ratios of (transaction's, receipt's) names, each asked for once by a worker."""
    new = [p for p in pairs if p not in _RATIOS]
    if len(_RATIOS) + len(new) > NAMES:
        _RATIOS.clear()
        new = pairs
    _RATIOS.update(zip(new, sequence_ratios([a for a, _ in new], [b for _, b in new]), strict=True))
    return np.array([_RATIOS[p] for p in pairs])


def _nearest(asked: pa.Table, held: pa.Table, days: int, tolerance: float) -> tuple[np.ndarray, ...]:
    """(row of asked, row of held, score, amount delta, days apart): of each receipt the best transaction of a cell.

    Of the transactions of one day and name only the next amount from below and from above can be best, so each receipt
    looks these up, first for its own name, then for all others on those days that could still reach the best so far.
    """
    n, m = asked.num_rows, held.num_rows
    names = pa.concat_arrays([pc.cast(t.column(c), pa.string()).combine_chunks() for t, c in ((asked, "r_vendor"), (held, "vendor"))]).dictionary_encode()
    named, text = len(names.dictionary), [*names.dictionary.to_pylist(), None]
    code = names.indices.cast(pa.int64()).fill_null(named).to_numpy()
    wanted, r_amount, r_day = code[:n], asked.column("r_amount").to_numpy(), asked.column("r_day").to_numpy()
    order = np.lexsort((held.column("amount").to_numpy(), code[n:], held.column("day").to_numpy()))
    vendor, amount, day = code[n:][order], held.column("amount").to_numpy()[order], held.column("day").to_numpy()[order]
    ids = pc.rank(held.column("txn_id"), tiebreaker="dense", null_placement="at_start").to_numpy()[order].astype(np.int64)
    low, high = r_amount * (1 - tolerance), r_amount * (1 + tolerance)

    start = np.flatnonzero(np.r_[True, (np.diff(day) != 0) | (np.diff(vendor) != 0)])  # one group for each day and name
    stop, of_day = np.r_[start[1:], m], day[start]
    group_key = (of_day - of_day[0]) * (named + 1) + vendor[start]
    levels, level = np.unique(amount, return_inverse=True)
    key = np.repeat(np.arange(len(start)), stop - start) * (len(levels) + 1) + level
    place = np.searchsorted(levels, r_amount)
    best, best_id, pick = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)

    def offer(r: np.ndarray, g: np.ndarray, shift: int) -> None:
        at = np.searchsorted(key, g * (len(levels) + 1) + place[r])
        r, t = np.r_[r, r], np.r_[np.where(at < stop[g], at, m), np.where(at > start[g], at - 1, m)]
        r, t = r[t < m], t[t < m]
        fit = (amount[t] >= low[r]) & (amount[t] <= high[r])
        r, t = r[fit], t[fit]
        x = r_amount[r]
        base = (1 - np.where(x != 0, np.abs(amount[t] - x) / np.where(x != 0, x, 1), 0.0)) * 0.4 + (1 - abs(shift) / max(days, 1)) * 0.3
        fit = base + 0.3 >= best[r]
        r, t, base = r[fit], t[fit], base[fit]
        if not len(r):
            return
        pairs, back = np.unique(vendor[t] * (named + 1) + wanted[r], return_inverse=True)
        score = base + _name_parts([(text[k // (named + 1)], text[k % (named + 1)]) for k in pairs.tolist()])[back] * 0.3
        last = np.lexsort((ids[t], score, r))
        r, t, score = r[last], t[last], score[last]
        last = np.r_[np.diff(r) != 0, True]
        r, t, score = r[last], t[last], score[last]
        better = (score > best[r]) | (score == best[r]) & (ids[t] > best_id[r])
        r, t = r[better], t[better]
        best[r], best_id[r], pick[r] = score[better], ids[t], t

    shifts = sorted(range(-days, days + 1), key=abs)
    for own in (True, False):
        for shift in shifts:
            reach = 0.7 + (1 - abs(shift) / max(days, 1)) * 0.3 + 1e-9
            r = np.flatnonzero((reach >= best) & (r_day + shift >= of_day[0]) & (r_day + shift <= of_day[-1]))
            if own:
                r = r[wanted[r] < named]
                seen = (r_day[r] + shift - of_day[0]) * (named + 1) + wanted[r]
                g = np.minimum(np.searchsorted(group_key, seen), len(start) - 1)
                offer(r[group_key[g] == seen], g[group_key[g] == seen], shift)
                continue
            first = np.searchsorted(of_day, r_day[r] + shift)
            many = np.searchsorted(of_day, r_day[r] + shift, side="right") - first
            total = np.cumsum(many)
            cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(LOOKUPS, total[-1] if len(r) else 0, LOOKUPS)), len(r)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                k = many[a:b]
                g = np.repeat(first[a:b] - np.cumsum(k) + k, k) + np.arange(k.sum())
                offer(np.repeat(r[a:b], k), g, shift)
    r = np.flatnonzero(pick >= 0)
    t = pick[r]
    return r, order[t], best[r], np.abs(amount[t] - r_amount[r]), np.abs(day[t] - r_day[r])


def receipts(found: DataFrame, transactions: DataFrame, days: int = 7, tolerance: float = AUDIT.amount_tolerance) -> DataFrame:
    """Best transaction of each receipt within the windows, by amount, day and name; receipts without one have nulls.

    ``found``: (receipt_id, vendor, amount, date). Rows meet in cells of a stretch of days and a step of the amount's
    logarithm, so that a day of very many rows falls apart; amounts of zero meet each other. ``tolerance`` is below 1.

    Equal rows meet as one: receipts of one name, amount and day, and of such transactions the one of greatest id. No
    pairs are written: a cell gives one row for each of its receipts, so the work grows with the rows.
    """
    zero = F.lit(-(1 << 62)).cast("bigint")
    r = found.select("receipt_id", F.col("vendor").alias("r_vendor"), F.col("amount").cast("double").alias("r_amount"), F.to_date("date").alias("r_date"))
    t = transactions.select("txn_id", "vendor", F.col("amount").cast("double").alias("amount"), F.to_date("date").alias("day")).where("amount >= 0 AND day IS NOT NULL")
    held = t.groupBy("vendor", "amount", "day").agg(F.max("txn_id").alias("txn_id")).select(
        _days(F.col("day"), days).alias("__days"), F.when(F.col("amount") == 0, zero).otherwise(F.floor(_steps(F.col("amount"), tolerance)).cast("bigint")).alias("__step"),
        "txn_id", "vendor", "amount", F.unix_date("day").cast("bigint").alias("day"),
    )
    low, high = (F.floor(_steps(F.col("r_amount") * (1 + s * tolerance), tolerance) + s * 1e-6).cast("bigint") for s in (-1, 1))
    near = F.when(F.col("r_amount") > 0, F.sequence(low, high)).when(F.col("r_amount") == 0, F.array(zero))
    stretches = F.array_distinct(F.array(_days(F.date_sub("r_date", days), days), _days(F.date_add("r_date", days), days)))
    asked = r.select("r_vendor", "r_amount", "r_date").where("r_amount >= 0 AND r_date IS NOT NULL").distinct().select("*", F.explode(stretches).alias("__days")).select("*", F.explode(near).alias("__step"))
    asked = asked.select("__days", "__step", "r_vendor", "r_amount", F.unix_date("r_date").cast("bigint").alias("r_day"))

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        a, b, score, delta, gap = _nearest(asked, held, days, tolerance) if asked.num_rows and held.num_rows else [np.empty(0, np.int64)] * 5
        columns = {c: asked.column(c).take(pa.array(a)) for c in ("r_vendor", "r_amount", "r_day")} | {"txn_id": held.column("txn_id").take(pa.array(b))}
        return pa.table(columns | {"score": pa.array(score, pa.float64()), "amount_delta": pa.array(delta, pa.float64()), "date_delta": pa.array(gap, pa.int32())})

    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((asked, "r_vendor"), (held, "txn_id"))}
    schema = f"r_vendor {kinds['r_vendor']}, r_amount double, r_day long, txn_id {kinds['txn_id']}, score double, amount_delta double, date_delta int"
    met = asked.groupBy("__days", "__step").cogroup(held.groupBy("__days", "__step")).applyInArrow(work, schema)
    first = F.max_by(F.struct("txn_id", "score", "amount_delta", "date_delta"), F.struct("score", "txn_id")).alias("b")
    of_kind = met.groupBy(F.col("r_vendor").alias("__v"), F.col("r_amount").alias("__a"), F.col("r_day").alias("__d")).agg(first)
    same = F.col("r_vendor").eqNullSafe(F.col("__v")) & (F.col("r_amount") == F.col("__a")) & (F.unix_date("r_date") == F.col("__d"))
    best = r.join(of_kind, same).select("receipt_id", "b.*").groupBy("receipt_id").agg(first)
    return found.select("receipt_id").join(best, "receipt_id", "left").select("receipt_id", F.col("b.txn_id").alias("txn_id"), F.coalesce(F.round("b.score", 3), F.lit(0.0)).alias("confidence"), F.round("b.amount_delta", 2).alias("amount_delta"), F.col("b.date_delta").alias("date_delta_days"))


def with_receipt(transactions: DataFrame, found: DataFrame, days: int = 7, tolerance: float = AUDIT.amount_tolerance) -> DataFrame:
    """Add receipt_found: some receipt (amount, date) lies within the windows of a row with this id. Without an id: false."""
    r = found.select(F.col("amount").alias("r_amount"), F.to_date("date").alias("r_date")).distinct()
    held = _within(r, transactions.select("txn_id", "amount", F.to_date("date").alias("day")), days, tolerance).select(F.col("txn_id").alias("__held")).distinct()
    return transactions.join(held, F.col("txn_id") == F.col("__held"), "left").withColumn("receipt_found", F.col("__held").isNotNull()).drop("__held")


def low_confidence(pairs: DataFrame, one: DataFrame, two: DataFrame, below: float = CONFIDENCE_BANDS["high"]) -> DataFrame:
    """(source_1_id, source_2_id, confidence, reasons) of the pairs below a confidence, for a closer look.

    Reasons are what differs, in the order vendor, amount, date; a row is known by its id, the least row of several.
    Specified by the contract's documents, which its code doesn't do.
    """

    def side(df: DataFrame, ident: str, name: str) -> DataFrame:
        return df.groupBy(F.col("txn_id").alias(ident)).agg(F.min(F.struct("vendor", "amount", "date")).alias(name))

    both = pairs.where(F.col("confidence") < below).select("source_1_id", "source_2_id", "confidence").join(side(one, "source_1_id", "a"), "source_1_id", "left").join(side(two, "source_2_id", "b"), "source_2_id", "left")
    differs = [
        F.when(~F.col("a.vendor").eqNullSafe(F.col("b.vendor")), F.lit("vendor name mismatch")),
        F.when(~F.col("a.amount").eqNullSafe(F.col("b.amount")), F.lit("amount mismatch")),
        F.when(F.coalesce(floor_days(F.col("a.date"), F.col("b.date")), F.lit(1)) != 0, F.lit("date mismatch")),
    ]
    return both.select("source_1_id", "source_2_id", "confidence", F.array_compact(F.array(*differs)).alias("reasons"))
