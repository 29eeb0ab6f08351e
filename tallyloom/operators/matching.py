"""Record linkage: exact keys, then composite keys, then fuzzy text within a date window.

Entities are prepared to (entity_id, pos, day, exact, composite, fuzzy, fuzzy_field); ``pos`` is the order that decides
between equal candidates. Every tier is an equi-join: the fuzzy tier pairs the distinct texts of the days of its window,
scores each pair once, and lists the candidates of each text and day once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import CONFIDENCE, ENTITY_DATE, ENTITY_ID, FUZZY_FLOOR, RULE_VERSION, RULES, PairRule
from tallyloom.functions import text as T
from tallyloom.functions.similarity import letter_facts, scored_pairs, weighted_bound
from tallyloom.session import cut


@dataclass
class Matches:
    links: DataFrame
    unmatched: DataFrame
    ambiguous: DataFrame


def prepare(df: DataFrame, kind: str, fields: tuple[str, ...], exact: str, pos: str = "pos") -> DataFrame:
    """``fields``: the text fields in the order they are tried; the first that is not empty when normalised is compared.

    Names fall back from an absent or empty merchant to the raw name. Every field is normalised once.
    """
    normal = {f"__{f}": T.comparable(f, F.col(f)) for f in dict.fromkeys((*fields, *(("merchant_name", "name") if kind == "transaction" else ("subject",))))}
    rows = df.withColumns(normal)
    composite = F.when(F.coalesce("merchant_name", F.lit("")) != "", F.col("__merchant_name")).otherwise(F.col("__name")) if kind == "transaction" else F.col("__subject")
    chosen = F.coalesce(*[F.when(F.col(f"__{f}") != "", F.struct(F.col(f"__{f}").alias("t"), F.lit(f).alias("f"))) for f in fields])
    return rows.select(
        F.col(ENTITY_ID[kind]).alias("entity_id"), F.col(pos).cast("long").alias("pos"), F.to_date(ENTITY_DATE[kind]).alias("day"), (F.col(exact) if exact in df.columns else F.lit(None)).cast("string").alias("exact"),
        composite.alias("composite"), chosen["t"].alias("fuzzy"), chosen["f"].alias("fuzzy_field"),
    )


def first_match(joined: DataFrame) -> DataFrame:
    """Of each source's candidates the one that stands first."""
    return joined.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy("t_pos", "target_id"))).where("__n = 1").drop("__n")


def _links(pairs: DataFrame, tier: str, confidence: Column, key: Column) -> DataFrame:
    return pairs.select("source_id", "target_id", F.lit(tier).alias("match_tier"), confidence.alias("confidence"), key.alias("linkage_key"))


def _first_target(target: DataFrame, keys: list[str]) -> DataFrame:
    """Of the targets with equal keys the one that stands first: all that a source of these keys can get."""
    first = F.min(F.struct(F.col("pos").alias("t_pos"), F.col("entity_id").alias("target_id")))
    return target.groupBy(*keys).agg(first.alias("__t")).select(*keys, "__t.t_pos", "__t.target_id")


def tier1(source: DataFrame, target: DataFrame, key_name: str) -> DataFrame:
    """Equal non-null keys; the first candidate wins. Targets are reduced to one a key before the join."""
    s = source.where(F.col("exact").isNotNull()).select(F.col("entity_id").alias("source_id"), "exact")
    t = _first_target(target.where(F.col("exact").isNotNull()), ["exact"])
    return _links(first_match(s.join(t, "exact")), "tier1_exact", F.lit(CONFIDENCE["tier1_exact"]), F.concat(F.lit(f"{key_name}:"), F.col("exact")))


def tier2(source: DataFrame, target: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Equal normalised names on one day; amounts are not compared; the first candidate wins."""
    s = source.where("composite <> ''").select(F.col("entity_id").alias("source_id"), "composite", "day")
    t = _first_target(target.where("composite <> ''"), ["composite", "day"])
    return _links(first_match(s.join(t, ["composite", "day"])), "tier2_composite", F.lit(CONFIDENCE["tier2_composite"]), F.lit("+".join(fields)))


#: Edits up to which texts meet by their parts; with more, a text would look up very many parts.
EDITS = 8


def _met_by_parts(one: DataFrame, two: DataFrame, days: int, least: float) -> DataFrame:
    """(s_text, t_text): every pair at most ``days`` apart that can reach the edit similarity ``least``, and some others.

    A text of ``two`` is cut into one part more than the edits that its length allows, so one part at least stays whole
    in any text that reaches the score, moved by no more than the edits before it and after it. Texts meet by stretch of
    days, length and such a part. Where the lengths allow more than ``EDITS`` edits, or as many as a text has letters,
    they meet by stretch and length alone. The lengths come from the texts of ``two``, one number each.
    """
    longest = one.agg(F.max(F.length("s_text"))).first()[0] or 0
    lengths = sorted(r[0] for r in two.select(F.length("t_text")).distinct().collect())
    if not lengths:
        return one.join(two, F.lit(False)).select("s_text", "t_text")

    def edits(length: int) -> int:
        other = max(length, min(longest, int(length / least + 1e-9)) if least > 0 else longest)
        return int((1 - least) * other + 1e-9)

    def parts(length: int) -> list[tuple[int, int]]:
        """(start, size) of the parts, from 0; one empty part where they would not do."""
        k = edits(length)
        if k > EDITS or k >= length:
            return [(0, 0)]
        cuts = [length * i // (k + 1) for i in range(k + 2)]
        return list(zip(cuts, (y - x for x, y in zip(cuts[:-1], cuts[1:], strict=True)), strict=False))

    rows = [(n, i, len(p) - 1, start, size) for n in lengths for p in [parts(n)] for i, (start, size) in enumerate(p)]
    plan = F.broadcast(one.sparkSession.createDataFrame(rows, "__n int, __i int, __last int, __start int, __size int"))  # at most EDITS + 1 rows a length
    width, n, m = 2 * days + 1, F.length("s_text"), F.length("t_text")
    stretch = lambda day: F.floor(F.unix_date(day) / width)
    key = F.xxhash64
    near = F.array_distinct(F.array(stretch(F.date_sub("s_day", days)), stretch(F.date_add("s_day", days))))
    other = F.explode(F.filter(F.lit(lengths), lambda x: F.least(n, x) >= F.greatest(n, x) * least - 1e-9)).alias("__n")
    first = F.greatest(F.lit(0), F.col("__start") - F.col("__i"), F.col("__start") + n - F.col("__n") - (F.col("__last") - F.col("__i")))
    last = F.least(n - F.col("__size"), F.col("__start") + F.col("__i"), F.col("__start") + n - F.col("__n") + (F.col("__last") - F.col("__i")))
    places = F.when(F.col("__size") == 0, F.array(F.lit(0))).when(first <= last, F.sequence(first, last))
    asked = one.select("*", other).join(plan, "__n").select("*", F.explode(places).alias("__at")).select("s_text", "s_day", "__n", "__i", F.col("s_text").substr(F.col("__at") + 1, F.col("__size")).alias("__part")).distinct()
    asked = asked.select("s_text", "s_day", F.explode(near).alias("__days"), "__n", "__i", "__part").select("s_text", "s_day", key("__days", "__n", "__i", "__part").alias("__key"))
    held = two.withColumn("__own", m).join(plan, F.col("__own") == F.col("__n")).select("t_text", "t_day", key(stretch("t_day"), "__n", "__i", F.col("t_text").substr(F.col("__start") + 1, F.col("__size"))).alias("__key"))
    return asked.join(held, "__key").where(F.abs(F.datediff("s_day", "t_day")) <= days).select("s_text", "t_text")


def _compared(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the fuzzy tier needs of both sides; a source without a day or text takes no part."""
    s = source.where(F.col("day").isNotNull() & F.col("fuzzy").isNotNull()).select(F.col("entity_id").alias("source_id"), F.col("fuzzy").alias("s_text"), "fuzzy_field", F.col("day").alias("s_day"))
    t = target.where(F.col("day").isNotNull() & F.col("fuzzy").isNotNull()).select(F.col("entity_id").alias("target_id"), F.col("pos").alias("t_pos"), F.col("fuzzy").alias("t_text"), F.col("fuzzy_field").alias("t_field"), F.col("day").alias("t_day"))
    return s, t


def _around(days: int):
    return F.explode(F.sequence(F.date_sub("s_day", days), F.date_add("s_day", days))).alias("t_day")


def text_pairs(s: DataFrame, t: DataFrame, days: int, least: float, scorer: str) -> DataFrame:
    """(s_text, t_text, score) of the texts that meet within ``days`` and score at least ``least``, each pair once.

    The distinct texts of a day meet, around the source's days, and each pair of texts is scored once, however many rows
    have them. For the edit scorer, only texts meet that have a part in common; for the weighted one, texts without a
    common word whose common letters keep them below the least score are dropped before they are scored.
    """
    one, two = s.select("s_text", "s_day").distinct(), t.select("t_text", "t_day").distinct()
    if scorer == "edit":
        met = _met_by_parts(one, two, days, least)
    else:
        if scorer == "weighted":
            one, two = (d.withColumn(f"{side}_facts", letter_facts(F.col(f"{side}_text"))) for d, side in ((one, "s"), (two, "t")))
        met = one.select("*", _around(days)).join(two, "t_day")
        if scorer == "weighted":
            met = met.where(weighted_bound(F.col("s_facts"), F.col("t_facts")) >= least - 1e-9)
        met = met.select("s_text", "t_text")
    return scored_pairs(met.distinct(), "s_text", "t_text", scorer).where(F.col("score") >= least)


def window_pairs(source: DataFrame, target: DataFrame, days: int, least: float, scorer: str) -> DataFrame:
    """Candidate pairs of rows at most ``days`` apart with a score of at least ``least``, by the pairs of their texts."""
    s, t = _compared(source, target)
    hits = text_pairs(s, t, days, least, scorer)
    return s.select("*", _around(days)).join(hits, "s_text").join(t, ["t_text", "t_day"]).drop("s_day", "t_day")


def tier3(source: DataFrame, target: DataFrame, rule: PairRule, scorer: str = "weighted") -> tuple[DataFrame, DataFrame]:
    """(links, ambiguous): one candidate at or above the least score is a link, several are ambiguous in candidate order.

    Sources of one text and day have the same candidates: these are listed once for each text and day. Rows that repeat
    a source's id are one source with the candidates of all its rows, and are listed on their own.
    """
    days, least = rule.fuzzy.date_window_days, rule.fuzzy.min_similarity_score
    s, t = _compared(source, target)
    hits = cut(text_pairs(s, t, days, least, scorer))
    many = cut(s.groupBy(F.col("source_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id"))
    listed = F.sort_array(F.collect_list(F.struct("t_pos", "target_id", "score", "t_field"))).alias("c")
    keys = s.select("s_text", "s_day").distinct()
    found = keys.select("*", _around(days)).join(hits, "s_text").join(t, ["t_text", "t_day"]).groupBy("s_text", "s_day").agg(listed)
    lists = cut(found.select("s_text", "s_day", F.when(F.size("c") == 1, F.col("c")[0]).alias("one"), F.when(F.size("c") > 1, F.transform("c", lambda x: x["target_id"])).alias("candidate_ids"), F.when(F.size("c") > 1, F.transform("c", lambda x: x["score"])).alias("candidate_scores")))
    single = s.join(many, s["source_id"] == many["__id"], "left_anti")
    own = single.select("source_id", "s_text", "s_day", "fuzzy_field")
    links = own.join(lists.where("one IS NOT NULL").select("s_text", "s_day", "one"), ["s_text", "s_day"]).select("source_id", "one.target_id", "one.score", F.col("fuzzy_field").alias("sf"), F.col("one.t_field").alias("tf"))
    ambiguous = own.join(lists.where("one IS NULL").select("s_text", "s_day", "candidate_ids", "candidate_scores"), ["s_text", "s_day"]).select("source_id", "candidate_ids", "candidate_scores")
    if not many.isEmpty():
        twice = s.join(many, s["source_id"] == many["__id"], "left_semi").select("*", _around(days)).join(hits, "s_text").join(t, ["t_text", "t_day"])
        rest = cut(twice.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("t_pos", "target_id", "score", "fuzzy_field", "t_field"))).alias("c")))
        x = F.col("c")[0]
        links = links.unionByName(rest.where("size(c) = 1").select("source_id", x["target_id"].alias("target_id"), x["score"].alias("score"), x["fuzzy_field"].alias("sf"), x["t_field"].alias("tf")))
        ambiguous = ambiguous.unionByName(rest.where("size(c) > 1").select("source_id", F.transform("c", lambda x: x["target_id"]).alias("candidate_ids"), F.transform("c", lambda x: x["score"]).alias("candidate_scores")))
    return _links(links, "tier3_fuzzy", F.greatest(F.lit(FUZZY_FLOOR), F.col("score")), T.fuzzy_key(F.col("sf"), F.col("tf"), F.col("score"))), ambiguous


def cascade(source: DataFrame, target: DataFrame, rule: PairRule, run_id: str = "", scorer: str = "weighted") -> Matches:
    """Every source leaves at the first tier that hits; what is left over is unmatched for this target type.

    The tiers' hits are thin and computed once each, so a plan doesn't grow with the tiers before it.
    """
    types = {"source_type": F.lit(rule.source_type), "target_type": F.lit(rule.target_type)}
    one = cut(tier1(source, target, rule.exact_keys[0]))
    rest = source.join(one.select(F.col("source_id").alias("entity_id")), "entity_id", "left_anti")
    two = cut(tier2(rest, target, rule.composite))
    rest = source.join(one.unionByName(two).select(F.col("source_id").alias("entity_id")), "entity_id", "left_anti")
    three, ambiguous = tier3(rest, target, rule, scorer)
    links = one.unionByName(two).unionByName(three).withColumns(types | {"match_type": F.lit("deterministic"), "rule_version": F.lit(RULE_VERSION)})
    links = links.withColumn("link_id", T.stable_id(F.col("source_id"), F.col("target_id"), F.col("target_type"), F.col("match_tier")))
    taken = three.select("source_id").unionByName(ambiguous.select("source_id")).withColumnRenamed("source_id", "entity_id")
    unmatched = rest.join(taken, "entity_id", "left_anti").select("entity_id", F.lit(rule.source_type).alias("entity_type"), types["target_type"].alias("target_type"), F.lit("no_candidate_found").alias("reason_code"), F.lit(run_id).alias("run_id"))
    ambiguous = ambiguous.withColumns(types).withColumnRenamed("source_id", "source_entity_id").withColumn("ambiguity_id", T.stable_id(F.col("source_entity_id"), F.col("target_type"))).withColumn("status", F.lit("pending"))
    return Matches(links, unmatched, ambiguous)


def match_all(transactions: DataFrame, emails: DataFrame, events: DataFrame, run_id: str = "", rules: dict = RULES, scorer: str = "weighted") -> Matches:
    """Transactions to emails and to events, then emails that no transaction took to events.

    Transactions are deduplicated (first position). Emails that are linked or an ambiguous candidate count as taken. An
    email without an event is recorded as unmatched towards transactions; events never are.
    """
    from tallyloom.operators.etl import first_by

    transactions = first_by(transactions, "transaction_id", "pos")

    prepared: dict[tuple, DataFrame] = {}

    def ready(df: DataFrame, kind: str, rule: PairRule, side: int) -> DataFrame:
        fields = rule.fuzzy.fields if side == 0 else tuple(dict.fromkeys(rule.fuzzy.field_map.get(f, f) for f in rule.fuzzy.fields))
        want = (kind, fields, rule.exact_keys[side])
        if want not in prepared:  # thin, and read by every tier
            prepared[want] = cut(prepare(df, *want))
        return prepared[want]

    te, tc, ec = rules["transaction", "email"], rules["transaction", "calendar_event"], rules["email", "calendar_event"]
    first = cascade(ready(transactions, "transaction", te, 0), ready(emails, "email", te, 1), te, run_id, scorer)
    second = cascade(ready(transactions, "transaction", tc, 0), ready(events, "calendar_event", tc, 1), tc, run_id, scorer)
    taken = first.links.select(F.col("target_id").alias("entity_id")).unionByName(first.ambiguous.select(F.explode("candidate_ids").alias("entity_id"))).distinct()
    free = cut(ready(emails, "email", ec, 0).join(taken, "entity_id", "left_anti"))
    third = cascade(free, ready(events, "calendar_event", ec, 1), ec, run_id, scorer)
    third.unmatched = third.unmatched.withColumn("target_type", F.lit("transaction"))
    parts = (first, second, third)
    out = {}
    for name in ("links", "unmatched", "ambiguous"):
        frames = [getattr(p, name) for p in parts]
        out[name] = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return Matches(**out)


def match_metrics(matches: Matches) -> DataFrame:
    """Counts and rates by pair: links of each tier, ambiguous, unmatched, and the rate of links."""
    links = matches.links.select("source_type", "target_type", F.col("match_tier").alias("outcome"))
    ambiguous = matches.ambiguous.select("source_type", "target_type", F.lit("ambiguous").alias("outcome"))
    unmatched = matches.unmatched.select(F.col("entity_type").alias("source_type"), F.coalesce("target_type", F.lit("unknown")).alias("target_type"), F.lit("unmatched").alias("outcome"))
    n = {k: F.count_if(F.col("outcome") == k) for k in ("tier1_exact", "tier2_composite", "tier3_fuzzy", "ambiguous", "unmatched")}
    linked = n["tier1_exact"] + n["tier2_composite"] + n["tier3_fuzzy"]
    return links.unionByName(ambiguous).unionByName(unmatched).groupBy("source_type", "target_type").agg(
        F.count("*").alias("entities"), *(c.alias(k) for k, c in n.items()), (linked / F.count("*")).alias("match_rate"), (n["ambiguous"] / F.count("*")).alias("ambiguity_rate"), (n["unmatched"] / F.count("*")).alias("unmatched_rate")
    )
