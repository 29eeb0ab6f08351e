"""Text and scalar functions as column expressions; regular expressions are Unicode-aware throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expansions of raw statement names, in order; the first that changes a name is taken.
EXPANSIONS = [
    (r"\bWHOLEFDS\s+MKT\b.*", "Whole Foods Market"),
    (r"\bWHOLEFDS\b.*", "Whole Foods"),
    (r"\bWFM\b.*", "Whole Foods"),
    (r"\bSTARBUCKS\s*(?:STORE\s*)?\s*#?\d+.*", "Starbucks"),
    (r"\bDELTA AIR(?:\s+LINES?)?\s*\d+.*", "Delta"),
    (r"\bUBER\s*\*\s*\w+.*", "Uber"),
    (r"\bLYFT\s*\*\w+.*", "Lyft"),
    (r"\bMARRIOTT\s+(?:INTL|SF|NYC|LA|CHICAGO|DOWNTOWN|HOTELS?)\b.*", "Marriott"),
    (r"\bAIRBNB\s*\*\s*\w+.*", "Airbnb"),
    (r"\bAIRBNB\s+INC\b.*", "Airbnb"),
    (r"\bAWS\s+EMEA\b.*", "Amazon Web Services"),
    (r"\bWEWORK\b.*", "WeWork"),
    (r"\bDOORDASH\b.*", "DoorDash"),
    (r"\bINTUIT\s*\*\s*QUICKBOOKS\b.*", "QuickBooks"),
    (r"\bCOSTCO\s+WHSE\b.*", "Costco"),
    (r"\bTRADER\s+JOE\s+S\b.*", "Trader Joes"),
]
# Personal data and what stands for it, in order.
PERSONAL = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b(?:\d{4}[- ]?){3}\d{4}\b", "[CC]"),
    (r"\b\+?1?\s*\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b", "[PHONE]"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
]
# Secrets in messages, in order.
SECRETS = [
    r"(?i)Bearer\s+\S+",
    r"(?i)Basic\s+[A-Za-z0-9+/=]+",
    r"(?i)\bdapi[a-f0-9]{32}\b",
    r"(?i)(token|key|password|secret|credential)\s*=\s*\S+",
    r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    r"[A-Za-z0-9+/=]{40,}",
]
# Words that approve a payment, in order.
APPROVALS = ("approved", "authorize", "authorized", "go ahead", "proceed", "looks good", "lgtm", "approved for payment", "please pay")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_raw_name(name: Column) -> Column:
    """At least 70 % of the letters are upper case; false without letters."""
    upper, letters = F.length(F.regexp_replace(name, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return F.coalesce(F.try_divide(upper, letters) >= 0.7, F.lit(False))


def expanded_name(name: Column) -> Column:
    """Statement abbreviations of raw names written out."""
    out = name
    for pattern, full in reversed(EXPANSIONS):
        out = F.when(name.rlike(f"(?iU){pattern}"), F.regexp_replace(name, f"(?iU){pattern}", full)).otherwise(out)
    return F.when(is_raw_name(name), out).otherwise(name)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def merchant(name: Column) -> Column:
    """Comparable merchant name: expanded, lower case, without legal forms, punctuation and filler words."""
    s = F.regexp_replace(F.lower(expanded_name(name)), r"(?U)\b(llc|inc|corp|ltd|co)\b\.?", "")
    s = _squeezed(F.regexp_replace(s, r"(?U)[^\w\s]", " "))
    return _squeezed(F.regexp_replace(s, r"(?U)\b(the|a|and|&)\b", ""))


def subject(text: Column) -> Column:
    """Comparable subject: lower case, without one reply prefix, amounts and punctuation."""
    s = F.regexp_replace(F.lower(text), r"(?U)^(re|fwd|fw)\s*:\s*", "")
    s = F.regexp_replace(s, r"(?U)\$[\d,]+(?:\.\d{1,2})?", "")
    return _squeezed(F.regexp_replace(s, r"(?U)[^\w\s]", " "))


def email_address(c: Column) -> Column:
    clean = F.lower(stripped(c))
    return F.when(F.contains(clean, F.lit("@")), clean)


def comparable(field: str, c: Column) -> Column:
    """The normal form that a field is compared in."""
    return merchant(c) if field in ("merchant_name", "name") else subject(c) if field == "subject" else stripped(F.lower(c))


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.datediff(F.to_date(a), F.to_date(b))) <= days


def amounts_agree(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Exact without tolerance; else the difference against the larger magnitude; two zeros agree."""
    if not tolerance:
        return a == b
    return ((a == 0) & (b == 0)) | F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))) <= tolerance, F.lit(False))


def masked(c: Column) -> Column:
    for pattern, sign in PERSONAL:
        c = F.regexp_replace(c, f"(?U){pattern}", sign)
    return c


def redacted(kind: Column, message: Column, most: int = 500) -> Column:
    """``kind: first line`` without secrets, cut to ``most`` characters with dots at the end."""
    line = F.split(message, "\n", 2)[0]
    for pattern in SECRETS:
        line = F.regexp_replace(line, pattern, "[REDACTED]")
    whole = F.concat(kind, F.lit(": "), line)
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole)


def user_hash(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, length)


def with_midnight(c: Column) -> Column:
    """A bare ISO date gets midnight UTC."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00Z"))).otherwise(c)


def fuzzy_key(source_field: Column, target_field: Column, score: Column) -> Column:
    pair = F.when(source_field == target_field, source_field).otherwise(F.concat(source_field, F.lit("->"), target_field))
    return F.concat(F.lit("fuzzy:"), pair, F.lit(":"), F.format_string("%.2f", score))


def calendar_features(amount: Column, day: Column, vendor: Column) -> list[Column]:
    """log of the amount, weekday (Monday 0), day of month, and a stable vendor bucket."""
    return [F.log1p(F.greatest(amount, F.lit(0.0))).alias("log_amount"), F.weekday(day).cast("double").alias("weekday"), F.dayofmonth(day).cast("double").alias("day"), (F.conv(F.substring(F.md5(F.coalesce(vendor, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % 1000).cast("double").alias("vendor_bucket")]


def unknown_slug(name: Column) -> Column:
    return F.concat(F.lit("unknown_"), F.lower(F.replace(name, F.lit(" "), F.lit("_"))))


def stable_id(*parts: Column) -> Column:
    """Reproducible identifier of its parts; nulls are told apart from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)


def token_cost(model: Column, tokens: Column, prices: dict[str, float]) -> Column:
    """Tokens times the model's price; unknown models cost nothing."""
    pairs = [F.lit(x) for kv in prices.items() for x in kv]
    return (F.coalesce(F.element_at(F.create_map(*pairs), model), F.lit(0.0)) * tokens).cast("decimal(10,4)") if pairs else F.lit(0).cast("decimal(10,4)")


def own_grams(c: Column) -> Column:
    """The distinct runs of three characters of a name, of a shorter one itself: a text that contains it has all of them
    among its ``grams``."""
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(.{3}))"), F.lit(1))))


def grams(c: Column) -> Column:
    """The distinct runs of at most three characters of a text, the empty one too: keys for an equi-join before ``contains``."""
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?s)(?=(.{1,3}))"), F.lit(1)))  # at every place, the longest
    every = F.transform(F.array(runs), lambda r: F.concat(F.array(F.lit("")), r, F.transform(r, lambda g: F.substring(g, 1, 1)), F.transform(r, lambda g: F.substring(g, 1, 2))))
    return F.array_distinct(F.flatten(every))  # within an array of one, so that the runs are found once
