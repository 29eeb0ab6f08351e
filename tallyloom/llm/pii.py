"""Personal data by anchor expansion: an automaton finds cues, local parsers expand and check what stands around them.

One Aho-Corasick pass over a text reports its anchors: at-signs, plus signs, digits, ``://``, double colons and cue words
such as ``iban`` or ``password``. Each anchor is handed to a parser that looks only at its surroundings:

* ``email`` - the run of local characters before the sign and the labels behind it; also ``name (at) host (dot) tld``, and
  addresses with letters beyond ASCII.
* ``ip`` - chains of dotted numbers in groups of four, each at most 255.
* ``card`` - digits with single blanks or hyphens between, 13 to 19 that pass Luhn's check.
* ``phone`` - a plus sign, digits and the signs between, 9 to 15 digits.
* ``address`` - IPv6, in a url or on its own.
* ``account`` - what follows a cue: bank accounts (checked by their remainder of 97), social security numbers, numbers of
  accounts and passports, tokens and passwords; and names with passwords in urls.

Spans of the first four kinds that the plain patterns of the contract give are ``base``; they are found whatever stands
around them, leftmost first, without overlaps within a kind. Other spans never overlap a base span or each other.
Anchors are read once from left to right and each parser starts where its last find ended, so the work is linear.

Defined results: null and empty texts have no spans; positions count code points, the end is exclusive; repeated rows get
one result each; a text of any length is read whole; an empty table gives an empty table; extra columns are ignored by
``find`` and pass through ``redact``.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from itertools import islice, takewhile

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyloom.llm.common import slices, small_batches, trimmed

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# Words before what identifies somebody, by the check of what follows.
CUES = {
    "bank": ("iban",),
    "social": ("ssn", "social security number", "social security no"),
    "number": ("account", "account number", "account no", "acct", "passport", "passport number", "passport no", "driver license", "licence number", "license number", "tax id", "customer number", "member number"),
    "secret": ("token", "password", "passwd", "secret", "api key", "api_key", "apikey", "access key", "access_key", "secret_key"),
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = ("(at)", "[at]", "{at}")
_SPELT = re.compile(r" ?[(\[{]at[)\]}] ?([A-Za-z0-9-]+(?:(?: ?[(\[{]dot[)\]}] ?|\.| dot )[A-Za-z0-9-]+)+)", re.I)
_USERINFO = re.compile(r"[^\s/?#@]{1,256}@")
_BRACKETED = re.compile(r"\[([0-9A-Fa-f:.]{2,45})\]")
_HEX = frozenset("0123456789abcdefABCDEF:")
_VALUE = {
    "bank": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "social": re.compile(r"(?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])"),
    "number": re.compile(r"[A-Z0-9](?:-?[A-Z0-9]){5,33}(?![A-Za-z0-9])"),
    "secret": re.compile(r"[A-Za-z0-9_+/=.!@#$%^&*-]{8,512}"),
}
_LINK = re.compile(r"[ \t]*(?:(?:no|nr|number|id|is)\b\.?)?[ \t]*[:=#]?[ \t]*[\"']?", re.I)
_ASSIGN = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")


def luhn(digits: str) -> bool:
    """Do the digits pass the check: from the right, every second one doubled, sum of all digits divisible by ten?"""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def bank_account(value: str) -> bool:
    """Is the remainder of 97 right, with the first four signs last and letters as numbers from 10?"""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _accepts(kind: str, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    match kind:
        case "bank":
            return bank_account(value)
        case "number":
            return digits >= 5
        case "secret":
            return digits >= 2 and any(c.isalpha() for c in value) and len(value) >= 8
    return True


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for anchor in ("@", "＠"):
        out.add_word(anchor, ("at", 1, ""))
    for anchor in (v for a in _AT for v in (a, a.upper())):
        out.add_word(anchor, ("spelt", len(anchor), ""))
    for digit in "0123456789":
        out.add_word(digit, ("digit", 1, ""))
    out.add_word("+", ("plus", 1, ""))
    out.add_word("://", ("scheme", 3, ""))
    out.add_word("::", ("colons", 2, ""))
    for kind, words in CUES.items():
        for word in words:
            for shape in {word, word.upper(), word.title(), word.capitalize()}:
                out.add_word(shape, ("cue", len(shape), kind))
    out.make_automaton()
    return out


_anchors: ahocorasick.Automaton | None = None


def _back(text: str, at: int, low: int, inside) -> int:
    """Start of the run of characters that ends before ``at``."""
    while at > low and inside(text[at - 1]):
        at -= 1
    return at


def _wide(c: str) -> bool:
    return c in _LOCAL or c.isalnum()


class _Reader:
    """The finds of one text."""

    def __init__(self, text: str) -> None:
        self.text, self.base, self.more = text, [], []
        self.free = dict.fromkeys((*KINDS, "spelt"), 0)  # where a parser may start again

    def at(self, i: int, _: str) -> None:
        text, low = self.text, self.free["email"]
        start = _back(text, i, low, _LOCAL.__contains__)
        found = _DOMAIN.match(text, i + 1) if start < i and text[i] == "@" else None
        if found:
            self.base.append(("email", start, found.end()))
            self.free["email"] = found.end()
        start, right = _back(text, i, max(low, i - 64), _wide), _WIDE_DOMAIN.match(text, i + 1, i + 256)
        if start < i and right and not (found and start == self.base[-1][1] and right.end() <= found.end()):
            self.more.append(("email", start, right.end()))

    def spelt(self, i: int, _: str) -> None:
        blank = self.text[i - 1 : i] == " "
        start = _back(self.text, i - blank, max(self.free["spelt"], i - 65), _LOCAL.__contains__)
        found = _SPELT.match(self.text, i - blank, i + 300)
        if found and start < i - blank:
            self.more.append(("email", start, found.end()))
            self.free["spelt"] = found.end()

    def digit(self, i: int, _: str) -> None:
        if i >= self.free["ip"]:
            chain = _DOTTED.match(self.text, i)
            self.free["ip"] = chain.end()
            if chain.group().count(".") >= 3:
                runs = list(re.finditer("[0-9]+", chain.group()))
                for k in range(0, len(runs) - 3, 4):
                    if all(len(v := r.group().lstrip("0")) <= 3 and int(v or 0) <= 255 for r in runs[k : k + 4]):
                        self.base.append(("ip", i + runs[k].start(), i + runs[k + 3].end()))
        if i >= self.free["card"]:
            chain = _CARD.match(self.text, i)
            self.free["card"] = chain.end()
            digits = chain.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                self.base.append(("card", i, chain.end()))

    def plus(self, i: int, _: str) -> None:
        found = _PHONE.match(self.text, i)
        if found and 9 <= sum(c in "0123456789" for c in found.group()) <= 15:
            self.base.append(("phone", i, found.end()))

    def scheme(self, i: int, _: str) -> None:
        if not (i and self.text[i - 1].isalpha()):
            return
        start, user = i + 3, _USERINFO.match(self.text, i + 3)
        if user:
            start = user.end()
            if ":" in user.group():
                self.more.append(("account", i + 3, start - 1))
        if (host := _BRACKETED.match(self.text, start)) and self._six(host.group(1)):
            self.more.append(("address", host.start(1), host.end(1)))
            self.free["address"] = host.end()

    def colons(self, i: int, _: str) -> None:
        if i < self.free["address"]:
            return
        start, stop = _back(self.text, i, max(0, i - 40), _HEX.__contains__), i + 2
        while stop < min(len(self.text), i + 45) and self.text[stop] in _HEX:
            stop += 1
        self.free["address"] = stop
        alone = not (self.text[start - 1 : start] if start else "").isalnum() and not self.text[stop : stop + 1].isalnum()
        if alone and self._six(self.text[start:stop]) and sum(map(bool, self.text[start:stop].split(":"))) >= 3:
            self.more.append(("address", start, stop))

    @staticmethod
    def _six(value: str) -> bool:
        try:
            return bool(ipaddress.IPv6Address(value))
        except ValueError:
            return False

    def cue(self, i: int, kind: str, size: int = 0) -> None:
        text, stop = self.text, i + size
        if (i and text[i - 1].isalnum()) or text[stop : stop + 1].isalpha():
            return
        link = (_ASSIGN if kind == "secret" else _LINK).match(text, stop, stop + 40)
        found = _VALUE[kind].match(text, link.end()) if link else None
        value = found.group().rstrip(".,;!?") if found else ""
        while kind == "bank" and " " in value and not bank_account(value):  # words in capitals may follow
            value = value[: value.rindex(" ")]
        if value and _accepts(kind, value):
            self.more.append(("account", found.start(), found.start() + len(value)))

    def spans(self) -> list[tuple[str, int, int, bool]]:
        """Base finds and those of the others that overlap none before, by kind and start."""
        taken, last = sorted((s, e) for _, s, e in self.base), -1
        out, k = [(*b, True) for b in self.base], 0
        for kind, start, stop in sorted(self.more, key=lambda x: (x[1], -x[2])):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if start >= last and not any(start < e for _, e in takewhile(lambda x, stop=stop: x[0] < stop, islice(taken, k, None))):
                out.append((kind, start, stop, False))
                last = stop
        return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of every find, by kind and start."""
    global _anchors
    if not text:
        return []
    _anchors = _anchors or _automaton()
    reader = _Reader(text)
    for stop, (name, size, kind) in _anchors.iter(text):
        i = stop - size + 1
        if name == "cue":
            reader.cue(i, kind, size)
        elif name != "digit" or i >= reader.free["ip"] or i >= reader.free["card"]:
            getattr(reader, name)(i, kind)
    return reader.spans()


def _with(docs: DataFrame, text: str, kept: list[str], made: StructField, work) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield pa.RecordBatch.from_arrays([*(column[c] for c in kept), work(column[text])], names=[*kept, made.name])

    return docs.mapInArrow(trimmed(run), StructType([*(docs.schema[c] for c in kept), made]))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end, base>>), spans by kind as in KINDS, then by start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    work = lambda texts: pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans_of(t)] for t in texts.to_pylist()], kind)
    made = StructType.fromDDL(f"spans {SPANS}")["spans"]
    return _with(docs.select(key, text), text, [key], made, work)


def redacted(text: str | None) -> str | None:
    """The text with the name of its kind in place of every span; of overlapping spans the one that starts first counts."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, stop, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, stop)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", into: str = "redacted") -> DataFrame:
    """``docs`` with a column of texts without personal data."""
    return _with(docs, text, docs.columns, StructType.fromDDL(f"`{into}` string")[into], lambda texts: pa.array([redacted(t) for t in texts.to_pylist()], pa.string()))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone long, base_sha256, spans string): counts and digest of the base spans, all spans."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, (lambda kind: lambda s: s["kind"] == kind)(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return find(docs, key, text).select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
