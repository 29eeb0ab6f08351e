import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import fim, merkle, pii


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------------------------------------ fill in the middle


UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*|[ \t\n\x0b\x0c\r]+", "char": r"(?s)."}


def brute_fim(row, unit="line", rate=100, spm=50, seed=7):
    text, h = row[1] or "", sha(f"{seed}:{'' if row[0] is None else row[0]}")
    draws, units = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)], re.findall(UNITS[unit], text)
    a, b = sorted(d % (len(units) + 1) for d in draws[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= rate:
        return (row[0], len(units), "plain", None, None, text, text)
    form = "spm" if draws[3] % 100 < spm else "psm"
    return (row[0], len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text)


ODD = ["\n", "\n\n", "a", "a\n", "\na", "é\nü\n\nß", "a <P> b\nc", "<S", "<M>", "<\nP>\n<", "x\r\ny\r\n", "\u2028line\u2028", "𝒳\n𝒴 𝒵", " lead\n  and trail  "]


@pytest.mark.parametrize(("unit", "rate"), [("line", 100), ("word", 60), ("char", 100)])
def test_fill_in_the_middle(spark, docs, rows, none, unit, rate):
    odd = [(20_000 + i, t) for i, t in enumerate(ODD)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    found = fim.restore(fim.transform(table, unit=unit, rate=rate)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((brute_fim(r, unit, rate) for r in [*rows, *odd]), key=str)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(none)).count() == 0


def test_fill_in_the_middle_digests(docs, rows):
    want = [(*b[:5], sha(b[5]), sha(b[6])) for b in map(brute_fim, rows)]
    assert sorted(map(tuple, fim.digests(docs).collect()), key=str) == sorted(want, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n é<PSM>\U0001d4b3", max_size=12), min_size=1, max_size=6), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from(list(UNITS)))
def test_cuts_of_sliced_batches(texts, first, second, unit):
    import numpy as np
    import pyarrow as pa

    column = pa.array(["before", *texts], pa.large_string()).slice(1)
    borders, data = fim.buffers(column)
    units, one, two = fim.cuts(data, borders, unit, np.full(len(texts), first), np.full(len(texts), second))
    for i, t in enumerate(texts):
        found = re.findall(UNITS[unit], t)
        a, b = sorted(d % (len(found) + 1) for d in (first, second))
        assert units[i] == len(found)
        assert (one[i] - borders[i], two[i] - borders[i]) == tuple(len("".join(found[:k]).encode()) for k in (a, b))


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("<P>", "x<P>y", "<M>")])
def test_marks_that_overlap(marks):
    with pytest.raises(ValueError):
        fim.checked(marks)


# --------------------------------------------------------------------------------------------------------- manifest


def brute_fields(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves):
    """Root and, for each leaf, its siblings as (left, right) of every level."""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, node in enumerate(at):
            low = node - node % 3
            proofs[i].append(("".join(level[low:node]), "".join(level[node + 1 : low + 3])))
        level, at = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)], [n // 3 for n in at]
    return level[0], proofs


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, brute_fields(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3]), *brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])])) for s in names}
    root, tops = brute_tree([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        leaves, subroot, proofs = trees[s]
        for (_, _, leaf, r), own in zip(leaves, proofs, strict=True):
            hit = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
            node = brute_fields((*r[:4], r[4] and r[4].replace("\n", ""))) if hit else leaf
            for left, right in own + top:
                node = sha(left + node + right)
            out.append((r[0], leaf, subroot, root, sha("".join(a + b for a, b in own + top)), node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest(docs, rows, none, levels):
    want = brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    found = [tuple(r) for r in merkle.digests(docs.withColumn("tree", F.lit(1)).withColumn("pos", F.lit("x")), levels=levels).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {f[-1] for f in found} == {True, False}
    if levels == 1:
        assert merkle.digests(none).count() == 0


def test_proofs_find_any_change(spark):
    table = spark.range(800).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.concat(F.lit("text "), "id").alias("text"))
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    proven = merkle.prove(table, fields, changed={"n_chars": F.when(F.col("doc_id") % 50 == 7, 2).otherwise(F.col("n_chars"))}, levels=2)
    bad = proven.where(merkle.folded(F.col("changed_leaf"), F.col("proof")) != F.col("root"))
    assert sorted(r["doc_id"] for r in bad.collect()) == list(range(7, 800, 50))
    assert proven.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 800
    assert proven.select("root").distinct().count() == 1


def test_no_task_holds_a_hot_group(spark):
    table = spark.range(0, 6000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("x").alias("text"))
    numbered = merkle.numbered(table.select(F.lit("=hot").alias("tree"), F.col("doc_id").alias("__key"), merkle.leaf([F.col("doc_id")]).alias("digest")), ["__key"])
    assert [r["pos"] for r in numbered.orderBy("__key").select("pos").collect()] == list(range(6000))
    blocks = merkle.blocks_of(numbered, 5).collect()
    assert len(blocks) == 25 and max(len(b["items"]) for b in blocks) == 243


# ---------------------------------------------------------------------------------------------------- personal data


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


PERSONAL = [
    "write to a.b+c@mail.example.com. or x@y, x@y.z@w.v and @a.b", "é@a.bc josé.maría@exämple.es", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1..2.3.4.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111111111111111", "+1 (555) 555-0100 +12 +1....2 +1 234 567 89 ++49-30-1234567",
    "name (at) host dot com", "jo.smith [at] example [dot] org", "IBAN: DE89 3704 0044 0532 0130 00 AND MORE", "iban GB82WEST12345698765432", "SSN 123-45-6789, ssn 000-12-3456",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "Password: hunter22!", "a token of love", "account 12345678 and passport no. X1234567", "https://me:secret@localhost/x http://[2001:db8::1]:80/ fe80::1:2:3 std::vector a::b",
    "９９ ＠ full", "0" * 5000 + "." + "1." * 4, "+" + "1" * 10, "+1" + "." * 3000, "a" * 3000 + "@b.c",
]


def test_base_spans_of_odd_texts():
    for text in PERSONAL:
        assert [s[:3] for s in pii.spans_of(text) if s[3]] == brute_spans(text), text


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+ 019()é:%/[]", max_size=60))
def test_base_spans_of_any_text(text):
    spans = pii.spans_of(text)
    assert [s[:3] for s in spans if s[3]] == brute_spans(text)
    more = sorted(s[1:3] for s in spans if not s[3])
    assert all(a < b for a, b in more) and all(a[1] <= b[0] for a, b in zip(more, more[1:], strict=False))
    assert not any(a < s[2] and s[1] < b for a, b in more for s in spans if s[3])


def shown(text):
    return [(k, text[a:b]) for k, a, b, base in pii.spans_of(text) if not base]


def test_spans_beyond_the_base():
    assert shown(PERSONAL[1]) == [("email", "é@a.bc"), ("email", "josé.maría@exämple.es")]
    assert shown("josé@exämple.es") == [("email", "josé@exämple.es")]
    assert shown(PERSONAL[5]) == [("email", "name (at) host dot com")]
    assert shown(PERSONAL[6]) == [("email", "jo.smith [at] example [dot] org")]
    assert shown(PERSONAL[7]) == [("account", "DE89 3704 0044 0532 0130 00")] and shown(PERSONAL[8]) == [("account", "GB82WEST12345698765432")]
    assert shown(PERSONAL[9]) == [("account", "123-45-6789")]
    assert shown(PERSONAL[10]) == [("account", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")] and shown(PERSONAL[11]) == [("account", "hunter22")]
    assert shown(PERSONAL[13]) == [("account", "12345678"), ("account", "X1234567")]
    assert shown(PERSONAL[14]) == [("address", "2001:db8::1"), ("address", "fe80::1:2:3"), ("account", "me:secret")]


def test_clean_texts_have_no_spans():
    for text in (PERSONAL[12], "std::map<int, x::y> a", "@property def f(self): return 3.14", "the account of 2024, page 12: see 10.5.3", "passport control", "meet at 10:30 (at) noon. Dot"):
        assert pii.spans_of(text) == []


def test_personal_data_queries(spark, docs, rows, none):
    odd = [(30_000 + i, t) for i, t in enumerate(PERSONAL)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("spans", F.lit("clash"))
    found = {r["doc_id"]: r for r in pii.digests(table).collect()}
    for key, text in [*((r[0], r[1]) for r in rows), *odd]:
        base = brute_spans(text)
        assert found[key]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [found[key][f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in pii.BASE]
        assert found[key]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pii.spans_of(text))
    assert pii.digests(table).count() == len(rows) + len(odd) and pii.digests(none).count() == 0
    clean = {r["doc_id"]: r["redacted"] for r in pii.redact(table).collect()}
    assert clean[30_000] == "write to <EMAIL>. or x@y, <EMAIL>@w.v and @a.b" and clean[30_010] == 'token = "<ACCOUNT>"' and clean[10_002] == ""
