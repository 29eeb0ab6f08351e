import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import groupjoin, lines, lm, quality, substring


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


# ------------------------------------------------------------------------------------------------ substring dedup


def brute_substrings(rows, window):
    first, out = {}, []
    keyed = sorted(((-(1 << 63) if r[0] is None else r[0], words(r[1]), r) for r in rows), key=lambda x: x[0])
    for i, w, _ in keyed:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (i, p)), (i, p))
    for i, w, r in keyed:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        out.append((r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [20, 4])
def test_substring_digests(docs, rows, window):
    assert sorted(map(tuple, substring.digests(docs, window).collect()), key=str) == brute_substrings(rows, window)


def test_substring_text_keeps_order_and_columns(docs, none):
    out = substring.deduplicate(docs, 20)
    assert out.schema == docs.schema and out.count() == docs.count()
    hashes = {tuple(r)[:1] + (r["kept_sha256"],) for r in substring.digests(docs, 20).collect()}
    assert {(r["doc_id"], hashlib.sha256(b" ".join(words(r["text"]))).hexdigest()) for r in out.collect()} == hashes
    assert substring.digests(none).count() == 0


def test_substring_across_small_blocks(docs, rows, monkeypatch):
    from tallyloom.llm import common

    monkeypatch.setattr(substring, "pack_blocks", lambda d, t: common.pack_blocks(d, t, 3000))
    assert sorted(map(tuple, substring.digests(docs, 20).collect()), key=str) == brute_substrings(rows, 20)


def test_no_range_meets_a_shared_passage_more_than_once_a_block(spark, monkeypatch):
    """A third of all documents share passages of 12, 25 and 60 words, each between words of its own."""
    from tallyloom.llm import common

    draw, rows = random.Random(4), []
    passages = [[f"p{n}_{i}" for i in range(n)] for n in (12, 25, 60)]
    for i in range(1200):
        own = [f"w{draw.randrange(10**6)}" for _ in range(40)]
        rows.append((i, " ".join([*own[:20], *passages[i % 9], *own[20:]] if i % 9 < 3 else own)))
    whole = substring.level_one

    def counted(found, block):
        import numpy as np

        key = np.sort(found["half"] if "half" in found else found["whole"])
        if len(key) and np.diff(np.flatnonzero(np.r_[True, np.diff(key) != 0, True])).max() > 40:
            raise AssertionError("a hot key")
        return whole(found, block)

    monkeypatch.setattr(substring, "level_one", counted)
    monkeypatch.setattr(substring, "pack_blocks", lambda d, t: common.pack_blocks(d, t, 30_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, substring.digests(docs, 20).collect()), key=str) == brute_substrings(rows, 20)


# ------------------------------------------------------------------------------------------------ Jaccard join


def shingles(text, k=5):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_classes(rows, percent=75):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    ids = [(-(1 << 63) if r[0] is None else r[0]) for r in rows]
    sets = [shingles(r[1]) for r in rows]
    for a in range(len(rows)):
        find(ids[a])
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    known = lambda i: None if i == -(1 << 63) else i
    return sorted(((known(i), len(s), known(find(i))) for i, s in zip(ids, sets, strict=True)), key=str)


@pytest.mark.parametrize("percent", [75, 40])
def test_classes(docs, rows, percent):
    assert sorted(map(tuple, groupjoin.link_classes(docs, 5, percent).collect()), key=str) == brute_classes(rows, percent)


def test_hot_postings_are_divided(docs, rows, monkeypatch):
    monkeypatch.setattr(groupjoin, "HOT", 3)
    met = []
    whole = groupjoin.hot_postings
    monkeypatch.setattr(groupjoin, "hot_postings", lambda r: met.append(whole(r)) or met[-1])
    assert sorted(map(tuple, groupjoin.link_classes(docs, 5, 40).collect()), key=str) == brute_classes(rows, 40)
    assert len(met[0][0]) and met[0][1].max() > 1


def test_a_hot_posting_of_one_component_sends_nothing(spark):
    """200,000 entries of one posting: in one component no tile gets an entry; with one entry apart, those tiles do that meet it."""
    rows = spark.range(0, 200_000, 1, 4).select("id", F.lit(5).cast("long").alias("comp"), F.lit(10).cast("long").alias("n"), F.array(F.lit(77).cast("long")).alias("tokens"), F.array(F.lit(0)).alias("places"))
    hot = groupjoin.hot_postings(rows)
    assert hot[1].tolist() == [10]
    seen = lambda token, ident, comp, n, place: __import__("pyarrow").table({"a": [len(token)], "b": [len(set(comp.tolist()))]})
    assert groupjoin._in_ranges(rows, 16, seen, "a long, b long", hot, tiles=True).count() == 0
    other = rows.withColumn("comp", F.when(F.col("id") == 123_456, 9).otherwise(F.col("comp")))
    tiles = groupjoin._in_ranges(other, 16, seen, "a long, b long", hot, tiles=True).collect()
    assert len(tiles) == 10 and all(t["b"] == 2 and t["a"] <= 2.2 * groupjoin.HOT for t in tiles)


def test_rows_without_an_id(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(None, same), (None, "other words of a row without any id"), (3, same), (4, "Other words of a row without any id"), (5, "five other words that stand alone")]
    got = groupjoin.link_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)


def test_members_of_entries_whose_heads_dont_link(spark):
    """Pairs that only members form: sets of one size and prefix, some of them far from their head."""
    draw = random.Random(2)
    pool = [f"s{i}" for i in range(24)]
    rows = [(i, " ".join(draw.sample(pool, 14))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = groupjoin.link_classes(df, shingle=1, percent=60)
    sets = {i: set(t.split()) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == comp


def edited(base: list[str], name: str, edits: int, at: int) -> str:
    """``base`` with words of its own at ``edits`` places that lie apart."""
    words = list(base)
    for k in range(edits):
        words[(at + k * (len(base) // edits)) % len(base)] = f"{name}_{k}"
    return " ".join(words)


@pytest.mark.parametrize("order", ["far first", "far last"])
def test_near_copies_without_a_text_that_all_are_near_to(spark, monkeypatch, order):
    """Copies three words from a text that is not there: none links with another, some with copies one word from it.

    Their pairs pass the length and position filters; no more than a few for each entry may be formed.
    """
    met = []
    verified = groupjoin.verified
    monkeypatch.setattr(groupjoin, "verified", lambda pairs, *a: met.append(pairs.count()) or verified(pairs, *a))
    base = [f"w{i}" for i in range(150)]
    texts = [edited(base, f"far{i}", 3, i) for i in range(150)] + [edited(base, f"near{i}", 1, i) for i in range(60)]
    texts += [edited([f"v{i}" for i in range(150)], f"lone{i}", 3, i) for i in range(100)]
    rows = list(enumerate(texts if order == "far first" else texts[::-1]))
    got = groupjoin.link_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)
    assert max(met) <= groupjoin.FEW * len(rows)


@pytest.mark.parametrize("crowd, few, bits", [(2, 0, 256), (2, 1, 64), (2, 1000, 2048)])
def test_sketches_lose_no_link(docs, rows, monkeypatch, crowd, few, bits):
    for name, value in (("CROWD", crowd), ("FEW", few), ("BITS", bits)):
        monkeypatch.setattr(groupjoin, name, value)
    assert sorted(map(tuple, groupjoin.link_classes(docs, 5, 40).collect()), key=str) == brute_classes(rows, 40)
    draw = random.Random(2)
    pool = [f"s{i}" for i in range(24)]
    members = [(i, " ".join(draw.sample(pool, 14))) for i in range(60)]
    got = groupjoin.link_classes(docs.sparkSession.createDataFrame(members, "doc_id long, text string"), shingle=1, percent=60)
    sets = {i: set(t.split()) for i, t in members}
    comp = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == comp


def test_many_near_copies_of_one_text(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:k], f"edit{i}", *base[k + 1 :]])) for i, k in enumerate(j * 7 % 60 for j in range(150))]
    rows += [(1000 + i, " ".join([*base[:40], *(f"other{i}_{j}" for j in range(20))])) for i in range(30)]
    got = groupjoin.link_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)


def test_one_document_of_each_class_stays(docs, rows, none):
    comp = {i: c for i, _, c in brute_classes(rows)}
    out = groupjoin.deduplicate(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(comp.values())
    assert groupjoin.link_classes(none).count() == 0


def test_one_row_of_repeated_and_missing_ids_stays(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    rows = [(5, text["a"], 1), (5, text["a"], 1), (5, text["a"].upper() + "\n", 2), (5, text["b"], 3), (6, text["a"], 4), (6, text["b"], 4)]
    rows += [(None, text["c"], 5), (None, text["c"], 6), (None, text["c"] + " end", 7), (None, text["d"], 8), (9, text["d"], 9), (10, text["e"], 10), (None, None, 11), (None, "", 11), (11, text["f"], 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    out = [tuple(r) for r in groupjoin.deduplicate(docs).collect()]
    same = lambda t: " ".join((t or "").lower().split())
    left = sorted(((i, same(t)[:5]) for i, t, _ in out), key=str)
    assert left == sorted([(5, text["a"][:5]), (5, text["b"][:5]), (None, text["c"][:5]), (None, text["d"][:5]), (10, text["e"][:5]), (None, ""), (11, text["f"][:5])], key=str)
    assert out and all(r in rows for r in out) and sorted(out, key=str) == sorted(map(tuple, groupjoin.deduplicate(docs.repartition(2)).collect()), key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, k) for k in range(201, 230)]
    got = {r["node"]: r["comp"] for r in groupjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, **{k: 200 for k in range(200, 230)}}


# ------------------------------------------------------------------------------------------------ language model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(docs, rows, order):
    mass = 50.0
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    texts = [[*words(r[1], lower=True), None] for r in rows]
    counts = Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            for k in range(1, order + 1):
                counts.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    n = sum(v for k, v in counts.items() if len(k) == 1)
    v = sum(1 for k in counts if len(k) == 1)
    want = []
    for r, t, h in zip(rows, texts, held, strict=True):
        base = score = 0.0
        for i, w in enumerate(t):
            p = (counts[(w,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                if i >= k - 1:
                    p = (counts[tuple(t[i - k + 1 : i + 1])] + mass * p) / (counts[tuple(t[i - k + 1 : i])] + mass)
            score += math.log10(p)
        want.append((r[0], h, len(t), sum(counts[(w,)] > 0 for w in t), n, round(base, 5), round(score, 5)))
    got = [(*tuple(r)[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in lm.score(docs, lm.default_held_out(), order, mass).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_registered_language_model_has_trigrams(spark, tmp_path):
    from tallyloom.llm import queries

    spark.createDataFrame([(i, "a b c d a b e c a b c") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_lm_scoring(spark, str(tmp_path))
    want = lm.score(spark.read.parquet(f"{tmp_path}/documents.parquet"), lm.default_held_out(), order=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_language_model_without_text(none):
    assert lm.score(none, lm.default_held_out()).count() == 0


def test_probabilities_sum_to_one(spark):
    rows = [(0, "a b a c a b"), (1, "b a"), *((100 + i, w) for i, w in enumerate(["a a", "a b", "a c", "a zzz", "a"]))]
    out = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100, 2, 5.0).collect()}
    first = 10 ** lm_first(out)
    after_a = [10 ** out[100 + i]["score"] / first for i in range(4)]
    ends = {"a": 4, "b": 3, "c": 1, None: 2}
    n, v = 10, 4
    arcs = {("a", "b"): 2, ("a", "c"): 1, ("a", None): 1}
    p = {w: (arcs.get(("a", w), 0) + 5 * (ends.get(w, 0) + 1) / (n + v + 1)) / (4 + 5) for w in ("a", "b", "c", None, "zzz")}
    assert sum(p.values()) == pytest.approx(1.0)
    for got, (w, tail) in zip(after_a, [("a", "a"), ("b", "b"), ("c", "c"), ("zzz", "zzz")], strict=True):
        c_tail = {"a": 4, "b": 3, "c": 1}.get(tail, 0)
        end = ({("a", None): 1, ("b", None): 1}.get((tail, None), 0) + 5 * 3 / 15) / (c_tail + 5)
        assert got == pytest.approx(p[w] * end, rel=1e-6)


def lm_first(out):
    return math.log10(5 / 15)


# ------------------------------------------------------------------------------------------------ quality rules


def test_base_counts(docs, rows):
    want = []
    for r in rows:
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {q for p in range(len(w) - 2) if c[w[p], w[p + 1], w[p + 2]] > 1 for q in (p, p + 1, p + 2)}
        seen, twice = set(), 0
        for x in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                twice += x in seen
                seen.add(x)
        want.append((r[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), twice, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    got = lines.judge(docs).select("doc_id", *lines.COUNTS, "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_boilerplate_goes_and_depleted_documents_are_rejected(spark, request, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if broadcast else "-1")
    letters = str.maketrans("0123456789", "abcdefghij")  # numbers are all the same to the rule
    body = lambda i, n: " ".join(f"word{i}x{j}".translate(letters) for j in range(n))
    rows = [(i, f"Welcome to page {i}\n{body(i, 60)}", "a") for i in range(30)]
    rows += [(100, "Welcome to page 1\n" * 40 + body(100, 5), "a"), (101, f"Welcome to page 7\n{body(101, 60)}", "b"), (102, f"hello\n{body(102, 60)}", None), (103, None, "a")]
    rows += [(200 + i, f"{body(9, 70)}\n{body(8, 70)}", "c") for i in range(40)]  # copies are one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = {r["doc_id"]: r for r in lines.judge(df).collect()}
    assert all(got[i]["kept"] and got[i]["n_shared_words"] == 4 for i in range(30))
    assert not got[100]["kept"] and got[101]["kept"] and got[101]["n_shared_words"] == 0 and got[102]["kept"] and not got[103]["kept"]
    assert all(got[200 + i]["kept"] and not got[200 + i]["n_shared_words"] for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in lines.clean(df).collect()}
    assert clean[3] == body(3, 60) and clean[101].startswith("Welcome") and 100 not in clean and lines.clean(df).columns == df.columns


def test_shared_lines_of_a_template_count_distinct_documents(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = []
    for host in "abcdef":
        template = [" ".join(word() for _ in range(6)) for _ in range(8)]
        texts = ["\n".join([*template[:4], *(" ".join(word() for _ in range(40)) for _ in range(1 + i % 2)), *template[4:]]) for i in range(60)]
        texts += ["\n".join(" ".join(word() for _ in range(60)) for _ in range(3)) for _ in range(40)]
        rows += [(len(rows) + i, t, host) for i, t in enumerate([*texts, *texts[:30], *[texts[-1]] * 90])]
    held = defaultdict(set)
    for _, t, h in rows:
        for x in {lines.line_code(x) for x in t.encode().split(b"\n")} | {0}:
            held[h, x].add(t)
    want = {k for k, v in held.items() if k[1] and len(v) > 10 and len(v) > 0.05 * len(held[k[0], 0])}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {tuple(r) for r in lines.shared_lines(docs, "source", "text", 0.05, 10).collect()} == want and len(want) == 48
    for r in lines.judge(docs).collect():
        i = r["doc_id"] % 220
        page = i < 60 or 100 <= i < 130  # its 48 template words outweigh one own line of 40, but not two
        assert r["n_shared_words"] == (48 if page else 0) and r["kept"] == (not page or i % 2 == 1)


def test_quality_rules_on_an_empty_table(none):
    assert lines.judge(none).count() == 0


# ------------------------------------------------------------------------------------------------ classifier


def test_classifier_separates_junk_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        body = " ".join(f"word{(i * 7 + j * 13) % 97}" for j in range(40 + i % 30))
        rows.append((i, body if good else body.upper().replace(" ", "!! "), "en"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stat_upper string")
    lab = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, lab).collect()}
    assert len(got) == 403
    wrong = [i for i, q, _ in labels if got[i]["held_out"] and got[i]["predicted"] != q]
    assert sum(got[i]["held_out"] for i, _, _ in labels) > 50 and len(wrong) <= 2
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[0]["held_out"] == (zlib.crc32(b"0") % 4 == 2)
    assert {r["doc_id"] for r in quality.accepted(docs, lab).collect()} == {i for i, r in got.items() if r["predicted"]}


def test_classifier_on_the_given_labels(spark):
    """Held-out rows of the given tables: nearly all are told apart."""
    from pathlib import Path

    from tallyloom.llm import queries

    at = Path("/root/testdata/sf0.01")
    if not (at / "labels.parquet").exists():
        pytest.skip("no given tables here")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [(r["score"], label[r["doc_id"]], r["predicted"]) for r in queries.op4_quality(spark, str(at)).collect() if r["held_out"] and label.get(r["doc_id"]) is not None]
    good, bad = [s for s, y, _ in rows if y == 1], [s for s, y, _ in rows if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 30 and auc > 0.97 and sum(y == p for _, y, p in rows) > 0.93 * len(rows)


def test_classifier_with_long_texts_and_repeated_rows(spark):
    rows = [(i, "plain words of a page " * 9 if i % 2 else "$$$ !!! " * 60) for i in range(100)] + [(500, "plain words of a page " * 60_000), (1, "plain words of a page " * 9), (1, "plain words of a page " * 9)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] * 2, "doc_id long, quality int, toxic int")
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 103 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and sum(r["doc_id"] == 1 for r in got) == 3
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] < 100)


def test_classifier_without_labels(docs, none, spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, lab).collect()} == {0.5}
    assert quality.score(none, lab).count() == 0


def test_without_a_model_all_documents_are_accepted(docs, rows, spark):
    for labels in ([], [(r[0], 1, 0) for r in rows if r[0] is not None]):
        out = quality.accepted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert out.columns == docs.columns and out.count() == len(rows)


def test_compiled_rules_agree_with_the_model(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    x = draw.random((600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    intercept, rules = quality.fit(x, y)
    margin = intercept + sum(w * quality.holds(r, x) for r, w in rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"stat_{s} double" for s in quality.STATISTICS))
    got = [r[0] for r in df.select(quality.compiled((intercept, rules))).collect()]
    assert got == pytest.approx(list(1 / (1 + np.exp(-margin))))
    assert (((np.array(got) > 0.5) == (y > 0.5)).mean()) > 0.97 and len(rules) < 200


def test_brute_frequency_is_stable():
    assert defaultdict(int)[lines.line_code(b"  \t ")] == 0 and lines.line_code(b"A  1") == lines.line_code(b"a 2")
