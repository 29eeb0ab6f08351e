"""Thin queries of the training-data operators, with production parameters, and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import ann, bpe, fim, groupjoin, lines, lm, merkle, packing, pii, quality, sharding, substring, urls

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), bpe.default_vocabulary(), length=4096, end=2, with_ids=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), lm.default_held_out(), order=3)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7, modulus=4)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES) + " AS rules(rule, verdict)")
    return urls.judge(_table(spark, sf_dir, "pages"), rules, default="allow")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.judge(docs).drop("source")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=8)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupjoin.link_classes(_table(spark, sf_dir, "documents"), shingle=5, percent=75)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_table(spark, sf_dir, "documents"), window=20)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"), rate=100, spm=50, seed=7, unit="line")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(_table(spark, sf_dir, "documents"), modulus=2)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality": op4_quality,
    "op5_url_filters": op5_url_filters,
    "op6_line_rules": op6_line_rules,
    "op7_neighbours": op7_neighbours,
    "op8_sharding": op8_sharding,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pii": op13_pii,
    "pipeline": pipeline,
}

def _merkle_sql(levels: int = 14) -> str:
    """Both trees level by level: nodes 0 are leaves; ``levels`` levels hold 3 ** levels rows of a source."""

    def field(c: str) -> str:
        return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"

    def tree(name: str, leaves: str) -> list[str]:
        steps = [f"{name}0 AS ({leaves})"]
        for k in range(levels):
            steps.append(f"""{name}{k + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest,
                (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY tree, pos // 3)""")
        return steps

    def walk(name: str, nodes: str, start: str) -> list[str]:
        """Of every row: proof and folded digest, one level after the other."""
        steps = [f"{name}0 AS ({start})"]
        for k in range(levels):
            steps.append(f"""{nodes}r{k} AS (SELECT tree, pos // 3 AS run, any_value(n) AS n, max(CASE WHEN pos % 3 = 0 THEN digest END) AS a, max(CASE WHEN pos % 3 = 1 THEN digest END) AS b,
                max(CASE WHEN pos % 3 = 2 THEN digest END) AS c FROM {nodes}{k} GROUP BY tree, pos // 3)""")
            own = "CASE w.pos % 3 WHEN 0 THEN {0} || coalesce(b, '') || coalesce(c, '') WHEN 1 THEN a || {0} || coalesce(c, '') ELSE a || b || {0} END"
            steps.append(f"""{name}{k + 1} AS (SELECT w.id, w.tree, w.pos // 3 AS pos, w.leaf, CASE WHEN r.n = 1 THEN proof ELSE proof || {own.format("''")} END AS proof,
                CASE WHEN r.n = 1 THEN folded ELSE sha256({own.format("folded")}) END AS folded FROM {name}{k} w JOIN {nodes}r{k} r ON w.tree = r.tree AND w.pos // 3 = r.run)""")
        return steps

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    leaves = f"""rows AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {digest("text")} AS leaf, {digest("replace(text, chr(10), '')")} AS stripped,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {digest("text")}) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id FROM documents)"""
    crc = """bits AS (
            SELECT b, 0 AS k, b AS v FROM (SELECT unnest(range(256))::BIGINT AS b)
            UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
        crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
        crcs AS (
            SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
                                       lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) AS crc FROM rows, crc_table)"""
    return "WITH RECURSIVE " + ",\n".join(
        [
            leaves,
            crc,
            *tree("t", "SELECT tree, pos, leaf AS digest, n FROM rows"),
            *tree("u", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n FROM t{levels}"),
            *walk("w", "t", "SELECT rows.id, rows.tree, pos, leaf, '' AS proof, CASE WHEN crc % 2 = 0 THEN stripped ELSE leaf END AS folded FROM rows JOIN crcs ON rows.id = crcs.id"),
            f"groups AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t{levels})",
            *walk("x", "u", f"SELECT w.id, '' AS tree, g.pos, leaf, proof, folded FROM w{levels} w JOIN groups g USING (tree)"),
        ]
    ) + f"""
        SELECT rows.doc_id, x.leaf, g.subroot, u.digest AS root, sha256(x.proof) AS proof_sha256, x.folded AS folded_root, x.folded = u.digest AS verified
        FROM x{levels} x JOIN rows ON x.id = rows.id JOIN groups g ON g.tree = rows.tree CROSS JOIN u{levels} u"""


ORACLES: dict[str, str] = {
    "op5_url_filters": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(r_host, r_path, verdict) AS (VALUES
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        ranked AS (
            SELECT p.page_id, p.host, p.path, r.r_host || r.r_path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.r_host) DESC, length(r.r_path) DESC) AS k
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE k = 1""",
    "op11_fill_in_middle": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        units AS (
            SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn),
        cut AS (
            SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
        parts AS (
            SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
                   coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
        FROM parts""",
    "op12_merkle_manifest": _merkle_sql(),
}
