"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file (they are never copied into the repository)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), length=2048, end_id=0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"), least=100)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .knn import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, manifest)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import MIN_WORDS, dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=MIN_WORDS)


def op11_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordered_packing import pack_in_order

    return pack_in_order(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), length=2048, end_id=1)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .merkle import manifest, tampered

    return manifest(table(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars") + 1}, tampered())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP2_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


OP7_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', CAST({c} AS VARCHAR)) END"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))}))"


#: CRC-32 bit by bit, over the decimal digits.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS UBIGINT[])), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"""


def _tree(name: str, leaves: str, group: str) -> str:
    """All nodes (group, level, r, m, node) above a table of leaves."""
    return f"""{name} AS (SELECT {group} AS grp, 0 AS lvl, r, m, node FROM {leaves}
  UNION ALL SELECT grp, lvl + 1, r // 2, (m + 1) // 2, sha256(string_agg(node, '' ORDER BY r)) FROM {name} WHERE m > 1 GROUP BY grp, lvl, r // 2, m)"""


def _fold(name: str, start: str, tree: str) -> str:
    """Rows of start (n, grp, r, m, x, proof) folded up to the root of their group."""
    return f"""{name} AS (SELECT n, grp, 0 AS lvl, r, m, x, proof FROM {start}
  UNION ALL SELECT f.n, f.grp, f.lvl + 1, f.r // 2, (f.m + 1) // 2, sha256(CASE WHEN f.r % 2 = 1 THEN concat(s.node, f.x) ELSE concat(f.x, s.node) END), concat(f.proof, s.node)
  FROM {name} f LEFT JOIN {tree} s ON s.grp = f.grp AND s.lvl = f.lvl AND s.r = xor(f.r, 1) WHERE f.m > 1)"""


OP12_SQL = f"""
WITH RECURSIVE a AS (SELECT row_number() OVER () AS n, doc_id, coalesce('=' || lang, '-') AS grp, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN ({CRC32}) % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed FROM documents),
leaves AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY grp) AS m FROM a),
{_tree("up", "leaves", "grp")},
subroots AS (SELECT grp, node, 0 AS top, row_number() OVER (ORDER BY CASE WHEN grp <> '-' THEN encode(grp) END NULLS FIRST) - 1 AS r, count(*) OVER () AS m FROM up WHERE m = 1),
{_tree("above", "subroots", "top")},
one AS (SELECT n, grp, r, m, coalesce(changed, leaf) AS x, '' AS proof FROM leaves),
{_fold("f1", "one", "up")},
two AS (SELECT f1.n, 0 AS grp, s.r, s.m, f1.x, f1.proof FROM f1 JOIN subroots s ON s.grp = f1.grp WHERE f1.m = 1),
{_fold("f2", "two", "above")}
SELECT l.doc_id, l.leaf, s.node AS subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = t.node AS verified
FROM leaves l JOIN subroots s ON s.grp = l.grp JOIN f2 f ON f.n = l.n AND f.m = 1 JOIN above t ON t.m = 1"""


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(words) < 100 AS INT)
  + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM w LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
o AS (SELECT '' AS s UNION ALL SELECT s || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(s, x)),
k AS (SELECT s AS filter_order, CAST(i AS INT) AS step, 1 << (ascii(s[i]) - 65) AS own,
  CAST(list_sum(list_transform(string_split(s[:i - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS INT) AS before FROM o, range(1, 6) r(i) WHERE length(s) = 5)
SELECT part, filter_order, step, CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & own > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, k GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    from .license_scan import license_sql

    return {"op2_warc": OP2_SQL, "op4_license_scan": license_sql(), "op7_knn_join": OP7_SQL, "op12_merkle_manifest": OP12_SQL, "op13_filter_audit": OP13_SQL}
