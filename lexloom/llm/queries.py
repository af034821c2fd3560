"""The queries of this subpackage and their SQL; the entry file registers them if this module can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.centroids import cluster
from lexloom.llm.common import table
from lexloom.llm.decontaminate import find_contamination
from lexloom.llm.main_text import extract_main_text
from lexloom.llm.packing import pack_documents
from lexloom.llm.pii import KINDS, describe, find_pii
from lexloom.llm import quality_model
from lexloom.llm.quality_rules import BOILERPLATE, MENU, SENTENCE_END, SEPARATORS, SHOUTING
from lexloom.llm.quality_rules import judge as judge_quality
from lexloom.llm.simhash import near_duplicates
from lexloom.llm.suffix_dedup import remove_repeats
from lexloom.llm.token_file import read_token_files, write_token_files
from lexloom.llm.url_filter import filter_urls
from lexloom.llm.warc_zip import read_packages, write_packages

#: Vocabulary files of the tokenizers; the folder is a parameter of the queries, nothing is copied.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    """Path of a vocabulary file: of the installed package of public vocabularies, or in the folder given."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{folder}/{name}"
    return public_tokenizers.path(name)


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by the additive model, trained on labels that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = quality_model.train(documents, table(spark, sf_dir, "labels"))
    return quality_model.score(documents, model, threshold=0.7)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to bit-packed files in order of id and read from them."""
    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files)


def op3_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 100-byte strings repeat from earlier on."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict by the line-first rules."""
    out = judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules above."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and the class that fingerprints within four bits join it to."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in windows of benchmark items."""
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to ZIP packages and read from them."""
    return read_packages(write_packages(table(spark, sf_dir, "pages")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base matches and spans of personal data."""
    out = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("pii_base", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(describe(F.col("pii_base")), 256).alias("base_sha256"), describe(F.col("pii_spans")).alias("spans"))


def op10_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op11_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, its blocks judged by a tree trained on labelled blocks."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op12_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's cluster of 40, by Lloyd's rounds over distinct integer vectors."""
    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_additive_model": op1_additive_model,
    "op2_token_files": op2_token_files,
    "op3_interval_expansion": op3_interval_expansion,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_winnowing": op7_winnowing,
    "op8_warc_zip": op8_warc_zip,
    "op9_pii": op9_pii,
    "op10_island_packing": op10_island_packing,
    "op11_block_tree": op11_block_tree,
    "op12_weighted_lloyd": op12_weighted_lloyd,
}

_S = r"\x20\x09-\x0D"

def _lloyd_sql(k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, salt: str = "2:") -> str:
    """The rounds one after the other, each centroid's components as rows."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims})",
        f"cells AS MATERIALIZED (SELECT row, unnest(range(1, {dims + 1})) AS d, unnest(q) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), q) - 1 AS cluster, q AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"far{i} AS (SELECT row, cluster, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM kept, c{i})")
        parts.append(f"a{i} AS MATERIALIZED (SELECT row, cluster, distance FROM far{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT cluster, d, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN cells ON a{i}.row = cells.row GROUP BY cluster, d)")
            parts.append(f"n{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS c FROM m{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} ON c{i}.cluster = n{i}.cluster)")
    last = rounds
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} a JOIN kept ON a.row = kept.row JOIN c{last} c ON a.cluster = c.cluster"""


ORACLES: dict[str, str] = {
    "op12_weighted_lloyd": _lloyd_sql(),
    "op4_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, s, list_filter(regexp_split_to_array(s, '[{_S}]+'), lambda x: x <> '') AS w,
             list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^{_S}]')) AS f FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, count(*) AS n_repeat_words
      FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS k FROM r WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(s, chr(10))) AS x FROM t),
k AS (SELECT doc_id, sum(length(x)) + count(*) - 1 AS n FROM l
      WHERE NOT regexp_matches(x, '[^{_S}]')
         OR NOT (NOT regexp_matches(x, '{SENTENCE_END.replace("'", "''")}')
             OR regexp_matches(x, '{SHOUTING}')
             OR (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 100
                > len(list_filter(regexp_split_to_array(x, '[{_S}]+'), lambda y: y <> '')) * 10
             OR regexp_matches(x, '{SEPARATORS}')
             OR regexp_matches(x, '{MENU.replace("'", "''")}')
             OR regexp_matches(x, '{BOILERPLATE.replace("'", "''")}'))
      GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(s, '[{_S}]+', '', 'g'))::BIGINT AS word_chars,
             (length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(f) - len(list_distinct(f)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(s) AS n, length(s) - coalesce(k.n, 0) AS lost
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN k ON w.doc_id = k.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost * 100 <= n * 50 AS kept FROM b""",
    "op5_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict FROM r""",
    "op7_winnowing": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0 AND item IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.span = bw.span AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id""",
}
