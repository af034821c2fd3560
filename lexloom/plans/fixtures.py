"""Inputs of the catalogue's queries, made from the driver's tables by the same arithmetic here and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.tables import spread

LINES_PER_PAGE = 12
PAGE_W, PAGE_H = 595.0, 842.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def legal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, filename, page_number, text): documents cut into pages, with headings, headers, marks and word breaks put in by line."""
    docs, text = table(spark, sf_dir, "documents"), lambda x: x.cast("string")

    def new(line, ln):
        k = (F.col("doc_id") * 7 + ln * 13) % 40
        put = {
            (0,): F.concat(F.lit("BAB "), F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), (ln % 5 + 1).cast("int"))),
            (1,): F.concat(F.lit("KETENTUAN UMUM "), text(ln % 3)),
            (2,): F.lit("Bagian Kesatu"),
            (3, 4): F.concat(F.lit("Pasal "), text(1 + ln % 9), F.when(ln % 5 == 0, "a").otherwise("")),
            (5,): F.lit("Pasal"),
            (18,): F.lit("7a"),
            (6, 7, 8): F.concat(F.lit("("), text(1 + ln % 4), F.lit(") "), line),
            (9,): F.concat(F.lit("Lembaran Dokumen "), text(F.col("doc_id"))),
            (10,): F.lit("- 3 -"),
            (11,): F.concat(line, F.lit(" kete-")),
            (24,): F.concat(F.lit("nagakerjaan "), line),
            (12,): F.lit("SK No 12"),
            (13,): F.lit("Presiden Republik Indonesia"),
            (14,): F.when(F.col("doc_id") % 5 == 0, "PENJELASAN").otherwise(line),
            (15,): F.lit(".. ,,"),
            (16,): F.concat(F.lit("Paragraf "), text(1 + ln % 3)),
            (19,): F.concat(F.lit("Pasal "), text(1 + ln % 9), F.lit(" "), line),
            # ligature, full-width letters, no-break space, soft hyphen, replacement sign, zero-width space, a tab
            (20,): F.concat(F.lit("\ufb01nal\u00a0\uff21\uff22 so\u00adft\ufffdx\u200b \ty "), text(ln % 3)),
        }
        out = line
        for keys, value in put.items():
            out = F.when(k.isin(*keys), value).otherwise(out)
        return out

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), new)
    # the lines are bound once, not made anew for each page
    starts = lambda x: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / LINES_PER_PAGE).cast("int"))
    cut = F.transform(F.array(lines), lambda x: F.transform(starts(x), lambda i: F.array_join(F.slice(x, i * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n")))
    pages = docs.select("doc_id", F.posexplode(cut[0]).alias("i", "text"))
    return pages.select("doc_id", F.concat(F.lit("UU No. "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), (F.col("i") + 1).alias("page_number"), "text")


LEGAL_SQL = r"""
legal0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS ln FROM documents),
legal1 AS (SELECT *, (doc_id * 7 + ln * 13) % 40 AS k FROM legal0),
legal AS (SELECT doc_id, CAST(1 + ln // 12 AS INTEGER) AS page_number, ln AS line_no,
  trim(regexp_replace(regexp_replace(CASE
    WHEN k = 0 THEN 'BAB ' || (['I', 'II', 'III', 'IV', 'V'])[CAST(ln % 5 + 1 AS INTEGER)]
    WHEN k = 1 THEN 'KETENTUAN UMUM ' || (ln % 3) WHEN k = 2 THEN 'Bagian Kesatu'
    WHEN k IN (3, 4) THEN 'Pasal ' || (1 + ln % 9) || CASE WHEN ln % 5 = 0 THEN 'a' ELSE '' END
    WHEN k = 5 THEN 'Pasal' WHEN k = 18 THEN '7a' WHEN k IN (6, 7, 8) THEN '(' || (1 + ln % 4) || ') ' || line
    WHEN k = 9 THEN 'Lembaran Dokumen ' || doc_id WHEN k = 10 THEN '- 3 -' WHEN k = 11 THEN line || ' kete-'
    WHEN k = 24 THEN 'nagakerjaan ' || line WHEN k = 12 THEN 'SK No 12' WHEN k = 13 THEN 'Presiden Republik Indonesia'
    WHEN k = 14 AND doc_id % 5 = 0 THEN 'PENJELASAN' WHEN k = 15 THEN '.. ,,' WHEN k = 16 THEN 'Paragraf ' || (1 + ln % 3)
    WHEN k = 19 THEN 'Pasal ' || (1 + ln % 9) || ' ' || line WHEN k = 20 THEN 'final AB soft x y ' || (ln % 3) ELSE line END, '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS line FROM legal1)"""


def join_sql(source: str, name: str) -> str:
    """Split headings joined."""
    return rf"""
{name}_w AS (SELECT *, lead(line) OVER w AS after, lag(line) OVER w AS before FROM {source} WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
{name} AS (SELECT doc_id, page_number, line_no, CASE WHEN lower(line) = 'pasal' AND regexp_matches(coalesce(after, ''), '^\d+[A-Za-z]?$') THEN 'Pasal ' || after ELSE line END AS line
  FROM {name}_w WHERE NOT (coalesce(lower(before), '') = 'pasal' AND regexp_matches(line, '^\d+[A-Za-z]?$')))"""


def clean_sql(source: str, name: str) -> str:
    """Headings joined, noise dropped."""
    return rf"""{join_sql(source, name + "_j")},
{name} AS (SELECT * FROM {name}_j WHERE NOT (line = '' OR regexp_matches(line, '^(?:[-–—]\s*)?\d{{1,4}}(?:\s*[-–—])?$') OR regexp_matches(line, '(?i)^(?:halaman|page)\s*\d{{1,4}}$')
  OR regexp_matches(regexp_replace(line, '\s+', '', 'g'), '^[|¦~_=*•·….,;:]+$') OR upper(line) IN ('PRESIDEN', 'REPUBLIK INDONESIA', 'PRESIDEN REPUBLIK INDONESIA')
  OR regexp_matches(line, '^-\s*\d+\s*-\s*$') OR regexp_matches(line, '(?i)^SK\s+No\.?\s*')))"""


def margin_sql(source: str, name: str) -> str:
    """{name}_m: lines with in_margin and key; {name}: repeated keys."""
    return rf"""
{name}_m AS (SELECT *, lower(line) AS key, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) <= 5 OR row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) <= 5 AS in_margin FROM {source}),
{name} AS (SELECT doc_id, key, count(DISTINCT page_number)::BIGINT AS n_pages FROM {name}_m WHERE in_margin AND length(line) BETWEEN 3 AND 120
  AND NOT (regexp_matches(line, '(?i)^(BAB|Bagian|Paragraf|Pasal)\s+') OR regexp_matches(line, '^\(\d+\)') OR upper(line) = 'PENJELASAN') GROUP BY doc_id, key HAVING count(DISTINCT page_number) >= 2)"""


def hyphen_sql(source: str, name: str) -> str:
    return rf"""
{name}_g AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '[A-Za-zÀ-ÿ]-$') AND regexp_matches(line, '^[a-zà-ÿ]'), false) AS glued FROM {source} WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
{name}_r AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS run FROM {name}_g),
{name}_l AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id, page_number, run ORDER BY line_no) IS NOT NULL AS goes_on FROM {name}_r),
{name} AS (SELECT doc_id, page_number, min(line_no) AS line_no, string_agg(CASE WHEN goes_on THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY line_no) AS line FROM {name}_l GROUP BY doc_id, page_number, run)"""


def document_sql(lines: str = LEGAL_SQL) -> str:
    """CTEs up to `cleaned`, the cleaned documents, and `parsed`, the lines as the parser reads them; `lines` has the CTE `legal`."""
    second = r"""
kept_m AS (SELECT *, lower(line) AS key, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) <= 5 OR row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) <= 5 AS in_margin FROM twice),
kept AS (SELECT m.doc_id, page_number, line_no, line FROM kept_m m LEFT JOIN margins k ON m.doc_id = k.doc_id AND m.key = k.key WHERE NOT (in_margin AND k.key IS NOT NULL))"""
    return ",".join([lines, clean_sql("legal", "basic"), margin_sql("basic", "margins"), clean_sql("basic", "twice"), second, hyphen_sql("kept", "cleaned"), clean_sql("cleaned", "thrice"), hyphen_sql("thrice", "unbroken"), join_sql("unbroken", "parsed")])


def classified_sql(lines: str = LEGAL_SQL) -> str:
    """CTEs up to `classified`."""
    return document_sql(lines) + r""",
kinds AS (SELECT *, CASE WHEN upper(line) = 'PENJELASAN' THEN 'PENJELASAN' WHEN regexp_matches(line, '(?i)^BAB\s+([IVXLCDM]+)$') THEN 'BAB' WHEN regexp_matches(line, '(?i)^Bagian\s+(.+)$') THEN 'BAGIAN'
  WHEN regexp_matches(line, '(?i)^Paragraf\s+(\d+)$') THEN 'PARAGRAF' WHEN regexp_matches(line, '(?i)^Pasal\s+(\d+[A-Za-z]?)(?:\s+(.+))?$') THEN 'PASAL' WHEN regexp_matches(line, '^\((\d+)\)\s*(.*)$') THEN 'AYAT' END AS kind FROM parsed),
alive AS (SELECT * FROM (SELECT *, max(CASE WHEN kind = 'PENJELASAN' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS ended FROM kinds) WHERE ended = 0),
ctxs AS (SELECT *, last_value(CASE WHEN kind IN ('BAB', 'BAGIAN', 'PARAGRAF', 'PASAL') THEN kind END IGNORE NULLS) OVER w AS ctx, sum(CASE WHEN kind = 'BAB' THEN 1 ELSE 0 END) OVER w AS bab_no, sum(CASE WHEN kind = 'PASAL' THEN 1 ELSE 0 END) OVER w AS pasal_no,
  last_value(CASE WHEN kind = 'BAB' THEN upper(regexp_extract(line, '(?i)^BAB\s+([IVXLCDM]+)$', 1)) END IGNORE NULLS) OVER w AS bab,
  last_value(CASE WHEN kind = 'PASAL' THEN upper(regexp_extract(line, '(?i)^Pasal\s+(\d+[A-Za-z]?)', 1)) END IGNORE NULLS) OVER w AS last_pasal FROM alive WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, line_no)),
secs AS (SELECT *, coalesce(kind = 'AYAT' AND ctx = 'PASAL', false) AS is_ayat, sum(CASE WHEN kind IN ('BAB', 'BAGIAN', 'PARAGRAF', 'PASAL') OR (kind = 'AYAT' AND ctx = 'PASAL') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS section FROM ctxs),
classified AS (SELECT *, CASE WHEN ctx = 'PASAL' THEN last_pasal END AS pasal,
  CASE WHEN ctx = 'PASAL' THEN last_value(CASE WHEN is_ayat THEN regexp_extract(line, '^\((\d+)\)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id, pasal_no ORDER BY page_number, line_no) END AS ayat,
  nullif(CASE WHEN kind = 'PASAL' THEN trim(regexp_extract(line, '(?i)^Pasal\s+(\d+[A-Za-z]?)(?:\s+(.+))?$', 2)) WHEN is_ayat THEN trim(regexp_extract(line, '^\((\d+)\)\s*(.*)$', 2))
    WHEN ctx = 'PASAL' AND (kind IS NULL OR kind NOT IN ('BAB', 'BAGIAN', 'PARAGRAF', 'PASAL')) THEN line END, '') AS content FROM secs)"""


def chunked_sql(lines: str = LEGAL_SQL) -> str:
    """CTEs up to `chunked`, the chunks in order of (doc_id, section, k), and `titles`."""
    return classified_sql(lines) + rf""",
tokens AS (SELECT doc_id, section, bab_no, bab, pasal, ayat, page_number, line_no, unnest(list_filter(string_split(content, ' '), lambda x: x <> '')) AS word, unnest(range(len(list_filter(string_split(content, ' '), lambda x: x <> '')))) AS pos FROM classified WHERE content IS NOT NULL AND ctx = 'PASAL'),
listed AS (SELECT doc_id, section, any_value(bab_no) AS bab_no, any_value(bab) AS bab, any_value(pasal) AS pasal, any_value(ayat) AS ayat, list(word ORDER BY page_number, line_no, pos) AS words, list(page_number ORDER BY page_number, line_no, pos) AS on_pages FROM tokens GROUP BY doc_id, section),
packed AS (SELECT *, list_reduce(list_transform(words, lambda w: {{'n': length(w)::BIGINT, 'ks': [1::BIGINT]}}), lambda a, x: CASE WHEN a.n + 1 + x.n > 1000 THEN {{'n': x.n, 'ks': list_append(a.ks, a.ks[-1] + 1)}} ELSE {{'n': a.n + 1 + x.n, 'ks': list_append(a.ks, a.ks[-1])}} END).ks AS ks FROM listed),
offsets AS (SELECT *, coalesce(sum(ks[-1]) OVER (PARTITION BY doc_id, pasal, ayat ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM packed),
flat AS (SELECT doc_id, section, bab_no, bab, pasal, ayat, before, unnest(words) AS word, unnest(on_pages) AS page, unnest(ks) AS k, unnest(range(len(ks))) AS i FROM offsets),
chunked AS (SELECT doc_id, section, k, any_value(bab_no) AS bab_no, any_value(bab) AS bab, any_value(pasal) AS pasal, any_value(ayat) AS ayat, (any_value(before) + k)::INTEGER AS part, min(page) AS page_start, max(page) AS page_end, list_sort(list_distinct(list(page))) AS pages, string_agg(word, ' ' ORDER BY i) AS text FROM flat GROUP BY doc_id, section, k),
titles AS (SELECT doc_id, bab_no, string_agg(CASE WHEN kind IS NULL OR kind <> 'BAB' THEN line END, ' ' ORDER BY page_number, line_no) AS bab_title FROM classified WHERE bab_no > 0 AND ctx = 'BAB' GROUP BY doc_id, bab_no)"""


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_number, text, page_w, page_h, boxes): a page per document with up to three images placed by its id."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")

    def box(i):
        x, y = (d * 37 + i * 101) % 400, (d * 53 + i * 71) % 500
        return F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 50 + (d * 11 + i * 67) % 500).cast("double").alias("x1"), (y + 60 + (d * 17 + i * 29) % 600).cast("double").alias("y1"))

    boxes = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, (d % 4).cast("int")), box)
    return docs.select("doc_id", F.lit(1).alias("page_number"), "text", F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"), boxes.alias("boxes"))


BOXES_SQL = r"""
box0 AS (SELECT doc_id, unnest(range(doc_id % 4)) AS i FROM documents),
box1 AS (SELECT doc_id, i, (doc_id * 37 + i * 101) % 400 AS x0, (doc_id * 53 + i * 71) % 500 AS y0, (doc_id * 37 + i * 101) % 400 + 50 + (doc_id * 11 + i * 67) % 500 AS x1, (doc_id * 53 + i * 71) % 500 + 60 + (doc_id * 17 + i * 29) % 600 AS y1 FROM box0),
boxes AS (SELECT doc_id, i, x0, y0, least(x1, 595) AS x1, least(y1, 842) AS y1 FROM box1 WHERE least(x1, 595) > x0 AND least(y1, 842) > y0),
xs AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS x2 FROM (SELECT DISTINCT doc_id, unnest([x0, x1]) AS x FROM boxes)),
strips AS (SELECT xs.doc_id, x, x2, y0, y1, coalesce(max(y1) OVER (PARTITION BY xs.doc_id, x ORDER BY y0, y1, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM xs JOIN boxes b ON xs.doc_id = b.doc_id AND b.x0 <= x AND b.x1 >= x2 WHERE x2 IS NOT NULL),
areas AS (SELECT doc_id, sum((x2 - x) * greatest(0, y1 - greatest(y0, top)))::DOUBLE AS area FROM strips GROUP BY doc_id),
coverage AS (SELECT d.doc_id, (d.doc_id % 4)::BIGINT AS image_count, CASE WHEN area IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, area / (595.0::DOUBLE * 842.0::DOUBLE)) END AS image_coverage FROM documents d LEFT JOIN areas a ON d.doc_id = a.doc_id)"""


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as registry operations: the user is the document, every 5th event of a kind reserves, others update."""
    e = table(spark, sf_dir, "events")
    run = F.floor(F.col("event_id") / 200)
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "reserve").otherwise("update").alias("op"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("document_hash"),
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("document_id"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("filename"), F.concat(F.lit("i"), run.cast("string")).alias("ingestion_id"),
        F.element_at(F.array(F.lit("processing"), F.lit("completed"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 3 == 1, (F.col("event_id") % 90).cast("int")).alias("indexed_chunks"), F.when(F.col("event_id") % 3 == 2, "boom").alias("error"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress of files: one job for 10 users, a file per user, every 50th event ends a job."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    ends = i % 50 == 49
    number = lambda m: F.when(i % m != 0, (i % (m * 7)).cast("int"))
    return e.select(
        i.alias("seq"), F.when(ends, "job_status").otherwise("document_status").alias("type"), F.concat(F.lit("job"), F.floor(u / 10).cast("string")).alias("job_id"), F.when(ends, "-").otherwise(F.concat(F.lit("f"), u.cast("string"), F.lit(".pdf"))).alias("filename"),
        F.col("event_type").alias("stage"), F.element_at(F.array(F.lit("processing"), F.lit("completed"), F.lit("failed")), (i % 3 + 1).cast("int")).alias("status"), F.concat(F.lit("m"), (i % 13).cast("string")).alias("message"), number(2).alias("chunks"), number(8).alias("indexed_chunks"), number(3).alias("progress_current"), number(4).alias("progress_total"), F.when(i % 9 != 0, (i % 100).cast("double") / 4).alias("progress_percent"), F.when(i % 10 != 0, "pages").alias("progress_unit"),
        number(5).alias("native_pages"), number(6).alias("ocr_pages"), number(7).alias("total_pages"), F.when(i % 3 == 2, "boom").alias("error"),
    )


JOBS_SQL = r"""
jobs AS (SELECT event_id AS seq, CASE WHEN event_id % 50 = 49 THEN 'job_status' ELSE 'document_status' END AS type, 'job' || (user_id // 10) AS job_id, CASE WHEN event_id % 50 = 49 THEN '-' ELSE 'f' || user_id || '.pdf' END AS filename,
  event_type AS stage, (['processing', 'completed', 'failed'])[CAST(event_id % 3 + 1 AS INTEGER)] AS status, 'm' || (event_id % 13) AS message, CASE WHEN event_id % 2 <> 0 THEN (event_id % 14)::INTEGER END AS chunks, CASE WHEN event_id % 8 <> 0 THEN (event_id % 56)::INTEGER END AS indexed_chunks, CASE WHEN event_id % 3 <> 0 THEN (event_id % 21)::INTEGER END AS progress_current,
  CASE WHEN event_id % 4 <> 0 THEN (event_id % 28)::INTEGER END AS progress_total, CASE WHEN event_id % 9 <> 0 THEN (event_id % 100)::DOUBLE / 4 END AS progress_percent, CASE WHEN event_id % 10 <> 0 THEN 'pages' END AS progress_unit, CASE WHEN event_id % 5 <> 0 THEN (event_id % 35)::INTEGER END AS native_pages, CASE WHEN event_id % 6 <> 0 THEN (event_id % 42)::INTEGER END AS ocr_pages, CASE WHEN event_id % 7 <> 0 THEN (event_id % 49)::INTEGER END AS total_pages, CASE WHEN event_id % 3 = 2 THEN 'boom' END AS error FROM events)"""


def citation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits: 50 to a query, with parents (lang, source) and page ranges by their id."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.floor(d / 50).alias("query_id"), (d % 50 + 1).alias("rerank_rank"), F.concat("lang", F.lit(".pdf")).alias("filename"), F.when(d % 11 != 0, F.col("source")).alias("pasal"), F.when(d % 3 != 0, (d % 7).cast("string")).alias("ayat"), F.when(d % 4 != 0, F.concat(F.lit("B"), (d % 5).cast("string"))).alias("bab"),
        F.concat(F.lit("c"), d.cast("string")).alias("chunk_id"), F.col("text"), (d % 40 + 1).cast("int").alias("page_start"), (d % 40 + 1 + d % 2).cast("int").alias("page_end"), (d % 1000 / 1000).alias("rerank_score"),
    )


HITS_SQL = r"""
hits AS (SELECT doc_id // 50 AS query_id, doc_id % 50 + 1 AS rerank_rank, lang || '.pdf' AS filename, CASE WHEN doc_id % 11 <> 0 THEN source END AS pasal, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 7)::VARCHAR END AS ayat, CASE WHEN doc_id % 4 <> 0 THEN 'B' || (doc_id % 5) END AS bab,
  'c' || doc_id AS chunk_id, text, (doc_id % 40 + 1)::INTEGER AS page_start, (doc_id % 40 + 1 + doc_id % 2)::INTEGER AS page_end, (doc_id % 1000)::DOUBLE / 1000 AS rerank_score FROM documents),
parent_rows AS (SELECT filename, pasal, chunk_id, trim(text) AS t, row_number() OVER (PARTITION BY filename, pasal ORDER BY chunk_id) AS n FROM hits WHERE filename <> '' AND pasal <> ''),
parents AS (SELECT filename, pasal, substr(string_agg(t, chr(10) ORDER BY chunk_id), 1, 6000) AS parent_text FROM parent_rows WHERE n <= 64 AND t <> '' GROUP BY filename, pasal),
expanded AS (SELECT h.*, CASE WHEN row_number() OVER (PARTITION BY query_id, h.filename, h.pasal ORDER BY rerank_rank) = 1 THEN coalesce(nullif(parent_text, ''), trim(text)) ELSE trim(text) END AS context_text
  FROM hits h LEFT JOIN parents p ON h.filename = p.filename AND h.pasal = p.pasal)"""
