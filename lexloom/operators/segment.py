"""Legal documents from page text: cleaning, margins, headings, sections, bounded chunks. Lines are (doc_id, page_number, line_no, line)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lexloom.functions import HEADINGS, casefold, chunk_id, document_id, dropped_by_cleaning, heading, is_structural, line_key, normalize_lines, split_lines
from lexloom.sources.tables import stored

MARGIN_LINES = 5
MARGIN_CHARS = 120
MAX_CHARS = 1000


def _page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_number").orderBy("line_no")


def _so_far() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text) to normalised lines; the empty part after a final line end is none."""
    lines = pages.select("doc_id", "page_number", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    # one shuffle: all windows and groups below are by document, or by document and page
    return normalize_lines(lines).repartition("doc_id")


def join_split_articles(lines: DataFrame) -> DataFrame:
    """A line `Pasal` and a following identifier become one line."""
    number = lambda x: F.coalesce(x.rlike(r"^\d+[A-Za-z]?$"), F.lit(False))
    # only a short line is lower-cased
    article = lambda x: F.coalesce((F.octet_length(x) <= 15) & (F.lower(x) == "pasal"), F.lit(False))
    own = lines.withColumn("__after", F.lead("line").over(_page())).withColumn("__before", F.lag("line").over(_page()))
    own = own.where(~(article(F.col("__before")) & number(F.col("line"))))
    joined = F.when(article(F.col("line")) & number(F.col("__after")), F.concat(F.lit("Pasal "), F.col("__after"))).otherwise(F.col("line"))
    return own.withColumn("line", joined).drop("__after", "__before")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Joins split headings and drops noise; lines are normalised."""
    return join_split_articles(lines).where(~dropped_by_cleaning(F.col("line")))


def margin_lines(lines: DataFrame) -> DataFrame:
    """Adds in_margin: within the first or last MARGIN_LINES lines of the page."""
    number, total = F.row_number().over(_page()), F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_number"))
    rows = lines.withColumn("__number", number).withColumn("__total", total)
    return rows.withColumn("in_margin", (F.col("__number") <= MARGIN_LINES) | (F.col("__number") > F.col("__total") - MARGIN_LINES)).drop("__number", "__total")


def _may_repeat() -> Column:
    """Margin lines that are removed where they occur on two or more pages."""
    return F.col("in_margin") & F.length("line").between(3, MARGIN_CHARS) & ~is_structural(F.col("line"))


def repeated_margins(lines: DataFrame, key: Callable[[Column], Column] = line_key) -> DataFrame:
    """(doc_id, key, n_pages) of margin lines that occur in the margins of two or more pages; `key` says which lines are one."""
    own = margin_lines(lines).where(_may_repeat())
    return own.groupBy("doc_id", key(F.col("line")).alias("key")).agg(F.count_distinct("page_number").alias("n_pages")).where("n_pages >= 2")


def remove_margins(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines but for margin lines with a repeated key."""
    own = margin_lines(lines).withColumn("key", line_key(F.col("line")))
    return own.join(keys.select("doc_id", "key", F.lit(True).alias("__hit")), ["doc_id", "key"], "left").where(~(F.col("in_margin") & F.coalesce("__hit", F.lit(False)))).select("doc_id", "page_number", "line_no", "line")


def join_hyphens(lines: DataFrame) -> DataFrame:
    """Undoes word breaks at line ends; chains of them too, never across pages."""
    before = F.col("__before")
    glued = F.coalesce(before.endswith("-") & before.rlike("[A-Za-zÀ-ÿ]-$") & F.col("line").rlike("^[a-zà-ÿ]"), F.lit(False))
    runs = lines.withColumn("__before", F.lag("line").over(_page())).withColumn("__glued", glued).drop("__before").withColumn("__run", F.sum(F.when(F.col("__glued"), 0).otherwise(1)).over(_page().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    out = runs.groupBy("doc_id", "page_number", "__run").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x, i: F.when(i < F.size("p") - 1, F.substring(x["line"], F.lit(1), F.length(x["line"]) - 1)).otherwise(x["line"])), "")
    return out.select("doc_id", "page_number", F.get("p", F.lit(0))["line_no"].alias("line_no"), text.alias("line"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Cleaned lines of whole documents: noise, then repeated margins, then hyphens.

    Each line learns, beside those of its document with its key, whether the key is repeated; so nothing is joined and lines
    move once. A key is no shorter than its line, and that of a margin line three times as long at most.
    """
    basic = margin_lines(clean_lines(page_lines(pages)))
    same, at = Window.partitionBy("doc_id", "__key"), F.col("__at")
    rows = basic.withColumn("__key", F.when(F.length("line") <= 3 * MARGIN_CHARS, casefold(F.col("line")))).withColumn("__at", F.when(_may_repeat(), F.col("page_number")))
    rows = rows.withColumn("__hit", F.coalesce(F.max(at).over(same) > F.min(at).over(same), F.lit(False))).drop("__key", "__at", "in_margin")
    # a heading that is joined only now has the key of none: what has it is a heading too
    rows = margin_lines(clean_lines(rows)).where(~(F.col("in_margin") & F.col("__hit") & ~is_structural(F.col("line"))))
    return join_hyphens(rows.select("doc_id", "page_number", "line_no", "line"))


def again(cleaned: DataFrame) -> DataFrame:
    """Cleaned lines cleaned once more page by page, headings joined."""
    return join_split_articles(join_hyphens(clean_lines(cleaned)))


def parser_lines(pages: DataFrame) -> DataFrame:
    """Lines as the parser reads them: those of cleaned documents, cleaned once more."""
    return again(clean_pages(pages))


def classify(lines: DataFrame) -> DataFrame:
    """Adds kind and context up to PENJELASAN, which ends a document.

    ctx is the last of BAB, BAGIAN, PARAGRAF, PASAL; a paragraph number counts only inside a PASAL. Further columns: bab
    (number) and bab_no, pasal and pasal_no, ayat, section (running count of headings), content (text that belongs to it).
    """
    x = F.col("line")
    part = lambda k, g: F.regexp_extract(x, HEADINGS[k], g)
    rows = lines.withColumn("kind", heading(x))
    rows = rows.withColumn("__ended", F.max((F.coalesce(F.col("kind"), F.lit("")) == "PENJELASAN").cast("int")).over(_so_far())).where("__ended = 0").drop("__ended")
    top = F.col("kind").isin("BAB", "BAGIAN", "PARAGRAF", "PASAL")
    rows = rows.withColumn("ctx", F.last(F.when(top, F.col("kind")), True).over(_so_far()))
    ayat = F.coalesce((F.col("kind") == "AYAT") & (F.col("ctx") == "PASAL"), F.lit(False))
    is_kind = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    rows = rows.withColumn("is_ayat", ayat).withColumn("section", F.sum((F.coalesce(top, F.lit(False)) | F.col("is_ayat")).cast("int")).over(_so_far()))
    rows = rows.withColumn("bab_no", F.sum(is_kind("BAB").cast("int")).over(_so_far())).withColumn("pasal_no", F.sum(is_kind("PASAL").cast("int")).over(_so_far()))
    rows = rows.withColumn("bab", F.last(F.when(is_kind("BAB"), F.upper(part("BAB", 1))), True).over(_so_far()))
    rows = rows.withColumn("pasal", F.when(F.col("ctx") == "PASAL", F.last(F.when(is_kind("PASAL"), F.upper(part("PASAL", 1))), True).over(_so_far())))
    in_pasal = Window.partitionBy("doc_id", "pasal_no").orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ayat", F.when(F.col("ctx") == "PASAL", F.last(F.when(F.col("is_ayat"), part("AYAT", 1)), True).over(in_pasal)))
    plain = (F.col("ctx") == "PASAL") & ~F.coalesce(top, F.lit(False))
    content = F.when(is_kind("PASAL"), F.trim(part("PASAL", 2))).when(F.col("is_ayat"), F.trim(part("AYAT", 2))).when(plain, x)
    return rows.withColumn("content", F.nullif(content, F.lit("")))


def bab_titles(classified: DataFrame) -> DataFrame:
    """(doc_id, bab_no, bab, bab_title): lines after a BAB up to the next heading, joined."""
    own = classified.where("bab_no > 0 and ctx = 'BAB'")
    title = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce(F.col("kind") != "BAB", F.lit(True)), F.struct("page_number", "line_no", "line")))), lambda s: s["line"]), " ")
    return own.groupBy("doc_id", "bab_no").agg(F.max("bab").alias("bab"), F.nullif(title, F.lit("")).alias("bab_title"))


def sections(classified: DataFrame) -> DataFrame:
    """(doc_id, section, bab_no, bab, pasal, ayat, words, pages): the words of each section and the page of each word."""
    own = classified.where("content is not null and ctx = 'PASAL'")
    items = F.sort_array(F.collect_list(F.struct("page_number", "line_no", "content")))
    out = own.groupBy("doc_id", "section").agg(F.first("bab_no").alias("bab_no"), F.first("bab").alias("bab"), F.first("pasal").alias("pasal"), F.first("ayat").alias("ayat"), items.alias("x"))
    words = F.flatten(F.transform("x", lambda s: F.transform(F.array_remove(F.split(s["content"], r"\s+"), ""), lambda w: F.struct(w.alias("w"), s["page_number"].alias("p")))))
    out = out.withColumn("y", words)
    return out.select("doc_id", "section", "bab_no", "bab", "pasal", "ayat", F.transform("y", lambda s: s["w"]).alias("words"), F.transform("y", lambda s: s["p"]).alias("pages")).where(F.size("words") > 0)


def _begins(found: DataFrame, max_chars: int) -> DataFrame:
    """Adds at: the words of a section with which its chunks begin.

    The fold keeps the length of the open chunk and where chunks begin, so it grows with the chunks and not the words.
    """
    start = F.struct(F.lit(0).alias("n"), F.array(F.lit(1)).alias("at"), F.lit(0).alias("i"))

    def add(acc, w):
        n, i = F.length(w), acc["i"] + 1
        fits = (acc["n"] == 0) | (acc["n"] + 1 + n <= max_chars)
        return F.struct(F.when(fits, F.when(acc["n"] == 0, n).otherwise(acc["n"] + 1 + n)).otherwise(n).alias("n"), F.when(fits, acc["at"]).otherwise(F.concat(acc["at"], F.array(i))).alias("at"), i.alias("i"))

    return found.withColumn("at", F.aggregate("words", start, add, lambda acc: acc["at"]))


def _cut(rows: DataFrame, *more: str) -> DataFrame:
    rows = rows.select("*", F.posexplode("at").alias("k", "begin")).withColumn("size", F.coalesce(F.get("at", F.col("k") + 1), F.size("words") + 1) - F.col("begin"))
    pages = F.array_sort(F.array_distinct(F.slice("pages", F.col("begin"), F.col("size"))))
    return rows.select("doc_id", "section", "bab_no", "bab", "pasal", "ayat", "k", F.size("at").alias("n_chunks"), F.array_join(F.slice("words", F.col("begin"), F.col("size")), " ").alias("text"), pages.alias("pages"), *more)


def pack_sections(found: DataFrame, max_chars: int = MAX_CHARS, *more: str) -> DataFrame:
    """Greedy packing of a section's words into chunks of at most max_chars; a longer word stands alone. `more` columns stay."""
    return _cut(_begins(found, max_chars), *more)


def chunk_documents(pages: DataFrame, max_chars: int = MAX_CHARS, *, lines: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """(doc_id, filename, page_number, text) to chunks with ids, titles and page ranges; on request also section and k, which order them.

    lines: the parser's lines of the pages, if they are there already.
    """
    # of a text without headings nothing is stored: only lines in articles and of chapter titles are used
    used = "(content is not null and ctx = 'PASAL') or (bab_no > 0 and ctx = 'BAB')"
    classified = stored(classify(parser_lines(pages) if lines is None else lines).where(used), "classified")
    names = pages.groupBy("doc_id").agg(F.min("filename").alias("filename"))
    # by document from here on: sections, part numbers and names move no row again
    found = _begins(sections(classified.where("content is not null and ctx = 'PASAL'").repartition("doc_id")), max_chars)
    # part numbers go on where a (pasal, ayat) is opened again
    before = F.sum(F.size("at")).over(Window.partitionBy("doc_id", "pasal", "ayat").orderBy("section").rowsBetween(Window.unboundedPreceding, -1))
    packed = _cut(found.withColumn("before", before).join(names, "doc_id"), "before", "filename")
    out = packed.join(bab_titles(classified).drop("bab"), ["doc_id", "bab_no"], "left")
    out = out.withColumn("part", (F.coalesce("before", F.lit(0)) + F.col("k") + 1).cast("int"))
    return out.select(
        "doc_id", "filename", "bab", "bab_title", "pasal", "ayat", "part", F.array_min("pages").alias("page_start"), F.array_max("pages").alias("page_end"), "pages", "text",
        chunk_id(document_id(F.col("filename")), F.col("pasal"), F.col("ayat"), F.col("part")).alias("chunk_id"), *(["section", "k"] if ordered else []),
    )


def document_metrics(pages: DataFrame, chunks: DataFrame, modes: DataFrame | None = None, *, cleaned: DataFrame | None = None) -> DataFrame:
    """Per document: characters, counts of articles and paragraphs, identifiers, page coverage, chunks, OCR and native pages.

    Articles are counted past PENJELASAN, and a chapter does not close an article here. modes: (doc_id, mode) by page.
    cleaned: the pages' cleaned lines, if they are there already.
    """
    cleaned = stored(clean_pages(pages), "cleaned") if cleaned is None else cleaned
    per_page = cleaned.groupBy("doc_id", "page_number").agg(F.sum(F.length("line") + 1).alias("n")).groupBy("doc_id").agg((F.sum("n") - F.count(F.lit(1))).cast("long").alias("normalized_characters"), F.count(F.lit(1)).alias("text_pages"))
    lines = again(cleaned)
    pasal = F.when(F.col("line").rlike(HEADINGS["PASAL"]), F.upper(F.regexp_extract("line", HEADINGS["PASAL"], 1)))
    rows = lines.withColumn("p", pasal).withColumn("own", F.last("p", True).over(_so_far()))
    ayat = F.when(F.col("p").isNull() & F.col("own").isNotNull() & F.col("line").rlike(HEADINGS["AYAT"]), F.regexp_extract("line", HEADINGS["AYAT"], 1))
    name = F.when(F.col("p").isNotNull(), F.concat(F.lit("Pasal "), "p")).when(F.col("a").isNotNull(), F.concat(F.lit("Pasal "), "own", F.lit(" Ayat "), "a"))
    found = rows.withColumn("a", ayat).groupBy("doc_id").agg(F.count("p").alias("pasal_count"), F.count("a").alias("ayat_count"), F.array_sort(F.collect_set(name)).alias("identifiers"))
    totals = pages.groupBy("doc_id").agg(F.count_distinct("page_number").alias("total_pages"))
    by_chunk = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("chunk_pages"))
    if modes is None:
        modes = pages.select("doc_id", F.lit("native_text").alias("mode"))
    by_mode = modes.groupBy("doc_id").agg(F.count_if(F.col("mode") == "full_ocr").alias("ocr_pages"), F.count_if(F.col("mode") == "native_text").alias("native_pages"))
    out = totals
    for part in (per_page, found, by_chunk, by_mode):
        out = out.join(part, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", zero("normalized_characters"), zero("pasal_count"), zero("ayat_count"), F.coalesce("identifiers", F.array().cast("array<string>")).alias("identifiers"),
        (F.coalesce("text_pages", F.lit(0)) / F.col("total_pages")).alias("page_coverage"), (F.coalesce("chunk_pages", F.lit(0)) / F.col("total_pages")).alias("chunk_page_coverage"), zero("chunk_count"), zero("ocr_pages"), zero("native_pages"),
    )
