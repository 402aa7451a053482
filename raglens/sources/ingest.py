"""Reading manifests, evaluation sets, CSV and HTML, and turning them into elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raglens.functions.scalars import is_blank, stripped

#: Fixed values.
FILE_TYPES = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".xlsx": "xlsx", ".csv": "csv", ".html": "html", ".htm": "html"}
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def parse_manifest(texts: DataFrame, text: str = "text") -> DataFrame:
    """The documents of JSON manifests, an object with `documents` each; other columns stay, a missing version is v1."""
    kind = "documents array<struct<filename:string,source_url:string,version_label:string,effective_from:string,effective_to:string,description:string,sha256:string>>"
    rest = [c for c in texts.columns if c != text]
    rows = texts.select(*rest, F.inline(F.from_json(text, kind)["documents"]))
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.withColumns({"version_label": F.coalesce(empty("version_label"), F.lit("v1")), "effective_from": empty("effective_from"), "effective_to": empty("effective_to")})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def parse_eval_set(texts: DataFrame, text: str = "text") -> DataFrame:
    """Items of JSON sets: a list, or an object's `items`; anything else is an error. Other columns stay; ord counts from 0."""
    item = "array<struct<id:string,question:string,ground_truth:string,source_docs:array<string>,valid_from:string,valid_to:string,modality:string,difficulty:string,answerable:boolean,failure_type:string,temporal_pair_id:string,expected_version:string>>"
    rest = [c for c in texts.columns if c != text]
    items = F.when(F.ltrim(text).startswith("["), F.from_json(text, item)).otherwise(F.from_json(text, f"items {item}")["items"])
    checked = texts.select(*rest, F.coalesce(items, F.raise_error(F.concat(F.lit("no list of items: "), F.substring(text, 1, 80))).cast(item)).alias("items"))
    return checked.select(*rest, F.posexplode("items").alias("ord", "item")).select(*rest, "ord", "item.*")


def read_eval_set_json(spark: SparkSession, path: str) -> DataFrame:
    """parse_eval_set() of files, with the file's sha256."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
    found = parse_eval_set(raw)
    return found.select("ord", *[c for c in found.columns if c not in ("ord", "sha256")], "sha256")


def parse_eval_row(rows: DataFrame) -> DataFrame:
    """CSV cells of evaluation items: lists split at `;`, booleans by word, empty cells absent. Evidence that starts
    with a brace is an object (evidence_object, of texts), or invalid; any other is text."""
    docs = F.filter(F.transform(F.split("source_docs", ";"), lambda x: F.trim(x)), lambda x: x != "")
    yes = F.lower(F.trim("answerable"))
    flag = F.when(yes.isin("true", "1", "yes", "y"), True).when(yes.isin("false", "0", "no", "n"), False)
    if "evidence" in rows.columns:
        brace = F.coalesce(stripped("evidence").startswith("{"), F.lit(False))
        parsed = F.when(brace, F.from_json("evidence", "map<string,string>"))
        rows = rows.withColumns({"evidence_object": parsed, "evidence_valid": ~brace | F.get_json_object("evidence", "$").isNotNull(), "evidence": F.when(~is_blank("evidence"), F.col("evidence"))})
    return rows.withColumns({"source_docs": docs, "answerable_valid": flag.isNotNull() | (F.coalesce(yes, F.lit("")) == ""), "answerable": flag})


def read_eval_set_csv(spark: SparkSession, path: str) -> DataFrame:
    """Items of CSV files with a header; extra_cells marks rows with more cells than that, even empty ones."""
    options = {"header": True, "mode": "PERMISSIVE", "multiLine": True, "escape": '"'}
    names = spark.read.csv(path, **options).columns
    kind = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "_row")])  # the row, where it has more or fewer cells
    rows = spark.read.schema(kind).csv(path, columnNameOfCorruptRecord="_row", **options)
    commas = F.length(F.regexp_replace(F.regexp_replace("_row", r'"(?:[^"]|"")*"', ""), "[^,]", ""))
    return parse_eval_row(rows.withColumn("extra_cells", F.coalesce(commas >= len(names), F.lit(False))).drop("_row"))


def suffix(name: str | Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.[^.]+$", 0)


def detect_file_type(name: str | Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])[suffix(name)], F.lit("unknown"))


def select_parsing_strategy(df: DataFrame, enable_vision: bool, name: str = "filename") -> DataFrame:
    kind = detect_file_type(name)
    sheet, vision = kind.isin("xlsx", "csv"), F.lit(enable_vision) & (kind == "pdf")
    return df.withColumns({"file_type": kind, "strategy": F.when(sheet, "spreadsheet_aware").when(vision, "text_table_vision").otherwise("text_table"), "vision_requested": F.lit(enable_vision), "vision_ignored": F.lit(enable_vision) & ~vision})


def row_text(number: Column, names: list[str]) -> Column:
    pairs = F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in names])
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.array_join(F.array_compact(pairs), ", "))


def csv_rows_to_elements(rows: DataFrame, doc: str, order: str, names: list[str]) -> DataFrame:
    """A text for each row of each document, numbered from 1 in `order`; empty values left out."""
    number = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    out = rows.withColumn("_n", number)
    return out.select(doc, (F.col("_n") - 1).alias("elem_idx"), row_text(F.col("_n"), names).alias("content"), F.lit("spreadsheet_cell").alias("chunk_type"), F.lit(0).alias("page"), F.lit("sheet_0").alias("table_id"))


def sheet_rows_to_elements(cells: DataFrame) -> DataFrame:
    """A summary of each sheet's columns, and a text for each further row with any cell that isn't blank."""
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    head = cells.where("row_no = 1").select("doc_id", "sheet_idx", "sheet_name", F.col("cells").alias("head"))
    summary = head.select("doc_id", "sheet_idx", F.lit(0).alias("row_no"), F.format_string("Sheet: %s | Columns: %s", "sheet_name", F.array_join(F.filter("head", full), ", ")).alias("content"), F.lit("text").alias("chunk_type"))
    pairs = F.filter(F.arrays_zip(F.col("head").alias("h"), F.col("cells").alias("v")), lambda x: full(x["v"]))
    body = cells.where("row_no > 1").join(head.select("doc_id", "sheet_idx", "head"), ["doc_id", "sheet_idx"]).withColumn("p", pairs).where("size(p) > 0")
    text = F.format_string("%s | row %d: %s", "sheet_name", "row_no", F.array_join(F.transform("p", lambda x: F.concat(x["h"], F.lit("="), x["v"])), ", "))
    return summary.unionByName(body.select("doc_id", "sheet_idx", "row_no", text.alias("content"), F.lit("spreadsheet_cell").alias("chunk_type")))


def table_rows_to_markdown(rows: DataFrame) -> DataFrame:
    """A Markdown table of each (doc, table); a line after the first row if there are more."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.coalesce(F.trim(c), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.lit("---")), " | "), F.lit(" |"))
    out = rows.withColumns({"line": line, "rule": rule}).groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "line", "rule"))).alias("r"))
    lines = F.transform("r", lambda x: x["line"])
    whole = F.when(F.size("r") > 1, F.concat(F.slice(lines, 1, 1), F.array(F.col("r")[0]["rule"]), F.slice(lines, 2, F.size("r")))).otherwise(lines)
    return out.select("doc_id", "table_id", F.array_join(whole, "\n").alias("content"))


def html_to_text(html: str | Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, entities read, white space single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


_BLOCK = r"(?is)<(h[1-6]|p|li|table)\b[^>]*>.*?</\1>"


def html_to_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The block elements of each page in order: headings, paragraphs, list items, tables; empty ones dropped."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(_BLOCK), 0)).alias("elem_idx", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"(?i)^<(h[1-6]|p|li|table)", 1))
    out = blocks.select(key, "elem_idx", html_to_text("raw").alias("content"), tag.alias("tag")).where("content <> ''")
    tables = F.sum((F.col("tag") == "table").cast("int")).over(Window.partitionBy(key).orderBy("elem_idx"))
    return out.select(key, "elem_idx", "content", F.when(F.col("tag") == "table", "table").otherwise("text").alias("chunk_type"), F.when(F.col("tag") == "table", F.concat(F.lit("table_"), (tables - 1).cast("string"))).alias("table_id"), F.col("tag").startswith("h").alias("is_heading"))


def page_descriptions_to_elements(rows: DataFrame, max_pages: int) -> DataFrame:
    """Descriptions of pages as image elements; blank and plain-text ones and pages past the limit are left out."""
    text = F.trim("description")
    own = rows.where((F.col("page") <= max_pages) & (F.coalesce(text, F.lit("")) != "") & (text != "PLAIN_TEXT_ONLY"))
    return own.select("doc_id", "page", text.alias("content"), F.lit("image").alias("chunk_type"), F.concat(F.lit("vision_"), F.col("page").cast("string")).alias("table_id"), (F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))).alias("vision_has_table"))


def description_counts(rows: DataFrame, max_pages: int) -> DataFrame:
    text, sent = F.coalesce(F.trim("description"), F.lit("")), F.col("page") <= max_pages
    return rows.groupBy("doc_id").agg(F.count_if(sent).alias("sent"), F.count_if(~sent).alias("skipped"), F.count_if(sent & (text == "PLAIN_TEXT_ONLY")).alias("plain"), F.count_if(sent & ~text.isin("", "PLAIN_TEXT_ONLY")).alias("chunks"))


def parse_elements(elements: DataFrame, strategy: str) -> DataFrame:
    """The elements that a strategy keeps: text always, tables with text_table, images with vision, sheets always."""
    kinds = {"text_only": ["text"], "text_table": ["text", "table"], "text_table_vision": ["text", "table", "image"]}.get(strategy, ["text"])
    return elements.where(F.col("chunk_type").isin(*kinds, "spreadsheet_cell"))


#: The readers of file types; the others have none.
READERS = {"html": "html", "csv": "csv", "xlsx": "sheet", "pdf": "pages", "docx": "pages"}


def dispatch_elements(files: DataFrame, pages: DataFrame, sheets: DataFrame, rows: DataFrame, described: DataFrame, strategy: str, max_pages: int = 50) -> DataFrame:
    """doc_id, elem_idx, content, chunk_type, error: each file's elements by its reader, as the strategy keeps them.

    files (doc_id, filename); pages (doc_id, html) and sheets, rows, described as the readers take them; rows
    (doc_id, row_no, names, values) are CSV cells. A file of no known type is one row with an error and no content.
    """
    own = files.select("doc_id", detect_file_type("filename").alias("file_type"), suffix("filename").alias("suffix"))
    of = lambda df, *kinds: df.join(own.where(F.col("file_type").isin(*kinds)).select("doc_id"), "doc_id", "left_semi")
    shape = lambda df, at, kind: df.select("doc_id", F.col(at).cast("int").alias("elem_idx"), "content", kind.alias("chunk_type"))
    html = shape(html_to_elements(of(pages, "html", "pdf", "docx"), key="doc_id"), "elem_idx", F.col("chunk_type"))
    sheet = sheet_rows_to_elements(of(sheets, "xlsx"))
    sheet = shape(sheet, "row_no", F.col("chunk_type"))
    pairs = F.filter(F.arrays_zip("names", "values"), lambda x: ~is_blank(x["values"]))
    text = F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), F.array_join(F.transform(pairs, lambda x: F.concat(x["names"], F.lit("="), x["values"])), ", "))
    cells = shape(of(rows, "csv").withColumn("content", text), "row_no", F.lit("spreadsheet_cell"))
    images = shape(page_descriptions_to_elements(of(described, "pdf"), max_pages), "page", F.lit("image"))
    found = parse_elements(html.unionByName(sheet).unionByName(cells).unionByName(images), strategy).withColumn("error", F.lit(None).cast("string"))
    bad = own.where(~F.col("file_type").isin(*READERS)).select("doc_id", F.lit(None).cast("int").alias("elem_idx"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("chunk_type"), F.concat(F.lit("no reader for "), F.coalesce(F.nullif("suffix", F.lit("")), F.lit("a file without suffix"))).alias("error"))
    return found.unionByName(bad)


def replace_document_chunks(store: DataFrame, new: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Deletes all chunks of the documents, then adds the new ones: the same under any number of retries."""
    return store.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def delete_documents(store: DataFrame, documents: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = doc_ids.select("doc_id").distinct()
    return store.join(ids, "doc_id", "left_anti"), documents.join(ids, "doc_id", "left_anti")


def scan_chunks(store: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """The documents' chunks; None and an empty list mean all."""
    if doc_ids is None or doc_ids.isEmpty():
        return store
    return store.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def list_documents(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, metadata, created_at, parse_status) newest first, with parsing_strategy from the metadata."""
    return documents.withColumn("parsing_strategy", F.col("metadata")["strategy"]).orderBy(F.col("created_at").desc_nulls_last(), "doc_id")


def done_count(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_if(F.col("parse_status") == "done").alias("done"), F.count("*").alias("documents"))
