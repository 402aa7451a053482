"""Evaluation sets: validation, subsets, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import is_blank, stripped

MODALITIES = ["text", "table", "chart", "spreadsheet", "mixed"]
FAILURE_TYPES = ["STALE_ANSWER", "WRONG_VERSION", "CHART_LAYOUT_BLINDNESS", "TABLE_RETRIEVAL_MISS", "LOW_RECALL_RETRIEVAL", "UNSUPPORTED_SYNTHESIS", "IRRELEVANT_CONTEXT_POLLUTION", "CHUNKING_BOUNDARY_ERROR", "NO_FAILURE", "UNANSWERABLE"]
STRICT_TYPES = [t for t in FAILURE_TYPES if t not in ("IRRELEVANT_CONTEXT_POLLUTION", "UNSUPPORTED_SYNTHESIS", "NO_FAILURE")]
MOST_ITEMS = 5000
_DATE = r"^\d{4}-\d{2}-\d{2}$"


DIFFICULTIES = ["easy", "medium", "hard"]
#: Columns of an item, and their types; what a set lacks counts as NULL.
ITEM = {"ord": "int", "id": "string", "question": "string", "ground_truth": "string", "source_docs": "array<string>", "valid_from": "string", "valid_to": "string", "modality": "string", "difficulty": "string", "answerable": "boolean", "answerable_valid": "boolean", "failure_type": "string", "evidence": "string", "evidence_valid": "boolean", "temporal_pair_id": "string", "extra_cells": "boolean"}


def _date(c: str) -> Column:
    return F.when(F.col(c).rlike(_DATE), F.expr(f"try_cast({c} as date)"))


def _fault(on: Column, field: str | None, message: str | Column) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(on, F.struct(F.lit(field).cast("string").alias("field"), said.alias("message")))


def _unknown(c: str, known: list[str]) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin(*known)


def _whole(items: DataFrame) -> DataFrame:
    return items.withColumns({c: F.lit(None).cast(kind) for c, kind in ITEM.items() if c not in items.columns})


def _dates() -> list[Column]:
    checks = [_fault(F.col(c).isNotNull() & _date(c).isNull(), c, "not a date") for c in ("valid_from", "valid_to")]
    return [*checks, _fault(F.coalesce(_date("valid_from") > _date("valid_to"), F.lit(False)), "valid_to", "before valid_from")]


def validate_eval_items(items: DataFrame) -> DataFrame:
    """(ord, id, field, message) of every fault; a set without any row here is valid.

    A set without items, or with more than MOST_ITEMS, has one row for that, without ord, and no others.
    `answerable_valid`, `evidence_valid` and `extra_cells` say what a reader saw that typed columns can't hold.
    """
    first = F.first("ord").over(Window.partitionBy("id").orderBy("ord"))
    docs = F.exists("source_docs", is_blank)
    checks = [_fault(F.coalesce("extra_cells", F.lit(False)), None, "more cells than the header")]
    checks += [_fault(is_blank(c), c, "required") for c in ("id", "question", "ground_truth")]
    checks.append(_fault(~is_blank("id") & (F.col("_first") < F.col("ord")), "id", F.concat(F.lit("duplicate, first seen in row "), F.col("_first").cast("string"))))
    checks.append(_fault(F.coalesce(docs, F.lit(False)), "source_docs", "not a list of names"))
    checks += _dates()
    checks += [_fault(_unknown("modality", MODALITIES), "modality", "unknown"), _fault(_unknown("difficulty", DIFFICULTIES), "difficulty", "unknown")]
    checks.append(_fault(~F.coalesce("answerable_valid", F.lit(True)), "answerable", "not a boolean"))
    checks.append(_fault(_unknown("failure_type", FAILURE_TYPES), "failure_type", "unknown"))
    checks.append(_fault(~F.coalesce("evidence_valid", F.lit(True)), "evidence", "neither object nor text"))
    size = items.agg(F.count("*").alias("_size"))
    none = F.lit(None)
    whole = size.where(f"_size = 0 or _size > {MOST_ITEMS}").select(none.cast("int").alias("ord"), none.cast("string").alias("id"), none.cast("string").alias("field"), F.when(F.col("_size") == 0, "no items").otherwise("too many items").alias("message"))
    rows = _whole(items).join(F.broadcast(size.where(f"_size <= {MOST_ITEMS}")))  # one row
    rows = rows.withColumn("_first", first).select(F.col("ord").cast("int").alias("ord"), "id", F.inline(F.array_compact(F.array(*checks))))
    return rows.unionByName(whole)


#: The stricter validator wants all of these.
STRICT_FIELDS = ["id", "question", "ground_truth", "source_docs", "modality", "difficulty", "answerable"]


def validate_eval_items_strict(items: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """The stricter validator: more fields are required, fewer failure types known; documents are in the manifest
    (filename), if given; answerable items name one; unanswerable ones have their type or none."""
    rows = _whole(items)
    t, docs = F.col("failure_type"), F.coalesce(F.size("source_docs"), F.lit(0))
    twice = F.col("id").isNotNull() & (F.first("ord").over(Window.partitionBy("id").orderBy("ord")) < F.col("ord"))
    checks = [_fault(F.col(c).isNull(), c, "missing") for c in STRICT_FIELDS]
    checks += [_fault(F.col(c).isNotNull() & is_blank(c), c, "empty") for c in ("question", "ground_truth")]
    checks += [_fault(F.col("_twice"), "id", "duplicate"), _fault(_unknown("modality", MODALITIES), "modality", "unknown"), _fault(_unknown("difficulty", DIFFICULTIES), "difficulty", "unknown"), _fault(_unknown("failure_type", STRICT_TYPES), "failure_type", "unknown"), *_dates()]
    answerable = F.coalesce("answerable", F.lit(False))
    checks.append(_fault(answerable & F.col("source_docs").isNotNull() & (docs == 0), "source_docs", "answerable without documents"))
    checks.append(_fault(F.col("answerable").isNotNull() & ~answerable & t.isNotNull() & (t != "UNANSWERABLE"), "failure_type", "unanswerable"))
    found = rows.withColumn("_twice", twice).select("ord", "id", F.inline(F.array_compact(F.array(*checks))))
    if manifest is None:
        return found
    named = rows.select("ord", "id", F.explode("source_docs").alias("filename"))
    lost = named.join(manifest.select("filename").distinct(), "filename", "left_anti")
    return found.unionByName(lost.select("ord", "id", F.lit("source_docs").alias("field"), F.concat(F.lit("not in the manifest: "), "filename").alias("message")))


def eval_set_catalog(items: DataFrame, sources: DataFrame, default: str | None = None) -> DataFrame:
    """Sets with item_count and is_default, built-in ones by id, then uploads, newest first (uploaded_at).

    A set that could not be read (`readable` false) is left out.
    """
    if "readable" in sources.columns:
        sources = sources.where(F.coalesce("readable", F.lit(True))).drop("readable")
    counts = items.groupBy("eval_set_id").agg(F.count("*").alias("item_count"))
    out = sources.join(counts, "eval_set_id", "left").na.fill(0, ["item_count"]).withColumn("is_default", F.col("eval_set_id").eqNullSafe(F.lit(default)))
    upload = F.col("source") == "upload"
    newest = F.when(upload, F.col("uploaded_at")).desc_nulls_last() if "uploaded_at" in sources.columns else F.lit(0)
    return out.orderBy(upload, newest, "eval_set_id")


def unmatched_source_docs(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Filenames that items name and no document has, in order."""
    named = items.select(F.explode("source_docs").alias("filename")).distinct()
    return named.join(documents.select("filename"), "filename", "left_anti").orderBy("filename")


def register_eval_set(items: DataFrame, documents: DataFrame, name: str | None = None, filename: str = "eval_set") -> DataFrame:
    """The items with the set's name, item_count and the named documents that don't exist; no row if any item has a fault.

    A blank name becomes the file's.
    """
    size = items.agg(F.count("*").alias("item_count"))
    lost = unmatched_source_docs(items, documents).agg(F.array_sort(F.collect_list("filename")).alias("unmatched"))
    faults = validate_eval_items(items).agg(F.count("*").alias("_faults"))
    one = size.crossJoin(lost).crossJoin(faults)  # one row
    named = items.withColumn("set_name", F.lit(name if name and name.strip() else filename))
    return named.crossJoin(F.broadcast(one)).where("_faults = 0").drop("_faults").withColumn("n_unmatched", F.size("unmatched").cast("long"))


def validate_document_ids(ids: DataFrame | None, documents: DataFrame) -> DataFrame:
    """doc_id, position, error: unknown ids in the order given, each once; None stands for all documents and has no
    fault, a list without any id is one."""
    kind = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, position long, error string"
    if ids is None:
        return documents.sparkSession.createDataFrame([], kind)
    first = ids.groupBy("doc_id").agg(F.min("position").cast("long").alias("position"))
    unknown = first.join(documents.select("doc_id"), "doc_id", "left_anti").withColumn("error", F.lit("unknown document"))
    empty = ids.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("position"), F.lit("no document is named").alias("error"))
    return unknown.unionByName(empty).orderBy("position")


def normalise_quotes(c: str | Column) -> Column:
    c = F.translate(c, "‘’“”", "''\"\"")
    return stripped(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r" ([,.;:])", "$1"))


def check_evidence(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """quotes (id, filename, quote [, location]) with found (the normalised quote is in the normalised document) and
    status: ok, missing, a note where the location is a chart image, or no document."""
    own = documents.select("filename", normalise_quotes(F.col("text")).alias("_text"))
    joined = quotes.join(own, "filename", "left")
    found = F.coalesce(F.contains("_text", normalise_quotes(F.col("quote"))), F.lit(False))
    chart = F.coalesce(F.contains("location", F.lit("chart image")), F.lit(False)) if "location" in quotes.columns else F.lit(False)
    status = F.when(F.col("_text").isNull(), "no document").when(found, "ok").when(chart, "note").otherwise("missing")
    return joined.withColumns({"found": found, "status": status}).drop("_text")


def check_cells(expected: DataFrame, cells: DataFrame) -> DataFrame:
    """expected (id, filename, sheet, ref, value) with actual and matches: numbers within a millionth, else equal normalised texts."""
    joined = expected.join(cells.select("filename", "sheet", "ref", F.col("value").alias("actual")), ["filename", "sheet", "ref"], "left")
    a, b = F.col("actual").try_cast("double"), F.col("value").try_cast("double")
    same = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-6).otherwise(normalise_quotes(F.col("actual")) == normalise_quotes(F.col("value")))
    return joined.withColumn("matches", F.coalesce(same, F.lit(False)))


def _paired() -> Column:
    return F.coalesce(F.col("temporal_pair_id") != "", F.lit(False))


def subset_temporal(items: DataFrame) -> DataFrame:
    return items.where(_paired()).orderBy("ord")


def subset_multimodal(items: DataFrame) -> DataFrame:
    """Answerable items of no pair on tables, sheets and charts."""
    return items.where(~_paired() & F.coalesce("answerable", F.lit(False)) & F.col("modality").isin("table", "chart", "spreadsheet")).orderBy("ord")


def _first_pairs(items: DataFrame, n: int) -> DataFrame:
    first = items.where(_paired()).groupBy("temporal_pair_id").agg(F.min("ord").alias("o"))
    return first.orderBy("o").limit(n).select("temporal_pair_id")


def subset_smoke(items: DataFrame) -> DataFrame:
    """The first pair, and the first answerable table, the first answerable chart and the first unanswerable item."""
    first = items.join(F.broadcast(_first_pairs(items, 1)), "temporal_pair_id", "left_semi").select("ord")
    yes = F.coalesce("answerable", F.lit(False))
    kind = F.when(yes & F.col("modality").isin("table", "chart"), F.col("modality")).when(F.col("answerable") == F.lit(False), "unanswerable")
    single = items.where(kind.isNotNull()).groupBy(kind.alias("kind")).agg(F.min("ord").alias("ord")).select("ord")
    return items.join(F.broadcast(first.union(single).distinct()), "ord", "left_semi").select(items.columns).orderBy("ord")


#: The first pairs, and how many other items of each class.
CORE_PAIRS, CORE_COUNTS = 8, {"unanswerable": 6, "table": 8, "spreadsheet": 4, "chart": 6}


def _core_kind() -> Column:
    return F.when(F.col("answerable") == F.lit(False), "unanswerable").otherwise(F.col("modality"))


def subset_core(items: DataFrame, pairs: int = CORE_PAIRS, counts: dict[str, int] = CORE_COUNTS) -> DataFrame:
    """All items of the first pairs, and the first few of each class among the other items, in source order."""
    first = F.broadcast(_first_pairs(items, pairs))  # that many rows
    paired = items.join(first, "temporal_pair_id", "left_semi")
    rest = items.join(first, "temporal_pair_id", "left_anti").withColumn("_kind", _core_kind()).where(F.col("_kind").isin(*counts))
    most = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy("_kind").orderBy("ord"))).where(F.col("_n") <= most[F.col("_kind")])
    return paired.select(items.columns).unionByName(rest.select(items.columns)).orderBy("ord")


def core_shortfalls(items: DataFrame, pairs: int = CORE_PAIRS, counts: dict[str, int] = CORE_COUNTS) -> DataFrame:
    """class, wanted, held of the classes, and of the pairs, of which there are fewer than the core set wants."""
    rest = items.join(F.broadcast(_first_pairs(items, pairs)), "temporal_pair_id", "left_anti")
    held = rest.groupBy(_core_kind().alias("class")).agg(F.count("*").alias("held"))
    held = held.unionByName(items.where(_paired()).agg(F.lit("pairs").alias("class"), F.count_distinct("temporal_pair_id").alias("held")))
    wanted = items.sparkSession.createDataFrame([*counts.items(), ("pairs", pairs)], "class string, wanted int")
    return wanted.join(held, "class", "left").na.fill(0, ["held"]).where("held < wanted")


def check_pairs_intact(subset: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs that the subset holds in part."""
    count = lambda df: df.where("temporal_pair_id is not null").groupBy("temporal_pair_id").agg(F.count("*").alias("n"))
    return count(subset).join(count(full).withColumnRenamed("n", "m"), "temporal_pair_id").where("n <> m").select("temporal_pair_id", "n", "m")
