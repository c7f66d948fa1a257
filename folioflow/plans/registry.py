"""Queries by name over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions import text as T
from ..operators import consolidation, extraction, flow, masking, pages, segments, validation
from .sql import ORACLE_SQL  # noqa: F401  part of the registry

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark, sf_dir):
    return sources.documents(spark, sf_dir)


def _regions(spark, sf_dir):
    return pages.regions(pages.strip_artifacts(pages.lines(sources.letters(spark, sf_dir))))


def _fields(spark, sf_dir):
    return extraction.extract_by_rule(_regions(spark, sf_dir))


def _validated(spark, sf_dir):
    return validation.validate(_fields(spark, sf_dir), sources.letters(spark, sf_dir))


def _tokens(spark, sf_dir):
    return masking.assign_tokens(masking.maskable(masking.detect(_docs(spark, sf_dir))))


@query
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_quality(_docs(spark, sf_dir), "text").select("doc_id", "quality.*")


@query
def source_select(spark, sf_dir):
    scanned = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.col("text").alias("ocr_text"))
    rows = _docs(spark, sf_dir).withColumnRenamed("text", "native_text").join(scanned, "doc_id", "left")
    out = pages.select_source(rows)
    return out.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("selected_text")).alias("chars"))


@query
def ligature_fix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.fix_ligatures(F.concat(F.lit("ﬁ“x”—…• ­"), F.regexp_replace("text", "fi", "ﬁ")))).alias("fixed"))


@query
def whitespace_norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_space(F.replace("text", F.lit("."), F.lit(".  \n\n\n")))).alias("x"))


@query
def hyphen_repair(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.join_hyphens(F.regexp_replace("text", "the", "th-\n e"))).alias("x"))


@query
def ocr_noise(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.remove_noise(F.replace("text", F.lit("on"), F.lit("→ ☃on")))).alias("x"))


@query
def unicode_nfc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.nfc(F.replace("text", F.lit("e"), F.lit("é")))).alias("x"))


@query
def cleaned_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query
def est_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query
def artifact_strip(spark, sf_dir):
    return pages.strip_artifacts(pages.lines(sources.letters(spark, sf_dir))).groupBy("doc_id", "page_number").agg(F.count("*").alias("n"), F.max("line_no").alias("last"))


@query
def region_islands(spark, sf_dir):
    return _regions(spark, sf_dir)


@query
def region_counts(spark, sf_dir):
    return _regions(spark, sf_dir).groupBy("region_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def document_regions(spark, sf_dir):
    done, _ = pages.preprocess(_docs(spark, sf_dir), "text")
    return done.select("doc_id", F.md5("plain_text").alias("plain"), "has_table", "has_key_value")


@query
def page_structure(spark, sf_dir):
    return pages.page_counts(pages.normalized_pages(sources.letters(spark, sf_dir), _regions(spark, sf_dir)), "page_number")


@query
def kv_extract(spark, sf_dir):
    return _fields(spark, sf_dir).select("doc_id", "page_number", "field_name", "value")


@query
def kv_dedupe(spark, sf_dir):
    return extraction.distinct_lines(_regions(spark, sf_dir)).select("doc_id", "page_number", F.size("lines").alias("n"), F.array_join("lines", "|").alias("lines"))


@query
def heading_asof(spark, sf_dir):
    return extraction.nearest_heading(_regions(spark, sf_dir)).select("doc_id", "page_number", "region_idx", "section_header")


@query
def pii_spans(spark, sf_dir):
    return masking.detect(_docs(spark, sf_dir)).groupBy("doc_id", "entity_type", "value").agg(F.count("*").alias("n"))


@query
def mask_summary(spark, sf_dir):
    return masking.summary(masking.mask_entries(_tokens(spark, sf_dir)))


@query
def mask_tokens(spark, sf_dir):
    return masking.mask_entries(_tokens(spark, sf_dir)).select("doc_id", "mask_token", "original_value")


@query
def masked_text(spark, sf_dir):
    return masking.masked_pages(_docs(spark, sf_dir), _tokens(spark, sf_dir)).select("doc_id", "entities_masked", F.md5("masked_text").alias("masked_text"))


@query
def rehydrate_roundtrip(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    masked = masking.masked_pages(_docs(spark, sf_dir), tokens).select("doc_id", "masked_text")
    back = masking.rehydrated(masked, masking.mask_entries(tokens), "masked_text")
    return back.select("doc_id", F.md5("masked_text").alias("x"), "is_rehydrated")


@query
def segment_pack(spark, sf_dir):
    rows = sources.conversations(spark, sf_dir)
    return segments.prompts(segments.segment(pages.regions(pages.strip_artifacts(pages.lines(rows))), segments.Budget(300, 20)))


@query
def alias_map(spark, sf_dir):
    mapped = extraction.map_targets(_fields(spark, sf_dir))
    return mapped.groupBy("target").agg(F.count("*").alias("n"))


@query
def fuzzy_map(spark, sf_dir):
    """Names of parts and labels of letters, each but for its last letter: what no alias has."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("field_name"))
    labels = _fields(spark, sf_dir).select(F.expr("left(field_name, length(field_name) - 1)").alias("field_name"))
    return extraction.map_targets(parts.union(labels), closed=False).groupBy("field_name", "target").agg(F.count("*").alias("n"))


@query
def normalised_values(spark, sf_dir):
    rows = extraction.normalize_values(extraction.map_targets(_fields(spark, sf_dir).withColumn("evidence", F.lit(""))))
    return rows.groupBy("target", "value").agg(F.count("*").alias("n"))


@query
def field_parse_json(spark, sf_dir):
    """Labelled values written as an extractor's answer for each page, and read back."""
    answer = F.to_json(F.struct(F.collect_list(F.struct(F.col("field_name").alias("field"), "value", "confidence", "evidence")).alias("fields")))
    rows = _fields(spark, sf_dir).groupBy("doc_id", "page_number").agg(answer.alias("response"))
    return extraction.parse_fields(rows).select("doc_id", "page_number", "field_name", "value", "confidence", "evidence")


@query
def fallback_trigger(spark, sf_dir):
    """Regions as segments, and the values found in them."""
    name = F.concat_ws("_", F.lit("seg"), F.col("page_number").cast("string"), F.col("region_idx").cast("string")).alias("segment_id")
    found = _regions(spark, sf_dir)
    segs = found.select("doc_id", name, "text", (F.col("region_type") == "key_value").alias("is_key_value_block"))
    valued = extraction.extract_by_rule(found).where(~F.lower("value").isin(extraction.NO_VALUE)).select("doc_id", name, "confidence")
    return extraction.needs_fallback(segs, valued).select("doc_id", "segment_id", "fallback")


def _scanned(spark, sf_dir):
    return sources.letters(spark, sf_dir).withColumnRenamed("text", "native_text").withColumn("ocr_text", F.lit(""))


def _flow(spark, sf_dir):
    return flow.run(_scanned(spark, sf_dir), budget=segments.Budget(min_tokens=1), keep=sources.kept)


@query
def flow_report(spark, sf_dir):
    """Letters through the whole flow, from pages to the report's table of fields."""
    sheet = _flow(spark, sf_dir).sheets["Extracted Fields"]
    return sheet.select("doc_id", F.col("#").alias("place"), F.col("Field Name").alias("field_name"), F.col("Value").alias("value"), F.col("Occurrences").alias("occurrence_count"), F.col("Conflict").alias("has_conflict"), F.col("Status").alias("validation_status"))


@query
def cost_summary(spark, sf_dir):
    """Tokens and cost of the answers; fields are counted, not checked."""
    out = flow.usage(_scanned(spark, sf_dir), budget=segments.Budget(min_tokens=1), keep=sources.kept)
    return out.withColumn("models_used", F.array_join("models_used", ","))


@query
def field_checks(spark, sf_dir):
    rows = validation.check_fields(_fields(spark, sf_dir))
    return rows.groupBy("is_valid", "should_flag", "check_reason").agg(F.count("*").alias("n"))


@query
def grounding(spark, sf_dir):
    """Every value, and those with wider spaces, looked for from the first page on."""
    wide = F.when(F.col("value").contains(" "), F.replace("value", F.lit(" "), F.lit("  ")))
    fields = _fields(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), "field_name", F.explode(F.array_compact(F.array("value", wide))).alias("value"))
    rows = validation.grounded(fields, sources.letters(spark, sf_dir))
    return rows.select("doc_id", "field_name", "value", "grounding.*").distinct()


@query
def validate_status(spark, sf_dir):
    return _validated(spark, sf_dir).select("doc_id", "page_number", "field_name", "validation_status", "rejection_reason")


@query
def validation_report(spark, sf_dir):
    return validation.report(_validated(spark, sf_dir), "field_name")


@query
def consolidated_fields(spark, sf_dir):
    return consolidation.consolidate(_validated(spark, sf_dir)).select("doc_id", "name_key", "field_name", "value", "occurrence_count", "has_conflict")


@query
def consolidation_summary(spark, sf_dir):
    return consolidation.summary(consolidation.consolidate(_validated(spark, sf_dir)))


@query
def field_table(spark, sf_dir):
    return consolidation.listed(consolidation.consolidate(_validated(spark, sf_dir))).select("doc_id", "place", "field_name", "short_value", "mark")


@query
def category_hints(spark, sf_dir):
    return _fields(spark, sf_dir).select("field_name", consolidation.category_hint(F.col("field_name")).alias("hint")).groupBy("field_name", "hint").agg(F.count("*").alias("n"))


@query
def name_canonical(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.col("p_name"), F.lit(" usd amount (tax id):")).alias("x"))
    return rows.select("p_partkey", consolidation.name_key(F.col("x")).alias("name_key"), consolidation.display_name(F.regexp_replace("x", ":+$", "")).alias("display"))


def _candidates(spark, sf_dir):
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("doc_id"), F.format_string("cand_%09d", key).alias("candidate_id"), F.col("o_orderpriority").alias("candidate_name"), F.col("o_orderstatus").alias("value"),
        F.array((key % 9).cast("int")).alias("page_numbers"), F.element_at(F.array(*map(F.lit, ("KEEP", "KEEP", "MERGE", "REJECT", "REVIEW"))), (key % 5 + 1).cast("int")).alias("decision"),
        F.col("o_orderpriority").alias("suggested_canonical_name"),
    )


@query
def tier_collapse(spark, sf_dir):
    out = consolidation.collapse_candidates(_candidates(spark, sf_dir))
    return out.withColumn("page_numbers", F.array_join("page_numbers", ","))


@query
def tier_audit(spark, sf_dir):
    return consolidation.collapse_audit(_candidates(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query
def tier_decisions(spark, sf_dir):
    return consolidation.decision_counts(_candidates(spark, sf_dir))


@query
def tier_canonical(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    first = rows.where("decision = 'KEEP'").groupBy("doc_id").agg(F.min("candidate_id").alias("merge_into_candidate_id"))
    out = consolidation.canonical_fields(consolidation.selected(rows.join(first, "doc_id", "left")))
    return out.select("doc_id", "canonical_field_name", "value", "status", F.array_join("source_candidate_ids", ",").alias("sources"), F.array_join("page_numbers", ",").alias("pages"))


@query
def fee_names(spark, sf_dir):
    amount = F.floor("o_totalprice").cast("string")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(consolidation.fee_name(F.lit("USD"), amount).alias("canonical_field_name")).agg(F.count("*").alias("n"))


@query
def ui_filter(spark, sf_dir):
    rows = consolidation.marked(consolidation.consolidate(_validated(spark, sf_dir)))
    return consolidation.search(rows, "FEE").select("doc_id", "field_name", "short_value", "band", consolidation.live_status(F.col("confidence")).alias("live"))


@query
def event_windows(spark, sf_dir):
    return streaming.windows(spark.read.parquet(f"{sf_dir}/events.parquet")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))
