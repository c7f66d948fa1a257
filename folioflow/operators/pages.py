"""Page quality, choice of source, cleaning, and regions of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# How lines of each kind look. The key is the first group of KEY_VALUE's match up to the colon.
KEY_VALUE = r"(?d)^[A-Z][A-Za-z0-9 /\-()]{1,60}\s*:\s*.+$"
TABLE_LINE = r"(?d)^.+(\t{1,}|\s{3,}).+$"
HEADING = r"^(?:[A-Z][A-Z\s\-/]{3,60}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,8})$"
PAGE_NUMBER = r"(?i)^\s*(?:page\s+\d+\s+of\s+\d+|-\s*\d+\s*-|\d{1,3})\s*$"
REFERENCE = r"^\s*[A-Z0-9]{3,20}[-/][A-Z0-9]{2,15}\s*$"
#: Line ends of text, as Unicode has them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def with_quality(pages: DataFrame, text: str, name: str = "quality") -> DataFrame:
    """pages with struct(usable, char_count, printable_ratio, alpha_ratio, reason), ratios to four digits; the first failing test is the reason.

    Characters are counted once, in a projection below the one that judges.
    """
    c = F.col(text)
    counted = pages.withColumn("_counted", F.struct(
        F.length(c).alias("total"), (F.length(T.strip(F.coalesce(c, F.lit("")))) == 0).alias("blank"),
        F.regexp_count(c, F.lit(r"[\p{Cc}\p{Cs}\p{Co}\p{Cn}]")).alias("hidden"), F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")).alias("alnum"),
    ))
    total, blank = F.col("_counted.total"), F.col("_counted.blank")
    printable, alnum = (total - F.col("_counted.hidden")) / total, F.col("_counted.alnum") / total
    reason = (
        F.when(blank, "empty or whitespace-only text").when(total < 20, "too few characters")
        .when(printable < 0.70, "too few printable characters").when(alnum < 0.40, "too few letters and digits").otherwise("usable")
    )
    return counted.withColumn(name, F.struct(
        (reason == "usable").alias("usable"), F.when(blank, 0).otherwise(total).alias("char_count"),
        F.when(blank, 0.0).otherwise(F.round(printable, 4)).alias("printable_ratio"), F.when(blank, 0.0).otherwise(F.round(alnum, 4)).alias("alpha_ratio"),
        reason.alias("reason"),
    )).drop("_counted")


def select_source(pages: DataFrame) -> DataFrame:
    """pages (.., native_text, ocr_text) with quality, selected_text and source_type: native if usable, else ocr, else empty."""
    q = with_quality(pages, "native_text")
    ocr = F.length(T.strip(F.coalesce("ocr_text", F.lit("")))) > 0
    return q.withColumns({
        "source_type": F.when(F.col("quality.usable"), "native").when(ocr, "ocr").otherwise("empty"),
        "selected_text": F.when(F.col("quality.usable"), F.col("native_text")).when(ocr, F.col("ocr_text")).otherwise(""),
    })


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page_number, line_no, line), line_no from 0."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")  # one last line end opens no line
    return pages.select("doc_id", "page_number", F.posexplode(F.split(body, LINE_END)).alias("line_no", "line"))


def strip_artifacts(rows: DataFrame, depth: int = 3) -> DataFrame:
    """lines without the run of blank, short, page-number and reference lines at the top and bottom (at most depth each); renumbered."""
    own = Window.partitionBy("doc_id", "page_number")
    bare = F.col("_bare")
    rows = rows.withColumn("_bare", T.strip(F.col("line")))
    junk = (F.length(bare) < 6) | bare.rlike(PAGE_NUMBER) | bare.rlike(REFERENCE)
    rows = rows.withColumn("_junk", junk).drop("_bare").withColumn("_last", F.max("line_no").over(own))
    keeper = F.when(~F.col("_junk"), F.col("line_no"))
    rows = rows.withColumn("_first_keep", F.min(keeper).over(own)).withColumn("_last_keep", F.max(keeper).over(own))
    top = F.least(F.coalesce("_first_keep", F.col("_last") + 1), F.lit(depth))
    bottom = F.greatest(F.coalesce("_last_keep", F.lit(-1)), F.col("_last") - depth, top - 1)
    rows = rows.where((F.col("line_no") >= top) & (F.col("line_no") <= bottom))
    return rows.select("doc_id", "page_number", (F.row_number().over(own.orderBy("line_no")) - 1).alias("line_no"), "line")


def regions(rows: DataFrame) -> DataFrame:
    """(doc_id, page_number, region_idx, region_type, text, line_start, line_end) as islands of line classes.

    A paragraph runs from the first line that is no heading, key-value or table line to the next blank line; a
    table runs over table lines and blanks; adjacent key-value lines are one region; a heading is one line.
    All windows share the page's partitioning, so there is one shuffle.
    """
    page = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    bare = F.col("bare")
    r = rows.withColumn("bare", T.strip(F.col("line"))).withColumns({"b": F.length(bare) == 0, "h": bare.rlike(HEADING) & (F.length(bare) < 80), "k": bare.rlike(KEY_VALUE), "t": F.col("line").rlike(TABLE_LINE)})
    r = r.withColumn("block", F.sum(F.col("b").cast("int")).over(page))
    plain = F.when(~F.col("b") & ~F.col("h") & ~F.col("k") & ~F.col("t"), F.col("line_no"))
    r = r.withColumn("plain", F.min(plain).over(Window.partitionBy("doc_id", "page_number", "block")))
    r = r.withColumn("p", ~F.col("b") & F.coalesce(F.col("line_no") >= F.col("plain"), F.lit(False)))
    r = r.withColumn("run_line", F.col("b") | (F.col("t") & ~F.col("p")))
    r = r.withColumn("run", F.sum((~F.col("run_line")).cast("int")).over(page))
    start = F.when(F.col("run_line") & F.col("t") & ~F.col("h") & ~F.col("k") & ~F.col("b"), F.col("line_no"))
    r = r.withColumn("table_from", F.min(start).over(Window.partitionBy("doc_id", "page_number", "run")))
    kind = (
        F.when(F.col("run_line") & F.coalesce(F.col("line_no") >= F.col("table_from"), F.lit(False)), "table")
        .when(F.col("b"), None).when(F.col("p"), "paragraph").when(F.col("h"), "heading").otherwise("key_value")
    )
    r = r.withColumn("kind", kind).where("kind is not null")
    fresh = (F.col("kind") == "heading") | ~F.lag("kind").over(page).eqNullSafe(F.col("kind")) | (F.lag("line_no").over(page) != F.col("line_no") - 1)
    r = r.withColumn("idx", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(page) - 1)
    body = F.when(F.col("kind") == "table", F.col("line")).otherwise(bare)
    out = r.groupBy("doc_id", "page_number", F.col("idx").cast("int").alias("region_idx"), F.col("kind").alias("region_type")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("x")))), lambda s: s["x"]).alias("xs"),
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"),
    )
    text = F.when(F.col("region_type") == "paragraph", F.array_join("xs", " ")).otherwise(F.array_join("xs", "\n"))
    return out.select("doc_id", "page_number", "region_idx", "region_type", text.alias("text"), "line_start", "line_end")


#: The patterns of lines as Arrow reads them: without the flag of Unix line ends, as no line holds one.
_ARROW = {name: pattern.removeprefix("(?d)") for name, pattern in (("page", PAGE_NUMBER), ("reference", REFERENCE), ("heading", HEADING), ("key_value", KEY_VALUE), ("table", TABLE_LINE))}
KINDS = ("table", "paragraph", "heading", "key_value")


def _matches(lines: pa.Array, name: str) -> np.ndarray:
    return pc.match_substring_regex(lines, _ARROW[name]).to_numpy(zero_copy_only=False)


def _least(values: np.ndarray, some: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each line the least value of those marked in its group, which begins where fresh says; beyond all values if none is."""
    begin = np.flatnonzero(fresh)
    least = np.minimum.reduceat(np.where(some, values, np.iinfo(np.int64).max), begin)
    return np.repeat(least, np.diff(np.append(begin, len(values))))


def _first(*ids: np.ndarray) -> np.ndarray:
    """Whether a line is the first of those with its ids, which stand together."""
    out = np.ones(len(ids[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
    return out


def _regions_of(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(place of the page, region_idx, place in KINDS, text, line_start, line_end) of all regions of the pages, in order."""
    split = pc.split_pattern_regex(pc.replace_substring_regex(texts, rf"(?:{LINE_END})\z", ""), LINE_END)
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    page, no = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lines = split.flatten()
    bare = pc.utf8_trim(lines, T.BLANKS)
    length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    keeper = ~((length < 6) | _matches(bare, "page") | _matches(bare, "reference"))
    # as in strip_artifacts
    last, first_keep, last_keep = sizes - 1, sizes.copy(), np.full(len(sizes), -1)
    np.minimum.at(first_keep, page[keeper], no[keeper])
    np.maximum.at(last_keep, page[keeper], no[keeper])
    top = np.minimum(first_keep, depth)
    bottom = np.maximum(np.maximum(last_keep, last - depth), top - 1)
    own = np.flatnonzero((no >= top[page]) & (no <= bottom[page]))
    page, no, length, lines, bare = page[own], (no - top[page])[own], length[own], lines.take(pa.array(own)), bare.take(pa.array(own))
    if not len(own):
        return page, no, no, bare, no, no
    # as in regions
    b, h, k, t = length == 0, _matches(bare, "heading") & (length < 80), _matches(bare, "key_value"), _matches(lines, "table")
    p = ~b & (no >= _least(no, ~b & ~h & ~k & ~t, _first(page, np.cumsum(b))))
    run_line = b | (t & ~p)
    table = run_line & (no >= _least(no, run_line & t & ~h & ~k & ~b, _first(page, np.cumsum(~run_line))))
    kind = np.select([table, b, p, h], [0, -1, 1, 2], 3)
    kept = np.flatnonzero(kind >= 0)
    page, no, kind, lines, bare = page[kept], no[kept], kind[kept], lines.take(pa.array(kept)), bare.take(pa.array(kept))
    if not len(kept):
        return page, no, kind, bare, no, no
    fresh = _first(page, kind) | (kind == 2)
    fresh[1:] |= no[1:] != no[:-1] + 1
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(no))
    body = pc.if_else(pa.array(kind == 0), lines, bare)
    gathered = pa.ListArray.from_arrays(pa.array(np.append(begin, len(no)).astype(np.int32)), body)
    text = pc.binary_join(gathered, pc.if_else(pa.array(kind[begin] == 1), " ", "\n"))
    pages = page[begin]
    nth = np.arange(len(begin))
    idx = nth - np.maximum.accumulate(np.where(_first(pages), nth, 0))
    return pages, idx, kind[begin], text, no[begin], no[end - 1]


def page_regions(pages: DataFrame, text: str = "text", depth: int = 3, whole: bool = False) -> DataFrame:
    """regions(strip_artifacts(lines(pages, text), depth)), of all lines of a batch of pages at once and without a shuffle.

    Each row is a page: rows of one page number are read each by itself. whole: a text without regions is one paragraph, unless it is empty.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("doc_id", "page_number")}
    schema = f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, region_idx int, region_type string, text string, line_start int, line_end int"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(2)
            page, idx, kind, body, start, end = _regions_of(texts, depth)
            columns = [batch.column(0).take(pa.array(page)), batch.column(1).take(pa.array(page)), *(pa.array(x.astype(np.int32)) for x in (idx, kind)), body, *(pa.array(x.astype(np.int32)) for x in (start, end))]
            columns[3] = pa.array(KINDS).take(columns[3])
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if whole:
                bare = np.ones(len(texts), dtype=bool)
                bare[page] = False
                bare = pa.array(np.flatnonzero(bare & (pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0)))
                n, none = len(bare), pa.nulls(len(bare), pa.int32())
                some = [batch.column(0).take(bare), batch.column(1).take(bare), pa.array(np.zeros(n, np.int32)), pa.array(["paragraph"] * n, pa.string()), texts.take(bare), none, none]
                yield pa.RecordBatch.from_arrays(some, names=names)

    return pages.select("doc_id", "page_number", F.col(text).cast("string")).mapInArrow(run, schema)


def normalized_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One row per page, empty ones too: all columns of pages with plain_text, has_table, has_key_value."""
    agg = found.groupBy("doc_id", "page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_idx", "text"))), lambda s: s["text"]), "\n").alias("plain_text"),
        F.bool_or(F.col("region_type") == "table").alias("has_table"), F.bool_or(F.col("region_type") == "key_value").alias("has_key_value"),
    )
    return pages.join(agg, ["doc_id", "page_number"], "left").fillna({"plain_text": "", "has_table": False, "has_key_value": False})


def cleaned(pages: DataFrame, text: str = "selected_text") -> DataFrame:
    """pages with original_text and cleaned_text; a blank page stays, with empty texts.

    Each step is a projection of its own, as a step that names the one before several times would run it as often.
    """
    blank = F.length(T.strip(F.coalesce(text, F.lit("")))) == 0
    own = pages.withColumn("original_text", F.when(blank, "").otherwise(F.col(text)))
    raw = F.col("original_text")
    own = own.withColumn("_plain", T.fix_ligatures(raw))
    own = own.withColumn("_whole", T.composed(F.col("_plain"), raw)).drop("_plain")
    own = own.withColumn("_quiet", T.remove_noise(F.col("_whole"))).drop("_whole")
    return own.withColumn("cleaned_text", F.when(F.length(raw) == 0, raw).otherwise(T.normalize_space(T.join_hyphens(F.col("_quiet"))))).drop("_quiet")


def structured(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned pages with structure and body, the text to go on with; their regions).

    body is the structured text, or the cleaned one where there are no regions.
    """
    found = regions(strip_artifacts(lines(own, "cleaned_text")))
    done = normalized_pages(own, found)
    return done.withColumn("body", F.coalesce(F.nullif("plain_text", F.lit("")), "cleaned_text")), found


def preprocess(pages: DataFrame, text: str = "selected_text") -> tuple[DataFrame, DataFrame]:
    """(pages with original_text, cleaned_text, structure and body; their regions): see cleaned and structured."""
    return structured(cleaned(pages, text))


def page_counts(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages, and how many hold labelled values and tables."""
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if("has_key_value").alias("with_key_values"), F.count_if("has_table").alias("with_tables"))
