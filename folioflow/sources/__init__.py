"""Reading documents as pages, and writing results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters in SQL that Spark and DuckDB read alike: a first page of labelled values (some absent, generic or long) with page artifacts,
#: a second with a table of items, a repeated value and sometimes another spelling, and for urgent orders a third that is one sentence.
LETTERS = """
SELECT o.o_orderkey AS doc_id, p.page_number, CASE
  WHEN p.page_number = 1 THEN concat_ws(chr(10),
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'REF' || CAST(o.o_orderkey AS STRING) || '-A1' END, 'ORDER CONFIRMATION', '',
    'Order Key: ' || CAST(o.o_orderkey AS STRING), 'Client Name: ' || c.c_name,
    'Payment Terms: ' || CASE o.o_orderkey % 4 WHEN 0 THEN CAST(o.o_orderkey % 90 + 1 AS STRING) || ' business days' WHEN 1 THEN 'thirty days' WHEN 2 THEN 'upon receipt' ELSE 'N/A' END,
    'Fee Type: ' || CASE o.o_orderkey % 5 WHEN 0 THEN 'flat fee' WHEN 1 THEN 'hourly rates, not to exceed budget' WHEN 2 THEN 'monthly retainer' WHEN 3 THEN 'milestone and lump sum'
      ELSE 'as agreed between both parties in writing' END,
    CASE WHEN o.o_orderkey % 7 = 0 THEN 'Name: ' || c.c_mktsegment END, 'Page 7 : ignored', '',
    'this letter confirms the order of ' || c.c_name || ' in segment ' || c.c_mktsegment, 'and its priority ', 'Fee Basis: inside a paragraph', '', 'Page 1 of 2')
  WHEN p.page_number = 2 THEN concat_ws(chr(10), 'Items And Prices', 'Line' || chr(9) || 'Quantity' || chr(9) || 'Flag', i.first_item, i.second_item, '', i.third_item, '',
    'Client Name: ' || CASE WHEN o.o_orderkey % 6 = 0 THEN upper(c.c_name) || '.' WHEN o.o_orderkey % 6 = 1 THEN 'Other ' || c.c_name ELSE c.c_name END,
    'Due: ' || CASE o.o_orderkey % 3 WHEN 0 THEN 'upon receipt' WHEN 1 THEN 'twenty days' ELSE 'TBD' END,
    'Payment Trigger: ' || CASE o.o_orderkey % 5 WHEN 0 THEN 'Within ' || CAST(o.o_orderkey % 20 + 1 AS STRING) || ' business days of the invoice' WHEN 1 THEN 'no later than 30 days from invoice'
      WHEN 2 THEN 'from the invoice date' WHEN 3 THEN 'upon receipt' ELSE 'see annex' END,
    CASE WHEN o.o_orderkey % 2 = 0 THEN '- 2 -' ELSE 'Page 2 of 2' END)
  ELSE 'the order is urgent and goes out first, as priority ' || o.o_orderpriority || ' asks' END AS text
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN (SELECT l_orderkey,
    max(CASE WHEN l_linenumber = 1 THEN '1' || chr(9) || CAST(CAST(l_quantity AS INT) AS STRING) || chr(9) || l_returnflag END) AS first_item,
    max(CASE WHEN l_linenumber = 2 THEN '2' || chr(9) || CAST(CAST(l_quantity AS INT) AS STRING) || chr(9) || l_returnflag END) AS second_item,
    max(CASE WHEN l_linenumber = 3 THEN '3' || chr(9) || CAST(CAST(l_quantity AS INT) AS STRING) || chr(9) || l_returnflag END) AS third_item
  FROM {lineitem} GROUP BY l_orderkey) i ON o.o_orderkey = i.l_orderkey
JOIN (SELECT 1 AS page_number UNION ALL SELECT 2 AS page_number UNION ALL SELECT 3 AS page_number) p ON p.page_number < 3 OR o.o_orderpriority = '1-URGENT'
"""
PAGES = "doc_id string, page_number int, native_text string, ocr_text string"


Decoder = Callable[[bytes], list[tuple[str, object]]]


def read_files(spark: SparkSession, path: str, decode: Decoder, recognise: Callable[[object], str] | None = None, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """One row per page of each file: decode(content) gives (native_text, image) by page, recognise(image) the text in an image.

    recognise None: images are not read. A page whose recognition fails has an empty ocr_text; a missing path is an error.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.path, pdf.content):
                stem = unquote(name.rsplit("/", 1)[-1]).rsplit(".", 1)[0]
                rows.extend((stem, i, a or "", _recognised(recognise, b)) for i, (a, b) in enumerate(decode(bytes(content)), 1))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "native_text", "ocr_text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, PAGES)


def _recognised(recognise, image) -> str:
    if recognise is None or image is None:
        return ""
    try:
        return recognise(image) or ""
    except Exception:  # recognition is best effort; the page stays, by its native text
        return ""


def first_file(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the first file: *.pdf by name, else *.PDF, else *.Pdf."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path")
    kind = F.substring_index("path", ".", -1)
    return files.where(kind.isin("pdf", "PDF", "Pdf")).orderBy(F.array_position(F.array(*map(F.lit, ("pdf", "PDF", "Pdf"))), kind), "path").limit(1)


def plain_text(content: bytes) -> list[tuple[str, object]]:
    """The default decoder: UTF-8 text, pages divided by form feeds, no images."""
    return [(page, None) for page in content.decode("utf-8", errors="replace").split("\f")]


def spread(df: DataFrame, split_bytes: int = 64 << 20, source: DataFrame | None = None) -> DataFrame:
    """df dealt evenly to all cores if it is too small for the scan to do so (a file of one row group is one task); else as it is.

    source: the table whose size decides; of a join Spark takes the product of the sizes, which is never small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = (source or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * split_bytes else df


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names and read again; the files go when the driver ends.

    Only a session whose tasks all run here may name none.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/folioflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended before the interpreter: nothing can be removed any more
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one-page documents."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page_number"), "text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as documents of a page for each turn."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as letters of two or three pages, see LETTERS."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem")}
    return spread(spark.sql(LETTERS, **named), 2 << 20, named["lineitem"])


def _private(spark: SparkSession, path: str) -> None:
    """Only the owner may read or write below path, where the file system knows permissions."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setPermission(folder, jvm.org.apache.hadoop.fs.permission.FsPermission("700"))


def write_masks(entries: DataFrame, path: str) -> None:
    """Token maps as JSON: one row a document with its entries and their counts by type. They hold original values, so only the
    owner may read the folder.
    """
    by_type = entries.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n")).groupBy("doc_id")
    summary = by_type.agg(F.sum("n").alias("total_masked"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("summary"))
    inner = F.struct("mask_token", "original_value", "entity_type", "score", "first_seen_page", "occurrences")
    rows = summary.join(entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(inner)).alias("entries")), "doc_id")
    rows.withColumn("saved_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).write.mode("overwrite").json(path)
    _private(entries.sparkSession, path)


def read_masks(spark: SparkSession, path: str, doc_type: str = "bigint") -> DataFrame:
    """Entries written by write_masks; masking.counters tells the highest number of each type, and masking.assign_tokens goes on from there."""
    entry = (
        "array<struct<mask_token:string,original_value:string,entity_type:string,score:double,first_seen_page:int,"
        "occurrences:array<struct<page_number:int,start:int,end:int>>>>"
    )
    return spark.read.schema(f"doc_id {doc_type}, entries {entry}").json(path).select("doc_id", F.inline("entries"))


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Each report table as Parquet in a folder of its name."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name.replace(' ', '_').lower()}")
