"""File sources: routing, CSV, JSON records, JSON flattening.

* Routing reads only ``path`` and ``length`` from the ``binaryFile`` source
  (content is not read unless selected) and filters on length there.
* CSV: Spark's reader with header and type inference; files whose bytes are
  not valid UTF-8 are re-read as Latin-1 (a per-file decision; a file that
  holds the replacement character itself stays UTF-8).
* JSON objects are flattened with ``parse_json`` + ``variant_explode``, level
  by level (lateral joins, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize

MAX_BYTES = 10 * 1024 * 1024

# FIXED VALUES: accepted extensions and the reader each one goes to.
EXTENSION_TYPES = [("csv", "csv"), ("xlsx", "excel"), ("xls", "excel"), ("pdf", "pdf"), ("doc", "docx"),
                   ("docx", "docx"), ("json", "json"), ("txt", "txt")]


def scan_route(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, recursive: bool = True) -> DataFrame:
    """(path, length, extension, file_type, accepted, empty) for every file."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .load(path).select("path", "length"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    ftype = F.lit("unknown")
    for e, t in reversed(EXTENSION_TYPES):
        ftype = F.when(ext == e, t).otherwise(ftype)
    return files.select(
        "path", "length", ext.alias("extension"), ftype.alias("file_type"),
        ((ftype != "unknown") & (F.col("length") <= max_bytes)).alias("accepted"),
        (F.col("length") == 0).alias("empty"))


def scan_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with header and inferred types; Latin-1 for files UTF-8 cannot decode."""
    utf8 = spark.read.option("header", True).option("inferSchema", infer).option("encoding", "UTF-8").csv(path)
    probe = (spark.read.text(path).select(F.input_file_name().alias("f"), "value")
             .where(~F.is_valid_utf8("value")).select("f").distinct())  # lines hold the bytes of the file
    bad = [r["f"] for r in probe.collect()]  # file names only (bounded by the file count)
    if not bad:
        return utf8
    good = utf8.where(~F.input_file_name().isin(bad))
    latin = spark.read.option("header", True).option("inferSchema", infer).option("encoding", "ISO-8859-1") \
        .csv(bad)
    return good.unionByName(latin, allowMissingColumns=True)


def scan_json_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON records (lines, or one array per file with ``multi_line``) as a table.
    Malformed input lands in ``_corrupt_record`` (PERMISSIVE)."""
    return (spark.read.option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


#: The tokens of compact JSON text: strings, marks, and everything else.
_JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^"\[\]{},:]+'


def _list_text(json_text) -> "F.Column":
    """A JSON list as the file reader prints it: True/False/None, strings in
    single quotes (double ones around a lone apostrophe), ", " between items."""
    def one(t):
        v = F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")
        plain = v
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            plain = F.replace(plain, F.lit(raw), F.lit(shown))
        quoted = F.when(v.contains("'") & ~v.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))
        return (F.when(t.startswith('"'), quoted).when(t == ",", ", ").when(t == ":", ": ")
                .when(t == "true", "True").when(t == "false", "False").when(t == "null", "None").otherwise(t))
    return F.array_join(F.transform(F.regexp_extract_all(json_text, F.lit(_JSON_TOKEN), F.lit(0)), one), "")


def _scalar_text(v) -> "F.Column":
    t = F.schema_of_variant(v)
    return (F.when(t == "BOOLEAN", F.when(v.cast("boolean"), "True").otherwise("False"))
            .when(t == "VOID", F.lit("None"))
            .when(t.startswith("ARRAY"), _list_text(F.to_json(v)))
            .otherwise(v.cast("string")))


def json_flatten(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(doc_id, path, line) with ``line = 'a.b[0].c: value'`` for every scalar leaf.

    Objects recurse into their members; arrays recurse into object elements
    and print other elements as ``key[i]: value``.  Variant objects keep keys
    sorted, so lines come in key order.  Any depth: one level after another
    until nothing descends, each level kept by a checkpoint.
    """
    spark = df.sparkSession
    root = df.select(F.col(id_col).alias("doc_id"), F.lit("").alias("path"),
                     F.try_parse_json(F.col(json_col)).alias("v")).where(
        F.schema_of_variant("v").startswith("OBJECT"))
    frontier = root.withColumn("kind", F.lit("OBJECT"))
    lines = []
    while not lines or not frontier.isEmpty():
        ex = frontier.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        child_path = F.when(F.col("kind") == "OBJECT", F.when(F.col("path") == "", F.col("key"))
                            .otherwise(F.concat(F.col("path"), F.lit("."), F.col("key")))) \
            .otherwise(F.concat(F.col("path"), F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        ch = ex.select("doc_id", F.col("kind").alias("parent_kind"), child_path.alias("path"),
                       F.col("value").alias("v")).withColumn("t", F.schema_of_variant("v"))
        ch = materialize(ch)
        is_obj = F.col("t").startswith("OBJECT")
        is_arr = F.col("t").startswith("ARRAY")
        # arrays recurse only one level into their object elements
        descend = is_obj | (is_arr & (F.col("parent_kind") == "OBJECT"))
        lines.append(ch.where(~descend).select("doc_id", "path", F.concat(F.col("path"), F.lit(": "),
                                                                           _scalar_text(F.col("v"))).alias("line")))
        frontier = ch.where(descend).select("doc_id", "path", "v",
                                            F.when(is_obj, "OBJECT").otherwise("ARRAY").alias("kind"))
    out = lines[0]
    for p in lines[1:]:
        out = out.unionByName(p)
    return out


def json_scalar_page(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Non-object JSON (arrays, scalars) -> one page: the value pretty-printed."""
    v = F.try_parse_json(F.col(json_col))
    return (df.where(v.isNotNull() & ~F.schema_of_variant(v).startswith("OBJECT"))
            .select(F.col(id_col).alias("doc_id"), F.lit(1).alias("page_no"), F.to_json(v, {"pretty": "true"}).alias("page")))
