"""JSON Lines with file and line of whatever is wrong; text and Markdown files; writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value`` of every line that isn't blank, with its number from 1.

    Files are read in blocks, so a file of any size is spread over tasks. Lines are numbered within their block; the blocks' counts
    (a row a block) are added up in each file's order.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    rows = raw.withColumn("at", F.monotonically_increasing_id())
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    starts = blocks.select(F.col("path").alias("p"), F.col("block").alias("b"), (before - F.col("first") + 1).alias("start"))
    joined = rows.join(starts, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    return joined.where(F.trim("value").rlike(r"(?U)\S")).select("path", (F.col("at") + F.col("start")).cast("int").alias("line"), "value")


def checked(spark: SparkSession, path: str, schema: T.StructType, required: list[str], allowed: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of ``schema`` with ``path`` and ``line``, and violations (``path, line, problem``).

    Strict: a value of another JSON type than its column (a number for a string, say, or true for 1) is a violation; so are
    missing or blank required fields, values outside ``allowed``, and lines that are no JSON object.
    """
    parsed = lines(spark, path).withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    problem = F.when(F.col("v").isNull() | ~kind.startswith("OBJECT"), F.lit("not a JSON object"))
    fits = {"string": ["STRING"], "int": ["BIGINT"], "bigint": ["BIGINT"], "double": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}
    columns = []
    for f in schema.fields:
        raw = F.try_variant_get("v", f"$.{f.name}", "variant")
        known = F.schema_of_variant(raw)
        name = f.dataType.simpleString()
        ok = F.lit(False)
        for k in fits[name]:
            ok = ok | known.startswith(k)
        problem = problem.when(raw.isNotNull() & (known != "VOID") & ~ok, F.lit(f"{f.name} is not of type {name}"))
        value = F.try_variant_get("v", f"$.{f.name}", name)
        if f.name in required:
            problem = problem.when(value.isNull(), F.lit(f"{f.name} is missing"))
            if name == "string":
                problem = problem.when(~value.rlike(r"(?U)\S"), F.lit(f"{f.name} is blank"))
        if allowed and f.name in allowed:
            problem = problem.when(value.isNotNull() & ~value.isin(allowed[f.name]), F.lit(f"{f.name} is unknown"))
        columns.append(value.alias(f.name))
    all_ = parsed.withColumn("problem", problem)
    return all_.where("problem is null").select("path", "line", *columns), all_.where("problem is not null").select("path", "line", "problem")


def raise_first(violations: DataFrame) -> None:
    """Raises with path and line of the first violation, if there is any."""
    first = violations.orderBy("path", "line").first()
    if first is not None:
        raise ValueError(f"{first['path']}:{first['line']}: {first['problem']}")


def write(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in alphabetical order, nulls left in."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def documents(spark: SparkSession, path: str, pattern: str = "*.md", contains: str = "") -> DataFrame:
    """``path, text`` of whole text files whose name (without folders) contains ``contains``."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return found.where(F.contains(F.element_at(F.split("path", "/"), -1), F.lit(contains))) if contains else found


def files_per_directory(spark: SparkSession, path: str, pattern: str = "*.{json,md}") -> DataFrame:
    """``directory, files``: files lying in each directory of ``path`` itself, README.md left out; only the listing is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path.rstrip("/") + "/*").select("path")
    part = F.split("path", "/")
    return found.where(F.element_at(part, -1) != "README.md").groupBy(F.element_at(part, -2).alias("directory")).agg(F.count("*").alias("files"))
