"""Readers for CSV, JSON, Parquet and JDBC. All normalise missing values on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions.columns import col, normalize_missing, string_columns, strip

# The cell texts that a CSV reader takes for a missing value.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Fixed value: what an unspecified database query reads.
DEFAULT_SQL = "SELECT * FROM users LIMIT 100"


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows in file order, as a stand-in for a row order."""
    return df.withColumn(name, F.monotonically_increasing_id())


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8; then GB18030, which contains GBK."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "GB18030" if broken else "UTF-8"


def read_csv(spark: SparkSession, path: str, *, encoding: str | None = None, multi_line: bool = False,
             schema: str | None = None) -> DataFrame:
    """CSV with a header line. Without a schema the types are inferred, in one reading that also tells whether the text is UTF-8.

    Files stay splittable; set ``multi_line`` where quoted cells contain line breaks. Reading
    GB18030 needs ``spark.sql.legacy.javaCharsets``, which is switched on for the session.
    """
    if schema is None:
        texts = _csv_texts(spark, path, encoding or "UTF-8", multi_line)
        facts = texts.agg(*_type_counts(texts.columns)).first()
        # Bytes that are no UTF-8 are read as a mark of their own; a file may hold that mark too, so it only calls for a closer look.
        marked = facts.marked or any("\ufffd" in c for c in texts.columns)
        if encoding is None and marked and (encoding := csv_encoding(spark, path)) != "UTF-8":
            texts = _csv_texts(spark, path, encoding, multi_line)
            facts = texts.agg(*_type_counts(texts.columns)).first()
        return normalize_missing(texts.select(*[_typed(c, facts, i) for i, c in enumerate(texts.columns)]))
    encoding = encoding or csv_encoding(spark, path)
    return normalize_missing(_without_na(_csv_reader(spark, encoding, multi_line).schema(schema).csv(path)))


def _csv_reader(spark: SparkSession, encoding: str, multi_line: bool):
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("encoding", encoding).option("escape", '"').option("multiLine", multi_line)


def _csv_texts(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    """All cells as text; cells that stand for a missing value are NULL."""
    return _without_na(_csv_reader(spark, encoding, multi_line).csv(path))


def _without_na(df: DataFrame) -> DataFrame:
    texts = string_columns(df)
    return df.select(*[F.when(~F.trim(col(c)).isin(*NA_TEXTS), col(c)).alias(c) if c in texts else col(c) for c in df.columns])


# What the cells of a column may all be, narrowest first: the type, and the pattern that its texts match.
CELL_TYPES = (
    ("int", r"^[+-]?\d{1,10}$"), ("bigint", r"^[+-]?\d{1,19}$"), ("decimal(38,0)", r"^[+-]?\d{1,38}$"), ("double", None),
    ("date", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("timestamp", r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}.*)?$"), ("boolean", r"(?i)^(true|false)$"),
)


def _cell(text: Column, kind: str, pattern: str | None) -> Column:
    """The cell as this type, or NULL."""
    text = strip(text)
    if kind == "double":
        # A Java literal suffix ("1d", "2f") parses as a number in Spark but is text here.
        return F.when(~F.lower(F.right(text, F.lit(1))).isin("d", "f") | F.lower(text).isin("inf", "-inf"), text.try_cast("double"))
    return F.when(text.rlike(pattern), text.try_cast(kind))


def _type_counts(columns: list[str]) -> list[Column]:
    """For each column its cells and how many of them are of each type, and the rows with the mark of unreadable bytes."""
    parts = [F.count_if(F.concat_ws("", *[col(c) for c in columns]).contains("\ufffd")).alias("marked")]
    for i, c in enumerate(columns):
        parts.append(F.count(col(c)).alias(f"n{i}"))
        parts += [F.count(_cell(col(c), kind, pattern)).alias(f"n{i}_{k}") for k, (kind, pattern) in enumerate(CELL_TYPES)]
    return parts


def _typed(name: str, facts, i: int) -> Column:
    """The column as the narrowest type that all of its cells are of; text if there is none."""
    n = facts[f"n{i}"]
    fitting = [t for k, t in enumerate(CELL_TYPES) if n and facts[f"n{i}_{k}"] == n]
    return (_cell(col(name), *fitting[0]) if fitting else col(name)).alias(name)


def read_json(spark: SparkSession, path: str, *, lines: bool = False, schema: str | None = None) -> DataFrame:
    """A JSON array of records; with ``lines`` one record per line, which large files should use."""
    reader = spark.read.option("multiLine", not lines)
    return normalize_missing((reader.schema(schema) if schema else reader).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize_missing(spark.read.parquet(path))


def jdbc_url(kind: str, host: str = "", port: int | None = None, database: str = "") -> str:
    kind = kind.lower()
    if kind == "sqlite":
        return f"jdbc:sqlite:{database}"
    if kind in ("mysql", "postgresql", "postgres"):
        name, default = ("mysql", 3306) if kind == "mysql" else ("postgresql", 5432)
        return f"jdbc:{name}://{host}:{port or default}/{database}"
    raise AnalysisError("unsupported_database", kind)


def read_jdbc(spark: SparkSession, url: str, sql: str = DEFAULT_SQL, *, user: str | None = None,
              password: str | None = None, driver: str | None = None, partition_column: str | None = None,
              lower_bound: object = None, upper_bound: object = None, num_partitions: int = 1,
              fetch_size: int = 10_000) -> DataFrame:
    """The result of a query run in the database.

    With a partition column and bounds the query is read by ``num_partitions`` tasks in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for name, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            reader = reader.option(name, value)
    if partition_column is None:
        return normalize_missing(reader.option("query", sql).load())
    if lower_bound is None or upper_bound is None:
        raise AnalysisError("missing_bounds", "a partitioned read needs lower_bound and upper_bound")
    reader = (reader.option("dbtable", f"({sql}) t").option("partitionColumn", partition_column)
              .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
              .option("numPartitions", num_partitions))
    return normalize_missing(reader.load())
