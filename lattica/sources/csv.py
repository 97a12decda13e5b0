"""Delimited text files.

Every column is read as a string; cells are trimmed; a double quote toggles quoting; a row never spans lines. Missing
and empty cells are both the empty string, so they are equal in grouping. A row with another number of cells than the
header is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", ";", "\t")


def _first_line(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).limit(1).collect()
    return row[0]["value"] if row else None


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon and tab in the first line; ties go to the comma, then the semicolon."""
    line = _first_line(spark, path) or ""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def delimiter_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """How often each delimiter stands in each line."""
    count = lambda d: (F.length(column) - F.length(F.replace(F.col(column), F.lit(d), F.lit("")))).cast("long")
    return lines.select(column, count(",").alias("commas"), count(";").alias("semicolons"), count("\t").alias("tabs"))


def tokenize(line: str, delimiter: str = ",") -> list[str]:
    """The cells of a line: quotes toggle and vanish, cells are trimmed."""
    cells, now, quoted = [], [], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            cells.append("".join(now).strip())
            now = []
        else:
            now.append(c)
    return [*cells, "".join(now).strip()]


def column_names(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> list[str]:
    line = _first_line(spark, path)
    if line is None:
        return []
    cells = tokenize(line, delimiter or detect_delimiter(spark, path))
    return cells if header else [f"col_{i + 1}" for i in range(len(cells))]


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The file, or files, as strings. columns: read only these; pruned in the scan."""
    sep = delimiter or detect_delimiter(spark, path)
    names = column_names(spark, path, sep, header)
    if len(set(names)) != len(names):
        raise ValueError("the header names a column twice")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False, mode="FAILFAST", enforceSchema=True, encoding="UTF-8", nullValue="", emptyValue="")
    chosen = list(columns or names)
    missing = [c for c in chosen if c not in names]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in chosen])


class CsvLoader:
    """read_csv, a setting at a time: CsvLoader.of(path).with_header(True).with_delimiter(";").load(spark)."""

    def __init__(self, path: str):
        self.path, self.header, self.delimiter = path, True, None

    @classmethod
    def of(cls, path: str) -> CsvLoader:
        return cls(path)

    def with_header(self, header: bool) -> CsvLoader:
        self.header = header
        return self

    def with_delimiter(self, delimiter: str) -> CsvLoader:
        if len(delimiter) != 1:
            raise ValueError("a delimiter is one character")
        self.delimiter = delimiter
        return self

    def load(self, spark: SparkSession) -> DataFrame:
        return read_csv(spark, self.path, self.header, self.delimiter)


def row_count(spark: SparkSession, path: str, header: bool = True) -> int:
    """Lines, but for the header."""
    return max(0, spark.read.text(path).count() - bool(header))


def column_count(spark: SparkSession, path: str, delimiter: str | None = None) -> int:
    return len(column_names(spark, path, delimiter))


def datasets_by_width(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[tuple[str, int]]:
    """The files of a folder with their number of columns, narrowest first, then by name."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path) or []
    paths = [s.getPath().toString() for s in found]
    return sorted(((p, column_count(spark, p)) for p in paths), key=lambda x: (x[1], x[0]))


def table_of(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A table of strings from rows, each with a cell for every column."""
    for i, r in enumerate(rows):
        if len(r) != len(names):
            raise ValueError(f"row {i} has {len(r)} cells for {len(names)} columns")
    return spark.createDataFrame([tuple("" if x is None else str(x) for x in r) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))


TYPES = {"INTEGER": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def typed_table(spark: SparkSession, columns: Sequence[tuple[str, str]], rows: Sequence[Sequence]) -> DataFrame:
    """A table of typed columns (name, one of TYPES); cells are checked against their types."""
    schema = T.StructType([T.StructField(n, TYPES[t.upper()]) for n, t in columns])
    return spark.createDataFrame([tuple(r) for r in rows], schema, verifySchema=True)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
