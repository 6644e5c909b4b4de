"""The table repository: where tables are, how they are read and named."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from joingrove.functions.naming import qualify, quote
from joingrove.functions.types import OTHER, TIMESTAMP, family

LINK_FILE = "connections.csv"

# Format of a CSV table with line breaks inside quotes.
MULTI_LINE = "csv_multiline"


@dataclass(frozen=True)
class Table:
    name: str
    path: str
    format: str
    schema: T.StructType | None = None


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with header, UTF-8, `"` quotes and `\\` escapes (A1, A2).

    The schema is inferred once and kept by the catalog. Dates stay strings.
    Line breaks inside quotes need `multi_line`, which gives each file to one
    task; without it files are split.
    """
    reader = (spark.read.option("header", True).option("encoding", "UTF-8")
              .option("quote", '"').option("escape", "\\").option("multiLine", multi_line)
              .option("enforceSchema", False))
    if schema is None:
        found = reader.option("inferSchema", True).csv(path).schema
        schema = T.StructType([
            T.StructField(f.name, T.StringType()) if family(f.dataType) == TIMESTAMP else f
            for f in found.fields])
    return reader.schema(schema).csv(path)


class Catalog:
    """Set of named tables; every edit returns a new catalog."""

    def __init__(self, spark: SparkSession, tables: dict[str, Table] | None = None):
        self.spark = spark
        self._tables = dict(tables or {})
        self._frames: dict[str, DataFrame] = {}

    # -- contents ---------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return sorted(self._tables)

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    @classmethod
    def from_parquet_dir(cls, spark: SparkSession, root: str, names: list[str]) -> "Catalog":
        return cls(spark, {n: Table(n, f"{root}/{n}.parquet", "parquet") for n in names})

    @classmethod
    def from_repository(cls, spark: SparkSession, root: str, datasets: list[str] | None = None,
                        all_tables: bool = False, include_link_files: bool = False) -> "Catalog":
        """Tables of the chosen datasets below `root`: exactly one of a list
        of datasets and `all_tables` (A5)."""
        if datasets and all_tables:
            raise ValueError("give either a list of datasets or all_tables, not both")
        if not datasets and not all_tables:
            raise ValueError("give a list of datasets or set all_tables")
        tables = {}
        for dataset in (datasets or ["*"]):
            for path in _list_files(spark, f"{root}/{dataset}/*.{{csv,parquet}}"):
                folder, name = path.rstrip("/").split("/")[-2:]
                if name == LINK_FILE and not include_link_files:
                    continue
                table = f"{folder}/{name}"
                tables[table] = Table(table, path, name.rsplit(".", 1)[1])
        return cls(spark, tables)

    def add(self, name: str, path: str, format: str = "parquet") -> "Catalog":
        return Catalog(self.spark, {**self._tables, name: Table(name, path, format)})

    def remove(self, name: str) -> "Catalog":
        return Catalog(self.spark, {k: v for k, v in self._tables.items() if k != name})

    # -- reading ----------------------------------------------------------

    def schema(self, name: str) -> T.StructType:
        entry = self._tables[name]
        if entry.schema is None:
            if entry.format == "parquet":
                df = self._frames[name] = self.spark.read.parquet(entry.path)
            else:
                df = read_csv(self.spark, entry.path, None, entry.format == MULTI_LINE)
            entry = replace(entry, schema=df.schema)
            self._tables[name] = entry
        return entry.schema

    def table(self, name: str) -> DataFrame:
        """The table with its own column names (A2). A catalog lists the files
        of a table once."""
        if name not in self._frames:
            entry, schema = self._tables[name], self.schema(name)
            self._frames[name] = (
                self.spark.read.schema(schema).parquet(entry.path) if entry.format == "parquet"
                else read_csv(self.spark, entry.path, schema, entry.format == MULTI_LINE))
        return self._frames[name]

    def qualified(self, name: str, target: str | None = None) -> DataFrame:
        """Columns named `<table>__<column>`; a target stays bare and comes
        first (A3). Nested columns cannot be keys or features and are left out."""
        df = self.table(name)
        fields = [f for f in df.schema.fields if family(f.dataType) != OTHER]
        first = [quote(target)] if target else []
        return df.selectExpr(*first, *[f"{quote(f.name)} AS {quote(qualify(name, f.name))}"
                                       for f in fields if f.name != target])

    def states(self) -> list[str]:
        """Name, place, schema, size and time of change of every table; nothing is read."""
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        out = []
        for name in self.names:
            entry = self._tables[name]
            path = self.spark._jvm.org.apache.hadoop.fs.Path(entry.path)
            fs = path.getFileSystem(conf)
            state = fs.getFileStatus(path)
            files = [state] if state.isFile() else list(fs.listStatus(path))
            stamp = "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
            out.append(f"{name}|{fs.makeQualified(path).toString()}|{entry.format}|{self.schema(name).json()}|{stamp}")
        return out

    def merged(self, other: "Catalog") -> "Catalog":
        """The tables of both; `other` wins where names are equal."""
        return Catalog(self.spark, {**self._tables, **other._tables})

    def only(self, names: list[str]) -> "Catalog":
        return Catalog(self.spark, {n: self._tables[n] for n in names if n in self._tables})

    # -- metadata tables --------------------------------------------------

    def tables(self) -> DataFrame:
        """name, path, n_rows, n_cols of every table."""
        counts = None
        for name in self.names:
            one = self.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("name"), F.lit(self._tables[name].path).alias("path"),
                "n_rows", F.lit(len(self.schema(name).fields)).alias("n_cols"))
            counts = one if counts is None else counts.unionByName(one)
        if counts is None:
            return self.spark.createDataFrame([], "name string, path string, n_rows long, n_cols int")
        return counts

    def columns(self) -> DataFrame:
        """One row per usable column: col_id, table, column, family."""
        return self.spark.createDataFrame(
            self.column_list(), "col_id int, table string, column string, family string")

    def column_list(self) -> list[tuple[int, str, str, str]]:
        rows = [(n, f.name, family(f.dataType)) for n in self.names for f in self.schema(n).fields]
        return [(i, *r) for i, r in enumerate(r for r in rows if r[2] != OTHER)]


def read_links(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Known foreign-key links as edges of weight 1 (A12). Link files name the
    tables of their own dataset, whose name goes in front."""
    table = (lambda c: F.concat(F.lit(f"{dataset}/"), F.col(c))) if dataset else F.col
    links = read_csv(spark, path)
    return links.select(
        table("fk_table").alias("from_table"), table("pk_table").alias("to_table"),
        F.col("fk_column").alias("from_col"), F.col("pk_column").alias("to_col"),
        F.lit(1.0).alias("weight"))


def _list_files(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().toString() for s in (fs.globStatus(path) or []))
