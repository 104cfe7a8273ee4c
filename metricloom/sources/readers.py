"""Sources by kind: files, JDBC databases and SQL, with a small registry, sampling and schema reading."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYSTEM = re.compile(r"^(information_schema|performance_schema|mysql|sys|tmp_|bak_)", re.I)
_DRIVERS = {"mysql": "com.mysql.cj.jdbc.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver", "postgresql": "org.postgresql.Driver"}


@dataclass(frozen=True)
class Database:
    """A JDBC database; reads are split over ``partitions`` ranges of a numeric column where one is named."""

    kind: str
    host: str
    port: int
    name: str
    user: str = ""
    password: str = field(default="", repr=False)
    options: tuple[tuple[str, str], ...] = ()

    def url(self) -> str:
        if self.kind == "sqlserver":
            return f"jdbc:sqlserver://{self.host}:{self.port};databaseName={self.name};encrypt=false"
        if self.kind == "oracle":
            return f"jdbc:oracle:thin:@//{self.host}:{self.port}/{self.name}"
        if self.kind not in _DRIVERS:
            raise ValueError(f"unknown database {self.kind}")
        tail = "?sessionVariables=sql_mode='STRICT_TRANS_TABLES'" if self.kind == "mysql" else ""
        return f"jdbc:{self.kind}://{self.host}:{self.port}/{quote(self.name)}{tail}"

    def reader(self, spark: SparkSession, table: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1):
        r = spark.read.format("jdbc").option("url", self.url()).option("driver", _DRIVERS[self.kind]).option("dbtable", table).option("user", self.user).option("password", self.password).option("fetchsize", "10000")
        if column and partitions > 1:
            r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
        for k, v in self.options:
            r = r.option(k, v)
        return r


class Sources:
    """Tables by name: a path (format by its ending), a Database with a table, SQL text, or a DataFrame."""

    def __init__(self, spark: SparkSession, tables: dict[str, object] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    def read(self, name: str) -> DataFrame:
        at = self.tables.get(name)
        if at is None:
            return self.spark.table(name)
        if isinstance(at, DataFrame):
            return at
        if isinstance(at, tuple) and isinstance(at[0], Database):
            return at[0].reader(self.spark, at[1], **(at[2] if len(at) > 2 else {})).load()
        text = str(at)
        if re.match(r"\s*(select|with)\b", text, re.I):
            return self.spark.sql(text)
        kind = text.rstrip("/").rsplit(".", 1)[-1].lower()
        reader = self.spark.read
        return {"orc": reader.orc, "json": reader.json, "csv": lambda p: reader.option("header", True).csv(p)}.get(kind, reader.parquet)(text)

    def names(self, exclude: str = SYSTEM.pattern) -> list[str]:
        have = set(self.tables) | {t.name for t in self.spark.catalog.listTables()}
        return sorted(n for n in have if not re.search(exclude, n, re.I))

    def schema(self, name: str) -> DataFrame:
        rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(self.read(name).schema)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean")

    def sample(self, name: str, rows: int, seed: int = 42, fraction: float | None = None) -> DataFrame:
        """At most ``rows`` rows, of a seeded sample where a fraction is given."""
        df = self.read(name)
        return (df if fraction is None else df.sample(fraction, seed)).limit(rows)

    def test(self, name: str) -> bool:
        """Whether the source can be read."""
        return self.read(name).limit(1).agg(F.count("*")).first() is not None
