"""Reading and writing the files between the stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.functions.text import parse_created_at, parse_tweet_id
from replyloom.schema import CONVERSATIONS, EVALUATED, TWEETS
from replyloom.sources.quoted_csv import read_quoted_csv

#: Rows of a section that the head of a report holds itself; longer sections are tables beside it.
MAX_REPORT_ROWS = 10_000
#: Where a head names those tables.
TABLES = "tables"


def read_tweets(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                limit: int | None = None) -> DataFrame:
    """The raw tweet CSV; quoted texts may run over several lines.

    This reader gives a whole file to one task, which suits a look at its first rows; :func:`convert_tweets` reads
    one file with many tasks.
    """
    df = (
        spark.read.schema(TWEETS)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    if columns is not None:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def typed_tweets(raw: DataFrame) -> DataFrame:
    """Timestamps and parent ids as types, unreadable ones as NULL."""
    return raw.withColumns(
        {
            "created_at": parse_created_at("created_at"),
            "in_response_to_tweet_id": parse_tweet_id("in_response_to_tweet_id"),
        }
    )


def convert_tweets(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Raw CSV to a typed parquet table that prunes columns; large files are read by many tasks."""
    typed_tweets(read_quoted_csv(spark, csv_path, TWEETS)).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def scan(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None,
         order_by: Sequence[str] = ()) -> DataFrame:
    """Chosen columns, and the first ``limit`` rows in key order."""
    if limit is not None:
        df = (df.orderBy(*order_by) if order_by else df).limit(limit)
    return df.select(*columns) if columns is not None else df


def write_conversations(nested: DataFrame, path: str) -> None:
    """One JSON object per line and conversation."""
    nested.write.mode("overwrite").json(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversation JSON lines; blank lines are skipped."""
    return spark.read.schema(CONVERSATIONS).json(path)


def flat_conversations(nested: DataFrame) -> DataFrame:
    """One row per message with its place in the conversation."""
    return nested.select(
        "conversation_id", "customer_id", "turn_count", F.posexplode("messages").alias("pos", "m")
    ).select("conversation_id", "customer_id", "turn_count", F.col("pos").cast("bigint"), "m.*")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A flat table as CSV with a header, or in another format; NULL is written as nothing."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.save(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table written by :func:`write_table`."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').csv(path)
    )


def write_report(spark: SparkSession, sections: Mapping[str, DataFrame], path: str,
                 inline_rows: int = MAX_REPORT_ROWS) -> None:
    """Sections as one JSON object, a list of rows per section, and long sections as tables beside it.

    The head at ``path`` holds sections of up to ``inline_rows`` rows. A longer one becomes a parquet table in the
    folder ``path`` + ``.sections``, of any size; the head names it under ``tables`` in place of its list. Tables are
    written before the head, so a head that can be read names only what is there. A report written anew replaces
    its head and the tables of the same names; sections called ``tables`` are refused.
    """
    if TABLES in sections:
        raise ValueError(f"no section may be called {TABLES}")
    path, named, short = path.rstrip("/"), {}, {}
    for name, df in sections.items():
        if df.limit(inline_rows + 1).count() > inline_rows:
            named[name] = name
            df.write.mode("overwrite").parquet(f"{path}.sections/{name}")
        else:
            short[name] = df
    gathered = {
        name: df.agg(F.collect_list(F.struct(*df.columns)).alias("r")).scalar() for name, df in short.items()
    }
    fields = [v.alias(k) for k, v in gathered.items()]
    if named:
        fields.append(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]).alias(TABLES))
    report = spark.range(1).select((F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("value"))
    report.write.mode("overwrite").text(path)


def read_section(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of one section of a report, wherever :func:`write_report` put them.

    Columns of ``schema`` that the section lacks are NULL; a section that the report does not have gives no rows.
    """
    path = path.rstrip("/")
    head = spark.read.schema(f"{TABLES} map<string,string>").option("multiLine", True).json(path)
    named = head.select(F.col(TABLES)[name].alias("table")).first()
    if named is not None and named["table"] is not None:
        found = spark.read.parquet(f"{path}.sections/{named['table']}")
        fields = T.StructType.fromDDL(schema).fields
        return found.select(*[
            (F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ])
    report = spark.read.schema(f"`{name}` array<struct<{_as_struct(schema)}>>").option("multiLine", True).json(path)
    return report.select(F.inline(F.col(f"`{name}`")))


def read_examples(spark: SparkSession, path: str, schema: str = EVALUATED) -> DataFrame:
    """Rows of the ``examples`` of a report, its own list or a table beside it."""
    return read_section(spark, path, "examples", schema)


def _as_struct(schema: str) -> str:
    """``a int, b string`` as the inside of a struct type."""
    return T.StructType.fromDDL(schema).simpleString()[len("struct<"):-1]
