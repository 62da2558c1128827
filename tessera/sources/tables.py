"""Reading award records from files: landing folders of JSON, answer files, tables with columns still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import awards, records


def with_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows with all wanted columns; those that are not there yet are null."""
    return rows.select(*rows.columns, *[F.lit(None).cast(kind).alias(c) for c, kind in wanted.items() if c not in rows.columns])


def landing(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One row a line of a landing folder: the raw record, its file, and the columns that all sources share.

    Records of the spending register give the columns of an award; those without a title are none.
    """
    stamp = F.date_format(F.col("_metadata.file_modification_time"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = spark.read.text(path).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"), stamp.alias("fetched"))
    if source == "USAspending":
        agency = raw.withColumn("agency", F.get_json_object("record", "$.Awarding Agency"))
        return awards.spending_records(agency, "record", "agency").drop("agency").where(F.col("grant_title").isNotNull())
    columns = {"NIH": records.nih_columns, "NSF": records.nsf_columns}.get(source)
    shared = columns(F.col("record"), F.col("fetched")) if columns else records.unasked_columns()
    return raw.select("record", "file", F.lit(source).alias("funding_source"), *shared)


def readable_answers(lines: DataFrame) -> DataFrame:
    """(id, sentence, terms and the other columns) of lines (value) that are JSON objects with an id."""
    read = lines.withColumn("a", F.from_json("value", "struct<id:string,sentence:string,terms:array<string>>"))
    return read.where(F.col("a.id").isNotNull()).select("a.*", *[c for c in lines.columns if c != "value"])


def answers(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(id, sentence, terms) of readable lines whose id was asked for in the batch of their file.

    asked: id, batch; files are named after their batch. Unreadable lines are left out.
    """
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.", 1).alias("batch"))
    return readable_answers(lines).join(asked, ["id", "batch"], "left_semi").select("id", "sentence", "terms")


def term_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, awards) of a frequency file {awards, terms: {term: count}}."""
    read = spark.read.schema("built_at string, awards long, min_awards int, terms map<string,long>").json(path, multiLine=True)
    return read.select(F.explode("terms").alias("term", "awards"))


def write_term_frequencies(frequency: DataFrame, awards: int, path: str) -> None:
    """One line a term, so that the file can grow; the number of awards on each."""
    frequency.withColumn("of", F.lit(awards)).write.json(path)


def read_any(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table by the ending of its path: parquet, orc, csv, json or text."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    kind = {"jsonl": "json", "txt": "text", "tsv": "csv"}.get(kind, kind)
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table; earlier ones are not read."""
    rows.write.mode("append").parquet(path)
