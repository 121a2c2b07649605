"""Export and import of tables as JSON, CSV, line protocol and annotated CSV.

Every writer produces a folder of part files and every reader accepts one, so
neither side is bound to a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_iso
from ..schemas import SENSOR_STRUCT

IMPORT_NUMBERS = {
    "temperature": "double", "humidity": "double", "pressure": "double", "battery_voltage": "double", "rssi": "int",
}
IMPORT_FIELDS = ["event_id", "mac", "ts", *IMPORT_NUMBERS]
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
FORMAT_UNKNOWN = -1


# --- JSON --------------------------------------------------------------------

def export_json(data: DataFrame, sensors: DataFrame, path: str) -> None:
    """Folders ``data`` (one record per line), ``sensors`` and ``export_info``."""
    data.write.mode("overwrite").option("timestampFormat", ISO_MICROS).json(f"{path}/data")
    sensors.select("mac", "name", "location").write.mode("overwrite").json(f"{path}/sensors")
    manifest(data).write.mode("overwrite").json(f"{path}/export_info")


def manifest(data: DataFrame) -> DataFrame:
    return data.agg(F.count("*").alias("record_count")).withColumn("version", F.lit("1.0"))


def import_json(spark: SparkSession, path: str, fields: list[str] = IMPORT_FIELDS, whole_files: bool = False) -> DataFrame:
    """Records, as text, of documents that hold a ``data`` array, a bare array or one record.

    A document is a line, or a file with ``whole_files``. Text that is none of
    the three shapes yields no record; ``rejected_json`` tells which.
    """
    record = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
    docs = _json_documents(spark, path, whole_files).filter("reason is null")
    listed = F.from_json("doc", f"array<{record}>")
    wrapped = F.from_json("doc", f"struct<data:array<{record}>>")["data"]
    single = F.array(F.from_json("doc", record))
    rows = F.when(F.col("doc").startswith("["), listed).when(
        F.get_json_object("doc", "$.data").isNotNull(), wrapped
    ).when(F.col("doc").startswith("{"), single)
    return docs.select(F.inline(rows))


def _json_documents(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    docs = spark.read.text(path, wholetext=whole_files).select(F.trim("value").alias("doc")).filter("doc <> ''")
    parsed = F.try_parse_json("doc")
    other = ~F.substring("doc", 1, 1).isin("{", "[")
    return docs.withColumn("reason", F.when(parsed.isNull(), "not JSON").when(other, "neither a record nor a list"))


def rejected_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``doc, reason`` of the documents that ``import_json`` cannot read."""
    return _json_documents(spark, path, whole_files).filter("reason is not null")


# --- CSV ---------------------------------------------------------------------

def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", ISO_MICROS).csv(path)


def import_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text; the stated columns save the pass that would look for a header."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def validate_import(records: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed good records, and the bad ones with their reason.

    Empty text is null, unreadable numbers or times make a record bad, a missing
    time becomes ``now``.
    """
    def text(column: str) -> Column:
        return F.nullif(F.trim(column), F.lit("")) if column in records.columns else F.lit(None).cast("string")

    typed = {c: text(c).try_cast(kind) for c, kind in IMPORT_NUMBERS.items()}
    ts = F.when(text("ts").isNull(), now if now is not None else F.current_timestamp()).otherwise(parse_iso(text("ts")))
    problems = F.array_compact(F.array(
        *[F.when(text(c).isNotNull() & typed[c].isNull(), F.lit(c)) for c in IMPORT_NUMBERS],
        F.when(ts.isNull(), F.lit("ts")),
    ))
    # one verdict column, two filters: the optimiser pushes each into its own scan
    judged = records.withColumn("problems", problems)
    extra = [c for c in records.columns if c not in ("mac", "ts", *IMPORT_NUMBERS)]
    good = judged.filter(F.size("problems") == 0).select(
        *extra, F.coalesce("mac", F.lit("")).alias("mac"), F.lit(FORMAT_UNKNOWN).alias("data_format"), ts.alias("ts"),
        *[typed[c].alias(c) for c in IMPORT_NUMBERS],
    )
    bad = judged.filter(F.size("problems") > 0).withColumn("problems", F.array_join("problems", ","))
    return good, bad


# --- line protocol -----------------------------------------------------------

def line_protocol(df: DataFrame, fields: list[str], measurement: str = "sensors") -> DataFrame:
    """``measurement,mac=.. field=value,.. nanoseconds``; null fields are left out."""
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in fields]
    nanos = (F.unix_micros("ts") * 1000).cast("string")
    tags = F.concat(F.lit(f"{measurement},mac="), F.coalesce("mac", F.lit("unknown")))
    return df.select(F.concat_ws(" ", tags, F.concat_ws(",", *parts), nanos).alias("value"))


def export_line_protocol(df: DataFrame, fields: list[str], path: str) -> None:
    line_protocol(df, fields).write.mode("overwrite").text(path)


# --- annotated CSV -------------------------------------------------------------

def read_annotated_csv(spark: SparkSession, path: str) -> DataFrame:
    """Query-result text: annotation lines start with ``#``; the header names the columns.

    Lines of another width, and header lines repeated in later files, are
    dropped. The empty leading annotation column is not returned.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    is_header = F.col("value").contains("table") & F.col("value").contains("result") & F.col("value").contains("_start")
    first = lines.filter(is_header).limit(1).collect()
    if not first:
        raise ValueError(f"no header line in {path}")
    names = first[0]["value"].split(",")
    cells = F.split("value", ",", -1)
    rows = lines.filter((F.col("value") != first[0]["value"]) & (F.size(cells) == len(names)))
    return rows.select(*[cells[i].alias(n) for i, n in enumerate(names) if n])


def write_annotated_csv(points: DataFrame, path: str, start: str, stop: str) -> None:
    """Points in the same text form (header in its own part file)."""
    spark = points.sparkSession
    header = ["#datatype,string,long,dateTime,dateTime,dateTime,double,string,string,string",
              ",result,table,_start,_stop,_time,_value,_field,_measurement,mac"]
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("overwrite").text(path)
    body = points.select(F.concat_ws(
        ",", F.lit(""), F.lit("_result"), F.lit("0"), F.lit(start), F.lit(stop), F.date_format("ts", ISO_MICROS),
        F.col("value").cast("string"), "field", "measurement", "mac",
    ).alias("value"))
    body.write.mode("append").text(path)


# --- sensor metadata -----------------------------------------------------------

def load_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Dimension rows from metadata documents (one per line): ``{"sensors": {mac: {...}}}``."""
    doc = F.from_json("value", f"struct<sensors:map<string,{SENSOR_STRUCT}>>")
    flat = spark.read.text(path).select(F.explode(doc["sensors"]).alias("mac", "s")).select("mac", "s.*")
    return flat.withColumns({c: parse_iso(F.col(c)) for c in ("discovered_at", "last_seen")})


def export_sensors(sensors: DataFrame, path: str) -> None:
    """Metadata documents, one per sensor and line.

    A single document would gather the whole dimension in one row; the loader
    treats any number of documents as one registry.
    """
    names = ["name", "location", "discovered_at", "last_seen", "status", "enabled", "notes", "firmware_version",
             "battery_level"]
    known = dict(sensors.dtypes)

    def value(c: str) -> Column:
        column = F.col(c) if c in known else F.lit(None).cast("string")
        return F.date_format(column, ISO_MICROS).alias(c) if known.get(c) == "timestamp" else column.alias(c)

    entry = F.create_map(F.col("mac"), F.struct(*[value(c) for c in names]))
    sensors.select(F.to_json(F.struct(F.lit("1.0").alias("version"), entry.alias("sensors"))).alias("value")).write.mode(
        "overwrite"
    ).text(path)
