"""Bulk import and export: JSON lines, CSV, TSV and Parquet, with errors routed row by row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row caps of an import: characters in a row, rows in a file.
ROW_CHARS, ROWS = 1 << 20, 10_000_000
#: Separator of each delimited format.
DELIMITERS = {"csv": ",", "tsv": "\t"}
FORMATS = ("jsonl", "csv", "tsv", "parquet")


@dataclass(frozen=True)
class Field:
    """A column of the flat formats: its path in the record and whether its cell is JSON."""

    name: str
    path: str
    json: bool = False


def columns_of(schema: T.StructType, prefix: str = "") -> list[Field]:
    """The flat columns of a nested schema: structs by dotted path, arrays and maps as JSON cells."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += columns_of(f.dataType, f"{path}.")
        else:
            out.append(Field(path, path, isinstance(f.dataType, (T.ArrayType, T.MapType))))
    return out


def flatten(df: DataFrame) -> DataFrame:
    """All flat columns as text; JSON cells by ``to_json``."""
    return df.select(*[(F.to_json(F.col(c.path)) if c.json else F.col(c.path).cast("string")).alias(f"{c.name}") for c in columns_of(df.schema)])


def export(df: DataFrame, path: str, kind: str, masked=None) -> None:
    """Write in one of ``FORMATS``; ``masked``, if given, is applied first (the default profile of exports)."""
    df = masked(df) if masked else df
    if kind == "jsonl":
        df.write.option("ignoreNullFields", "false").json(path)
    elif kind == "parquet":
        flatten(df).write.option("compression", "zstd").parquet(path)
    elif kind in DELIMITERS:
        flatten(df).write.csv(path, header=True, sep=DELIMITERS[kind], escape='"', nullValue="", emptyValue='""')
    else:
        raise ValueError(f"unknown format {kind}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records with __row (the raw line), __error (null if good). Blank lines are skipped; lines too long or malformed are errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    line = F.rtrim(F.regexp_replace("value", "\r$", ""))
    parsed = F.from_json(line, T.StructType([*schema.fields, T.StructField("__bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = lines.select(line.alias("__row"), F.when(F.char_length(line) <= ROW_CHARS, parsed).alias("r"))
    error = F.when(F.char_length("__row") > ROW_CHARS, "row_too_long").when(F.col("r.__bad").isNotNull() | F.col("r").isNull(), "malformed_json")
    return rows.select("__row", error.alias("__error"), *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, kind: str) -> DataFrame:
    """Like :func:`read_jsonl` for CSV and TSV: columns in any order, unknown ones ignored, missing ones null, a bad cell is that row's error."""
    raw = spark.read.csv(path, header=True, sep=DELIMITERS[kind], escape='"', multiLine=False)
    bad: list[Column] = []

    def cell(f: T.StructField, prefix: str = "") -> Column:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            return F.struct(*[cell(x, f"{name}.").alias(x.name) for x in f.dataType.fields])
        if name not in raw.columns:
            return F.lit(None).cast(f.dataType)
        text = F.col(f"`{name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            wrapped = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), T.StructType([T.StructField("v", f.dataType), T.StructField("b", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "b"})
            bad.append(F.when(text.isNotNull() & wrapped["b"].isNotNull(), F.lit(name)))
            return wrapped["v"]
        value = text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
        bad.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
        return value

    cells = [cell(f).alias(f.name) for f in schema.fields]
    broken = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return raw.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("__row"), F.when(F.size(broken) > 0, F.concat(F.lit("bad_cell:"), F.array_join(broken, ","))).alias("__error"), *cells)


def read(spark: SparkSession, path: str, kind: str, schema: T.StructType, most_rows: int = ROWS) -> DataFrame:
    """Rows of an import file; Parquet is an export format alone and refused, and so is a file of more than ``most_rows`` lines."""
    if kind in (*DELIMITERS, "jsonl") and spark.read.text(path).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    if kind == "jsonl":
        return read_jsonl(spark, path, schema)
    if kind in DELIMITERS:
        return read_delimited(spark, path, schema, kind)
    raise ValueError("parquet is export-only" if kind == "parquet" else f"unknown format {kind}")


def error_report(rows: DataFrame) -> DataFrame:
    """row, field, message, kind of the rejected rows, ready for CSV."""
    return rows.where("__error IS NOT NULL").select(F.col("__row").alias("row"), F.when(F.col("__error").startswith("bad_cell:"), F.substring_index("__error", ":", -1)).alias("field"), F.col("__error").alias("message"), F.substring_index("__error", ":", 1).alias("kind"))


def stable_key(identifiers: str, tax_id: str, pid: str, strongest: tuple[str, ...] = ("SSN", "TAX", "NPI", "PPN")) -> Column:
    """``type:value`` of the strongest identifier, else the tax id, else the pid."""
    of = lambda kind: F.get(F.filter(identifiers, lambda x: (x["identifier_type"] == kind) & (F.trim(x["value"]) != "")), F.lit(0))["value"]
    return F.coalesce(*[F.concat(F.lit(f"{k}:"), of(k)) for k in strongest], F.concat(F.lit("TAX:"), F.nullif(F.trim(tax_id), F.lit(""))), F.concat(F.lit("PID:"), F.col(pid)))


def plan_import(rows: DataFrame, existing: DataFrame, key: str, best_score: DataFrame | None = None, review_at: float = 0.7) -> DataFrame:
    """``rows`` with ``outcome``: errored, upserted (its key exists), or created; and ``to_review`` for keyless
    rows whose best candidate (``best_score``: __row, score) reaches ``review_at``, which are created too."""
    known = existing.select(F.col(key).alias("__k")).where("__k IS NOT NULL").distinct()
    out = rows.join(known, F.col(key) == F.col("__k"), "left")
    if best_score is not None:
        out = out.join(best_score.groupBy("__row").agg(F.max("score").alias("__s")), "__row", "left")
    else:
        out = out.withColumn("__s", F.lit(None).cast("double"))
    outcome = F.when(F.col("__error").isNotNull(), "errored").when(F.col("__k").isNotNull(), "upserted").otherwise("created")
    review = F.coalesce((outcome == "created") & F.col(key).isNull() & (F.col("__s") >= review_at), F.lit(False))
    return out.withColumns({"outcome": outcome, "to_review": review}).drop("__k", "__s")


def import_counts(planned: DataFrame) -> DataFrame:
    return planned.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "upserted", "errored")], F.count_if("to_review").alias("to_review"))


def first_submissions(jobs: DataFrame) -> DataFrame:
    """One job for each (entity, kind, idempotency_key): the earliest; jobs without a key all stay."""
    keyed = jobs.where("idempotency_key IS NOT NULL")
    rest = [c for c in jobs.columns if c not in ("entity", "kind", "idempotency_key")]
    one = keyed.groupBy("entity", "kind", "idempotency_key").agg(F.min_by(F.struct(*rest), F.struct("submitted_at", "job_id")).alias("r"))
    return one.select("entity", "kind", "idempotency_key", *[F.col("r")[c].alias(c) for c in rest]).select(*jobs.columns).unionByName(jobs.where("idempotency_key IS NULL"))


def geojson(lon: Column, lat: Column, elevation: Column | None = None, **properties: Column) -> Column:
    """A GeoJSON point feature as text; null without coordinates."""
    at = F.array(lon, lat) if elevation is None else F.when(elevation.isNull(), F.array(lon, lat)).otherwise(F.array(lon, lat, elevation))
    geometry = F.struct(F.lit("Point").alias("type"), at.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.to_json(feature))


def event_log(segments: DataFrame, key: str) -> DataFrame:
    """case, activity, timestamp, lifecycle rows of segments: start and, where closed, complete; no personal reference."""
    ends = F.array_compact(F.array(F.struct(F.lit("start").alias("lifecycle"), F.col("start_ms").alias("timestamp_ms")), F.when(F.col("end_ms").isNotNull(), F.struct(F.lit("complete").alias("lifecycle"), F.col("end_ms").alias("timestamp_ms")))))
    return segments.select(F.col(key).alias("case"), F.col("stage").alias("activity"), F.inline(ends))


def resource(kind: str, **fields: Column) -> Column:
    """A resource of a search bundle as JSON text, missing fields left out."""
    return F.to_json(F.struct(F.lit(kind).alias("resourceType"), *[v.alias(k) for k, v in fields.items()]))
