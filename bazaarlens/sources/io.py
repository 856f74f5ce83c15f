"""Reading and writing market data (A)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"csv": "csv", "txt": "csv", "json": "json", "geojson": "geojson", "parquet": "parquet", "text": "text"}


def _kind(path: str, kind: str | None) -> str:
    name = (kind or path.rstrip("/").rpartition(".")[2]).lower()
    if name not in KINDS:
        raise ValueError(f"no Spark source for {name!r}: use one of {sorted(KINDS)}")
    return KINDS[name]


def read_geojson(spark: SparkSession, path: str, properties: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Features as rows (A1): their properties, geometry type, and x and y of points (rings of areas as ``ring``).

    A feature collection is one JSON value, so a file is one task; ``lines`` reads a feature per line, which splits.
    """
    point = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    if properties is None:
        found = spark.read.option("multiLine", not lines).json(path)
        kind = found.schema["properties"].dataType if lines else found.schema["features"].dataType.elementType["properties"].dataType
    else:
        kind = properties
    feature = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", kind), T.StructField("geometry", point)])
    if lines:
        rows = spark.read.schema(feature).json(path)
    else:
        whole = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", True).json(path)
        rows = whole.select(F.explode("features").alias("f")).select("f.*")
    xy = F.from_json("geometry.coordinates", T.ArrayType(T.DoubleType()))
    ring = F.from_json("geometry.coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))[0]
    is_point = F.col("geometry.type") == "Point"
    return rows.select("properties.*", F.col("geometry.type").alias("geometry"), F.when(is_point, xy[0]).alias("x"), F.when(is_point, xy[1]).alias("y"), F.when(F.col("geometry.type") == "Polygon", F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("ring"))


def write_geojson(data: DataFrame, path: str, x: str = "x", y: str = "y", mode: str = "overwrite") -> None:
    """A point feature per line, in as many files as the data has partitions (A3)."""
    rest = [c for c in data.columns if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), geometry.alias("geometry"))
    data.select(F.to_json(feature).alias("value")).write.mode(mode).text(path)


def load(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table by the file's extension or the given kind (A2)."""
    name = _kind(path, kind)
    if name == "geojson":
        return read_geojson(spark, path, **options)
    reader = spark.read.options(**({"header": True, "inferSchema": schema is None} if name == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).format(name).load(path)


def save(data: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite", **options) -> None:
    """The table in the format of the extension or the given kind (A3)."""
    name = _kind(path, kind)
    if name == "geojson":
        return write_geojson(data, path, mode=mode, **options)
    return data.write.mode(mode).options(**({"header": True} if name == "csv" else {}) | options).format(name).save(path)


def save_by_market(data: DataFrame, path: str, market: str = "market", kind: str = "csv", mode: str = "overwrite") -> None:
    """A folder per market (A4)."""
    writer = data.repartition(market).write.mode(mode).partitionBy(market)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def load_by_market(spark: SparkSession, path: str, market: str = "market", date: str = "date", kind: str = "csv") -> DataFrame:
    """All markets, the market from the folder (or the file's name), dates parsed (A5)."""
    reader = spark.read.options(header=True, inferSchema=True) if kind == "csv" else spark.read
    out = reader.format(kind).load(path)
    if market not in out.columns:
        out = out.withColumn(market, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1))
    return out.withColumn(market, F.col(market).cast("string")).withColumn(date, F.to_date(date))


def merge_csv(spark: SparkSession, paths: Sequence[str], output: str | None = None, on: Sequence[str] = (), how: str = "outer") -> DataFrame:
    """Files put under each other, or joined on id columns (A6); written if an output is named."""
    out = merge([load(spark, p, "csv") for p in paths], on, how)
    if output is not None:
        save(out, output, "csv")
    return out


def merge(tables: Sequence[DataFrame], on: Sequence[str] = (), how: str = "outer") -> DataFrame:
    """Tables put under each other by column name, or joined on id columns."""
    if on:
        return reduce(lambda a, b: a.join(b, list(on), how), tables)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of the files that match (A7), without reading them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(folder).select("path", "length", "modificationTime")


def load_rates(spark: SparkSession, path: str, date: str = "date", rates: Sequence[str] = ("rate_a", "rate_b"), kind: str | None = None) -> DataFrame:
    """(date, rates...) with its columns checked."""
    out = load(spark, path, kind)
    missing = [c for c in (date, *rates) if c not in out.columns]
    if missing:
        raise ValueError(f"exchange-rate table without {missing}")
    return out.select(F.to_date(date).alias(date), *[F.col(r).cast("double").alias(r) for r in rates])
