"""Sources and sinks: tolerant CSV scans, Parquet, run metadata, vector blocks, rasters, lines, models and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NODATA = -9999.0
ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, **options: str) -> DataFrame:
    """CSV with a header and a declared schema; partitions take the place of chunks, so chunk borders cannot change results."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_csv_any_encoding(spark: SparkSession, path: str, schema: StructType | str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """The first encoding under which no field holds a replacement character, else the last of the list."""
    for e in encodings:
        df = read_csv(spark, path, schema, encoding=e)
        names = [f"`{c}`" for c, kind in df.dtypes if kind == "string"]
        if not names or df.filter(F.concat_ws("", *[F.col(c) for c in names]).contains("�")).isEmpty():
            return df
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("float", "double")})


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A header in every part; mode append adds parts and repeats no header within one."""
    df.write.mode(mode).option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    """A block of vectors, joined later by key and never by position."""
    df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key long, vector array<float>").parquet(path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """Run metadata as one JSON row."""
    spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    return {r.name: r.value for r in spark.read.schema("name string, value string").json(path).collect()}


def find_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files under path whose names match pattern, with their sizes; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length")


def smallest_file(spark: SparkSession, path: str, pattern: str) -> str | None:
    first = find_files(spark, path, pattern).orderBy("length", "path").limit(1).collect()
    return first[0].path if first else None


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def read_first(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The Parquet table under the first path that exists; an error that names all, if there is none."""
    paths = list(paths)
    found = first_existing(spark, paths)
    if found is None:
        raise FileNotFoundError(f"none of {paths} exists")
    return spark.read.parquet(found)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A point table; x, y and z must be there and become doubles."""
    df = spark.read.parquet(path)
    missing = {"x", "y", "z"} - set(df.columns)
    if missing:
        raise ValueError(f"point table lacks {sorted(missing)}")
    return df.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "z")})


def write_raster(cells: DataFrame, meta: DataFrame, path: str) -> None:
    """Cell table with nodata for empty cells, beside the one-row grid definition."""
    cells.withColumn("value", F.coalesce("value", F.lit(NODATA))).write.mode("overwrite").parquet(f"{path}/cells")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    cells = spark.read.parquet(f"{path}/cells")
    return mask_nodata(cells), spark.read.parquet(f"{path}/meta")


def mask_nodata(cells: DataFrame, value: str = "value") -> DataFrame:
    """Values below -1000 are empty."""
    return cells.withColumn(value, F.when(F.col(value) >= -1000, F.col(value)))


def to_geojson(lines: DataFrame, points: str = "points", *properties: str) -> DataFrame:
    """One GeoJSON feature (column value) for each line: points is array<struct<x, y>>."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p.x, p.y)).alias("coordinates"))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[F.col(p) for p in properties]).alias("properties"))).alias("value"))


def from_geojson(features: DataFrame, properties: str) -> DataFrame:
    schema = f"type string, geometry struct<type:string, coordinates:array<array<double>>>, properties struct<{properties}>"
    row = features.select(F.from_json("value", schema).alias("f"))
    return row.select(F.transform("f.geometry.coordinates", lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("points"), "f.properties.*")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Text lines from (section, name, value)."""
    lines = metrics.orderBy("section", "name").select(F.format_string("[%s] %s: %s", "section", "name", F.col("value").cast("string")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
