"""Pixel tables, their metadata and the files that the workflow leaves behind.

A raster is a table with one row per pixel: ``idx`` (row-major, 64 bits), ``row``,
``col`` and one column per band, so that Parquet reads only the bands in use.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.vector import reproject_rings
from tessella.params import Grid
from tessella.sources import geojson


def read_pixels(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """A pixel table, with all bands or those named."""
    pixels = spark.read.parquet(path)
    return pixels if bands is None else pixels.select("idx", "row", "col", *bands)


def read_label(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("idx", "y")


def from_wide(table: DataFrame, key: str, width: int, bands: dict[str, str]) -> DataFrame:
    """A pixel table from rows keyed by their linear index; bands: name to SQL expression."""
    idx = F.col(key).cast("bigint")
    places = [idx.alias("idx"), F.floor(idx / width).alias("row"), (idx % width).alias("col")]
    return table.select(*places, *[F.expr(e).cast("double").alias(n) for n, e in bands.items()])


def raster_meta(spark: SparkSession, transform: list[float], wkt: str, grid: Grid) -> DataFrame:
    """One row: affine transform, projection, size."""
    schema = "gt array<double>, wkt string, width int, height int"
    return spark.createDataFrame([(transform, wkt, grid.width, grid.height)], schema)


def to_map(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds the map coordinates x, y of each pixel's centre; the metadata is one row."""
    gt, column, row = F.col("gt"), F.col("col") + 0.5, F.col("row") + 0.5
    both = pixels.crossJoin(F.broadcast(meta.select("gt").limit(1)))
    x = gt[0] + column * gt[1] + row * gt[2]
    y = gt[3] + column * gt[4] + row * gt[5]
    return both.withColumns({"x": x, "y": y}).drop("gt")


def grid_of(pixels: DataFrame, width: int | None = None) -> Grid:
    """Size of a raster from its largest row and column."""
    found = pixels.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    if found["r"] is None:
        raise ValueError("the raster has no pixels")
    return Grid(found["r"] + 1, width or found["c"] + 1)


def require_bands(pixels: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in pixels.columns]
    if missing:
        raise ValueError(f"the raster lacks the bands {', '.join(missing)}")


def require_same_grid(a: Grid, b: Grid) -> None:
    if a != b:
        raise ValueError(f"the rasters differ in size: {a} and {b}")


_RINGS = "array<array<array<double>>>"
#: Of a file that names no system: longitude and latitude.
DEFAULT_CRS = "EPSG:4326"


def _system(name: Column) -> Column:
    """EPSG:n of a system's name in short or URN form."""
    code = F.regexp_extract(name, "EPSG:(?:[^:]*:)?([0-9]+)$", 1)
    return F.when(name.isNull() | name.endswith("CRS84"), DEFAULT_CRS).when(code != "", F.concat(F.lit("EPSG:"), code)).otherwise(name)


def _one_system(names: DataFrame) -> str:
    found = [r["crs"] for r in names.select(_system(F.col("name")).alias("crs")).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"no single coordinate system: {', '.join(found) or 'no file'}")
    return found[0]


def _rings(shapes: DataFrame) -> DataFrame:
    """(pid, ring, vertices) of (file, start, type, coordinates); each part of a multi-polygon is a polygon of its own."""
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", _RINGS))).when(
        F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<{_RINGS}>")
    )
    parts = shapes.select("file", "start", F.posexplode(parts).alias("part", "rings"))
    rings = parts.select(F.xxhash64("file", "start", "part").alias("pid"), F.posexplode("rings").alias("ring", "v"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return rings.select("pid", "ring", F.transform("v", point).alias("vertices"))


def _whole_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same as ``geojson`` gives, from a store that only Spark reaches: a file is one task there."""
    schema = "crs struct<properties: struct<name: string>>, features array<struct<geometry: struct<type: string, coordinates: string>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    shapes = docs.select("file", F.posexplode("features").alias("start", "f")).select("file", F.col("start").cast("bigint").alias("start"), "f.geometry.*")
    return docs.select("file", F.col("crs.properties.name").alias("name")), shapes


def _collections(spark: SparkSession, path: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(file, name of its system, null where it names none) and the shapes of all files at ``path``."""
    names = geojson.files(spark, path)
    if not all(geojson.reachable(f) for f, _ in names[:1]):
        return _whole_files(spark, path)
    found = geojson.parts(spark, path, block)
    all_files = spark.createDataFrame([(f,) for f, _ in names], "file string")
    return all_files.join(geojson.crs_names(found), "file", "left"), geojson.geometries(found)


def polygons_system(spark: SparkSession, path: str, block: int = geojson.BLOCK) -> str:
    """The coordinate system that the files at ``path`` name; files of several systems raise."""
    return _one_system(_collections(spark, path, block)[0])


def read_polygons(spark: SparkSession, path: str, block: int = geojson.BLOCK) -> DataFrame:
    """Rings (pid, ring, vertices) of the polygons of GeoJSON files, read in blocks of ``block`` bytes by many tasks.

    A missing file raises; other types of geometry have no area and are left out.
    """
    return _rings(_collections(spark, path, block)[1])


def write_polygons(rings: DataFrame, path: str, system: str = DEFAULT_CRS) -> None:
    """Polygons (pid, vertices) of one ring each as GeoJSON, a feature collection per line and about 4096 in all."""
    closed = F.concat("vertices", F.slice("vertices", 1, 1))
    pairs = F.transform(closed, lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")).alias("geometry"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(system).alias("name")).alias("properties"))
    by_file = rings.groupBy(F.pmod(F.xxhash64("pid"), F.lit(4096)).alias("file")).agg(F.collect_list(feature).alias("features"))
    whole = by_file.select(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), "features")
    whole.write.mode("overwrite").json(path)


def polygons_on(spark: SparkSession, path: str, system: str, block: int = geojson.BLOCK) -> DataFrame:
    """The polygons of ``path`` in the raster's system, reprojected where theirs is another."""
    names, shapes = _collections(spark, path, block)
    rings, own = _rings(shapes), _one_system(names)
    return rings if own == system else reproject_rings(rings, own, system)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_prediction(prediction: DataFrame, path: str) -> None:
    """Class and single-precision scores per pixel."""
    scores = [F.col(c).cast("float").alias(c) for c in prediction.columns if c.startswith("p")]
    write_table(prediction.select("idx", *scores, F.col("cls").cast("tinyint").alias("cls")), path)


def bands_long(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """One row per pixel and band (band numbers from 1), as rasters of several bands are stored."""
    values = F.array(*[F.col(b) for b in bands])
    return pixels.select("idx", F.posexplode(values).alias("band", "value")).withColumn("band", (F.col("band") + 1).cast("bigint"))


def write_georeferenced(pixels: DataFrame, bands: list[str], meta: DataFrame, path: str, kind: str = "float") -> None:
    """A raster of bands with its metadata beside it; kind: float, or byte stored as a short."""
    long = bands_long(pixels, bands).withColumn("value", F.col("value").cast("float" if kind == "float" else "smallint"))
    write_table(long, f"{path}/bands", "band")
    write_table(meta, f"{path}/meta")


def write_class_map(spark: SparkSession, mapping: dict[int, int], path: str) -> None:
    write_table(class_map(spark, mapping).coalesce(1), path)


def class_map(spark: SparkSession, mapping: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), "src int, dst int")


def read_class_map(spark: SparkSession, path: str) -> dict[int, int]:
    """A few rows: one per class."""
    return {r["src"]: r["dst"] for r in spark.read.parquet(path).collect()}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_report(report: DataFrame, path: str, run: str | None = None) -> None:
    """Adds rows to a report. With a run's name they replace what that run has added before, so a repeated append changes nothing; readers see it as a column."""
    if run is None:
        report.write.mode("append").parquet(path)
    else:
        report.write.mode("overwrite").parquet(f"{path}/run={run}")


def require_on_grid(other: DataFrame, grid: Grid) -> None:
    """Raises unless a second raster lies on the grid: of the same size if it has rows and columns, else with indices inside."""
    if {"row", "col"} <= set(other.columns):
        require_same_grid(grid, grid_of(other))
        return
    found = other.agg(F.min("idx").alias("least"), F.max("idx").alias("most")).first()
    if found["least"] is not None and not 0 <= found["least"] <= found["most"] < grid.height * grid.width:
        raise ValueError(f"indices {found['least']} to {found['most']} are not on {grid}")


def store_raster(pixels: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """A raster as a table in buckets of idx, each sorted by it: rasters stored alike join without a shuffle, and ranges of pixels skip most of each file.

    The table is registered in the session under a name of its own; its files lie at ``path``.
    """
    spark = pixels.sparkSession
    name = f"raster_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pixels.repartition(n, "idx").write.bucketBy(n, "idx").sortBy("idx").option("path", path).saveAsTable(name)
    return spark.table(name)


def with_optional(pixels: DataFrame, other: DataFrame | None, bands: list[str], fill: float = 0.0) -> DataFrame:
    """Bands of a second raster, or a constant where there is none or it has gaps."""
    if other is None:
        return pixels.withColumns({b: F.lit(fill) for b in bands})
    joined = pixels.join(other.select("idx", *bands), "idx", "left")
    return joined.withColumns({b: F.coalesce(F.col(b), F.lit(fill)) for b in bands})


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
