"""Pixel tables: (raster_id, row, col, bands) with one metadata row (affine a..f, width, height, nodata) per raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.functions.scalar import from_sinusoidal, from_utm, ndvi, sinusoidal, utm

NODATA = -9999.0
QA_FILL = 65535


def qa_ok(qa: Column) -> Column:
    """Cloud state clear or possibly cloudy-free (lowest two bits 0 or 1) and third bit unset; fill fails."""
    return (qa != QA_FILL) & (qa.bitwiseAND(3) <= 1) & (qa.bitwiseAND(4) == 0)


def scaled(raw: Column, scale: float = 0.001, fill: int = -28672) -> Column:
    return F.when(raw != fill, (raw * scale).cast("float"))


def masked(df: DataFrame, qa: str, bands: list[str]) -> DataFrame:
    """Science bands where quality is good, else null; the quality band stays."""
    return df.withColumns({b: F.when(qa_ok(F.col(qa)), F.col(b)) for b in bands})


def pixel_centre(meta: str = "") -> tuple[Column, Column]:
    """x and y of the centre of (row, col) by the affine columns a..f."""
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    return F.col("a") * c + F.col("b") * r + F.col("c"), F.col("d") * c + F.col("e") * r + F.col("f")


def clipped(pixels: DataFrame, meta: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centre lies in a box of degrees; rasters are in the sinusoidal projection."""
    x, y = pixel_centre()
    lat, lon = from_sinusoidal(x, y)
    rows = pixels.join(meta.select("raster_id", *"abcdef"), "raster_id")
    return rows.where(lon.between(box[0], box[2]) & lat.between(box[1], box[3])).drop(*"abcdef")


def trimmed(pixels: DataFrame, meta: DataFrame, bands: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pixels and metadata cut to the rows and columns that hold a value; rasters without any leave."""
    valid = F.coalesce(*(F.col(b) for b in bands)).isNotNull()
    extent = pixels.where(valid).groupBy("raster_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    cut = pixels.join(extent, "raster_id").where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    moved = cut.withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")}).drop("r0", "r1", "c0", "c1")
    origin = meta.join(extent, "raster_id").withColumns(
        {"c": F.col("c") + F.col("c0") * F.col("a") + F.col("r0") * F.col("b"), "f": F.col("f") + F.col("c0") * F.col("d") + F.col("r0") * F.col("e"), "width": F.col("c1") - F.col("c0") + 1, "height": F.col("r1") - F.col("r0") + 1}
    )
    return moved, origin.drop("r0", "r1", "c0", "c1")


def ndvi_composite(samples: DataFrame, pixels: DataFrame, key: str = "pixel_id", red: str = "B04", nir: str = "B08", scene: str = "SCL", mask: str = "dataMask") -> DataFrame:
    """Median NDVI of a pixel's valid samples with mask 1, or 0 with mask 0; cloud, shadow and snow classes are left out."""
    good = samples.where((F.col(mask) != 0) & ~F.col(scene).isin(3, 8, 9, 10, 11)).withColumn("_v", ndvi(F.col(red), F.col(nir)))
    medians = good.groupBy(key).agg(F.median("_v").alias("_m"))
    return pixels.select(key).join(medians, key, "left").select(key, F.coalesce("_m", F.lit(0.0)).alias("ndvi"), F.col("_m").isNotNull().cast("int").alias("mask"))


def masked_value(value: Column, mask: Column) -> Column:
    """Value of a measured pixel, 0 elsewhere."""
    return F.when(mask == 0, 0.0).otherwise(value)


def degrees_of(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """Latitude and longitude of a point in a raster's reference system: ``degrees`` (x is longitude), ``sinusoidal`` or ``utm:<zone>``."""
    if crs == "degrees":
        return y, x
    return from_sinusoidal(x, y) if crs == "sinusoidal" else from_utm(x, y, int(crs.removeprefix("utm:")))


def point_of(lat: Column, lon: Column, crs: str) -> tuple[Column, Column]:
    """x and y of a place in a reference system."""
    if crs == "degrees":
        return lon, lat
    return sinusoidal(lat, lon) if crs == "sinusoidal" else utm(lat, lon, int(crs.removeprefix("utm:")))


def cell_of(x: Column, y: Column, meta: dict[str, float]) -> tuple[Column, Column]:
    """Row and column of the cell that a point lies in, by the inverse of a raster's affine a..f (b and d, its rotation, are 0 unless given)."""
    a, b, d, e = (meta.get(k, 0.0) for k in "abde")
    u, v = x - meta["c"], y - meta["f"]
    if b == d == 0:
        return F.floor(v / e).cast("int"), F.floor(u / a).cast("int")
    det = a * e - b * d
    return F.floor((a * v - d * u) / det).cast("int"), F.floor((e * u - b * v) / det).cast("int")


def aligned(fine: DataFrame, coarse: DataFrame, fine_meta: dict[str, float], coarse_meta: dict[str, float], value: str, fine_crs: str = "degrees", coarse_crs: str = "degrees") -> DataFrame:
    """Fine cells with the value of the coarse cell their centre lies in, null outside. Rasters may be rotated, and of different reference systems."""
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    x = F.lit(fine_meta["c"]) + c * fine_meta["a"] + r * fine_meta.get("b", 0.0)
    y = F.lit(fine_meta["f"]) + c * fine_meta.get("d", 0.0) + r * fine_meta["e"]
    if fine_crs != coarse_crs:
        x, y = point_of(*degrees_of(x, y, fine_crs), coarse_crs)
    row, col = cell_of(x, y, coarse_meta)
    at = fine.withColumns({"_c": col, "_r": row})
    return at.join(coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value)), ["_r", "_c"], "left").drop("_r", "_c")


def valid_cells(df: DataFrame, value: str, nodata: float = NODATA) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (v != nodata))


def exported(df: DataFrame, bands: list[str]) -> DataFrame:
    """Nulls as the nodata value in the band's own type, for writing rasters only."""
    return df.withColumns({b: F.coalesce(F.col(b), F.lit(NODATA).cast(df.schema[b].dataType)) for b in bands})


def processed_granules(raw: DataFrame, meta: DataFrame, box: tuple[float, float, float, float], bands: list[str], qa: str = "qa", scale: float = 0.001, fill: int = -28672) -> tuple[DataFrame, DataFrame]:
    """The whole chain for all granules at once: scale and fill, quality mask, clip to a box, trim. Granules without a valid pixel leave.

    A row's quality and all its bands are in one row, so masking needs no join; the only shuffles are the joins with metadata
    and extents, which have one row per granule.
    """
    good = masked(raw.withColumns({b: scaled(F.col(b), scale, fill) for b in bands}), qa, bands)
    return trimmed(clipped(good, meta, box), meta, bands)
