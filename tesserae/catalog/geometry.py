"""Registered queries: tiles, zoom children and older splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import fixtures as fx
from tesserae.catalog import sql
from tesserae.catalog.registry import query
from tesserae.operators import regions as ops


@query("gen_tiles", sql.using("slides", "scaled", body="""
SELECT image_id, x || '_' || y || '_m5' AS region_id, x, y, 4096 AS width, 4096 AS height,
  greatest(1, round_even(4096 * 5 / (10.0::DOUBLE / mpp), 0))::BIGINT AS output_width,
  'physical' AS scale_kind, 5.0::DOUBLE AS scale, round(mpp, 9) AS mpp, mpp_source AS magnification_source
FROM (SELECT *, unnest(range(0, ceil(width / 4096)::BIGINT)) * 4096 AS x FROM scaled WHERE input_kind = 'wsi') a,
  LATERAL (SELECT unnest(range(0, ceil(a.height / 4096)::BIGINT)) * 4096 AS y) b
UNION ALL
SELECT image_id, 'roi', 0, 0, width, height, width, 'relative', 1.0::DOUBLE, NULL, 'native_roi_relative_scale'
FROM scaled WHERE input_kind = 'roi'"""))
def gen_tiles(spark: SparkSession, sf: str) -> DataFrame:
    images = ops.scale_columns(fx.slides(spark, sf))
    return ops.tile_regions(images).select(
        "image_id", "region_id", "x", "y", "width", "height", "output_width", "scale_kind",
        "scale", F.round("mpp", 9).alias("mpp"), "magnification_source",
    )


@query("gen_rejected", """
SELECT image_id, reason FROM (
  SELECT 'slide_' || p_partkey AS image_id, CASE WHEN p_partkey % 5 = 0 THEN 'no width'
    WHEN p_partkey % 17 = 5 THEN NULL WHEN p_partkey % 3 = 0 THEN 'unknown scale'
    WHEN p_partkey % 7 = 0 THEN 'invalid scale' END AS reason FROM part)
WHERE reason IS NOT NULL
UNION ALL
SELECT 'slide_' || p_partkey, 'tiled' FROM part
WHERE p_partkey % 5 <> 0 AND (p_partkey % 17 = 5 OR (p_partkey % 3 <> 0 AND p_partkey % 7 <> 0))
UNION ALL
SELECT 'zoom_' || vec_id, CASE WHEN vec_id % 4 IN (1, 3) THEN 'target is no multiple' WHEN label = 8 THEN 'too small'
  ELSE 'children ' || CASE WHEN vec_id % 4 = 0 THEN 4 ELSE 16 END END FROM embeddings""")
def gen_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Images without a usable scale or size, and regions that can't be zoomed, by reason."""
    p = F.expr("cast(substring_index(image_id, '_', -1) as bigint)")
    mpp = F.when(p % 3 == 0, None).when(p % 7 == 0, -0.5).otherwise(0.5)
    images = fx.slides(spark, sf).withColumns({
        "width": F.when(p % 5 != 0, F.col("width")), "mpp": mpp, "mpp_source": F.lit("given")})
    tiled = ops.tile_regions(images).select("image_id").distinct().withColumn("reason", F.lit("tiled"))
    v = F.col("region_id").cast("bigint")
    to = F.element_at(F.array(*[F.lit(x) for x in (10.0, 12.0, 20.0, 2.5)]), (v % 4 + 1).cast("int"))
    children, rejected = ops.checked_zoom(fx.regions(spark, sf), to, to.cast("string"))
    name = lambda key: F.concat(F.lit("zoom_"), key.cast("bigint").cast("string")).alias("image_id")
    counted = children.groupBy(name(F.col("parent_id"))).agg(
        F.concat(F.lit("children "), F.count("*").cast("string")).alias("reason"))
    return ops.rejected_images(images).unionByName(tiled).unionByName(counted).unionByName(
        rejected.select(name(F.col("region_id")), "reason"))


@query("gen_tiles_at", sql.using("slides", "scaled", body="""
SELECT image_id, x || '_' || y || '_m5' AS region_id, x, y,
  greatest(1, round_even(4096 * 5 / (10.0::DOUBLE / mpp), 0))::BIGINT AS output_width
FROM (SELECT 'slide_' || l_partkey AS image_id, (l_orderkey % 9 * 512)::BIGINT AS x,
        (l_suppkey % 7 * 512)::BIGINT AS y FROM lineitem) c
JOIN scaled USING (image_id) WHERE input_kind = 'wsi'"""))
def gen_tiles_at(spark: SparkSession, sf: str) -> DataFrame:
    from tesserae.runtime import table

    coords = table(spark, sf, "lineitem").select(
        F.concat(F.lit("slide_"), F.col("l_partkey").cast("string")).alias("image_id"),
        (F.col("l_orderkey") % 9 * 512).alias("x"), (F.col("l_suppkey") % 7 * 512).alias("y"),
    )
    images = ops.scale_columns(fx.slides(spark, sf)).filter("input_kind = 'wsi'")
    return ops.tile_regions(images, coords).select("image_id", "region_id", "x", "y", "output_width")


@query("gen_zoom", sql.using("regions", body="""
SELECT region_id || '/z' || (10 * (1 + vec_id % 2)) || '/' || (c // f) || '_' || (c % f) AS region_id,
  region_id AS parent_id, x + (c % f) * width // f AS x, y + (c // f) * height // f AS y,
  (c % f + 1) * width // f - (c % f) * width // f AS width,
  (c // f + 1) * height // f - (c // f) * height // f AS height,
  output_width, 5.0::DOUBLE * f AS scale
FROM (SELECT *, unnest(range(0, f * f)) AS c FROM (
  SELECT * REPLACE (width - vec_id % 3 AS width, height - vec_id % 5 AS height),
    2 * (1 + vec_id % 2) AS f FROM regions) WHERE least(width, height) >= f)"""))
def gen_zoom(spark: SparkSession, sf: str) -> DataFrame:
    level = 10 * (1 + F.col("vec_id") % 2)
    r = fx.regions(spark, sf).withColumns({
        "width": F.col("width") - F.col("vec_id") % 3, "height": F.col("height") - F.col("vec_id") % 5,
    })
    return ops.zoom_regions(r, level, level.cast("string")).select(
        "region_id", "parent_id", "x", "y", "width", "height", "output_width", "scale"
    )


@query("gen_zoom_legacy", sql.using("regions", body="""
SELECT region_id AS tile, zoom, i AS cell_row, j AS cell_col,
  CASE WHEN vec_id % 4 = 0 THEN 0 ELSE x END + j * (w // f) AS x,
  CASE WHEN vec_id % 4 = 0 THEN 0 ELSE y END + i * (h // f) AS y,
  CASE WHEN j = f - 1 THEN w - j * (w // f) ELSE w // f END AS width,
  CASE WHEN i = f - 1 THEN h - i * (h // f) ELSE h // f END AS height
FROM (SELECT region_id, vec_id, x, y, width + vec_id % 7 AS w, height + vec_id % 11 AS h, zoom, zoom // 5 AS f,
        unnest(range(0, zoom // 5)) AS i
      FROM regions, (VALUES (5), (15), (20)) z(zoom)) a, LATERAL (SELECT unnest(range(0, a.f)) AS j) b"""))
def gen_zoom_legacy(spark: SparkSession, sf: str) -> DataFrame:
    named = F.col("vec_id") % 4 != 0
    tiles = fx.regions(spark, sf).select(
        F.col("region_id").alias("tile"), F.when(named, F.col("x")).alias("x"),
        F.when(named, F.col("y")).alias("y"), (F.col("width") + F.col("vec_id") % 7).alias("width"),
        (F.col("height") + F.col("vec_id") % 11).alias("height"),
    )
    parts = [
        ops.split_for_zoom(tiles, zoom).withColumn("zoom", F.lit(zoom)) for zoom in (5, 15, 20)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
