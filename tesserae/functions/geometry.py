"""Scale arithmetic and tile names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tiling scheme.
FIELD_OF_VIEW = 4096
BASE_MAGNIFICATION = 5
MPP_AT_ONE_X = 10.0
PHYSICAL_TARGETS = (10, 20, 40)
RELATIVE_TARGETS = (2, 4, 8)


def resolved_mpp(slide_mpp: Column, objective_power: Column, assumed_mpp: Column) -> Column:
    return F.coalesce(
        slide_mpp.cast("double"),
        F.lit(MPP_AT_ONE_X) / objective_power.cast("double"),
        assumed_mpp.cast("double"),
    )


def mpp_source(slide_mpp: Column, objective_power: Column, assumed_mpp: Column) -> Column:
    return (
        F.when(slide_mpp.isNotNull(), "slide_metadata")
        .when(objective_power.isNotNull(), "objective_power_conversion")
        .when(assumed_mpp.isNotNull(), "assumed")
        .otherwise("unknown")
    )


def is_valid_mpp(mpp: Column) -> Column:
    """A missing value is allowed here; a present one must be finite and positive."""
    finite = ~F.isnan(mpp) & (F.abs(mpp) != F.lit(float("inf")))
    return F.coalesce(finite & (mpp > 0), F.lit(True))


def native_magnification(mpp: Column) -> Column:
    return F.lit(MPP_AT_ONE_X) / mpp


def output_pixels(size: Column, magnification: Column, mpp: Column) -> Column:
    """Pixels after resampling to ``magnification``; half-even rounding, at least one.

    Null where the scale is unknown.
    """
    exact = size * magnification / native_magnification(mpp)
    pixels = F.greatest(F.lit(1), F.bround(exact).cast("bigint")).cast("bigint")
    return F.when(exact.isNotNull(), pixels)


def grid_tiles(width: Column, height: Column, size: int = FIELD_OF_VIEW) -> Column:
    return (F.ceil(width / size) * F.ceil(height / size)).cast("bigint")


_TILE_NAME = r"\A([+-]?\d+)_([+-]?\d+)\z"


def _stem(name: Column) -> Column:
    base = F.substring_index(name, "/", -1)
    return F.regexp_replace(base, r"(?s)(\A.+)\.[^.]*\z", "$1")


def tile_x(name: Column) -> Column:
    return _coordinate(name, 1)


def tile_y(name: Column) -> Column:
    return _coordinate(name, 2)


def _coordinate(name: Column, part: int) -> Column:
    stem = _stem(name)
    return F.when(
        stem.rlike(_TILE_NAME), F.regexp_extract(stem, _TILE_NAME, part).try_cast("bigint")
    )


def slide_of(name: Column) -> Column:
    """Slide id: the text before the first dot."""
    return F.substring_index(name, ".", 1)
