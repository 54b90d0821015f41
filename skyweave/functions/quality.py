"""Quality codes as column expressions: scene classes, bit-packed masks, cloud scores.

A quality score is an integer, lower is better; ``NODATA`` (65535) marks what
must not be used and ``USABLE`` is the largest score of a usable pixel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = 65535
USABLE = 32767

# Classes of the scene classification layer.
SCL_BEST = (4, 5, 6, 11)
SCL_FAIR = (7,)
SCL_POOR = (2, 3)

#: Byte that stands for "no code", by dialect.
CODE_NODATA = {"scl": 0, "fmask": 255, "mandatory": 255}


def scl_quality(code: Column) -> Column:
    return F.when(code.isin(*SCL_BEST), 0).when(code.isin(*SCL_FAIR), 1).when(code.isin(*SCL_POOR), 2).otherwise(NODATA)


def scl_valid(code: Column) -> Column:
    return code != CODE_NODATA["scl"]


def scl_clear(code: Column) -> Column:
    return code.isin(*SCL_BEST)


def fmask_clear(code: Column) -> Column:
    """No cloud, shadow or cirrus bit, and at most low aerosol."""
    return (code != CODE_NODATA["fmask"]) & (code.bitwiseAND(15) == 0) & (F.shiftright(code, 6).bitwiseAND(3) <= 1)


def fmask_score(code: Column) -> Column:
    def bit(k: int) -> Column:
        return F.shiftright(code, k).bitwiseAND(1) == 1

    aerosol = F.shiftright(code, 6).bitwiseAND(3)
    return F.when((code == CODE_NODATA["fmask"]) | bit(1), NODATA).when(bit(0) | bit(3), 2).when(bit(2) | (aerosol >= 2), 1).when(bit(4), 1).otherwise(0)


def mandatory_clear(code: Column) -> Column:
    return code == 0


def mandatory_score(code: Column) -> Column:
    return F.when(code.isin(0, 1), code.cast("int")).otherwise(NODATA)


def cloud_score_valid(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0)


def cloud_score_quality(score: Column, threshold: float = 0.0) -> Column:
    """Clear scores of 0 to 1 become 10000 to 0; below the threshold there is no data."""
    scaled = F.least(F.greatest(F.rint((F.lit(1.0) - score) * 10000), F.lit(0.0)), F.lit(float(NODATA - 1)))
    return F.when(cloud_score_valid(score) & (score >= threshold), scaled.cast("int")).otherwise(NODATA)


def finite(value: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def usable(bands: list[Column], quality: Column, strict: bool = True) -> Column:
    """Whether a pixel may win: all bands finite and quality usable, or (not strict) the quality alone."""
    if not strict:
        return quality != NODATA
    out = quality.isNotNull() & (quality <= USABLE)
    for band in bands:
        out = out & finite(band)
    return out


def merged(*codes: Column) -> Column:
    """The worst of several quality bands."""
    return F.greatest(*codes) if len(codes) > 1 else codes[0]


def fill_to_nodata(value: Column, *fills) -> Column:
    return F.when(value.isin(*fills), NODATA).otherwise(value)


def selection_score(quality: Column, sample_index: Column, order: Column, weights: tuple[float, float, float] = (1e6, 1.0, 1.0)) -> Column:
    """The ranking key: an arithmetic sum, so a lower sample may offset a later order."""
    return quality * weights[0] + F.coalesce(sample_index, F.lit(0)) * weights[1] + order * weights[2]
