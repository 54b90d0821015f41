"""Storage codes of composites: scaled 16-bit values and relative uncertainties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyweave.functions.quality import finite


@dataclass(frozen=True)
class Encoding:
    """``scale``, the value for no data, and those of relative uncertainty in percent."""

    scale: int = 10000
    nodata: int = 65535
    uncertainty_nodata: int = 255
    uncertainty_most: int = 200

    def __post_init__(self):
        if self.scale <= 0 or not 0 < self.nodata <= 65535 or not 0 < self.uncertainty_most < self.uncertainty_nodata <= 255:
            raise ValueError("encoding out of range")


DEFAULT = Encoding()


def encode(value: Column, how: Encoding = DEFAULT, single: bool = False) -> Column:
    """Half-even scaled integer, or nodata outside the range; ``single``: products in 32-bit floats."""
    most = (how.nodata - 1) / how.scale
    scaled = (value.cast("float") * F.lit(float(how.scale)).cast("float")) if single else value * how.scale
    return F.when(finite(value) & value.between(0.0, most), F.rint(scaled).cast("int")).otherwise(how.nodata)


def decode(code: Column, how: Encoding = DEFAULT) -> Column:
    return F.when(code != how.nodata, code / how.scale)


def encode_uncertainty(percent: Column, how: Encoding = DEFAULT) -> Column:
    return F.when(finite(percent) & percent.between(0.0, float(how.uncertainty_most)), F.rint(percent).cast("int")).otherwise(how.uncertainty_nodata)


def decode_uncertainty(code: Column, how: Encoding = DEFAULT) -> Column:
    return F.when(code != how.uncertainty_nodata, code.cast("double"))


def spread_uncertainty(single: Column, bands: int) -> Column:
    """One uncertainty for every band."""
    return F.array_repeat(single, bands)


def to_int16(value: Column) -> Column:
    """What a signed 16-bit raster holds: 0 to 32767, no data as 0."""
    return F.when(finite(value), F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(32767.0))).otherwise(0.0).cast("int")


def preview(value: Column, gain: float = 3.5) -> Column:
    """An 8-bit brightness; no data is black."""
    return F.when(finite(value), F.floor(F.least(F.greatest(value * gain, F.lit(0.0)), F.lit(1.0)) * 255)).otherwise(0).cast("int")


def zero_as_nodata(value: Column, fill: float = 0.0) -> Column:
    return F.when(value != fill, value)


def reflectance(number: Column) -> Column:
    return number * 0.0001
