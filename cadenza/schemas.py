"""Schemas of the long observation table, its metadata and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, INT, DOUBLE, STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

#: One row per point. Order inside a curve is (time, tie).
OBS = _struct(object_id=LONG, band=STRING, passband=INT, time=DOUBLE, flux=DOUBLE, flux_err=DOUBLE, detected=INT, tie=LONG)
#: Observation files: passband numbers, no band names.
RAW_OBS = _struct(object_id=LONG, mjd=DOUBLE, passband=INT, flux=DOUBLE, flux_err=DOUBLE, detected=INT)
META = _struct(
    object_id=LONG, ra=DOUBLE, decl=DOUBLE, gal_l=DOUBLE, gal_b=DOUBLE, ddf=INT, hostgal_specz=DOUBLE, hostgal_photoz=DOUBLE,
        hostgal_photoz_err=DOUBLE, distmod=DOUBLE, mwebv=DOUBLE, target=INT
)
CURVE_CSV = _struct(time=DOUBLE, value=DOUBLE, error=DOUBLE)
CUTOFF = T.StructType([T.StructField("band", STRING), T.StructField("column", STRING), T.StructField("median_scale", DOUBLE), T.StructField("cutoffs", T.ArrayType(DOUBLE))])
#: Period catalogue: one row per object.
PERIODS = _struct(object_id=LONG, ddf=INT, target=INT, **{f"period{i}": DOUBLE for i in range(1, 6)}, **{f"score{i}": DOUBLE for i in range(1, 6)})


@dataclass(frozen=True)
class BandSpec:
    """A survey's bands in order; a passband number is a place in this order."""

    name: str
    bands: tuple[str, ...]


#: Bands of the surveys and effective wavelengths (nm) of the first.
SIX_BAND = BandSpec("six_band", ("u", "g", "r", "i", "z", "y"))
FOUR_BAND = BandSpec("four_band", ("g", "r", "i", "z"))
TWO_BAND = BandSpec("two_band", ("I", "V"))
WAVELENGTHS = {"u": 368.55, "g": 484.45, "r": 622.95, "i": 753.55, "z": 868.65, "y": 967.85}
