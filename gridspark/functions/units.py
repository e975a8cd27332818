"""Unit conversion of columns and temperatures, mixing ratios and the like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The factor and offset from one unit to another, y = x * factor + offset.
# The offset of Kelvin is 273.2 for agreement with existing results.
KELVIN = 273.2
LINEAR: dict[tuple[str, str], tuple[float, float]] = {
    ("s", "min"): (1 / 60, 0.0),
    ("min", "h"): (1 / 60, 0.0),
    ("s", "h"): (1 / 3600, 0.0),
    ("m", "km"): (1e-3, 0.0),
    ("M", "km"): (1e-3, 0.0),
    ("km", "m"): (1e3, 0.0),
    ("m", "ft"): (3.28, 0.0),
    ("m", "miles"): (1 / 1609.344, 0.0),
    ("K", "C"): (1.0, -KELVIN),
    ("K", "F"): (1.8, -KELVIN * 1.8 + 32),
    ("F", "C"): (1 / 1.8, -32 / 1.8),
    ("F", "K"): (1 / 1.8, -32 / 1.8 + KELVIN),
    ("m/s", "km/h"): (3.6, 0.0),
    ("M/S", "km/h"): (3.6, 0.0),
    ("m/s", "km/s"): (1e-3, 0.0),
    ("m/s", "miles/h"): (3600 / 1609.344, 0.0),
    ("m/s", "miles/s"): (1 / 1609.344, 0.0),
    ("moles/s", "moles/h"): (3600.0, 0.0),
    ("ppm", "ppb"): (1e3, 0.0),
    ("ppb", "ppt"): (1e3, 0.0),
    ("ppt", "ppb"): (1e-3, 0.0),
    ("ppb", "ppm"): (1e-3, 0.0),
    ("ppm", "ppt"): (1e6, 0.0),
    ("ppt", "ppm"): (1e-6, 0.0),
}


def convert(c: Column, given: str, wanted: str) -> Column:
    """The column in another unit; units in blanks and equal units are the same."""
    given, wanted = given.strip(), wanted.strip()
    if given == wanted:
        return c
    if (given, wanted) not in LINEAR:
        if (wanted, given) in LINEAR:
            k, b = LINEAR[wanted, given]
            return (c - b) / k
        raise ValueError(f"no conversion from {given} to {wanted}")
    k, b = LINEAR[given, wanted]
    return c * k + b


def profile_units(name: Column) -> Column:
    """The unit of a profile's species by its name."""
    mass = name.startswith("A") & F.right(name, F.lit(1)).isin("I", "J", "K") | name.startswith("ASEA")
    return F.when(mass, "micrograms/m**3").when(name.startswith("NUM"), "#/m**3").when(name.startswith("SRF"), "m**2/m**3").otherwise("ppmV")


# The unit of particles and of gases by kind of file.
FILE_UNITS: dict[str, tuple[str, str]] = {
    "EMISSIONS": ("g/time", "mol/time"),
    "AVERAGE": ("micrograms/m**3", "ppm"),
    "BOUNDARY": ("micrograms/m**3", "ppm"),
    "INSTANT": ("micrograms/m**3", "micromoles/m**3"),
    "IPR": ("micrograms/m**3", "micromoles/m**3"),
    "AIRQUALITY": ("micrograms/m**3", "ppm"),
    "DEPOSITION": ("g/ha", "mol/ha"),
}


def species_units(name: Column, kind: str, particles: list[str]) -> Column:
    """By the kind of file and whether a species is one of the particles; deposition by the name's ending."""
    mass, gas = FILE_UNITS[kind.strip()]
    fallen, fallen_gas = FILE_UNITS["DEPOSITION"]
    base = F.regexp_replace(name, "_(DD|WD)$", "")
    return F.when(F.right(name, F.lit(3)) == "_DV", "m/s").when(base != name, F.when(base.isin(*particles), fallen).otherwise(fallen_gas)).otherwise(F.when(name.isin(*particles), mass).otherwise(gas))
