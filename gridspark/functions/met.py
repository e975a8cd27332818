"""Meteorological functions of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.safe import div

# Published coefficients of saturation vapour pressure.
E0, A, B = 6.112, 17.67, 243.5
EPS = 0.622


def vapour_pressure(t_c: Column) -> Column:
    """hPa over water at a temperature (or dew point) in Celsius."""
    return F.exp(div(t_c * A, t_c + B)) * E0


def specific_humidity(p_hpa: Column, td_c: Column, grams: bool = False) -> Column:
    """kg/kg (or g/kg) from pressure and dew point."""
    e = vapour_pressure(td_c)
    q = div(e * EPS, p_hpa - e * (1 - EPS))
    return q * 1000 if grams else q


def relative_humidity(t_c: Column, td_c: Column, percent: bool = True) -> Column:
    r = div(vapour_pressure(td_c), vapour_pressure(t_c))
    return r * 100 if percent else r


def mixing_ratio(p_hpa: Column, td_c: Column) -> Column:
    """kg water a kg of dry air."""
    e = vapour_pressure(td_c)
    return div(e * EPS, p_hpa - e)


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """c0 + c1 x + ..., by Horner's rule."""
    return reduce(lambda acc, c: acc * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """u and v of a wind from a direction in degrees."""
    a = F.radians(direction)
    return -speed * F.sin(a), -speed * F.cos(a)


def wind_speed_direction(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed, and the direction in degrees that the wind comes from."""
    return F.sqrt(u * u + v * v), F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def rain_rate(water: Column) -> Column:
    """mm/h from rain water in g/m3."""
    return F.pow(water * 10, F.lit(1.27))


def cloudy(depth: Column) -> Column:
    return (depth >= 5).cast("int")


# Wobus' polynomial of saturation over water, from the constant term, and the value at 0 degrees in hPa.
WOBUS = [0.99999683, -0.90826951e-02, 0.78736169e-04, -0.61117958e-06, 0.43884187e-08, -0.29883885e-10, 0.21874425e-12, -0.17892321e-14, 0.11112018e-16, -0.30994571e-19]
WOBUS_E0 = 6.1078


def saturation_wobus(t_c: Column) -> Column:
    """hPa over water, for -50 to 100 degrees Celsius."""
    return div(F.lit(WOBUS_E0), F.pow(polynomial(t_c, WOBUS), F.lit(8.0)))


def saturation_mixing_ratio(p_hpa: Column, t_c: Column) -> Column:
    """g water a kg of dry air at saturation, with the table's correction for pressure and temperature."""
    x = (t_c - 12.5 + div(F.lit(7500.0), p_hpa)) * 0.02
    e = (p_hpa * 4.5e-06 + x * x * 1.4e-03 + 1.0) * saturation_wobus(t_c)
    return div(e * 0.62197, p_hpa - e) * 1000.0
