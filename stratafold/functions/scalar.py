"""Column functions: variogram models, kernels, weights, transforms, formats."""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


def variogram(kind: str, h: Column, nugget: float, sill: float, range_: float, style: str = "analyser") -> Column:
    """Model value at distance h. ``style`` "kriging" has linear n+s*h and power n+s*h**range; "analyser" has n+s*h/a and n+s*sqrt(h/a)."""
    n, s, a = F.lit(float(nugget)), F.lit(float(sill)), F.lit(float(range_))
    r = h / a
    forms = {
        "spherical": F.when(h < a, n + s * (1.5 * r - 0.5 * r * r * r)).otherwise(n + s),
        "exponential": n + s * (1 - F.exp(-r)),
        "gaussian": n + s * (1 - F.exp(-r * r)),
        "linear": n + s * (h if style == "kriging" else r),
        "power": n + s * (F.pow(h, a) if style == "kriging" else F.sqrt(r)),
        "nugget": n,
    }
    return F.when(h <= 0, F.lit(0.0)).otherwise(forms[kind])


def kernel(kind: str, r: Column, epsilon: float = 1.0) -> Column:
    """Radial basis function of distance r."""
    e = (F.lit(float(epsilon)) * r) * (F.lit(float(epsilon)) * r)
    return {
        "gaussian": F.exp(-e),
        "multiquadric": F.sqrt(1 + e),
        "inverse_multiquadric": 1 / F.sqrt(1 + e),
        "thin_plate": F.when(r > 0, r * r * F.log(r + 1e-15)).otherwise(0.0),
        "linear": r,
        "cubic": r * r * r,
        "quintic": r * r * r * r * r,
    }[kind]


def idw_weight(d: Column, power: float = 2.0, smoothing: float = 0.0) -> Column:
    return 1 / F.pow(d + smoothing, F.lit(float(power)))


def anisotropy(x: Column, y: Column, ratio: float, angle: float) -> tuple[Column, Column]:
    """Rotate by the angle in degrees, stretch the second axis by the ratio, rotate back."""
    c, s = cos(radians(angle)), sin(radians(angle))
    u, v = x * c + y * s, (y * c - x * s) * ratio
    return u * c - v * s, u * s + v * c


def azimuth(dx: Column, dy: Column) -> Column:
    """Direction in [0, 180) degrees, the two senses of a line alike."""
    a = F.degrees(F.atan2(dy, dx))
    return F.when(a < 0, a + 180).when(a >= 180, a - 180).otherwise(a)


def in_direction(a: Column, direction: float, tolerance: float) -> Column:
    d = F.abs(a - direction)
    return F.least(d, F.abs(d - 180)) <= tolerance


def sector(dx: Column, dy: Column, n: int) -> Column:
    """Number of the sector in [0, n) that the direction lies in."""
    two_pi = 2 * pi
    theta = F.atan2(dy, dx)
    theta = F.when(theta < 0, theta + two_pi).otherwise(theta)
    return F.least(F.floor(theta / (two_pi / n)), F.lit(n - 1)).cast("int")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / F.sqrt(F.lit(2 * pi)) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def box_cox(v: Column, lam: float) -> Column:
    return F.log(v) if lam == 0 else (F.pow(v, F.lit(float(lam))) - 1) / lam


def box_cox_inverse(v: Column, lam: float) -> Column:
    return F.exp(v) if lam == 0 else F.pow(v * lam + 1, F.lit(1.0 / lam))


def yeo_johnson(v: Column, lam: float) -> Column:
    up = F.log1p(v) if lam == 0 else (F.pow(v + 1, F.lit(float(lam))) - 1) / lam
    down = -F.log1p(-v) if lam == 2 else -(F.pow(1 - v, F.lit(2.0 - lam)) - 1) / (2 - lam)
    return F.when(v >= 0, up).otherwise(down)


def yeo_johnson_inverse(v: Column, lam: float) -> Column:
    up = F.expm1(v) if lam == 0 else F.pow(v * lam + 1, F.lit(1.0 / lam)) - 1
    down = 1 - F.exp(-v) if lam == 2 else 1 - F.pow(1 - (2 - lam) * v, F.lit(1.0 / (2 - lam)))
    return F.when(v >= 0, up).otherwise(down)


def decimals(v: Column) -> Column:
    """Digits after the point as the number is written, without closing zeros."""
    text = F.regexp_replace(F.format_string("%.10f", v), "0+$", "")
    return F.length(F.substring_index(text, ".", -1))


def format_number(v: Column, precision: int = 2, locale: str = "en_US") -> Column:
    """Grouped number of a locale; null and NaN give N/A."""
    text = F.format_number(v, precision)
    if locale == "ru_RU":
        text = F.translate(text, ",.", "\u00a0,")
    return F.when(v.isNull() | F.isnan(v.cast("double")), "N/A").otherwise(text)


def format_percentage(v: Column, precision: int = 1, locale: str = "en_US") -> Column:
    """Shares up to 1 count as fractions."""
    return F.concat(format_number(F.when(F.abs(v) <= 1, v * 100).otherwise(v), precision, locale), F.lit("%"))


def format_short(v: Column, precision: int = 1) -> Column:
    """K, M and B for thousands, millions and milliards."""
    size, out = F.abs(v), F.format_string(f"%.{precision}f", v.cast("double"))
    for limit, sign in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(size >= limit, F.concat(F.format_string(f"%.{precision}f", v / limit), F.lit(sign))).otherwise(out)
    return out


def format_currency(v: Column, locale: str = "en_US") -> Column:
    return F.concat(F.lit("$"), format_number(v, 2, locale)) if locale == "en_US" else F.concat(format_number(v, 2, locale), F.lit(" ₽"))


def format_date(v: Column, locale: str = "en_US", kind: str = "date") -> Column:
    date = {"en_US": "MM/dd/yyyy", "ru_RU": "dd.MM.yyyy"}[locale]
    return F.date_format(v, {"date": date, "time": "HH:mm:ss", "datetime": f"{date} HH:mm:ss"}[kind])


def format_dms(v: Column) -> Column:
    """Degrees, minutes and seconds of a decimal coordinate."""
    a = F.abs(v)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = ((a - d) * 60 - m) * 60
    return F.concat(F.when(v < 0, "-").otherwise(""), F.format_string("%d°%d'%.2f\"", d, m, s))


def parse_number(text: Column, locale: str = "en_US") -> Column:
    """Number written in a locale, null if it is none; signs of currency and percent are passed over."""
    bare = F.regexp_replace(text, "[$₽%\\s ]", "")
    bare = F.translate(bare, ",", "") if locale == "en_US" else F.translate(bare, ",", ".")
    return bare.try_cast("double")


def parse_date(text: Column) -> Column:
    """The first of five patterns that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd"))).cast("date")
