"""Whole analyses in tidy form, interpolators that users add, validation of any of them, and words about results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.model import Grid, Kriging, Rbf, Search, Variogram
from stratafold.operators import correlation, grid, interpolate, outliers, quality, spatial, statistics, variograms
from stratafold.operators.neighbours import nearest_join
from stratafold.operators.ranks import order_quantiles
from stratafold.operators.validation import poisson_count, uniform
from stratafold.session import settled

# --- interpolators as an extension point -------------------------------------------------------------------------


class Interpolator(Protocol):
    """What every method offers: estimates (id, estimate) at targets from points (id, x, y, value)."""

    def __call__(self, points: DataFrame, targets: DataFrame) -> DataFrame: ...


def inverse_distance(search: Search = Search(), power: float = 2.0) -> Interpolator:
    return lambda points, targets: interpolate.idw(points, targets, search, power).select("id", "estimate")


def kriged(model: Variogram | None = None, k: Kriging = Kriging(), search: Search | None = None, axes: Sequence[str] = ("x", "y"), max_distance: float | None = None, lags: int = 15) -> Interpolator:
    """Kriging; without a model the best of those fitted to the points' own variogram is used."""

    def estimate(points: DataFrame, targets: DataFrame) -> DataFrame:
        own = model
        if own is None:
            b = spatial.bounds(points).first()
            most = max_distance or 0.5 * ((b.x_max - b.x_min) ** 2 + (b.y_max - b.y_min) ** 2) ** 0.5
            own = variograms.best(variograms.fit_all(variograms.experimental(points, most, lags)))
        return interpolate.kriging(points, targets, own, k, search, axes).select("id", "estimate")

    return estimate


def radial(p: Rbf = Rbf(), search: Search | None = None, axes: Sequence[str] = ("x", "y")) -> Interpolator:
    return lambda points, targets: interpolate.rbf(points, targets, p, search, axes)


METHODS: dict[str, Callable[..., Interpolator]] = {"idw": inverse_distance, "kriging": kriged, "rbf": radial}


def register_method(name: str, make: Callable[..., Interpolator]) -> None:
    """Add or replace a method by name."""
    METHODS[name] = make


def run(points: DataFrame, method: str, cell_size: float = 50.0, buffer: float = 0.1, **parameters) -> DataFrame:
    """(id, ix, iy, x, y, estimate): grid over the points' box and estimates by a named method with its parameters."""
    nodes = grid.regular(points.sparkSession, Grid(cell_size=cell_size, buffer=buffer), points)
    return nodes.join(METHODS[method](**parameters)(points, nodes), "id", "left")


def fold_predictions(points: DataFrame, fold: str, method: Interpolator) -> DataFrame:
    """(id, fold, actual, predicted) of any method: each fold from a fit of the others; a fit per fold, folds are few."""
    out = None
    for (k,) in sorted(points.select(fold).distinct().collect()):
        test = points.where(F.col(fold) == k)
        found = method(points.where(F.col(fold) != k), test)
        part = test.select("id", F.col(fold).alias("fold"), F.col("value").alias("actual")).join(found.select("id", F.col("estimate").alias("predicted")), "id", "left")
        out = part if out is None else out.unionByName(part)
    return out


def compare_methods(points: DataFrame, fold: str, methods: dict[str, Interpolator]) -> DataFrame:
    """(method, metrics) of the same folds."""
    out = None
    for name, method in methods.items():
        part = statistics.error_metrics(fold_predictions(points, fold, method)).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def analytical_uncertainty(points: DataFrame, targets: DataFrame, model: Variogram, measurement: float, k: Kriging = Kriging(), search: Search | None = None, z: float = 1.959963984540054) -> DataFrame:
    """(id, estimate, std, low, high): kriging variance and measurement error, in normal intervals."""
    found = interpolate.kriging(points, targets, model, k, search)
    std = F.sqrt(F.col("variance") + measurement * measurement)
    return found.select("id", "estimate", std.alias("std"), (F.col("estimate") - z * std).alias("low"), (F.col("estimate") + z * std).alias("high"))


# --- single measures ---------------------------------------------------------------------------------------------


def spatial_distribution(points: DataFrame) -> DataFrame:
    """One row: extents, area, density, mean and deviation of nearest distances, and points nearer than a tenth of the mean; ``crowded`` if those are over a tenth of all."""
    b = spatial.bounds(points)
    near = settled(nearest_join(points, points, 1, other=True, keep=()).select("dist"))
    s = near.agg(F.avg("dist").alias("mean_nearest"), F.stddev_pop("dist").alias("std_nearest"), F.count("*").alias("n_near"))
    close = near.crossJoin(F.broadcast(s)).agg(F.count_if(F.col("dist") < 0.1 * F.col("mean_nearest")).alias("very_close"))
    row = b.crossJoin(s).crossJoin(close)
    return row.select("n", (F.col("x_max") - F.col("x_min")).alias("x_range"), (F.col("y_max") - F.col("y_min")).alias("y_range"), "area", "density", "mean_nearest", "std_nearest", "very_close", (F.col("very_close") > 0.1 * F.col("n")).alias("crowded"))


def spatial_coverage(points: DataFrame, bins: int = 10) -> DataFrame:
    """One row: area, density and uniformity 1 / (1 + CV) of the counts of all cells, empty ones included."""
    c = spatial.cells(points, bins).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    mean = F.col("s") / (bins * bins)
    cv = F.sqrt(F.greatest(F.col("s2") / (bins * bins) - mean * mean, F.lit(0.0))) / mean
    return spatial.bounds(points).crossJoin(c).select("n", "area", "density", (1 / (1 + cv)).alias("uniformity"))


def directional_errors(predictions: DataFrame, directions: int = 8) -> DataFrame:
    """(angle, bias, rmse): sorting by a direction changes no mean, so all directions have those of all errors, as by definition."""
    e = F.col("predicted") - F.col("actual")
    s = predictions.where("predicted is not null").agg(F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return s.select(F.explode(F.array(*(F.lit(360.0 * i / directions) for i in range(directions)))).alias("angle"), "bias", "rmse")


def trend_kind(points: DataFrame, least: float = 0.1, gain: float = 1.2) -> DataFrame:
    """(kind, r2): linear if a plane explains enough, quadratic if second powers explain that much more; by sums of products in one pass."""
    terms = [F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("x") * F.col("y")]
    middle = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("value").alias("mv"), F.count("*").alias("n")).first()
    spark = points.sparkSession
    if middle.n < 10:
        return spark.createDataFrame([(None, 0.0)], "kind string, r2 double")
    rows = points.select((F.col("x") - middle.mx).alias("x"), (F.col("y") - middle.my).alias("y"), (F.col("value") - middle.mv).alias("v"))
    products = rows.agg(F.sum(F.col("v") * F.col("v")), *(F.sum(a * F.col("v")) for a in terms), *(F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:])).first()
    total, right = products[0], np.array(products[1:7])
    gram = np.zeros((6, 6))
    gram[np.triu_indices(6)] = products[7:]
    gram = gram + np.triu(gram, 1).T

    def explained(m: int) -> float:
        return float(np.linalg.lstsq(gram[:m, :m], right[:m], rcond=None)[0] @ right[:m]) / total if total else 0.0

    linear = explained(3)
    kind, r2 = ("linear", linear) if linear > least else (None, linear)
    if kind and middle.n > 20 and (more := explained(6)) > gain * linear:
        kind, r2 = "quadratic", more
    return spark.createDataFrame([(kind, r2)], "kind string, r2 double")


def best_bandwidth(points: DataFrame, bandwidths: Sequence[float]) -> DataFrame:
    """(bandwidth, log_likelihood, best) of kernel densities at the points themselves."""
    out = None
    for h in bandwidths:
        part = spatial.density_kernel(points, h).agg(F.lit(float(h)).alias("bandwidth"), F.sum("log_density").alias("log_likelihood"))
        out = part if out is None else out.unionByName(part)
    out = settled(out)
    top = F.broadcast(out.agg(F.max("log_likelihood").alias("_top")))
    return out.crossJoin(top).select("bandwidth", "log_likelihood", (F.col("log_likelihood") == F.col("_top")).alias("best"))


def median_interval(df: DataFrame, value: str, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(median, low, high): bootstrap interval of the median. A replicate weights each different value by Poisson counts of its rows."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = v.withColumn("_i", F.monotonically_increasing_id())
    counted = rows.select("v", "_i", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("w", poisson_count(uniform(seed, F.col("rep"), F.col("_i")))).where("w > 0")
    each = counted.groupBy("rep").agg(F.percentile("v", F.lit(0.5), F.col("w")).alias("median"))
    low, high = order_quantiles(each, "median", (0.5 - level / 2, 0.5 + level / 2))
    return df.sparkSession.createDataFrame([(order_quantiles(v, "v", (0.5,))[0], low, high)], "median double, low double, high double")


def grid_problems(cells: DataFrame) -> list[str]:
    """What speaks against writing a grid (ix, iy, x, y, value): nothing in it, missing nodes, nodes twice."""
    s = cells.agg(F.count("*").alias("n"), F.count_distinct("ix").alias("nx"), F.count_distinct("iy").alias("ny"), F.count_distinct("ix", "iy").alias("places"), F.count("value").alias("known")).first()
    tests = ((s.n == 0, "the grid is empty"), (s.places < s.nx * s.ny, "nodes are missing"), (s.n > s.places, "nodes occur twice"), (s.n > 0 and s.known == 0, "no value is known"))
    return [text for test, text in tests if test]


# --- whole analyses ----------------------------------------------------------------------------------------------


def tidy(section: str, row: DataFrame, key: str | None = None) -> DataFrame:
    """(section, item, metric, value) of a table's numbers; ``key`` names the rows."""
    numbers = [c for c, t in row.dtypes if t in ("double", "float", "bigint", "int", "boolean") and c != key]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers))).alias("p")
    return row.select(F.lit(section).alias("section"), (F.col(key).cast("string") if key else F.lit("all")).alias("item"), pairs).select("section", "item", "p.metric", "p.value")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def analyse_values(df: DataFrame, value: str) -> DataFrame:
    """Description, shape, quantiles, variability, extremes, intervals and normality of one column."""
    return _all([
        tidy("descriptive", statistics.descriptive(df, value)), tidy("shape", statistics.shape(df, value)), tidy("quantiles", statistics.quantile_table(df, value), "percent"), tidy("variability", statistics.variability(df, value)),
        tidy("outliers", statistics.outlier_counts(df, value)), tidy("intervals", statistics.confidence_intervals(df, value), "statistic"), tidy("normality", statistics.normality(df, value), "test"),
    ])


def analyse_places(points: DataFrame) -> DataFrame:
    """Box, centre, density, neighbours, pattern and trend of places; sections that need more points than there are stay out."""
    n = points.limit(10).count()
    parts = [tidy("bounds", spatial.bounds(points)), tidy("centre", spatial.centre(points))]
    if n >= 3:
        parts += [tidy("quadrats", spatial.quadrats(points, 4)), tidy("hull", spatial.hull_measures(points))]
    if n >= 5:
        parts += [tidy("neighbours", spatial.nearest_neighbours(points)), tidy("variation", spatial.density_variation(points, 15))]
    if n >= 10:
        parts += [tidy("directions", spatial.directional_extent(points), "angle"), tidy("ellipse", spatial.ellipse(points)), tidy("trend", spatial.trend(points))]
    return _all(parts)


def analyse_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations, ranks, summary and collinearity of the columns that vary; fewer than two raise ValueError."""
    varying = correlation.varying(df, columns)
    if len(varying) < 2:
        raise ValueError("fewer than two columns vary")
    named = lambda t: t.withColumn("pair", F.concat_ws("/", "var1", "var2"))
    p = settled(correlation.pearson(df, varying))
    return _all([tidy("pearson", named(p), "pair"), tidy("spearman", named(correlation.spearman(df.select(*varying), varying)), "pair"), tidy("summary", correlation.summary(p)), tidy("collinearity", correlation.multicollinearity(df, varying))])


def analyse_quality(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Completeness, repetitions, business rules and, where given, ranges."""
    parts = [tidy("completeness", quality.completeness(df), "column"), tidy("duplicates", quality.duplicates(df, keys)), tidy("rules", quality.business_rules(df), "column")]
    return _all(parts + ([tidy("ranges", quality.ranges(df, ranges), "column")] if ranges else []))


def analyse_variogram(points: DataFrame, max_distance: float, lags: int = 15) -> DataFrame:
    """Experimental variogram, variograms by direction, and fitted models."""
    v = settled(variograms.experimental(points, max_distance, lags))
    d = variograms.directional(points, max_distance, lags).withColumn("item", F.concat_ws("/", F.col("direction").cast("string"), F.col("lag").cast("string")))
    return _all([tidy("experimental", v, "lag"), tidy("directional", d, "item"), tidy("models", variograms.fit_all(v), "model")])


def flags(points: DataFrame, kind: str) -> DataFrame:
    """(id, method) of all statistical, spatial or multivariate outlier tests."""
    tests = {
        "statistical": (outliers.fences, outliers.z_scores, outliers.modified_z, outliers.grubbs),
        "spatial": (outliers.distance, outliers.local_factor, outliers.residual, outliers.edge),
        "multivariate": (outliers.mahalanobis, outliers.isolation, outliers.one_class, outliers.robust_distance),
    }[kind]
    return _all([t(points).select("id", "method") for t in tests])


def summary_report(analysis: DataFrame, title: str) -> str:
    """Text of a tidy analysis, section by section; it holds a few hundred rows by its making."""
    lines, last = [title, "=" * len(title)], None
    for r in analysis.orderBy("section", "item", "metric").collect():
        if r.section != last:
            lines += ["", r.section, "-" * len(r.section)]
            last = r.section
        lines.append(f"{'' if r.item == 'all' else r.item + ' '}{r.metric}: {'N/A' if r.value is None else f'{r.value:.4g}'}")
    return "\n".join(lines)


# --- words -------------------------------------------------------------------------------------------------------


def pattern_words(uniformity: float, clustering: float) -> str:
    """Fixed thresholds: uniformity 0.7 and 0.4, clustering 0.7."""
    if clustering > 0.7:
        return "clustered"
    return "even" if uniformity > 0.7 else "moderately even" if uniformity > 0.4 else "uneven"


def radius_words(radius: float, mean_spacing: float) -> str:
    share = radius / mean_spacing if mean_spacing else 0.0
    return f"{radius:g} is {share:.1f} times the mean spacing: " + ("few neighbours, local detail" if share < 2 else "several neighbours, balanced" if share < 5 else "many neighbours, smooth")


def power_words(power: float) -> str:
    return f"power {power:g}: " + ("smooth, far points count" if power < 1.5 else "balanced" if power <= 2.5 else "near points decide")


class Events:
    """Handlers by name of an event, called in the order they were bound; a failing one does not keep the others."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable]] = {}

    def bind(self, name: str, handler: Callable) -> None:
        self.handlers.setdefault(name, []).append(handler)

    def emit(self, name: str, *args, **kwargs) -> list[Exception]:
        errors = []
        for handler in self.handlers.get(name, ()):
            try:
                handler(*args, **kwargs)
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        return errors
