"""Published rates: Wilson bounds, proportions and ratios, withheld below a minimum of evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WITHHELD = "insufficient-evidence"
UNCOVERED = "insufficient-coverage"


@dataclass(frozen=True)
class Floor:
    """A floor for all keys, with exceptions."""

    default: float
    overrides: dict[str, float] = field(default_factory=dict)

    def of(self, key: Column) -> Column:
        out = F.lit(self.default)
        for k, v in sorted(self.overrides.items()):
            out = F.when(key == k, F.lit(v)).otherwise(out)
        return out


@dataclass(frozen=True)
class Accounting:
    min_denominator: int = 5
    replays: int = 2
    interval_z: float = 1.96
    interval_precision: int = 6
    resolved_rate_floor: Floor = Floor(0.9, {"differential": 0.0})
    measurable_share_floor: Floor = Floor(0.7, {"policy": 0.0})
    twin_coverage_floor: Floor = Floor(0.5, {"policy": 0.0})

    def __post_init__(self):
        floors = [v for f in (self.resolved_rate_floor, self.measurable_share_floor, self.twin_coverage_floor) for v in (f.default, *f.overrides.values())]
        if self.min_denominator < 1 or self.replays < 2 or not self.interval_z > 0 or not 1 <= self.interval_precision <= 12 or not all(0 <= v <= 1 for v in floors):
            raise ValueError("invalid accounting parameters")


def to_fixed(value: float, precision: int) -> float:
    """Half up on the exact binary value: 1.005 has two digits 1.0, as it is below 1.005."""
    return float(Decimal(value).quantize(Decimal(1).scaleb(-precision), ROUND_HALF_UP))


def round_to_fixed(value: Column, precision: int) -> Column:
    """Decimal rounding in Spark starts from the shortest decimal form instead, so the few published figures go through Python."""

    @F.arrow_udf("double")
    def rounded(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in values:
            yield pa.array([None if x is None or x != x else to_fixed(x, precision) for x in part.to_pylist()], pa.float64())

    return rounded(value.cast("double"))


def wilson(point: Column, n: Column, upper: bool, z: float, precision: int) -> Column:
    """The pessimistic end of the Wilson interval, within [0, 1]; null where it isn't a number (a point above 1)."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    scale = 1.0 + (z * z) / n
    centre = (point + (z * z) / (2.0 * n)) / scale
    spread = (F.lit(z) / scale) * F.sqrt((point * (1.0 - point)) / n + (z * z) / (4.0 * n * n))
    end = centre + spread if upper else centre - spread
    return round_to_fixed(F.when(end.isNotNull() & ~F.isnan(end), F.least(F.lit(1.0), F.greatest(F.lit(0.0), end))), precision)


def _figure(numerator: Column, denominator: Column, n: Column, config: Accounting, bound, shown_n: Column, allowed: Column | None) -> Column:
    none = (denominator == 0) | (n == 0)
    withheld = F.when(~allowed, F.lit(WITHHELD)) if allowed is not None else F.lit(None).cast("string")
    withheld = F.coalesce(withheld, F.when(~none & (n < config.min_denominator), F.lit(WITHHELD)))
    shown = ~none & withheld.isNull()
    point = F.when(shown, F.try_divide(numerator.cast("double"), denominator.cast("double")))
    return F.struct(
        round_to_fixed(point, config.interval_precision).alias("point"),
        (bound(point) if bound else F.lit(None).cast("double")).alias("bound"),
        F.when(shown, shown_n).alias("n"),
        withheld.alias("withheld"),
    )


def proportion(numerator: Column, denominator: Column, upper: bool, config: Accounting, n: Column | None = None, allowed: Column | None = None) -> Column:
    """struct(point, bound, n, withheld): all null if the denominator or n is 0; withheld if n is under the minimum or not ``allowed``."""
    n = denominator if n is None else n
    return _figure(numerator, denominator, n, config, lambda p: wilson(p, n, upper, config.interval_z, config.interval_precision), n, allowed)


def ratio(numerator: Column, denominator: Column, config: Accounting, n: Column | None = None, allowed: Column | None = None) -> Column:
    """A figure without a bound. The guard is n, what is shown as n is the denominator."""
    return _figure(numerator, denominator, denominator if n is None else n, config, None, denominator, allowed)
