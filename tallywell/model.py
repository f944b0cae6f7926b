"""What the operators share: column roles, refusals, keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Unsupported(ValueError):
    """An operator refuses what it can't answer exactly as asked, instead of answering something near it."""

    def __init__(self, what: str, why: str):
        super().__init__(f"{what}: {why}")
        self.what, self.why = what, why


@dataclass(frozen=True)
class Roles:
    """Which columns are labels, and which one is the value."""

    labels: tuple[str, ...] = field(default=())
    value: str = "value"

    def of(self, df: DataFrame) -> DataFrame:
        """Labels, then the value; nothing else reaches the plan."""
        missing = {*self.labels, self.value} - set(df.columns)
        if missing:
            raise Unsupported(f"columns {sorted(missing)}", "the table doesn't have them")
        return df.select(*self.labels, self.value)


def counting_key(df: DataFrame, name: str) -> Column:
    """Integers and strings by value; doubles by their bits, so that -0.0 isn't 0.0 and NaN is NaN."""
    return df[name].cast("string") if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else df[name]


def subset_key(labels: dict[str, Column]) -> Column:
    """label:value;label:value over the labels that aren't null, with \\ : ; escaped."""
    escaped = {k: F.regexp_replace(v.cast("string"), r"([\\:;])", r"\\$1") for k, v in labels.items()}
    return F.concat_ws(";", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v)) for k, v in escaped.items()])
