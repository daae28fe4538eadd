"""The declarative hypothesis: a dataclass, its JSON, and its checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as t


@dataclass
class DataSource:
    provider: str
    source_type: str = "prices"
    fields: list[str] = field(default_factory=list)


@dataclass
class HypothesisSpec:
    """What is tested: a signal over a universe, held for some days, with the least effect that counts."""

    name: str
    uuid: str
    signal_name: str = "reversal"
    direction: int = 1
    holding_period_days: int = 5
    rebalance: str = "weekly"
    top_quantile: float = 0.2
    long_only: bool = True
    start: str = "1900-01-01"
    end: str = "2999-12-31"
    min_alpha_bps: float = 0.0
    min_sharpe: float = 0.0
    min_hit_rate: float = 0.5
    max_drawdown: float = 0.5
    custom_filter: str = ""
    data_sources: list[DataSource] = field(default_factory=list)

    def validate(self) -> list[str]:
        """What is wrong with it; empty if nothing."""
        wrong = []
        if not self.name or not self.uuid:
            wrong.append("name and uuid are required")
        if self.holding_period_days < 1:
            wrong.append("holding_period_days must be at least 1")
        if not 0 < self.top_quantile <= 0.5:
            wrong.append("top_quantile must be over 0 and at most 0.5")
        if self.rebalance not in ("daily", "weekly", "monthly"):
            wrong.append("rebalance must be daily, weekly or monthly")
        if self.start >= self.end:
            wrong.append("start must be before end")
        if self.direction not in (-1, 1):
            wrong.append("direction must be 1 or -1")
        return wrong

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> HypothesisSpec:
        """Unknown keys are ignored."""
        held = {k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        held["data_sources"] = [DataSource(**{k: v for k, v in d.items() if k in DataSource.__dataclass_fields__}) for d in held.get("data_sources", [])]
        return cls(**held)


#: The same as a Spark schema, for from_json over many specs at once.
SCHEMA = t.StructType(
    [t.StructField(n, k) for n, k in (("name", t.StringType()), ("uuid", t.StringType()), ("signal_name", t.StringType()), ("direction", t.IntegerType()), ("holding_period_days", t.IntegerType()), ("rebalance", t.StringType()), ("top_quantile", t.DoubleType()), ("long_only", t.BooleanType()))]
    + [t.StructField("data_sources", t.ArrayType(t.StructType([t.StructField("provider", t.StringType()), t.StructField("source_type", t.StringType()), t.StructField("fields", t.ArrayType(t.StringType()))])))]
)
