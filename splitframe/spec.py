"""Description of one party's table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

COMPANY = "company"
PARTNER = "partner"
LABEL = "y"


@dataclass(frozen=True)
class TableSpec:
    """Column groups of a party table: id, private features, public columns, label."""

    id: str
    features: tuple[str, ...]
    public: tuple[str, ...] = ()
    label: str | None = None

    @property
    def columns(self) -> list[str]:
        tail = (self.label,) if self.label else ()
        return [self.id, *self.features, *self.public, *tail]


@dataclass(frozen=True)
class Party:
    """A party's DataFrame together with its column groups."""

    df: DataFrame
    spec: TableSpec = field(compare=False)

    @classmethod
    def of(cls, df: DataFrame, id: str = "id", label: str | None = LABEL, public: tuple[str, ...] = ()) -> Party:
        """Every column that is neither id, label nor public is a feature."""
        held = label if label in df.columns else None
        features = tuple(c for c in df.columns if c not in {id, held, *public})
        return cls(df, TableSpec(id, features, tuple(public), held))

    def table(self) -> DataFrame:
        return self.df.select(*self.spec.columns)
