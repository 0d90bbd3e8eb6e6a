"""A contract: what a source table must look like and how it becomes a clean one.

A rule is a condition over one row that should not hold. Rules are counted together in one
aggregate, so adding a rule adds no pass over the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.numbers import is_whole, number
from rollbook.functions.points import in_bounds, latitude, longitude
from rollbook.functions.text import matches, present

ERROR = "error"
WARNING = "warning"


def source(name: str) -> Column:
    """A raw column; published names hold spaces, dots and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def derived(name: str, what: str) -> Column:
    """A parsed form of a raw column in a prepared table: ``number``, ``longitude``, ``latitude``."""
    return source(f"{name} as {what}")


def prepare(df: DataFrame, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Strip every column once, blank becoming null, and parse numbers and points once.

    Columns to ``keep`` stay as they are.
    """
    numbers = {r.column for r in contract.rules if isinstance(r, WholeNumber | NumberWithin)}
    points = {r.column for r in contract.rules if isinstance(r, PointWithin)}
    stripped = df.select(*(present(source(name)).alias(name) for name in contract.columns), *keep)
    return stripped.withColumns(
        {f"{name} as number": number(source(name)) for name in sorted(numbers)}
        | {f"{name} as longitude": longitude(source(name)) for name in sorted(points)}
        | {f"{name} as latitude": latitude(source(name)) for name in sorted(points)}
    )


@dataclass(frozen=True)
class Check:
    """One counted condition over a prepared row."""

    severity: str
    code: str
    column: str
    message: str
    failing: Column


@dataclass(frozen=True)
class Required:
    column: str

    def checks(self) -> list[Check]:
        message = f"{self.column!r} cannot be blank."
        blank = source(self.column).isNull()
        return [Check(ERROR, "missing_required_value", self.column, message, blank)]


@dataclass(frozen=True)
class Optional:
    column: str

    def checks(self) -> list[Check]:
        message = f"{self.column!r} contains blank values."
        blank = source(self.column).isNull()
        return [Check(WARNING, "missing_optional_value", self.column, message, blank)]


@dataclass(frozen=True)
class Matches:
    """Text must match a pattern; a blank passes unless ``null_fails``."""

    column: str
    pattern: str
    code: str
    message: str
    severity: str = WARNING
    null_fails: bool = False

    def checks(self) -> list[Check]:
        text = source(self.column)
        failing = ~matches(text, self.pattern)
        if self.null_fails:
            failing = text.isNull() | failing
        return [Check(self.severity, self.code, self.column, self.message, failing)]


@dataclass(frozen=True)
class WholeNumber:
    """Non-blank text must be an integer; a required column reports its blanks here too."""

    column: str
    required: bool = False

    def checks(self) -> list[Check]:
        x = derived(self.column, "number")
        failing = source(self.column).isNotNull() & (x.isNull() | ~is_whole(x))
        message = f"{self.column!r} must contain integer values."
        found = [Check(ERROR, "invalid_integer", self.column, message, failing)]
        return found + (Required(self.column).checks() if self.required else [])


@dataclass(frozen=True)
class NumberWithin:
    """A parsed number must lie in a range, inclusive unless ``lower_open``; None is no bound.

    With ``whole``, text that is present but no integer fails as well.
    """

    column: str
    lower: float | None
    upper: float | None
    code: str
    message: str
    severity: str = ERROR
    whole: bool = False
    lower_open: bool = False

    def checks(self) -> list[Check]:
        x = derived(self.column, "number")
        outside = F.lit(False)
        if self.lower is not None:
            outside = outside | ((x <= self.lower) if self.lower_open else (x < self.lower))
        if self.upper is not None:
            outside = outside | (x > self.upper)
        failing = x.isNotNull() & outside
        if self.whole:
            failing = source(self.column).isNotNull() & (x.isNull() | ~is_whole(x) | outside)
        return [Check(self.severity, self.code, self.column, self.message, failing)]


@dataclass(frozen=True)
class OneOf:
    """Present text must belong to a small vocabulary."""

    column: str
    values: tuple[str, ...]

    def outside(self) -> Column:
        text = source(self.column)
        return text.isNotNull() & ~text.isin(*self.values)

    def checks(self) -> list[Check]:
        message = f"{self.column!r} contains unreviewed values"
        return [Check(ERROR, "unexpected_category", self.column, message, self.outside())]


@dataclass(frozen=True)
class PointWithin:
    """Present text must be a point on the globe."""

    column: str
    code: str
    message: str

    def checks(self) -> list[Check]:
        inside = in_bounds(derived(self.column, "longitude"), derived(self.column, "latitude"))
        failing = source(self.column).isNotNull() & ~inside
        return [Check(WARNING, self.code, self.column, self.message, failing)]


@dataclass(frozen=True)
class Unique:
    """Parsed numbers must not repeat. The one rule that needs a shuffle."""

    column: str
    code: str
    message: str


Rule = Required | Optional | Matches | WholeNumber | NumberWithin | OneOf | PointWithin | Unique


@dataclass(frozen=True)
class FieldDefinition:
    """One entry of the data dictionary of the clean table."""

    name: str
    source: str
    type: str
    nullable: bool
    description: str


@dataclass(frozen=True)
class Provenance:
    name: str
    publisher: str
    identifier: str
    url: str
    licence: str
    licence_url: str


@dataclass(frozen=True)
class Contract:
    """Source header, ordered rules, and the derivation of the clean table.

    ``renames`` maps every source column to its clean name, in published order. ``sentinels``
    maps a new column to (column, value that means missing), ``mappings`` to (column, labels),
    ``flags`` to (column, value), ``points`` a text column to its two coordinate columns.
    """

    renames: dict[str, str]
    rules: tuple[Rule, ...]
    integers: tuple[str, ...] = ()
    upper: tuple[str, ...] = ()
    padded: dict[str, int] = field(default_factory=dict)
    sentinels: dict[str, tuple[str, int]] = field(default_factory=dict)
    mappings: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    flags: dict[str, tuple[str, str]] = field(default_factory=dict)
    points: dict[str, tuple[str, str]] = field(default_factory=dict)
    dictionary: tuple[FieldDefinition, ...] = ()
    provenance: Provenance | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.renames)
