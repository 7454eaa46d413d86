"""Filter builders: each returns a boolean Column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

# Which field a flow type filters on and which one it reports.
FLOW_FIELDS = {
    "talker": ("src_ip", "dst_ip"),
    "listener": ("dst_ip", "src_ip"),
    "vlan": ("vlan_id", "src_ip"),
    "dscp": ("tos", "src_ip"),
    "service": ("service_id", "src_ip"),
}
MEASURES = ("bytes", "pkts")

# Code labels used by the catalog and order reports.
CATALOG_STATUS = {0: "Rejected", 1: "Saved", 2: "Published", 3: "Ima_pending", 4: "New", 5: "Excluded"}
ALLOCATION = {1: "Site_01", 2: "Site_02", 3: "Both"}
OWNER = {"S": "Site_02", "K": "Site_01", "B": "Both"}
ORDER_STATUS = {1: "Open", 2: "Invoice", 3: "Pending"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def optional(*terms: tuple[Any, Callable[[Any], Column]]) -> Column:
    """AND of the terms whose argument is given; a None argument is no filter."""
    return all_of(build(value) for value, build in terms if value is not None)


def equals_or_any(c: Column | str, value: Any) -> Column:
    """``col = IFNULL(arg, col)``: rows with a NULL column go even when no value is given."""
    return _col(c).isNotNull() if value is None else _col(c) == F.lit(value)


def shares_bits(c: Column | str, mask: Column | int) -> Column:
    other = mask if isinstance(mask, Column) else F.lit(mask)
    return _col(c).bitwiseAND(other) != 0


def covers_bits(c: Column | str, mask: Column | int) -> Column:
    other = mask if isinstance(mask, Column) else F.lit(mask)
    return _col(c).bitwiseAND(other) == other


def name_starts(c: Column | str, text: str) -> Column:
    return _col(c).startswith(text.upper())


def name_contains(c: Column | str, text: str) -> Column:
    return _col(c).contains(text.upper())


def _moment(value: dt.date | dt.datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def on_day(c: Column | str, day: dt.date) -> Column:
    """Closed window [day, day + 1]: the next midnight belongs to both days."""
    return _col(c).between(_moment(day), _moment(day + dt.timedelta(days=1)))


def last_days(c: Column | str, as_of: dt.date, days: int) -> Column:
    """Half-open window of whole days before ``as_of``."""
    return within(c, as_of - dt.timedelta(days=days), as_of)


def within(c: Column | str, start: dt.date | dt.datetime, end: dt.date | dt.datetime) -> Column:
    return (_col(c) >= _moment(start)) & (_col(c) < _moment(end))


def between(c: Column | str, start: dt.date | dt.datetime, end: dt.date | dt.datetime) -> Column:
    return _col(c).between(_moment(start), _moment(end))


def period(grain: str, period_id: int | None = None) -> Column:
    """One period of a rollup, a whole rollup table (None), or raw rows (no period test)."""
    here = F.col("grain") == grain
    if grain == "raw":
        return here
    return here & (F.col("period_id") > 0 if period_id is None else F.col("period_id") == period_id)


def flow_fields(
    flow_type: str, measure: str, *, netflow: bool = False, application_id: int = 0, class_id: int = 0
) -> tuple[str, str]:
    """(filter field, reported field) of a flow type, after the argument checks."""
    if flow_type not in FLOW_FIELDS:
        raise ValueError(f"wrong flow type {flow_type!r}")
    if (application_id > 0 or class_id > 0) and flow_type not in ("talker", "listener"):
        raise ValueError(f"flow type {flow_type!r} does not go with applications or classes")
    if measure not in MEASURES:
        raise ValueError(f"wrong measure {measure!r}")
    if flow_type == "service" and netflow:
        raise ValueError("netflow rows carry no service")
    return FLOW_FIELDS[flow_type]


def code_label(c: Column | str, labels: Mapping[Any, str], default: str | None = None) -> Column:
    code = _col(c)
    out = None
    for value, label in labels.items():
        out = F.when(code == value, label) if out is None else out.when(code == value, label)
    return out.otherwise(F.lit(default)) if default is not None else out


def leaf(left: Column | str = "l_idx", right: Column | str = "r_idx") -> Column:
    return _col(left) == _col(right) - 1


def name_lists(
    c: Column | str,
    *,
    within: str | None = None,
    without: str | None = None,
    like: str | None = None,
    unlike: str | None = None,
    delimiter: str = ";",
) -> Column:
    """Table-name filter from delimited lists; every LIKE item must hold."""

    def items(text: str | None) -> list[str]:
        return [t.strip() for t in (text or "").split(delimiter) if t.strip()]

    name = _col(c)
    terms: list[Column] = []
    if within is not None:
        terms.append(name.isin(items(within)))
    if without is not None:
        terms.append(~name.isin(items(without)))
    terms += [name.like(t) for t in items(like)]
    terms += [~name.like(t) for t in items(unlike)]
    return all_of(terms)
