"""Event log reports, newest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shardline.functions.scalars import us_date_time


def event_report(log: DataFrame, when: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The columns with ``when`` as MM/DD/YYYY HH:MI:SS, in true time order, newest first."""
    ordered = log.orderBy(F.col(when).desc(), *ties)
    return ordered.select(*[us_date_time(when).alias(when) if c == when else F.col(c) for c in columns])


def logon_report(log: DataFrame) -> DataFrame:
    return event_report(
        log, "event_date", ["user_name", "event_action", "event_date", "ip_address", "instance_num"], ["user_name"]
    )


def ddl_report(log: DataFrame) -> DataFrame:
    columns = ["user_name", "ddl_date", "ddl_event", "obj_type", "obj_owner", "obj_name"]
    return event_report(log, "ddl_date", columns, ["obj_name"])


def error_report(log: DataFrame) -> DataFrame:
    columns = ["error", "datestamp", "username", "osuser", "machine", "process", "program"]
    return event_report(log, "datestamp", columns, ["username"])
