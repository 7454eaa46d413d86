"""Network-flow reports over period facts.

Facts carry ``grain`` ('raw' or a rollup name), ``period_id`` and ``datetime`` (period
start); written partitioned by grain and month, the range filter prunes files. The bridge
tables are joined among themselves first and written once, so Spark knows the bridge's size
when it chooses between a broadcast and a shuffle join with the facts. What follows are sums
and maxima, combined on the map side.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardline.functions.predicates import flow_fields, leaf, period, within
from shardline.functions.scalars import ipv4_to_binary, ipv4_to_text, mean_delay, ratio
from shardline.operators.aggregates import bit_rate, cells, efficiency
from shardline.operators.hierarchy import children_of
from shardline.operators.ordered import top
from shardline.session import cut_lineage

RTM_FLOW = 4
PET_FLOW = 5

SUMS = ("bytes", "pkts", "tcp_retx_bytes", "sample_interval_secs", "guar_rate_fails")
#: States of a period table, and the steps that may follow each ('': none was recorded).
NEXT_STATES = {"": "nc", "n": "c", "c": "rf", "r": "l", "l": "def", "f": "c", "d": "l", "e": "l"}
DIMENSIONS = ("device_id", "ud_class_id", "src_ip", "dst_ip", "vlan_id", "tos", "service_id", "ftype_num")


@dataclass(frozen=True)
class Bridges:
    """Dimension tables of the class facts."""

    classes: DataFrame
    group_devices: DataFrame
    dev_classes: DataFrame
    site_classes: DataFrame
    sites: DataFrame


def rollup_facts(raw: DataFrame, grain: str, keys: Sequence[str] = ("device_id", "class_id")) -> DataFrame:
    """Roll raw class facts up to 'hour', 'day' or 'month' periods."""
    start = F.date_trunc(grain, "datetime").cast("timestamp_ntz")
    sums = [F.sum(c).alias(c) for c in SUMS]
    rolled = raw.groupBy(start.alias("datetime"), *keys).agg(*sums, F.max("peak_bps").alias("peak_bps"))
    hours = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("datetime"))
    return rolled.withColumn("grain", F.lit(grain)).withColumn("period_id", (hours + 1).cast("long"))


def period_stats(facts: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Ledger line per period: rows and the exact distinct count of each dimension, from one scan.

    Every row gives a cell for each dimension and one for itself; equal cells are combined within the task.
    """
    row = facts.where("period_id IS NOT NULL").withColumn("_row", F.lit(None).cast("string"))
    each = cells(row, ["_row", *dimensions], "period_id", "datetime")
    combined = each.groupBy("period_id", "column_name", "value").agg(
        F.count("*").alias("_times"), F.min("datetime").alias("_start")
    )
    counts = [F.count(F.when(F.col("column_name") == c, F.col("value"))).alias(f"nd_{c}") for c in dimensions]
    return combined.groupBy("period_id").agg(
        F.min("_start").alias("start_time"),
        F.sum(F.when(F.col("column_name") == "_row", F.col("_times"))).alias("roll_rows"),
        *counts,
    )


def rollup_state(expected: DataFrame, stats: DataFrame) -> DataFrame:
    """State of each expected period table: 'd' rolled up, 'e' empty, 'n' not yet seen."""
    joined = expected.join(stats, "period_id", "left")
    state = F.when(F.col("roll_rows").isNull(), "n").when(F.col("roll_rows") == 0, "e").otherwise("d")
    return joined.select("period_id", state.alias("state"), F.coalesce("roll_rows", F.lit(0)).alias("roll_rows"))


def rollup_ledger(expected: DataFrame, steps: DataFrame) -> DataFrame:
    """State of each expected period from the steps recorded of it, with the seconds that copy and rollup took.

    ``steps`` holds (period_id, at, state, roll_rows): new, copy, ready, rollup and then done, empty or failure; a
    failure may be copied again, and a done or empty period may be rolled up once more. A step that the state recorded
    before it doesn't allow counts as ``illegal`` and doesn't become the state. Without steps a period is new. A rollup
    that ended without rows is empty, whatever the step says.
    """
    kept = expected.select("period_id").distinct()
    order = Window.partitionBy("period_id").orderBy("at", "state")  # the few steps of one period
    before, since = F.lag("state", 1, "").over(order), F.lag("at").over(order)
    told = steps.join(kept, "period_id", "left_semi").withColumns({"_before": before, "_since": since})
    legal = F.concat("_before", "state").isin([a + b for a, after in NEXT_STATES.items() for b in after])
    seconds = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("_since").cast("timestamp"))
    took = F.floor(seconds / 1_000_000)
    told = told.withColumns({"_legal": legal, "_took": took})
    ended = F.col("_legal") & (F.col("_before") == "l")
    folded = told.groupBy("period_id").agg(
        F.max_by("state", F.when(F.col("_legal"), F.struct("at", "state"))).alias("_state"),
        F.sum(F.when(F.col("_legal") & (F.col("_before") == "c"), F.col("_took"))).alias("copy_time"),
        F.sum(F.when(ended, F.col("_took"))).alias("rollup_time"),
        F.max_by(F.coalesce("roll_rows", F.lit(0)), F.when(ended, F.struct("at", "state"))).alias("roll_rows"),
        F.count_if(~F.col("_legal")).alias("illegal"),
    )
    rows = F.coalesce("roll_rows", F.lit(0)).cast("long")
    state = F.when(F.col("_state").isin("d", "e"), F.when(rows > 0, "d").otherwise("e")).otherwise(F.coalesce("_state", F.lit("n")))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("copy_time", "rollup_time", "illegal")}
    return kept.join(folded, "period_id", "left").select("period_id", state.alias("state"), *zero.values(), rows.alias("roll_rows"))


def _floor(moment: dt.datetime, grain: str) -> dt.datetime:
    if grain == "month":
        return dt.datetime(moment.year, moment.month, 1)
    return dt.datetime(moment.year, moment.month, moment.day, moment.hour if grain == "hour" else 0)


def _ceiling(moment: dt.datetime, grain: str) -> dt.datetime:
    below = _floor(moment, grain)
    if below == moment:
        return moment
    step = {"month": dt.timedelta(days=31), "day": dt.timedelta(days=1), "hour": dt.timedelta(hours=1)}[grain]
    return _floor(below + step, grain)


def covering(start: dt.datetime, end: dt.datetime, grains: Sequence[str]) -> Column:
    """Rows that cover [start, end) once: whole coarse periods, finer grains for the edges.

    ``grains`` run from coarse to fine and end with the one that has all the rest.
    """
    grain, *finer = grains
    if start >= end:
        return F.lit(False)
    if not finer:
        return period(grain) & within("datetime", start, end)
    first, last = _ceiling(start, grain), _floor(end, grain)
    if first >= last:
        return covering(start, end, finer)
    whole = period(grain) & within("datetime", first, last)
    return whole | covering(start, first, finer) | covering(last, end, finer)


def in_periods(facts: DataFrame, start: dt.datetime, end: dt.datetime, grain: str | Sequence[str]) -> DataFrame:
    """Facts of one grain in [start, end), or of several that cover it together."""
    if end < start:
        raise ValueError("end is before start")
    return facts.where(covering(start, end, [grain] if isinstance(grain, str) else grain))


def _reduced(facts: DataFrame, *keys: str) -> DataFrame:
    """Sums per key; of rows that were reduced before, with their numbers of facts."""
    number = F.sum("fact_rows") if "fact_rows" in facts.columns else F.count("*")
    return facts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("peak_bps").alias("peak_bps"), number.alias("fact_rows")
    )


def device_class_timeseries(
    facts: DataFrame,
    classes: DataFrame,
    devices: DataFrame,
    group_devices: DataFrame,
    *,
    device_id: int,
    is_group: bool,
    class_id: int,
    start: dt.datetime,
    end: dt.datetime,
    grain: str,
) -> DataFrame:
    """Average and peak rate of one class over time, for a device or a device group."""
    chosen = in_periods(facts, start, end, grain).where(F.col("class_id") == class_id)
    known = classes.where(F.col("class_id") == class_id)
    if is_group:
        owners = group_devices.where(F.col("group_id") == device_id).select("device_id")
        rows = chosen.join(owners, "device_id")
    else:
        owners = devices.where(F.col("device_id") == device_id).select("device_id")
        rows = chosen.where(F.col("device_id") == device_id).join(owners, "device_id", "left_semi")
    rows = rows.join(known.select("class_id"), "class_id", "left_semi")
    return (
        rows.groupBy(F.col("datetime").alias("start_time"))
        .agg(
            bit_rate(F.sum("bytes"), F.sum("sample_interval_secs")).cast("decimal(14,2)").alias("avg_rate"),
            F.max("peak_bps").alias("peak_rate"),
        )
        .orderBy("start_time")
    )


def _by_site(facts: DataFrame, dims: Bridges, group_id: int, start, end, grain: str) -> DataFrame:
    """Measures per (datetime, site) over leaf classes, of one device group (0: all).

    Facts are summed by what the bridge asks of them before they meet it, and once more after: sums and maxima
    come out the same, and a class of many sites repeats sums, not facts.
    """
    bridge = dims.site_classes.select("class_id", "site_id").join(
        dims.classes.where(leaf()).select("class_id"), "class_id"
    )
    keys = ["class_id"]
    if group_id > 0:
        members = dims.group_devices.where(F.col("group_id") == group_id).select("device_id")
        bridge = dims.dev_classes.select("class_id", "device_id").join(members, "device_id").join(bridge, "class_id")
        keys = ["class_id", "device_id"]
    rows = _reduced(in_periods(facts, start, end, grain), "datetime", *keys)
    return _reduced(rows.join(cut_lineage(bridge, "bridge"), keys), "datetime", "site_id")


def _across_periods(rows: DataFrame, key: str, extra: Sequence[Column], weighted: bool) -> DataFrame:
    """Sums, means and maxima over periods per ``key``, and one line for the grand total.

    The mean of a rate is the plain mean of the period rates unless ``weighted``.
    """
    if weighted:
        eff = efficiency(F.sum("bytes"), F.sum("tcp_retx_bytes"))
        rate = bit_rate(F.sum("bytes"), F.sum("sample_interval_secs"))
    else:
        eff = F.avg(efficiency(F.col("bytes"), F.col("tcp_retx_bytes")))
        rate = F.avg(bit_rate(F.col("bytes"), F.col("sample_interval_secs")))
    return rows.rollup(key).agg(
        F.grouping(key).alias("_total"),
        F.sum("bytes").alias("bytes"),
        F.sum("pkts").alias("pkts"),
        eff.cast("decimal(5,2)").alias("efficiency_level"),
        rate.cast("decimal(14,2)").alias("avg_rate"),
        F.max("peak_bps").alias("peak_rate"),
        *extra,
    )


def _merge_equal_periods(rows: DataFrame) -> DataFrame:
    """Drop a period's line when another period of the same key has equal measures."""
    return rows.drop("datetime", "fact_rows").distinct()


def _top_with_total(rolled: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """Top n lines with the total beside each; the total line rides along as line n+1."""
    is_total = F.col("_total") == 1
    few = rolled.orderBy(F.col("_total").desc(), F.col(measure).desc(), key).limit(n + 1)
    total = F.max(F.when(is_total, F.col(measure))).over(Window.partitionBy())  # n + 1 rows at most
    return few.withColumn("total", F.coalesce(total, F.lit(0))).where("_total = 0")


def top_n_sites(
    facts: DataFrame,
    dims: Bridges,
    *,
    group_id: int,
    measure: str,
    start: dt.datetime,
    end: dt.datetime,
    n: int,
    grain: str,
    weighted: bool = False,
    distinct_periods: bool = False,
) -> DataFrame:
    """Top n sites of a device group by bytes or packets, with the grand total.

    ``distinct_periods`` counts periods with equal measures once, as a UNION of the
    period results does.
    """
    rows = _by_site(facts, dims, group_id, start, end, grain)
    names = dims.sites.select("site_id", F.ltrim("name").alias("site_name"), F.lit(True).alias("_named"))
    fails = [F.sum("guar_rate_fails").alias("guar_rate_fails")]
    if not distinct_periods:
        rolled = _across_periods(rows, "site_id", fails, weighted)
    else:
        totals = rows.groupBy("datetime").agg(F.sum(measure).alias("_b")).select("_b").distinct()
        whole = totals.agg(F.sum("_b").alias(measure), F.lit(1).alias("_total"))
        merged = _across_periods(_merge_equal_periods(rows), "site_id", fails, weighted)
        rolled = merged.where("_total = 0").unionByName(whole, allowMissingColumns=True)
    is_total = F.col("_total") == 1
    named = rolled.where(is_total | (F.col(measure) > 0)).join(names, "site_id", "left")
    return _top_with_total(named.where(is_total | F.col("_named")), "site_id", measure, n).select(
        "total", "site_id", "site_name", "bytes", "pkts", "efficiency_level", "avg_rate", "peak_rate", "guar_rate_fails"
    )


def top_n_sites_timeseries(
    facts: DataFrame,
    dims: Bridges,
    *,
    group_id: int,
    measure: str,
    start: dt.datetime,
    end: dt.datetime,
    n: int,
    grain: str,
) -> DataFrame:
    """Rate over time of the top n sites, from one pass over the facts.

    Every line of a period carries its site's sum, and sites are ranked by it. The limit on the rank holds in each task before
    the lines meet, so that no more than the periods of n sites come from any of them.
    """
    rows = _by_site(facts, dims, group_id, start, end, grain)
    whole = F.sum(measure).over(Window.partitionBy("site_id"))  # a line for each period
    names = dims.sites.select("site_id", F.ltrim("name").alias("site_name"))
    named = rows.withColumn("_m", whole).where("_m > 0").join(names, "site_id")
    place = F.dense_rank().over(Window.orderBy(F.col("_m").desc(), "site_id"))
    return named.withColumn("ord_num", place).where(F.col("ord_num") <= n).select(
        "ord_num",
        "site_id",
        "site_name",
        F.col("datetime").alias("start_time"),
        bit_rate(F.col("bytes"), F.col("sample_interval_secs")).cast("decimal(14,2)").alias("avg_rate"),
    ).orderBy("ord_num", "start_time")


def with_partition_use(
    rows: DataFrame, part_facts: DataFrame, partitions: DataFrame, repeat_rows: bool = False
) -> DataFrame:
    """Add part_size and part_bytes of the partition whose path is the class path.

    ``partitions`` should hold the wanted paths only. Partition facts are summed per (period, device, path) first. ``repeat_rows`` gives the
    sums of the plain join instead, where each side repeats once per row of the other.
    """
    use = (
        part_facts.join(partitions.select("part_id", "path"), "part_id")
        .groupBy("datetime", "device_id", "path")
        .agg(F.sum("part_size_bps").alias("part_size"), F.sum("bytes").alias("part_bytes"), F.count("*").alias("_parts"))
    )
    joined = rows.join(use, ["datetime", "device_id", "path"], "left")
    if repeat_rows:
        times = F.coalesce("_parts", F.lit(1))
        joined = joined.withColumns(
            {
                **{c: F.col(c) * times for c in SUMS},
                "part_size": F.col("part_size") * F.col("fact_rows"),
                "part_bytes": F.col("part_bytes") * F.col("fact_rows"),
            }
        )
    return joined.drop("_parts")


def top_n_child_classes(
    facts: DataFrame,
    part_facts: DataFrame,
    partitions: DataFrame,
    dims: Bridges,
    *,
    parent_path: str,
    group_id: int,
    measure: str,
    start: dt.datetime,
    end: dt.datetime,
    n: int,
    grain: str,
    weighted: bool = False,
    repeat_partitions: bool = False,
) -> DataFrame:
    """Top n immediate child classes of a class path, with partition size and use."""
    children = children_of(dims.classes, parent_path).select("class_id", F.col("name").alias("class_name"), "path")
    group = dims.group_devices.where(F.col("group_id") == group_id).select("device_id")
    rows = _reduced(in_periods(facts, start, end, grain), "datetime", "device_id", "class_id").join(children, "class_id")
    rows = _reduced(rows.join(group, "device_id"), "datetime", "device_id", "class_id", "class_name", "path")
    wanted = partitions.join(children.select("path").distinct(), "path", "left_semi")
    used = with_partition_use(rows, in_periods(part_facts, start, end, grain), wanted, repeat_partitions)
    per = used.groupBy("datetime", "class_id", "class_name").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.max("peak_bps").alias("peak_bps"),
        F.sum("part_size").alias("part_size"),
        F.sum("part_bytes").alias("part_bytes"),
    )
    extra = [
        F.max("class_name").alias("class_name"),
        F.coalesce(F.sum("part_size"), F.lit(0)).alias("part_size"),
        F.coalesce(F.avg(ratio(8 * F.col("part_bytes"), F.col("part_size"))), F.lit(0))
        .cast("decimal(14,2)")
        .alias("part_utilization"),
    ]
    rolled = _across_periods(per, "class_id", extra, weighted)
    return _top_with_total(rolled, "class_id", measure, n).select(
        "total",
        "class_id",
        "class_name",
        "bytes",
        "pkts",
        "efficiency_level",
        "part_size",
        "part_utilization",
        "avg_rate",
        "peak_rate",
    )


def top_n_flow_details(
    flows: DataFrame,
    *,
    flow_type: str,
    measure: str,
    value: str,
    start: dt.datetime,
    end: dt.datetime,
    grain: str,
    group_devices: DataFrame | None = None,
    dev_classes: DataFrame | None = None,
    owner_classes: DataFrame | None = None,
    services: DataFrame | None = None,
    group_id: int = 0,
    site_id: int = 0,
    application_id: int = 0,
    class_id: int = 0,
    netflow: bool = False,
    binary_ip: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Peers of one talker, listener, VLAN, DSCP value or service, largest first.

    ``owner_classes`` is (site_id, class_id), (application_id, class_id) or (class_id), as
    the chosen filter needs. Flow, response-time and server-time figures come out of one
    conditional aggregation. A bridge that matches a row several times counts it so often. ``limit``
    keeps the largest peers only; without it all are returned. Devices count as the bridges name
    them, whether or not a device table lists them.
    """
    field, peer = flow_fields(flow_type, measure, netflow=netflow, application_id=application_id, class_id=class_id)
    rows = in_periods(flows, start, end, grain)
    if flow_type == "service":
        wanted = services.where(F.col("name") == value).select("ord_id").scalar()
    elif binary_ip and field.endswith("_ip"):
        wanted = ipv4_to_binary(F.lit(value))
    else:
        wanted = F.lit(value).cast(flows.schema[field].dataType)
    entity = ipv4_to_text(peer) if binary_ip else F.col(peer)
    rtm, pet = F.col("ftype_num") == RTM_FLOW, F.col("ftype_num") == PET_FLOW
    figures = {
        "bytes": F.col("bytes"),
        "pkts": F.col("pkts"),
        "flows": F.col("flow_num"),
        "retrans": F.lit(0) if netflow else F.col("retrans_bytes"),
        "rtm_total": F.when(rtm, F.col("measure_1")),
        "rtm_server": F.when(rtm, F.col("measure_2")),
        "rtm_trans": F.when(rtm, F.col("measure_3")),
        "pet_server": F.when(pet, F.col("measure_2")),
        "pet_client": F.when(pet, F.col("measure_3")),
    }
    rows = rows.where(F.col(field) == wanted)
    times = F.lit(1)
    if group_id > 0:
        members = group_devices.where(F.col("group_id") == group_id)
        counted = members.groupBy("device_id").agg(F.count("*").alias("_members"))
        rows = rows.join(counted, "device_id")
        times = times * F.col("_members")
    owner = None if netflow else _owner_filter(owner_classes, site_id, application_id, class_id)
    if owner is not None:
        bridge = dev_classes.select("device_id", "ud_class_id", "class_id").join(owner, "class_id")
        keys = ["device_id", "ud_class_id"]
        counted = bridge.groupBy(*keys).agg(F.count("*").alias("_owners"))
        rows = rows.join(cut_lineage(counted, "bridge"), keys)
        times = times * F.col("_owners")
    sums = rows.groupBy(entity.alias("entity")).agg(*[F.sum(c * times).alias(n) for n, c in figures.items()])
    zero = F.lit(0)
    extra = {n: zero.cast("long") if netflow else F.coalesce(n, zero) for n in list(figures)[4:]}
    full = sums.withColumns(extra).select(
        "entity",
        "bytes",
        "pkts",
        "flows",
        efficiency(F.col("bytes"), F.col("retrans")).cast("decimal(5,2)").alias("efficiency_pct"),
        mean_delay(F.col("rtm_total"), F.col("rtm_trans")).cast("decimal(14,2)").alias("avg_total_delay"),
        mean_delay(F.col("rtm_server"), F.col("rtm_trans")).cast("decimal(14,2)").alias("avg_server_delay"),
        F.col("rtm_trans").alias("total_rtm_trans"),
        "pet_server",
        "pet_client",
    )
    return top(full, measure, limit, "entity")


def _owner_filter(owners: DataFrame | None, site_id: int, application_id: int, class_id: int) -> DataFrame | None:
    """Classes of the chosen site, application or class; None for no (or a mixed) choice."""
    if site_id > 0 and application_id == 0:
        test = F.col("site_id") == site_id
    elif application_id > 0 and site_id == 0:
        test = F.col("application_id") == application_id
    elif site_id == 0 and application_id == 0 and class_id > 0:
        test = F.col("class_id") == class_id
    else:
        return None
    return owners.where(test).select("class_id")
