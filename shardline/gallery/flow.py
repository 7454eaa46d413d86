"""Network-flow reports on line items (months as periods) and events (raw rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from shardline.functions import predicates as P
from shardline.functions.scalars import mean_delay
from shardline.gallery.base import Tables, div, fixed, mean, query
from shardline.operators import aggregates as A
from shardline.operators import hierarchy as H
from shardline.operators.ordered import top
from shardline.operators.sets import union_all, union_distinct
from shardline.plans import flow as flow_plans

START, END = dt.datetime(1995, 1, 1), dt.datetime(2002, 1, 1)
SPAN = "datetime >= TIMESTAMP '1995-01-01' AND datetime < TIMESTAMP '2002-01-01'"
GROUP = 2


def bridges(t: Tables) -> flow_plans.Bridges:
    return flow_plans.Bridges(t.classes, t.group_devices, t.dev_classes, t.site_classes, t.sites)


def _site_rows(group: bool = True) -> str:
    joins = f"""
      JOIN x_dev_classes d ON d.class_id = f.class_id AND d.device_id = f.device_id
      JOIN x_group_devices gd ON gd.device_id = d.device_id AND gd.group_id = {GROUP}"""
    return f"""
    per AS (
      SELECT f.datetime, sc.site_id, SUM(bytes) AS b, SUM(pkts) AS p, SUM(tcp_retx_bytes) AS r,
             SUM(sample_interval_secs) AS s, MAX(peak_bps) AS k, SUM(guar_rate_fails) AS g
      FROM x_class_facts f
      JOIN x_classes c ON f.class_id = c.class_id AND c.l_idx = c.r_idx - 1 {joins if group else ""}
      JOIN x_site_classes sc ON sc.class_id = f.class_id
      WHERE f.grain = 'month' AND f.period_id > 0 AND {SPAN}
      GROUP BY f.datetime, sc.site_id)"""


EFF, RATE = div("100 * (b - r)", "b"), div("8 * b", "s")


def _sites_sql(n: int, total: str, source: str = "per", weighted: bool = False, group: bool = True) -> str:
    eff = fixed(div("100 * (SUM(b) - SUM(r))", "SUM(b)"), 6, 2) if weighted else mean(f"SUM({EFF})", "COUNT(*)", 6, 2)
    rate = fixed(div("8 * SUM(b)", "SUM(s)"), 6, 2) if weighted else mean(f"SUM({RATE})", "COUNT(*)", 6, 2)
    return f"""
    WITH {_site_rows(group)}
    SELECT CAST(({total}) AS BIGINT) AS total, q.site_id, LTRIM(st.name) AS site_name,
           CAST(SUM(b) AS BIGINT) AS bytes, CAST(SUM(p) AS BIGINT) AS pkts, {eff} AS efficiency_level,
           {rate} AS avg_rate, MAX(k) AS peak_rate, CAST(SUM(g) AS BIGINT) AS guar_rate_fails
    FROM {source} q JOIN x_sites st ON st.site_id = q.site_id
    GROUP BY q.site_id, st.name HAVING SUM(b) > 0
    ORDER BY SUM(b) DESC, q.site_id LIMIT {n}"""


def _sites(t: Tables, n: int = 10, group: int = GROUP, **options):
    return flow_plans.top_n_sites(
        t.class_facts, bridges(t), group_id=group, measure="bytes", start=START, end=END, n=n, grain="month", **options
    )


query("r3_top_n_sites", _sites_sql(10, "SELECT SUM(b) FROM per"))(lambda t: _sites(t))
query("r3_top_n_sites_all_groups", _sites_sql(5, "SELECT SUM(b) FROM per", group=False))(lambda t: _sites(t, 5, 0))
query("a3_weighted_mean_over_periods", _sites_sql(25, "SELECT SUM(b) FROM per", weighted=True))(
    lambda t: _sites(t, 25, weighted=True)
)
query(
    "u1_union_distinct_periods",
    _sites_sql(
        10,
        "SELECT SUM(x) FROM (SELECT DISTINCT SUM(b) AS x FROM per GROUP BY datetime)",
        "(SELECT DISTINCT site_id, b, p, r, s, k, g FROM per)",
    ),
)(lambda t: _sites(t, distinct_periods=True))


@query(
    "r4_top_n_sites_timeseries",
    f"""
    WITH {_site_rows()},
    best AS (
      SELECT per.site_id, LTRIM(st.name) AS site_name, SUM(b) AS m,
             ROW_NUMBER() OVER (ORDER BY SUM(b) DESC, per.site_id) AS ord_num
      FROM per JOIN x_sites st ON st.site_id = per.site_id
      GROUP BY per.site_id, st.name HAVING SUM(b) > 0)
    SELECT CAST(ord_num AS INT) AS ord_num, best.site_id, site_name, datetime AS start_time, {fixed(RATE, 6, 2)} AS avg_rate
    FROM best JOIN per ON per.site_id = best.site_id WHERE ord_num <= 8""",
)
def _(t):
    return flow_plans.top_n_sites_timeseries(
        t.class_facts, bridges(t), group_id=GROUP, measure="bytes", start=START, end=END, n=8, grain="month"
    )


def _class_series_sql(test: str) -> str:
    return f"""
    SELECT datetime AS start_time, {fixed(div("8 * SUM(bytes)", "SUM(sample_interval_secs)"), 6, 2)} AS avg_rate,
           MAX(peak_bps) AS peak_rate
    FROM x_class_facts f WHERE {SPAN} AND period_id > 0 AND class_id = 7 AND {test}
      AND EXISTS (SELECT 1 FROM x_classes c WHERE c.class_id = f.class_id)
    GROUP BY datetime"""


@query(
    "r1_device_class_timeseries_group",
    _class_series_sql(f"device_id IN (SELECT device_id FROM x_group_devices WHERE group_id = {GROUP})"),
)
def _(t):
    return flow_plans.device_class_timeseries(
        t.class_facts, t.classes, t.devices, t.group_devices, device_id=GROUP, is_group=True, class_id=7,
        start=START, end=END, grain="month",
    )


@query(
    "r1_device_class_timeseries_device",
    f"""SELECT datetime AS start_time, {fixed(div("8 * SUM(bytes)", "SUM(sample_interval_secs)"), 6, 2)} AS avg_rate,
               MAX(peak_bps) AS peak_rate
        FROM x_raw_facts WHERE device_id = 5 AND class_id = 0 GROUP BY datetime""",
)
def _(t):
    facts = t.raw_facts
    devices = facts.select("device_id").distinct()
    classes = facts.select("class_id").distinct()
    return flow_plans.device_class_timeseries(
        facts, classes, devices, t.group_devices, device_id=5, is_group=False, class_id=0,
        start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 2, 1), grain="raw",
    )


def _child_sql(repeat: bool) -> str:
    many = "COALESCE(pr.n, 1)" if repeat else "1"
    rows = "f.n" if repeat else "1"
    return f"""
    WITH f AS (
      SELECT datetime, device_id, class_id, SUM(bytes) AS b, SUM(pkts) AS p, SUM(tcp_retx_bytes) AS r,
             SUM(sample_interval_secs) AS s, MAX(peak_bps) AS k, COUNT(*) AS n
      FROM x_class_facts WHERE {SPAN} AND period_id > 0 GROUP BY datetime, device_id, class_id),
    pr AS (
      SELECT datetime, device_id, path, SUM(part_size_bps) AS size, SUM(bytes) AS use, COUNT(*) AS n
      FROM x_part_facts JOIN x_partitions USING (part_id) WHERE {SPAN} AND period_id > 0
      GROUP BY datetime, device_id, path),
    per AS (
      SELECT f.datetime, cl.class_id, cl.name, SUM(f.b * {many}) AS b, SUM(f.p * {many}) AS p, SUM(f.r * {many}) AS r,
             SUM(f.s * {many}) AS s, MAX(f.k) AS k, SUM(pr.size * {rows}) AS size, SUM(pr.use * {rows}) AS use
      FROM f JOIN x_classes cl ON cl.class_id = f.class_id
        AND cl.parent_id = (SELECT class_id FROM x_classes WHERE path = '/Size7')
      JOIN x_group_devices gd ON gd.device_id = f.device_id AND gd.group_id = {GROUP}
      LEFT JOIN pr ON pr.datetime = f.datetime AND pr.device_id = f.device_id AND pr.path = cl.path
      GROUP BY f.datetime, cl.class_id, cl.name)
    SELECT CAST((SELECT SUM(b) FROM per) AS BIGINT) AS total, class_id, name AS class_name, CAST(SUM(b) AS BIGINT) AS bytes,
           CAST(SUM(p) AS BIGINT) AS pkts, {mean(f"SUM({EFF})", "COUNT(*)", 6, 2)} AS efficiency_level,
           CAST(COALESCE(SUM(size), 0) AS BIGINT) AS part_size,
           CASE WHEN COUNT(size) = 0 THEN 0.0
                ELSE {mean(f"SUM(CASE WHEN size IS NOT NULL THEN {div('8 * use', 'size')} END)", "CAST(COUNT(size) AS HUGEINT)", 6, 2)} END AS part_utilization,
           {mean(f"SUM({RATE})", "COUNT(*)", 6, 2)} AS avg_rate, MAX(k) AS peak_rate
    FROM per GROUP BY class_id, name ORDER BY SUM(b) DESC, class_id LIMIT 10"""


def _children(t: Tables, repeat: bool):
    return flow_plans.top_n_child_classes(
        t.class_facts, t.part_facts, t.partitions, bridges(t), parent_path="/Size7", group_id=GROUP, measure="bytes",
        start=START, end=END, n=10, grain="month", repeat_partitions=repeat,
    )


UNKNOWN_PATH = "SELECT class_id, path FROM x_classes WHERE parent_id IN (SELECT class_id FROM x_classes WHERE path = '/No such path')"
query("r2_top_n_child_classes", _child_sql(False))(lambda t: _children(t, False))
query("j15_part_path_join_repeating_rows", _child_sql(True))(lambda t: _children(t, True))
query("f10_unknown_class_path", UNKNOWN_PATH)(
    lambda t: H.children_of(t.classes, "/No such path").select("class_id", "path")
)


def _flow_sql(field: str, value: str, measure: str = "bytes", joins: str = "", netflow: bool = False, limit: int = 5000):
    def kind(k: int, m: str) -> str:
        return "CAST(0 AS BIGINT)" if netflow else f"CAST(COALESCE(SUM(CASE WHEN ftype_num = {k} THEN {m} END), 0) AS BIGINT)"

    def delay(m: str) -> str:
        return f"CASE WHEN tr = 0 THEN 0 ELSE {fixed(div(m, 'tr', 8), 8, 2)} END"

    return f"""
    WITH q AS (
      SELECT {"dst_ip" if field == "src_ip" else "src_ip"} AS entity, CAST(SUM(bytes) AS BIGINT) AS bytes,
             CAST(SUM(pkts) AS BIGINT) AS pkts, CAST(SUM(flow_num) AS BIGINT) AS flows,
             {"0" if netflow else "SUM(retrans_bytes)"} AS rb, {kind(4, "measure_1")} AS td, {kind(4, "measure_2")} AS sd,
             {kind(4, "measure_3")} AS tr, {kind(5, "measure_2")} AS pet_server, {kind(5, "measure_3")} AS pet_client
      FROM x_flows f {joins} WHERE {SPAN} AND {field} = {value} GROUP BY 1)
    SELECT entity, bytes, pkts, flows, {fixed(div("100 * (bytes - rb)", "bytes"), 6, 2)} AS efficiency_pct,
           {delay("td")} AS avg_total_delay, {delay("sd")} AS avg_server_delay, tr AS total_rtm_trans, pet_server, pet_client
    FROM q ORDER BY {measure} DESC, entity LIMIT {limit}"""


def _flow(t: Tables, flow_type: str, value: str, measure: str = "bytes", **options):
    return flow_plans.top_n_flow_details(
        t.flows, flow_type=flow_type, measure=measure, value=value, start=START, end=END, grain="month",
        services=t.services, group_devices=t.group_devices, dev_classes=t.dev_classes, **options,
    )


GROUP_JOIN = f"JOIN x_group_devices gd ON gd.device_id = f.device_id AND gd.group_id = {GROUP}"
SITE_JOIN = """JOIN x_dev_classes dc ON dc.device_id = f.device_id AND dc.ud_class_id = f.ud_class_id
  JOIN x_site_classes sc ON sc.class_id = dc.class_id AND sc.site_id = 3"""
query("r5_top_n_flow_details_talker", _flow_sql("src_ip", "'10.0.3.1'", joins=GROUP_JOIN))(
    lambda t: _flow(t, "talker", "10.0.3.1", group_id=GROUP)
)
query("r5_top_n_flow_details_listener_of_site", _flow_sql("dst_ip", "'172.16.7.3'", "pkts", SITE_JOIN))(
    lambda t: _flow(t, "listener", "172.16.7.3", "pkts", site_id=3, owner_classes=t.site_classes)
)
query("r5_top_n_flow_details_vlan_netflow", _flow_sql("vlan_id", "4", netflow=True))(
    lambda t: _flow(t, "vlan", "4", netflow=True)
)
query("f9_dimension_dispatch_dscp", _flow_sql("tos", "5", "pkts"))(lambda t: _flow(t, "dscp", "5", "pkts"))
query(
    "f10_service_name_lookup",
    _flow_sql("service_id", "(SELECT ord_id FROM x_services WHERE name = 'ASIA')"),
)(lambda t: _flow(t, "service", "ASIA"))
query("k2_entity_cap", _flow_sql("vlan_id", "4", limit=20))(lambda t: _flow(t, "vlan", "4", limit=20))


@query(
    "a1_rate_peak_ratio",
    f"""SELECT device_id, {fixed(div("8 * SUM(bytes)", "SUM(sample_interval_secs)"), 6, 2)} AS avg_rate, MAX(peak_bps) AS peak_rate
        FROM x_class_facts GROUP BY device_id""",
)
def _(t):
    return t.class_facts.groupBy("device_id").agg(
        A.bit_rate(F.sum("bytes"), F.sum("sample_interval_secs")).cast("decimal(14,2)").alias("avg_rate"),
        F.max("peak_bps").alias("peak_rate"),
    )


@query(
    "a2_efficiency_percent",
    f"""SELECT class_id, {fixed(div("100 * (SUM(bytes) - SUM(tcp_retx_bytes))", "SUM(bytes)"), 6, 2)} AS efficiency
        FROM x_class_facts GROUP BY class_id""",
)
def _(t):
    return t.class_facts.groupBy("class_id").agg(
        A.efficiency(F.sum("bytes"), F.sum("tcp_retx_bytes")).cast("decimal(5,2)").alias("efficiency")
    )


@query(
    "a3_two_level_aggregate",
    f"""WITH per AS (SELECT datetime, device_id, SUM(bytes) AS b, SUM(sample_interval_secs) AS s, MAX(peak_bps) AS k
                     FROM x_class_facts GROUP BY datetime, device_id)
        SELECT device_id, CAST(SUM(b) AS BIGINT) AS bytes, {mean(f"SUM({RATE})", "COUNT(*)", 6, 2)} AS avg_rate, MAX(k) AS peak_rate
        FROM per GROUP BY device_id""",
)
def _(t):
    per = t.class_facts.groupBy("datetime", "device_id").agg(
        F.sum("bytes").alias("b"), F.sum("sample_interval_secs").alias("s"), F.max("peak_bps").alias("k")
    )
    rate = A.bit_rate(F.col("b"), F.col("s"))
    return per.groupBy("device_id").agg(
        F.sum("b").alias("bytes"), F.avg(rate).cast("decimal(14,2)").alias("avg_rate"), F.max("k").alias("peak_rate")
    )


@query(
    "a4_grand_total_beside_top_n",
    """SELECT CAST((SELECT SUM(bytes) FROM x_class_facts) AS BIGINT) AS total, device_id, CAST(SUM(bytes) AS BIGINT) AS bytes
       FROM x_class_facts GROUP BY device_id ORDER BY SUM(bytes) DESC, device_id LIMIT 5""",
)
def _(t):
    facts = t.class_facts
    per = facts.groupBy("device_id").agg(F.sum("bytes").alias("bytes"))
    return top(per, "bytes", 5, "device_id").withColumn("total", facts.agg(F.sum("bytes")).scalar())


@query(
    "a5_having_positive_sum",
    "SELECT class_id, CAST(SUM(tcp_retx_bytes) AS BIGINT) AS resent FROM x_class_facts GROUP BY class_id HAVING SUM(tcp_retx_bytes) > 0",
)
def _(t):
    return t.class_facts.groupBy("class_id").agg(F.sum("tcp_retx_bytes").alias("resent")).where("resent > 0")


@query(
    "a17_flow_count",
    "SELECT dst_ip, COUNT(*) AS flows FROM x_flows GROUP BY dst_ip",
)
def _(t):
    return t.flows.groupBy("dst_ip").agg(F.sum("flow_num").alias("flows"))


@query(
    "a18_rollup_stats_distinct_dimensions",
    """SELECT period_id, MIN(datetime) AS start_time, COUNT(*) AS roll_rows, COUNT(DISTINCT device_id) AS nd_device_id,
              COUNT(DISTINCT ud_class_id) AS nd_ud_class_id, COUNT(DISTINCT src_ip) AS nd_src_ip, COUNT(DISTINCT dst_ip) AS nd_dst_ip,
              COUNT(DISTINCT vlan_id) AS nd_vlan_id, COUNT(DISTINCT tos) AS nd_tos, COUNT(DISTINCT service_id) AS nd_service_id,
              COUNT(DISTINCT ftype_num) AS nd_ftype_num
       FROM x_flows GROUP BY period_id""",
)
def _(t):
    return flow_plans.period_stats(t.flows, flow_plans.DIMENSIONS)


@query(
    "a18_rollup_state_ledger",
    """SELECT p.period_id, CASE WHEN COUNT(f.period_id) = 0 THEN 'n' ELSE 'd' END AS state, COUNT(f.period_id) AS roll_rows
       FROM (SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) * 12 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS period_id FROM orders) p
       LEFT JOIN x_flows f ON f.period_id = p.period_id GROUP BY p.period_id""",
)
def _(t):
    months = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    expected = t.orders.select(months.cast("long").alias("period_id")).distinct()
    return flow_plans.rollup_state(expected, flow_plans.period_stats(t.flows, ["device_id"]))


def _steps(t):
    """What was recorded of each month: every fifth fails, every seventh is ended twice, months without flows have none."""
    months = t.orders.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("period_id")).distinct()
    rows = t.flows.groupBy("period_id").agg(F.count("*").alias("rows"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    done = [("n", 0), ("c", 10), ("r", 15), ("l", 20), ("d", 50)]
    listed = F.when(F.col("period_id") % 5 == 0, _taken([("n", 0), ("c", 10), ("f", 17)])).when(
        F.col("period_id") % 7 == 0, _taken([*done, ("d", 60)])
    ).otherwise(_taken(done))
    seen = months.where("period_id % 11 <> 0").join(rows, "period_id", "left").select("period_id", "rows", F.inline(listed))
    moment = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("second"))
    return months, seen.select("period_id", moment.alias("at"), "state", F.when(F.col("state") == "d", F.col("rows")).alias("roll_rows"))


def _taken(steps):
    return F.array(*(F.struct(F.lit(s).alias("state"), F.lit(at).alias("second")) for s, at in steps))


@query(
    "a18_rollup_ledger_of_steps",
    """SELECT p.period_id, CASE WHEN p.period_id % 11 = 0 THEN 'n' WHEN p.period_id % 5 = 0 THEN 'f' WHEN COUNT(f.period_id) = 0 THEN 'e' ELSE 'd' END AS state,
              CAST(CASE WHEN p.period_id % 11 = 0 THEN 0 WHEN p.period_id % 5 = 0 THEN 7 ELSE 5 END AS BIGINT) AS copy_time,
              CAST(CASE WHEN p.period_id % 11 = 0 OR p.period_id % 5 = 0 THEN 0 ELSE 30 END AS BIGINT) AS rollup_time,
              CAST(CASE WHEN p.period_id % 11 <> 0 AND p.period_id % 5 <> 0 AND p.period_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS illegal,
              CASE WHEN p.period_id % 11 = 0 OR p.period_id % 5 = 0 THEN 0 ELSE COUNT(f.period_id) END AS roll_rows
       FROM (SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) * 12 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS period_id FROM orders) p
       LEFT JOIN x_flows f ON f.period_id = p.period_id GROUP BY p.period_id""",
)
def _(t):
    return flow_plans.rollup_ledger(*_steps(t))


@query(
    "f8_whole_rollup_and_raw_periods",
    """SELECT device_id, SUM(CAST(1 AS BIGINT))::BIGINT AS raw_rows, COUNT(DISTINCT DATE_TRUNC('day', datetime)) AS day_rows
       FROM x_raw_facts GROUP BY device_id""",
)
def _(t):
    raw = t.raw_facts
    days = flow_plans.rollup_facts(raw, "day", ["device_id"])
    cols = ["grain", "period_id", "device_id", "bytes"]
    both = raw.select(*cols).unionByName(days.select(*cols))
    return both.where(P.period("raw") | P.period("day")).groupBy("device_id").agg(
        F.count_if(F.col("grain") == "raw").alias("raw_rows"), F.count_if(F.col("grain") == "day").alias("day_rows")
    )


@query(
    "f8_one_period_of_a_rollup",
    """SELECT device_id, CAST(SUM(bytes) AS BIGINT) AS bytes FROM x_class_facts WHERE period_id = 1996 * 12 + 5 GROUP BY device_id""",
)
def _(t):
    return t.class_facts.where(P.period("month", 1996 * 12 + 5)).groupBy("device_id").agg(F.sum("bytes").alias("bytes"))


@query(
    "f8_range_covered_by_coarse_rollups",
    """SELECT device_id, CAST(SUM(bytes) AS BIGINT) AS bytes, CAST(SUM(pkts) AS BIGINT) AS pkts FROM x_raw_facts
       WHERE datetime >= TIMESTAMP '2024-01-02 05:20:00' AND datetime < TIMESTAMP '2024-01-28 17:45:00' GROUP BY device_id""",
)
def _(t):
    raw = t.raw_facts
    days, hours = (flow_plans.rollup_facts(raw, g).select(*raw.columns) for g in ("day", "hour"))
    stored = raw.unionByName(hours).unionByName(days)
    span = (dt.datetime(2024, 1, 2, 5, 20), dt.datetime(2024, 1, 28, 17, 45))
    chosen = flow_plans.in_periods(stored, *span, ("day", "hour", "raw"))
    return chosen.groupBy("device_id").agg(F.sum("bytes").alias("bytes"), F.sum("pkts").alias("pkts"))


@query(
    "r1_rollup_builder_hourly",
    """SELECT DATE_TRUNC('hour', datetime) AS datetime, device_id, class_id, CAST(SUM(bytes) AS BIGINT) AS bytes,
              CAST(SUM(sample_interval_secs) AS BIGINT) AS sample_interval_secs, MAX(peak_bps) AS peak_bps,
              CAST(DATE_DIFF('hour', TIMESTAMP '1970-01-01', DATE_TRUNC('hour', datetime)) + 1 AS BIGINT) AS period_id
       FROM x_raw_facts GROUP BY 1, 2, 3""",
)
def _(t):
    return flow_plans.rollup_facts(t.raw_facts, "hour").select(
        "datetime", "device_id", "class_id", "bytes", "sample_interval_secs", "peak_bps", "period_id"
    )


@query("f14_leaf_classes", "SELECT class_id, path FROM x_classes WHERE l_idx = r_idx - 1")
def _(t):
    return t.classes.where(P.leaf()).select("class_id", "path")


@query(
    "j1_star_join_through_bridges",
    """SELECT gd.group_id, sc.site_id, COUNT(*) AS n_rows, CAST(SUM(f.bytes) AS BIGINT) AS bytes
       FROM x_class_facts f JOIN x_dev_classes d ON d.device_id = f.device_id AND d.class_id = f.class_id
       JOIN x_group_devices gd ON gd.device_id = f.device_id JOIN x_site_classes sc ON sc.class_id = f.class_id
       GROUP BY 1, 2""",
)
def _(t):
    keyed = t.class_facts.groupBy("device_id", "class_id").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    joined = (
        keyed.join(t.dev_classes, ["device_id", "class_id"])
        .join(t.group_devices, "device_id")
        .join(t.site_classes, "class_id")
    )
    return joined.groupBy("group_id", "site_id").agg(F.sum("n").alias("n_rows"), F.sum("b").alias("bytes"))


@query(
    "k1_top_n_by_measure",
    "SELECT class_id, CAST(SUM(pkts) AS BIGINT) AS pkts FROM x_class_facts GROUP BY class_id ORDER BY SUM(pkts) DESC, class_id LIMIT 12",
)
def _(t):
    return top(t.class_facts.groupBy("class_id").agg(F.sum("pkts").alias("pkts")), "pkts", 12, "class_id")


@query("k3_order_by_measure_then_entity", "SELECT dst_ip, CAST(SUM(bytes) AS BIGINT) AS bytes FROM x_flows GROUP BY dst_ip")
def _(t):
    sums = t.flows.groupBy("dst_ip").agg(F.sum("bytes").alias("bytes"))
    return sums.orderBy(F.col("bytes").desc(), "dst_ip")


@query(
    "u2_union_all_periods",
    """SELECT device_id, CAST(SUM(b) AS BIGINT) AS bytes, COUNT(*) AS parts FROM (
         SELECT device_id, SUM(bytes) AS b FROM x_class_facts WHERE datetime < TIMESTAMP '1998-01-01' GROUP BY device_id
         UNION ALL
         SELECT device_id, SUM(bytes) FROM x_class_facts WHERE datetime >= TIMESTAMP '1998-01-01' GROUP BY device_id)
       GROUP BY device_id""",
)
def _(t):
    facts, cut = t.class_facts, F.lit("1998-01-01").cast("timestamp_ntz")
    parts = [
        facts.where(test).groupBy("device_id").agg(F.sum("bytes").alias("b"))
        for test in (F.col("datetime") < cut, F.col("datetime") >= cut)
    ]
    return union_all(parts).groupBy("device_id").agg(F.sum("b").alias("bytes"), F.count("*").alias("parts"))


@query(
    "w5_ordinal_of_top_entities",
    """SELECT CAST(ROW_NUMBER() OVER (ORDER BY SUM(bytes) DESC, device_id) AS INT) AS ord_num, device_id, CAST(SUM(bytes) AS BIGINT) AS bytes
       FROM x_class_facts GROUP BY device_id ORDER BY 1 LIMIT 15""",
)
def _(t):
    best = top(t.class_facts.groupBy("device_id").agg(F.sum("bytes").alias("bytes")), "bytes", 15, "device_id")
    return best.withColumn("ord_num", F.row_number().over(Window.orderBy(F.col("bytes").desc(), "device_id")))


@query(
    "c13_mean_delay",
    """SELECT src_ip, CASE WHEN SUM(measure_3) = 0 THEN 0 ELSE CAST(CAST(SUM(measure_1) AS BIGINT) AS DOUBLE) / CAST(SUM(measure_3) AS BIGINT) END AS delay
       FROM x_flows GROUP BY src_ip""",
)
def _(t):
    return t.flows.groupBy("src_ip").agg(mean_delay(F.sum("measure_1"), F.sum("measure_3")).alias("delay"))


TREE = """
    WITH RECURSIVE walk AS (
      SELECT store_hierarchy_id AS id, parent_store_hierarchy_id AS parent, 0 AS depth,
             LPAD(CAST(store_hierarchy_id AS VARCHAR), 12, '0') AS path
      FROM x_hierarchy WHERE parent_store_hierarchy_id IS NULL
      UNION ALL
      SELECT h.store_hierarchy_id, h.parent_store_hierarchy_id, depth + 1, path || LPAD(CAST(h.store_hierarchy_id AS VARCHAR), 12, '0')
      FROM x_hierarchy h JOIN walk ON h.parent_store_hierarchy_id = walk.id),
    pre AS (SELECT *, ROW_NUMBER() OVER (ORDER BY path) - 1 AS pos FROM walk),
    sized AS (
      SELECT pre.id, pre.parent, pre.depth, pre.pos,
             COALESCE(LEAD(pos) OVER (ORDER BY pos), 0) AS nxt,
             (SELECT COUNT(*) FROM pre d WHERE d.path >= pre.path AND d.path < pre.path || 'z') AS subtree
      FROM pre)"""


@query(
    "h1_nested_set",
    TREE
    + """
    SELECT id AS node_id, parent AS parent_id, CAST(depth AS INT) AS depth, CAST(2 * pos - depth + 1 AS BIGINT) AS l_idx,
           CAST(2 * pos - depth + 1 + 2 * subtree - 1 AS BIGINT) AS r_idx
    FROM sized""",
)
def _(t):
    edges = t.hierarchy.select(
        F.col("store_hierarchy_id").alias("node_id"), F.col("parent_store_hierarchy_id").alias("parent_id")
    )
    return H.nested_set(edges)


@query(
    "h2_leaf_test_on_nested_set",
    "SELECT store_hierarchy_id AS node_id FROM x_hierarchy h WHERE NOT EXISTS "
    "(SELECT 1 FROM x_hierarchy c WHERE c.parent_store_hierarchy_id = h.store_hierarchy_id)",
)
def _(t):
    edges = t.hierarchy.select(
        F.col("store_hierarchy_id").alias("node_id"), F.col("parent_store_hierarchy_id").alias("parent_id")
    )
    return H.nested_set(edges).where(P.leaf()).select("node_id")


@query(
    "h3_children_by_parent_path",
    "SELECT c.class_id, c.path FROM x_classes c JOIN x_classes p ON p.class_id = c.parent_id WHERE p.path = '/Size11'",
)
def _(t):
    return H.children_of(t.classes, "/Size11").select("class_id", "path")


@query(
    "u1_union_distinct_of_period_rows",
    """SELECT bytes, pkts FROM (SELECT bytes, pkts FROM x_class_facts WHERE datetime < TIMESTAMP '1998-01-01'
       UNION SELECT bytes, pkts FROM x_class_facts WHERE datetime >= TIMESTAMP '1998-01-01')""",
)
def _(t):
    facts, cut = t.class_facts, F.lit("1998-01-01").cast("timestamp_ntz")
    halves = [facts.where(F.col("datetime") < cut), facts.where(F.col("datetime") >= cut)]
    return union_distinct([half.select("bytes", "pkts") for half in halves])
