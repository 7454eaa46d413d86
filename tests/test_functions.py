import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardline.functions import predicates as P
from shardline.functions import scalars as S

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def in_sequence(text, source, target):
    for i in range(len(source) - 1, -1, -1):
        text = text.replace(source[i], target[i] if i < len(target) else "")
    return text


def test_initcap(spark):
    assert one(spark, S.initcap("t"), t="content item build instruction") == "Content Item Build Instruction"


def test_table_alias(spark):
    assert one(spark, S.table_alias("t"), t="content_item_build_instruction") == "cibi"


@pytest.mark.parametrize(
    "source,target",
    [("abc", "xyz"), ("abc", "b"), ("ba", "ab"), ("abcd", "bcda"), ("aab", "xyz"), (f"{ALPHABET} abc", ALPHABET), ("a", "")],
)
def test_translate_equals_replacing_slot_by_slot(spark, source, target):
    text = "A cab backed a bad cadre; aaa bbb ccc"
    assert one(spark, S.translate("t", source, target), t=text) == in_sequence(text, source, target)


def test_paths(spark):
    assert one(spark, S.path_element("t", 2), t="a|b|c") == "b"
    assert one(spark, S.path_element("t", 3), t="a|b") == "b"
    assert one(spark, S.path_element("t", -1), t="a|b|c") == "c"
    assert one(spark, S.path_top("t"), t="a|b") == "a"
    assert one(spark, S.path_top("t"), t="ab") == ""


def test_packed_value(spark):
    text = "~|~mfgname== Acme ~|~brand==B~|~"
    assert one(spark, S.packed_value("t", "mfgname"), t=text) == "Acme"
    assert one(spark, S.packed_value("t", "brand"), t=text) == "B"
    assert one(spark, S.packed_value("t", "color"), t=text) is None


@pytest.mark.parametrize(
    "moment,slot",
    [("10:14:59", "10:00:00"), ("10:15:00", "10:30:00"), ("10:44:59", "10:30:00"), ("23:45:00", "00:00:00")],
)
def test_nearest_half_hour(spark, moment, slot):
    day = dt.datetime.fromisoformat(f"2011-10-31 {moment}")
    got = spark.createDataFrame([(day,)], "t timestamp_ntz").select(S.nearest_half_hour("t").alias("v")).first()["v"]
    assert got.strftime("%H:%M:%S") == slot


def test_ipv4(spark):
    rows = spark.createDataFrame([("75.0.53.208",), ("256.1.1.1",), ("1.2.3",), ("0.0.0.0",), ("a.b.c.d",)], ["ip"])
    packed = rows.select("ip", S.ipv4_to_binary("ip").alias("b")).withColumn("back", S.ipv4_to_text("b"))
    got = {r["ip"]: (bytes(r["b"]) if r["b"] is not None else None, r["back"]) for r in packed.collect()}
    assert got["75.0.53.208"] == (bytes([75, 0, 53, 208]), "75.0.53.208")
    assert got["0.0.0.0"] == (bytes(4), "0.0.0.0")
    assert got["256.1.1.1"] == got["1.2.3"] == got["a.b.c.d"] == (None, None)


def test_fingerprint_tells_null_from_text(spark):
    rows = spark.createDataFrame([(1, None), (2, "NULL"), (3, None)], "id int, a string")
    prints = {r["id"]: r["p"] for r in rows.select("id", S.row_fingerprint(["a"]).alias("p")).collect()}
    assert prints[1] == prints[3] != prints[2]


def test_tracked_columns():
    names = ["account_id", "account_name", "account_name_lower", "modified_dtm", "comments", "status"]
    assert S.tracked_columns(names, ["account_id"]) == ["account_name", "status"]


def test_ratio_guards_zero(spark):
    assert one(spark, S.ratio(F.lit(5), F.lit(0))) == 0
    assert str(one(spark, S.ratio(F.lit(1), F.lit(3)))) == "0.333333"


def test_on_day_holds_both_midnights(spark):
    rows = spark.createDataFrame([(dt.datetime(2010, 1, d),) for d in (1, 2, 3)], "t timestamp_ntz")
    assert rows.where(P.on_day("t", dt.date(2010, 1, 1))).count() == 2
    assert rows.where(P.last_days("t", dt.date(2010, 1, 3), 2)).count() == 2


def test_equals_or_any_drops_null_rows(spark):
    rows = spark.createDataFrame([(1,), (None,)], "a int")
    assert rows.where(P.equals_or_any("a", None)).count() == 1


def test_flow_fields_checks_arguments():
    assert P.flow_fields("talker", "bytes") == ("src_ip", "dst_ip")
    assert P.flow_fields("dscp", "pkts") == ("tos", "src_ip")
    for bad in (
        dict(flow_type="port", measure="bytes"),
        dict(flow_type="vlan", measure="bytes", class_id=3),
        dict(flow_type="talker", measure="flows"),
        dict(flow_type="service", measure="bytes", netflow=True),
    ):
        with pytest.raises(ValueError):
            P.flow_fields(**bad)


def test_name_lists(spark):
    names = ["account", "account_log", "account_address_log", "order_messages", "user", "user_log"]
    rows = spark.createDataFrame([(n,) for n in names], ["table_name"])

    def kept(**lists):
        return {r[0] for r in rows.where(P.name_lists("table_name", **lists)).collect()}

    assert kept(without="account; account_log") == set(names) - {"account", "account_log"}
    assert kept(within="account; account_log") == {"account", "account_log"}
    assert kept(like="account; account_log") == set()
    assert kept(like="account%; %log", unlike="account_address_%; %_messages") == {"account_log"}
    assert kept(within="user;user_log", without="user") == {"user_log"}
