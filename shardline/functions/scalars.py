"""Scalar functions as Column expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Columns that do not count as a change of a logged row.
AUDIT_COLUMNS = (
    "modified_id",
    "modified_dtm",
    "created_dtm",
    "log_created_dtm",
    "log_modified_dtm",
    "last_mod_time",
    "version_number",
    "comments",
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

US_DATE = "MM/dd/yyyy"
US_DATE_TIME = "MM/dd/yyyy HH:mm:ss"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def initcap(c: Column | str) -> Column:
    return F.initcap(_col(c))


def translate(c: Column | str, source: str, target: str) -> Column:
    """Replace characters one slot after another, from the last slot to the first.

    A character may pass through several slots; each one's end value is worked out here,
    so the rows need a single pass.
    """
    ends: dict[str, str] = {}
    for start in source:
        current = start
        for slot in range(len(source) - 1, -1, -1):
            if current and current == source[slot]:
                current = target[slot] if slot < len(target) else ""
        ends[start] = current
    kept = {a: b for a, b in ends.items() if b}
    dropped = [a for a, b in ends.items() if not b]
    return F.translate(_col(c), "".join([*kept, *dropped]), "".join(kept.values()))


def table_alias(c: Column | str) -> Column:
    """Initials of an underscore name: content_item_build_instruction -> cibi."""
    words = F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))
    return F.lower(translate(words, f"{UPPER} {LOWER}", UPPER))


def path_element(c: Column | str, n: int, sep: str = "|") -> Column:
    """n-th element; a path that is too short gives its last element."""
    if n == -1:
        return F.substring_index(_col(c), sep, -1)
    head = F.substring_index(_col(c), sep, n)
    return head if n == 1 else F.substring_index(head, sep, -1)


def path_top(c: Column | str, sep: str = "|") -> Column:
    """Text before the first separator, empty when there is none."""
    text = _col(c)
    at = F.locate(sep, text)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).when(text.isNotNull(), F.lit(""))


def packed_value(c: Column | str, key: str, anchored: bool = True) -> Column:
    """Value of ``key`` in a ``~|~key==value~|~`` string, NULL when the key is absent."""
    text = _col(c)
    marker = f"~|~{key}==" if anchored else f"{key}=="
    tail = F.substring_index(text, marker, -1)
    return F.when(text.contains(key), F.trim(F.substring_index(tail, "~|~", 1)))


def us_date(c: Column | str) -> Column:
    return F.date_format(_col(c), US_DATE)


def us_date_time(c: Column | str) -> Column:
    return F.date_format(_col(c), US_DATE_TIME)


def nearest_half_hour(c: Column | str) -> Column:
    """Nearest 30 minutes, keeping the timestamp type (with or without zone)."""
    ts = _col(c)
    part = F.extract(F.lit("SECOND"), ts)
    seconds = F.minute(ts) * 60 + part
    minutes = (F.round(seconds / 1800).cast("int") * 30) - F.minute(ts)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes, -part.cast("decimal(18,6)"))


#: Sums and products of whole or fractional figures, without overflow.
EXACT = "decimal(38,6)"


def later_of(a: Column | str, b: Column | str) -> Column:
    """Later of two times, NULL counts as lowest."""
    return F.greatest(_col(a), _col(b))


def whole_hours(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("HOUR", _col(start), _col(end))


def ipv4_to_binary(c: Column | str) -> Column:
    """Dotted text to four bytes; NULL when the text is no IPv4 address."""
    text = _col(c)
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    digits = F.transform(F.split(text, r"\."), lambda part: F.lpad(F.hex(part.cast("bigint")), 2, "0"))
    return F.when(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.unhex(F.array_join(digits, "")))


def ipv4_to_text(c: Column | str) -> Column:
    code = F.hex(_col(c))
    parts = [F.conv(F.substring(code, at, 2), 16, 10) for at in (1, 3, 5, 7)]
    return F.when(F.length(_col(c)) == 4, F.concat_ws(".", *parts))


def ratio(num: Column, den: Column, scale: int = 6) -> Column:
    """num / den as a decimal, 0 when the divisor is 0 (to six places, as both sides are taken)."""
    above, below = num.cast(EXACT), den.cast(EXACT)
    return F.when(below == 0, F.lit(0)).otherwise(above / F.when(below != 0, below)).cast(f"decimal(28,{scale})")


def mean_delay(total: Column, count: Column) -> Column:
    return F.when(count == 0, F.lit(0.0)).otherwise(total.cast("double") / F.when(count != 0, count))


def thousands(c: Column | str) -> Column:
    return F.format_number(_col(c), 0)


def excel_quote(c: Column | str) -> Column:
    """Leading and trailing apostrophe, so a spreadsheet keeps the text as it is."""
    return F.concat(F.lit("'"), _col(c).cast("string"), F.lit("'"))


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def status_suffix(online: Column | str, name: Column | str) -> Column:
    """Name, or name padded to 14 with ' OFF' when not online."""
    text = _col(name)
    return F.when(_col(online) == 1, text).otherwise(F.concat(F.rpad(text, 14, " "), F.lit(" OFF")))


def tracked_columns(columns: Iterable[str], keys: Iterable[str] = ()) -> list[str]:
    """Columns whose change makes a new version of a logged row."""
    skip = {*AUDIT_COLUMNS, *keys}
    return [c for c in columns if c not in skip and not c.endswith("_lower")]


def row_fingerprint(columns: Iterable[str]) -> Column:
    """Digest of the named columns; NULL and the text 'NULL' stay apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
