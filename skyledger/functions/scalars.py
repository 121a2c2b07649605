"""Named column functions; all compile to built-in expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted address form (fixed value).
MAC_PATTERN = "^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"

# Lower voltage bound, band, estimated months left, test passed (fixed values).
BATTERY_BANDS = [
    (3.0, "Excellent", 12, True),
    (2.8, "Good", 6, True),
    (2.6, "Fair", 3, True),
    (2.4, "Low", 1, False),
]


def normalize_mac(mac: Column) -> Column:
    """Upper-case, colon every two characters; null unless 12 characters remain."""
    clean = F.regexp_replace(F.upper(mac), "[^0-9A-Z]", "")
    return F.when(F.length(clean) == 12, F.regexp_replace(clean, "(..)(?=.)", "$1:"))


def is_valid_mac(mac: Column) -> Column:
    return F.coalesce(mac.rlike(MAC_PATTERN), F.lit(False))


def same_text(left: Column, right: Column) -> Column:
    """Case-insensitive equality."""
    return F.lower(left) == F.lower(right)


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to an instant; ``Z`` and offsets honoured, bad text is null."""
    # seconds may be left out before a zone, which the cast does not allow
    full = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.when(text.rlike(ISO_PATTERN), F.try_to_timestamp(full))


def local_time(ts: Column, zone: Column) -> Column:
    """Wall-clock time of an instant in a named zone."""
    return F.convert_timezone(F.lit("UTC"), zone, ts.cast("timestamp_ntz"))


def horizon_hours(run_time: Column, valid_time: Column) -> Column:
    """Whole hours from the forecast run to the hour it predicts."""
    return F.timestamp_diff("HOUR", run_time, valid_time).cast("int")


def epoch_offset(base_seconds: Column, offset_seconds: Column) -> Column:
    return F.timestamp_seconds(base_seconds + offset_seconds)


def banded(value: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """First label whose lower bound is reached; null stays null."""
    out = None
    for bound, label in steps:
        branch = F.lit(label)
        out = F.when(value >= bound, branch) if out is None else out.when(value >= bound, branch)
    return F.when(value.isNotNull(), out.otherwise(F.lit(otherwise)))


def battery_health(voltage: Column) -> Column:
    """Struct of band, estimated months left and pass verdict."""
    return F.struct(
        banded(voltage, [(b, h) for b, h, _, _ in BATTERY_BANDS], "Critical").alias("health"),
        banded(voltage, [(b, m) for b, _, m, _ in BATTERY_BANDS], 0).alias("months_left"),
        F.coalesce(voltage >= 2.6, F.lit(False)).alias("passed"),
    )


def item_label(column: str, bin_label: Column) -> Column:
    return F.when(bin_label.isNotNull(), F.concat_ws("_", F.lit(column), bin_label))


def item_list(items: Column) -> Column:
    """Sorted, comma-joined item text."""
    return F.array_join(F.array_sort(items), ",")


def display_status(enabled: Column, status: Column) -> Column:
    return F.when(enabled & (status == "active"), F.lit("Active")).otherwise(F.lit("Inactive"))


def last_seen_text(last_seen: Column) -> Column:
    return F.coalesce(F.date_format(last_seen, "yyyy-MM-dd HH:mm"), F.lit("Never"))


def location_text(location: Column) -> Column:
    return F.coalesce(F.nullif(location, F.lit("")), F.lit("Unknown"))


def signed_error(actual: Column, forecast: Column) -> Column:
    return forecast - actual


def abs_error(actual: Column, forecast: Column) -> Column:
    return F.abs(actual - forecast)


def json_field(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def tag_map(**tags: Column) -> Column:
    """String map of the given tags; a null tag is left out."""
    pairs = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def tag_value(tags: Column, key: str) -> Column:
    return F.element_at(tags, key)


def bits(word: Column, shift: int, mask: int) -> Column:
    """``(word >> shift) & mask``."""
    return F.shiftright(word, shift).bitwiseAND(F.lit(mask))


# A 64-bit id has fewer values than the range; moved up, ids are positive, and zero stands for null.
_ID_RANGE, _ID_SHIFT, _NO_TIME = Decimal(2 ** 64 + 1), Decimal(2 ** 63 + 1), Decimal(-10 ** 18)


def packed_order(ts: str, tie: str) -> Column:
    """An instant and a 64-bit id as one fixed-width number that sorts by instant, then id; nulls come first.

    Structs cannot be kept in a hash table's buffer, a decimal can: ``max_by`` over it combines without a sort.
    """
    micros = F.coalesce(F.unix_micros(F.col(ts)).cast("decimal(19,0)"), F.lit(_NO_TIME))
    moved = F.coalesce(F.col(tie).cast("decimal(20,0)") + F.lit(_ID_SHIFT), F.lit(Decimal(0)))
    return micros * F.lit(_ID_RANGE) + moved


def packed_tie(packed: Column) -> Column:
    """The id inside a packed order."""
    moved = F.pmod(packed, F.lit(_ID_RANGE))
    return F.when(moved > 0, moved - F.lit(_ID_SHIFT))
