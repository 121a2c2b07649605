"""Binary payload decode as column expressions over a frame table.

``frames(frame_id, address, rssi, manufacturer_data map<int,binary>, received_at)``
goes through routing and decode in one stage without a shuffle: a map-only job
however many frames there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bits, epoch_offset

MANUFACTURER_ID = 0x0499  # 1177
MIN_LENGTH = {3: 14, 5: 24}
HISTORY_RECORD = 24
MAX_CHUNK_ID = 0xFFFF  # the id is a 16-bit field


WORD = 4
WORDS = [f"_w{k}" for k in range(6)]


def _four_bytes() -> list[str]:
    """Tables that turn the CRC-32 of four bytes back into them, as a big-endian integer: one for each byte of the CRC.

    Spark has no cast from bytes to integers, and ``conv`` reads text digit by digit. The CRC of four bytes takes every
    value once, and but for a constant it is linear over bits: undoing its 32 steps for each byte apart and joining the
    results by exclusive or gives the bytes.
    """
    def undone(state: int) -> int:
        for _ in range(32):
            state = (state ^ 0xEDB88320) << 1 | 1 if state >> 31 else state << 1
        return int.from_bytes(state.to_bytes(4, "little"), "big")

    constant = 0xFFFFFFFF ^ undone(0xFFFFFFFF)
    tables = [[undone(b << 8 * i) ^ (0 if i else constant) for b in range(256)] for i in range(4)]
    return [f"cast(split('{','.join(map(str, t))}', ',') as array<bigint>)" for t in tables]  # folded to a constant


_FOUR_BYTES = _four_bytes()


def with_words(df: DataFrame, source: str) -> DataFrame:
    """Add the first 24 bytes as six 32-bit integers; missing bytes read as zero.

    Every field is then a shift and a mask on a long.
    """
    whole = F.concat(F.col(source).cast("binary"), F.lit(bytes(WORD * len(WORDS))))
    tables = [F.expr(t) for t in _FOUR_BYTES]

    def word(k: int) -> Column:
        crc = F.crc32(F.substring(whole, WORD * k + 1, WORD))
        parts = [F.get(t, bits(crc, 8 * i, 0xFF).cast("int")) for i, t in enumerate(tables)]
        return parts[0].bitwiseXOR(parts[1]).bitwiseXOR(parts[2]).bitwiseXOR(parts[3])

    return df.withColumns({w: word(k) for k, w in enumerate(WORDS)})


def byte(offset: int) -> Column:
    return bits(F.col(WORDS[offset // WORD]), 8 * (WORD - 1 - offset % WORD), 0xFF)


def unsigned(offset: int, width: int = 1) -> Column:
    """Big-endian unsigned integer at a zero-based byte offset."""
    end = offset % WORD + width
    if end <= WORD:  # inside one word
        return bits(F.col(WORDS[offset // WORD]), 8 * (WORD - end), (1 << 8 * width) - 1)
    return _joined([byte(offset + i) for i in reversed(range(width))])


def unsigned_le(offset: int, width: int) -> Column:
    return _joined([byte(offset + i) for i in range(width)])


def _joined(low_first: list[Column]) -> Column:
    out = low_first[0]
    for i, b in enumerate(low_first[1:], 1):
        out = out.bitwiseOR(F.shiftleft(b, 8 * i))
    return out


def signed(raw: Column, wide: int) -> Column:
    """Two's complement of an unsigned integer: shift its sign bit to the top and back."""
    return F.shiftright(F.shiftleft(raw, 64 - wide), 64 - wide)


def _milli_g(raw: Column) -> Column:
    return signed(raw, 16) / F.lit(1000.0)


def _pressure_hpa(raw: Column) -> Column:
    return (raw + 50000) / F.lit(100.0)


def route_frames(frames: DataFrame) -> DataFrame:
    """Add ``payload``, ``data_format`` and ``route`` (why a frame is kept or not)."""
    first, size = byte(0), F.length("payload")
    routed = with_words(
        frames.withColumn("payload", F.try_element_at("manufacturer_data", F.lit(MANUFACTURER_ID))), "payload"
    )
    return routed.withColumn(
        "route",
        F.when(F.col("payload").isNull(), "other_manufacturer")
        .when(size == 0, "empty")
        .when(~first.isin(3, 5), "unknown_format")
        .when((first == 3) & (size < MIN_LENGTH[3]), "short_frame")
        .when((first == 5) & (size < MIN_LENGTH[5]), "short_frame")
        .otherwise("decoded"),
    ).withColumn("data_format", F.when(F.col("route") == "decoded", first.cast("int")))


def route_counts(frames: DataFrame) -> DataFrame:
    return route_frames(frames).groupBy("route").agg(F.count("*").alias("frames"))


def _routed(frames: DataFrame, data_format: int) -> DataFrame:
    return route_frames(frames).filter(F.col("data_format") == data_format)


def _format3_fields() -> dict[str, Column]:
    return {
        "humidity": byte(1) / F.lit(2.0),
        # the fraction is added to the signed whole degrees
        "temperature": signed(byte(2), 8) + byte(3) / F.lit(100.0),
        "pressure": _pressure_hpa(unsigned(4, 2)),
        "acceleration_x": _milli_g(unsigned(6, 2)),
        "acceleration_y": _milli_g(unsigned(8, 2)),
        "acceleration_z": _milli_g(unsigned(10, 2)),
        "battery_voltage": unsigned(12, 2) / F.lit(1000.0),
        "tx_power": F.lit(None).cast("int"),
        "movement_counter": F.lit(None).cast("int"),
        "measurement_sequence": F.lit(None).cast("int"),
        "mac": F.lit(None).cast("string"),
    }


def _power_fields(word: Column) -> dict[str, Column]:
    return {
        "battery_voltage": (bits(word, 5, 0x7FF) + 1600) / F.lit(1000.0),
        "tx_power": (bits(word, 0, 0x1F) * 2 - 40).cast("int"),
    }


def _format5_fields() -> dict[str, Column]:
    return {
        "temperature": signed(unsigned(1, 2), 16) * F.lit(0.005),
        "humidity": unsigned(3, 2) * F.lit(0.0025),
        "pressure": _pressure_hpa(unsigned(5, 2)),
        "acceleration_x": _milli_g(unsigned(7, 2)),
        "acceleration_y": _milli_g(unsigned(9, 2)),
        "acceleration_z": _milli_g(unsigned(11, 2)),
        **_power_fields(unsigned(13, 2)),
        "movement_counter": byte(15).cast("int"),
        "measurement_sequence": unsigned(16, 2).cast("int"),
        "mac": F.regexp_replace(F.hex(F.substring("payload", 19, 6)), "(..)(?=.)", "$1:"),
    }


READING_FIELDS = [
    "temperature", "humidity", "pressure", "acceleration_x", "acceleration_y", "acceleration_z",
    "battery_voltage", "tx_power", "movement_counter", "measurement_sequence", "mac",
]


def _decode(routed: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return routed.withColumns({k: fields[k] for k in READING_FIELDS}).drop(*WORDS)


def decode_f3(frames: DataFrame) -> DataFrame:
    return _decode(_routed(frames, 3), _format3_fields())


def decode_f5(frames: DataFrame) -> DataFrame:
    return _decode(_routed(frames, 5), _format5_fields())


def decode_frames(frames: DataFrame) -> DataFrame:
    """Both formats in one pass, so the frame table is read once."""
    three, five = _format3_fields(), _format5_fields()
    kept = route_frames(frames).filter(F.col("data_format").isNotNull())
    return _decode(kept, {k: F.when(F.col("data_format") == 3, three[k]).otherwise(five[k]) for k in READING_FIELDS})


def attach_envelope(decoded: DataFrame) -> DataFrame:
    """The advertised address (upper-cased) replaces the MAC inside the payload."""
    return decoded.withColumn("mac", F.upper("address"))


def frames_to_readings(frames: DataFrame) -> DataFrame:
    """Routed, decoded and addressed readings."""
    return attach_envelope(decode_frames(frames)).select(
        F.col("frame_id").alias("event_id"), "mac", F.col("received_at").alias("ts"), "data_format",
        "temperature", "humidity", "pressure", "acceleration_x", "acceleration_y", "acceleration_z",
        "battery_voltage", "tx_power", "movement_counter", "measurement_sequence", "rssi",
    )


def split_records(blobs: DataFrame, size: int = HISTORY_RECORD, payload: str = "payload") -> DataFrame:
    """One row per whole fixed-size record; a trailing partial record is dropped."""
    n = F.floor(F.length(payload) / F.lit(size)).cast("int")
    position = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    return (
        blobs.select("*", F.explode(position).alias("record_no"))
        .withColumn("record", F.expr(f"substring({payload}, record_no * {size} + 1, {size})"))
        .drop(payload)
    )


def decode_history(records: DataFrame, base_seconds: str = "base_seconds") -> DataFrame:
    """Little-endian log record of 16 to 24 bytes; longer records carry more fields."""
    size = F.length("record")
    power = _power_fields(unsigned_le(16, 2))
    # a plain comparison makes Spark look for null payloads first, which builds a derived payload twice
    whole = records.filter(F.coalesce(size >= 16, F.lit(False)))
    return with_words(whole, "record").withColumns({
        "ts": epoch_offset(F.col(base_seconds), unsigned_le(0, 4)),
        "temperature": signed(unsigned_le(4, 2), 16) * F.lit(0.005),
        "humidity": unsigned_le(6, 2) * F.lit(0.0025),
        "pressure": _pressure_hpa(unsigned_le(8, 2)),
        "acceleration_x": _milli_g(unsigned_le(10, 2)),
        "acceleration_y": _milli_g(unsigned_le(12, 2)),
        "acceleration_z": _milli_g(unsigned_le(14, 2)),
        "battery_voltage": F.when(size >= 20, power["battery_voltage"]),
        "tx_power": F.when(size >= 20, power["tx_power"]),
        "movement_counter": F.when(size >= 22, unsigned_le(18, 2).cast("int")),
        "measurement_sequence": F.when(size >= 24, unsigned_le(20, 2).cast("int")),
        "data_format": F.lit(5),
    }).drop(*WORDS)


def _received(chunks: DataFrame) -> DataFrame:
    """One payload per (transfer, chunk): the first by ``tie``.

    A partial ``min_by`` removes repeats before the shuffle, so a transfer that
    was re-sent many times costs no more than one that was not.
    """
    return (
        chunks.filter(F.col("chunk_id").between(0, MAX_CHUNK_ID))
        .groupBy("transfer_id", "chunk_id")
        .agg(F.min_by("payload", "tie").alias("payload"), F.max("total").alias("total"))
    )


def rejected_chunks(chunks: DataFrame) -> DataFrame:
    """``transfer_id, reason, n``: chunks left out because their id does not fit the 16-bit field."""
    outside = F.when(F.col("chunk_id").isNull(), "missing id").when(F.col("chunk_id") < 0, "negative id").otherwise("id too large")
    return (
        chunks.filter(F.col("chunk_id").isNull() | ~F.col("chunk_id").between(0, MAX_CHUNK_ID))
        .groupBy("transfer_id", outside.alias("reason")).agg(F.count("*").alias("n"))
    )


def reassemble(chunks: DataFrame) -> DataFrame:
    """Whole payload per complete transfer.

    Chunk ids are 16-bit, so once repeats are gone a transfer holds at most
    65,536 short chunks: the collected list has a fixed bound.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", F.hex("payload").alias("body"))))
    return (
        _received(chunks)
        .groupBy("transfer_id")
        .agg(F.count("*").alias("received"), F.max("total").alias("total"), ordered.alias("parts"))
        .filter(F.col("received") >= F.col("total"))
        .select(
            "transfer_id", "total",
            F.unhex(F.array_join(F.col("parts.body"), "")).alias("payload"),
        )
    )


def transfer_progress(chunks: DataFrame) -> DataFrame:
    return (
        _received(chunks)
        .groupBy("transfer_id")
        .agg(F.count("*").alias("received_chunks"), F.max("total").alias("total_chunks"))
        .withColumn("progress_percent", F.col("received_chunks") * 100.0 / F.col("total_chunks"))
        .withColumn("is_complete", F.col("received_chunks") >= F.col("total_chunks"))
    )


def decode_capabilities(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Capability record; shorter than 8 bytes gives the defaults."""
    known = F.length(payload) >= 8
    # latin-1 keeps one character per byte, so a NUL splits exactly at its byte
    texts = F.split(F.decode(F.expr(f"substring({payload}, 9)"), "ISO-8859-1"), "\\x00", -1)

    def text(index: int) -> Column:
        terminated = known & (F.size(texts) > index + 1)
        body = F.decode(F.encode(texts[index], "ISO-8859-1"), "UTF-8")
        return F.when(terminated, body).otherwise(F.lit(""))

    return with_words(df, payload).withColumns({
        "supports_history": F.when(known, bits(byte(0), 0, 1) == 1).otherwise(F.lit(False)),
        "max_records": F.when(known, unsigned_le(1, 2).cast("int")).otherwise(F.lit(0)),
        "interval_seconds": F.when(known, unsigned_le(3, 2).cast("int")).otherwise(F.lit(0)),
        "firmware_version": text(0),
        "hardware_version": text(1),
    }).drop(*WORDS)
