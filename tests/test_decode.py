"""Golden frames and malformed input."""

import glob
import random
import re

import pytest
from pyspark.sql import functions as F

from skyledger import session
from skyledger.plans import views
from skyledger.sources import frames as fr

# Payload and expected values (fixed values).
GOLDEN = {
    "f3 indoor": ("033214322710" "03E8FF3800640BB8",
                  dict(temperature=20.5, humidity=25.0, pressure=600.0, acceleration_x=1.0, acceleration_y=-0.2,
                       acceleration_z=0.1, battery_voltage=3.0, tx_power=None)),
    "f3 cold": ("03A0F6191E14" "0032006403E80A8C",
                dict(temperature=-9.75, humidity=80.0, pressure=577.0, acceleration_x=0.05, acceleration_y=0.1,
                     acceleration_z=1.0, battery_voltage=2.7)),
    "f3 hot": ("033C234B262C" "FFCE000003E80898",
               dict(temperature=35.75, humidity=30.0, pressure=597.72, acceleration_x=-0.05, battery_voltage=2.2)),
    "f3 max": ("03C87F63FFFF" "7FFF7FFF7FFF0E10",
               dict(temperature=127.99, humidity=100.0, pressure=1155.35, acceleration_z=32.767, battery_voltage=3.6)),
    "f5 indoor": ("050FA02710271003E8FF380064C8182A0100AABBCCDDEEFF",
                  dict(temperature=20.0, humidity=25.0, pressure=600.0, acceleration_y=-0.2, battery_voltage=3.2,
                       tx_power=8, movement_counter=42, measurement_sequence=256, mac="AA:BB:CC:DD:EE:FF")),
    "f5 cold": ("05F8304E201E140032006403E8A2960F0210112233445566",
                dict(temperature=-10.0, humidity=50.0, pressure=577.0, battery_voltage=2.9, tx_power=4,
                     movement_counter=15, measurement_sequence=528, mac="11:22:33:44:55:66")),
    "f5 precise": ("0510682AF8286A012CFED403F2E11C800ABCDEADBEEFCAFE",
                   dict(temperature=21.0, humidity=27.5, pressure=603.46, acceleration_x=0.3, acceleration_y=-0.3,
                        acceleration_z=1.01, battery_voltage=3.4, tx_power=16, movement_counter=128,
                        measurement_sequence=2748, mac="DE:AD:BE:EF:CA:FE")),
    "f3 zero": ("03" + "00" * 13, dict(temperature=0.0, humidity=0.0, pressure=500.0)),
    "f3 lowest": ("030080" + "00" * 11, dict(temperature=-128.0)),
    "f5 lowest": ("058000" + "00" * 21, dict(temperature=-163.84, battery_voltage=1.6, tx_power=-40)),
    "f5 highest": ("057FFF" + "00" * 21, dict(temperature=163.835)),
}

MALFORMED = ["033214", "03", "0332143227", "050FA027", "05", "05" + "00" * 10, "63010203", "", "FFFF",
             "03" + "FF" * 5, "05" + "FF" * 10]


def frame_table(spark, payloads, manufacturer=fr.MANUFACTURER_ID):
    rows = [(i, "aa:bb", -60, {manufacturer: bytearray.fromhex(p)}) for i, p in enumerate(payloads)]
    return spark.createDataFrame(
        rows, "frame_id int, address string, rssi int, manufacturer_data map<int,binary>"
    ).selectExpr("*", "timestamp '2024-01-01' as received_at")


def test_golden_frames(spark):
    decoded = fr.decode_frames(frame_table(spark, [p for p, _ in GOLDEN.values()])).collect()
    by_id = {r["frame_id"]: r for r in decoded}
    for i, (name, (_, expected)) in enumerate(GOLDEN.items()):
        for field, value in expected.items():
            got = by_id[i][field]
            assert got == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (name, field)


def test_single_format_decoders_agree(spark):
    frames = frame_table(spark, [p for p, _ in GOLDEN.values()])
    both = fr.decode_frames(frames)
    split = fr.decode_f3(frames).unionByName(fr.decode_f5(frames))
    columns = ["frame_id", *fr.READING_FIELDS]
    assert sorted(both.select(*columns).collect()) == sorted(split.select(*columns).collect()) or (
        both.select(*columns).exceptAll(split.select(*columns)).isEmpty()
    )


def test_malformed_frames_are_rejected(spark):
    assert fr.decode_frames(frame_table(spark, MALFORMED)).count() == 0


def test_foreign_and_empty_advertisements(spark):
    assert fr.decode_frames(frame_table(spark, ["0102"], 0x004C)).count() == 0
    empty = frame_table(spark, ["01"]).withColumn("manufacturer_data", fr.F.expr("map_filter(manufacturer_data, (k, v) -> false)"))
    assert [r["route"] for r in fr.route_frames(empty).collect()] == ["other_manufacturer"]


def test_envelope_wins(spark):
    frames = frame_table(spark, [GOLDEN["f5 indoor"][0]])
    row = fr.frames_to_readings(frames).first()
    assert (row["mac"], row["rssi"]) == ("AA:BB", -60)


def test_history_record_lengths(spark):
    full = "0A000000" "A00F" "1027" "1027" "E803" "38FF" "6400" "18C8" "2A00" "0001" "0000"
    records = [full[: 2 * n] for n in (15, 16, 20, 22, 24)]
    df = spark.createDataFrame([(i, bytearray.fromhex(r)) for i, r in enumerate(records)], "i int, record binary")
    rows = fr.decode_history(df.selectExpr("*", "1700000000L as base_seconds")).orderBy("i").collect()
    assert [r["i"] for r in rows] == [1, 2, 3, 4]
    assert [r["battery_voltage"] for r in rows] == [None, 3.2, 3.2, 3.2]
    assert [r["movement_counter"] for r in rows] == [None, None, 42, 42]
    assert [r["measurement_sequence"] for r in rows] == [None, None, None, 256]
    assert (rows[0]["temperature"], rows[0]["acceleration_y"]) == (20.0, -0.2)
    assert rows[0]["ts"].timestamp() == 1700000010


def test_reassembly(spark):
    rows = [(1, 2, 2, 5, b"B"), (1, 1, 2, 9, b"late"), (1, 1, 2, 1, b"A"), (2, 1, 3, 1, b"x"), (3, 0, 1, 1, b"")]
    chunks = spark.createDataFrame(rows, "transfer_id int, chunk_id int, total int, tie int, payload binary")
    whole = {r["transfer_id"]: bytes(r["payload"]) for r in fr.reassemble(chunks).collect()}
    assert whole == {1: b"AB", 3: b""}
    progress = {r["transfer_id"]: (r["received_chunks"], r["is_complete"]) for r in fr.transfer_progress(chunks).collect()}
    assert progress == {1: (2, True), 2: (1, False), 3: (1, True)}


def test_capabilities(spark):
    payloads = ["01E803", "01E8033C00000000" + b"1.2\0revB\0".hex(), "00E8033C00000000" + b"1.2".hex()]
    df = spark.createDataFrame([(i, bytearray.fromhex(p)) for i, p in enumerate(payloads)], "i int, payload binary")
    rows = fr.decode_capabilities(df).orderBy("i").drop("i", "payload").collect()
    assert [tuple(r) for r in rows] == [
        (False, 0, 0, "", ""), (True, 1000, 60, "1.2", "revB"), (False, 1000, 60, "", ""),
    ]


def test_bytes_are_read_as_integers_not_as_text(spark):
    """Payloads of all lengths and byte values; what is missing reads as zero."""
    draw = random.Random(3)
    bodies = [bytes(draw.randrange(256) for _ in range(n)) for n in [*range(31), *[24] * 200]] + [bytes([b]) * 24 for b in range(256)] + [None]
    df = spark.createDataFrame([(i, b if b is None else bytearray(b)) for i, b in enumerate(bodies)], "i int, payload binary")
    read = fr.with_words(df, "payload").select("i", *[fr.byte(k) for k in range(24)], fr.unsigned(2, 4), fr.unsigned_le(5, 4), fr.unsigned(8, 4))
    for i, *got in read.collect():
        if bodies[i] is None:
            assert set(got) == {None}
            continue
        body = (bodies[i] + bytes(24))[:24]
        assert got == [*body, int.from_bytes(body[2:6], "big"), int.from_bytes(body[5:9], "little"), int.from_bytes(body[8:12], "big")]
    history = df.select(F.col("payload").alias("record"), F.lit(0).cast("long").alias("base_seconds"))
    assert not re.search(r"\bconv\(", fr.decode_history(history)._jdf.queryExecution().toString())


def test_little_endian_text(spark):
    """Negative and too large integers keep their low bytes; a null field makes the whole text null."""
    rows = [(1, 2, 3, 4, 5), (-1, -2, 70_000, 2**33 + 7, -2**31), (0, 0x0102, 0xFF00, 0x01020304, 0xFFFFFFFF), (1, 2, 3, None, 5)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, e long")
    got = [r[0] for r in df.select(F.expr(views._le_text([("a", 2), ("d", 4), ("b", 2), ("c", 2), ("e", 4)]))).collect()]
    want = [None if d is None else b"".join((x & (1 << 8 * n) - 1).to_bytes(n, "little") for x, n in ((a, 2), (d, 4), (b, 2), (c, 2), (e, 4)))
            + bytes(2) for a, b, c, d, e in rows]
    assert got == [w if w is None else w.hex().upper() for w in want]


def test_history_blobs_are_built_once_and_not_stored(spark, tmp_path):
    """Blobs take several times the room of the table behind them; a null field leaves a blob without records."""
    rows = [(1, 7, 3, 2), (5, 9, None, 1), (2**33, 70_000, 4, 3), (6, 8, 2, None), (None, 8, 2, 2), (10, None, 2, 1), (1, 7, 3, 2)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    stored = lambda: set(glob.glob(f"{session._app_folder(spark)}/blobs-*"))
    before, split = stored(), fr.split_records(views.Tables(spark, str(tmp_path)).history_blobs)
    decoded = fr.decode_history(split)
    got = [(r["l_orderkey"], r["record_no"], r["ts"] and int(r["ts"].timestamp()), r["temperature"], r["measurement_sequence"]) for r in decoded.collect()]
    want = []
    for order, part, supp, n in rows:
        for k in range(n or 0) if order is not None and part is not None else ():
            raw = int.from_bytes(((part * 31 + k * 7) % 65536).to_bytes(2, "little"), "little", signed=True)
            ts = None if supp is None else 1_700_000_000 + supp + (order * 60 + k * 10) % 2**32
            want.append((order, k, ts, raw * 0.005, (order + k) % 65536))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert stored() == before
    for df in (split, decoded):
        assert df._jdf.queryExecution().executedPlan().toString().count("unhex(") == 1
