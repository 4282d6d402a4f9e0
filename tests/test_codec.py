import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbline.functions.codec import KeyError_, Layout, TierKind, decode_pk, encode_pk, floor_to, pk_text


def test_tier_keys_from_text():
    ts = TierKind.TIMESTAMPTZ
    assert ts.parse("2026-07-01") == 1782864000000000
    assert ts.parse("2026-07-01 12:30:45.123456") == 1782909045123456
    assert ts.parse("2026-07-01T12:30:45.1234569Z") == 1782909045123456
    assert ts.parse("2026-07-01T14:30:45+02:00") == ts.parse("2026-07-01 12:30:45")
    assert ts.parse("1969-12-31 23:59:59.999999") == -1
    assert TierKind.DATE.parse("2026-07-01") == 20635
    assert TierKind.DATE.parse("1969-12-31") == -1
    assert TierKind.BIGINT.parse("-42") == -42
    for bad in ("", "soon", "2026-13-01", "2026-07-01 25:00:00"):
        with pytest.raises(KeyError_):
            ts.parse(bad)


def test_durations():
    assert TierKind.TIMESTAMP.duration("7d") == 7 * 86400 * 10**6
    assert TierKind.TIMESTAMP.duration("10s") == 10**7
    assert TierKind.DATE.duration("48h") == 2
    assert TierKind.BIGINT.duration(50) == 50
    for kind, text in ((TierKind.DATE, "12h"), (TierKind.BIGINT, "1d"), (TierKind.TIMESTAMP, "x")):
        with pytest.raises(KeyError_):
            kind.duration(text)


def test_tokens_and_floors():
    assert TierKind.BIGINT.token(-5) == "m5"
    assert TierKind.TIMESTAMP.token(1782864000000000) == "20260701"
    assert floor_to(-1, 100) == -100
    assert floor_to(199, 100) == 100


def test_columns_equal_python(spark):
    moments = [dt.datetime(2026, 7, 1, 12, 30, 45, 123456), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1, 1, 2)]
    df = spark.createDataFrame([(m, m.date()) for m in moments], "ts timestamp_ntz, d date")
    got = df.select(TierKind.TIMESTAMP.to_long(F.col("ts")), TierKind.DATE.to_long(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(TierKind.TIMESTAMP.parse(m), TierKind.DATE.parse(m.date())) for m in moments]
    for r, m in zip(got, moments, strict=True):
        assert df.filter(F.col("ts") == TierKind.TIMESTAMP.literal(r[0])).collect()[0].ts == m


def test_literals_beyond_the_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp_ntz")
    assert df.filter(F.col("ts") >= TierKind.TIMESTAMP.literal(-(1 << 63))).count() == 1
    assert df.filter(F.col("ts") < TierKind.TIMESTAMP.literal((1 << 63) - 1)).count() == 1


@pytest.mark.parametrize("values", [["a"], ["1", "d1"], ["x\\", "\x1fy"], ["", ""], ["\\\x1f", "\x1f\\"]])
def test_primary_keys_round_trip(spark, values):
    text = encode_pk(values)
    assert decode_pk(text, len(values)) == values
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    assert df.select(pk_text(names, df.schema)).first()[0] == text


def test_primary_keys_reject(spark):
    with pytest.raises(KeyError_):
        encode_pk([1, None])
    df = spark.createDataFrame([(1.5,)], "x double")
    with pytest.raises(KeyError_):
        pk_text(["x"], df.schema)


def test_layouts(spark):
    key = TierKind.TIMESTAMP.parse("2024-03-05 13:00:00")
    df = spark.createDataFrame([(key, -1)], "k long, n long")
    for unit, start in (("hour", "2024-03-05 13:00"), ("day", "2024-03-05"), ("month", "2024-03-01"), ("year", "2024-01-01")):
        assert df.select(Layout(unit).bucket(F.col("k"), TierKind.TIMESTAMP)).first()[0] == TierKind.TIMESTAMP.parse(start)
    assert df.select(Layout(100).bucket(F.col("n"), TierKind.BIGINT)).first()[0] == -100
    assert Layout(100).one_bucket(100, 199) and not Layout(100).one_bucket(99, 100)
    with pytest.raises(ValueError):
        Layout("day").one_bucket(0, 1)
    with pytest.raises(ValueError):
        Layout("week")
