import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridelake.errors import NdError
from stridelake.functions import bits, index, text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=4), st.booleans())
def test_strides(shape, fortran):
    x = np.zeros(shape, order="F" if fortran else "C")
    assert [s * 8 for s in index.strides(shape, fortran)] == [s if n > 1 else index.strides(shape, fortran)[k] * 8 for k, (s, n) in enumerate(zip(x.strides, shape))]


def test_unravel_and_ravel_equal_numpy(spark):
    shape = (3, 4, 5)
    for order in "CF":
        at = index.unravel(F.col("id"), shape, order == "F")
        rows = spark.range(60).select("id", *(c.alias(f"i{k}") for k, c in enumerate(at)), index.ravel(at, shape, order == "F").alias("again")).collect()
        for r in rows:
            assert (r.i0, r.i1, r.i2) == tuple(map(int, np.unravel_index(r.id, shape, order=order))) and r.again == r.id
    got = spark.range(60).select(index.ravel_array(F.array(F.col("id"), F.lit(2)), F.array(F.lit(10), F.lit(3))).alias("v")).collect()
    assert [r.v for r in got] == [10 * k + 6 for k in range(60)]


def test_indices_out_of_range(spark):
    with pytest.raises(Exception, match="index_out_of_bounds"):
        spark.range(1).select(index.normalize_index(F.lit(-4), 3)).collect()
    assert spark.range(1).select(index.normalize_index(F.lit(3), 3, "null").alias("v")).first().v is None
    with pytest.raises(NdError):
        index.ravel([1], (2, 2))
    with pytest.raises(NdError):
        index.checked_size((1 << 40, 1 << 40))


def test_swaps_equal_numpy(spark):
    values = [0, 1, -1, 255, -2, 32767, -32768, 12345]
    df = spark.createDataFrame([(v, float(v)) for v in values], "v long, f double")
    for width, kind in ((2, "<i2"), (4, "<i4"), (8, "<i8")):
        got = [r[0] for r in df.select(bits.bswap(F.col("v"), width)).collect()]
        assert got == np.array(values, kind).byteswap().tolist()
    got = [r[0] for r in df.select(bits.bswap_double(bits.bswap_double(F.col("f")))).collect()]
    assert got == [float(v) for v in values]
    got = df.select(bits.bswap_complex(F.struct(F.col("f").alias("re"), F.lit(1.0).alias("im"))).alias("z")).collect()
    assert got[1].z.re == np.array([1.0]).byteswap()[0]


def test_masks():
    assert bits.bitmask(0, 64) == -1 and bits.bitmask(3, 5) == 248 and bits.bitmask(63, 1) == -(1 << 63)


def test_code_points(spark):
    texts = ["", "abc", "añ🙂", "퟿\U0010ffff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(text.to_ucs4(F.col("t")).alias("p"), text.from_ucs4_bytes(text.ucs4_bytes(F.col("t"))).alias("le"), text.from_ucs4_bytes(text.ucs4_bytes(F.col("t"), True), True).alias("be")).collect()
    for t, r in zip(texts, rows):
        assert r.p == list(map(ord, t)) and r.le == t and r.be == t
    with pytest.raises(Exception, match="invalid_value"):
        df.select(text.ucs4_fits(F.col("t"), 2)).collect()
    raw = spark.createDataFrame([(np.array([65, 0, 66], "<u4").tobytes(),)], "b binary")
    assert raw.select(text.from_ucs4_bytes(F.col("b")).alias("t")).first().t == "A"


def test_ucs4_bytes_of_odd_texts_and_units(spark):
    texts = ["\ufeffa", "\ufffe\r\n\u2028", "".join(map(chr, range(1, 0x3000))), "".join(map(chr, range(0x10FF00, 0x110000)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.ucs4_bytes(F.col("t")).alias("le"), text.ucs4_bytes(F.col("t"), True).alias("be"))
    for r in df.select("*", text.from_ucs4_bytes(F.col("le")).alias("x"), text.from_ucs4_bytes(F.col("be"), True).alias("y")).collect():
        assert r.le == r.t.encode("utf-32-le") and r.be == r.t.encode("utf-32-be") and r.x == r.y == r.t
    units = {b"A": "", b"A\0\0\0BC": "A", np.array([0x110000, 65, 0x80000042, 66], "<u4").tobytes(): "AB", np.array([0x100, 0x10000, 0, 65], "<u4").tobytes(): "\u0100\U00010000", b"": "", None: None}
    raw = spark.createDataFrame([(u,) for u in units], "b binary")
    assert [r.t for r in raw.select(text.from_ucs4_bytes(F.col("b")).alias("t")).collect()] == list(units.values())
    for pair in ([0xD800], [65, 0xD83D, 0xDE42]):
        raw = spark.createDataFrame([(np.array(pair, "<u4").tobytes(), np.array(pair, ">u4").tobytes())], "le binary, be binary")
        for points in (text.from_ucs4_bytes(F.col("le")), text.from_ucs4_bytes(F.col("be"), True)):
            with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
                raw.select(points).collect()


def test_ucs4_round_trip_takes_time_in_proportion_to_the_text(spark):
    import time

    df = spark.range(1).select(F.repeat(F.lit("añ🙂x"), 1000).alias("t"))
    began = time.monotonic()
    assert df.select(text.from_ucs4_bytes(text.ucs4_bytes(F.col("t"))) == F.col("t")).first()[0]
    assert time.monotonic() - began < 15  # by the square of the length: about a minute


def test_fixed_utf8_and_hexdump(spark):
    df = spark.createDataFrame([("añ",)], "t string")
    assert bytes(df.select(text.to_utf8(F.col("t"), 5)).first()[0]) == "añ".encode() + b"\0\0"
    with pytest.raises(Exception, match="invalid_value"):
        df.select(text.to_utf8(F.col("t"), 2)).collect()
    lines = spark.createDataFrame([(bytes(range(20, 40)),)], "b binary").select(text.hexdump_lines(F.col("b"))).first()[0]
    assert lines[0] == "00000000: 14 15 16 17 18 19 1a 1b 1c 1d 1e 1f 20 21 22 23  | ............ !\"#"
    assert lines[1] == "00000010: 24 25 26 27 " + " " * 36 + " | $%&'"


def test_single_byte_swaps_keep_nan_and_null(spark):
    import random
    import struct

    from stridelake.functions import bits

    rng = random.Random(1)
    wanted = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(200)] + [struct.unpack(">d", struct.pack("<d", float("nan")))[0], 1.0000000000141254, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(wanted)], "k int, v double")
    got = {r.k: r.s for r in df.select("k", bits.bswap_double(df["v"]).alias("s")).collect()}
    for k, v in enumerate(wanted):
        if v is None:
            assert got[k] is None
        elif v == v:
            want = struct.unpack(">d", struct.pack("<d", v))[0]
            assert got[k] == want or (want != want and got[k] != got[k])
        else:
            assert got[k] is not None
