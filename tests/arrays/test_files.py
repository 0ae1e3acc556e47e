import io
import struct
import zipfile

import numpy as np
import pytest

from stridelake.errors import Errors, NdError, Result, Warnings
from stridelake.operators.frame import NDFrame
from stridelake.sources import dtypes, header
from stridelake.sources.catalog import inspect_fields, npy_catalog, read_properties
from stridelake.sources.literal import parse_literal, token_spans
from stridelake.sources.npy_source import find_array, read_npy, read_npz
from stridelake.sources.sink import save_npy, save_npy_shards, save_npz, save_npz_compressed
from stridelake.streaming.arrivals import decode_binary, read_arrivals


def raw_file(text: str, payload: bytes = b"", version=(1, 0), align: int = 64) -> bytes:
    width = 2 if version == (1, 0) else 4
    body = text.encode("latin-1")
    pad = -(8 + width + len(body) + 1) % align
    body += b" " * pad + b"\n"
    return b"\x93NUMPY" + bytes(version) + len(body).to_bytes(width, "little") + body + payload


def code_of(data: bytes, **kw) -> int:
    try:
        header.read_header(io.BytesIO(data), len(data), **kw)
        return 0
    except NdError as e:
        return int(e.code)


def head(descr: str, order: str = "False", shape: str = "()") -> str:
    return f"{{'descr': {descr}, 'fortran_order': {order}, 'shape': {shape}, }}"


GOOD = head("'<f8'", shape="(2,)")
CORPUS = [
    (raw_file(GOOD, bytes(16)), 0),
    (raw_file("{'shape': (2,), 'extra': 1, 'descr': '<f8', 'fortran_order': True}", bytes(16)), 0),
    (raw_file(head("'<f8'"), bytes(8)), 0),
    (raw_file(head("'<f8'", shape="(0, 3)")), 0),
    (raw_file(GOOD, bytes(16), (2, 0)), 0),
    (b"\x92" + raw_file(GOOD, bytes(16))[1:], 201),
    (raw_file(GOOD, bytes(16), (3, 0)), 202),
    (raw_file(GOOD, bytes(16), align=16), 0 if (10 + len(GOOD) + 1 + (-(10 + len(GOOD) + 1) % 16)) % 64 == 0 else 203),
    (raw_file(GOOD)[:40], 105),
    (raw_file("{'descr': '<f8'"), 205),
    (raw_file("[1, 2]"), 206),
    (raw_file("{}"), 207),
    (raw_file(head("8")), 302),
    (raw_file(head("'|O'")), 303),
    (raw_file(head("'!f8'")), 303),
    (raw_file(head("'<M8[ns]'")), 304),
    (raw_file(head("'|O8'")), 303),
    (raw_file(head("[]")), 305),
    (raw_file(head("['<f8']")), 306),
    (raw_file(head("[('a',)]")), 307),
    (raw_file(head("[('a','<f8',(2,),1)]")), 308),
    (raw_file(head("[('a','<f8',2)]")), 309),
    (raw_file(head("[('a','<f8',('x',))]")), 310),
    (raw_file(head("[('a',8)]")), 311),
    (raw_file(head("'<f8'", "0")), 401),
    (raw_file(head("'<f8'", shape="[3]")), 402),
    (raw_file(head("'<f8'", shape="('x',)")), 403),
    (raw_file(head("'<f8'", shape="(-1,)")), 403),
    (raw_file(head("'<f8'", shape="(3.0,)")), 403),
    (raw_file(GOOD, bytes(15)), 405),
    (raw_file(GOOD, bytes(8)), 405),
    (raw_file("{'fortran_order': False, 'shape': (2,)}", bytes(16)), 301),
    (b"PK\x03\x04" + bytes(60), 101),
    (raw_file(head("'<f8'", shape=f"({1 << 40}, {1 << 40})")), 604),
    (raw_file("__import__('os').getcwd()"), 205),
]


@pytest.mark.parametrize("k", range(len(CORPUS)))
def test_header_corpus(k):
    data, code = CORPUS[k]
    assert code_of(data) == code


def test_lenient_headers():
    assert code_of(raw_file(GOOD, bytes(16), (3, 0)), lenient=True) == 0
    assert code_of(raw_file(GOOD, bytes(16), align=1), lenient=True) == 0


def test_missing_keys_are_warnings():
    data = raw_file("{'descr': '<f8'}", bytes(24))
    h = header.read_header(io.BytesIO(data), len(data))
    assert h.shape == (3,) and not h.fortran_order and h.warnings == Warnings.missing_fortran_order | Warnings.missing_shape
    assert str(Result(h.warnings)) == "missing_fortran_order | missing_shape, none"
    assert str(Result()) == "none, none" and str(Result(err=Errors.file_not_found)) == "none, file_not_found"
    with pytest.raises(NdError):
        (Result(h.warnings) | Result(err=Errors.invalid_value)).check()


def test_headers_equal_numpys():
    for x in (np.zeros((3, 4), "<f4"), np.asfortranarray(np.zeros((2, 3), ">i2")), np.zeros(2, [("a", "<U3"), ("b", [("c", "<u8"), ("d", ">f4", (2, 2))])])):
        f = io.BytesIO()
        np.lib.format.write_array(f, x, version=(2, 0))
        f.seek(0)
        h = header.read_header(f, len(f.getvalue()))
        f2 = io.BytesIO(header.header_bytes(h.dtype, h.fortran_order, h.shape) + f.getvalue()[h.data_offset :])
        y = np.load(f2)
        assert y.dtype == x.dtype and y.shape == x.shape and dtypes.numpy_dtype(h.dtype) == x.dtype


def test_literals():
    assert parse_literal("{'a': (1, -2.5, [None, True, {3}])}") == {"a": (1, -2.5, [None, True, {3}])}
    for bad in ("1 + 1", "f(x)", "(1,,2)", "a", "{**{}}", "(" * 500):
        with pytest.raises(NdError):
            parse_literal(bad)
    assert [t[:2] for t in token_spans("('a', 1)")] == [("punctuation", "("), ("string", "'a'"), ("punctuation", ","), ("number", "1"), ("punctuation", ")")]


def test_dtype_helpers():
    dt = dtypes.with_layout(dtypes.parse_descr([("year", "<u4"), ("c", [("name", "<U16"), ("gdp", "<u8", (2,))], (3,))]))
    assert dt.is_structured and dt.find_field("c", "gdp").offset == 68 and dt.item_size == 4 + 3 * (64 + 16)
    assert dt.add_field(dtypes.parse_typestr("<f8", "x")).fields[-1].offset == dt.item_size
    assert dt.find_field("nope") is None and [p for p, _ in dt.walk()] == [("year",), ("c",), ("c", "name"), ("c", "gdp")]
    assert dtypes.to_byte_order(">") == "big" and dtypes.to_byte_order("?") == "invalid"


def save(tmp_path, name, x):
    np.save(tmp_path / name, x)
    return str(tmp_path / name)


TYPES = ["|b1", "|i1", "<i2", ">i4", "<i8", "|u1", "<u2", ">u4", "<u8", "<f2", ">f4", "<f8", "<c8", ">c16", "|S4", "<U5", ">U5", "|V3"]


def test_all_types(spark, tmp_path):
    for t in TYPES:
        rng = np.random.default_rng(1)
        x = rng.integers(0, 256, (3, 4, np.dtype(t).itemsize), np.uint8).view(np.uint8).reshape(3, -1)
        if t[1] in "U":
            x = np.array([["añb", "🙂", "", "12345"]] * 3, t)
        elif t[1] in "fcb":
            x = np.arange(12).reshape(3, 4).astype(t)
        else:
            x = np.ascontiguousarray(x).view(t).reshape(3, 4)
        got = [r.value for r in read_npy(spark, save(tmp_path, "t.npy", x)).orderBy("flat_index").collect()]
        want = x.reshape(-1).tolist()
        if t[1] == "c":
            got = [complex(g["re"], g["im"]) for g in got]
        assert [bytes(g) if isinstance(g, (bytearray, bytes)) else g for g in map(lambda g: int(g) if t == "<u8" else g, got)] == want, t


def test_fixture_arrays(spark, tmp_path):
    nested = np.array([(2023, (("USA", 27360935), ("China", 17794782)))], [("year", "<u4"), ("countries", [("c1", [("country", "<U16"), ("gdp", "<u8")]), ("c2", [("country", "<U16"), ("gdp", "<u8")])])])
    frame = NDFrame.load(spark, save(tmp_path, "nested.npy", nested))
    assert int(frame.field("countries", "c1", "gdp").value(0)) == 27360935 and frame.field("countries", "c2", "country").value(0) == "China"
    with pytest.raises(NdError, match="/countries/c9"):
        frame.field("countries", "c9")
    path = save(tmp_path, "s.npy", np.array([("Sarah", (8.0, 7.0)), ("John", (6.0, 7.0))], [("name", "<U16"), ("grades", "<f8", (2,))]))
    assert [tuple(r) for r in read_npy(spark, path, "records").orderBy("flat_index").collect()] == [(0, "Sarah", [8.0, 7.0]), (1, "John", [6.0, 7.0])]
    assert read_npy(spark, path, "records", fields="grades").columns == ["flat_index", "grades"]
    assert [tuple(r)[2:] for r in inspect_fields(spark, path).collect()] == [(0, 64, 64), (64, 16, 80)]
    assert len(read_npy(spark, path, "raw").first()["value"]) == 80
    aligned = np.zeros(2, np.dtype([("a", "i1"), ("b", "<i4")], align=True))
    assert read_npy(spark, save(tmp_path, "al.npy", aligned), "records").columns == ["flat_index", "a", "b"]


def test_frame_operations(spark, tmp_path):
    x = np.arange(70).reshape(2, 5, 7)
    for order in "CF":
        frame = NDFrame.load(spark, save(tmp_path, f"{order}.npy", np.asarray(x, order=order)))
        assert frame.fortran_order == (order == "F") and frame.size == 70
        assert frame.value(1, 2, 3) == x[1, 2, 3] and frame.value(-1, -1, -1) == 69
        got = {(r.i0, r.i1, r.i2): r.value for r in frame.indexed().collect()}
        assert got == {k: v for k, v in np.ndenumerate(x)}
        assert [r["values"] for r in frame.rows().orderBy("i0").collect()] == x.reshape(2, -1).tolist()
        assert frame.max() == 69
        assert frame.set((0, 1, -1), 500).value(0, 1, 6) == 500
    frame = NDFrame.load(spark, str(tmp_path / "C.npy"))
    assert frame.limit_items(30).agg({"value": "sum"}).first()[0] == 435
    assert frame.reshape(7, 10).value(6, 9) == 69 and len(list(frame)) == 70
    assert frame.seek(68).count() == 2 and frame.seek(70).count() == 0
    for code, call in [(601, lambda: frame.reshape(3, 3)), (602, lambda: frame.get(2, 0, 0)), (603, lambda: frame.get(1)), (504, lambda: frame.seek(71))]:
        with pytest.raises(NdError) as e:
            call()
        assert int(e.value.code) == code
    assert NDFrame.load(spark, save(tmp_path, "p.npy", np.array([[1, 2, 3], [4, 5, 60]]))).text() == "[[ 1,  2,  3],\n [ 4,  5, 60]]"
    zero = NDFrame.load(spark, save(tmp_path, "z.npy", np.float64(2.5)))
    assert zero.shape == () and zero.value() == 2.5
    empty = NDFrame.load(spark, save(tmp_path, "e.npy", np.zeros((0, 3))))
    assert empty.max() is None and empty.items.count() == 0
    nan = NDFrame.load(spark, save(tmp_path, "n.npy", np.array([1.0, np.nan, 3.0])))
    assert np.isnan(nan.max()) and nan.max(skip_nan=True) == 3.0


def test_ranges_reach_the_reader(spark, tmp_path):
    path = save(tmp_path, "big.npy", np.arange(100_000))
    frame = NDFrame.load(spark, path, partitionBytes=8000)
    assert frame.items.rdd.getNumPartitions() == 100
    part = frame.apply(lambda v: v + 1).limit_items(10, begin=5000)
    assert part.rdd.getNumPartitions() == 1 and [r.value for r in part.collect()] == list(range(5001, 5011))
    assert frame.items.filter("flat_index = 99999 and value > 5").count() == 1 and frame.items.filter("flat_index > 99998").count() == 1
    assert frame.items.filter("flat_index > 5 or value = 1").count() == 99_995 and frame.items.count() == 100_000
    assert read_npy(spark, save(tmp_path, "m.npy", np.zeros((9, 2))), "rows", begin=7).count() == 2


def test_truncated_payload(spark, tmp_path):
    path = save(tmp_path, "cut.npy", np.arange(10))
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-8])
    with pytest.raises(Exception, match="data_size_mismatch"):
        read_npy(spark, path).count()
    assert [r.error_code for r in npy_catalog(spark, [path, str(tmp_path / "none.npy")]).orderBy("error_code").collect()] == [102, 405]
    assert read_properties(save(tmp_path, "ok.npy", np.zeros((2, 2))), lambda h: len(h.shape) == 3) is None


def test_save_round_trip(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as flat_index", "cast(id * 2 as int) as a", "concat('n', id) as b", "array(id, id + 1) as c", "struct(cast(id as double) as re, 0D as im) as z").repartition(7)
    path = save_npy(rows, str(tmp_path / "r.npy"), widths={"b": 6}, shapes={"c": (2,)})
    x = np.load(path)
    assert x["a"].tolist() == list(range(0, 2000, 2)) and x["b"][7] == "n7" and x["c"][9].tolist() == [9, 10] and x["z"][3] == 3
    with pytest.raises(NdError, match="file_exists"):
        save_npy(rows, path, widths={"b": 6}, shapes={"c": (2,)})
    save_npy(spark.range(6).selectExpr("id as flat_index", "id as value"), path, shape=(2, 3), typestr=">u4", overwrite=True)
    assert np.load(path).tolist() == [[0, 1, 2], [3, 4, 5]] and np.load(path).dtype == ">u4"
    for bad in (spark.range(1, 5), spark.createDataFrame([(0,), (0,), (2,)], "id long")):
        with pytest.raises(NdError, match="invalid_value"):
            save_npy(bad.selectExpr("id as flat_index", "id as value"), str(tmp_path / "bad.npy"))
    with pytest.raises(Exception, match="nulls"):
        save_npy(spark.range(2).selectExpr("id as flat_index", "if(id = 0, null, id) as value"), str(tmp_path / "null.npy"))
    assert not [p for p in tmp_path.iterdir() if "part" in p.name]


def test_shards(spark, tmp_path):
    folder = save_npy_shards(spark.range(100).selectExpr("id as flat_index", "id as value").repartition(4), str(tmp_path / "shards"))
    assert sorted(r.value for r in read_npy(spark, folder).collect()) == list(range(100))


def test_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    for t in ("|i1", "|u1", "<i2", ">i4", "<i8", "<u8", "<f4", ">f8"):
        x = rng.integers(0, 2, 3001).astype(t) if t in ("|i1",) else np.frombuffer(rng.bytes(3001 * np.dtype(t).itemsize), t) if t[1] != "f" else rng.normal(size=3001).astype(t)
        frame = NDFrame.load(spark, save(tmp_path, "b.npy", x))
        from stridelake.sources.blocks import summarize

        row = summarize(spark, frame.path, 1000).first()
        assert (row.n, row.n_nan) == (3001, 0) and float(row.low) == float(x.min()) and float(row.high) == float(x.max())
        assert row.total == sum(x.tolist()) if t[1] != "f" else np.isclose(row.total, x.astype(float).sum())
        assert frame.max() == x.max().item() and (t[1] == "f" or frame.sum() == sum(x.tolist()))
    frame = NDFrame.load(spark, save(tmp_path, "n.npy", np.array([[1.0, np.nan], [3.0, np.inf]])))
    assert np.isnan(frame.sum()) and np.isnan(frame.max()) and frame.max(skip_nan=True) == np.inf
    assert NDFrame.load(spark, save(tmp_path, "z.npy", np.zeros((0, 2)))).sum() is None
    swapped = NDFrame.load(spark, save(tmp_path, "s.npy", np.arange(12.0).reshape(3, 4))).apply_blocks(lambda v: v.byteswap(), str(tmp_path / "t.npy"))
    assert np.load(swapped.path).byteswap().tolist() == np.arange(12.0).reshape(3, 4).tolist()
    half = swapped.apply_blocks(lambda v: v.byteswap() / 2, str(tmp_path / "h.npy"), typestr="<f4")
    assert np.load(half.path).dtype == "<f4" and half.value(2, 3) == 5.5
    with pytest.raises(NdError, match="unavailable"):
        half.apply(lambda v: v).apply_blocks(lambda v: v, "x")
    with pytest.raises(Exception, match="item_size_mismatch"):
        half.apply_blocks(lambda v: v[1:], str(tmp_path / "bad.npy"))


def test_archives(spark, tmp_path):
    one, two = (spark.range(n).selectExpr("id as flat_index", "id as value") for n in (3, 4))
    path = save_npz(str(tmp_path / "a.npz"), {"one": one, "two": two})
    assert {k: v.tolist() for k, v in np.load(path).items()} == {"one": [0, 1, 2], "two": [0, 1, 2, 3]}
    assert all(i.compress_type == zipfile.ZIP_STORED for i in zipfile.ZipFile(path).infolist())
    frame = read_npz(spark, path)
    assert frame.columns == ["array_name", "flat_index", "value"] and find_array(frame, "two").count() == 4 and read_npz(spark, path, arrays="one").count() == 3
    with pytest.raises(NdError):
        find_array(frame, "three", required=True)
    packed = save_npz_compressed(str(tmp_path / "b.npz"), [one, (two, {"typestr": "<f4"})], level=9)
    assert np.load(packed)["arr_1"].dtype == "<f4"
    with pytest.raises(Exception, match="another type"):
        read_npz(spark, packed).count()
    with pytest.raises(NdError, match="duplicate"):
        save_npz(str(tmp_path / "c.npz"), [("x", one), ("x", two)])
    with pytest.raises(Exception, match="wrong_filetype"):
        read_npz(spark, save(tmp_path, "no.npy", np.zeros(2))).count()
    with pytest.raises(Exception, match="wrong_filetype"):
        read_npy(spark, path).count()


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    save(folder, "a.npy", np.arange(5.0))
    whole = decode_binary(spark.read.format("binaryFile").load(str(folder)), "double")
    assert sorted(r.value for r in whole.collect()) == [0, 1, 2, 3, 4]
    q = read_arrivals(spark, str(folder), "double").writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    save(folder, "b.npy", np.arange(3.0))
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrivals").count() == 8


def test_struct_is_little_endian():
    assert struct.unpack("<H", raw_file(GOOD)[8:10])[0] % 64 == 54
