import hashlib
import re
from collections import defaultdict

import pytest

from stridelake.llm import mixing
from stridelake.llm.queries import op3_mix_sources

SF = "/root/testdata/sf0.001"


def plain(rows):
    """(doc_id, source, size, source_size, target, taken) by repeated sharing, as the contract words it."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        above = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    out, at = [], defaultdict(int)
    for i, s, n in sorted(sized, key=lambda r: (hashlib.md5(f"mix-1|{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[2])):
        budget = min(round(target[s]), 2 * sizes[s])
        whole, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        out.append((i, s, n, sizes[s], target[s], whole * n + min(max(rest - at[s], 0), n)))
        at[s] += n
    return out


ROWS = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "one  two\tthree\n", "é"), (5, "z " * 300, None), (6, "q " * 40, None),
    (7, "same words", "y"), (7, "same words", "y"), (8, "w " * 1000, "y"), (None, "no id here", "x"), (9, " non breaking", "Z"), (10, "v " * 77, ""),
]


def test_equals_plain_version(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, source string, size int")
    got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(df).collect()]
    want = plain(ROWS)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and g[5] == w[5]


def test_query_budgets(spark):
    rows = op3_mix_sources(spark, SF).collect()
    again = op3_mix_sources(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=1e-3)


def test_documents_are_repeated(spark):
    df = spark.createDataFrame([(*r, "kept") for r in ROWS], "doc_id long, text string, source string, __pass string")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
        assert r["__pass"] == "kept"
    want = defaultdict(int)
    for i, _, n, _, _, taken in plain(ROWS):
        if n:
            want[i] += taken // n + (2 * (taken % n) >= n and taken % n > 0)
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}


def test_repeated_rows_at_the_end_of_the_budget(spark):
    rows = [(1, "one two three four five six seven eight", "a")] * 10 + [(2, "w " * 70, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = defaultdict(int)
    for r in mixing.mix_sources(df).collect():
        taken[r.doc_id] += r.taken
    got = defaultdict(int)
    for r in mixing.mix_documents(df).collect():
        got[r.doc_id] += len(r.text.split())
    assert abs(got[1] - taken[1]) <= 4 and abs(got[2] - taken[2]) <= 35


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == 0 and mixing.mix_documents(df).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], df.schema)
    assert {(r.target, r.taken) for r in mixing.mix_sources(nothing).collect()} == {(0.0, 0)}
