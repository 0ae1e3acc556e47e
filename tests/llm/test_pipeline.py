import zlib
from collections import Counter

import corpus_pipeline as P
from stridelake.llm import quality, toxicity
from stridelake.llm.common import held_out
from tests.llm.test_mixing import plain as plain_mix
from tests.llm.test_packing import check_layout
from tests.llm.test_simhash import brute_force

SF = "/root/testdata/sf0.001"


def stage(spark, name, docs):
    return dict(P.STAGES)[name](spark, docs, SF)


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    distances = toxicity.Distances(model.dictionaries)
    want = {i for i, r in rows.items() if model.score(distances.features([r.text.encode()]))[0] < 0.5}
    kept = stage(spark, "toxicity", docs).cache()
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns and kept.count() == len(want)

    judge, want = quality.BandJudge(quality.fit_bands(kept, spark.read.parquet(f"{SF}/labels.parquet"))), set()
    for r in kept.collect():
        data = r.text.encode()
        counts = quality.base_counts(data, len(r.text))
        if not quality.base_fails(counts[0], counts[4]) and judge.passes(data, *judge.ratios(data)):
            want.add(r.doc_id)
    good = stage(spark, "quality", kept).cache()
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    groups = brute_force([(r.doc_id, r.text) for r in good.collect()])
    single = stage(spark, "near_duplicates", good).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in groups}) and single.columns == docs.columns

    mixed = stage(spark, "mixing", single).cache()
    got = Counter(r.doc_id for r in mixed.collect())
    for i, _, n, _, _, taken in plain_mix([(r.doc_id, r.text, r.source) for r in single.collect()]):
        assert got[i] == taken // n + (taken % n > 0 and 2 * (taken % n) >= n)
    assert mixed.columns == docs.columns

    out = stage(spark, "packing", mixed).collect()
    check_layout(out)
    starts = Counter(r.doc_id for r in out if r.start == 0)
    assert starts == got


def test_run(spark):
    rows = P.run(spark, SF).collect()
    used, n, _ = check_layout(rows)
    assert rows and 1 - used / (n * 1024) < 0.05


def test_odd_rows_and_clashing_names(spark):
    prose = " ".join(f"word{k * k % 97} and{k}" for k in range(80))
    rows = [(None, prose, None, None, None), (2, prose, "en", "a", 1), (2, prose, "en", "a", 1), (1, prose, "en", None, 1), (3, None, None, "a", None), (4, "", "en", "b", 0), (5, prose.upper() + " x" * 40, "en", "a", 3)]
    df = spark.createDataFrame([(*r, "s", "f") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, fp string")
    good = stage(spark, "quality", df)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in good.collect()) == [(False, 1), (False, 2), (False, 2), (False, 5), (True, 0)]
    single = stage(spark, "near_duplicates", good)
    assert single.columns == df.columns and [(r.doc_id, r.score, r.fp) for r in single.orderBy("doc_id").collect()] == [(1, "s", "f"), (5, "s", "f")]
    same = stage(spark, "near_duplicates", df.filter("doc_id = 2 or doc_id is null"))
    assert [r.doc_id for r in same.collect()] == [2]
    for name, _ in P.STAGES:
        assert stage(spark, name, df.limit(0)).count() == 0


def test_held_out_rule(spark):
    rows = spark.range(200).selectExpr("id as doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out()).first()[0] is False
