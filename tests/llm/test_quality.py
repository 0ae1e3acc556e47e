import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from stridelake.llm import quality
from stridelake.llm.queries import op6_quality_rules

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t #|\x0b\x1c "), max_size=60))
def test_base_counts(text):
    assert quality.base_counts(text.encode(), len(text)) == plain(text)


def test_query_equals_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, want = texts[r.doc_id], plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        data = text.encode()
        assert r.whole_ratio == len(data) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data))
        assert not (r.kept and r.base_failed)
    assert sum(r.kept for r in rows) > 0.95 * sum(not r.base_failed for r in rows)


def test_verdicts_and_odd_rows(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900))
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(200))
    chant = " ".join(f"{k % 7}" * 40 + str(k) for k in range(900))
    rows = [(1, None, 0), (2, "", 0), (3, prose, 0), (4, noise, 0), (5, chant, 0), (6, "\n\n  \n", 0), (3, prose, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = [(r.doc_id, r.base_failed, r.kept) for r in quality.score_quality(df).collect()]
    assert sorted(got) == sorted([(1, True, False), (2, True, False), (3, False, True), (4, False, False), (5, False, False), (6, True, False), (3, False, True)])
    assert quality.score_quality(df).columns[:2] == ["doc_id", "text"]
    assert quality.score_quality(spark.createDataFrame([], df.schema)).count() == 0


def test_chunks_judge_all_of_long_texts():
    rng = random.Random(6)

    def words(letters, least, most, size):
        out = ""
        while len(out) < size:
            out += "".join(rng.choice(letters) for _ in range(rng.randint(least, most))) + " "
        return out[:size].encode()

    prose = lambda n: words("abcdefghij", 2, 7, n)
    code = words("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 60, 60, 4 * 4096)
    line = b"the very same line again and again\n" * 600
    judge = quality.BandJudge(quality.Bands())

    def passes(data):
        return judge.passes(data, *judge.ratios(data))

    assert not passes(prose(6 * 4096) + code)
    assert not passes(prose(24000) + line)
    assert passes(prose(10 * 4096))
    data = prose(2 * 4096) + code[:1000]
    last = len(data[4096:]) / len(judge.compress(data[4096:]))
    assert judge.ratios(data)[1][1:] == [last] and len(judge.ratios(data + code[:2000])[1]) == 3


def plain_limits(rows):
    """Limits of (bytes, whole, least, greatest) of clean texts, for the four length classes and for chunks."""
    old = quality.Bands()

    def limits(low, high, was):
        if not low:
            return was
        wide = 1.02 + 0.5 / math.sqrt(len(low))
        return max(was[0], np.quantile(low, 0.001) / wide), min(was[1], np.quantile(high, 0.999) * wide)

    whole, floor = [], 0
    for limit, low, high in old.whole:
        x = [r[1] for r in rows if floor < r[0] <= limit]
        whole.append((limit, *limits(x, x, (low, high))))
        floor = limit
    long = [r for r in rows if r[0] > 4096]
    return whole, limits([r[2] for r in long], [r[3] for r in long], old.chunk)


def test_verdicts_equal_a_plain_version(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    clean = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    compress = zstandard.ZstdCompressor(level=3, write_content_size=False).compress

    def ratios(text):
        data = text.encode()
        ends = [e for e in range(4096, len(data), 4096) if len(data) - e >= 2048] + [len(data)] if len(data) > 4096 else [len(data)]
        return len(data), len(data) / len(compress(data)), [len(data[a:e]) / len(compress(data[a:e])) for a, e in zip([0, *ends], ends)]

    def fails(text):
        n, _, _, _, repeat = plain(text)
        return n < 50 or 100 * repeat > 50 * n

    found = [ratios(texts[i]) for i in clean if i in texts and not fails(texts[i])]
    whole, chunk = plain_limits([(n, r, min(c), max(c)) for n, r, c in found])
    rows = op6_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = not r.base_failed
        if want:
            n, ratio, chunks = ratios(texts[r.doc_id])
            low, high = next(b[1:] for b in whole if n <= b[0])
            want = low <= ratio <= high
            if n > 4096:
                outside = sum(not chunk[0] <= c <= chunk[1] for c in chunks)
                want &= outside <= len(chunks) * (0.25 if len(chunks) >= 8 else 0.5)
        assert r.kept == want
    rejected = sum(not r.kept for r in rows if not r.base_failed)
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not zlib.crc32(str(r.doc_id).encode()) % 5}
    held = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
    assert rejected > 100 and sum(held) > 0.99 * len(held) > 300


def test_fitted_bands_reject_repetitive_and_random_texts(spark):
    sf, rng = "/root/testdata/sf0.1", random.Random(8)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    bands = quality.fit_bands(docs, labels)
    assert bands == quality.fit_bands(docs.repartition(5), labels.repartition(3))
    junk = []
    for n in (100, 400, 2000, 9000):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=12)) for _ in range(n)]
        cycle = [f"{rng.choice('abc')}{k % 11} item of the same list" for k in range(n // 4)]
        junk += [" ".join(words), " ".join(cycle)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(junk)], "doc_id long, text string")
    assert not any(r.kept for r in quality.score_quality(df, bands).collect())
    assert quality.fit_bands(docs, labels.limit(0)) == quality.fit_bands(docs.limit(0), labels) == quality.Bands()
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.fit_bands(docs, odd) == quality.Bands()


def test_bands_come_from_every_clean_row(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words[: rng.choice((40, 300, 3000))], k=rng.randint(55, 90))) for _ in range(12_000)] + [" ".join(rng.choices(words, k=rng.randint(700, 3000))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[9]), (None, texts[1])], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1) for k in range(len(texts))] + [(5, 0), (None, 1)], "doc_id long, quality int")
    judge, rows = quality.BandJudge(quality.Bands()), []
    for k, text in [*enumerate(texts), (3, texts[9])]:
        counts = quality.base_counts(text.encode(), len(text))
        if k != 5 and zlib.crc32(str(k).encode()) % 5 and not quality.base_fails(counts[0], counts[4]):
            whole, chunks = judge.ratios(text.encode())
            rows.append((len(text), whole, min(chunks), max(chunks)))
    assert len(rows) > 9000
    bands = quality.fit_bands(docs, labels)
    whole, chunk = plain_limits(rows)
    assert np.allclose(bands.whole, whole, rtol=1e-14, atol=0) and np.allclose(bands.chunk, chunk, rtol=1e-14, atol=0)
    measured = quality.measure(docs)
    assert quality.fit_measured(measured, labels) == bands
    scored = quality.score_quality(docs, bands)
    judged = quality.judge(measured, bands)
    assert judged.columns == scored.columns and judged.exceptAll(scored).count() == scored.exceptAll(judged).count() == 0
    assert {r.kept for r in judged.collect()} == {True, False}
