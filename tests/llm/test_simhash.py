import random
import re

import numpy as np
import xxhash

from stridelake.llm import simhash
from stridelake.llm.common import materialize
from stridelake.llm.components import connected_components
from stridelake.llm.queries import op5_simhash_dedup

SF = "/root/testdata/sf0.001"


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_force(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[:k] if (x ^ y).bit_count() <= 3]
    return {(i, f"{p:016x}", c) for (i, p), c in zip(prints, map(plain_components(links, [i for i, _ in prints]).get, [i for i, _ in prints]))}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in op5_simhash_dedup(spark, SF).collect()} == brute_force(rows)


def test_odd_rows(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "ONE two"), (7, "É é"), (8, " ".join(base)), (9, " ".join(base[:-1] + ["other"])), (10, " ".join(base)), (10, " ".join(base)), (11, " ".join(base * 200))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(materialize(simhash.fingerprints(df), "t")).collect()
    want = brute_force(rows)
    assert len(got) == len(rows) and {(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got} == want


def test_near_pairs_lose_nothing(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            prints.add(y)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = sorted((r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect())
    x = np.array(signed, np.int64)
    d = np.bitwise_count((x[:, None] ^ x[None]).view(np.uint64))
    want = [(signed[i], signed[j]) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 3]
    assert len(want) > 500 and got == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (301, 302), (302, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components([p for p in links if p[0] != p[1]], {x for p in links for x in p} - {300})
    assert got == want
    df = spark.createDataFrame([p for p in links if p[0] > 40], "a long, b long")
    assert {r.node: r.root for r in connected_components(df).collect()} == {n: c for n, c in want.items() if n > 40}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(materialize(simhash.fingerprints(df), "t")).collect() == []
