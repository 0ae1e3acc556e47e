import random

import numpy as np
import zstandard

from stridelake.llm import embeddings, langid, tokencount, toxicity
from stridelake.llm.queries import op4_toxicity, op7_embedding_dedup, op8_token_counts, op10_language_id

SF = "/root/testdata/sf0.01"


# Language identification


def test_languages_held_out(spark):
    rows = op10_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_languages_of_odd_texts(spark):
    rng = random.Random(1)
    words = {"en": "the of and with that this there which".split(), "de": "der die und nicht über für ein schön".split(), "fr": "le une été garçon est que pour où".split(), "ru": "это как для что был они".split()}
    train = [(k, " ".join(rng.choices(words[lang], k=30)), lang) for k, lang in enumerate([*words] * 40)]
    odd = [(1001, None, "en"), (1002, "", None), (1003, "123 -- !?", "en"), (1004, "这是", None), (None, "the of and", "en"), (1005, "der die " * 40000, None), (1006, "the of and", "en"), (1006, "the of and", "en")]
    df = spark.createDataFrame([(*r, 7) for r in train + odd], "doc_id long, text string, lang string, score int")
    model = langid.train_languages(df)
    assert set(model.families.classes) == {"germanic", "romance", "slavic"} and model.within["germanic"].classes == ["de", "en"]
    out = langid.identify_languages(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert [g[1:] for g in got if g[0] in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert {g[1] for g in got if g[0] == 1006 or g[0] is None} == {"en"} and [g[1] for g in got if g[0] == 1005] == ["de"]
    nothing = langid.identify_languages(df, langid.train_languages(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify_languages(df.limit(0), model).count() == 0


def test_features_do_not_depend_on_blocks():
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdéßя", k=rng.randint(1, 9))) for _ in range(3000))
    one = langid.ngram_features(text, 12)
    for block in (7, 1000, 4096):
        assert np.array_equal(langid.ngram_features(text, 12, block), one)


def test_language_sample_is_bounded_and_the_same_in_every_run(spark):
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choices(words, k=12)), lang) for lang, words in (("en", "the of and with".split()), ("de", "der die und nicht".split()), ("xx", ["zzz"])) for k in range(150)]
    rows += [(1, f"the of {k}", "en") for k in range(400)]  # one id, many rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = [langid.train_languages(d, max_rows=40, max_languages=2) for d in (df, df.repartition(5))]
    assert made[0].families.classes == ["germanic"] and made[0].within["germanic"].classes == ["de", "en"]
    assert np.array_equal(made[0].within["germanic"].w, made[1].within["germanic"].w)


def test_machines_vote():
    rng = np.random.default_rng(0)
    centers = np.eye(4) * 3
    names = np.array(list("abcd") * 50)
    x = np.array([centers["abcd".index(n)] for n in names]) + rng.normal(0, 0.3, (200, 4))
    m = langid.Machines.fit(x, names)
    assert len(m.pairs) == 6 and np.mean([m.best(v)[0] == n for v, n in zip(x, names)]) > 0.99


# Toxicity


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in op4_toxicity(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    labels = [(rows[r.doc_id].predicted, r.toxic, rows[r.doc_id].held_out) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert np.mean([p == y for p, y, held in labels if held]) > 0.85
    assert np.mean([p == y for p, y, held in labels if not held]) > 0.95


def small_corpus(n=400):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["zworthless", "zmoronic", "zidiotic", "zscummy"]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(20, 120))
        if k % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    return docs, labels


def test_toxicity_learns_and_takes_odd_rows(spark):
    docs, labels = small_corpus()
    odd = [(5001, None), (5002, ""), (5003, "   "), (None, docs[1][1]), (1, docs[1][1]), (5004, docs[0][1].upper()), (5005, " ".join(t for _, t in docs) * 5)]
    df = spark.createDataFrame([(*d, 1.5) for d in docs + odd], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels + [(None, 1), (7000, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df, lab)
    out = toxicity.score_toxicity(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = [(r.doc_id, r.predicted, r.score) for r in out.collect()]
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    assert np.mean([p == truth[i] for i, p, _ in got if i in truth]) > 0.95
    assert len({s for i, _, s in got if i in (5001, 5002, 5003)}) == 1 and [p for i, p, _ in got if i in (5002, 5004)] == [0, 1]
    assert toxicity.train_toxicity(df, lab.limit(0)) is None
    assert {r.score for r in toxicity.score_toxicity(df, None).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_toxic_samples_are_what_few_toxic_texts_have():
    rng = random.Random(4)

    def word(letters):
        return "".join(rng.choice(letters) for _ in range(8))

    plain, bad = [word("abcdefghijklm") for _ in range(20000)], [word("nopqrstuvwxyz") for _ in range(60)]

    def texts(n, k):
        return [" ".join(rng.choices(plain, k=60) + [bad[(k * at + i) % len(bad)] for i in range(k)]).encode() for at in range(n)]

    toxic, ordinary = texts(400, 3), texts(1200, 0)
    samples = toxicity.toxic_samples(toxic, ordinary)
    found = [w for s in samples for w in s.split()]
    assert {w.encode() for w in bad} <= set(found) and sum(w.decode() in bad for w in found) > 0.98 * len(found)  # the rest by chance
    fine, own = toxicity.train_dictionaries(toxic, ordinary)
    distances = toxicity.Distances((fine, own))
    assert distances.features(texts(50, 3))[:, 0].min() > np.median(distances.features(texts(50, 0))[:, 0])


def learning_texts(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.learning_rows(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), (9000, 4000), 32 << 10)
    return [[t for y, t in rows if y == label] for label in (0, 1)]


def test_each_dictionary_is_what_zstandard_trains_on_its_class(spark):
    ordinary, toxic = learning_texts(spark)
    fine, own = toxicity.train_dictionaries(toxic, ordinary)
    pieces = [w for t in toxicity._once(ordinary) for w in toxicity.windows(t, 160)]
    random.Random(7).shuffle(pieces)
    assert fine == zstandard.train_dictionary(16 << 10, pieces[:15_000]).as_bytes()
    samples = toxicity.toxic_samples(toxicity._once(toxic), toxicity._once(ordinary))
    trained = zstandard.train_dictionary(min(2 << 10, sum(map(len, samples)) // 6), samples).as_bytes()
    assert own[: len(fine)] == fine and len(own) > len(fine) + 512 and trained.endswith(own[len(fine) :])


def test_scores_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    fine, bad = (zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d)) for d in model.dictionaries)
    for r in docs.limit(150).collect():
        data, row = r.text.encode().lower(), []
        words = data.split()
        for size in (60, 100, 160):
            cuts, at = [], 0
            while at < len(words):  # windows by words
                n, end = 1 + len(words[at]), at + 1
                while n < size and end < len(words):
                    n, end = n + 1 + len(words[end]), end + 1
                cuts.append(b" " + b" ".join(words[at:end]) + b" ")
                at = end
            d = sorted((len(fine.compress(w)) - len(bad.compress(w)) for w in cuts), reverse=True) or [0]
            stats = np.array([*(d + [0, 0])[:3], sum(d), sum(max(x - 1, 0) for x in d), sum(x >= 2 for x in d), sum(x >= 3 for x in d), sum(x <= -2 for x in d)], float)
            share = max(1.0, len(data) / size)
            row += [*stats, *(stats / share), *np.log1p(np.maximum(0, stats)), np.log(share), 1 / share]
        z = (np.array([*row, 1.0]) - model.mean) / model.scale
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))) < 1e-9


def test_learning_rows_are_bounded_and_the_same_in_every_run(spark):
    docs = [(k, f"text {k} again") for k in range(300)] * 3 + [(1, f"other {k}") for k in range(500)]
    labels = [(k, k % 2) for k in range(300)] + [(k, 1 - k % 2) for k in range(0, 300, 10)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.learning_rows(df, lab, (40, 60), 1000)
    assert [sum(y == label for y, _ in rows) for label in (0, 1)] == [40, 60]
    assert rows == toxicity.learning_rows(df.repartition(7), lab.repartition(3), (40, 60), 1000)
    assert not any(t.startswith(b"text") and int(t.split()[1]) % 10 == 0 for _, t in rows)
    every = toxicity.learning_rows(df, lab, (9000, 9000), 1000)
    assert len(every) == len(set(every))


def test_training_sends_no_texts_from_the_driver(spark, monkeypatch):
    docs, labels = small_corpus(900)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.learning_rows(df, lab, (300, 90), 1000)

    def refuse(*_, **__):
        raise AssertionError("rows of the driver as a table")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    model = toxicity.train_toxicity(df, lab, (300, 90), 1000)
    ordinary, toxic = ([t for y, t in rows if y == label] for label in (0, 1))
    assert len(ordinary) == 300 and len(toxic) == 90
    x, y = [], []
    for k in (0, 1, 2, None):
        own, others = ([[t for i, t in enumerate(ts) if k is None or (i % 3 == k) == mine] for ts in (ordinary, toxic)] for mine in (True, False))
        made = toxicity.train_dictionaries(*(others if k is not None else own)[::-1])
        x += list(toxicity.Distances(made).features(own[0] + own[1]))
        y += [0.0] * len(own[0]) + [1.0] * len(own[1])
    assert model.dictionaries == made
    x, y = np.array(x), np.array(y)
    order = np.lexsort((*x.T, y))
    for got, want in zip((model.mean, model.scale, model.weights), toxicity._calibrate(x[order], y[order])):
        assert np.array_equal(got, want)


def test_windows_cover_the_text():
    text = "a bb\n ccc\t" * 500 + "x" * 1000
    assert b" ".join(toxicity.windows(text.encode(), 64)).split() == text.encode().split()


# Token counts


def test_counts_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = tokencount.unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    low = min(s for _, s in pieces)
    t = Tokenizer(models.Unigram([("<unk>", low), *pieces], 0))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[ \t\n\x0b\f\r]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=True)])
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op8_token_counts(spark, SF).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows.items()}
    odd = ["", "  ", "日本語の 本", "🙂🙂a🙂", "ￂ\x00b", "a" * 3000, "ñandú\n\tÖl"]
    df = spark.createDataFrame([(k, x, "n") for k, x in enumerate([None, *odd])], "doc_id long, text string, n_tokens string")
    out = tokencount.count_tokens(df, pieces, cache_words=3)
    assert out.columns == ["doc_id", "text", "n_tokens", "best_score"]
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {0: 0} | {k + 1: len(t.encode(x, add_special_tokens=False).ids) for k, x in enumerate(odd)}
    assert tokencount.count_tokens(df.limit(0), pieces).count() == 0


def test_ties_and_unknown_runs():
    from tokenizers import Tokenizer, models

    rng = random.Random(4)
    for _ in range(60):
        pieces = list({"".join(rng.choices("abc", k=rng.randint(1, 4))): float(-rng.randint(1, 3)) for _ in range(10)}.items())
        t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], 0))
        count = tokencount.CountingViterbi(pieces)
        for _ in range(20):
            text = "".join(rng.choices("abcd", k=rng.randint(1, 14)))
            assert count(text)[1] == len(t.encode(text).ids), (pieces, text)


def test_one_very_long_word_takes_little_memory():
    import tracemalloc

    rng = random.Random(3)
    pieces = [("a", -1.0), ("ab", -1.5), ("bca", -2.0), ("c", -3.0), ("cabca", -2.5)]
    count = tokencount.CountingViterbi(pieces)
    text = "".join(rng.choices("abcd", k=50_000))
    whole = tokencount.CountingViterbi(pieces)
    whole.keep = 1 << 40
    assert count(text) == whole(text)
    tracemalloc.start()
    count("abcad" * 600_000)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


# Embeddings


def plain_links(rows, cosine=0.9):
    vectors = []
    for i, v in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None))
    n, links = len(rows), [0] * len(rows)
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            x, y = vectors[a][1], vectors[b][1]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, links[a], least[find(a)], i == least[find(a)]) for a, (i, _) in enumerate(rows))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        base = rng.normal(size=16)
        rows += [(k * 10 + j, (base + rng.normal(0, s, 16)).tolist()) for j, s in enumerate([0, 0.05, 0.2, 0.3][: 1 + k % 4])]
    dense = rng.normal(size=16)
    rows += [(5000 + k, (dense + rng.normal(0, 0.1, 16)).tolist()) for k in range(70)] + [(6000 + k, dense.tolist()) for k in range(30)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [1.0, None] * 8), (7004, [float("nan")] * 16), (7005, [float("inf")] + [0.0] * 15), (7006, [1.0, 2.0]), (7007, [2.0, 4.0]), (7008, [-0.0] + [1.0] * 15), (7009, [0.0] + [1.0] * 15)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    want = plain_links(rows)
    for block in (16, 512):
        got = sorted(map(tuple, embeddings.near_duplicate_vectors(df, miss=1e-6, block=block).collect()))
        assert got == want
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0
    assert {r.n_links for r in embeddings.near_duplicate_vectors(df.filter("vec_id between 7000 and 7005")).collect()} == {0}


def test_lengths_beyond_doubles(spark):
    rows = [(1, [1e200] * 4), (2, [1e-200] * 4), (3, [1.0] * 4), (4, [1e-320, 0.0, 0.0, 0.0]), (5, [5.0, 0.0, 0.0, 0.0]), (6, [1.7e308] * 4), (7, [0.1] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {i: (4, 1) for i in (1, 2, 3, 6, 7)} | {4: (1, 4), 5: (1, 4)}


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {i: int(n) - 1 for (i, _), n in zip(rows, (x @ x.T >= 0.9).sum(1))}
    got = {r.vec_id: r.n_links for r in op7_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    assert all(got[i] <= true[i] for i in true) and sum(got.values()) >= 0.99 * sum(true.values())


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2, 64))
    x[1] = x[0] * 0.8 + x[1] * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    values, inside = [], []
    for k in range(400):
        turned, signs, factors = embeddings.encode(x, embeddings.rotation(64, k))
        v, half = embeddings.estimate(signs, factors, turned, 4.0)
        values.append(v[0, 1])
        inside.append(abs(v[0, 1] - x[0] @ x[1]) <= half[0, 0])
    assert abs(np.mean(values) - x[0] @ x[1]) < 0.02 and np.mean(inside) > 0.995
