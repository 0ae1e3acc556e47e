"""Operator 4: toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_input, discard, held_out, importable, materialize, text_bytes

#: The three start values of zstandard's repeated offsets, which end the header of a trained dictionary: fixed values.
_REPEATS = (1).to_bytes(4, "little") + (4).to_bytes(4, "little") + (8).to_bytes(4, "little")
_EDGES = b".,!?;:*#%&$\"'()|"
#: Lengths of the byte sequences by which words that ordinary texts lack are told.
_GRAMS = (5, 7)

#: Texts are looked at in windows of these many bytes at least.
WINDOWS = (60, 100, 160)


def _spaced(data: bytes) -> bytes:
    """A text with one space for each run of white space, and one at both ends; b" " if there are no words."""
    words = data.split()
    return b" " + b" ".join(words) + b" " if words else b" "


def _cut(spaced: bytes, size: int) -> Iterator[bytes]:
    at, last = 0, len(spaced) - 1
    while at < last:
        end = spaced.find(b" ", min(at + size, last))
        yield spaced[at : end + 1]
        at = end


def windows(data: bytes, size: int) -> list[bytes]:
    """All of a text, cut at white space once a window has size bytes; white space becomes one space."""
    return list(_cut(_spaced(data), size))


def _words(data: bytes) -> set[bytes]:
    return {x for w in data.split() if len(x := w.strip(_EDGES)) >= 3}


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word
    return {word[i : i + n] for n in _GRAMS for i in range(len(word) - n + 1)}


def _once(texts: list[bytes]) -> list[bytes]:
    """The first of all texts whose words have the same smallest hash, as copies and nearly all near copies do."""
    return list({min((zlib.crc32(w) for w in _words(t)), default=0): t for t in reversed(texts)}.values())[::-1]


def toxic_samples(toxic: list[bytes], ordinary: list[bytes], times: float = 10.0, nats: float = 9.0) -> list[bytes]:
    """What each toxic text has that ordinary texts lack: its words with a sequence of bytes that is ``times`` as
    frequent in toxic texts, and in so many that chance explains it with exp(-nats) at most.

    Labels are of texts, and most of a toxic text is ordinary; a dictionary trained on all of it holds ordinary text.
    Chance is Chernoff's bound on how many of the texts with a sequence are toxic, so there is no least share of the
    toxic texts: those of a small language count too. Only sequences that toxic texts have are counted in ordinary ones.
    """
    seen = Counter(g for t in toxic for g in set().union(*map(_grams, _words(t))))
    seen = {g: n for g, n in seen.items() if n >= 3}
    fine = Counter(g for t in ordinary for g in set().union(*map(_grams, _words(t))) if g in seen)
    share = len(toxic) / (len(toxic) + len(ordinary))

    def telling(n: int, m: int) -> bool:
        if n / len(toxic) <= times * (m + 0.3) / len(ordinary):
            return False
        p = n / (n + m)
        return n * math.log(p / share) + (m * math.log((1 - p) / (1 - share)) if m else 0.0) >= nats

    own = {g for g, n in seen.items() if telling(n, fine[g])}
    found = ([w for x in t.split() if len(w := x.strip(_EDGES)) >= 3 and not own.isdisjoint(_grams(w))] for t in toxic)
    return [b" " + b" ".join(dict.fromkeys(words)) + b" " for words in found if words]


def train(samples: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Header and content of the dictionary that zstandard trains; where it can't, no header and the samples' end."""
    try:
        made = zstandard.train_dictionary(size, samples).as_bytes()
        at = made.index(_REPEATS) + len(_REPEATS)
        return made[:at], made[at:]
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(samples)[-size:]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes], ordinary_bytes: int = 16 << 10, toxic_bytes: int = 2 << 10, max_windows: int = 15_000, seed: int = 7) -> tuple[bytes, bytes]:
    """The dictionary that zstandard trains on windows of ordinary texts, and the one for toxic texts.

    zstandard trains the toxic one apart, on toxic_samples(). To express the ordinary text around, it stands behind
    the ordinary content, with the ordinary header: a window's two lengths then differ by what toxic content saves
    and not by chance differences of ordinary content. At most max_windows ordinary windows, drawn at random from
    all, are used; copies count once in both classes.
    """
    toxic, ordinary = _once(toxic), _once(ordinary)
    pieces = [w for x in ordinary for w in windows(x, 160)]
    random.Random(seed).shuffle(pieces)
    header, content = train(pieces[:max_windows], ordinary_bytes)
    samples = toxic_samples(toxic, ordinary)
    _, own = train(samples, min(toxic_bytes, max(512, sum(map(len, samples)) // 6)))
    return header + content, header + content + own


class Distances:
    """Lengths under the ordinary dictionary minus those under the toxic one, summed up over the windows of a text."""

    def __init__(self, dictionaries: tuple[bytes, bytes], sizes: tuple[int, ...] = WINDOWS):
        self.sizes, self._kept, made = sizes, [], []
        # The tables have room for all of the dictionaries' content, else what comes first is forgotten.
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        for data in dictionaries:
            full = data[:4] == b"\x37\xa4\x30\xec"
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self._kept.append(d)
            made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress)
        self.fine, self.bad = made

    def windows(self, data: bytes, size: int) -> list[int]:
        """The difference for each window of a text."""
        fine, bad = self.fine, self.bad
        return [len(fine(w)) - len(bad(w)) for w in _cut(_spaced(data.lower()), size)]

    def features(self, texts: Iterable[bytes]) -> np.ndarray:
        """A row per text: for each size the three largest differences, sums and counts, whole and per window."""
        found: list[list[int]] = [[] for _ in self.sizes]
        counts: list[list[int]] = [[] for _ in self.sizes]
        lengths = []
        for data in texts:
            lengths.append(len(data))
            for size, d, n in zip(self.sizes, found, counts):
                own = self.windows(data, size) or [0]
                d += own
                n.append(len(own))
        if not lengths:
            return np.zeros((0, 0))
        columns = []
        for size, d, n in zip(self.sizes, found, counts):
            d, n = np.array(d), np.array(n)
            starts = np.cumsum(n) - n
            falling = d[np.lexsort((-d, np.repeat(np.arange(len(n)), n)))]
            top = [np.where(n > k, falling[np.minimum(starts + k, len(d) - 1)], 0) for k in range(3)]
            stats = np.array([*top, *(np.add.reduceat(x, starts) for x in (d, np.maximum(d - 1, 0), (d >= 2) * 1, (d >= 3) * 1, (d <= -2) * 1))], float)
            share = np.maximum(1.0, np.array(lengths) / size)
            columns += [*stats, *(stats / share), *np.log1p(np.maximum(0.0, stats)), np.log(share), 1 / share]
        return np.array([*columns, np.ones(len(lengths))]).T


@dataclass(frozen=True)
class ToxicityModel:
    dictionaries: tuple[bytes, bytes]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((features - self.mean) / self.scale) @ self.weights, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method, with steps halved until the loss falls: where the thresholds on the
    distances lie, for each length of text."""
    ridge = 1e-3 + 1 / len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[-1], scale[-1] = 0.0, 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0.0, np.where(y > 0, -1.0, 1.0) * (z @ w)).mean() + ridge * (w @ w) / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-7:
            step /= 2
        w, before, now = w - step, now, new
        if before - now < 1e-9:
            break
    return mean, scale, w


def learning_sample(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int], max_bytes: int) -> tuple[DataFrame, list[np.ndarray]]:
    """A table (y, key, text) of at most max_rows rows of each label, the first by key, a hash of id and text; and the
    keys of each label in order.

    Ids whose labels differ are not used. Rows that repeat an id count as rows, and equal rows once, so max_rows *
    max_bytes bounds the sample. The rows are the same in every run.
    """
    y = F.col("toxic").cast("int")
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(y).alias("y"), F.max(y).alias("__y")).filter("y = __y").drop("__y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # A preselection by id of twice as many: a bounded table, sent to all tasks; texts that are too long are few.
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    ids = known.filter(share < F.when(F.col("y") == 0, 2.0 * max_rows[0] / max(1, counts.get(0, 0))).otherwise(2.0 * max_rows[1] / max(1, counts.get(1, 0))))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    few = materialize(texts.join(F.broadcast(ids), "doc_id").distinct().select("y", F.xxhash64("doc_id", "text").alias("key"), "text"), "toxicity-sample")
    found = few.select("y", "key").collect()
    keys = [np.sort(np.array([r["key"] for r in found if r["y"] == label], np.int64))[:n] for label, n in enumerate(max_rows)]
    last = [F.lit(int(k[-1]) if len(k) else None).cast("long") for k in keys]
    sample = few.filter(F.col("key") <= F.when(F.col("y") == 0, last[0]).otherwise(last[1]))
    sample.shared_path = few.shared_path
    return sample, keys


def _sample_rows(sample: DataFrame) -> list[tuple[int, bytes]]:
    """(label, text with A-Z in lower case) by key. A sixteenth of the texts is in the driver's JVM at a time."""
    rows = sample.select("y", "key", F.col("text").cast("binary").alias("text")).coalesce(16).toLocalIterator()
    return [(label, text) for _, text, label in sorted((r["key"], bytes(r["text"]).lower(), r["y"]) for r in rows)]


def learning_rows(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int], max_bytes: int) -> list[tuple[int, bytes]]:
    """learning_sample() as (label, text with A-Z in lower case), in the same order in every run."""
    sample, _ = learning_sample(docs, labels, max_rows, max_bytes)
    rows = _sample_rows(sample)
    discard(sample)
    return rows


def _sample_features(sample: DataFrame, keys: list[np.ndarray], whole: tuple[bytes, bytes], apart: list[tuple[bytes, bytes] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all of the sample under the dictionaries of whole, and of each part (by the rank of the
    key within its label) under those of apart; without any, the part is left out. The tasks read the texts from the
    sample's table; the driver sends dictionaries only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, others = Distances(whole), [made and Distances(made) for made in apart]
        for batch in batches:
            if not batch.num_rows:
                continue
            y, key, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), list(text_bytes(batch.column(2)))
            part = np.where(y == 0, *(np.searchsorted(k, key) for k in keys)) % len(others)
            labels, x = [y], [full.features(texts)]
            for k, distances in enumerate(others):
                own = np.flatnonzero(part == k)
                if distances and len(own):
                    labels.append(y[own])
                    x.append(distances.features(texts[i] for i in own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(labels), pa.int32()), pa.array(list(np.concatenate(x)), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.select("y", "key", "text").mapInArrow(run, "y int, x array<double>").toArrow()
    return rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1), rows["y"].to_numpy().astype(float)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = (9000, 4000), max_bytes: int = 32 << 10, folds: int = 3) -> ToxicityModel | None:
    """Fit on a bounded sample: at most max_rows labelled documents of each label (0, 1), each of at most max_bytes.

    Only rows that held_out() spares are used; see learning_sample(). The dictionaries come from the whole sample. The
    thresholds are fitted to its distances under them and, as much, to those of each part of the sample under
    dictionaries that the other parts give, which no text of the part was trained into. None where a label is missing, as in
    empty tables.
    """
    importable(docs.sparkSession)
    sample, keys = learning_sample(docs, labels, max_rows, max_bytes)
    rows = _sample_rows(sample)
    texts = [[t for y, t in rows if y == label] for label in (0, 1)]
    del rows
    if not all(texts):
        discard(sample)
        return None
    dictionaries = train_dictionaries(texts[1], texts[0])
    others = [[[t for i, t in enumerate(ts) if i % folds != k] for ts in texts] for k in range(folds)]
    apart = [train_dictionaries(toxic, ordinary) if toxic and ordinary else None for ordinary, toxic in others]
    del texts, others
    x, y = _sample_features(sample, keys, dictionaries, apart)
    discard(sample)
    order = np.lexsort((*x.T, y))  # as the rows' order differs from run to run, and sums with it
    return ToxicityModel(dictionaries, *_calibrate(x[order], y[order]))


def _scores(docs: DataFrame, carry: list[str], text_col: str, model: ToxicityModel) -> DataFrame:
    """carry, and the score."""
    docs, at, ddl = arrow_input(docs, carry, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.dictionaries)
        for batch in batches:
            x = distances.features(text_bytes(batch.column(at)))
            made = pa.array(model.score(x) if len(x) else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], made], names=[*carry, "score"])

    return docs.mapInArrow(run, f"{ddl}, score double")


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: all) with score (0 to 1) and predicted (score >= 0.5) for every whole text.

    Null and empty texts have no windows and get the score of an empty text. Without a model all scores are 0. A
    text is in memory once and its windows one at a time; there is no shuffle. Repeated rows get equal scores. An
    empty table gives no rows.
    """
    importable(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    if model is None:
        out = docs.select(*carry, F.lit(0.0).alias("score"))
    else:
        out = _scores(docs, carry, text_col, model)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
