"""Operator 10: language identification by hierarchical discrimination."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_input, held_out, importable

# Families of languages by ISO 639-1 code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "gu", "pa"),
    "semitic": ("ar", "he", "mt"),
    "celtic": ("ga", "cy", "gd", "br"),
    "dravidian": ("ta", "te", "kn", "ml"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def ngram_features(text: str, bits: int, block: int = 1 << 20) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 4-byte sequences of the lower-case UTF-8 text."""
    data = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass")
    counts, mask = np.zeros(1 << bits), np.uint32((1 << bits) - 1)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), block):
        b = raw[at : at + block + 3].astype(np.uint32)
        starts = min(block, len(raw) - at)  # sequences that start in the overlap belong to the next block
        h = np.zeros_like(b)
        for n in range(4):  # h: hash of the n + 1 bytes that start here
            if len(b) <= n:
                break
            h = (h[: len(b) - n] * np.uint32(0x01000193)) ^ (b[n:] + np.uint32(n * 257))
            mixed = h[:starts] * np.uint32(0x9E3779B1)
            counts += np.bincount((mixed >> np.uint32(32 - bits)) & mask, minlength=1 << bits)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-9)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss), by dual coordinate descent. y: 1 or -1."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2  # classes weigh the same
    norms = (x * x).sum(1) + 1.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w + b)) / norms[i], 0.0), cost * share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


@dataclass(frozen=True)
class Machines:
    """One-versus-one machines for a set of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    w: np.ndarray
    b: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, names: np.ndarray) -> Machines:
        classes = sorted(set(names.tolist()))
        pairs = list(combinations(range(len(classes)), 2))
        made = []
        for i, j in pairs:
            rows = (names == classes[i]) | (names == classes[j])
            made.append(train_svm(x[rows], np.where(names[rows] == classes[i], 1.0, -1.0)))
        return Machines(classes, pairs, np.array([w for w, _ in made]).reshape(len(pairs), x.shape[1]), np.array([b for _, b in made]))

    def best(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most votes (ties: the larger sum of margins, then the first), and how sure it is."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.w @ x + self.b
        votes, sums, least = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for (i, j), m in zip(self.pairs, margins):
            votes[i if m >= 0 else j] += 1
            for k, v in ((i, m), (j, -m)):
                sums[k] += v
                least[k] = min(least[k], v)
        k = max(range(len(self.classes)), key=lambda c: (votes[c], sums[c], -c))
        return self.classes[k], float(1 / (1 + np.exp(-2 * np.clip(least[k], -15, 15))))


@dataclass(frozen=True)
class LanguageModel:
    bits: int
    families: Machines
    within: dict[str, Machines]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNDETERMINED, 0.0
        x = ngram_features(text, self.bits)
        family, sure = self.families.best(x)
        lang, surer = self.within[family].best(x)
        return lang, sure * surer


def train_languages(docs: DataFrame, max_rows: int = 1500, max_bytes: int = 32 << 10, bits: int = 12, max_languages: int = 200, max_total: int = 12_000) -> LanguageModel | None:
    """Fit on a bounded sample: at most max_rows texts of each language, each of at most max_bytes, of the
    max_languages most frequent languages (ties: by name), and fewer of each where that made over max_total texts.

    Only rows that held_out() spares and that have a language and a letter are used; the sample of a language is the
    first of its different texts by a hash of id and text, so reruns agree and rows that repeat an id count like any
    other. A language's candidates are preselected by id, twice as many as needed, so no task ranks a whole language.
    At most max_total texts reach the driver. None where there are no such rows, as in an empty table.
    """
    importable(docs.sparkSession)
    known = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text").between(1, max_bytes)))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    max_rows = max(1, min(max_rows, max_total // len(counts)))
    rate = docs.sparkSession.createDataFrame([(r["lang"], 2.0 * max_rows / r["n"]) for r in counts], "lang string, rate double")
    share = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    few = known.select("lang", "doc_id", "text").join(F.broadcast(rate), "lang").filter((share < F.col("rate")) & F.col("text").rlike(r"\p{L}"))
    few = few.select("lang", "text", F.xxhash64("doc_id", "text").alias("key")).distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    rows = few.withColumn("number", number).filter(F.col("number") <= max_rows).select("lang", "number", "text")

    got = sorted((r["lang"], r["number"], r["text"]) for r in rows.collect() if has_letter(r["text"]))
    if not got:
        return None
    names = np.array([lang for lang, _, _ in got])
    x = np.empty((len(got), 1 << bits), np.float32)
    for k, (_, _, text) in enumerate(got):
        x[k] = ngram_features(text, bits)
    families = np.array([family_of(n) for n in names])
    return LanguageModel(bits, Machines.fit(x, families), {f: Machines.fit(x[families == f], names[families == f]) for f in sorted(set(families.tolist()))})


def identify_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: all) with lang_pred and score for every whole text.

    A text that is null, empty or without a letter, and every text where there is no model, is "und" with score 0.
    No shuffle; a text is read once, in blocks whose size changes no result. Repeated rows get equal predictions. An
    empty table gives no rows.
    """
    importable(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    docs, at, ddl = arrow_input(docs, carry, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits weights for each pair of classes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            made = [fitted.predict(t.as_py()) if fitted else (UNDETERMINED, 0.0) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*carry, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{ddl}, lang_pred string, score double")
