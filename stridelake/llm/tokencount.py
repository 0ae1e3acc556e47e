"""Operator 8: token counts of a unigram vocabulary without building the tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_input, importable, text_bytes

#: What the unknown piece costs beyond the worst piece, as in public unigram tokenizers: a fixed value.
UNKNOWN_PENALTY = 10.0
SPACE_MARK = "▁"


def unigram_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a public sentencepiece vocabulary, most frequent first, with the log of a Zipf share."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)))
    pieces = list(dict.fromkeys(sp.id_to_piece(i) for i in ids))
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return [(p, -math.log(k + 1) - total) for k, p in enumerate(pieces)]


class CountingViterbi:
    """Best score and number of pieces of a word, equal to those of ``tokenizers``' Unigram model.

    Aho-Corasick names the pieces that end at a character, longest first. Of equally good paths to a position the
    one whose last piece starts first is kept, as later ones must be strictly better. A character that is no piece
    of its own may be unknown; unknown characters in a row count as one piece. Of a long word only the positions that
    the longest piece can reach back to are kept.
    """

    keep = 1 << 14

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton, self.longest = ahocorasick.Automaton(), max((len(p) for p, _ in vocabulary), default=1)
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def __call__(self, text: str) -> tuple[float, int]:
        score, count, unknown, base = [0.0], [0], [False], 0  # of the positions from base on
        found = iter(self.automaton.iter(text))
        piece_end, piece = next(found, (-1, None))
        for end in range(len(text)):
            best, start, single = -math.inf, -1, False
            while piece_end == end:
                length, s = piece
                single |= length == 1
                at = end + 1 - length - base
                if s + score[at] > best:
                    best, start = s + score[at], at
                piece_end, piece = next(found, (-1, None))
            is_unknown = not single and self.unknown + score[-1] > best
            if is_unknown:
                best, start = self.unknown + score[-1], len(score) - 1
            score.append(best)
            count.append(count[start] + (not (is_unknown and unknown[start])))
            unknown.append(is_unknown)
            if len(score) > self.keep:  # no piece reaches back further than the longest
                base += len(score) - self.longest - 1
                for held in (score, count, unknown):
                    del held[: -self.longest - 1]
        return score[-1], count[-1]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text", carry: list[str] | None = None, cache_words: int = 300_000, cache_word_bytes: int = 256) -> DataFrame:
    """The columns carry of docs (None: all) with n_tokens and best_score.

    Words (cut at ASCII white space, each with the space mark in front) are segmented apart, so a word's result is
    kept in a cache of at most cache_words words of at most cache_word_bytes bytes. Null, empty and blank texts: 0 and
    0.0. No shuffle; whole texts, one at a time, also where a text is one word. Repeated rows get equal counts. An
    empty table gives no rows.
    """
    importable(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_tokens", "best_score")]
    docs, at, ddl = arrow_input(docs, carry, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, whatever the corpus

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = CountingViterbi(shared.value)

        class Words(dict):
            def __missing__(self, word: bytes) -> tuple[float, int]:
                out = segment(SPACE_MARK + word.decode("utf-8", "surrogatepass"))
                if len(word) <= cache_word_bytes:
                    if len(self) >= cache_words:
                        self.clear()
                    self[word] = out
                return out

        known = Words().__getitem__
        for batch in batches:
            counts, scores = [], []
            for data in text_bytes(batch.column(at)):
                found = list(map(known, data.split()))
                counts.append(sum(n for _, n in found))
                scores.append(math.fsum(s for s, _ in found))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], names=[*carry, "n_tokens", "best_score"])

    return docs.mapInArrow(run, f"{ddl}, n_tokens long, best_score double")
