import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stridelake.llm import packing
from stridelake.llm.queries import op1_pack_sequences, tokenizer_files

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None),
    (2, ""),
    (3, " leading and  double  spaces "),
    (4, "tabs\tand\r\nlines\n\n\nmore\n"),
    (5, "ñandú Öl — “quoted”  nbsp  em 日本語 🙂"),
    (6, "ends in <|endoftext|> and goes on<|endoftext|>"),
    (7, "it's we've I'M 12ab34 !!?? a_b"),
    (7, "it's we've I'M 12ab34 !!?? a_b"),
    (8, "x" * 5000 + " y" * 3000),
    (None, "no id"),
    (9, "\x1cfile sep\x85 next   line"),
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_files()["tokenizer_file"])


def check_layout(rows):
    """Gapless sequences of at most 1024, and every document whole."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append((r.start, r.length))
    used = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        used += at
    return used, len(seqs), docs


def test_ids_equal_the_tokenizer(spark, whole):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    out = packing.pack_documents(rows, **tokenizer_files(), with_ids=True).collect()
    check_layout(out)
    got = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        got[r.doc_id].append((r.start, bytes(r.ids)))
    for doc_id, text in ODD:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(p for _, p in sorted(set(got[doc_id]))) == ids
    assert len(got[7]) == 2  # repeated rows are both packed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é'\n\t.,!1ß "), max_size=40), max_size=8))
def test_encoder_on_any_white_space(whole, texts):
    encode = packing.Encoder(**tokenizer_files())
    for t in texts:
        assert list(np.frombuffer(encode(t), "<u4")) == whole.encode(t, add_special_tokens=False).ids


def test_whole_table(spark, whole):
    rows = op1_pack_sequences(spark, SF).collect()
    used, n, docs = check_layout(rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {d for d, _ in docs} == set(texts)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in rows}
    for (doc_id, total), parts in docs.items():
        ids = np.array([*whole.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert total == len(ids) == sum(length for _, length in parts)
        for start, length in parts:
            assert crc[doc_id, start] == zlib.crc32(ids[start : start + length].tobytes())
    assert 1 - used / (n * 1024) < 0.05


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_patterns_use_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    used = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 64 and count > 0
        for length in pattern:
            used[length] += count
    assert used == Counter(histogram)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), **tokenizer_files()).collect() == []
