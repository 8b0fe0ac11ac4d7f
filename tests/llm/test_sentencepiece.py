from __future__ import annotations

import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from parleystat.llm import sentencepiece_fst as fst
from parleystat.llm.common import slices, table
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
MACHINE = fst.transducer(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(machine, text):
    return np.frombuffer(machine.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeostnr h\n▁.,é日🎉0123<>", max_size=80))
def test_equals_the_library(text):
    assert ids(MACHINE, text) == LIBRARY.encode(text)


@pytest.mark.parametrize("text", ["", " ", "a  b ", "<s> <0x0A> <unk>", "a" * 5000, "the" * 400, "x\x00y", "def f(x):\n        return 1\n"])
def test_odd_texts(text):
    assert ids(MACHINE, text) == LIBRARY.encode(text)
    assert MACHINE.decode(ids(MACHINE, text)) == text


def test_short_and_long_chains_agree():
    words = {w for t in ("quantification internationalisation", "unbelievable misunderstanding") for w in t.split()}
    for word in words:
        assert MACHINE._by_prefixes("▁" + word) == MACHINE._only_path("▁" + word)


def test_full_caches_give_the_same():
    small = fst.transducer(PATH, 8)
    text = " ".join(f"word{k % 7}, unbelievable{k} é{k}" for k in range(60))
    assert ids(small, text) == LIBRARY.encode(text)
    caches = [f.__self__ for f in (small.apart, small.last_of, small.of_part, small.of_word)]
    assert all(0 < len(c) <= c.limit <= 8 and len(c.older) <= 8 for c in caches)


def test_batches_are_cut_and_no_row_is_lost():
    parts = [pa.RecordBatch.from_pydict({"n": list(range(k))}) for k in (0, 2500, 1, 1000)]
    found = [x.column(0).to_pylist() for x in slices(iter(parts))]
    assert [len(x) for x in found] == [1000, 1000, 500, 1, 1000]
    assert [n for x in found for n in x] == [*range(2500), 0, *range(1000)]


def test_table_against_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for row in fst.encode_documents(docs, PATH).collect():
        assert row.ids == LIBRARY.encode(texts[row.doc_id]) and row.decoded_equal


def test_edge_cases(spark):
    rows = fst.encode_documents(cases.docs(spark), PATH).collect()
    want = sorted((r[0], LIBRARY.encode(r[1] or "")) for r in cases.ROWS if r[0] is not None)
    assert sorted((r.doc_id, r.ids) for r in rows if r.doc_id is not None) == want
    assert all(r.decoded_equal for r in rows) and len(rows) == len(cases.ROWS)
    assert fst.encode_documents(cases.no_docs(spark), PATH).collect() == []


# A unigram model, written by hand


def _number(value: int) -> bytes:
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def _bytes(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _number(kind))


def unigram(rules: bytes = b"", byte_fallback: bool = False, squeeze: bool = False) -> bytes:
    pieces = [("<unk>", 0.0, fst.UNKNOWN), ("<s>", 0.0, fst.CONTROL), ("</s>", 0.0, fst.CONTROL)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, fst.BYTE) for b in range(256)]
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁▁", "b▁"]
    pieces += [(w, -1.37 - 0.731 * ((k * 7) % 11), fst.NORMAL) for k, w in enumerate(words)]
    data = b"".join(_piece(*p) for p in pieces)
    trainer = b"\x18\x01" + (b"\x98\x02\x01" if byte_fallback else b"")
    norm = (_bytes(2, rules) if rules else b"") + b"\x18\x01" + b"\x20" + _number(int(squeeze)) + b"\x28\x01"
    return data + _bytes(2, trainer) + _bytes(3, norm)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc zé ", max_size=30), st.booleans(), st.booleans())
def test_unigram_equals_the_library(text, byte_fallback, squeeze):
    data = unigram(byte_fallback=byte_fallback, squeeze=squeeze)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert ids(fst.Transducer(data), text) == library.encode(text)


def test_normaliser_rules_equal_the_library():
    rules = dict(fst._fields(dict(fst._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]))[2]
    data = unigram(rules=rules, squeeze=True)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    machine = fst.Transducer(data)
    for text in ("ａｂｃ　ab", "ﬁ ½ ㌔ é é", "a\tb\nc​d", "①②", "カﾞ", "  a   b  "):
        assert machine.normalise(text) == library.normalize(text)
        assert ids(machine, text) == library.encode(text)
