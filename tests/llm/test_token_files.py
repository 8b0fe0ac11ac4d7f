from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parleystat.llm import simple8b, token_files
from parleystat.llm.common import Remembered, scratch, table
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64).flatmap(lambda b: st.integers(0, (1 << b) - 1 if b else 0)), max_size=900))
def test_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escaped = simple8b.encode(ids)
    assert simple8b.decode(words, offsets, escaped, len(ids)).tolist() == ids.tolist()
    assert len(escaped) == int((ids >= 1 << 60).sum())


def test_blocks_decode_alone_and_pack_tightly():
    ids = np.random.default_rng(1).integers(0, 2, 10_000).astype(np.uint64)
    words, offsets, escaped = simple8b.encode(ids)
    assert len(words) <= 10_000 / 50
    for k in (0, 3, len(offsets) - 1):
        n = min(simple8b.BLOCK, len(ids) - k * simple8b.BLOCK)
        stop = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        alone = simple8b.decode(words[offsets[k] : stop], np.array([0], np.uint32), escaped, n)
        assert alone.tolist() == ids[k * simple8b.BLOCK :][:n].tolist()


def test_damaged_frames_raise():
    frame = simple8b.pack_frame(np.array([1, 2]), np.array([2, 1]), np.array([5, 70_000, 2])) + simple8b.TAIL
    assert [f.ids.tolist() for f in simple8b.frames(frame * 2)] == [[5, 70_000, 2]] * 2
    for at in (2, 50, len(frame) - 1):
        with pytest.raises(ValueError):
            list(simple8b.frames(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :]))


ODD = ["", " ", "  ", "a  b   c    d", "x \n y\t z ", "\n\n \n", "it's we'll 'tis", "a<|endoftext|>b", "   x", "é🎉 日本語  1234",
       "tab\tand \r\n end ", " lead", "trail  ", "\x1c \x1d a", "word" * 500]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab'.1é🎉 　ſ!<|>", max_size=40))
def test_encoder_equals_the_library(text):
    library = Tokenizer.from_file(PATH)
    encode = token_files.encoder(PATH, public_tokenizers.PATTERN)
    for t in (text, *ODD):
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_texts_together_equal_the_library_and_each_word_is_met_once():
    library = Tokenizer.from_file(PATH)
    coder = token_files.ByteLevelEncoder(PATH, public_tokenizers.PATTERN)
    met, find = [], coder.words.compute
    coder.words.compute = lambda word: met.append(word) or find(word)
    texts = [*ODD, "one two one, two", "two one\u2003 one", *ODD]
    for part in (texts, [], ["one two", "two three"]):
        ids, sizes = coder.encode(pa.array(part, pa.string()))
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[: len(part)]] == want
    assert "three" in met and len(met) == len(set(met))


def test_a_full_cache_gives_the_same():
    cache = Remembered(lambda n: n * n, 5)
    for keys in (range(4), range(2, 9), range(20), [3], []):
        assert cache.many(list(keys)) == [n * n for n in keys]
        assert len(cache) <= 5 + len(keys) and len(cache.older) <= 25


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZs9é.,;-'\"$\n\t \x00Жﬁ٣", max_size=30), max_size=6))
def test_words_cut_at_signs_equal_the_library(texts):
    ids, sizes = token_files.encoder(PATH, public_tokenizers.PATTERN).encode(pa.array(texts, pa.string()))
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[: len(texts)]] == want


def test_a_word_is_merged_once_whatever_sign_follows():
    coder = token_files.ByteLevelEncoder(PATH, public_tokenizers.PATTERN)
    met, find = [], coder.words.compute
    coder.words.compute = lambda word: met.append(word) or find(word)
    stems, signs = [a + b for a in "abcdef" for b in "uvwxyz"], [",", ".", ";", ":", "!", "?", ")", "-", ".\n", "\n"]
    coder.encode(pa.array([f"x {w}{s}{w} {w}{s}" for w in stems for s in signs], pa.string()))
    assert len(met) == len(set(met)) <= 2 * len(stems) + len(signs) + 1  # x, and each word with a space before it and without


def test_known_words_are_bounded_and_right_after_words_are_forgotten():
    known = token_files.KnownWords(lambda word: list(word.encode()), 10, 500)
    for words in (["a", "b"], [], [f"w{k}" for k in range(40)], ["a", "w3"], ["y" * 1000, "é"], ["y" * 1000, "z", ""], ["a", "é"]):
        got = known.many(pa.array(words, pa.string()))
        assert got.to_pylist() == [list(w.encode()) for w in words]
        assert len(known.words) == len(known.ids) == len(known.met) <= 10
        assert known.words.nbytes + known.ids.nbytes <= 500


def test_words_met_last_stay_known():
    asked = []
    known = token_files.KnownWords(lambda word: asked.append(word) or [1], 10)
    for words in (["often", "a"], *([f"{k}", "often"] for k in range(30))):
        known.many(pa.array(words))
    assert asked.count("often") == 1 and len(known.words) <= 10


def test_portions_keep_all_rows_in_order():
    texts = ["", "a" * 5, "b" * 40, "c", "d" * 9, "", "e" * 9, "f" * 25, "g"]
    batches = [pa.record_batch({"d": list(range(a, b)), "t": texts[a:b]}) for a, b in ((0, 4), (4, 4), (4, 7), (7, 9))]
    batches[1] = batches[0].slice(0, 0)
    for most in (1, 7, 10, 30, 1000):
        got = list(token_files.portions(iter(batches), most))
        assert [d for portion in got for piece in portion for d in piece.column(0).to_pylist()] == list(range(9))
        sizes = [[len(t) for piece in portion for t in piece.column(1).to_pylist()] for portion in got]
        assert all(sum(x) - max(x, default=0) < most for x in sizes)
        assert len(got) == 1 or most < 1000


def brute(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def found(spark, docs):
    path = scratch(spark, "tokens-test")
    token_files.write_token_files(docs, path, PATH, public_tokenizers.PATTERN, 2)
    return [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]


def test_whole_table_against_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert found(spark, docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_edge_cases(spark):
    got = found(spark, cases.docs(spark))
    want = brute([(r[0], r[1]) for r in cases.ROWS if r[0] != 7])
    assert sorted(x[2:] for x in got if x[0] != 7) == sorted(x[2:] for x in want)
    assert [x[0] for x in got] == [None, -9, 1, 2, 2, 3, 4, 5, 6, 7, 7, 8]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    assert found(spark, cases.no_docs(spark)) == []
