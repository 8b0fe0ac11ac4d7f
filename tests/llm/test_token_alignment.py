from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parleystat.llm import queries, token_alignment
from parleystat.llm.common import table
from parleystat.llm.token_files import byte_letters
from tests.llm import cases

NAMES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
A = Tokenizer.from_file(NAMES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=NAMES[2])
BYTES = {letter: byte for byte, letter in enumerate(byte_letters())}

ODD = [
    "", None, "a", " ", "  a  b ", "<|endoftext|> x", "</s> <s> hi <unk> <0x41>", "é▁x", "▁", "日本語 🎉\n\n x\t\ty", " nbsp ", "ﬁ ﬀ",
    "a\r\nb", "\x00 nul", "x" * 300, "12345 6789 " * 20, "é combining", "﻿bom", "don't stop  the　end", "\U0010ffff",
]


def tokens(text):
    """(id, start, end) of both tokenisations over the bytes of a space and the text; nothing if they don't spell it."""
    if not text:
        return [], []
    a = [(i, bytes(BYTES[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return [], []

    def placed(found):
        at, out = 0, []
        for i, x in found:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    return placed(a), placed(b)


def brute(rows):
    """Per row the contract's columns, from the library's tokens and all pairs compared."""
    done = []
    for doc_id, text in rows:
        a, b = tokens(text)
        starts = {e for _, _, e in a} & {e for _, _, e in b}
        groups, low = [], 0
        for end in sorted(starts):
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= end) for side in (a, b)))
            low = end
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        done.append((doc_id, len(a), len(b), groups, links))
    counts = Counter(p for *_, links in done for p in links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted(
        (
            (d is not None, d), n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for d, n_a, n_b, groups, links in done
    )


def got(frame):
    return sorted(((r.doc_id is not None, r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


def test_against_brute_force(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").where("length(text) < 900").orderBy("doc_id").collect()]
    rows = list(enumerate(texts[:150] + texts[:20] + ODD))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    found = token_alignment.aligned(docs, *NAMES)
    for frequent in (token_alignment.FREQUENT, 50, 1):  # all pairs looked up, some joined, all joined
        assert got(token_alignment.link_strengths(found, frequent)) == want


def test_windows_hold_what_the_whole_text_holds():
    align = token_alignment.Aligner(*NAMES, remembered=8)
    text = "the cat sat on the mat. " * 30 + "Žluťoučký kůň 日本語 \n\n tail"
    a, b = tokens(text)
    n_a, n_b, n_groups, _, links = align([None, text, ""])[1]
    assert (n_a, n_b) == (len(a), len(b)) and n_groups == len({e for *_, e in a} & {e for *_, e in b})
    assert Counter(links.tolist()) == Counter(i << 32 | j for i, s, e in a for j, t, f in b if s < f and t < e)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_whole_table_counts(spark, folder):
    """Over the whole table: tokens from the libraries, links from merged ends instead of windows."""
    rows = {r.doc_id: r for r in queries.op11_token_alignment(spark, folder).collect()}
    links, counts = {}, Counter()
    for r in table(spark, folder, "documents").collect():
        a, b = tokens(r.text)
        assert (rows[r.doc_id].n_a, rows[r.doc_id].n_b) == (len(a), len(b))
        assert rows[r.doc_id].n_groups == len({e for *_, e in a} & {e for *_, e in b})
        i = j = 0
        links[r.doc_id] = found = []
        while i < len(a) and j < len(b):
            found.append((a[i][0], b[j][0]))
            ea, eb = a[i][2], b[j][2]
            i, j = i + (ea <= eb), j + (eb <= ea)
        counts.update(found)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    for d, found in links.items():
        assert rows[d].n_links == len(found) and rows[d].count_sum == sum(counts[p] for p in found)
        assert rows[d].n_best == sum(counts[p] == top[p[1]] for p in found)


def test_edge_cases(spark):
    docs = cases.docs(spark)
    found = token_alignment.link_strengths(token_alignment.aligned(docs, *NAMES))
    rows = found.collect()
    assert len(rows) == len(cases.ROWS)
    assert [tuple(r)[1:] for r in rows if r.doc_id in (3, 4)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (1, 2)}) == 1  # equal texts, equal results
    none = token_alignment.link_strengths(token_alignment.aligned(cases.no_docs(spark), *NAMES))
    assert none.collect() == [] and none.columns == found.columns
