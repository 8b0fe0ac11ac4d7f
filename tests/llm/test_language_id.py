from __future__ import annotations

from pyspark.sql import functions as F

from parleystat.llm import language_id as li
from parleystat.llm import queries
from parleystat.llm.common import table
from tests.llm import cases


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op8_language_id(spark, folder).join(table(spark, folder, "documents"), "doc_id")
    held = rows.where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("right"), "accepted", "score").collect()
    assert len(held) > 2000
    assert sum(r.right for r in held) / len(held) > 0.98
    sure = [r for r in held if r.accepted]
    assert len(sure) / len(held) > 0.95 and sum(r.right for r in sure) >= sum(r.right for r in held) - 30
    assert all(0 <= r.score <= 1 for r in held)


def test_edge_cases(spark):
    docs = cases.docs(spark)
    model = li.fit(docs)
    rows = li.predict(docs, model).collect()
    assert len(rows) == len(cases.ROWS)
    unknown = {r.doc_id for r in rows if r.lang_pred == li.UNKNOWN}
    assert {3, 4, 5} <= unknown and all(r.score == 0 and not r.accepted for r in rows if r.lang_pred == li.UNKNOWN)
    assert all(r.lang_pred in (*model.dictionaries, li.UNKNOWN) for r in rows)
    assert li.predict(cases.no_docs(spark), model).collect() == []
    empty = li.fit(cases.no_docs(spark))
    assert {r.lang_pred for r in li.predict(docs, empty).collect()} == {li.UNKNOWN}


def test_narrow_margins_are_rejected():
    same = b"one and the same text for both languages, word by word"
    classify = li.Classifier(li.LanguageModel({"b": same, "a": same}))
    assert classify("one and the same text") == ("b", 0.0, False)
    assert li.Classifier(li.LanguageModel({"a": same}))("text") == ("a", 1.0, True)


def test_sizes_against_plain_compression(spark):
    """Every size recomputed text by text; and the two levels' verdicts on short texts, where both are taken."""
    import zstandard as z

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = li.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    found = {r.doc_id: r for r in queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()}

    def sizes(raw, level):
        out = []
        for content in model.dictionaries.values():
            own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            one = z.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            out.append(sum(len(one.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)))
        return out

    names, alike, short = list(model.dictionaries), 0, 0
    for r in docs.collect():
        letters = "".join(c if c.isalpha() else " " for c in (r.text or "").lower())
        raw = (" " if letters[:1] == " " else "").encode() + " ".join(letters.split()).encode() + (" " if letters[-1:] == " " else "").encode()
        if not letters.strip():
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        mine = sizes(raw, 19 if len(raw) <= 600 else 6)
        first, second = sorted(mine)[:2]
        assert found[r.doc_id].lang_pred == names[mine.index(first)]
        assert abs(found[r.doc_id].score - (1 - first / second)) < 1e-12
        if len(raw) <= 600:
            other = sizes(raw, 6)
            short, alike = short + 1, alike + (names[other.index(min(other))] == found[r.doc_id].lang_pred)
    assert short > 50 and alike / short > 0.9
