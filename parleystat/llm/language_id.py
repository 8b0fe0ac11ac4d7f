"""Language identification by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm.common import batches

UNKNOWN = "und"
#: The sample a dictionary is made from: about so many documents per language, and so many characters of each.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 2000
DICTIONARY_BYTES = 224 << 10
#: Texts are compressed in pieces, so that a long text's own repeats do not stand in for the dictionary's.
PIECE_BYTES = 1024
LEVEL = 6
#: Texts up to so many bytes are compressed harder: only a thorough search finds their few short matches.
SHORT_BYTES, SHORT_LEVEL = 600, 19
#: A prediction is narrow if the second language needs less than this share more bytes.
MARGIN = 0.01

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> bytes:
    """The lower-case words of a text, joined by single spaces: signs, digits and case say little of a language."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8")


@dataclass(frozen=True)
class LanguageModel:
    """A dictionary by language; the more common language in the learned rows first."""

    dictionaries: dict[str, bytes]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Learn from the `text` and `lang` of `docs`. Rows without either are passed over.

    All rows are counted by language; then a share of each language that leaves about `sample_docs` rows is drawn
    by a hash of the text, and of a longer text a run of `sample_chars` characters at a place set by the hash. The
    driver gets that sample only. With one row per language to spare the hash does not matter: it is drawn whole.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel({})
    most = 1 << 31
    bounds = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(most, most * 2 * sample_docs // n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(most))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1
    piece = F.substring("text", start, F.lit(sample_chars))
    drawn = rows.where(draw < bounds[F.col("lang")]).select("lang", draw.alias("draw"), piece.alias("piece")).distinct()
    pieces: dict[str, list[tuple[int, bytes]]] = {k: [] for k in counts}
    for lang, place, text in drawn.collect():
        pieces[lang].append((place, letters_of(text)))
    dictionaries = {}
    for lang, found in sorted(pieces.items(), key=lambda x: (-counts[x[0]], x[0])):
        content = b"\n".join(text for _, text in sorted(found))[:DICTIONARY_BYTES]
        if len(content) >= 8:  # what zstandard takes as a dictionary
            dictionaries[lang] = content
    return LanguageModel(dictionaries)


class Classifier:
    def __init__(self, model: LanguageModel):
        import zstandard as z

        def packers(level: int) -> list:
            out = []
            for content in model.dictionaries.values():
                own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=level)
                bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
                out.append(z.ZstdCompressor(dict_data=own, **bare).compress)
            return out

        self.languages = list(model.dictionaries)
        self.packers, self.thorough = packers(LEVEL), packers(SHORT_LEVEL)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is wide enough to rely on it.

        The score is the share of bytes that the best dictionary saves over the second. A text without a letter
        is `und` with score 0; ties go to the more common language and count as narrow.
        """
        if text is None or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        raw = letters_of(text)
        cut = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        packers = self.thorough if len(raw) <= SHORT_BYTES else self.packers
        sizes = sorted((sum(len(pack(x)) for x in cut), k) for k, pack in enumerate(packers))
        best = self.languages[sizes[0][1]]
        if len(sizes) == 1:
            return best, 1.0, True
        score = 1 - sizes[0][0] / sizes[1][0]
        return best, score, score >= MARGIN


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`doc_id, lang_pred, score, accepted` of each row, from its whole text alone."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)

        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    yield doc_id, *classify(text.as_py())

        yield from batches(rows(), _OUT)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scan, "doc_id long, lang_pred string, score double, accepted boolean")
