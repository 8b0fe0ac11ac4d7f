"""Token ids of documents as Simple-8b files, in document order."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parleystat.llm import simple8b
from parleystat.llm.common import Remembered, batches, small_batches, stored

#: Ids after which a frame is closed.
FRAME_IDS = 1 << 18
#: White space as Python has it.
_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Longer white space at a space.
_ODD = rf"{_WHITE} (?:{_WHITE}|$)"
#: Letters and digits in any version of Unicode; what is not listed is just not cut.
_SAFE = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}]"
#: Signs other than an apostrophe, which may begin a chunk of letters.
_SIGN = r"[!-&(-/:-@\[-`{-~]"
#: Stands before a part of a text that no space precedes.
APART = "\0"
#: Places inside a word where a chunk always ends: a sign or a line end after a letter or digit, and a letter or digit after a
#: sign or after a line end that no other white space precedes.
_ENDS = ((rf"({_SAFE})(\n|{_SIGN})", rf"\1 {APART}\2"), (rf"({_SIGN}\n?|{APART}\n)({_SAFE})", rf"\1 {APART}\2"))
#: Bytes of text, about, whose words are numbered together.
PORTION = 1 << 23


class KnownWords:
    """Ids of words, as Arrow arrays, which take a small part of what a dict of strings would. `compute` gives those of a new
    word. When more than `limit` words or `most` bytes are held, the short ones met last stay, at most half of `limit`."""

    def __init__(self, compute: Callable[[str], list[int]], limit: int, most: int = 1 << 26):
        self.compute, self.limit, self.most, self.rounds = compute, limit, most, 0
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        self.met = np.empty(0, np.int32)  # the last round that asked for the word

    def many(self, words: pa.StringArray) -> pa.ListArray:
        """The ids of each of these words, which are distinct."""
        found = pc.index_in(words, value_set=self.words)
        absent = found.is_null()
        new = words.filter(absent)
        places = found.fill_null(0).to_numpy().copy()
        places[absent.to_numpy(zero_copy_only=False)] = np.arange(len(self.words), len(self.words) + len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = pa.concat_arrays([self.ids, self._computed(new)])
        self.rounds += 1
        self.met = np.concatenate([self.met, np.empty(len(new), np.int32)])
        self.met[places] = self.rounds
        out = self.ids.take(pa.array(places))
        if len(self.words) > self.limit or self.words.nbytes + self.ids.nbytes > self.most:
            self._forget()
        return out

    def _computed(self, words: pa.StringArray) -> pa.ListArray:
        ids, ends = array("I"), [0]
        for word in words.to_numpy(zero_copy_only=False).tolist():
            ids.extend(self.compute(word))
            ends.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.uint32)))

    def _forget(self) -> None:
        short = np.flatnonzero(pc.binary_length(self.words).to_numpy() <= 64)
        last = np.argsort(-self.met[short], kind="stable")[: self.limit // 2]  # of one round, the ones known longer
        kept = np.sort(short[last])
        self.words, self.ids, self.met = self.words.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.met[kept]


class ByteLevelEncoder:
    """Ids of whole texts from a byte-level BPE tokenizer of the tokenizers library.

    The library splits a text into chunks and merges each chunk alone. A space that touches a character other
    than white space always starts a chunk, so texts are cut there first. The pieces of many texts are numbered, so that
    each is met once, cut again where letters and signs meet, and numbered again; the ids of these words are remembered. A
    new word is cut into chunks by the tokenizer's pattern, and a new chunk goes to the library's model. Texts with longer
    white space at a space, or with an added token, go to the library whole. The ids are those of
    `Tokenizer.encode(text, add_special_tokens=False)`.
    """

    def __init__(self, path: str, pattern: str, remembered: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        self.chunks = regex.compile(pattern).findall
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        self.of_chunk = Remembered(self._chunk, 50_000).__getitem__
        self.words = KnownWords(self._word, remembered)

    def _chunk(self, chunk: str) -> list[int]:
        if chunk.isascii() and chunk.isprintable():  # only the space is spelled otherwise
            spelled = chunk.replace(" ", self.space)
        else:
            spelled = "".join(map(self.letters.__getitem__, chunk.encode("utf-8")))
        return [t.id for t in self.merged(spelled)]

    def _word(self, word: str) -> list[int]:
        """A word with the space before it, if it had one. Letters are one chunk."""
        if word.isalpha():
            return [t.id for t in self.merged(self.space + word)] if word.isascii() else self._chunk(" " + word)
        chunks = self.chunks(word[1:] if word[:1] == APART else " " + word)
        return [n for chunk in chunks for n in self.of_chunk(chunk)]

    def _pieces(self, pieces: pa.StringArray) -> pa.ListArray:
        """The ids of each piece."""
        for end, cut in _ENDS:
            pieces = pc.replace_substring_regex(pieces, end, cut)
        words = pc.split_pattern(pieces, " ")
        numbered = words.values.dictionary_encode()
        ids = self.words.many(numbered.dictionary).take(numbered.indices)
        return pa.ListArray.from_arrays(ids.offsets.take(words.offsets), ids.values)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        whole = reduce(pc.or_, [pc.match_substring(texts, t) for t in (*self.added, APART)], pc.match_substring_regex(texts, _ODD))
        cut = pc.split_pattern(pc.binary_join_element_wise(APART, pc.if_else(whole, "", texts), ""), " ")
        numbered = cut.values.dictionary_encode()
        table, numbers = self._pieces(numbered.dictionary), numbered.indices.to_numpy().copy()
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(alone):
            lists = [self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids for k in alone.tolist()]
            numbers[cut.offsets.to_numpy()[alone]] = np.arange(len(table), len(table) + len(alone))
            table = pa.concat_arrays([table, pa.array(lists, table.type)])
        ids = table.take(pa.array(numbers))
        ends = ids.offsets.to_numpy()[cut.offsets.to_numpy()]
        return ids.values.to_numpy(), np.diff(ends)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode(pa.array([text], pa.string()))[0].tobytes()


def byte_letters() -> list[str]:
    """The printable letter by which byte-level BPE spells each byte: printable bytes stand for themselves, the
    others take the letters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteLevelEncoder:
    """One per Python worker, so what it remembers serves all tasks of the worker."""
    return ByteLevelEncoder(path, pattern)


def portions(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """All rows (doc_id, text) in order, in lists of at most `most` bytes of text, one longer text aside."""
    held, room = [], most
    for part in parts:
        places = np.cumsum(pc.binary_length(part.column(1)).to_numpy()) // most
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = part.slice(a, b - a)
            size = pc.sum(pc.binary_length(piece.column(1))).as_py() or 0
            if held and size > room:
                yield held
                held, room = [], most
            held.append(piece)
            room -= size
    if held:
        yield held


def write_token_files(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int) -> None:
    """Write the ids of all `docs` (doc_id, text), each followed by `end_id`, in ascending doc_id order.

    Files follow each other by part number. Rows without an id come first; rows that share an id are ordered by
    their text's hash; equal rows are interchangeable. A null text is empty. The order comes from a range
    partitioning, so no task holds more than its share, and rows of one repeated id are dealt out by their hash.
    """
    ranked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = ranked.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern).encode

        def documents():
            for portion in portions(parts, PORTION):
                names = [doc_id for piece in portion for doc_id in piece.column(0).to_pylist()]
                ids, sizes = encode(pa.concat_arrays([piece.column(1) for piece in portion]))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                yield from zip(names, np.split(ids, ends[:-1] + np.arange(1, len(ends))))

        def packed():
            names, held, size = [], [], 0
            for doc_id, ids in documents():
                held.append(ids)
                names.append(simple8b.NO_ID if doc_id is None else doc_id)
                size += len(ids)
                if size >= FRAME_IDS:
                    yield frame(names, held)
                    names, held, size = [], [], 0
            if held:
                yield frame(names, held)

        def frame(names: list[int], held: list[np.ndarray]) -> tuple[bytes]:
            return (simple8b.pack_frame(np.array(names, np.int64), np.array([len(x) for x in held]), np.concatenate(held)),)

        yield from batches(packed(), pa.schema([("value", pa.binary())]), most=4)

    frames = ordered.mapInArrow(write, "value binary").select(F.col("value").cast("string"))
    with small_batches(docs.sparkSession):
        frames.write.option("lineSep", simple8b.TAIL.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


_READ = pa.schema([(n, pa.int64()) for n in ("part", "doc_id", "local_start", "n_tokens", "ids_crc32")])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: `doc_id, start, n_tokens, ids_crc32`, all taken from the files.

    Starts are places within a part plus the sum of the parts before it; that table has one row per file.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for name, data in zip(part.column(0).to_pylist(), part.column(1)):
                    number, place = int(re.search(r"part-(\d+)", name.rpartition("/")[2])[1]), 0
                    for f in simple8b.frames(data.as_py()):
                        raw, at = memoryview(f.ids.astype("<u4").tobytes()), 0
                        for doc_id, n in zip(f.doc_ids.tolist(), f.lengths.tolist()):
                            crc = zlib.crc32(raw[4 * at : 4 * (at + n)])
                            yield number, None if doc_id == simple8b.NO_ID else doc_id, place + at, n, crc
                            at += n
                        place += at

        yield from batches(rows(), _READ, most=20_000)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = ", ".join(f"{f.name} long" for f in _READ)
    docs = stored(files.mapInArrow(read, schema), "tokens")
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
