"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model compiles into three machines over characters: the normaliser (rewrite rules, longest match first), the
pieces, and the byte fallback. A text's chain of characters is composed with them into a lattice whose arcs are
pieces, and the encoding is its shortest path in the tropical semiring.

* A unigram model weighs an arc with the negative score of its piece.
* A BPE model merges greedily, and a segmentation is the one that merging yields exactly if every piece merges to
  itself and every two neighbours, merged as one string, stay those two. So the lattice is also composed with a
  machine that has a state per piece and an arc between neighbours that stay apart. One path is left.

Composition is lazy, and a chain is cut between characters that stand side by side in no piece. The ids of words and
of their parts are remembered, so common ones are composed once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleystat.llm.common import Remembered, batches, slices

MARK = "\u2581"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces
UNKNOWN_PENALTY = 10.0
#: Characters up to which a chain's prefixes are remembered.
SHORT = 40
#: Prefixes, parts and words (each) that a worker remembers; up to twice as many stay, at some 150 bytes each.
REMEMBERED = 200_000

# Reading a model file (protocol buffers)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What the file says: pieces with scores and kinds, the model type, and the normaliser's settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind = UNIGRAM
        self.rules = b""
        self.dummy_prefix = self.squeeze = self.marks = True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                self.pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.rules = spec.get(2, b"")
                self.dummy_prefix, self.squeeze, self.marks = (bool(spec.get(k, 1)) for k in (3, 4, 5))


# Machines


class Normaliser:
    """Rewrite rules as a transducer: a trie over bytes whose ends carry the replacement; longest match wins, and a
    character without a rule passes. Then the settings for white space apply."""

    def __init__(self, model: Model):
        self.model = model
        self.trie: dict = {}
        if model.rules:
            size = struct.unpack_from("<I", model.rules)[0]
            units = struct.unpack_from(f"<{size // 4}I", model.rules, 4)
            self._load(units, model.rules[4 + size :])

    def _load(self, units: tuple[int, ...], texts: bytes) -> None:
        """Unfold the double array of the file into nested tables."""
        shift = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        waiting = [(shift(units[0]), self.trie)]
        while waiting:
            base, node = waiting.pop()
            for label in range(256):
                place = base ^ label
                if place >= len(units):
                    continue
                unit = units[place]
                if label == 0:
                    continue
                if unit & ((1 << 31) | 0xFF) != label:
                    continue
                child: dict = {}
                node[label] = child
                below = place ^ shift(unit)
                if (unit >> 8) & 1:
                    start = units[below] & ((1 << 31) - 1)
                    child[-1] = texts[start : texts.index(b"\0", start)].decode("utf-8")
                waiting.append((below, child))

    def rewrite(self, text: str) -> str:
        if not self.trie:
            return text
        data, out, at = text.encode("utf-8"), [], 0
        while at < len(data):
            node, end, found = self.trie, at, None
            for k in range(at, len(data)):
                node = node.get(data[k])
                if node is None:
                    break
                if -1 in node:
                    end, found = k + 1, node[-1]
            if found is None:
                end = at + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                found = data[at:end].decode("utf-8")
            out.append(found)
            at = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.marks else text


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, data: bytes, remembered: int = REMEMBERED):
        self.model = model = Model(data)
        if any(kind == USER for _, _, kind in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.normalise = Normaliser(model)
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.scores = [s for _, s, _ in model.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.heads: set[str] = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.longest = max(map(len, self.ids), default=1)
        self.joints = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.unknown_cost = UNKNOWN_PENALTY - min((self.scores[i] for i in self.ids.values()), default=0.0)
        #: No piece has a mark after another character, so a word's pieces do not depend on the word before it.
        self.by_word = model.marks and all(x[0] == MARK or x[1] != MARK for x in self.joints)
        self.apart = Remembered(self._stay_apart, remembered * 3 // 4).__getitem__
        self.last_of = Remembered(self._last, remembered).__getitem__
        self.of_part = Remembered(self._ids, remembered).__getitem__
        self.of_word = Remembered(lambda word: self._parts(MARK + word), remembered).__getitem__
        if model.kind == BPE:
            self._merge_table()
        self.texts = [self._text(*piece) for piece in model.pieces]

    # BPE: greedy merging of single pieces, from which the machine of neighbours is made

    def _merge_table(self) -> None:
        """When each piece is made, by the order of scores (-1: never, a single character), from which two parts,
        which pieces merge to themselves, and which of them out of the order of scores (few)."""
        order = sorted(self.ids, key=lambda p: -self.scores[self.ids[p]])
        self.time = {p: k if len(p) > 1 else -1 for k, p in enumerate(order)}
        self.parts_of: dict[str, tuple[str, str]] = {}
        self.whole: set[str] = set()
        self.disordered: set[str] = set()
        for piece in order:
            steps: list[tuple[str, str]] = []
            if self._merged(piece, steps) == [piece]:
                self.whole.add(piece)
                times = [self.time[a + b] for a, b in steps]
                if times != sorted(times):
                    self.disordered.add(piece)
                if steps:
                    self.parts_of[piece] = steps[-1]

    def _merged(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until no two neighbours make a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self.ids.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.scores[number] > best):
                    best, at = self.scores[number], i
            if best is None:
                break
            if steps is not None:
                steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, pair: tuple[str, str]) -> bool:
        """Whether merging the two as one string never joins across their border.

        Undo their merges, latest first (of one piece on both sides the right one): while two parts face each
        other across the border, joining them must not come before the merge that was undone last.
        """
        left, right = pair
        if left in self.disordered or right in self.disordered:
            return self._merged(left + right) == [left, right]
        made, parts_of, before = self.time.get, self.parts_of, len(self.time)
        made_left, made_right = made(left, -1), made(right, -1)
        while True:
            across = made(left + right)
            if across is not None and across < before:
                return False
            if made_left > made_right:
                before, left = made_left, parts_of[left][1]
                made_left = made(left, -1)
            elif made_right >= 0:
                before, right = made_right + 1, parts_of[right][0]
                made_right = made(right, -1)
            else:
                return True

    # Composition and shortest path

    def _arcs(self, text: str, at: int) -> list[str]:
        """Pieces that start at a place of the chain, shortest first; a character that is no piece is an arc too."""
        found, end, ids, heads = [], at + 1, self.ids, self.heads
        if text[at] not in ids:
            found.append(text[at])
        while end <= len(text):
            piece = text[at:end]
            if piece in ids:
                found.append(piece)
            if piece not in heads:
                break
            end += 1
        return found

    def _only_path(self, text: str) -> list[str]:
        """The accepted path of a long chain. Arcs weigh nothing and exactly one path is accepted, so that one is
        the lightest; composing depth first, long pieces first, finds it without building the rest. A state (place,
        last piece) that led nowhere is not entered again."""
        path: list[str] = []
        places, waiting, dead = [0], [self._arcs(text, 0)], set()
        while places[-1] < len(text):
            at, arcs = places[-1], waiting[-1]
            if not arcs:
                waiting.pop()
                places.pop()
                dead.add((at, path.pop()))
                continue
            piece = arcs.pop()
            end = at + len(piece)
            if (end, piece) in dead or len(piece) > 1 and piece not in self.whole or path and not self.apart((path[-1], piece)):
                continue
            path.append(piece)
            places.append(end)
            waiting.append(self._arcs(text, end) if end < len(text) else [])
        return path

    def _last(self, chain: str) -> str:
        """The last arc of the accepted path of a short chain. Every prefix of it has exactly one accepted path as
        well, so the state after a prefix is the last piece of that path; words share prefixes, and their states
        are remembered."""
        if chain in self.whole:
            return chain
        n = len(chain)
        for k in range(min(n - 1, self.longest), 0, -1):
            piece = chain[n - k :]
            if (k == 1 or piece in self.whole) and self.apart((self.last_of(chain[: n - k]), piece)):
                return piece
        return chain

    def _by_prefixes(self, text: str) -> list[str]:
        out = []
        while text:
            out.append(self.last_of(text))
            text = text[: -len(out[-1])]
        return out[::-1]

    def _lightest_path(self, text: str) -> list[str]:
        """The lightest path of a unigram lattice: weights add along a path, the smaller sum wins, and of equal
        sums the one found first."""
        best: list[tuple[float, str] | None] = [(0.0, "")] + [None] * len(text)
        for at in range(len(text)):
            if best[at] is None:
                continue
            for piece in self._arcs(text, at):
                number = self.ids.get(piece)
                cost = best[at][0] + (self.unknown_cost if number is None else -self.scores[number])
                end = at + len(piece)
                if best[end] is None or cost < best[end][0]:
                    best[end] = (cost, piece)
        out, at = [], len(text)
        while at:
            out.append(best[at][1])
            at -= len(out[-1])
        return out[::-1]

    def shortest_path(self, text: str) -> list[str]:
        if self.model.kind != BPE:
            return self._lightest_path(text)
        return self._by_prefixes(text) if len(text) <= SHORT else self._only_path(text)

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.shortest_path(text):
            number = self.ids.get(piece)
            if number is not None:
                out.append(number)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode("utf-8")]
            else:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _parts(self, text: str) -> bytes:
        """Cut where no piece crosses, and put the parts' ids together."""
        joints, start, out = self.joints, 0, []
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joints:
                out.append(self.of_part(text[start:i]))
                start = i
        if text:
            out.append(self.of_part(text[start:]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = self.normalise(text)
        if self.by_word and text.startswith(MARK) and MARK + MARK not in text:
            ids = b"".join(map(self.of_word, text[1:].split(MARK)))
        else:
            ids = self._parts(text)
        if not self.bytes:  # unknown characters in a row are one unknown
            all_ids = np.frombuffer(ids, "<u4")
            again = (all_ids[1:] == self.unknown) & (all_ids[:-1] == self.unknown)
            ids = all_ids[np.concatenate([[True], ~again])].tobytes() if len(all_ids) else ids
        return ids

    def _text(self, piece: str, _score: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        if kind == CONTROL:
            return b""
        return (piece.replace(MARK, " ") if self.model.marks else piece).encode("utf-8")

    def decode(self, ids: list[int]) -> str:
        """The inverse machine: pieces and bytes to text. Bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def transducer(path: str, remembered: int = REMEMBERED) -> Transducer:
    """Compiled once per Python worker."""
    with open(path, "rb") as file:
        return Transducer(file.read(), remembered)


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_equal", pa.bool_())])


def encode_documents(docs: DataFrame, model: str, check: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """`doc_id, ids array<int>, decoded_equal` of each row's whole text.

    `model` is a model file that every executor has at that path. A null or empty text has no ids. With `check`,
    every encoding is decoded again and compared with the text; a model whose normaliser changes texts gives false
    there. Rows that repeat stay. With fewer words `remembered` a worker needs less memory and more time.
    """

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model, remembered)

        def rows():
            for part in slices(parts):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py() or ""
                    ids = np.frombuffer(machine.encode(text), "<i4")
                    same = machine.decode(ids.tolist()) == text if check else None
                    yield doc_id, ids, same

        yield from batches(rows(), _OUT, most=1024, weigh=lambda r: 4 * len(r[1]))

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, decoded_equal boolean")
