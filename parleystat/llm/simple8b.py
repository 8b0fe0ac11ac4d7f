"""Simple-8b coding of token ids, vectorised in numpy, and the frames that a token file is made of.

A 64-bit word holds a 4-bit selector and 60 bits of data: 60 ids of 1 bit, 30 of 2, and so on to one of 60 bits.
An id that needs more bits is an escape: selector 0, whose data is the id's place in a list of raw ids. Ids are
coded in blocks of `BLOCK`; no word crosses a block, and the offset of every block's first word is stored, so
blocks decode alone and all words of a frame decode at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BLOCK = 256
#: Ids per word and bits per id, by selector; selector 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MAGIC = b"TOK8"
#: After every frame; Spark's text sink writes it as the row separator.
TAIL = b"\nTOKEND\n"
_HEAD = struct.Struct("<4sIQIIIII")  # magic, block size, ids, documents, blocks, words, escapes, crc32 of the body
NO_ID = -(2**63)
#: Bit lengths of small ids.
_BITS = np.array([max(1, n.bit_length()) for n in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit length of each id, at least 1."""
    if len(ids) and ids.max() < len(_BITS):
        return _BITS[ids]
    wide = ids.astype(np.uint64)
    bits = np.ones(len(wide), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = wide >= np.uint64(1 << shift)
        bits[high] += np.uint8(shift)
        wide = np.where(high, wide >> np.uint64(shift), wide)
    return bits


def _widest(bits: np.ndarray) -> np.ndarray:
    """By position, the selector that packs most of the ids that follow it."""
    best = np.where(bits > 60, 0, len(COUNTS) - 1).astype(np.uint8)
    n = len(bits)
    top, span = bits, 1  # top[i]: the most bits in bits[i : i + span]
    for selector in range(len(COUNTS) - 2, 0, -1):
        count, width = COUNTS[selector], WIDTHS[selector]
        while span < count:
            step = min(span, count - span)
            grown, rest = top.copy(), max(0, n - step)
            np.maximum(top[:rest], top[step:], out=grown[:rest])
            top, span = grown, span + step
        np.copyto(best, np.uint8(selector), where=top <= width)
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and the raw escaped ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint64)
    best = _widest(_bits(ids))
    step = np.array(COUNTS, np.int64)[best]
    first = np.arange(0, n, BLOCK)
    last = np.minimum(first + BLOCK, n)
    at, stop, begins = first, last, np.zeros(n, bool)
    while len(at):  # one word of every unfinished block at a time
        begins[at] = True
        at = at + step[at]
        more = at < stop
        at, stop = at[more], stop[more]
    starts = np.flatnonzero(begins)
    selectors = best[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(max(COUNTS), np.uint64)])
    for selector in np.unique(selectors):
        where = np.flatnonzero(selectors == selector)
        if selector == 0:
            escaped = ids[starts[where]]
            words[where] |= np.arange(len(where), dtype=np.uint64)
            continue
        count, width, begin = COUNTS[selector], WIDTHS[selector], starts[where]
        end, packed = last[begin // BLOCK], np.zeros(len(where), np.uint64)
        short = np.flatnonzero(begin + count > end)  # the block ends inside the word
        for k in range(count):
            value = padded[begin + k]
            value[short[begin[short] + k >= end[short]]] = 0
            packed |= value << np.uint64(k * width)
        words[where] |= packed
    offsets = np.searchsorted(starts, first).astype(np.uint32)
    return words, offsets, escaped if (selectors == 0).any() else np.empty(0, np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The `n` ids of a frame, as unsigned 64-bit integers."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    data = words & np.uint64((1 << 60) - 1)
    counts = np.array(COUNTS, np.int64)[selectors]
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    start = before - before[offsets.astype(np.int64)][owner] + owner * BLOCK
    end = np.minimum((owner + 1) * BLOCK, n)
    for selector in np.unique(selectors):
        where = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[start[where]] = escaped[data[where].astype(np.int64)]
            continue
        count, width = COUNTS[selector], WIDTHS[selector]
        mask, begin, held = np.uint64((1 << width) - 1), start[where], data[where]
        room = end[where] - begin
        for k in range(count):
            value = (held >> np.uint64(k * width)) & mask
            inside = room > k
            out[begin[inside] + k] = value[inside]
    return out


class Frame(NamedTuple):
    doc_ids: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def pack_frame(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escaped = encode(ids)
    body = b"".join(
        x.tobytes()
        for x in (doc_ids.astype("<i8"), lengths.astype("<u8"), offsets.astype("<u4"), words.astype("<u8"), escaped.astype("<u8"))
    )
    head = _HEAD.pack(MAGIC, BLOCK, len(ids), len(doc_ids), len(offsets), len(words), len(escaped), zlib.crc32(body))
    return head + body


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a file. Raises if one is damaged: token data may not be read with holes."""
    at = 0
    while at < len(data):
        magic, block, n, docs, blocks, n_words, n_escaped, crc = _HEAD.unpack_from(data, at)
        begin = at + _HEAD.size
        size = 16 * docs + 4 * blocks + 8 * n_words + 8 * n_escaped
        if magic != MAGIC or block != BLOCK or zlib.crc32(data[begin : begin + size]) != crc:
            raise ValueError(f"damaged token frame at byte {at}")
        parts, place = [], begin
        for kind, count in (("<i8", docs), ("<u8", docs), ("<u4", blocks), ("<u8", n_words), ("<u8", n_escaped)):
            parts.append(np.frombuffer(data, kind, count, place))
            place += parts[-1].nbytes
        doc_ids, lengths, offsets, words, escaped = parts
        yield Frame(doc_ids, lengths, decode(words, offsets, escaped, n))
        if data[place : place + len(TAIL)] != TAIL:
            raise ValueError(f"token frame at byte {at} is not closed")
        at = place + len(TAIL)
