"""Encoding of texts chunk by chunk with a memo, for tokenizers whose result is local to a chunk.

A text is cut where a non-space character meets a space and, for patterns that part letters, digits and signs (``fine``),
where those meet. None of the supported pre-token patterns lets a match reach over such a place, and none looks
back, so the ids of a text are the ids of its chunks in order. Chunks are hashed and looked up array-wise, and every
match is confirmed on the chunks' bytes; only a chunk that the memo lacks reaches the tokenizer. The memo is bounded: it
starts anew when it is full, which costs time and never changes a result.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import BLOCK_BYTES, SpanHasher, same_spans, tidy, words_of

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that end a character which is surely no space: printable ASCII. Of longer characters see _solid_before.
_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True  # U+00C0 to U+07FF holds no space
_LEAD3 = np.zeros(256, bool)
_LEAD3[0xE4:0xEE] = True  # U+4000 to U+DFFF neither


def _solid_before(buf: np.ndarray) -> np.ndarray:
    """Where the character that ends just before a byte is surely no space of any kind."""
    out = np.zeros(len(buf), bool)
    out[1:] = _PRINT[buf[:-1]]
    out[2:] |= _LEAD2[buf[:-2]]
    out[3:] |= _LEAD3[buf[:-3]]
    return out


#: Kinds of ASCII for ``fine`` cuts: letters, digits, signs. 0: never cut beside it (controls, space, what added tokens are made of).
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[ord(c) for c in "<>|"]] = 0
_APOSTROPHE = ord("'")
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xCA] = True  # U+00C0 to U+024F are letters but for two signs; U+0130 ends in a mark once it is lower case
_LATIN_OTHER = (0xC397, 0xC3B7, 0xC4B0)


def cuts(buf: np.ndarray, plain: bool, fine: bool = False) -> np.ndarray:
    """Places where a chunk may begin. plain: white space only parts chunks and is itself dropped by the tokenizer.

    fine: letters, digits and signs are parted too (an apostrophe stays with what follows it); with plain, digits
    also from each other.
    """
    space = _SPACE[buf]
    at = space.copy()
    at[1:] &= ~space[:-1] if plain else True
    if not plain:
        at &= _solid_before(buf)
    if fine and len(buf) > 1:
        kind = _KIND[buf]
        before, after = kind[:-1], kind[1:]
        edge = (before != after) & (before > 0) & (after > 0) & (buf[:-1] != _APOSTROPHE)
        if plain:
            edge |= (before == 2) & (after == 2)
        if len(buf) > 2:  # a Latin letter of two bytes, then an ASCII sign or digit
            last = np.flatnonzero(_LATIN[buf[:-2]] & (kind[2:] >= 2))
            code = (buf[last].astype(np.int64) << 8) + buf[last + 1]
            edge[1 + last[~np.isin(code, _LATIN_OTHER)]] = True
        at[1:] |= edge
    return np.flatnonzero(at)


def blocks(texts: Iterable[bytes], plain: bool, most: int = BLOCK_BYTES, *, fine: bool = False) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Buffers of about ``most`` bytes with (text number, bytes) of what they hold; long texts are cut at chunk borders."""
    held, parts, size = [], [], 0
    for i, text in enumerate(texts):
        while len(text) > most:
            at = cuts(np.frombuffer(text, np.uint8, min(len(text), 2 * most)), plain, fine)
            at = at[at > 0]
            if not len(at):
                at = cuts(np.frombuffer(text, np.uint8), plain, fine)
                at = at[at > 0]
                if not len(at):
                    break
                cut = int(at[0])
            else:
                cut = int(at[min(np.searchsorted(at, most), len(at) - 1)])
            held.append(text[:cut])
            parts.append((i, cut))
            yield b"".join(held), parts
            held, parts, size, text = [], [], 0, text[cut:]
        held.append(text)
        parts.append((i, len(text)))
        size += len(text)
        if size >= most:
            yield b"".join(held), parts
            held, parts, size = [], [], 0
    if parts:
        yield b"".join(held), parts


class ChunkEncoder:
    """``encode(texts)`` gives (ids of all texts in order, where each text's ids begin and the last end).

    ``misses(list of chunk bytes)`` returns a list of id lists; it is asked once for each chunk not in the memo.
    """

    def __init__(self, misses: Callable[[list[bytes]], list], plain: bool, most_chunks: int = 1_000_000, fine: bool = False):
        self.misses, self.plain, self.most, self.fine = misses, plain, most_chunks, fine
        self.hash = SpanHasher()
        self.reset()

    def reset(self) -> None:
        """The memo: sorted hashes, each with its number; by number the chunk's place, length, and ids."""
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.n = 0
        self.chunk_at, self.chunk_len, self.at, self.len = (np.zeros(1 << 12, np.uint32) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.chunks, self.chunk_used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array) // 2), array.dtype)])

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        """Encodes new chunks and returns their numbers."""
        ids = self.misses(chunks)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        total, text, to = int(sizes.sum()), int(lens.sum()), self.n + len(chunks)
        self.pool, self.chunks = self._room(self.pool, self.used + total), self._room(self.chunks, self.chunk_used + text + 8)
        self.pool[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        self.chunks[self.chunk_used : self.chunk_used + text] = np.frombuffer(b"".join(chunks), np.uint8)
        for name in ("at", "len", "chunk_at", "chunk_len"):
            setattr(self, name, self._room(getattr(self, name), to))
        own = slice(self.n, to)
        self.len[own], self.chunk_len[own] = sizes, lens
        self.at[own] = self.used + np.cumsum(sizes) - sizes
        self.chunk_at[own] = self.chunk_used + np.cumsum(lens) - lens
        self.used, self.chunk_used, self.n = self.used + total, self.chunk_used + text, to
        return np.arange(own.start, to)

    def _numbers(self, data: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memo's number of every chunk."""
        words = words_of(buf)
        hashes = self.hash(buf, starts, ends, words)
        order = np.argsort(hashes)
        run = hashes[order]
        new = np.append(True, run[1:] != run[:-1])
        unique, first = run[new], order[new]
        if self.n + len(unique) > self.most or max(self.used, self.chunk_used) > 1 << 28:
            self.reset()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = np.flatnonzero(place < len(self.keys))
        known[inside] = self.keys[place[inside]] == unique[inside]
        number = np.zeros(len(unique), np.int64)
        number[known] = self.number[place[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            s, e = starts[first[fresh]].tolist(), ends[first[fresh]].tolist()
            number[fresh] = self._add([data[a:b] for a, b in zip(s, e, strict=True)])
            self.keys, self.number = np.insert(self.keys, place[fresh], unique[fresh]), np.insert(self.number, place[fresh], number[fresh])
        out = np.empty(len(starts), np.int64)
        out[order] = number[np.cumsum(new) - 1]
        size = ends - starts
        memo = np.ndarray((len(self.chunks) - 7,), "<u8", self.chunks, strides=(1,))
        same = self.chunk_len[out] == size
        own = np.flatnonzero(same)
        same[own] = same_spans(buf, starts[own], self.chunks, self.chunk_at[out[own]].astype(np.int64), size[own], words, memo)
        other = np.flatnonzero(~same)  # equal hashes of different bytes: such chunks do without the memo's index
        if len(other):
            out[other] = self._add([data[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
        return out

    def _block(self, data: bytes, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block and the number of ids of each part."""
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        buf = np.frombuffer(data, np.uint8)
        bounds = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([n for _, n in parts], out=bounds[1:])
        begins = np.zeros(len(buf), bool)
        begins[cuts(buf, self.plain, self.fine)] = True
        begins[bounds[:-1][bounds[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buf))
        if self.plain:  # drop the white space before a word, so that one entry serves every place
            led = np.flatnonzero(_SPACE[buf[starts]])
            solid = np.flatnonzero(~_SPACE[buf])
            begin = np.append(solid, len(buf))[np.searchsorted(solid, starts[led])]
            starts[led] = np.minimum(begin, ends[led])
        number = self._numbers(data, buf, starts, ends)
        at, size = self.at[number].astype(np.int64), self.len[number].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        border = np.searchsorted(np.append(starts, len(buf)), bounds) if not self.plain else np.searchsorted(ends, bounds, side="right")
        return ids, np.diff(upto[np.minimum(border, len(size))])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [], np.zeros(len(texts), np.int64)
        for data, parts in blocks(texts, self.plain, fine=self.fine):
            ids, n = self._block(data, parts)
            out.append(ids)
            np.add.at(sizes, [i for i, _ in parts], n)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(sizes)])


def batches(texts: list, most: int = 8 * BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of at most ``most`` bytes, one text at least."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def text_runs(batch: pa.RecordBatch, most: int = 2 * BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(i, j, texts i to j as UTF-8) of a batch, at most ``most`` bytes at a time; null is empty."""
    column = batch.column(batch.schema.get_field_index("text"))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, side="right")))
        yield i, j, [b"" if t is None else t.encode() for t in column.slice(i, j - i).to_pylist()]
        i = j
    tidy()


class WholeEncoder:
    """As :class:`ChunkEncoder`, each text in one piece: for tokenizers whose added tokens may reach over a cut."""

    def __init__(self, misses: Callable[[list[bytes]], list]):
        self.misses = misses

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.misses(texts)
        return np.array([x for y in ids for x in y], np.uint32), np.cumsum([0, *map(len, ids)], dtype=np.int64)


def local(tokenizer, plain: bool, fine: bool) -> bool:
    """Whether no added token can be cut, holds white space or takes in what follows it, so that chunks hold added tokens whole."""
    for t in tokenizer.get_added_tokens_decoder().values():
        inside = cuts(np.frombuffer(t.content.encode(), np.uint8), plain, fine)
        if t.rstrip or any(c.isspace() for c in t.content) or len(inside[inside > 0]):
            return False
        if fine and (t.lstrip or t.single_word or not (_KIND[t.content.encode()[0]] == 0 and _KIND[t.content.encode()[-1]] == 0)):
            return False  # a cut beside it could part it from what decides whether it is one
    return True


#: The patterns, as their vocabularies state them, that part letters, digits and signs.
FINE_PATTERNS = (
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)


def parts_kinds(tokenizer_json: str, plain: bool) -> bool:
    """Whether a tokenizer's pre-tokens are those of FINE_PATTERNS, so that ``fine`` cuts are right for it."""
    known = json.loads(tokenizer_json)
    before, split = known.get("normalizer"), known.get("pre_tokenizer") or {}
    if plain:
        first = (split.get("pretokenizers") or [split])[0]
        names = [n["type"] for n in (before or {}).get("normalizers", [])]
        return first.get("type") == "Split" and first.get("pattern") == {"Regex": FINE_PATTERNS[0]} and set(names) <= {"NFC", "Replace", "Lowercase"}
    return before is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True


def library_misses(tokenizer, added: bool = False) -> Callable[[list[bytes]], list]:
    """Chunks encoded by the tokenizers library itself. added: literal added tokens get their ids, as is the library's default."""
    tokenizer.encode_special_tokens = not added

    def misses(chunks: list[bytes]) -> list:
        return [e.ids for e in tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    return misses


_held: dict = {}


def held_encoder(key: str, make: Callable[[], ChunkEncoder | WholeEncoder]) -> ChunkEncoder | WholeEncoder:
    """One encoder per worker process and vocabulary, so that the memo outlives a task."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def library_encoder(json_text: str, plain: bool, added: bool = False) -> ChunkEncoder | WholeEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    def make():
        tokenizer = Tokenizer.from_str(json_text)
        misses = library_misses(tokenizer, added)
        fine = parts_kinds(json_text, plain)
        fine = fine and (not added or local(tokenizer, plain, True))
        return WholeEncoder(misses) if added and not local(tokenizer, plain, fine) else ChunkEncoder(misses, plain, fine=fine)

    return held_encoder(f"library:{plain}:{added}:{hash(json_text)}", make)


def library_json(path: str | None, name: str) -> str:
    """The vocabulary file's text, read by the driver; executors get it by broadcast (its size is the file's)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()
