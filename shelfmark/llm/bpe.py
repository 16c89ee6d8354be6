"""Token ids of whole texts, as the ``tokenizers`` library gives them, at column speed.

White space separates tokens in the supported kind of file (a white-space
``Replace``, ``Lowercase``, a regex split, then byte-level BPE with word ends),
so a text's ids are the ids of its words in order. A worker keeps the ids of the
words it has met in a bounded table; new plain Latin words are merged together
in numpy, anything else goes through the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex

from .textkernel import Chunk, mix

_EMPTY = np.uint64(0)
#: Fixed value: the split pattern of the supported tokenizer files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = regex.compile(r"[\n\x21-\x7e\xa1-\u024f]+")


class HashIndex:
    """Open addressing from nonzero 64-bit keys to int32 values, in numpy."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = (keys & self.mask).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (there != _EMPTY)
            left, slot = left[go], (slot[go] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and new."""
        self.size += len(keys)
        slot = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & int(self.mask)


def _byte_chars() -> list[str]:
    """Byte-level BPE's printable character for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class WordBpe:
    def __init__(self, path: str, table_bits: int = 21):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        splits = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"]]
        self.fast = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and SPLIT in splits
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bits = table_bits
        self._clear()
        if self.fast:
            vocab, chars = model["vocab"], _byte_chars()
            self.first = np.array([vocab[c] for c in chars], np.int64)
            self.final = np.array([vocab[c + "</w>"] for c in chars], np.int64)
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
            self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
            key, rank = np.unique(key, return_index=True)
            self.ranks = HashIndex(18)
            self.ranks.add(mix(key), rank.astype(np.int32))
        self.split = regex.compile(SPLIT + r"|\n")

    def _clear(self) -> None:
        self.index = HashIndex(self.bits)
        self.starts = np.zeros(1, np.int64)
        self.tokens = np.empty(0, np.int32)
        self.count = 0

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of each piece's ids."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lengths)
        symbol = self.first[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done_symbols, done_words, none = [], [], np.int32(1 << 30)
        while len(symbol):
            rank = np.full(len(symbol), none)
            pair = np.flatnonzero(word[1:] == word[:-1])
            found = self.ranks.find(mix(symbol[pair].astype(np.uint64) << np.uint64(32) | symbol[pair + 1].astype(np.uint64)))
            rank[pair] = np.where(found < 0, none, found)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            best = np.repeat(best, np.diff(np.append(begin, len(symbol))))
            idle = best == none
            if idle.any():
                done_symbols.append(symbol[idle])
                done_words.append(word[idle])
                symbol, word, rank, best = symbol[~idle], word[~idle], rank[~idle], best[~idle]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbols, words = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(words, minlength=len(pieces))

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        text = "\n".join(words)
        if not self.fast:
            plain = np.zeros(len(words), bool)
        elif "<|" in text or _PLAIN.fullmatch(text) is None:
            plain = np.array(["<|" not in w and _PLAIN.fullmatch(w) is not None for w in words])
        else:
            plain = np.ones(len(words), bool)
        if not plain.all():
            odd = [w for w, ok in zip(words, plain.tolist()) if not ok]
            self._store(keys[~plain], [e.ids for e in self.library.encode_batch(odd, add_special_tokens=False)])
            keys, text = keys[plain], "\n".join(w for w, ok in zip(words, plain.tolist()) if ok)
        if not len(keys):
            return
        found = self.split.findall(text.lower())
        code = {piece: i for i, piece in enumerate(dict.fromkeys(found))}
        mark = code.setdefault("\n", len(code))
        codes = np.fromiter(map(code.__getitem__, found), np.int64, len(found))
        ids, sizes = self._merge([piece.encode() for piece in code])
        sizes_here = np.where(np.arange(len(code)) == mark, 0, sizes)
        at = np.cumsum(sizes) - sizes
        parts = sizes_here[codes]
        total = np.append(0, np.cumsum(parts))
        ends = np.append(np.flatnonzero(codes == mark), len(codes))
        self._append(keys, ids[_spans(at[codes], parts)], total[ends])

    def _store(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        self._append(keys, np.array([i for x in ids for i in x], np.int32), np.cumsum([len(x) for x in ids]))

    def _append(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Enter words whose ids lie end to end in ``ids``, up to ``ends``."""
        self.tokens = np.concatenate([self.tokens, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.index.add(keys, np.arange(self.count, self.count + len(keys), dtype=np.int32))
        self.count += len(keys)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunk's rows end to end (int32), and the rows' offsets."""
        keys = chunk.word_hashes() | np.uint64(1)
        entry = self.index.find(keys)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            new, where = np.unique(keys[lost], return_index=True)
            if self.count + len(new) > (1 << self.bits) * 0.6:
                lost = np.arange(len(keys))
                new, where = np.unique(keys, return_index=True)
                while len(new) > (1 << self.bits) * 0.6:
                    self.bits += 1
                self._clear()
            raw = chunk.data.tobytes()
            first, last = chunk.starts[lost[where]].tolist(), chunk.ends[lost[where]].tolist()
            self._learn(new, [raw[a:b].decode("utf-8", "replace") for a, b in zip(first, last)])
            entry[lost] = self.index.find(keys[lost])
        sizes = self.starts[entry + 1] - self.starts[entry]
        ids = self.tokens[_spans(self.starts[entry], sizes)]
        total = np.append(0, np.cumsum(sizes))
        return ids, total[chunk.word_offsets]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of the ranges [start, start + size), end to end."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) if len(sizes) else np.empty(0, np.int64)
    return shift + np.arange(total)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer, with its table of words, for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def id_bytes(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Little-endian unsigned 32-bit ids, cut at ``starts``, as a binary column."""
    raw = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts * 4, np.int64)), raw])
