"""Token ids of whole texts by a public tokenizer file, a chunk at a time.

Natural text repeats its words, so each task keeps the ids of the chunks it has
met.  A text is cut only where the tokenizer itself always cuts, so the ids
equal those of one call over the whole text; texts with white space in unusual
places are encoded by such a call.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks that a task keeps; a full table is emptied and refills with the frequent ones.
CHUNKS_KEPT = 600_000

#: Chunks of these characters (less those that begin a special token) are cut into the tokenizer's words here and only
#: looked up in its model; others go through all of it.
PLAIN = r"\x21-\x7e\u00c0-\u024f"
#: Words of the two kinds of tokenizer (fixed patterns of their files).
WORDS = {
    "spaced": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    "bare": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"),
}


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


SIGNS = _byte_signs()
SPACE = SIGNS[32]

_OPEN: dict = {}


def tokenizer_file(name_or_path: str) -> str:
    """A path, or the place of a named file of the public vocabularies."""
    if os.path.exists(name_or_path):
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class ChunkTokenizer:
    """``kind`` 'spaced': a single space belongs to the word behind it (byte-level BPE);
    'bare': white space is dropped (BPE with word ends)."""

    def __init__(self, path: str, kind: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(path))
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind, self.dtype = kind, np.dtype(dtype)
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._heads: dict[str, bytes | None] = {}
        self._chunks: dict[str, bytes | None] = {}
        self._words: dict[str, bytes] = {}
        self._tokenize = self.tokenizer.model.tokenize
        self._bytes = [array(self._code, [i]).tobytes() for i in range(self.vocab_size)]
        begin = "".join(sorted({regex.escape(t.content[0]) for t in self.tokenizer.get_added_tokens_decoder().values()}))
        self._plain = regex.compile(f"(?V1)[[{PLAIN}]--[{begin or ' '}]--[\\u0130]]+").fullmatch
        self._cut = WORDS[kind].findall if self._same_words() else None

    def _same_words(self) -> bool:
        """Whether the file cuts and writes words as ``kind`` says; if not, chunks go through all of the tokenizer."""
        probe = "Don't stop" if self.kind == "spaced" else "don't stop"
        pre, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        want = [w.encode().decode("latin-1").translate(SIGNS) for w in WORDS[self.kind].findall(probe)]
        return pre is not None and type(model).__name__ == "BPE" and not model.dropout and [w for w, _ in pre.pre_tokenize_str(probe)] == want

    @classmethod
    def shared(cls, path: str, kind: str, dtype: str = "<u4") -> ChunkTokenizer:
        """One instance for each process and vocabulary."""
        key = (path, kind, dtype)
        if key not in _OPEN:
            _OPEN[key] = cls(path, kind, dtype)
        return _OPEN[key]

    def forget(self) -> None:
        """Give back the memory of all kept chunks: at the end of a task, as a worker may do other work next."""
        self._heads, self._chunks, self._words = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str, signs: str | None = None) -> bytes:
        """Ids of one of the tokenizer's words; ``signs``: the same with a sign for each byte."""
        if signs is None:
            signs = word.encode().decode("latin-1").translate(SIGNS)
        bytes_of = self._bytes
        ids = self._words[word] = b"".join([bytes_of[t.id] for t in self._tokenize(signs)])
        return ids

    def _learn(self, table: dict, chunks, lead: str) -> None:
        """Enter the ids of ``lead + chunk``; None for chunks that can't be cut off from their neighbours."""
        rest, plain, words, cut, word = [], self._plain, self._words, self._cut, self._word
        if len(words) + len(chunks) > CHUNKS_KEPT:
            words.clear()
        get, lower = words.get, self.kind == "bare"
        front = SPACE if lead else ""
        for chunk in chunks:
            if cut is None:
                rest.append(chunk)
                continue
            whole = chunk.lower() if lower else lead + chunk
            if chunk.isascii():
                if chunk.isalpha():
                    table[chunk] = get(whole) or word(whole, whole if lower else front + chunk)
                    continue
                if chunk and chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
                    body, tail = whole[:-1], whole[-1]
                    table[chunk] = (get(body) or word(body, body if lower else front + chunk[:-1])) + (get(tail) or word(tail))
                    continue
            if plain(chunk):
                table[chunk] = b"".join([get(w) or word(w) for w in cut(whole)])
            else:
                rest.append(chunk)
        if rest:
            got = self.tokenizer.encode_batch_fast([lead + c for c in rest], add_special_tokens=False)
            for chunk, enc in zip(rest, got, strict=True):
                table[chunk] = array(self._code, enc.ids).tobytes()
                if lead and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
                    table[chunk] = None  # a space beside other white space isn't cut off alone

    def encode(self, texts) -> list[bytes]:
        """Ids of each text (a list or an Arrow array of strings without nulls) as little-endian integers of ``dtype``.

        The chunks of all texts are split, numbered and put together again by
        Arrow; only distinct chunks are looked up here."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        spaced = self.kind == "spaced"
        split = pc.split_pattern(texts if spaced else pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        chunks, table = coded.dictionary.to_pylist(), self._chunks
        ids = list(map(table.get, chunks))
        if None in ids:
            fresh = [c for c, x in zip(chunks, ids, strict=True) if x is None]
            if len(table) + len(fresh) > CHUNKS_KEPT:
                table.clear()
            self._learn(table, fresh, " " if spaced else "")
            ids = [table[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
        number = coded.indices.to_numpy()
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        whole: set[int] = set()
        if None in ids:
            odd = np.array([x is None for x in ids])
            inner = odd[number]
            inner[ends[:-1]] = False  # the first chunk of a text is looked at by itself
            whole = set((np.searchsorted(ends, np.flatnonzero(inner), "right") - 1).tolist())
        joined = pa.array([x or b"" for x in ids], pa.large_binary()).take(coded.indices)
        _, starts, data = joined.buffers()
        starts = np.frombuffer(starts, np.int64, len(joined) + 1, joined.offset * 8)
        data = memoryview(data) if data is not None else memoryview(b"")
        out = []
        for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            head = b""
            if spaced:
                head = None if d in whole else self._head(chunks[number[a]], b - a > 1)
                a += 1
            out.append(self.whole(texts[d].as_py()) if head is None else head + bytes(data[starts[a] : starts[b]]))
        return out

    def _head(self, chunk: str, more: bool) -> bytes | None:
        """Ids of the first chunk, which no space leads; None if the text must be encoded whole."""
        if more and (not chunk or chunk[-1].isspace()):
            return None
        if chunk not in self._heads:
            if len(self._heads) >= CHUNKS_KEPT // 4:
                self._heads.clear()
            self._learn(self._heads, [chunk], "")
        return self._heads[chunk]


def batches(texts, limit: int = 1 << 23):
    """Slices (first, stop) of an Arrow array of strings with about ``limit`` bytes each; a longer text has one of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def texts_of(column) -> pa.Array:
    """A column of strings, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")
