"""Exact token ids of whole texts from a public tokenizer file, encoding each distinct word of a batch once.

A text is cut where the tokenizer's own pre-tokenizer always cuts, before a blank or a line end. The distinct chunks of
a batch are found by Arrow; each is encoded by the ``tokenizers`` library, and the ids of a text are the joined ids of
its chunks. A chunk that is one Latin word with ASCII punctuation behind it is cut into these two pre-tokens, which go
straight to the tokenizer's BPE model. A text in which white space makes a cut unsafe is encoded whole, and so is one
that holds the string of a special token, which becomes that token's id, as in a plain call of the library. The result
equals encoding the whole text, which the tests check.
"""
from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and other chunks, whose ids a Python worker keeps at most, twice over.
CACHED = 250_000
_NEW = object()
#: Bytes of text that are encoded together.
TOGETHER = 12 << 20

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation without the apostrophe, which can start a suffix
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_NO_SPACE, _KEPT_SPACE = (rf"^(?P<word>{line}{_LATIN})(?P<marks>[{re.escape(_MARKS)}]*)\z" for line in ("", r"\n?"))


class _Kept(dict):
    """Results of a function, kept from one batch to the next. When it is full, those that are not met again until it is full
    once more are forgotten, so that frequent ones stay."""

    def __init__(self, made: Callable[[str], bytes | None]):
        super().__init__()
        self.made, self.before = made, {}

    def __missing__(self, key: str) -> bytes | None:
        if len(self) >= CACHED:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key, _NEW)
        if found is _NEW:
            found = self.made(key)
        self[key] = found
        return found


class WordEncoder:
    """Encodes string arrays to ids. ``keep_space``: the tokenizer keeps white space in its tokens (byte level)."""

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.keep_space = keep_space
        self.words, self.marks, self.others = _Kept(self._word), _Kept(self._piece), _Kept(self._other)
        # byte-level alphabet: printable bytes stand for themselves, the rest follow from code point 256 on
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        self.alphabet = {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone, as little-endian unsigned 32-bit integers."""
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, from the tokenizer's BPE model."""
        if not piece:
            return b""
        shown = piece if piece.isascii() and piece[0] > " " else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a Latin word, of which a blank or a line end was cut off or is the first character."""
        if not self.keep_space:
            return self._piece(word.lower())
        return self._piece("\n") + self._piece(word[1:]) if word[0] == "\n" else self._piece(" " + word)

    def _other(self, chunk: str) -> bytes | None:
        """Ids of any other chunk; null where the cut behind it isn't safe."""
        if not self.keep_space:
            return self.whole(chunk) if chunk else b""
        if not chunk or chunk[-1].isspace():  # a longer run of white space
            return None
        line = chunk[0] == "\n"
        if line and chunk[1].isspace():  # the line end would become one token with it
            return None
        return self.whole(chunk if line else " " + chunk)

    def _chunks(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct chunks, and which of them are unsafe. Words and marks are parted and named by Arrow."""
        split = pc.extract_regex(chunks, _KEPT_SPACE if self.keep_space else _NO_SPACE)
        parts = []
        for name, known in (("word", self.words), ("marks", self.marks)):
            named = pc.struct_field(split, name).dictionary_encode()
            ids = [known[x] for x in named.dictionary.to_numpy(zero_copy_only=False)]
            parts.append(pa.array(ids, pa.large_binary()).take(named.indices))
        ids = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        rest = split.is_null()
        found = [self.others[x] for x in chunks.filter(rest).to_numpy(zero_copy_only=False)]
        unsafe = np.zeros(len(chunks), dtype=bool)
        unsafe[rest.to_numpy(zero_copy_only=False)] = [f is None for f in found]
        return pc.replace_with_mask(ids, rest, pa.array([f or b"" for f in found], pa.large_binary())), unsafe

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (``<u4``) of each whole text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.keep_space:  # "\n" before each text, whose id is taken off again: then no chunk is a text's first
            cut = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), texts, pa.scalar("", pa.large_string())), "\n", " \n")
        else:
            cut = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(cut, " ")
        ends = parts.offsets.to_numpy()
        named = parts.flatten().dictionary_encode()
        codes = named.indices
        found, unsafe = self._chunks(named.dictionary)
        joined = found.take(codes)
        ids = np.frombuffer(joined.buffers()[2] or b"", dtype="<u4")
        upto = np.frombuffer(joined.buffers()[1] or bytes(8), dtype=np.int64, count=len(joined) + 1) // 4
        unsafe = unsafe[codes.to_numpy()]
        if self.keep_space:
            unsafe[ends[:-1]] = False  # the empty chunk before the added line end
        bad = np.concatenate([[0], np.cumsum(unsafe)])[ends]
        special = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        doc = upto[ends]
        out = []
        for i in range(len(texts)):
            if special[i] or bad[i + 1] > bad[i]:
                out.append(np.frombuffer(self.whole(texts[i].as_py()), dtype="<u4"))
            else:
                out.append(ids[doc[i] + self.keep_space:doc[i + 1]])
        return out


@lru_cache(maxsize=4)
def encoder(path: str, keep_space: bool) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    return WordEncoder(path, keep_space)


def grouped(texts: pa.Array, target: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``target`` bytes each, so that working memory doesn't follow the batch's size."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= target:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)
