"""Whole-text encoding by the `tokenizers` library with a memo of pieces.

A byte-level BPE of this family cuts a text before each space that follows a
non-space character, so the ids of a text are the ids of its space-separated
pieces, one after the other.  Pieces recur far more often than texts do: the
merges of a piece are asked of the library's model once and remembered.
Texts for which that cut is not proven (runs of white space, white space other
than space and line feed, added tokens of the file, NUL) go to the library whole.

The memo is bounded by the bytes that it takes, and long pieces stay out of it.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import SparkSession

#: Bytes of memory for the pieces that one Python worker remembers; beyond it, half of them go.
MEMO_BYTES = 128 << 20
#: Longer pieces aren't remembered.
MEMO_PIECE = 128
#: Memory of an entry besides its characters and ids: two objects and their place in the table.
MEMO_ENTRY = 150
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 16 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"

_OTHER_SPACE = re.compile(r"[^\S \n]")

#: The pattern by which byte-level BPE splits a text, and the
#: characters that stand for bytes (printable ones for themselves, the others
#: from U+0100 on in ascending order).
_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
).findall
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {
    b: 0x100 + i for i, b in enumerate(x for x in range(0x100) if x not in _PRINTABLE)
}


def regular(text: str) -> bool:
    """Whether a text without added tokens may be cut before each of its spaces."""
    return not (
        "  " in text
        or "\n " in text
        or " \n" in text
        or "\0" in text
        or text[0] == " "
        or _OTHER_SPACE.search(text)
    )


def _begins(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo_bytes, self.used = memo_bytes, 0
        self.memo: dict[str, bytes] = {}

        self.merge = self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        """Ids of a text that can't be cut, from the library as it is."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, piece: str) -> bytes:
        """Ids of one piece of the library's own splitting pattern."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        return array("I", [t.id for t in self.merge(piece.translate(_BYTE_CHARS))]).tobytes()

    def _learn(self, part: str) -> bytes:
        memo, bare = self.memo, part[:1] == "\0"
        word = part[1:] if bare else part
        if word.isalpha():  # one piece of the pattern
            ids = self._model(word if bare else " " + word)
        else:
            out = []
            for piece in _SPLIT(word if bare else " " + word):
                key = piece[1:] if piece[0] == " " and len(piece) > 1 else "\0" + piece
                ids = memo.get(key)
                if ids is None:
                    ids = self._model(piece)
                    self._remember(key, ids)
                out.append(ids)
            ids = b"".join(out)
        self._remember(part, ids)
        return ids

    def _remember(self, part: str, ids: bytes) -> None:
        if len(part) <= MEMO_PIECE and part not in self.memo:
            self.memo[part] = ids
            self.used += MEMO_ENTRY + 2 * len(part) + len(ids)

    def _shrink(self) -> None:
        """Half of the memo goes where it is too large; the pieces met first are the frequent ones."""
        if self.used > self.memo_bytes:
            self.memo = dict(islice(self.memo.items(), len(self.memo) // 2))
            self.used = sum(MEMO_ENTRY + 2 * len(k) + len(v) for k, v in self.memo.items())

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular texts, one after the other, and the place where each begins."""
        cut = pc.split_pattern(pa.array(["\0" + t for t in texts], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        known, memo = coded.dictionary.to_pylist(), self.memo
        found = [memo.get(p) or self._learn(p) for p in known]
        self._shrink()
        ids, begin = np.frombuffer(b"".join(found), "<u4"), _begins([len(f) >> 2 for f in found])
        code = coded.indices.to_numpy()
        long = begin[code + 1] - begin[code]
        at = _begins(long)
        place = np.repeat(begin[code] - at[:-1], long)
        place += np.arange(len(place))
        return ids[place], at[cut.offsets.to_numpy()]

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and n + 1 places where texts begin and end."""
        added = self.added
        odd = {i for i, t in enumerate(texts) if t and (not regular(t) or any(a in t for a in added))}
        even = [i for i, t in enumerate(texts) if t and i not in odd]
        ids, begin = self._parts([texts[i] for i in even]) if even else (np.zeros(0, "<u4"), [0])
        if not odd and len(even) == len(texts):
            return ids, begin
        own = [ids[:0]] * len(texts)
        for k, i in enumerate(even):
            own[i] = ids[begin[k] : begin[k + 1]]
        for i in odd:
            own[i] = np.frombuffer(self.whole(texts[i]), "<u4")
        return np.concatenate(own or [ids]), _begins([len(x) for x in own])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, memo_bytes: int = MEMO_BYTES) -> PieceEncoder:
    """The encoder of this Python worker; a worker keeps its memo between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].memo_bytes = memo_bytes
    return _ENCODERS[path]


def forget() -> None:
    """Gives back the memory of encoders that earlier tasks left in this Python worker."""
    if _ENCODERS:
        _ENCODERS.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def bounded(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Bounds the bytes of the session's Arrow batches, from now on; a smaller bound stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most:
        spark.conf.set(_ARROW, str(most))


def in_runs(texts: list, most_chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of a list of texts of about so many characters: bounds a batch's memory."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= most_chars:
            yield slice(at, i + 1)
            at, chars = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def column_runs(column: pa.Array, most_bytes: int) -> Iterator[tuple[slice, list[str | None]]]:
    """Slices of a text column of about so many bytes, and their texts: only one slice is in Python's memory."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = sizes[at - 1] if at else 0
        stop = min(len(column), int(np.searchsorted(sizes, before + most_bytes)) + 1)
        yield slice(at, stop), column.slice(at, stop - at).to_pylist()
        at = stop
