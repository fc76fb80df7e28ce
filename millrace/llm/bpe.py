"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The merges of a vocabulary decide for each pair of tokens whether the two can
stand side by side in an encoding: they can't if, while the merges that build
both run in rank order, a merge across their boundary comes first.  A sequence
of tokens that tiles a word and has only compatible neighbours is the encoding
of that word, and the only one.  So a word is encoded by taking the longest
token at each place (an Aho-Corasick automaton finds them in one pass over the
text) and checking it against the pair table; where the check fails, the last
token gives way to the next shorter one.  Each place is left for good at most
once, so the work is linear in the word.

Whole batches of words run through the automaton as one string and the pair
check as one array operation; only words in which some neighbours don't fit
enter the backtracking loop.  Words recur, so each Python worker remembers the
ids of the white-space-separated parts it has met, up to a bound.

Decoding puts the texts of tokens together from one blob and a table of
offsets, with a space between tokens, as the library does for a tokenizer file
without a decoder.

Defined results: null text is an empty one; empty text has no tokens and an
empty decoded text; repeated rows and doc_ids stay separate rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import _BYTE_CHARS, MEMO_BYTES, MEMO_ENTRY, MEMO_PIECE, _begins, bounded, column_runs

#: Stands for the end of a word, one character in place of the file's suffix.
END = ""
#: Bytes of text encoded at once.
RUN_BYTES = 4_000_000

#: The white space of the files' patterns, as character ranges.
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_SPACES = re.compile(f"[{_SPACE}]+")
_CONTROL = re.compile("[\\x1c-\\x1f]")


class Vocabulary:
    """Tokens, pair table, automaton and offset table of a tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.marker = END if suffix else ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        text_of = {i: t for t, i in {**model["vocab"], **self.special}.items()}

        def own(token: str) -> str:
            return token[: -len(suffix)] + END if suffix and token.endswith(suffix) else token

        self.id_of = {own(t): i for t, i in model["vocab"].items()}
        n = max(text_of) + 1
        self.rank = np.full(n, -1, np.int64).tolist()
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (own(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, both = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.merge[left, right] = rank
            if self.parts[both] is None:
                self.parts[both], self.rank[both] = (left, right), rank
        self.length = np.zeros(n, np.int64)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            if self.parts[i] is not None or len(token) - token.endswith(END) == 1:
                self.automaton.add_word(token, i)
                self.length[i] = len(token)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        #: decoding: an array of strings is a blob and its offsets
        self.texts = pa.array([text_of.get(i, "") for i in range(n)], pa.string())
        self.decimals = pa.array([str(i) for i in range(n)], pa.string())

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Tokens that stand at one end of a token while it is built: (token, made, used)."""
        out, used = [], 1 << 60
        while True:
            out.append((token, self.rank[token], used))
            if self.parts[token] is None:
                return out
            used, token = self.rank[token], self.parts[token][side]

    def fit(self, left: int, right: int) -> bool:
        """Whether the two can be neighbours; of merges of one rank the left one runs first."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = True
            for a, made_a, used_a in self._edge(left, 1):
                for b, made_b, used_b in self._edge(right, 0):
                    rank = self.merge.get((a, b))
                    if rank is not None and made_a <= rank < used_a and made_b < rank <= used_b:
                        known = False
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def backtrack(self, word: str) -> list[int]:
        """Ids of one word (mapped characters and end mark)."""
        n = len(word)
        found: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(word):
            found[end - self.length[token] + 1].append(token)  # ascending length
        out: list[int] = []
        at, options = 0, [list(x) for x in found]
        dead = [False] * (n + 1)  # no valid continuation from here
        while at < n:
            while options[at]:
                token = options[at].pop()
                after = at + int(self.length[token])
                if not dead[after] and (not out or self.fit(out[-1], token)):
                    out.append(token)
                    at = after
                    break
            else:
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                dead[at] = True
                options[at] = list(found[at])
                at -= int(self.length[out.pop()])
        return out

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of many words, each of mapped characters and end mark."""
        if not words:
            return []
        ends, tokens = [], []
        for end, token in self.automaton.iter_long("\n".join(words)):
            ends.append(end)
            tokens.append(token)
        ends, tokens = np.array(ends, np.int64), np.array(tokens, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        begin = _begins(sizes + 1)
        word = np.searchsorted(begin, ends, "right") - 1
        starts = ends - self.length[tokens] + 1
        first = np.searchsorted(word, np.arange(len(words)))
        last = np.searchsorted(word, np.arange(len(words)), "right")
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, where = np.unique(tokens[inner] << 32 | tokens[inner + 1], return_inverse=True)
        fits = np.array([self.fit(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], bool)
        wrong = np.zeros(len(words), bool)
        wrong[word[inner[~(fits[where] if len(keys) else np.ones(0, bool))]]] = True
        wrong[word[inner[starts[inner + 1] != ends[inner] + 1]]] = True
        wrong |= first == last
        some = np.flatnonzero(~wrong)
        wrong[some[(starts[first[some]] != begin[some]) | (ends[last[some] - 1] != begin[some + 1] - 2)]] = True
        return [
            np.array(self.backtrack(w), np.int64) if bad else tokens[a:b]
            for w, bad, a, b in zip(words, wrong.tolist(), first.tolist(), last.tolist())
        ]

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
        """Decoded text of each run of ids."""
        return _joined(self.texts, ids, begin)


def _joined(table: pa.Array, ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The table's strings for each run of ids, joined by one space."""
    if len(ids) > 50_000_000:  # one very long text: beyond Arrow's 32-bit offsets
        strings = table.to_pylist()
        joined = [" ".join([strings[i] for i in ids[a:b].tolist()]) for a, b in zip(begin[:-1], begin[1:])]
        return pa.array(joined, pa.large_string())
    runs = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), table.take(pa.array(ids)))
    return pc.binary_join(runs, " ")


class WordEncoder:
    """Whole texts to ids for files that lower-case and drop white space."""

    #: Fixed value: the pattern of words of these files.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        self.vocabulary = Vocabulary(path)
        self.memo: dict[str, bytes] = {}
        self.memo_bytes, self.used = memo_bytes, 0
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    @staticmethod
    def normal(part: str) -> str:
        """NFC and lower case, character by character."""
        if part.isascii():
            return part.lower()
        part = unicodedata.normalize("NFC", part)
        return "".join([c.lower() for c in part]) if "Σ" in part else part.lower()

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        words, owner = [], []
        for k, part in enumerate(parts):
            part = self.normal(part)
            for piece in [part] if part.isalpha() else self.PATTERN(part):
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1")
                words.append(piece.translate(_BYTE_CHARS) + self.vocabulary.marker)
                owner.append(k)
        found = self.vocabulary.words(words)
        flat = np.concatenate(found).astype("<u4") if found else np.zeros(0, "<u4")
        each = _begins(np.bincount(owner, [len(f) for f in found], len(parts)).astype(np.int64) if words else np.zeros(len(parts), np.int64))
        raw = flat.tobytes()
        return {part: raw[a:b] for part, a, b in zip(parts, (4 * each[:-1]).tolist(), (4 * each[1:]).tolist())}

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts without special tokens and control separators."""
        cut = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        return self._coded(cut.values.dictionary_encode(), cut.offsets.to_numpy())

    def _coded(self, coded: pa.DictionaryArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, memo = coded.dictionary.to_pylist(), self.memo
        new, own = [p for p in known if p not in memo], {}
        for i in range(0, len(new), 50_000):
            own |= self._learn(new[i : i + 50_000])
        found = [memo.get(p) or own.get(p) or b"" for p in known]
        for part, ids in own.items():
            if len(part) <= MEMO_PIECE:
                memo[part] = ids
                self.used += MEMO_ENTRY + 2 * len(part) + len(ids)
        if self.used > self.memo_bytes:  # the parts met first are the frequent ones
            self.memo = dict(islice(memo.items(), len(memo) // 2))
            self.used = sum(MEMO_ENTRY + 2 * len(k) + len(v) for k, v in self.memo.items())
        ids, begin = np.frombuffer(b"".join(found), "<u4"), _begins([len(f) >> 2 for f in found])
        code = coded.indices.to_numpy()
        long = begin[code + 1] - begin[code]
        at = _begins(long)
        place = np.repeat(begin[code] - at[:-1], long)
        place += np.arange(len(place))
        return ids[place], at[offsets]

    def _odd(self, text: str) -> np.ndarray:
        """A text with special tokens, or characters that Arrow takes for white space."""
        out = []
        for k, run in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(np.array([self.vocabulary.special[run]], "<u4"))
                continue
            parts = [p for p in _SPACES.split(run) if p]
            if parts:
                array = pa.array(parts, pa.large_string()).dictionary_encode()
                out.append(self._coded(array, np.array([0, len(parts)]))[0])
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and n + 1 places where texts begin and end."""
        special = list(self.vocabulary.special)
        odd = {i for i, t in enumerate(texts) if t and (any(s in t for s in special) or _CONTROL.search(t))}
        ids, begin = self._plain(["" if i in odd else t or "" for i, t in enumerate(texts)])
        if not odd:
            return ids, begin
        own = [self._odd(t) if i in odd else ids[begin[i] : begin[i + 1]] for i, t in enumerate(texts)]
        return np.concatenate(own), _begins([len(x) for x in own])


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; a worker keeps its memo between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's `ids` and its `decoded` text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer)
        for batch in batches:
            for of, texts in column_runs(batch.column(1), RUN_BYTES):
                ids, begin = coder.batch(texts)
                lists = pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(ids.astype(np.int32)))
                columns = [
                    batch.column(0)[of.start : of.stop], lists,
                    coder.vocabulary.decode(ids, begin).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, f"{id_col} long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and SHA-256 of each document's ids, SHA-256 of its decoded text.

    The digests are taken where the texts are encoded, so neither ids nor
    decoded texts leave the Python worker.
    """

    def sha(texts: pa.Array) -> pa.Array:
        found = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
        return pa.array(found, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer)
        for batch in batches:
            for of, texts in column_runs(batch.column(1), RUN_BYTES):
                ids, begin = coder.batch(texts)
                columns = [
                    batch.column(0)[of.start : of.stop], pa.array(np.diff(begin)),
                    sha(_joined(coder.vocabulary.decimals, ids, begin)),
                    sha(coder.vocabulary.decode(ids, begin)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
