"""Exact byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A pre-token is scanned once by an Aho-Corasick automaton over the vocabulary, which gives the longest token at each
position. The encoder takes the longest token, checks it against the token before it in a pair-compatibility table
(two neighbours are compatible if no merge across their border would have come before the merges that built them) and
steps to the token's next shorter prefix, or back, if they clash. That gives the merges' own result in linear time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from tokenizers import Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lodestream.llm.common import map_texts, ship

#: Entries of a task's memo of pre-tokens and of its memo of token pairs; at that size they start anew.
MEMO_ENTRIES = 300_000
#: Below this code point the split pattern has an equal for the standard library; above it Unicode versions differ.
PLAIN_BELOW = "\u0530"
#: The split pattern of the vocabulary and its equal for texts below PLAIN_BELOW. White space parts words in any case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\x09-\x0D \x85\xA0\w]|_)+"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordMemo(dict):
    """Pre-token -> its ids, packed; bounded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        packed = self.encode(word)
        if len(word) <= 64:
            self[word] = packed
        return packed


class Bpe:
    """An encoder and decoder for a vocabulary file of the tokenizers library (BPE with a word-end suffix)."""

    def __init__(self, spec: bytes):
        conf = json.loads(spec)
        model = conf["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.added = {k: v.to_bytes(4, "little") for k, v in added.items()}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in conf["added_tokens"]):
            raise ValueError("added tokens that take spaces, whole words or normalised text aren't supported")
        self.added_pattern = re.compile("(" + "|".join(re.escape(k) for k in sorted(added, key=len, reverse=True)) + ")") if added else None
        # What all added tokens begin with: a text without it holds none.
        self.added_start = os.path.commonprefix(list(added))
        split = next(p for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = re.compile(PLAIN_SPLIT).findall if pattern == SPLIT else None
        library = Tokenizer.from_str(spec.decode())
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        # Offset table: the written form of token i is text[offset[i]:offset[i + 1]]; a space ends each.
        names = [""] * size
        for t, i in [*vocab.items(), *added.items()]:
            names[i] = t
        forms = [t.encode() + b" " for t in names]
        self.length = np.array([len(f) for f in forms], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.blob = np.frombuffer(b"".join(forms), dtype=np.uint8)
        # Symbols: a character, or a character with the word end, which is one symbol of its own.
        self.symbols: list[str] = [""] * size
        for t, i in vocab.items():
            self.symbols[i] = self._symbols(t)
        ids = {s: i for i, s in enumerate(self.symbols) if s}
        self.pair: dict[int, int] = {}
        self.parts = [(i, i) for i in range(size)]
        last = -1
        for a, b in model["merges"]:
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z <= last:
                raise ValueError("the vocabulary's ids don't follow the order of its merges")
            last = z
            self.pair[x << 20 | y] = z
            self.parts[z] = (x, y)
        self.shorter = [-1] * size
        automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            automaton.add_word(s, i)
            self.shorter[i] = next((ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in ids), -1)
        automaton.make_automaton()
        self.automaton = automaton
        self.lengths = [len(s) for s in self.symbols]
        self.compatible: dict[int, bool] = {}
        self.memo = WordMemo(self._encode_word)

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000)
        return token

    def _fits(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side: undoing merges from the latest, no earlier merge crosses the border."""
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MEMO_ENTRIES:
                self.compatible.clear()
            known = self.compatible[key] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        bound = 1 << 30
        while True:
            if self.pair.get(left << 20 | right, bound) < bound:
                return False
            # The later of the two merges is undone first; at a tie, merges run from the left, so the right one is.
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    bound, inner = left, self.parts[left][1]
                    if inner != left:
                        left = inner
                        break
                else:
                    bound, inner = right + 1, self.parts[right][0]
                    if inner != right:
                        right = inner
                        break
                undo_left = not undo_left
            else:
                return True

    def ids_of(self, word: str) -> list[int]:
        """Ids of one pre-token, written in the vocabulary's symbols."""
        n, lengths, compatible = len(word), self.lengths, self.compatible
        longest = [-1] * n
        # Matches come by their ends, so the last one of a start is its longest.
        for end, i in self.automaton.iter(word):
            longest[end + 1 - lengths[i]] = i
        out: list[int] = []
        at, last = 0, -1
        while at < n:
            token = longest[at]
            if last >= 0:
                fits = compatible.get(last << 20 | token)
                if not (self._fits(last, token) if fits is None else fits):
                    return self._backtracked(n, longest)
            out.append(token)
            at += lengths[token]
            last = token
        return out

    def _backtracked(self, n: int, longest: list[int]) -> list[int]:
        """The same where a longest token clashes with the one before it."""
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        symbols, shorter = self.symbols, self.shorter
        while at < n:
            end = at + len(symbols[token])
            if open_at[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(symbols[token])
                # The token that led here is tried again and now finds its end closed.
        return out

    def _encode_word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            s = word
        else:
            alphabet = self.alphabet
            s = "".join([alphabet[b] for b in word.encode()])
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + 0x10000)
        return struct.pack(f"<{len(ids := self.ids_of(s))}I", *ids)

    def _lower(self, text: str) -> str:
        # Character by character: str.lower() alone would look at what stands around a capital sigma.
        return "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.added_pattern is not None and self.added_start in text:
            return b"".join(self.added[p] if p in self.added else self._plain(p) for p in self.added_pattern.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self.words is not None and (text.isascii() or max(text) < PLAIN_BELOW):
            return b"".join(map(self.memo.__getitem__, self.words(self._lower(unicodedata.normalize("NFC", text)))))
        words = self.pre_tokenize(self.normalize(text))
        return b"".join([self.memo[bytes(map(self.byte_of.__getitem__, w)).decode("utf-8")] for w, _ in words])

    def forget(self) -> None:
        self.memo.clear()

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the tokens' forms with a space between them, as a vocabulary without a decoder has it."""
        ids = np.frombuffer(packed, dtype="<u4")
        if not len(ids):
            return b""
        size = self.length[ids]
        ends = np.cumsum(size)
        where = np.repeat(self.offset[ids] - (ends - size), size)
        where += np.arange(ends[-1])
        return self.blob[where].tobytes()[:-1]


_loaded: dict[str, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """The encoder of a vocabulary file's bytes, built once a worker process."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def encode_documents(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids (binary, if with_ids), ids_sha256 and decoded_sha256 for each whole text.

    path: a vocabulary file that the driver can read; its bytes (fixed size) go to the workers by broadcast.
    Null and empty texts have no tokens. Repeated rows and other columns pass unchanged; columns of the added names
    are replaced. An empty table gives an empty table.
    """
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def make() -> Callable[[list[str | None]], list[list]]:
        bpe = loaded(spec.value)

        def work(texts: list[str | None]) -> list[list]:
            counts, packs, shas, decoded = [], [], [], []
            for t in texts:
                packed = bpe.encode(t) if t else b""
                counts.append(len(packed) // 4)
                packs.append(packed)
                shas.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            return [counts, *([packs] if with_ids else []), shas, decoded]

        work.close = bpe.forget
        return work

    fields = [("n_tokens", T.LongType()), *([("ids", T.BinaryType())] if with_ids else []), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(df, text, fields, make, keep)


def decode_documents(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text of a binary ids column; null ids give null."""
    ship(df.sparkSession)
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @pandas_udf(T.StringType())
    def decoded(packed: pd.Series) -> pd.Series:
        bpe = loaded(spec.value)
        return packed.map(lambda p: None if p is None else bpe.decode(bytes(p)).decode("utf-8", "replace"))

    return df.withColumn(out, decoded(df[ids]))
