"""Byte-pair encoding against the tokenizers library, and token counts against all segmentations."""

import hashlib
import math
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestream.llm import bpe, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "e", "th", "in", "ing", "er", "zz", "q", "the", "'s", "'ll", " ", "é", "ß", "Σ", "ΑΣ", "İ", "<|endoftext|>", "<|", "1", "22", "!!", "😀", "日本", "́", "\n", "\x1c", "\x85", "​", "ſ", "²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoder_is_exact(library):
    with open(PATH, "rb") as f:
        own = bpe.loaded(f.read())
    rng = random.Random(0)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["a" * 50_000, "thinger" * 5000, "".join(map(chr, range(1, 0x1000)))]
    for text in texts:
        packed = own.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(packed).decode() == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_documents(library, docs, no_docs):
    got = bpe.encode_documents(docs, PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, r.text) and r.score == 0.5
    assert bpe.encode_documents(no_docs, PATH).collect() == []
    made = bpe.decode_documents(bpe.encode_documents(docs.filter("doc_id = 1"), PATH), PATH).first()
    assert hashlib.sha256(made.decoded.encode()).hexdigest() == made.decoded_sha256


def brute(word, ranks):
    """The best (score, fewest tokens) over all segmentations."""
    scores = {p: round(-1000 * math.log(r + 2)) for p, r in ranks.items()}

    def best(rest):
        if not rest:
            return (0, 0)
        options = []
        for k in range(1, len(rest) + 1):
            piece = rest[:k]
            if piece in scores:
                s, n = best(rest[k:])
                options.append((s + scores[piece], n - 1))
        s, n = best(rest[1:])
        width = len(rest[0].encode())
        options.append((s + width * tokencount.BYTE_SCORE, n - width))
        return max(options)

    return -best(word)[1]


def test_counts_against_all_segmentations():
    ranks = {"▁": 3, "a": 10, "b": 11, "ab": 4, "▁a": 5, "ba": 7, "abab": 30, "▁ab": 2, "bb": 20, "é": 9}
    rng = random.Random(1)
    words = sorted({"▁" + "".join(rng.choice("abéc") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    assert tokencount.Counter(ranks).count(words) == [brute(w, ranks) for w in words]


def test_count_documents(docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = tokencount.count_tokens(docs, path).collect()
    assert len(got) == docs.count()
    single = tokencount.Counter(tokencount.pieces_of(path))
    for r in got:
        words = (r.text or "").encode().split()
        assert r.n_words == len(words) and r.n_tokens == sum(single.count(["▁" + w.decode()])[0] for w in set(words) for _ in range(words.count(w))) if len(words) < 200 else True
    assert tokencount.count_tokens(no_docs, path).collect() == []
