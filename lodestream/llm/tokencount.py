"""Unigram token counts by dynamic programming that prefixes share.

The distinct pre-tokens of a slice of texts are the words of a trie. A walk through the trie in order computes, for each
node once, the best score of any segmentation that ends there and its number of tokens; the node that ends a pre-token
stores its count. The vocabulary file lists pieces by rank; a piece of rank r scores -1000 ln(r + 2), as frequencies fall
with rank, and a character without a piece costs BYTE_SCORE for each of its UTF-8 bytes, one token each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestream.llm.common import map_texts

BYTE_SCORE = -30_000
MEMO_ENTRIES = 200_000
#: Scores and counts share one number: the score in units, less the count, so that ties go to fewer tokens. No string has
#: so many bytes, and so no pre-token so many tokens.
UNIT = 1 << 32


def pieces_of(path: str) -> dict[str, int]:
    """Piece -> rank of a sentencepiece model's ordinary pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): r for r, i in enumerate(plain)}


class Counter:
    def __init__(self, ranks: dict[str, int]):
        # Pieces by their characters from the last to the first: all pieces that end at a node are on one path.
        self.ending: dict = {}
        for piece, rank in ranks.items():
            node = self.ending
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = round(-1000 * math.log(rank + 2)) * UNIT - 1
        self.memo: dict[bytes, int] = {}

    def count(self, words: list[str]) -> list[int]:
        """Token counts of sorted distinct words; the values along the last word's path serve the next one's prefix."""
        out, path, last = [], [0], ""
        ending = self.ending
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :]
            for i in range(shared, len(word)):
                c = word[i]
                width = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                best = path[i] + width * (BYTE_SCORE * UNIT - 1)
                node, at = ending.get(c), i
                while node is not None:
                    value = node.get("")
                    if value is not None and path[at] + value > best:
                        best = path[at] + value
                    at -= 1
                    if at < 0:
                        break
                    node = node.get(word[at])
                path.append(best)
            out.append(-path[-1] % UNIT)
            last = word
        return out

    def totals(self, texts: list[str | None]) -> list[list[int]]:
        """Words and tokens of each text; each word is counted with the mark of a word's start before it."""
        split = [(t or "").encode().split() for t in texts]
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        new = set().union(*split).difference(memo)
        if new:
            decoded = sorted((b"\xe2\x96\x81" + w).decode() for w in new)
            for w, n in zip(decoded, self.count(decoded), strict=True):
                memo[w[1:].encode()] = n
        return [[len(ws) for ws in split], [sum(map(memo.__getitem__, ws)) for ws in split]]


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words (runs without ASCII white space) and n_tokens for each whole text.

    path: a sentencepiece model that the driver can read; its pieces (a fixed number) go to the workers by broadcast.
    Null and empty texts have none. Other columns pass unchanged; columns of the added names are replaced. No shuffle.
    """
    ranks = df.sparkSession.sparkContext.broadcast(pieces_of(path))

    def make() -> Callable[[list[str | None]], list[list]]:
        counter = Counter(ranks.value)
        return counter.totals

    return map_texts(df, text, [("n_words", T.LongType()), ("n_tokens", T.LongType())], make, keep, rows=1024)
