"""Personal data by fixed patterns and a skip-chain conditional random field.

Tokens with a digit or an @ are the field's nodes. Neighbours share chain potentials; equal tokens, and tokens with equal
digits, share skip potentials however far apart they are, each with its next occurrence, so edges stay in proportion to
tokens. Loopy belief propagation passes messages over both kinds of edges, so a form that is clear in one place, by its
shape or by the words before it, is found in the others where it stands bare. Weights are fitted by pseudo-likelihood on a
bounded sample, labelled by the fixed patterns; forms that could be personal data but match no pattern stay unlabelled
there. What the field finds is added to the fixed patterns' spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import map_texts, ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents that the weights are fitted on, at most: those whose id and text have the smallest hashes; and tokens of each,
#: at most: those whose places have the smallest hashes.
SAMPLE_DOCS, SAMPLE_TOKENS = 3000, 300
ROUNDS, DAMPING, LEAST_MARGINAL = 30, 0.3, 0.6

# The fixed patterns, written so that no text makes them go back over it: a run of digits is never entered in its middle.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_SPACES = " \t\n\x0b\x0c\r"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; offsets are code points."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or an @, bare of outer punctuation."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        start = max(text.rfind(c, at, m.start()) for c in _SPACES) + 1 or at
        start = max(start, at)
        stop = _SPACE.search(text, m.end())
        end = at = stop.start() if stop else len(text)
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while start < end and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        if start < end:
            out.append((start, end))
    return out


# Features of a token, each a pattern or a count, with the prior weights of LABELS. What could be a phone number or not has
# about even weights, so that neighbours, cues and other mentions decide.
_SHAPES = (
    (re.compile(r".+@[^@]+\.[^@.]+"), (0, 7, 0, 0, 0)),
    (re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), (0, 0, 7, 0, 0)),
    (re.compile(r"[0-9]{4}"), (2, 0, 0, 1, 0)),
    (re.compile(r"\+[0-9]{1,3}"), (0, 0, 0, 0, 3)),
    (re.compile(r"\([0-9]{2,4}\)"), (0, 0, 0, 0, 2)),
    (re.compile(r"[0-9]{3}-[0-9]{4}"), (0, 0, 0, 0, 1.5)),
    (re.compile(r"\+?[0-9]{1,3}(?:[-.()][0-9]{2,4}){2,4}"), (0, 0, 0, 0, 1.5)),
    (re.compile(r"[0-9]{7,13}"), (0, 0, 0, 0, 1.5)),
)
# Numbers of a card's length, by whether the check digit is right.
_CARDS = ((3, 0, 0, 2, 0), (0, 0, 0, 7, 0))
_COUNTS = ((0, 0, (2, 0, 0, 0, 0)), (1, 5, (2, 0, 0, 0, 0)), (6, 13, (1, 0, 0, 0, 0)), (14, 19, (0, 0, 0, 1, 0)), (20, 1 << 62, (4, 0, 0, 0, 0)))
_LETTERS = (3, 1, 0, 0, 0)
# Words shortly before a token that speak for a kind, in the languages of the corpus.
_CUES = (frozenset("mail email e-mail correo courriel".split()), frozenset("ip host server serveur servidor".split()), frozenset("card visa mastercard karte carte tarjeta".split()), frozenset("tel phone call telefon telefono teléfono téléphone".split()))
_CUE_WEIGHT, _CUE_WORDS, _CUE_CHARS = 5, 4, 40
_BIAS = (1, 0, 0, 0, 0)
N_FEATURES = len(_SHAPES) + len(_CARDS) + len(_COUNTS) + 1 + len(_CUES) + 1
# Shapes from the fourth to the last of these leave a token without a label; so do cues.
_OTHER_FROM = len(_SHAPES) + len(_CARDS)
_CUE_IDS = range(_OTHER_FROM + len(_COUNTS) + 1, _OTHER_FROM + len(_COUNTS) + 1 + len(_CUES))
_CARD_FORM = re.compile(r"[0-9]{14,19}|[0-9]{4}(?:-[0-9]{2,7}){2,4}")


def prior() -> np.ndarray:
    """Weights (features, labels), then the chain's (labels, labels), then the skip edges' single weight."""
    cue_rows = [[_CUE_WEIGHT * (k == i + 1) for k in range(len(LABELS))] for i in range(len(_CUES))]
    unary = np.array([*[w for _, w in _SHAPES], *_CARDS, *[w for *_, w in _COUNTS], _LETTERS, *cue_rows, _BIAS], dtype=float)
    chain = np.zeros((len(LABELS), len(LABELS)))
    chain[3, 3], chain[4, 4] = 1.5, 2.5
    return np.concatenate([unary.ravel(), chain.ravel(), [4.0]])


def cues(text: str, at: int) -> list[int]:
    """The kinds that the words before a place speak for; words with a digit are no cues and end the search."""
    found = []
    for word in reversed(text[max(0, at - _CUE_CHARS) : at].lower().split()[-_CUE_WORDS:]):
        if _MARK.search(word):
            break
        found += [i for i, words in enumerate(_CUES) if word.strip(".,:;#=()") in words]
    return found


def feature_ids(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    out = []
    cards = len(_SHAPES)
    counts = cards + len(_CARDS)
    letters = counts + len(_COUNTS)
    for s, e in spans:
        token = text[s:e]
        digits = "".join(_DIGITS.findall(token))
        n = len(digits)
        ids = [i for i, (p, _) in enumerate(_SHAPES) if p.fullmatch(token)]
        if 14 <= n <= 19 and _CARD_FORM.fullmatch(token):
            ids.append(cards + luhn(digits))
        ids += [counts + i for i, (lo, hi, _) in enumerate(_COUNTS) if lo <= n <= hi]
        if any(c.isalpha() for c in token) and "@" not in token:
            ids.append(letters)
        ids += sorted({letters + 1 + i for i in cues(text, s)})
        out.append([*ids, N_FEATURES - 1])
    return out


def edges(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between tokens with only white space between them, and skip edges to the next similar token.

    Tokens are similar if their forms are equal but for case, or their digits; of phone numbers the last seven count.
    """
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 8 and not text[spans[i][1] : spans[i + 1][0]].strip()]
    skip, last = set(), {}
    for i, (s, e) in enumerate(spans):
        form = text[s:e].lower()
        digits = "".join(_DIGITS.findall(form)) if not any(c.isalpha() for c in form) else ""
        keys = {("form", form)}
        if len(digits) >= 7:
            keys.add(("digits", digits[-7:] if len(digits) < 14 else digits))
        for key in keys:
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
    return chain, sorted(skip)


def _split(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    k, u = len(LABELS), N_FEATURES * len(LABELS)
    return w[:u].reshape(N_FEATURES, k), w[u : u + k * k].reshape(k, k), float(w[-1])


def marginals(ids: list[list[int]], chain: list[tuple[int, int]], skip: list[tuple[int, int]], weights: np.ndarray) -> np.ndarray:
    """Beliefs (tokens, labels) by sum-product belief propagation with damped messages."""
    unary, pair, same = _split(weights)
    k, n = len(LABELS), len(ids)
    node = np.array([unary[x].sum(axis=0) for x in ids]) if n else np.zeros((0, k))
    both = chain + skip
    if both:
        e = np.array(both)
        tables = np.concatenate([np.repeat(pair[None], len(chain), 0), np.repeat((same * np.eye(k))[None], len(skip), 0)])
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        tables = np.exp(np.concatenate([tables, tables.transpose(0, 2, 1)]))
        m = len(both)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        log = np.zeros((2 * m, k))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, dst, log)
            out = total[src] - log[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, tables))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - log).max()
            log = DAMPING * log + (1 - DAMPING) * new
            if moved < 1e-4:
                break
        np.add.at(node, dst, log)
    p = np.exp(node - node.max(axis=1, keepdims=True)) if n else node
    return p / p.sum(axis=1, keepdims=True) if n else p


def _plausible(kind: int, form: str) -> bool:
    n = len(_DIGITS.findall(form))
    return (kind == 0 and "@" in form[1:]) or (kind == 1 and form.count(".") == 3 and n >= 4) or (kind == 2 and 14 <= n <= 19) or (kind == 3 and 7 <= n <= 15)


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the field finds and no base span touches; neighbouring card or phone tokens join."""
    spans = tokens(text)
    if not spans:
        return []
    chain, skip = edges(text, spans)
    p = marginals(feature_ids(text, spans), chain, skip, weights)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    joined: list[list[int]] = []
    linked = {b for _, b in chain}
    for i, (s, e) in enumerate(spans):
        k = int(best[i]) - 1
        if k < 0 or sure[i] < LEAST_MARGINAL:
            continue
        if joined and i in linked and joined[-1][1] == k and joined[-1][3] == i - 1 and (k == 3 or (k == 2 and e - s <= 6)):
            joined[-1][2:] = [e, i]
        else:
            joined.append([s, k, e, i])
    out = []
    at = 0
    for s, k, e, _ in joined:
        while at < len(base) and base[at][2] <= s and base[at][0] < s:
            at += 1
        touched = any(b[0] < e and s < b[2] for b in base[max(0, at - 4) : at + 8])
        if not touched and _plausible(k, text[s:e]):
            out.append((s, k, e))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _sample_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a sampled token with a label: its features, its label, its neighbours' labels, and its similar tokens'.

    Labels are those of the fixed patterns; -1 stands for none: what could be personal data but matches no pattern.
    """
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            spans = tokens(text)
            ids = feature_ids(text, spans)
            base = base_spans(text)
            unsure = [(m.start(), m.end()) for p in (_CARD, _PHONE) for m in p.finditer(text) if m.end() - m.start() >= 10]
            labels, at, doubt = [], 0, 0
            for (s, e), x in zip(spans, ids, strict=True):
                while at < len(base) and base[at][2] <= s:
                    at += 1
                while doubt < len(unsure) and unsure[doubt][1] <= s:
                    doubt += 1
                own = next((k for b, k, f in base[at : at + 4] if b < e and s < f), None)
                open_ = any(b < e and s < f for b, f in unsure[doubt : doubt + 4]) or any(3 <= i < _OTHER_FROM for i in x) or any(i in _CUE_IDS for i in x)
                labels.append(own + 1 if own is not None else -1 if open_ else 0)
            chain, skip = edges(text, spans)
            before, after, same = {b: labels[a] for a, b in chain}, {a: labels[b] for a, b in chain}, [[0] * len(LABELS) for _ in spans]
            for a, b in skip:
                for x, y in ((a, b), (b, a)):
                    if labels[y] >= 0:
                        same[x][labels[y]] += 1
            chosen = sorted((i for i, label in enumerate(labels) if label >= 0), key=lambda i: hashlib.blake2b(i.to_bytes(8, "little"), digest_size=8).digest())[:SAMPLE_TOKENS]
            rows += [(ids[i], labels[i], before.get(i, -1), after.get(i, -1), same[i]) for i in chosen]
        yield pd.DataFrame(rows, columns=["ids", "label", "before", "after", "same"])


def fitted(rows: list, rounds: int = 60, rate: float = 0.5, ridge: float = 0.02) -> np.ndarray:
    """Weights by pseudo-likelihood: each labelled token given its neighbours' labels; a ridge pulls to the prior.

    Cues and the skip weight keep their prior: a label by a fixed pattern never depends on them.
    """
    w0 = prior()
    if not rows:
        return w0
    k = len(LABELS)
    x = np.zeros((len(rows), N_FEATURES))
    for i, r in enumerate(rows):
        x[i, list(r.ids)] = 1
    y, p, q = (np.array([r[c] for r in rows]) for c in ("label", "before", "after"))
    s = np.array([r.same for r in rows], dtype=float)
    one = np.eye(k)
    hp, hq = np.where(p[:, None] >= 0, one[p], 0.0), np.where(q[:, None] >= 0, one[q], 0.0)
    w, n = w0.copy(), len(y)
    free = np.ones_like(w0)
    free[[i * k + j for i in _CUE_IDS for j in range(k)]] = 0
    free[-1] = 0
    for _ in range(rounds):
        u, c, v = _split(w)
        z = x @ u + hp @ c + hq @ c.T + v * s
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = one[y] - z / z.sum(axis=1, keepdims=True)
        g = np.concatenate([(x.T @ d).ravel(), (hp.T @ d + d.T @ hq).ravel(), [0.0]]) / n - ridge * (w - w0)
        w += rate * g * free
    return w


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Weights fitted on at most sample_docs documents that hold a digit or an @; without any, the prior."""
    ship(docs.sparkSession)
    own = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("__key"), F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    # At most sample_docs keys, so small enough to send to all.
    chosen = own.select("__key").distinct().orderBy("__key").limit(sample_docs)
    found = own.join(F.broadcast(chosen), "__key").dropDuplicates(["__key"]).select("text")
    made = found.mapInPandas(_sample_tokens, "ids array<int>, label int, before int, after int, same array<int>")
    # At most sample_docs times SAMPLE_TOKENS rows of some numbers.
    return fitted(sorted(made.collect()))


def find_documents(df: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None, with_redacted: bool = False, prefix: str = "") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base_sha256 of the fixed patterns' spans, and spans, all spans.

    A span is kind:start:end in code points, by start and then kind, comma-joined. With with_redacted also redacted, the
    text with its spans replaced. Null and empty texts have no spans; a null text stays null. Other columns pass
    unchanged; columns of the added names are replaced; prefix goes before the added names. No shuffle.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        def work(texts: list[str | None]) -> list[list]:
            out: list[list] = [[] for _ in range(7 if with_redacted else 6)]
            for t in texts:
                base, every = [], []
                if t and _MARK.search(t):
                    base = base_spans(t)
                    every = sorted(base + added_spans(t, base, weights))
                counts = [0] * 4
                for _, k, _ in base:
                    counts[k] += 1
                made = [*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), redacted(t, every) if every else t]
                for column, v in zip(out, made, strict=False):
                    column.append(v)
            return out

        return work

    fields = [*[(f"n_{k}", T.LongType()) for k in KINDS], ("base_sha256", T.StringType()), ("spans", T.StringType())]
    fields += [("redacted", T.StringType())] if with_redacted else []
    return map_texts(df, text, [(prefix + n, t) for n, t in fields], make, keep)
