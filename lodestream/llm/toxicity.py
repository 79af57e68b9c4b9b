"""Toxicity by a lexicon trie met with Levenshtein automata, weighed by the words around each hit.

The lexicon is a short fixed list plus words and stems learned from labels. Its trie is intersected with the Levenshtein
automata of its entries once, by subset construction, into one deterministic automaton; a token is a hit if the
automaton accepts it, so misspellings cost no more than right spellings. Around each hit a context window looks for
quotation (quote marks on both sides, reporting words) and for address (second person, shouting). Hits become a few
sums a text, and a logistic model fitted on labelled rows turns them into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import forget, map_texts, ship, stored, word_array

# Abusive English words, and the words that report or address.
SEED_WORDS = ["bastard", "clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
# Ordinary words within the edits of an entry.
ORDINARY = frozenset("apathetic blown boron brash closer crash crown dastard digesting discussing flown idiom laser loner loper loses lower mirthless poser thrash".split())
REPORTING = frozenset("said says say called calls quoted quote quotes wrote writes word words term terms saying dit mot terme appelle sagte nannte wort begriff dijo palabra llama".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein ihr tu toi ton vous eres usted".split())
QUOTES = "\"'«»„“”‘’‹›`"

#: Labelled rows that lexicon and model are fitted on, at most: the rows whose doc_id has the smallest hashes.
SAMPLE_ROWS = 8000
#: Different texts of one labelled doc_id that are learned from, at most: those with the smallest hashes.
TEXTS_OF_ID = 4
#: Words over so many letters are no lexicon entries; learned stems have so many letters. Scoring looks at all words.
LONGEST_WORD, STEM_LETTERS = 24, range(4, 11)
#: Learned entries, at most, and what an entry needs: toxic rows, their share of its rows, and a z value.
LEXICON_ENTRIES, LEAST_ROWS, LEAST_SHARE, LEAST_Z = 64, 4, 0.4, 5.0
#: Edits allowed in a whole-word entry by its length; stems allow none, as any ending may follow them. So that misspellings
#: stay hits, words stay entries beside a stem, up to LEXICON_ENTRIES learned ones and all fixed ones.
EDITS = ((9, 2), (5, 1))
#: Tokens on either side of a hit that its context score looks at.
WINDOW = 6
MEMO_ENTRIES = 200_000
FEATURES = ("word_strength", "stem_strength", "stem_rate", "fuzzy_strength")
#: Without labels: the intercept and the weights of FEATURES.
DEFAULT_WEIGHTS = (-4.5, 9.0, 1.0, 1.0, 8.0)


def edits_of(entry: str, stem: bool) -> int:
    return 0 if stem else next((k for n, k in EDITS if len(entry) >= n), 0)


class LexiconAutomaton:
    """The determinised meeting of the lexicon trie with its entries' Levenshtein automata.

    A subset state holds (trie node, edits so far) pairs. Character classes are the lexicon's own characters and one
    class for all others. match(token) gives (entry index, edits) or None.
    """

    def __init__(self, entries: list[tuple[str, bool]], exact: frozenset[str] = frozenset()):
        """exact: the entries that allow no edits."""
        self.entries = entries
        self.edits = [0 if text in exact else edits_of(text, stem) for text, stem in entries]
        children: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, int, bool]]] = [[]]
        most = [0]
        for k, (text, stem) in enumerate(entries):
            node, allowed = 0, self.edits[k]
            most[0] = max(most[0], allowed)
            for c in text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    most.append(0)
                node = children[node][c]
                most[node] = max(most[node], allowed)
            ends[node].append((k, allowed, stem))
        self.children, self.ends, self.most = children, ends, most
        self.alphabet = sorted({c for text, _ in entries for c in text})
        self.start = self._closed({(0, 0)})
        self.states: dict[frozenset, int] = {self.start: 0}
        self.sets = [self.start]
        self.verdicts = [self._verdict(self.start)]
        self.steps: list[dict[str, int]] = [{}]
        self.longest = max((len(t) + e for (t, _), e in zip(entries, self.edits, strict=True)), default=0)

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the entry characters that the token leaves out, and only the fewest edits for each node."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(x, e + 1) for x in self.children[node].values()]
        return frozenset(best.items())

    def _verdict(self, state: frozenset) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
        """The best entry if the token ends here, and the best stem that is met whatever follows."""
        word = stem = None
        for node, e in state:
            for k, allowed, is_stem in self.ends[node]:
                if e > allowed:
                    continue
                found = (e, k)
                if is_stem:
                    stem = min(stem or found, found)
                else:
                    word = min(word or found, found)
        return word, stem

    def _step(self, at: int, c: str) -> int:
        known = self.steps[at].get(c)
        if known is None:
            out = set()
            for node, e in self.sets[at]:
                out.add((node, e + 1))
                for x, child in self.children[node].items():
                    out.add((child, e + (x != c)))
            state = self._closed(out)
            known = self.states.get(state)
            if known is None:
                known = self.states[state] = len(self.sets)
                self.sets.append(state)
                self.verdicts.append(self._verdict(state))
                self.steps.append({})
            self.steps[at][c] = known
        return known

    def match(self, token: str) -> tuple[int, int] | None:
        at, stem = 0, None
        for c in token[: self.longest + 1]:
            at = self._step(at, c if c in self._letters else "\0")
            if not self.sets[at]:
                break
            stem = self.verdicts[at][1] or stem
        word = self.verdicts[at][0] if len(token) <= self.longest else None
        best = min(x for x in (word, stem) if x) if word or stem else None
        return None if best is None else (best[1], best[0])

    @property
    def _letters(self) -> frozenset:
        if not hasattr(self, "_set"):
            self._set = frozenset(self.alphabet)
        return self._set


@dataclass
class Model:
    """Lexicon entries (text, is a stem), those that allow no edits, and the logistic model's intercept and weights."""

    entries: list[tuple[str, bool]] = field(default_factory=lambda: [(w, False) for w in SEED_WORDS])
    weights: tuple[float, ...] = DEFAULT_WEIGHTS
    exact: frozenset[str] = frozenset()


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = LexiconAutomaton(model.entries, model.exact)
        # Stems, and learned words that the fixed list doesn't vouch for, may also stand in clean texts.
        self.weak = [stem or text not in SEED_WORDS for text, stem in model.entries]
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _look_up(self, token: str) -> tuple[int, int] | None:
        bare = token.strip(".,;:!?()[]{}<>|*#$%&~-_/\\+=" + QUOTES)
        if not bare or bare in ORDINARY:
            return None
        found = self.automaton.match(bare)
        if found is None and not bare.isalnum():
            joined = "".join(c for c in bare if c.isalnum())
            found = self.automaton.match(joined) if joined else None
        return found

    def hits(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(token index, entry, edits) of each hit."""
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = self._look_up(t)
        return [(i, *m) for i, m in enumerate(map(memo.__getitem__, tokens)) if m]

    @staticmethod
    def quotation(tokens: list[str], i: int) -> float:
        """0 for plain use to 1 for a word that is quoted or reported."""
        before, own, after = tokens[max(0, i - WINDOW) : i], tokens[i], tokens[i + 1 : i + 1 + WINDOW]
        # In some languages a space stands between a mark and its word.
        opened = own[0] in QUOTES or any(t[0] in QUOTES and (len(t) == 1 or t[-1] not in QUOTES) for t in before)
        closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any((bare := t.rstrip(".,;:!?"))[-1:] in QUOTES and (len(bare) == 1 or t[0] not in QUOTES) for t in after)
        reported = any(t.strip(QUOTES + ".,;:!?") in REPORTING for t in before + after)
        return 0.6 * (opened and closed) + 0.4 * reported * (opened or closed)

    @staticmethod
    def address(tokens: list[str], i: int) -> float:
        near = tokens[max(0, i - WINDOW) : i + 1 + WINDOW]
        return 0.5 * any(t.strip(QUOTES + ".,;:!?") in ADDRESS for t in near) + 0.5 * any(t.endswith("!") for t in tokens[i : i + 2])

    def features(self, text: str | None) -> tuple[list[float], int, float]:
        """The values of FEATURES, the number of hits, and the mean quotation of the hits."""
        tokens = (text or "").lower().split()
        word = stem = fuzzy = quoted = 0.0
        found = self.hits(tokens)
        for i, entry, edits in found:
            q = self.quotation(tokens, i)
            strength = (1 - 0.8 * q) * (1 + 0.25 * self.address(tokens, i))
            quoted += q
            if self.weak[entry]:
                stem += strength
            elif edits:
                fuzzy += strength / edits
            else:
                word += strength
        n = max(1, len(tokens))
        # One plain hit of a word tells nearly all, so words saturate; stems also occur in clean texts, so they count on.
        return [1 - math.exp(-2 * word), math.log1p(stem), math.log1p(1000 * stem / n), 1 - math.exp(-2 * fuzzy)], len(found), quoted / max(1, len(found))

    def score(self, features: list[float]) -> float:
        z = self.model.weights[0] + sum(w * x for w, x in zip(self.model.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge towards DEFAULT_WEIGHTS, by Newton's method; weights stay at or above 0."""
    a = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array(DEFAULT_WEIGHTS)
    w, ridge = prior.copy(), np.array([0.01, 0.5, 0.5, 0.5, 0.5])
    free = np.ones(len(w), dtype=bool)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * (w - prior)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        new = w - np.clip(step, -2, 2)
        new[1:] = np.maximum(new[1:], 0.0)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return tuple(float(v) for v in w)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that nothing is learned from: crc32(doc_id as text) mod 5 is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def _prefix_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, toxic = Counter(), Counter()
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["toxic"], strict=True):
            forms = set()
            for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
                if 3 <= len(w) <= LONGEST_WORD:
                    forms.add(w + "$")
                    forms.update(w[:k] for k in STEM_LETTERS if k <= len(w))
            n.update(forms)
            if label:
                toxic.update(forms)
    keys = list(n)
    yield pd.DataFrame({"form": keys, "n": [n[k] for k in keys], "n_toxic": [toxic[k] for k in keys]})


def learned_entries(sample: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems that go with the label in sample (text, toxic), best first.

    No entry extends another, but whole words that give way to a stem follow at the end: they allow edits, the stem doesn't.
    """
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total.n or not total.t or total.t == total.n:
        return []
    share = total.t / total.n
    counts = sample.mapInPandas(_prefix_counts, "form string, n long, n_toxic long").groupBy("form").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("k"))
    z = (F.col("k") - share * F.col("n")) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    rows = counts.withColumn("z", z).filter((F.col("k") >= LEAST_ROWS) & (F.col("k") >= LEAST_SHARE * F.col("n")) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), F.desc(F.col("form").endswith("$")), F.desc(F.length("form")), "form").limit(50 * LEXICON_ENTRIES).collect()
    out: list[tuple[str, bool]] = []
    beside: list[tuple[str, bool]] = []
    for r in rows:
        text, stem = r.form.rstrip("$"), not r.form.endswith("$")
        near = [(t, s) for t, s in out if text.startswith(t) or t.startswith(text)]
        if len(out) < LEXICON_ENTRIES and not near:
            out.append((text, stem))
        elif near and not stem and all(s for _, s in near) and (edits_of(text, False) or not any(text.startswith(t) for t, _ in near)):
            beside.append((text, False))
    return out + beside[:LEXICON_ENTRIES]


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most sample_rows labelled rows that are not held out.

    docs needs doc_id and text, labels doc_id and toxic (null labels are skipped; a doc_id labelled twice is toxic if
    one label says so). Near copies in the sample count once for the lexicon. Without usable labels: the default model.
    """
    ship(docs.sparkSession)
    chosen = labels.filter(~held_out(doc_id) & F.col("toxic").isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    # The sample is at most sample_rows ids, so it is small enough to send to all.
    found = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")
    signature = F.slice(F.array_sort(F.transform(F.array_distinct(word_array(F.lower("text"))), lambda w: F.xxhash64(w))), 1, 3)
    found = found.select("__id", F.coalesce("text", F.lit("")).alias("text"), "toxic", signature.alias("signature")).dropDuplicates(["__id", "text"])
    nth = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("text"), "text"))
    sample = stored(found.withColumn("nth", nth).filter(F.col("nth") <= TEXTS_OF_ID).drop("nth"), "toxicity-sample")
    distinct = sample.groupBy("signature").agg(F.min(F.struct("__id", "text", "toxic")).alias("r")).select("r.text", "r.toxic")
    learned = learned_entries(distinct)
    # Also beside a learned stem, which allows no edits.
    seeds = [(w, False) for w in SEED_WORDS if (w, False) not in learned]
    model = Model(entries=[*learned, *seeds])
    # An entry whose near spellings are common in clean texts (its neighbours are words of the language) keeps to itself.
    near = _near_hits(sample.select("toxic", "text"), model).select("toxic", F.explode("near").alias("entry")).groupBy("entry").agg(F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("clean"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).collect()
    model.exact = frozenset(model.entries[r.entry][0] for r in near if r.clean > 0.25 * r.toxic + 1)
    # At most sample_rows times TEXTS_OF_ID rows of some numbers.
    rows = sorted(_features(sample.select("__id", "toxic", "text"), model).select("features", "toxic").collect())
    forget(sample)
    y = np.array([float(r.toxic > 0) for r in rows])
    if len(y) and 0 < y.sum() < len(y):
        model.weights = fitted(np.array([r.features for r in rows], dtype=float), y)
    return model


def _features(df: DataFrame, model: Model) -> DataFrame:
    def make() -> Callable[[list[str | None]], list[list]]:
        scorer = Scorer(model)
        return lambda texts: [[scorer.features(t)[0] for t in texts]]

    return map_texts(df, "text", [("features", T.ArrayType(T.DoubleType()))], make, keep=["toxic"])


def _near_hits(df: DataFrame, model: Model) -> DataFrame:
    def make() -> Callable[[list[str | None]], list[list]]:
        scorer = Scorer(model)
        return lambda texts: [[sorted({e for _, e, edits in scorer.hits((t or "").lower().split()) if edits}) for t in texts]]

    return map_texts(df, "text", [("near", T.ArrayType(T.IntegerType()))], make, keep=["toxic"])


def score_documents(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds score (0 to 1), predicted (score >= 0.5), n_hits and quotation (0 to 1, the hits' mean) for each whole text.

    Null and empty texts have no hits and get the score of such texts. Other columns pass unchanged; columns of the
    added names are replaced; prefix goes before the added names. No shuffle.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        scorer = Scorer(model)

        def work(texts: list[str | None]) -> list[list]:
            made = [scorer.features(t) for t in texts]
            scores = [scorer.score(f) for f, _, _ in made]
            return [scores, [int(s >= 0.5) for s in scores], [n for _, n, _ in made], [q for _, _, q in made]]

        return work

    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_hits", T.LongType()), ("quotation", T.DoubleType())]
    return map_texts(df, text, [(prefix + n, t) for n, t in fields], make, keep)
