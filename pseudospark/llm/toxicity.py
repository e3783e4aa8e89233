"""Toxicity by a lexicon that tolerates misspelling.

The lexicon (whole words, and stems that a word may begin with) is learned from labelled texts. It is held as a trie;
each word of a text runs through the trie intersected with Levenshtein automata, made deterministic state by state as
words need it. Each hit is scored by its term's log-odds, its distance, and the words and quotation marks around it,
which tell quotation from abuse; a logistic regression over a text's hits gives the probability.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pseudospark.llm.training import Sample, fit_logistic, labelled_sample, predictions
from pseudospark.llm.words import pieces, text_column

#: Terms of at most so many letters must be spelled right, longer ones may differ by one letter, longest by two.
EXACT_UNTIL, ONE_UNTIL = 4, 8
#: The same for stems, counted on their own letters.
STEM_EXACT_UNTIL = 6
STEM_LENGTHS = range(4, 9)
TERMS = 400
STEMS = 100
#: An entry's log-odds are taken so many standard errors lower; at least this much must be left.
DOUBT = 1.64
LEAST_ODDS = 1.0
#: What a hit keeps of its score for each letter that differs.
SPELLING = 0.6
WINDOW = 8  # words on either side
QUOTED = 0.25
REPORTED = 0.6
ADDRESSED = 1.25
#: Words that a task keeps at hand, and states of the automaton (a state takes about a kilobyte).
CACHED = 100_000
STATES = 20_000

# Words that report what others say, and words that address somebody.
REPORTING = frozenset(
    "said says say quote quoted quotes wrote writes called word term phrase slur quotation "
    "sagte sagt zitat zitiert schrieb nannte wort begriff dit citation cité mot terme appelé "
    "dijo dice cita citó palabra término llamado".split()
)
ADDRESS = frozenset("you your you're youre u ur du dich dein ihr euch tu toi ton vous votre tú te usted ustedes".split())
QUOTES = "\"'“”„‟«»‹›‘’"

_WORD = re.compile(r"[^\W\d_]+")


class Automaton:
    """Lexicon trie intersected with Levenshtein automata, determinised on demand.

    A state holds the reachable (trie node, edits) pairs and the best distance at which each stem has been met so far.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.entries = [*terms, *stems]
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.allowed: list[int] = [0]  # the most edits of any entry below a node
        for number, entry in enumerate(self.entries):
            is_stem = number >= len(terms)
            edits = self.edits(entry, is_stem)
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for letter in entry:
                following = self.children[node].get(letter)
                if following is None:
                    following = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = following
                self.allowed[node] = max(self.allowed[node], edits)
            (self.stem if is_stem else self.whole)[node] = number
        self.limit = [self.edits(e, i >= len(terms)) for i, e in enumerate(self.entries)]
        self._reset()

    @staticmethod
    def edits(entry: str, is_stem: bool) -> int:
        if is_stem:
            return 0 if len(entry) <= STEM_EXACT_UNTIL else 1
        return 0 if len(entry) <= EXACT_UNTIL else 1 if len(entry) <= ONE_UNTIL else 2

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.dead: list[bool] = []
        self.found: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state({0: 0}, {})

    def _state(self, at: dict[int, int], stems: dict[int, int]) -> int:
        """Number of the state, after letters of the trie that a word may have left out."""
        todo = list(at)
        while todo:
            node = todo.pop()
            edits = at[node] + 1
            for child in self.children[node].values():
                if edits <= self.allowed[child] and edits < at.get(child, 99):
                    at[child] = edits
                    todo.append(child)
        stems = dict(stems)
        for node, edits in at.items():
            entry = self.stem.get(node)
            if entry is not None and edits <= self.limit[entry] and edits < stems.get(entry, 99):
                stems[entry] = edits
        key = (frozenset(at.items()), frozenset(stems.items()))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append((at, stems))
            self.moves.append({})
            hits = dict(stems)
            for node, edits in at.items():
                entry = self.whole.get(node)
                if entry is not None and edits <= self.limit[entry]:
                    hits[entry] = edits
            self.found.append(tuple(sorted(hits.items())))
            self.dead.append(not at)
        return number

    def _step(self, state: int, letter: str) -> int:
        at, stems = self.states[state]
        following: dict[int, int] = {}
        for node, edits in at.items():
            if edits + 1 <= self.allowed[node] and edits + 1 < following.get(node, 99):
                following[node] = edits + 1  # a letter too many
            for other, child in self.children[node].items():
                cost = edits + (other != letter)
                if cost <= self.allowed[child] and cost < following.get(child, 99):
                    following[child] = cost
        return self._state(following, stems)

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(entry, edits) of each entry that the word is a spelling of, or that a stem of it is."""
        if len(self.states) > STATES:
            self._reset()
        state, moves, dead = self.start, self.moves, self.dead
        for letter in word:
            move = moves[state].get(letter)
            if move is None:
                move = moves[state][letter] = self._step(state, letter)
            state = move
            if dead[state]:
                break
        return self.found[state]


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    odds: np.ndarray  # of each entry, terms first
    innocent: frozenset[str]
    weights: np.ndarray
    intercept: float


def learned_lexicon(texts: list[str], labels: np.ndarray) -> tuple[list[str], list[str], np.ndarray, frozenset[str]]:
    """Terms and stems with their log-odds: in enough texts of label 1, and several times as likely there.

    Last come words of two or more texts of label 0 that look like misspelled terms: they are words of their own.
    """
    counts = [Counter(), Counter()]
    prefixes = [Counter(), Counter()]
    seen = set()
    for text, label in zip(texts, labels):
        words = set(_WORD.findall(text))
        order = sorted(words, key=lambda w: crc32(w.encode()))
        # Most near copies agree here; each family should count once, or its rare words look like a class's.
        family = (label, *order[:1], *order[-1:])
        if family in seen:
            continue
        seen.add(family)
        counts[label].update(words)
        prefixes[label].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) > n})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    least = max(4, n1 // 200)

    def odds(found: list[Counter], key: str) -> float:
        a, b = found[1][key] + 0.5, found[0][key] + 0.5
        return float(np.log(a / (n1 + 1)) - np.log(b / (n0 + 1)) - DOUBT * np.sqrt(1 / a + 1 / b))

    def chosen(found: list[Counter], most: int) -> list[str]:
        good = [(k, odds(found, k)) for k, n in found[1].items() if n >= least]
        good = [(k, o) for k, o in good if o >= LEAST_ODDS]
        good.sort(key=lambda x: (-x[1] * found[1][x[0]] ** 0.5, x[0]))
        return [k for k, _ in good[:most]]

    terms = chosen(counts, TERMS)
    stems: list[str] = []
    for stem in sorted(chosen(prefixes, 10 * STEMS), key=lambda p: (len(p), p)):
        # A stem stands for more than two words, none of which makes up most of it.
        if len(stems) < STEMS and not any(stem.startswith(s) for s in stems):
            forms = [n for w, n in counts[1].items() if w.startswith(stem)]
            if len(forms) > 2 and max(forms) < 0.7 * sum(forms):
                stems.append(stem)
    # Terms that a stem covers stay: a stem allows fewer edits, and none in its own first letters.
    automaton = Automaton(terms, stems)
    innocent = {w for w, n in counts[0].items() if n > 1 and any(automaton.match(w)) and min(d for _, d in automaton.match(w))}
    values = np.array([*(odds(counts, t) for t in terms), *(odds(prefixes, s) for s in stems)])
    return terms, stems, values, frozenset(innocent)


class Scorer:
    """Features of texts by a lexicon: best and summed hit, hits in quotation, and hits to the number of words."""

    def __init__(self, terms: list[str], stems: list[str], odds: np.ndarray, innocent: frozenset[str]):
        self.automaton = Automaton(terms, stems)
        self.odds = odds
        self.innocent = innocent
        self.known: dict[str, float] = {}

    def word_score(self, word: str) -> float:
        if word in self.innocent:
            return 0.0
        return max((float(self.odds[e]) * SPELLING**d for e, d in self.automaton.match(word)), default=0.0)

    def features(self, text: str) -> tuple[float, float, float, float]:
        text = text.lower()
        words = _WORD.findall(text)
        distinct = set(words)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = distinct
        for word in new:
            self.known[word] = self.word_score(word)
        hits = {w for w in distinct if self.known[w]}
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        best = total = quoted = 0.0
        spans = None
        for at, word in enumerate(words):
            if word not in hits:
                continue
            if spans is None:
                spans = [m.span() for m in _WORD.finditer(text)]
            factor = self.context(text, words, spans, at)
            score = self.known[word] * factor
            best, total = max(best, score), total + score
            quoted += factor < 1
        return best, float(np.log1p(total)), float(np.log1p(quoted)), float(np.log1p(100 * total / len(words)))

    def context(self, text: str, words: list[str], spans: list[tuple[int, int]], at: int) -> float:
        first, last = max(0, at - WINDOW), min(len(words), at + WINDOW + 1)
        before, after = text[spans[first][0] : spans[at][0]], text[spans[at][1] : spans[last - 1][1] + 1]
        # Marks inside words (can't) are no quotation.
        marks = sum(_is_mark(before, i) for i in range(len(before)))
        if marks % 2 and any(_is_mark(after, i) for i in range(len(after))):
            return QUOTED
        around = set(words[first:at])
        if around & REPORTING:
            return REPORTED
        return ADDRESSED if (around | set(words[at + 1 : last])) & ADDRESS else 1.0


def _is_mark(text: str, i: int) -> bool:
    if text[i] not in QUOTES:
        return False
    return not (0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum())


def trained(sample: Sample) -> Model:
    """Lexicon and weights from a sample; with fewer than two labels the lexicon is empty."""
    texts = [t.decode().lower() for t in sample.texts]
    lexicon = learned_lexicon(texts, sample.labels)
    scorer = Scorer(*lexicon)
    features = np.array([scorer.features(t) for t in texts]).reshape(-1, 4)
    if len(set(sample.labels.tolist())) < 2:
        share = (sample.totals[1] + 1) / (sum(sample.totals) + 2)
        return Model([], [], np.zeros(0), frozenset(), np.zeros(4), float(np.log(share / (1 - share))))
    weights, intercept = fit_logistic(features, sample.labels)
    return Model(*lexicon, weights, intercept + sample.prior_shift)


def scorer(model: Model):
    """A function from a batch to the log-odds of label 1 of its texts."""
    lexicon = Scorer(model.terms, model.stems, model.odds, model.innocent)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = text_column(batch, "text")
        rows = [
            lexicon.features(str(data[offsets[k] : offsets[k + 1]], "utf-8", "replace"))
            for first, last in pieces(offsets)
            for k in range(first, last)
        ]
        return np.array(rows).reshape(-1, 4) @ model.weights + model.intercept

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text``).

    Lexicon and weights are learned from ``labels.toxic`` on a bounded sample of rows that are not held out (crc32 of the
    id as text, modulo ``modulus``, is not ``remainder``); every whole text is scored. Texts without hits, empty and null
    ones among them, have the lowest score. A null id is not held out. Repeated rows are scored each by itself; other
    columns are ignored; an empty table gives no rows, and labels of fewer than two kinds give every text their share.
    """
    model = trained(labelled_sample(docs, labels, "toxic", modulus=modulus, remainder=remainder))
    return predictions(docs, partial(scorer, model), modulus=modulus, remainder=remainder)
