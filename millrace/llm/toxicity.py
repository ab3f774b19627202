"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause: insult, threat, target, negation and
reported speech. They are composed into one machine whose states are tuples of theirs
and whose table is filled as it is travelled; its output is the weight of the clause's
insults or threats, sorted by how the clause frames them. The insult transducer's arcs
(words, and stems open at the end) and their weights are learned from labels, as are
the weights that join a document's clauses into a score.
"""

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import words as W
from .common import ship
from .labelled import sample
from .worker import give_back, lean

# The closed word classes of the grammar in English, Spanish, French and German.
TARGETS = frozenset("you your yours u he she they him her them this these those tu vous il elle ils toi ton usted ustedes vosotros ella ellos du dich dir ihr euch er sie".split())
NEGATIONS = frozenset("not no never n't isn't aren't don't pas jamais ne no nunca jamás nicht kein keine nie".split())
REPORTS = frozenset("said says say wrote writes called calls quoted reported claims dit écrit appelle dijo dice escribió llamó sagte sagt schrieb nannte".split())
THREATS = frozenset("kill murder hurt destroy beat shoot stab burn matar matará destruir tuer détruire frapper töten schlagen vernichten".split())
# End of fixed values.

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile("[.!?;:\n]")
NEGATION_SCOPE = 4
FRAMES = ("plain", "targeted", "negated", "reported", "threat")
#: The grammar's own opinion of the frames, from which fitting departs as labels tell.
PRIOR = np.array([1.2, 1.4, 0.4, 0.4, 1.0])
#: Least weights: a negated or reported insult may speak against toxicity, where labels say so; the others never.
FLOOR = np.array([0.3, 0.3, -1.0, -1.0, 0.3])
THREAT_WEIGHT = 3.0
STEMS = range(4, 8)


class Transducer:
    """A small machine: step(state, symbol) -> (state, output)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def seen(symbol):
    return Transducer(0, lambda state, s: (1 if s == symbol else state, 1 if s == symbol else state))


def scope(symbol, length):
    """Output 1 for `length` words after the symbol."""
    return Transducer(0, lambda state, s: ((length, 1) if s == symbol else (max(0, state - 1), int(state > 0))))


class Composed:
    """The product of transducers; its transition table is built on demand."""

    def __init__(self, *machines):
        self.machines, self.start, self.table = machines, tuple(m.start for m in machines), {}

    def step(self, state, symbol):
        key = state, symbol
        got = self.table.get(key)
        if got is None:
            each = [m.step(s, symbol) for m, s in zip(self.machines, state, strict=True)]
            got = self.table[key] = tuple(s for s, _ in each), tuple(o for _, o in each)
        return got


GRAMMAR = Composed(seen("target"), scope("negation", NEGATION_SCOPE), seen("report"))


class Lexicon:
    """Arcs of the insult transducer: whole words and stems, each with a weight."""

    def __init__(self, words, stems):
        self.words, self.stems = words, stems
        self.finder = None

    def weight(self, word):
        got = self.words.get(word)
        if got is None:
            got = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
        return got

    def find(self):
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for x in {*(w for w, x in self.words.items() if x > 0), *self.stems, *THREATS}:
                self.finder.add_word(x, len(x))
            self.finder.make_automaton()
        return self.finder

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "finder": None}


def symbol(word):
    if word in TARGETS:
        return "target"
    if word in NEGATIONS:
        return "negation"
    if word in REPORTS:
        return "report"
    return "other"


def read_clause(words, lexicon):
    """Weight of each frame in one clause."""
    state, hits = GRAMMAR.start, []
    for word in words:
        state, (_, negated, _) = GRAMMAR.step(state, symbol(word))
        weight = lexicon.weight(word)
        if weight > 0:
            hits.append(("insult", weight, negated))
        elif word in THREATS:
            hits.append(("threat", THREAT_WEIGHT, negated))
    targeted, _, reported = state
    out = [0.0] * len(FRAMES)
    for kind, weight, negated in hits:
        if kind == "threat":
            frame = 4 if targeted and not negated and not reported else None
        else:
            frame = 3 if reported else 2 if negated else 1 if targeted else 0
        if frame is not None:
            out[frame] += weight
    return out


def clauses(text, lexicon):
    """The clauses, whole however long, that hold an insult's or a threat's letters; each once, in one pass over the text."""
    start, stop, find = 0, -1, CLAUSE_END.search
    for end, _ in lexicon.find().iter(text):
        if end < stop:
            continue  # in the clause just read
        while stop <= end:
            start = stop + 1
            hit = find(text, start)
            stop = hit.start() if hit else len(text)
        yield text[start:stop]


def features(text, lexicon):
    total = np.zeros(len(FRAMES))
    for clause in clauses(text.lower(), lexicon):
        total += read_clause(WORD.findall(clause), lexicon)
    return np.log1p(total)


def arcs_of(text):
    """Words and stems of a text, each with the contexts (neighbouring words) it stands in."""
    words, found = WORD.findall(text.lower()), {}
    for before, word, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
        if len(word) > 2:
            for arc in [("word", word), *(("stem", word[:k]) for k in STEMS if len(word) > k)]:
                found.setdefault(arc, (before, after))
    return found


def pruned(stems, words):
    """Stems of three words or more, the longest of those that open the same words."""
    opened = {s: {w for w in words if len(w) > len(s) and w.startswith(s)} for s in stems}
    return {s: x for s, x in stems.items() if len(opened[s]) > 2 and not any(t != s and t.startswith(s) and len(opened[t]) == len(opened[s]) for t in stems)}


def learn_lexicon(texts, labels, odds=9.0, risk=0.05):
    """Words and stems that mark toxic texts.

    An arc counts once for each context it is found in, so words that merely come along
    in copies of one toxic text count once. It is kept if it is `odds` times likelier
    than not to stand in a toxic text, in so many contexts that chance would hardly make
    one such arc among all. Words known to be harmless override a stem they share.
    """
    n_toxic = int(sum(labels))
    share = (n_toxic + 1) / (len(labels) + 2)
    toxic, clean = {}, {}
    for text, label in zip(texts, labels, strict=True):
        if label:
            for arc, context in arcs_of(text).items():
                toxic.setdefault(arc, set()).add(context)
    counts = {arc: len(c) for arc, c in toxic.items() if len(c) > 2}
    by_count = np.bincount(list(counts.values())) if counts else np.zeros(1)
    above = np.cumsum(by_count[::-1])[::-1]
    least = next((t for t in range(3, len(above)) if above[t] * share**t < risk), len(above))
    stems = {arc[1] for arc in counts if arc[0] == "stem"}
    for text, label in zip(texts, labels, strict=True):
        if not label:
            words = set(WORD.findall(text.lower()))
            for arc in {("word", w) for w in words} | {("stem", w[:k]) for w in words for k in STEMS if len(w) > k and w[:k] in stems}:
                clean[arc] = clean.get(arc, 0) + 1
    ratio = {arc: (n + 0.5) / (clean.get(arc, 0) + 0.5) for arc, n in counts.items() if n >= least}
    kept = {arc: math.log(r) for arc, r in ratio.items() if r >= odds}
    word_weights = {w: x for (kind, w), x in kept.items() if kind == "word"}
    stem_weights = pruned({w: x for (kind, w), x in kept.items() if kind == "stem"}, {w for kind, w in toxic if kind == "word"})
    for kind, word in clean:
        if kind == "word" and word not in word_weights and clean[kind, word] > counts.get((kind, word), 0) and any(word[:k] in stem_weights for k in STEMS):
            word_weights[word] = 0.0
    return Lexicon(word_weights, stem_weights)


def fit_frames(x, y, strength=0.02, steps=60):
    """Logistic weights of the frames and an intercept, held near the grammar's prior and above its floor."""
    mean = (y.sum() + 1) / (len(y) + 2)
    w, b = PRIOR.copy(), math.log(mean / (1 - mean)) - 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.concatenate((x.T @ (p - y) + strength * len(y) * 0.01 * (w - PRIOR), [np.sum(p - y)]))
        s = p * (1 - p) + 1e-6
        xb = np.column_stack((x, np.ones(len(y))))
        h = (xb * s[:, None]).T @ xb + np.diag([strength * len(y) * 0.01 + 0.05] * len(w) + [0.05])
        move = np.linalg.solve(h, g)
        w, b = np.maximum(w - move[:-1], FLOOR), b - move[-1]
        if np.abs(move).max() < 1e-6:
            break
    return w, float(b)


class Model:
    def __init__(self, lexicon, weights, bias):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, text):
        z = float(features(text or "", self.lexicon) @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs, labels, label="toxic", id_col="doc_id", text_col="text", max_rows=8000):
    """Learn lexicon and frame weights from a bounded sample of labelled rows that are not held out."""
    texts, y = sample(docs, labels, label, id_col, text_col, max_rows)
    lexicon = learn_lexicon(texts, y)
    give_back()
    if not len(texts):
        return Model(lexicon, PRIOR.copy(), -3.0)
    x = np.array([features(t, lexicon) for t in texts])
    del texts
    give_back()
    return Model(lexicon, *fit_frames(x, y))


def _score(model):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "_text"):
                scores = [model.score(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("_id"), "score": pa.array(scores, pa.float64())})

    return run


def score_texts(docs, model, id_col="doc_id", text_col="text"):
    """doc_id and score of every row, from the whole text; null and empty texts score as a text without marks.

    Each row is scored by itself: repeated rows score alike, null ids are kept, very long
    texts and clauses are read whole, extra columns and clashing names do not matter; an
    empty table gives an empty result. Clauses of equal weights tie, and so do their texts.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return base.mapInArrow(lean(_score(model)), "doc_id long, score double")


def _drop(model, column, threshold):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, column):
                keep = [model.score(t) < threshold for t in part.column(column).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def drop_toxic(docs, model, text_col="text", threshold=0.5):
    """The documents that score below the threshold, with all their columns and without a shuffle.

    Null and empty texts are scored as texts without marks; repeated rows and null ids are
    judged by their text alone; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    return docs.mapInArrow(lean(_drop(model, text_col, threshold)), docs.schema)
