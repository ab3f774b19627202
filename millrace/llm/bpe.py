"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token arcs: a path from the start spells a word exactly when it is
the word's tokenization. It is compiled merge by merge. The gadget of a merge (u, v)
splits the state behind u: the new state shares all arcs of the old one but v, which it
loses; beside every arc u it adds the arc uv, to the state behind v. A state is thus a
parent, the arc it lost and when; an arc younger than its state leads on where the arc of
its left part does. Arcs are expanded from this when first travelled and kept in a
transition table of fixed size (all of them together would be the square of the
vocabulary).

Words are read in one pass. Exactly one token ends a prefix's tokenization, and it leaves
the state behind the prefix before it. The tokens that can end where a reader stands are
given by a table of transitions over bytes (a matching automaton of all labels); the one
arc that leaves its state gives the state behind this place. All new words of a batch are
read in step, place by place.

Texts are split and joined as Arrow columns, a slice at a time: only its different runs
become Python objects, and only pieces that the worker does not keep are read.
"""

import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F

from . import words as W
from .common import ship
from .worker import held, lean

#: White space of the Unicode standard, as the pre-split pattern understands it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_RUN = re.compile(f"[{WHITE}]+")
#: Separators to str.split that are not white space there.
ODD = re.compile("[\x1c-\x1f]")
#: Slots of the transition table, and the longest word (in bytes) that is read in step with others.
SLOTS, IN_STEP = 1 << 20, 48
#: Bytes of encoded pieces that a worker keeps in a generation; it holds two.
KEPT_BYTES = 12 << 20
#: Bytes of text whose different runs are Python objects at a time.
SLICE_BYTES = 2 << 20


def byte_symbols():
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Automaton:
    def __init__(self, vocabulary, merges, suffix):
        self.size = max(vocabulary.values()) + 1
        self.labels = [None] * self.size
        for label, token in vocabulary.items():
            self.labels[token] = label
        self.left, self.right, self.rank = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.live, self.behind = [label is not None for label in self.labels], [0] * self.size
        #: State 0 is the start, where any arc leaves. Each state: owner, parent, lost arc, time.
        self.owner, self.parent, self.lost, self.born = [-1], [-1], [-1], [-1]
        self.merged = {}
        for rank, (u, v) in enumerate(merges):
            self.add_gadget(vocabulary[u], vocabulary[v], vocabulary[u + v], rank)
        keys = np.array([u * self.size + v for u, v in self.merged], np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks = keys[by], np.array(list(self.merged.values()), np.int64)[by]
        for name in ("left", "right", "rank", "live", "behind", "owner", "parent", "lost", "born"):
            setattr(self, name, np.array(getattr(self, name), bool if name == "live" else np.int32))
        self.table = np.full(SLOTS, -1, np.int64)
        self.compile_bytes(suffix)

    def add_gadget(self, u, v, new, rank):
        """Where no path u, v is left at its turn, a merge adds nothing and its token is dead."""
        self.left[new], self.right[new], self.rank[new] = u, v, rank
        self.live[new] = self.live[u] and self.live[v] and self.leaves(self.behind[u], v)
        if not self.live[new]:
            return
        self.behind[new] = self.behind[v]  # before the split, for v may be u
        self.owner.append(u)
        self.parent.append(self.behind[u])
        self.lost.append(v)
        self.born.append(rank)
        self.behind[u] = len(self.owner) - 1
        self.merged[u, v] = rank

    def leaves(self, state, token):
        """Whether an arc leaves a state: along the states it was split from, back in time."""
        while state > 0:
            if self.lost[state] == token:
                return False
            if self.rank[token] < self.born[state]:
                state = self.parent[state]
            else:
                token = self.left[token]
        return True

    def expand(self, state, token):
        """`leaves` for arrays of arcs, each state's chain of splits being passed in one step.

        The states split off behind one token u are passed at once: arc w is lost between
        them exactly if u, w merged by then. Below them comes the state behind u's right
        part at the time u came to be.
        """
        ok = self.live[token].copy()
        open_ = np.flatnonzero(ok & (state > 0))
        a, b = self.owner[state[open_]].astype(np.int64), token[open_].astype(np.int64)
        until, by = self.born[state[open_]].astype(np.int64) + 1, np.full(len(open_), len(self.owner) + self.size, np.int64)
        while len(open_):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], -1)
            lost = (rank >= 0) & (rank < until) & (rank <= by)
            ok[open_[lost]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~lost & ((ra >= 0) | (rb >= 0))
            open_, a, b, until, by, ra, rb = (x[go] for x in (open_, a, b, until, by, ra, rb))
            strip = rb >= ra
            by, b = np.where(strip, rb, by), np.where(strip, self.left[b], b)
            until, a = np.where(strip, until, ra), np.where(strip, a, self.right[a])
        return ok

    def arcs(self, state, token):
        """Whether each arc leaves its state, from the transition table; missing entries are expanded."""
        key = state.astype(np.int64) * self.size + token
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)
        held = self.table[slot]
        ok = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            fresh, which = np.unique(key[new], return_inverse=True)
            found = self.expand(fresh // self.size, fresh % self.size)[which]
            ok[new] = found
            self.table[slot[new]] = key[new] * 2 + found
        return ok

    def compile_bytes(self, suffix):
        """Transitions over bytes: at each node, the longest token that ends there, within a word and at its end."""
        symbols = byte_symbols()
        byte_of = {c: b for b, c in symbols.items()}
        inner, final = {}, {}
        for token, label in enumerate(self.labels):
            if label is not None and self.live[token]:
                ends = bool(suffix) and len(label) > len(suffix) and label.endswith(suffix)
                body = label.removesuffix(suffix) if ends else label
                if all(c in byte_of for c in body):
                    (final if ends or not suffix else inner)[bytes(byte_of[c] for c in body)] = token
        inner = inner if suffix else final
        bodies = {**inner, **final}
        used = sorted({b for body in bodies if len(body) > 1 for b in body})
        #: Class 0: bytes that only stand alone.
        self.byte_class = np.zeros(256, np.int32)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        prefixes = sorted({body[:i] for body in bodies for i in range(1, len(body) + 1) if self.byte_class[body[0]]}, key=len)
        node = {b"": 0, **{p: i + 1 for i, p in enumerate(prefixes)}}
        n = len(node)
        parent = np.array([0, *(node[p[:-1]] for p in prefixes)], np.int32)
        symbol = np.array([0, *(self.byte_class[p[-1]] for p in prefixes)], np.int32)
        depth = np.array([0, *map(len, prefixes)], np.int32)
        edges = np.searchsorted(depth, np.arange(depth.max() + 1))
        fail = np.zeros(n, np.int32)
        self.goto = np.zeros((n, len(used) + 1), np.int32)
        out = {kind: np.full(n, -1, np.int32) for kind in ("inner", "final")}
        for kind, tokens in (("inner", inner), ("final", final)):
            for body, token in tokens.items():
                if body in node:
                    out[kind][node[body]] = token
        own = {kind: x.copy() for kind, x in out.items()}
        levels = [np.arange(a, b) for a, b in zip(edges, [*edges[1:], n], strict=True)]
        for here, below in zip(levels, [*levels[1:], levels[0][:0]], strict=True):
            if depth[here[0]] > 1:
                fail[here] = self.goto[fail[parent[here]], symbol[here]]
            if depth[here[0]] > 0:
                self.goto[here] = self.goto[fail[here]]
            self.goto[parent[below], symbol[below]] = below
            for x in out.values():
                x[here] = np.where(x[here] < 0, x[fail[here]], x[here])
        self.out_inner, self.out_final = out["inner"], out["final"]
        self.alone_inner, self.alone_final = (np.array([kind.get(bytes([b]), -1) for b in range(256)], np.int32) for kind in (inner, final))
        self.length, self.link = np.zeros(self.size, np.int32), np.full(self.size, -1, np.int32)
        for kind, tokens in (("inner", inner), ("final", final)):
            for body, token in tokens.items():
                self.length[token] = len(body)
            ids = own[kind]
            some = np.flatnonzero(ids >= 0)
            self.link[ids[some]] = out[kind][fail[some]]

    def read(self, word):
        """Ids of one long word, by the same transitions."""
        node, state, last = 0, [0], [-1]
        for place, byte in enumerate(word, 1):
            of = self.byte_class[byte]
            node = self.goto[node, of]
            ends = place == len(word)
            token = (self.out_final if ends else self.out_inner)[node] if of else (self.alone_final if ends else self.alone_inner)[byte]
            while not self.arcs(np.array([state[place - self.length[token]]]), np.array([token]))[0]:
                token = self.link[token]
            state.append(self.behind[token])
            last.append(token)
        place, out = len(word), []
        while place:
            out.append(int(last[place]))
            place -= self.length[last[place]]
        return out[::-1]

    def encode(self, words):
        """Ids of every word (non-empty bytes)."""
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.packed(words)]

    def packed(self, words):
        """Ids of every word, as the bytes of 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = [None] * len(words)
        for i in np.flatnonzero(sizes > IN_STEP).tolist():
            out[i] = np.array(self.read(words[i]), np.int32).tobytes()
        some = np.flatnonzero(sizes <= IN_STEP)
        some = some[np.argsort(-sizes[some], kind="stable")]
        if not len(some):
            return out
        sizes, n, wide = sizes[some], len(some), int(sizes[some[0]])
        flat = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, last = np.zeros((n, wide + 1), np.int32), np.zeros((n, wide + 1), np.int32)
        node = np.zeros(n, np.int32)
        for place in range(wide):
            live = int(np.searchsorted(-sizes, -place, side="left"))  # words longer than this place
            byte = flat[starts[:live] + place]
            of = self.byte_class[byte]
            node = self.goto[node[:live], of]
            ends = sizes[:live] == place + 1
            token = np.where(ends, self.out_final[node], self.out_inner[node])
            alone = of == 0
            if alone.any():
                token[alone] = np.where(ends, self.alone_final[byte], self.alone_inner[byte])[alone]
            todo = np.arange(live)
            while len(todo):
                t = token[todo]
                ok = self.arcs(state[todo, place + 1 - self.length[t]], t)
                done, t = todo[ok], t[ok]
                last[done, place + 1], state[done, place + 1] = t, self.behind[t]
                todo = todo[~ok]
                token[todo] = self.link[token[todo]]
        # The tokens of a word, from its end.
        steps, at, which = [], sizes.copy(), np.arange(n)
        while len(which):
            t = last[which, at[which]]
            steps.append((which, t))
            at[which] -= self.length[t]
            which = which[at[which] > 0]
        counts = np.zeros(n, np.int64)
        for which, _ in steps:
            counts[which] += 1
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), np.int32)
        for k, (which, t) in enumerate(steps):
            ids[ends[which] - 1 - k] = t
        ids, ends = ids.tobytes(), (4 * ends).tolist()
        begin = 0
        for i, end in zip(some.tolist(), ends, strict=True):
            out[i] = ids[begin:end]
            begin = end
        return out


class Tokenizer:
    """Normalise, pre-split, encode and decode as the vocabulary file prescribes."""

    def __init__(self, text):
        spec = json.loads(text)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {**{i: t for t, i in self.special.items()}, **{i: t for i, t in enumerate(self.automaton.labels) if t is not None}}
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}")).findall
        self.label = pa.array([self.labels.get(i, "") for i in range(max(self.labels) + 1)], pa.string())
        #: Texts that hold any of these are split by `split`.
        self.unusual = "|".join([ODD.pattern, *map(re.escape, self.special)])
        #: Pieces (special tokens: their numbers) and their ids, in two generations, so that those in use stay.
        self.young, self.old, self.bytes = {}, {}, 0

    def split(self, text):
        """Runs of characters without white space; special tokens are cut out of the raw text first."""
        if not text:
            return []
        if self.find_special is not None and self.find_special.search(text):
            return [x for run in WHITE_RUN.split(text) for x in self.cut(run) if x]
        return [x for x in WHITE_RUN.split(text) if x] if ODD.search(text) else text.split()

    def cut(self, run):
        at = 0
        for hit in self.find_special.finditer(run):
            yield run[at : hit.start()]
            yield hit.group()
            at = hit.end()
        yield run[at:]

    @staticmethod
    def normal(text):
        if text.isascii():
            return text.lower()
        # Lower case goes character by character, without a special form at word ends.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def runs(self, texts):
        """The runs of every text, flat, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, self.unusual)).as_py():
            lists = pa.array([self.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        words, at = lists.flatten(), np.asarray(lists.offsets)
        full = np.asarray(pc.binary_length(words)) > 0
        return words.filter(pa.array(full)), np.append(0, np.cumsum(full))[at - at[0]]

    def cut_runs(self, runs):
        """The pieces of all runs, and how many each run has. No piece crosses white space."""
        if self.special.keys().isdisjoint(runs):
            text = self.normal("\n".join(runs))
            pieces = self.pieces(text)
            ends = np.cumsum(np.fromiter(map(len, text.split("\n")), np.int64, len(runs)))
            stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            if stops[-1:] == ends[-1:]:  # the pattern leaves nothing out
                return pieces, np.diff(np.searchsorted(stops, ends, side="right"), prepend=0)
        each = [[self.special[run]] if run in self.special else self.pieces(self.normal(run)) for run in runs]
        return list(itertools.chain.from_iterable(each)), np.fromiter(map(len, each), np.int64, len(each))

    def learn(self, pieces):
        """Encode pieces that are not kept, all at once."""
        if self.bytes > KEPT_BYTES:
            self.old, self.young, self.bytes = self.young, {}, 0
        young, old = self.young, self.old
        missing = set(pieces).difference(young)
        known = {p: old[p] for p in missing.intersection(old)}
        fresh = list(missing.difference(known))
        words = [p for p in fresh if isinstance(p, str)]
        known.update(zip(words, self.automaton.packed([p.encode("utf-8") for p in words]), strict=True))
        if len(words) < len(fresh):
            known.update((p, np.int32(p).tobytes()) for p in fresh if not isinstance(p, str))
        young.update(known)
        self.bytes += 200 * len(known) + sum(map(len, words)) + sum(map(len, known.values()))

    def ids(self, runs):
        """Ids of all runs, flat, and how many each run has."""
        if not runs:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        pieces, counts = self.cut_runs(runs)
        self.learn(pieces)
        packed = list(map(self.young.__getitem__, pieces))
        each = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        return np.frombuffer(b"".join(packed), np.int32), np.diff(np.append(0, np.cumsum(each))[np.cumsum(counts)], prepend=0)

    def read(self, texts):
        """Ids and decoded text of every text, as Arrow columns; different runs are encoded and decoded once."""
        runs, at = self.runs(texts)
        coded = runs.dictionary_encode()
        del runs
        flat, counts = self.ids(coded.dictionary.to_pylist())
        ends = np.append(0, np.cumsum(counts))
        spelt = pc.binary_join(lists_of(ends, self.label.take(pa.array(flat))), " ")
        decoded = pc.binary_join(lists_of(at, spelt.take(coded.indices)), " ")
        which = np.asarray(coded.indices)
        counts = counts[which]
        stops = np.append(0, np.cumsum(counts))
        ids = flat[np.repeat(ends[which] - stops[:-1], counts) + np.arange(stops[-1])]
        return lists_of(stops[at], pa.array(ids)), decoded

    def encode(self, text):
        return self.read(pa.array([text], pa.string()))[0][0].as_py()

    def decode(self, ids):
        """Arc labels joined by a space, as the file names no decoder; special tokens stay."""
        return " ".join(map(self.labels.__getitem__, ids))


def lists_of(ends, values):
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def tokenizer(text):
    """The compiled tokenizer of a vocabulary, once per process while no other operator runs there."""
    return held(("bpe", hash(text)), lambda: Tokenizer(text))


def _encode(vocabulary):
    def run(batches):
        made = tokenizer(vocabulary)
        for batch in batches:
            for part in W.slices(batch, "_text", SLICE_BYTES):
                ids, decoded = made.read(part.column("_text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("_id"), "ids": ids, "decoded": decoded})
                del ids, decoded

    return run


def encode_texts(docs, vocabulary_path, id_col="doc_id", text_col="text"):
    """doc_id, ids (array of int) and decoded (text) of every row.

    The file is read on the driver and sent to the workers once. Null and empty texts
    have no ids and decode to the empty text; texts of any length are read whole. Rows
    are independent: repeated rows, null ids, ties and extra columns, clashing names
    included, need no care; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return base.mapInArrow(lean(_encode(vocabulary), keep=True), "doc_id long, ids array<int>, decoded string")
