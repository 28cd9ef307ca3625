"""LM scoring: a smoothed n-gram model as a weighted backoff automaton, and texts scored by one traversal of it.

States are the histories of up to ORDER - 1 tokens that the training texts have. A state's arcs are the tokens seen after
its history; each has a weight, the log10 of its probability, and leads to the state of the longest history that the
tokens read so far end with. Every other token is reached over the state's failure arc, which costs the log10 of the
state's backoff weight and leads to the history without its first token, at last to the root. The root's arcs are all
single tokens, the unknown ones among them with one weight. A text starts in the state of its begin mark.

Weights are Witten's and Bell's, from counts c and numbers of different followers t of the whole training part:
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), backoff(h) = t(h) / (c(h) + t(h)),
p(w | h) = c(hw) / (c(h) + t(h)) + backoff(h) p(w | h without its first token).
What leaves a state over its arcs and its failure arc thus sums to 1.

Counts come from blockcount in two rounds: counts of all n-grams, with a mark that makes one block the owner of each; then
the followers of each history, each n-gram counted by its owner, so that no history, however common, is one group. Each
block of documents builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .blockcount import ASKS, Kinds, _asks, ask, counted, dealt, totals, with_answers
from .common import distinct, mix, word_hashes

ADD = 0.1
ORDER = 3
#: Tokens of a stretch of text; all stretches of a block are walked in step.
STRETCH = 64
#: Bits by which keys of n-grams are longer than the length in bits of the number of bytes of all texts; at least LEAST_BITS.
SPARE_BITS, LEAST_BITS = 18, 48
BEGIN, END = np.uint64(0x51ED270B7F3A9C10), np.uint64(0x2545F4914F6CDD1C)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, token_score double"


def held_out(doc_id: object) -> bool:
    """crc32 of the id as text, modulo 10, is 0; a row without an id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class Grams:
    """The distinct n-grams of some texts. Level k - 1 has the k-grams: of each its parent (the k-gram without its last
    token, on the level above), its last token, its suffix (without its first token, on the level above), its own count
    in the texts to learn from and its key. Tokens are numbers; `begin` is the mark before a text, which nothing precedes."""

    def __init__(self, texts: list[bytes | None], learn: np.ndarray, order: int):
        words, n = word_hashes(texts)
        self.lengths = n + 1  # with the end mark
        starts = np.cumsum(n + 2) - (n + 2)  # places of begin marks
        total = int((n + 2).sum())
        special = np.zeros(total, bool)
        ends = starts + n + 1
        special[starts], special[ends] = True, True
        keys, codes = distinct(words)
        self.begin, self.end = len(keys) + 1, len(keys)
        self.base = len(keys) + 2
        tokens = np.empty(total, np.int64)
        tokens[~special] = codes
        tokens[starts], tokens[ends] = self.begin, self.end
        self.tokens, self.starts = tokens, starts
        of_learn = np.repeat(learn, n + 2)
        place = np.arange(total) - np.repeat(starts, n + 2)
        counts = np.bincount(tokens[of_learn], minlength=self.base)
        none = np.zeros(self.base, np.int64)
        self.parent, self.last, self.suffix = [none], [np.arange(self.base)], [none]
        self.own, self.keys = [counts], [np.concatenate([keys, [END, BEGIN]])]
        upper = tokens
        for k in range(2, order + 1):
            there = place >= k - 1
            pairs, which = distinct((upper[:-1] * self.base + tokens[1:])[there[1:]])
            here = np.full(total, -1, np.int64)
            here[there] = which
            suffix = np.empty(len(pairs), np.int64)
            suffix[which] = upper[there]
            parent, last = pairs // self.base, pairs % self.base
            self.parent.append(parent)
            self.last.append(last)
            self.suffix.append(suffix)
            self.own.append(np.bincount(which[of_learn[there]], minlength=len(pairs)))
            self.keys.append(mix(self.keys[-1][parent] * np.uint64(0x9E3779B97F4A7C15) + self.keys[0][last] + np.uint64(k)))
            upper = here

    def asked(self, bits: int, wanted: list[np.ndarray], values: list[np.ndarray] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """The wanted n-grams as keys of both kinds, with their values if there are any, and the place of each wanted one
        in them. The keys of single tokens are whole, so that their counts are exact; the others have so many bits."""
        if not wanted:
            return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2, []
        single, at_single = distinct(self.keys[0][wanted[0]])
        longer = [k[w] >> np.uint64(64 - bits) for k, w in zip(self.keys[1:], wanted[1:])]
        keys, at = distinct(np.concatenate(longer or [np.zeros(0, np.uint64)]))
        ends = np.cumsum([len(x) for x in longer])[:-1] if longer else []
        first = more = np.zeros(0, np.int64)
        if values is not None:
            first = np.bincount(at_single, values[0][wanted[0]], len(single)).astype(np.int64)
            of = np.concatenate([v[w] for v, w in zip(values[1:], wanted[1:])] or [more])
            more = np.bincount(at, of, len(keys)).astype(np.int64)
        return [(single, first), (keys, more)], [at_single, *(np.split(at, ends) if longer else [])]

    def all(self) -> list[np.ndarray]:
        """Every n-gram but the begin mark, which is no token."""
        return [np.arange(len(k)) != self.begin if not i else np.ones(len(k), bool) for i, k in enumerate(self.keys)]

    def answered(self, bits: int, answer: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Of each level the counts of the whole training part, the n-grams that other blocks ask for too, and those that
        this block has learned from and owns."""
        wanted = self.all()
        _, places = self.asked(bits, wanted)
        counts, asked, owned = [], [], []
        for k, (w, at) in enumerate(zip(wanted, places)):
            told = [np.zeros(len(w), x.dtype) for x in answer[min(k, 1)]]
            for mine, x in zip(told, answer[min(k, 1)]):
                mine[w] = x[at]
                if not k:
                    mine[self.begin] = mine[self.end]  # a text has one begin and one end
            counts.append(self.own[k] + told[0])
            asked.append(told[1])
            owned.append(told[2] & (self.own[k] > 0))
        return counts, asked, owned

    def followers(self, owned: list[np.ndarray]) -> list[np.ndarray]:
        """Of each level but the last the number of n-grams of this block that have the n-gram as parent."""
        return [np.bincount(self.parent[k + 1][owned[k + 1]], minlength=len(self.keys[k])) for k in range(len(self.keys) - 1)]

    @staticmethod
    def shared(counts: list[np.ndarray], asked: list[np.ndarray]) -> list[np.ndarray]:
        """Histories of the training part that other blocks ask for too, of each level but the last. One that is there
        once has one follower, and is no question."""
        return [(c > 1) & o for c, o in zip(counts[:-1], asked[:-1])]

    @staticmethod
    def single(counts: list[np.ndarray], after: list[np.ndarray]) -> list[np.ndarray]:
        """Numbers of followers, with that of histories that are there once."""
        return [np.where(c == 1, 1, a) for c, a in zip(counts[:-1], after)]


class Automaton:
    """States and arcs as arrays. State 0 is the root. The arc of token w from the root is arc w; other arcs are sorted by
    state * base + token in `goto`, those of a state from `first` on, `number` of them. Of each arc: `weight` and the state
    it leads to, `to`. Of each state: `back`, the weight of its failure arc, and `fail`, the state that leads to."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], followers: list[np.ndarray], n_tokens: int, n_types: int):
        order = len(counts)
        self.base, self.begin = grams.base, grams.begin
        p = [(counts[0] + ADD) / (n_tokens + ADD * (n_types + 1))]
        first = np.cumsum([1] + [len(c) for c in counts[:-1]])  # state of the first n-gram of each level
        states = int(first[-1])
        self.fail, self.back = np.zeros(states, np.int64), np.zeros(states)
        is_state = np.zeros(states, bool)
        is_state[0] = True
        goto, weight, to = [], [np.log10(p[0])], [np.zeros(self.base, np.int64)]
        for k in range(order - 1):
            seen = (counts[k] > 0) & (followers[k] > 0)
            own = first[k] + np.flatnonzero(seen)
            is_state[own] = True
            share = followers[k][seen] / (counts[k][seen] + followers[k][seen])
            self.back[own] = np.log10(share)
            self.fail[own] = first[k - 1] + grams.suffix[k][seen] if k else 0
        for k in range(1, order):
            parent, suffix = grams.parent[k], grams.suffix[k]
            arc = counts[k] > 0
            t, c = followers[k - 1][parent[arc]], counts[k - 1][parent[arc]]
            now = np.zeros(len(arc))
            now[arc] = (counts[k][arc] + t * p[k - 1][suffix[arc]]) / (c + t)
            p.append(now)
            goto.append((first[k - 1] + parent[arc]) * self.base + grams.last[k][arc])
            weight.append(np.log10(now[arc]))
            to.append(first[k] + np.flatnonzero(arc) if k < order - 1 else first[k - 1] + suffix[arc])
        to[0] = np.arange(1, self.base + 1) if order > 1 else to[0]
        self.goto = np.concatenate(goto or [np.zeros(0, np.int64)])
        self.number = np.bincount(self.goto // self.base, minlength=states)
        self.first = np.cumsum(self.number) - self.number
        self.weight, self.to = np.concatenate(weight), np.concatenate(to)
        while len(lost := np.flatnonzero(~is_state[self.to])):  # such as a history that ends a text: left for its suffix
            self.to[lost] = self._suffix_state(grams, first, self.to[lost])
        self.start = 1 + self.begin if order > 1 and is_state[1 + self.begin] else 0
        self.unigram = np.log10(p[0])

    @staticmethod
    def _suffix_state(grams: Grams, first: np.ndarray, states: np.ndarray) -> np.ndarray:
        out = np.zeros(len(states), np.int64)
        for k in range(1, len(first)):
            mine = (states >= first[k]) & (states < first[k] + len(grams.suffix[k]))
            out[mine] = first[k - 1] + grams.suffix[k][states[mine] - first[k]]
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the log10 probabilities of the tokens: failure arcs as far as needed, then an arc."""
        cost, arc = np.zeros(len(state)), token.copy()
        left, now = np.flatnonzero(state > 0), state[state > 0]
        while len(left):
            want, at, many = now * self.base + token[left], self.first[now], np.flatnonzero(self.number[now] > 1)
            at[many] = np.searchsorted(self.goto, want[many])  # a state with one arc needs no search
            at[at == len(self.goto)] = 0
            hit = self.goto[at] == want
            arc[left[hit]] = self.base + at[hit]
            left, now = left[~hit], now[~hit]
            cost[left] += self.back[now]
            now = self.fail[now]
            left, now = left[now > 0], now[now > 0]
        return self.to[arc], cost + self.weight[arc]

    def walk(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: int, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each text: places starts + 1 on, lengths tokens. Texts are cut into stretches, all walked
        in step; a stretch inside a text first reads the order - 1 tokens before it, which fix its state."""
        stretch = max(stretch, order - 1)
        pieces = -(-lengths // stretch)
        text = np.repeat(np.arange(len(lengths)), pieces)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        size = np.minimum(stretch, lengths[text] - offset)
        rank = np.argsort(-size, kind="stable")
        text, offset, size = text[rank], offset[rank], size[rank]
        at = starts[text] + 1 + offset
        state = np.where(offset > 0, 0, self.start)
        inner = np.flatnonzero(offset > 0)
        for k in range(order - 1, 0, -1):
            state[inner] = self.step(state[inner], tokens[at[inner] - k])[0]
        total = np.zeros(len(text))
        active = len(text)
        for k in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size[:active], -k, side="left"))  # sizes fall: those above k
            state[:active], cost = self.step(state[:active], tokens[at[:active] + k])
            total[:active] += cost
        return np.bincount(text, total, len(lengths))


def score(docs: DataFrame, order: int = ORDER, train: Callable[[object], bool] = lambda doc_id: not held_out(doc_id)) -> DataFrame:
    """Scores every text; learns from the rows whose id train() accepts. token_score is the score of a text by token.

    One row for each row of docs. A null text is empty: one token, the end. Without any training row N = V = 0 and each
    token has probability 1 under both models. Repeated rows count as often as they are there. A very long text is a block
    of its own and is walked in stretches. An empty table gives an empty result. Other columns are not read."""
    blocks, size = dealt(docs)
    bits = min(64, max(LEAST_BITS, size.bit_length() + SPARE_BITS))
    kinds: Kinds = [(64, size // 30 + 1), (bits, int(size / 7 * (order - 1)) + 1)]
    told: Kinds = [(64, size // 40 + 1), (bits, int(size / 14 * max(0, order - 2)) + 1)]

    def grams(ids: list, texts: list) -> tuple[Grams, np.ndarray]:
        learn = np.array([train(x) for x in ids], bool)
        return Grams(texts, learn, order), learn

    def first(ids: list, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        own, _ = grams(ids, texts)
        return own.asked(bits, own.all(), own.own)[0]

    counts = counted(ask(blocks, first, kinds), "counts")
    n_types, n_tokens = totals(counts, kinds)

    def second(block: int, ids: list, texts: list, hashes: np.ndarray, answer: list) -> pd.DataFrame:
        own, _ = grams(ids, texts)
        count, asked, owned = own.answered(bits, answer)
        keys, _ = own.asked(bits, own.shared(count, asked), own.followers(owned))
        return _asks(block, keys, told)

    followers = counted(with_answers(blocks, [(counts, kinds)], second, ASKS), "followers")

    def use(block: int, ids: list, texts: list, hashes: np.ndarray, answer: list, more: list) -> pd.DataFrame:
        own, learn = grams(ids, texts)
        count, asked, owned = own.answered(bits, answer)
        after = own.single(count, own.followers(owned))
        shared = own.shared(count, asked)
        for k, (w, at) in enumerate(zip(shared, own.asked(bits, shared)[1])):
            after[k][w] += more[min(k, 1)][0][at]
        model = Automaton(own, count, after, n_tokens, n_types)
        logp = model.walk(own.tokens, own.starts, own.lengths, order)
        text = np.repeat(np.arange(len(ids)), own.lengths)
        words = own.tokens[own.tokens != own.begin]
        known, base = np.bincount(text, count[0][words] > 0, len(ids)), np.bincount(text, model.unigram[words], len(ids))
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": ~learn, "n_tokens": own.lengths, "n_known": known.astype(np.int64), "train_tokens": n_tokens, "base_score": base, "score": logp, "token_score": logp / own.lengths})

    return with_answers(blocks, [(counts, kinds), (followers, told)], use, SCHEMA)
