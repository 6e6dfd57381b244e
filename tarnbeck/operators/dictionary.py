"""A phrase dictionary that scans each text once.

Whole phrases in a text are found by an Aho-Corasick automaton over all phrases; the phrases that hold a text by a
suffix automaton over all phrases, whose states know them; phrases that may be alike by an inverted list of
their words and by their lengths.  No table of texts and phrases is made: only hits leave a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

from ..config import RULES
from ..functions import similarity as sim


class SuffixAutomaton:
    """Every substring of the phrases leads to a state; ``holding`` gives the phrases that hold a text."""

    def __init__(self, phrases: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for p in phrases:
            state = 0
            for c in p:
                state = self._extend(state, c)
        self.held: list[list[int]] = [[] for _ in self.next]
        for k, p in enumerate(phrases):
            state = 0
            for c in p:  # every substring that ends here is this state's or one of its suffix links'
                state = self.next[state][c]
                up = state
                while up > 0 and (not self.held[up] or self.held[up][-1] != k):
                    self.held[up].append(k)
                    up = self.link[up]

    def _new(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, c: str) -> int:
        """The state reached by ``c``, cut off from longer texts if it stands for such too."""
        to = self.next[state][c]
        if self.length[to] == self.length[state] + 1:
            return to
        short = self._new(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = short
        while state != -1 and self.next[state].get(c) == to:
            self.next[state][c] = short
            state = self.link[state]
        return short

    def _extend(self, state: int, c: str) -> int:
        if c in self.next[state]:
            return self._split(state, c)
        made = self._new(self.length[state] + 1, {}, 0)
        while state != -1 and c not in self.next[state]:
            self.next[state][c] = made
            state = self.link[state]
        if state != -1:
            self.link[made] = self._split(state, c)
        return made

    def holding(self, text: str) -> list[int]:
        state = 0
        for c in text:
            state = self.next[state].get(c, -1)
            if state == -1:
                return []
        return self.held[state] if text else []


class Dictionary:
    """``phrases`` are normalised and not empty; a hit is the phrase's place in the list."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.phrases = phrases
        self.fragments = SuffixAutomaton(phrases)
        places: dict[str, list[int]] = defaultdict(list)
        for k, p in enumerate(phrases):
            places[p].append(k)
        self.automaton = ahocorasick.Automaton()
        for p, ks in places.items():
            self.automaton.add_word(p, ks)
        self.automaton.make_automaton()
        self.sets = [frozenset(p.split()) for p in phrases]
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for k, own in enumerate(self.sets):
            for w in own:
                self.by_word[w].append(k)
        self.lengths = [_joined(own) for own in self.sets]
        self.order = sorted(range(len(phrases)), key=self.lengths.__getitem__)
        self.sorted_lengths = [self.lengths[k] for k in self.order]

    def inside(self, text: str) -> set[int]:
        """Phrases that the text holds whole."""
        return {k for _, ks in self.automaton.iter(text) for k in ks} if self.phrases else set()

    def holding(self, text: str) -> list[int]:
        """Phrases that hold the text (equal ones too)."""
        return self.fragments.holding(text)

    def loose(self, text: str, but: set[int], threshold: float) -> list[tuple]:
        """``(phrase, words, part, covered, anchored)`` of phrases alike enough in words, each score as far as the one before lets it."""
        own = frozenset(text.split())
        size = _joined(own)
        low, high = size * threshold / (2 - threshold) - 1e-6, size * (2 - threshold) / threshold + 1e-6
        near = set(self.order[bisect_left(self.sorted_lengths, low) : bisect_right(self.sorted_lengths, high)])
        near.update(k for w in own if w in self.by_word for k in self.by_word[w])
        out = []
        for k in near - but:
            p = self.phrases[k]
            if not self._may_pass(k, own, size, threshold) or (words := sim.token_set_ratio(p, text) / 100.0) < threshold:
                continue
            part = sim.partial_ratio(p, text) / 100.0
            covered = sim.word_coverage(p, text) if part >= threshold else None
            out.append((k, words, part, covered, sim.has_anchor(p, text) if covered is not None and covered >= RULES.word_coverage else None))
        return out

    def _may_pass(self, k: int, own: frozenset, size: int, threshold: float) -> bool:
        """Whether the lengths of the shared and all words leave a word-set ratio of ``threshold`` possible."""
        a, shared = self.lengths[k], own & self.sets[k]
        if 2 * min(a, size) >= (threshold - 1e-9) * (a + size):
            return True
        s = _joined(shared)
        return bool(shared) and 2 * s >= (threshold - 1e-9) * (s + min(a, size))


def _joined(own: frozenset) -> int:
    return sum(map(len, own)) + max(0, len(own) - 1)
