"""A trie of words walked by a Levenshtein automaton with swaps of neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

_END = ""


class Trie:
    def __init__(self, words: Iterable[str] = ()) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[_END] = word

    def within(self, word: str, edits: int) -> Iterator[tuple[str, int]]:
        """Each word of the trie at most ``edits`` insertions, deletions, replacements or swaps away, once."""
        best: dict[str, int] = {}
        done: dict[tuple[int, int], int] = {}
        # automaton state: trie node, letters of the word read, edits spent
        todo = [(self.root, 0, 0)]
        size = len(word)
        while todo:
            node, at, spent = todo.pop()
            state = (id(node), at)
            if done.get(state, edits + 1) <= spent:
                continue
            done[state] = spent
            if at == size and _END in node:
                found = node[_END]
                if spent < best.get(found, edits + 1):
                    best[found] = spent
            if at < size and word[at] in node:
                todo.append((node[word[at]], at + 1, spent))
            if spent < edits:
                if at < size:
                    todo.append((node, at + 1, spent + 1))
                    if at + 1 < size and word[at] != word[at + 1]:
                        second = node.get(word[at + 1])
                        if second is not None and word[at] in second:
                            todo.append((second[word[at]], at + 2, spent + 1))
                for ch, child in node.items():
                    if ch != _END:
                        if at < size and ch != word[at]:
                            todo.append((child, at + 1, spent + 1))
                        todo.append((child, at, spent + 1))
        return iter(best.items())
