"""Fixed strings that a page holds, found in one pass and then asked for as sets.

A page is read once by a pattern that is the prefix tree of all strings: at each place it takes the longest string that begins there. A
string is held exactly if one that begins with it was found, as all places are tried; so strings may overlap and contain each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Ways from a node of the tree that are tried one by one.
FEW = 4


def prefix_tree(literals: Iterable[str]) -> str:
    """A pattern that takes the longest of ``literals`` at a place."""
    tree: dict = {}
    for word in literals:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [(ch, re.escape(ch) + pattern(below)) for ch, below in sorted(node.items()) if ch]
        if not ways:
            return ""
        return halved(ways) + "?" if "" in node else halved(ways) if len(ways) > 1 else ways[0][1]

    def halved(ways: list[tuple[str, str]]) -> str:
        """The ways as alternatives; many are split behind looks at the next character, so that few are tried."""
        if len(ways) <= FEW:
            return f"(?:{'|'.join(way for _, way in ways)})"
        middle = len(ways) // 2
        sides = (f"(?=[{''.join(re.escape(ch) for ch, _ in side)}]){halved(side)}" for side in (ways[:middle], ways[middle:]))
        return f"(?:{'|'.join(sides)})"

    return pattern(tree)


class Literals:
    """A set of strings, none empty, to look for in texts."""

    def __init__(self, *groups: Iterable[str]):
        self.words = sorted({w for group in groups for w in group})
        if not all(self.words):
            raise ValueError("an empty string is in every text")
        firsts = "".join(re.escape(ch) for ch in sorted({w[0] for w in self.words}))
        self._pattern = f"(?=[{firsts}])(?=({prefix_tree(self.words)}))"

    def found(self, text: Column) -> Column:
        """The distinct longest strings of all places of ``text``; null for null."""
        return F.array_distinct(F.regexp_extract_all(text, F.lit(self._pattern), F.lit(1)))

    def holds(self, found: Column, word: str) -> Column:
        """Whether the text that ``found`` was taken from holds ``word``."""
        return self.holds_any(found, (word,))

    def holds_any(self, found: Column, words: Iterable[str]) -> Column:
        words = tuple(words)
        if not set(words) <= set(self.words):
            raise KeyError(sorted(set(words) - set(self.words)))
        longer = [w for w in self.words if w.startswith(words)]
        return F.array_contains(found, longer[0]) if len(longer) == 1 else F.arrays_overlap(found, F.array(*map(F.lit, longer)))
