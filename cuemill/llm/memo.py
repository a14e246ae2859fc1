"""A bounded per-worker cache of tokenised words."""

from __future__ import annotations


class Memo:
    """Word to value, in two generations: when the young one is full it becomes the old one, whose unused words then go."""

    def __init__(self, make, size: int = 300_000):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def values(self, words: list) -> list:
        """The value of each word; ``make`` gets the list of the words that aren't known."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for w in set(words).difference(young):
            if w in old:
                young[w] = old[w]
            else:
                new.append(w)
        if new:
            young.update(zip(new, self.make(new), strict=True))
        return list(map(young.__getitem__, words))

