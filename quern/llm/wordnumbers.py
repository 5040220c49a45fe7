"""Numbers for the distinct words of a stream of texts, so that what a word gives is computed once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordNumbers(dict):
    """Words to places in ``rows``, an array that ``make`` extends with a row for each new word.

    With over ``most`` words it starts anew at the next ``of``.
    """

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], most: int = 250_000):
        self.make, self.most, self.new = make, most, []
        self.rows = make([])

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[:0]
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.rows = np.concatenate([self.rows, self.make(self.new)])
            self.new = []
        return out
