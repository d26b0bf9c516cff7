"""Results kept by argument, for functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """A function that keeps its last results, `most` at the most; all go when they are more.

    The package's functions go to tasks by value. A cache of functools would go by name instead and bring a second copy of its
    module, whose exceptions and classes are others; this one goes with its function and leaves its results behind.
    """

    def __init__(self, function: Callable, most: int):
        self.function, self.most, self.results = function, most, {}

    def __call__(self, *args):
        if args not in self.results:
            made = self.function(*args)
            if len(self.results) >= self.most:
                self.results.clear()
            self.results[args] = made
        return self.results[args]

    def __reduce__(self):
        return Memo, (self.function, self.most)


def memo(most: int) -> Callable[[Callable], Memo]:
    return lambda function: Memo(function, most)
