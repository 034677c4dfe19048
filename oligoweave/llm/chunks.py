"""Cuts texts where a byte-level pre-tokenizer always cuts, and remembers the value of each cut.

The pre-tokenizer pattern lets a pre-token start with one space and never lets one run
over a later space. So a plain space with a non-space on either side always starts a new
pre-token, and what stands between two such spaces can be tokenized by itself. Texts
repeat these chunks, so a value (ids, bytes) is worked out once per chunk and worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_OTHER_SPACE = re.compile(r"[^\S \n]")


def plain_spacing(text: str) -> bool:
    """Whether each plain space of the text has a non-space on either side."""
    return not (
        "  " in text
        or " \n" in text
        or "\n " in text
        or text[:1] == " "
        or text[-1:] == " "
        or _OTHER_SPACE.search(text)
    )


class ChunkValues:
    """Values of the chunks of texts, in order.

    `compute` gets a list of strings and returns their values; `split` cuts a text whose
    spacing is not plain. The memory is emptied once it holds `limit` characters; that
    changes the work, never a value.
    """

    def __init__(self, compute: Callable[[list[str]], list], split: Callable[[str], list[str]], limit: int = 8_000_000):
        self._compute, self._split, self._limit = compute, split, limit
        self._spaced: dict[str, object] = {}
        self._plain: dict[str, object] = {}
        self._held = 0

    def of(self, texts: list[str]) -> Iterator[list]:
        """The values of each text's chunks; the texts of one call are worked out together."""
        if self._held > self._limit:
            self._spaced.clear()
            self._plain.clear()
            self._held = 0
        plain, spaced, plain_new, spaced_new = [], [], set(), set()
        for text in texts:
            if plain_spacing(text):
                first, *rest = text.split(" ")
                spaced_new.update(x for x in rest if x not in self._spaced)
                start = [first]
            else:
                start, rest = self._split(text), []
            plain_new.update(x for x in start if x not in self._plain)
            plain.append(start)
            spaced.append(rest)
        self._learn(self._plain, list(plain_new), "")
        self._learn(self._spaced, list(spaced_new), " ")
        for start, rest in zip(plain, spaced, strict=True):
            values = [self._plain[x] for x in start]
            values.extend(map(self._spaced.__getitem__, rest))
            yield values

    def _learn(self, memory: dict, chunks: list[str], before: str) -> None:
        if chunks:
            memory.update(zip(chunks, self._compute([before + x for x in chunks]), strict=True))
            self._held += sum(map(len, chunks)) + 4 * len(chunks)


def text_blocks(texts: list[str], most: int = 2_000_000) -> Iterator[list[int]]:
    """Positions of texts in blocks of about `most` characters."""
    block, size = [], 0
    for at, text in enumerate(texts):
        block.append(at)
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block
