"""Pre-tokens of texts by the public pattern, in lists of bounded length.

Libraries know different versions of Unicode. Each character that a worker meets for the first time is shown
to the library once; where its class (letter, number, space, other) is not this module's, the
pattern is built anew so that the cuts are the library's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import regex

AT_ONCE = 1 << 18
KINDS = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}


class Splitter:
    def __init__(self, pattern: str, classify: Callable[[str], str]):
        self.source, self.classify = pattern, classify
        self.known = {chr(i) for i in range(128)}
        self.odd: dict[str, str] = {}
        self.pattern = regex.compile(pattern)
        self.own = {k: regex.compile(p) for k, p in KINDS.items()}

    def _meet(self, chars: set[str]) -> None:
        for c in chars:
            own = next((k for k, p in self.own.items() if p.match(c)), "O")
            if (theirs := self.classify(c)) != own:
                self.odd[c] = theirs
                self.pattern = None
        self.known |= chars
        if self.pattern is None:
            every = "".join(map(regex.escape, self.odd))
            p = self.source.replace(r"\S", r"[^\s]")
            for k, name in KINDS.items():
                mine = "".join(regex.escape(c) for c, x in self.odd.items() if x == k)
                p = p.replace(name, f"[[{name}--[{every}]]{f'[{mine}]' if mine else ''}]")
            self.pattern = regex.compile(p, regex.V1)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches in order; a long text gives several lists."""
        if not text.isascii() and not self.known.issuperset(chars := set(text)):
            self._meet(chars - self.known)
        if len(text) <= AT_ONCE:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, AT_ONCE)]:
            yield part
