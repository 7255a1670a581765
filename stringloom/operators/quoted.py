"""Replace quoted texts of a file step after step, at the cost of the file and its hits.

A file is a list of pieces between its quotes. Texts to be replaced hold no quotes, so a hit is a whole
piece with the same quote on both sides, and an index from a piece's text to its places finds it without
going through the file. A replacement is cut at its own quotes and put in place of the piece and its two
quotes; what it leaves on either side joins the neighbouring pieces. Later steps see the result.
"""

import re
from collections import defaultdict

from ..functions.text import WS

_QUOTE = re.compile("([\"'])")
_SPACES = re.compile(f"[{re.sub(r'\\x\{([0-9A-F]+)\}', lambda m: chr(int(m[1], 16)), WS)}]*")


class QuotedText:
    """The pieces of a text. Piece ``i`` ends at quote ``close[i]``, which is '' for the last."""

    def __init__(self, text: str):
        self._cut(text)

    def _cut(self, text: str) -> None:
        parts = _QUOTE.split(text)
        self.text, self.close = parts[0::2], [*parts[1::2], ""]
        n = len(self.text)
        self.before, self.after = list(range(-1, n - 1)), [*range(1, n), -1]
        self.place: list[tuple[int, ...]] = [(i,) for i in range(n)]  # orders pieces, also those put in later
        self.alive = [True] * n
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.loose: dict[str, set[int]] = defaultdict(set)
        for i in range(n):
            self._file(i)

    def _file(self, i: int) -> None:
        self.exact[self.text[i]].add(i)
        self.loose[_core(self.text[i])].add(i)

    def _unfile(self, i: int) -> None:
        self.exact[self.text[i]].discard(i)
        self.loose[_core(self.text[i])].discard(i)

    def _quoted(self, i: int, quote: str) -> bool:
        """The piece stands between two quotes of this kind."""
        return self.alive[i] and self.close[i] == quote and self.before[i] >= 0 and self.close[self.before[i]] == quote

    def replace(self, original: str, replacement: str) -> bool:
        """Replace all double-quoted places of ``original``, or else all single-quoted ones, or else those with
        white space inside the quotes, double or else single. True if that changed the text."""
        if _QUOTE.search(original):
            return self._replace_plain(original, replacement)
        spaced = None
        for loose in (False, True):
            for quote in "\"'":
                if not loose:
                    hits = [i for i in self.exact.get(original, ()) if self._quoted(i, quote)]
                else:
                    spaced = spaced or re.compile(_SPACES.pattern + re.escape(original) + _SPACES.pattern)
                    hits = [i for i in self.loose.get(_core(original), ())
                            if self._quoted(i, quote) and spaced.fullmatch(self.text[i])]
                changed = False
                for i in sorted(hits, key=self.place.__getitem__):
                    if self._quoted(i, quote):  # not if the hit before it took its quote
                        changed |= replacement != quote + self.text[i] + quote
                        self._put(i, replacement)
                if changed:  # what stands there already is no replacement
                    return True
        return False

    def _put(self, i: int, replacement: str) -> None:
        """Put a text in place of a piece and its quotes."""
        left, right = self.before[i], self.after[i]
        parts = _QUOTE.split(replacement)
        texts, quotes = parts[0::2], parts[1::2]
        for j in (left, i, right):
            self._unfile(j)
        self.alive[i] = False
        if not quotes:  # all of it becomes one piece, which takes the place of the left one
            self.alive[right] = False
            self.text[left] += texts[0] + self.text[right]
            self.close[left], self.after[left] = self.close[right], self.after[right]
            if self.after[right] >= 0:
                self.before[self.after[right]] = left
            self._file(left)
            return
        self.text[left] += texts[0]
        self.close[left] = quotes[0]
        last = left
        for n, (text, quote) in enumerate(zip(texts[1:-1], quotes[1:], strict=True), 1):
            new = len(self.text)
            self.text.append(text)
            self.close.append(quote)
            self.before.append(last)
            self.after.append(-1)
            self.place.append((*self.place[i], n))
            self.alive.append(True)
            self.after[last] = new
            self._file(new)
            last = new
        self.alive[right] = False  # as another piece, so that a hit found before does not count any more
        new = len(self.text)
        self.text.append(texts[-1] + self.text[right])
        self.close.append(self.close[right])
        self.before.append(last)
        self.after.append(self.after[right])
        self.place.append(self.place[right])
        self.alive.append(True)
        self.after[last] = new
        if self.after[new] >= 0:
            self.before[self.after[new]] = new
        self._file(left)
        self._file(new)

    def _replace_plain(self, original: str, replacement: str) -> bool:
        """The same for a text that holds quotes, which pieces do not show."""
        text = str(self)
        inner = re.escape(original)
        for pattern in (f'"{inner}"', f"'{inner}'", f'"{_SPACES.pattern}{inner}{_SPACES.pattern}"', f"'{_SPACES.pattern}{inner}{_SPACES.pattern}'"):
            new = re.sub(pattern, lambda _: replacement, text)
            if new != text:
                self._cut(new)
                return True
        return False

    def __str__(self) -> str:
        out, i = [], 0
        while i >= 0:
            out += [self.text[i], self.close[i]]
            i = self.after[i]
        return "".join(out)


def _core(text: str) -> str:
    start = _SPACES.match(text).end()
    end = len(text) - _SPACES.match(text[:start - 1 if start else None:-1]).end()
    return text[start:end]


def replace_all(text: str, steps: list[tuple[str, str]]) -> tuple[str, int]:
    """The text after all (original, replacement) steps, and how many of them found a place."""
    pieces = QuotedText(text)
    applied = sum(pieces.replace(original, replacement) for original, replacement in steps)
    return (str(pieces) if applied else text), applied
