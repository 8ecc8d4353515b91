"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

The library spends most of its time on cutting texts into words and keeping
offsets. ``Encoder`` cuts at single spaces and line feeds between other
characters, where the library's pattern always cuts too, remembers the ids of
each piece and asks the library's model only for words it hasn't met. Texts
with any other white space go to the library whole. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``, which gives the
vocabulary's special strings their own ids where a text holds them; with
``plain`` they are ordinary text.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A text is cut into words by this pattern of the vocabulary (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The vocabulary writes each byte as a letter: printable Latin-1 bytes as
    themselves, the others in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Encoder:
    """Ids of texts as little-endian bytes; one per Python worker."""

    def __init__(self, path: str, remember: int = 1_200_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        wide = self.library.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.remember = remember
        self._code = "I" if wide else "H"
        self._words = regex.compile(WORDS)
        self._letters = _byte_letters()
        self._line_feed = self._ask("\n")
        self._first: dict[str, bytes] = {}  # pieces at the start of a line
        self._next: dict[str, bytes] = {}  # pieces after a space, kept without it

    def _ask(self, word: str) -> bytes:
        """Ids of one word of the pattern, from the library's model."""
        letters = word.encode().decode("latin1").translate(self._letters)
        return array(self._code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _learn(self, piece: str, space: str) -> bytes | None:
        """Ids of a new piece; None where it holds white space or nothing."""
        known = self._next if space else self._first
        if piece.isalpha():
            ids = self._ask(space + piece)
        elif piece[:-1].isalpha() and piece[-1] in ".,":
            word = piece[:-1]
            ids = (known.get(word) or self._learn(word, space)) + self._first.get(piece[-1], b"")
            if piece[-1] not in self._first:
                ids += self._learn(piece[-1], "")
        elif piece.split() != [piece]:
            return None
        else:
            ids = b"".join(map(self._ask, self._words.findall(space + piece)))
        known[piece] = ids
        return ids

    def _pieces(self, pieces: list[str], known: dict[str, bytes], space: str) -> list[bytes | None]:
        out = list(map(known.get, pieces))
        if None in out:
            out = [known.get(p) or self._learn(p, space) if i is None else i for p, i in zip(pieces, out, strict=True)]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of the text without the end id."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        self._forget()
        ids = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            ids += self._pieces([first], self._first, "")
            ids += self._pieces(rest, self._next, " ")
            ids.append(self._line_feed)
        ids.pop()
        if None in ids:
            return self._whole(text)
        return b"".join(ids)

    def _forget(self) -> None:
        for known in (self._first, self._next):
            if len(known) > self.remember:
                known.clear()

    def _whole(self, text: str) -> bytes:
        return array(self._code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def pieces(self, bodies: list[str], lead: str) -> list[bytes | None]:
        """Ids of pieces that follow a single space or line feed, with it; None
        for a piece that is empty or holds white space."""
        self._forget()
        if lead == " ":
            return self._pieces(bodies, self._next, " ")
        return [None if ids is None else self._line_feed + ids for ids in self._pieces(bodies, self._first, "")]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
