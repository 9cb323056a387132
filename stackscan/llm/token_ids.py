"""Token ids of texts with a public byte-level BPE file and the tokenizers library."""

from __future__ import annotations

import os
import re
from array import array

import regex

#: Most chunks, and most pieces, that a worker remembers of the newest; as many older ones stay for look-ups.
MEMO = 750_000
#: The pre-tokenisers' pattern for ASCII text, which the standard library's engine runs faster.
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: The same for texts up to U+024F: the letters, numbers and white space there, stated as ranges.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A space before which the pattern may not cut, if no two spaces follow each other: it stands behind other
#: white space and before white space or the end.
MIXED = re.compile(r"[^\S ] (?=\s|\Z)")
_SPACED_WORD = re.compile(r" ([A-Za-z]+)")
_WORD_MARKS = re.compile(r"([A-Za-z]+)([!-/:-@\[-`{-~]*)")
_BEYOND = re.compile(r"[^\x00-ɏ]")


def splitter(pattern: str):
    """The function that cuts a text into the matches of the public pre-tokeniser pattern."""
    full = regex.compile(pattern)

    def split(text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text)
        return full.findall(text) if _BEYOND.search(text) else _LATIN.findall(text)

    return split


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE files spell bytes as letters: printable ones as themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class _Memo(dict):
    """Answers by key; asks ``make`` for a key it does not hold yet.

    ``turn`` makes the answers the older generation once they are too many; of that one, those asked for
    again move back, and the rest go with the next turn.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()


class ChunkEncoder:
    """Encodes whole texts, asking the library's model for every distinct piece once.

    The pre-tokeniser of byte-level BPE cuts before a single space, unless other white space stands before it and
    white space or the end after it, so a text may be cut there and its chunks, which repeat often, be looked
    up. A new chunk is cut into pieces, and a new piece goes to the library's model. A text with such a space,
    or two in a row, is cut into pieces at once. With ``added`` a text
    that holds an added token of the file goes to the library whole; else their strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.letters = _byte_letters()
        self.split = splitter(public_tokenizers.PATTERN)
        self.space = self.letters[0x20]
        self.pieces, self.spaced = _Memo(self._piece), _Memo(self.new_chunk)

    def _spelled(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if (word := _SPACED_WORD.fullmatch(piece)):
            return self.spaced[word[1]]
        return self._spelled(piece.encode().decode("latin-1").translate(self.letters))

    def new_chunk(self, chunk: str) -> bytes:
        """The ids of a space and a text without white space that is a space."""
        # ASCII letters, spelled as themselves, and the space before them are one piece, and marks behind them another
        if (found := _WORD_MARKS.fullmatch(chunk)):
            word, marks = found.groups()
            return self.spaced[word] + self.pieces[marks] if marks else self._spelled(self.space + word)
        return self._whole(" " + chunk)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        for token in self.added:
            if token in text:
                return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        for memo in (self.pieces, self.spaced):
            memo.turn(MEMO)
        if "  " in text or MIXED.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(map(self.spaced.__getitem__, rest))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a file, added tokens included, made once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, added=True)
    return _ENCODERS[path]
