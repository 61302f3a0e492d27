"""Token ids of whole texts with the tokenizers library, one library call per distinct piece of text.

The library splits a text into pieces before its merges and encodes each piece on its own, so ids can be kept per piece. Pieces are cut here
with the same patterns, for texts whose characters lie below U+0300, where normalisation to NFC changes nothing and classes of characters are
settled; other texts, and those that hold the content of an added token, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

#: Pieces whose ids a worker keeps; beyond that it starts anew.
KEPT_PIECES = 600_000
_TOP = 0x300


def _class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_TOP) if unicodedata.category(chr(c))[0] in kinds)


_SPACE = r"\t-\r \x85\xa0"
_L, _N = _class("L"), _class("N")
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|"
PATTERNS = {
    "byte_bpe_50k.json": re.compile(f"{_CUT} ?[{_L}]+| ?[{_N}]+| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
    "word_bpe_49k.json": re.compile(f"{_CUT}[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+"),
}
_HIGH = re.compile("[̀-\U0010ffff]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The characters that stand for the bytes 0 to 255 in the vocabularies: printable ones for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Pieces(dict):
    """The ids of pieces, as bytes; the library's merges run for a piece when it is first asked for."""

    def __init__(self, model):
        self.merge = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, each text followed by ``end``. With ``plain``, special tokens within a text are
    found as the library does unasked, else they are text like any other."""

    def __init__(self, path: str, end: int, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not plain
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if plain or not t.special]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = PATTERNS.get(os.path.basename(path))
        self.lower = "word_bpe" in path
        self.end = array("I", [end]).tobytes()
        self.kept = _Pieces(self.library.model)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        low = text.lower() if self.lower else text
        if self.pattern is None or _HIGH.search(text) or _HIGH.search(low) or (self.added and (self.added.search(text) or self.added.search(low))):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, self.pattern.findall(low))) + self.end


@functools.lru_cache(maxsize=4)
def encoder(path: str, end: int) -> Encoder:
    """A worker's encoder, which keeps its pieces from one task to the next; its ids are those of the library's plain encode."""
    return Encoder(path, end, plain=True)
