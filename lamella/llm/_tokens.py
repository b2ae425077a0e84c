"""Token ids of whole texts with a public tokenizer, remembered word by word.

No piece that the tokenizer encodes crosses a space or a line feed, so the ids
of a text are those of its space-separated words in order, and known words are
looked up.  A new word of Latin-1 characters, where lower case and the
tokenizer's classes are plain, is split into pieces here by the tokenizer's own
rule (letters, single digits, runs of other characters, a few contractions),
and the library's model encodes each new piece, its bytes named as the
tokenizer's byte level names them.  Other new words, and those that may hold a
special token, are encoded by the library whole.  Full tables take no more.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

WORDS = 400_000
PIECES = 300_000
SLICE = 1 << 20
GROUP = 1 << 21
LONGEST = 200

_SPACE = r"\x09-\x0d\x20\x85\xa0"
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

#: Byte-level BPE names the bytes that don't print by the code points from 256 on, in order.
_NAMES = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_type(path: str) -> str:
    """The numpy type that holds every id of the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers; ``GROUP`` characters or one slice are split at a time."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _slices(text or ""):
                held.append((i, part))
                size += len(part)
                if size > GROUP:
                    self._flush(held, parts)
                    held, size = [], 0
        self._flush(held, parts)
        return [np.frombuffer(p[0] if len(p) == 1 else b"".join(p), dtype="<u4") for p in parts]

    def encode(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def _flush(self, held: list[tuple[int, str]], parts: list[list[bytes]]) -> None:
        get, open_ = self.words.get, []
        fresh: dict[str, bytes] = {}
        for i, text in held:
            words = text.replace("\n", " ").split(" ")
            ids = list(map(get, words))
            if None in ids:
                gaps = [k for k, x in enumerate(ids) if x is None]
                fresh.update([(words[k], b"") for k in gaps])
                open_.append((i, len(parts[i]), words, ids, gaps))
                parts[i].append(b"")
            else:
                parts[i].append(b"".join(ids))
        if fresh:
            self._spell(fresh)
            for i, at, words, ids, gaps in open_:
                for k in gaps:
                    ids[k] = fresh[words[k]]
                parts[i][at] = b"".join(ids)

    def _spell(self, fresh: dict[str, bytes]) -> None:
        """Fill in the ids of new words, and remember them while there is room."""
        known, room = self.pieces, PIECES - len(self.pieces)
        for w in fresh:
            if not _latin(w):
                fresh[w] = self._library(w)
                continue
            ids = []
            for p in _PIECE.findall(w.lower()):
                x = known.get(p)
                if x is None:
                    x = array("I", [t.id for t in self.tokenize(_byte_names(p))]).tobytes()
                    if room > 0 and len(p) <= LONGEST:
                        known[p] = x
                        room -= 1
                ids.append(x)
            fresh[w] = ids[0] if len(ids) == 1 else b"".join(ids)
        if len(self.words) + len(fresh) <= WORDS:
            self.words.update([x for x in fresh.items() if len(x[0]) <= LONGEST])

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()


def _slices(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.find(" ", at + SLICE) if at + SLICE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _byte_names(piece: str) -> str:
    return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_NAMES)


def _latin(text: str) -> bool:
    if "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
