"""Token ids of whole texts by a public tokenizer, with the ids of each distinct word kept."""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402

#: Words that a worker meets before those not met since the last such turn are forgotten; bounds space, not results.
KEPT_WORDS = 300_000
#: Characters for which the rules below are those of the tokenizer: ASCII text and the letters of Latin-1.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the split pattern stated in the tokenizer's file, for those characters in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in visible}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class TextEncoder:
    """Encodes texts as the tokenizer file says, without special tokens, to little-endian id bytes.

    The tokenizer lower-cases, drops white space and merges inside pieces of a word only, so a text's ids
    are those of its pieces in order. Pieces of plain texts are looked up; each new one is encoded by the
    library's model. Texts with other characters, or with the spelling of a special token, go through the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = False
        self.model = self.whole.model
        self.model._resize_cache(0)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        size = max(self.whole.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None and (found := self.older_pieces.get(piece)) is not None:
            self.pieces[piece] = found
        if found is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(spelled)], self.dtype).tobytes()
            self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.older_words.get(word)
        if found is None:
            found = b"".join([self._piece(p) for p in _PIECES.findall(word)])
        self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; a null text has none."""
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.words) > KEPT_WORDS:
            self.older_words, self.words = self.words, {}
        if len(self.pieces) > KEPT_WORDS:
            self.older_pieces, self.pieces = self.pieces, {}
        words, new = self.words, self._word
        return b"".join([words[w] if w in words else new(w) for w in text.lower().split()])


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file, one for each worker process."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def id_bytes(ids: bytes, dtype: np.dtype) -> bytes:
    """The same ids as unsigned 32-bit numbers, little-endian."""
    return np.frombuffer(ids, dtype).astype("<u4").tobytes()


def word_bpe() -> str:
    """Place of the public word-level BPE file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
