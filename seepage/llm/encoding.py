"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

No merge of such a tokenizer reaches over a space that separates two words, a
line end or the end of a run of letters.  Texts are cut there and each
different piece is encoded once per worker.  A piece's ids are kept as bytes
of little-endian unsigned numbers, so a text's ids are one join.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Different pieces that a worker remembers; later ones are encoded each time.
REMEMBERED = 600_000

# white space next to white space, other than one blank or line end between two words, and texts that begin or end with it
_IRREGULAR = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")
_TAIL = ".,;:!?"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as bytes, ``width`` bytes an id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # a text that holds the string of an added token is given to the library as a whole
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        self.model = self.whole.model
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        # the byte alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + k for k, b in enumerate(hidden)}

    def _plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a blank and a run of letters."""
        ids = self.letters.get(word)
        if ids is None:
            symbols = (" " + word).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array([t.id for t in self.model.tokenize(symbols)], self.kind).tobytes()
            if len(self.letters) < REMEMBERED:
                self.letters[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(_TAIL)
        if core.isalpha():
            tail = piece[len(core):]
            ids = self._word(core) + (self._tail(tail) if tail else b"")
        else:
            ids = self._plain(piece if piece[0] == "\n" else " " + piece)
        if len(self.known) < REMEMBERED:
            self.known[piece] = ids
        return ids

    @lru_cache(4096)  # noqa: B019 - one encoder per worker
    def _tail(self, tail: str) -> bytes:
        return self._plain(tail)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added.search(text):
            return self._plain(text)
        if _IRREGULAR.search(text):
            return self._irregular(text)
        pieces = text.replace("\n", " \n").split(" ")
        known, missing = self.known, self._piece
        out = [known.get(p) or missing(p) for p in pieces[1:]]
        return b"".join([self._plain(pieces[0]), *out])

    def _irregular(self, text: str) -> bytes:
        """Cut at blanks between two words only; all other white space stays inside its piece."""
        pieces = re.split(r"(?<=\S) (?=\S)", text)
        out = [self._plain(pieces[0])]
        for p in pieces[1:]:
            out.append(self._plain(" " + p) if p[0] == "\n" or _IRREGULAR.search(p) or "\n" in p else self.known.get(p) or self._piece(p))
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process, kept between its tasks."""
    return Encoder(path)


def lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    own = encoder(path)
    size = own.kind.itemsize
    for batch in batches:
        yield batch, [len(own.encode(t or "")) // size for t in batch.column("text").to_pylist()]
