"""Token ids of whole texts, by a tokenizer that drops white space."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers

WORD_BPE = "word_bpe_49k.json"
#: Words that one Python worker keeps the ids of.
KEPT_WORDS = 600_000
#: Stands between words that go to the library together; it is a word of its own.
APART = "\x00"
#: How the tokenizer cuts a lower-case word of printable ASCII.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTABLE = re.compile(rb"[!-~]+")
_TAIL = b".,;:!?"


class Encoder:
    """``ids(texts)`` as the library gives them, without special tokens added.

    The tokenizer's steps never look across white space, so each distinct word
    goes to the library once and its ids are kept. Texts that hold the start of a
    special string go to the library whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.apart = self.library.encode(APART, add_special_tokens=False).ids
        assert len(self.apart) == 1
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ask(self, words: list[bytes]) -> None:
        """Ids of words not known yet, many in one text."""
        for at in range(0, len(words), 128):
            some = words[at:at + 128]
            joined = f" {APART} ".join([w.decode("utf-8", "replace") for w in some])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.apart[0]).tolist(), len(ids)]
            start = 0
            for word, end in zip(some, ends, strict=True):
                self.known[word] = ids[start:end].tobytes()
                start = end + 1

    def learn(self, words: set[bytes]) -> None:
        """Puts the ids of all ``words`` into ``known``.

        A word of printable ASCII is cut as the tokenizer cuts it, after lower
        case, and its pieces go to the model. Another word goes to the library,
        without the marks that close it after a letter."""
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known.clear()
        known, token = self.known, self.model.tokenize
        tails, ask = [], set()
        for word in words:
            if word in known:
                continue
            if _PRINTABLE.fullmatch(word):
                ids = b""
                for piece in _PIECES.findall(word.lower()):
                    if (got := known.get(piece)) is None:
                        got = known[piece] = array("I", [t.id for t in token(piece.decode())]).tobytes()
                    ids += got
                known[word] = ids
            elif b"\0" in word:
                known[word] = self.whole(word)
            else:
                base = word.rstrip(_TAIL)
                if len(base) < len(word) and not base[-8:].decode("utf-8", "ignore")[-1:].lower()[-1:].isalpha():
                    base = word
                ask.add(base)
                if len(base) < len(word):
                    tails.append((word, base, word[len(base):]))
        ask |= {tail for _, _, tail in tails}
        self._ask([w for w in ask if w not in known])
        for word, base, tail in tails:
            known[word] = known[base] + known[tail]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if b"<|" in t else t.split() for t in texts]
        out: list[bytes] = []
        for at in range(0, len(texts), 64):
            part = split[at:at + 64]
            self.learn(set().union(*[w for w in part if w is not None]))
            known = self.known
            out += [self.whole(t) if w is None else b"".join([known[x] for x in w]) for t, w in zip(texts[at:at + 64], part, strict=True)]
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(name if os.sep in name else public_tokenizers.path(name))
