"""Token ids of whole texts, with the library's own result for each distinct pre-token remembered.

Texts are cut at ASCII white space, where none of these tokenizers lets a token, a contraction or a normalised
character reach across; what stands between two cuts is encoded by the library once and then looked up. The two kinds
of vocabulary:

* ``words``: white space makes no token, so the pre-tokens are the words themselves;
* ``spaced``: white space belongs to the word after it, so a pre-token is a run of white space and the word after it;
  punctuation after plain letters, where the library begins anew as well, is a pre-token of its own. Such a text is
  encoded whole where it has other Unicode white space, which can join an ASCII run.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections import Counter

from .common import Memo, held, stretches

#: Bytes of remembered pre-tokens, about; a task uses one of the two tables. What is forgotten costs the library's time again.
PRE_TOKEN_BYTES = 96 << 20

#: White space beyond [\x20\x09-\x0D], by the Unicode property and by Python's isspace().
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: What may follow a word and makes one pre-token of its own: ASCII punctuation but the apostrophe, which begins contractions.
PUNCTUATION = string.punctuation.replace("'", "")

#: A run of letters, with the one space before it, is a pre-token of its own where PUNCTUATION, white space or nothing follows.
_SPACED = re.compile(
    rf" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?=[\x20\x09-\x0D{re.escape(PUNCTUATION)}]|\Z)"
    r"|[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
)


def _spelled() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


_SPELLED = _spelled()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A tokenizer file's ids and counts; ``width``: bytes an id takes (2 or 4); ``remember``: bytes of pre-tokens."""

    def __init__(self, path: str, width: int = 4, remember: int = PRE_TOKEN_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = {2: "H", 4: "I"}[width]
        self.spaced = spec.get("normalizer") is None
        self.model = self.tokenizer.model
        self._ids, self._counts = Memo(self._encode, remember), Memo(self._count, remember)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, key) -> str | tuple | None:
        """What a new pre-token is made of: one entry for the model, or keys side by side, or None: ask the library.

        Only plain cases are taken apart, in which the library's own rules leave no choice: letters up to U+00FF, which
        normalise to themselves and make one run, perhaps with a run of PUNCTUATION after them.
        """
        if self.spaced:
            text, lead = key, 1 if key[0] == " " else 0
        else:
            text, lead = key.decode().lower() if key.isascii() else key.decode(), 0
        if self.spaced and text[lead:].isalpha() and text.isascii():
            return "\u0120" + text[1:] if lead else text
        core = text[lead:].rstrip(PUNCTUATION)
        if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
            end = lead + len(core)
            if end < len(text):
                return (text[:end], text[end:]) if self.spaced else (text[:end].encode(), text[end:].encode())
            return self._mapped(text if self.spaced else text.lower())
        if self.spaced and key[0] in "\n\t" and len(key) > 1 and not key[1].isspace():
            return key[0], key[1:]
        return None

    def _mapped(self, text: str) -> str:
        """As the byte-level vocabulary spells it."""
        return text if text.isascii() and text.isalpha() else "".join(map(_SPELLED.__getitem__, text.encode()))

    def _make(self, key, memo: Memo, leaf):
        parts = self._parts(key)
        if parts is None:
            return leaf(self._whole(key if self.spaced else key.decode()))
        if isinstance(parts, str):
            return leaf([t.id for t in self.model.tokenize(parts)])
        return memo[parts[0]] + memo[parts[1]]

    def _encode(self, key) -> bytes:
        return self._make(key, self._ids, lambda ids: array(self.code, ids).tobytes())

    def _count(self, key) -> int:
        return self._make(key, self._counts, len)

    def pre_tokens(self, text: bytes) -> list | None:
        """Those of a text, in order; None if it must be encoded whole."""
        if not self.spaced:
            return text.split()
        text = text.decode()
        if (not text.isascii() or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text) and _OTHER_SPACE.search(text):
            return None
        return _SPACED.findall(text)

    def ids(self, text: bytes) -> bytes:
        """Its ids, as unsigned integers of the width."""
        return b"".join(map(self._ids_of, stretches(text)))

    def _ids_of(self, text: bytes) -> bytes:
        found = self.pre_tokens(text)
        return b"".join(map(self._ids.__getitem__, found)) if found is not None else array(self.code, self._whole(text.decode())).tobytes()

    def count(self, text: bytes) -> int:
        """How many ids it has: each distinct pre-token's pieces times its frequency here; no ids are made."""
        return sum(map(self._count_of, stretches(text)))

    def _count_of(self, text: bytes) -> int:
        found = self.pre_tokens(text)
        if found is None:
            return len(self._whole(text.decode()))
        pieces = self._counts
        return sum(n * pieces[word] for word, n in Counter(found).items())


def pieces(path: str, width: int = 4, remember: int = PRE_TOKEN_BYTES) -> Pieces:
    """A worker keeps what it has loaded, and what it remembers, for tasks of arrow(..., keep=(path, width, remember))."""
    return held((path, width, remember), lambda: Pieces(path, width, remember))


def id_width(path: str, *more_ids: int) -> int:
    """2 if all ids of the vocabulary, and those named, fit in 16 bits, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(*Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), *more_ids, 0) < 1 << 16 else 4
