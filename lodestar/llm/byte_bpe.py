"""Ids of a byte-level BPE vocabulary, word by word, with every distinct word of a batch encoded once.

The pre-tokeniser of these vocabularies lets no piece reach across a space that a non-space follows, so a text
may be cut before every such space. Texts with a space before other white space are encoded as they are.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cache

import numpy as np

#: Distinct words whose ids a worker keeps (some 10 MB); then it starts anew.
KEPT_WORDS = 50_000

_SPACE_THEN_SPACE = re.compile(r" \s")


class WordIds(dict):
    """Little-endian unsigned 32-bit ids, as bytes, of a space and the word that is the key.

    ``added_path``, a JSON model of the tokenizers library, names added tokens: where their text stands in a text it
    is their id, and the text on both sides is encoded apart, as that library does.
    """

    def __init__(self, ranks_path: str, added_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[rank for piece, rank in ranks.items() if piece[:1] == b" "]] = True
        self.added: dict[str, bytes] = {}
        if added_path:
            with open(added_path, encoding="utf-8") as model:
                listed = json.load(model).get("added_tokens") or []
            self.added = {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in listed}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not known yet, in one text; a piece that begins with a space begins a word."""
        if len(self) > KEPT_WORDS:
            self.clear()
        new = list(words.difference(self))
        if not new:
            return
        ids = np.array(self.coder.encode_ordinary(" " + " ".join(new)), "<u4")
        begins = np.flatnonzero(self.opens[ids]).tolist()
        raw = ids.tobytes()
        stops = [*begins[1:], len(ids)]
        self.update((word, raw[4 * a : 4 * b]) for word, a, b in zip(new, begins, stops, strict=True))

    def plain(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; added tokens are their ids."""
        if self.splitter is None:
            return self._encode(texts)
        parts = [self.splitter.split(text) for text in texts]
        # Split parts alternate: text, added token, text, ...
        ids = iter(self._encode([piece for split in parts for piece in split[::2]]))
        return [b"".join(next(ids) if k % 2 == 0 else self.added[piece] for k, piece in enumerate(split)) for split in parts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if _SPACE_THEN_SPACE.search(text) or text.endswith(" ") else text.split(" ") for text in texts]
        self.learn(set().union(*(words[1:] for words in cut if words)) - {""})
        known = self.__getitem__
        return [
            self.plain(text) if words is None else self.plain(words[0]) + b"".join(map(known, words[1:]))
            for text, words in zip(texts, cut, strict=True)
        ]


@cache
def word_ids(ranks_path: str, added_path: str | None = None) -> WordIds:
    """One per worker and vocabulary."""
    return WordIds(ranks_path, added_path)
