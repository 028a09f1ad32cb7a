"""Token ids of whole texts, as little-endian 32-bit bytes, with a bounded memory of words.

The tokenizer lower-cases, drops white space and never lets a token cross it, so a text's ids are its words' ids in a
row.  Words of plain Latin letters, digits and ASCII marks are split by the tokenizer's own pattern here and only their
unseen parts go through its merges; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The vocabulary file's pattern, for texts of PLAIN letters only.
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
PLAIN = re.compile(rf"[!-~{LETTERS}]+")
WORDS = 600_000
WORD_END = "</w>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by one vocabulary file.

    Remembers at least the last ``words`` / 2 words and parts of words, and at most ``words`` of each.
    """

    def __init__(self, path: str | None = None, words: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or default_path())
        self.whole.model._resize_cache(0)  # what repeats is remembered here
        self.merges = Tokenizer(self.whole.model)
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        letters = byte_letters()
        self.letters = {chr(b): letters[b] for b in range(256)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.limit = words // 2

    def _split(self, word: str) -> list[str] | None:
        if not PLAIN.fullmatch(word) or "<|" in word:
            return None
        return [word.lower()] if word.isalpha() else PARTS.findall(word.lower())

    def _merge(self, parts: list[str]) -> None:
        """Run the merges over parts that aren't known yet; each part's last token is one that ends a word."""
        mapped = [p if p.isascii() else "".join([self.letters[chr(b)] for b in p.encode()]) for p in parts]
        ids = np.array(self.merges.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        edge = (4 * np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])).tolist()
        blob = ids.tobytes()
        self.parts.update(zip(parts, [blob[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], strict=True))

    def _learn(self, words: set[bytes]) -> None:
        if len(self.words) > self.limit:
            self.words, self.old_words = {}, self.words
        if len(self.parts) > self.limit:
            self.parts, self.old_parts = {}, self.parts
        split: dict[bytes, list[str]] = {}
        new: dict[str, None] = {}
        for w in words:
            if (known := self.old_words.get(w)) is not None:
                self.words[w] = known
                continue
            text = w.decode("utf-8", "surrogatepass")
            parts = self._split(text)
            if parts is None:
                self.words[w] = packed(self.whole.encode(text, add_special_tokens=False).ids)
                continue
            split[w] = parts
            for p in parts:
                if p not in self.parts:
                    if (known := self.old_parts.get(p)) is not None:
                        self.parts[p] = known
                    else:
                        new[p] = None
        if new:
            self._merge(list(new))
        own = self.parts
        for w, parts in split.items():
            self.words[w] = own[parts[0]] if len(parts) == 1 else b"".join([own[p] for p in parts])

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        found = list(map(self.words.get, words))
        if None in found:
            self._learn({w for w, x in zip(words, found, strict=True) if x is None})
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.words[words[i]]
        return b"".join(found)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder: what it has learned lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
