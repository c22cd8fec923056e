"""A byte-pair vocabulary file of the tokenizers library, as tables.

Only its parts are used here: vocabulary, merges, normaliser, pre-tokenizer and
special strings.  The merging itself is done by the operators.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one file.

    merge_of: {(left id, right id): (rank, merged id)}.
    born: the rank of the merge that makes a token, -1 for symbols.
    parts: the two tokens that this merge joins (symbols: themselves).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in told["added_tokens"] if x["special"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.alphabet = byte_alphabet()
        self.shown = {b: c for c, b in self.alphabet.items()}

        self.size = max(*self.vocab.values(), *self.special.values()) + 1
        self.born = np.full(self.size, -1, np.int64)
        self.parts = np.stack([np.arange(self.size)] * 2, 1)
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.vocab[a], self.vocab[b]
            made = self.vocab[a.removesuffix(self.end) + b if self.end else a + b]
            if (left, right) not in self.merge_of:
                self.merge_of[left, right] = (rank, made)
            if self.born[made] < 0:
                self.born[made], self.parts[made] = rank, (left, right)
        keys = np.array([a * self.size + b for a, b in self.merge_of], np.int64)
        order = np.argsort(keys)
        self.pair_key = keys[order]
        self.pair_rank, self.pair_made = np.array([*self.merge_of.values()], np.int64)[order].T

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        out = [b""] * self.size
        for token, i in self.vocab.items():
            out[i] = bytes(self.alphabet[c] for c in token.removesuffix(self.end) if c in self.alphabet)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out

    def symbols(self, piece: str) -> list[int]:
        """Ids of a pre-tokenized piece's characters, the last with the word end."""
        if not piece:
            return []
        return [*(self.vocab[c] for c in piece[:-1]), self.vocab[piece[-1] + self.end]]

    def pieces(self, text: str) -> list[str | int]:
        """Special strings as ids, the rest normalised and pre-tokenized."""
        out: list[str | int] = []
        at = 0
        for m in [*self.special_re.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                if self.normalizer:
                    part = self.normalizer.normalize_str(part)
                out += [p for p, _ in self.pre_tokenizer.pre_tokenize_str(part)]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """One copy for each Python process."""
    return Vocabulary(path)
