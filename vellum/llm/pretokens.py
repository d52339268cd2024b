"""Byte-level vocabularies: the split pattern, the byte alphabet and the files of public tokenizers."""

from __future__ import annotations

import base64
import json

import public_tokenizers
import regex

#: Entries that a worker keeps of each memo; a full memo is emptied, which costs time and no result.
MEMO_ENTRIES = 300_000


def vocabulary(name: str) -> str:
    """Default path of a vocabulary file; every operator takes another path instead."""
    return public_tokenizers.path(name)


def splitter(pattern: str | None = None):
    """``findall`` of the pre-token pattern."""
    return regex.compile(pattern or public_tokenizers.PATTERN).findall


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level .json vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class JsonVocabulary:
    """Bytes, merges and special strings of a byte-level BPE ``.json`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_ids = [self.ids[c] for c in byte_alphabet()]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def segments(self, text: str) -> list[str]:
        """Ordinary stretches (even places) and special strings (odd places) of a text."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text]
        return self.cut(text)

    def ranks(self) -> dict[bytes, int]:
        """Bytes of each ordinary token with its id, in merge order."""
        back = {c: b for b, c in enumerate(byte_alphabet())}
        made = [self.ids[a + b] for a, b in self.merges]
        if made != sorted(made) or max(self.byte_ids) > made[0]:
            raise ValueError("the ids of this vocabulary don't follow the order of its merges")
        return {bytes(back[c] for c in t): i for t, i in self.ids.items() if t not in self.special}


def rank_file(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
