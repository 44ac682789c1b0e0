"""Byte-level BPE ids, as the `tokenizers` library gives them for a vocabulary file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

PROBE = "Prüfung: it's 3 words,\n\n  two\tlines… \U0001f600 'll 12345 end  "


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text): numpy uint32. The file is read by `tokenizers`, whose ids are the definition.

    Where the file is plain byte-level BPE, its merges are also loaded into `tiktoken`, which gives the same ids at
    five times the speed; a probe compares both, and texts that hold an added token's string always take the first.
    """

    def __init__(self, path: str):
        self.path, self._exact = path, None
        self.fast, spec = None, json.load(open(path, encoding="utf-8"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.fast = self._fast(spec)
            if self.fast.encode_ordinary(PROBE) != self.exact.encode(PROBE, add_special_tokens=False).ids:
                self.fast = None
            self._exact = None  # a worker seldom needs it again, and keeps its memory

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def _fast(self, spec: dict):
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(4)
def encoder(path: str | None = None) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path or vocabulary())
