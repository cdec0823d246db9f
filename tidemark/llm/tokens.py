"""Token ids of a tokenizer file, the fast way where it is sure to give the same ids."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# The split of byte-level BPE, and the characters that stand for bytes in its vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(_HIDDEN)}

#: Bytes of characters from U+0280 on, and control characters: libraries may class these by different Unicode versions.
_ODD = np.zeros(256, bool)
_ODD[0xCA:] = True
_ODD[[*range(0x09), *range(0x0B, 0x0D), *range(0x0E, 0x20), 0x7F]] = True


class Encoder:
    """ids of texts as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    Files of plain byte-level BPE whose merges make the ids in order are run as ranks, several times as fast; texts with
    characters beyond the Latin blocks, and all other files, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ranks = self._as_ranks(spec)

    @staticmethod
    def _as_ranks(spec: dict) -> tiktoken.Encoding | None:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec.get("added_tokens", [])
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added):
            return None
        special = {t["content"]: t["id"] for t in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(BYTE_OF[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        if len(ranks) != 256 + len(pairs):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        if self.ranks is None or _ODD[data].any():
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)
