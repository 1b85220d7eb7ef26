"""Byte-level BPE ids of whole texts.

The vocabulary is read from a ``tokenizers`` JSON file, which defines the
ids.  Encoding itself goes through ``tiktoken`` built from that same
vocabulary: the same merges in the same order, about four times as fast.  A
text that holds one of the file's added tokens (such as <|endoftext|>) is
encoded with the ``tokenizers`` library itself.  In every batch the ids of one
other text are compared with that library; a difference raises.
"""

from __future__ import annotations

import json

import numpy as np


def _byte_of_char() -> dict[str, int]:
    """The byte each printable stand-in character of a byte-level vocabulary means."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextEncoder:
    """``encode(texts)`` gives one little-endian uint32 byte string per text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.added = sorted(special - {""})
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("from_json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return not any(t in text for t in self.added)

    def _known(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) if t else True for t in texts]
        out = [(np.asarray(self.fast.encode_ordinary(t), dtype="<u4").tobytes() if p else self._known(t)) if t else b""
               for t, p in zip(texts, plain)]
        probe = next((i for i, t in enumerate(texts) if t and plain[i] and len(t) <= 20_000), None)
        if probe is not None and out[probe] != self._known(texts[probe]):
            raise ValueError("the fast encoder's ids differ from the tokenizer file's")
        return out
