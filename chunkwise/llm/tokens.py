"""Token ids of texts, encoded with a given tokenizer file.

A tokenizer file fixes the ids. Where the same vocabulary also exists as a table of
ranks, texts are encoded through the faster byte-pair encoder over that table; texts
that hold the string of a special token, and texts that encoder refuses, go through
the tokenizer itself, so the ids are the tokenizer's in every case.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_loaded: dict[TokenizerFile, Callable[[str], np.ndarray]] = {}


@dataclass(frozen=True)
class TokenizerFile:
    """``path``: a file of the tokenizers library. ``ranks`` and ``pattern``: the same
    vocabulary as base64 ranks and its word pattern, both or neither."""

    path: str
    ranks: str | None = None
    pattern: str | None = None


def public_byte_bpe() -> TokenizerFile:
    import public_tokenizers as p

    return TokenizerFile(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def encoder(file: TokenizerFile) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32). Loaded once per process."""
    if file not in _loaded:
        _loaded[file] = _load(file)
    return _loaded[file]


def _load(file: TokenizerFile) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(file.path)

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if not (file.ranks and file.pattern):
        return slow
    import tiktoken

    with open(file.ranks, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("file", pat_str=file.pattern, mergeable_ranks=ranks, special_tokens={})
    with open(file.path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        except Exception:  # its pattern engine gives up on some very long runs
            return slow(text)

    return encode
