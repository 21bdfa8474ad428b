"""Public tokenizer vocabularies, read from a path that is a parameter; nothing here is copied or trained."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """A tiktoken encoding of a file of base64 pieces and ranks, split by the pattern of the public byte-level vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


END_TEXT, END_ID = "<|endoftext|>", 50256


def encode(encoding, text: str) -> np.ndarray:
    """Ids as the tokenizers library gives them for byte_bpe_50k.json with add_special_tokens=False (uint32): the special
    token's string in a text is that token."""
    if END_TEXT not in text:
        return encoding.encode_to_numpy(text, disallowed_special=())
    parts = []
    for k, part in enumerate(text.split(END_TEXT)):
        if k:
            parts.append(np.array([END_ID], dtype=np.uint32))
        if part:
            parts.append(encoding.encode_to_numpy(part, disallowed_special=()))
    return np.concatenate(parts)
