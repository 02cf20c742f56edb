"""Encoders of the public tokenizer files, one per Python worker."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np


def default_vocabulary() -> str:
    """The 50k byte-level vocabulary in the form that encodes fastest; byte_bpe_50k.json holds the same vocabulary and gives the same ids (tests/llm/test_tokens.py)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32), without special tokens: their strings in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        plain = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: plain.encode_to_numpy(text, disallowed_special=())
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda text: np.array(model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: np.array(pieces.encode(text, num_threads=1), dtype=np.uint32)
