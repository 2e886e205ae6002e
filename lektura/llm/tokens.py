"""Token ids of whole texts by a public tokenizer, for use inside tasks."""

from __future__ import annotations

import base64
import os

import numpy as np

#: The one special token of the vocabulary; a text that holds its string is left to the library that knows it.
SPECIAL = "<|endoftext|>"
_LOADED: dict[tuple[str | None, str | None], ByteBpe] = {}


def byte_bpe(path: str | None = None, ranks: str | None = None) -> ByteBpe:
    """The encoder, loaded once in each Python worker. ``path``: a tokenizers file, by default the public
    byte_bpe_50k.json; ``ranks``: the same vocabulary as ranks."""
    if (path, ranks) not in _LOADED:
        import public_tokenizers

        _LOADED[path, ranks] = ByteBpe(path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _LOADED[path, ranks]


class ByteBpe:
    """A byte-level BPE. tiktoken gives the same ids from the same vocabulary in a quarter of the CPU time; tests hold
    them equal to those of tokenizers, whose file is used for texts with the special token's string."""

    def __init__(self, path: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The text's ids as unsigned 32-bit numbers."""
        if SPECIAL in text:
            if self.tokenizer is None:  # most corpora never need it
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")
