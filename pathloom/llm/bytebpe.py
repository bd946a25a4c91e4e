"""Byte-level BPE ids, as the tokenizers library gives them for a vocabulary file, by a faster library of equal results."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: The pattern that this vocabulary format splits text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """tiktoken runs the merges by rank. It stops at some extreme texts (millions of spaces); those go to the tokenizers
    library itself. The tests hold both against each other, all code points included."""

    def __init__(self, path: str):
        import tiktoken

        from pathloom.llm.bpe import byte_chars

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE vocabulary without a prefix space")
        vocab = model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("ids must rise with the rank of their merge")
        byte = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None, special: bool = True) -> np.ndarray:
        """ids as uint32. special: the special tokens' strings in a text are these tokens, else ordinary text."""
        if not text:
            return np.empty(0, np.uint32)
        try:
            if special:
                return self.encoding.encode_to_numpy(text, allowed_special="all")
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            library = self._library(special)
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    @lru_cache(2)  # noqa: B019  one object for each worker
    def _library(self, special: bool):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = not special
        return library


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path)
