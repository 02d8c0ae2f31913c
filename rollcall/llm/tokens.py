"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools

import numpy as np

END_OF_TEXT = "<|endoftext|>"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine; the files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def fast_encoder(path: str):
    """The same vocabulary as merge ranks, which encode several times faster; None where no ranks lie beside `path`.

    Ranks and vocabulary give the same ids (tested, special token included). The special token's string is its id in
    both, as it is by default in the `tokenizers` library.
    """
    import os

    import public_tokenizers
    import tiktoken

    ranks_path = f"{os.path.splitext(path)[0]}.tiktoken"
    if not os.path.exists(ranks_path):
        return None
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: 50256})


@functools.lru_cache(maxsize=2)
def plain_tokenizer(path: str):
    """A tokenizer of its own that takes the strings of special tokens as ordinary text."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def encode(text: str, path: str, special: bool = True) -> np.ndarray:
    """Token ids of a whole text, without added special tokens.

    The string of a special token is that token's id, or with special=False ordinary text. Texts with very long runs of
    white space (from 999,999 characters) are more than the fast encoder's pattern can match; the vocabulary file's own
    library encodes those.
    """
    fast = fast_encoder(path)
    if fast is not None:
        try:
            return np.array(fast.encode(text, allowed_special="all") if special else fast.encode(text, disallowed_special=()), dtype=np.uint32)
        except ValueError:
            pass
    return np.array((tokenizer if special else plain_tokenizer)(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
