"""Where the public vocabulary files are; they are read, never copied."""
from __future__ import annotations


def path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
