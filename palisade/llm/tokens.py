"""Token ids of whole texts inside Arrow batches."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: The splitting pattern without its look-ahead; the same where no two white spaces meet.
_NO_LOOKAHEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Beyond these characters, or with a special token in the text, the tokenizers library has the word.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-ɏ]|<\\|endoftext\\|>")
_MEETING = re.compile(r"\s\s")


class Encoder:
    """ids of the byte-level BPE vocabulary, as ``tokenizers`` gives them without added special tokens.

    Plain Latin text goes through the same vocabulary in tiktoken, which is several times faster.
    """

    def __init__(self, tokenizer: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer)
        self.plain = self.spaced = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=known, special_tokens={})
            self.plain, self.spaced = make("plain", _NO_LOOKAHEAD), make("spaced", public_tokenizers.PATTERN)

    def ids(self, text: str) -> np.ndarray:
        if self.plain is None or _UNUSUAL.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        encoder = self.spaced if _MEETING.search(text) else self.plain
        return np.array(encoder.encode_ordinary(text), "<u4")


@lru_cache(2)
def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder per Python worker. Without paths: the public files on that machine."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    return Encoder(str(tokenizer), None if ranks is None else str(ranks))
