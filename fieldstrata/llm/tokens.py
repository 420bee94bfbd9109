"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64

import numpy as np

#: The text of the vocabulary's one special token (fixed value).
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of whole texts, without special tokens added. The merge ranks do it for all texts but those that spell the
    special token, which only the tokenizer file knows."""

    def __init__(self, tokenizer_json: str, ranks_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.special = Tokenizer.from_file(tokenizer_json)
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids as uint16 (the vocabulary has under 65,536 entries)."""
        if not text:
            return np.empty(0, np.uint16)
        if SPECIAL in text:
            return np.array(self.special.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.array(self.ranked.encode_ordinary(text), np.uint16)


def default_encoder() -> Encoder:
    import public_tokenizers as P

    return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
