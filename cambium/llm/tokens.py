"""Public tokenizers by the path of their vocabulary file. Nothing is trained and nothing is copied."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the byte-level vocabulary above.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class ByteTokenizer:
    """A byte-level tokenizer: its tokens' bytes joined are the text's bytes."""

    encoding: object
    sizes: np.ndarray  # bytes of each token

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()))

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@lru_cache(maxsize=4)
def tokenizer(path: str = DEFAULT_VOCABULARY) -> ByteTokenizer:
    """Loaded once per worker process."""
    import tiktoken

    with open(path, encoding="ascii") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return ByteTokenizer(tiktoken.Encoding(path, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)


STEP = 200_000  # characters encoded at once


def pieces(text: str) -> list[str]:
    """The text in steps that end at line ends where a letter follows, so that a very long text is encoded piece by
    piece with the same tokens as at once."""
    out, at = [], 0
    while len(text) - at > STEP:
        cut = text.rfind("\n", at, at + STEP)
        while cut > at and not (cut + 1 < len(text) and text[cut + 1].isalpha() and text[cut - 1].isalnum()):
            cut = text.rfind("\n", at, cut)
        if cut <= at:
            cut = text.rfind(" ", at + 1, at + STEP)
            while cut > at and not (text[cut - 1].isalnum() and text[cut + 1].isalnum()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break
        else:
            cut += 1
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out
