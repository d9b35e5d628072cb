"""Public tokenizers, loaded once a process from a vocabulary file given by path."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files; override with ``SIMDEX_TOKENIZERS`` or a path parameter.
TOKENIZERS = os.environ.get("SIMDEX_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

#: Pre-tokenisation: contractions, words, numbers, punctuation and white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str = BYTE_BPE):
    """A byte-level BPE encoder without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
