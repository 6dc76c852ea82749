"""Token ids of whole texts, as the tokenizers library gives them for a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Letters, marks, signs and spaces on which the pre-tokenizers of both libraries agree (long-settled Unicode blocks).
#: Anything else goes through the tokenizers library itself.
_SETTLED = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")


@lru_cache(maxsize=2)
def _reference(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = "byte_bpe_50k") -> dict[str, str | None]:
    """Paths of a vocabulary file and of its rank file: the default parameters of encode()."""
    import public_tokenizers

    return {"vocab": public_tokenizers.path(f"{name}.json"), "ranks": public_tokenizers.path(f"{name}.tiktoken")}


def encode(text: str, vocab: str, ranks: str | None = None) -> np.ndarray:
    """uint32 ids, without special tokens added. With a rank file of the same vocabulary, texts of settled characters
    and without special-token strings take the faster of two engines; the ids are the same (tested)."""
    if ranks and "<|" not in text and (text.isascii() or _SETTLED.fullmatch(text)):
        return _ranks(ranks).encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
    return np.array(_reference(vocab).encode(text, add_special_tokens=False).ids, np.uint32)
