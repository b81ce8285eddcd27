"""Public tokenizer vocabularies, named by path; loaded once per Python worker."""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken


def path_of(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tiktoken_encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(encoding) -> bytes:
    """Ids of a tokenizers encoding as little-endian unsigned 32-bit numbers."""
    ids = array("I", encoding.ids)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def joined_ids(words: pa.Array, ids_of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Packed ids of texts given as lists of words; `ids_of` is asked for the distinct words only."""
    coded = words.flatten().dictionary_encode()
    ids = ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    place = coded.indices.to_numpy()
    each = sizes[place]
    ends = np.concatenate(([0], np.cumsum(each)))
    begins = (np.cumsum(sizes) - sizes)[place]
    flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begins - ends[:-1], each) + np.arange(ends[-1])]
    borders = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
    return [flat[i:j].tobytes() for i, j in zip(borders, borders[1:], strict=False)]
