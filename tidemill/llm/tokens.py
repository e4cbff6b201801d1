"""Byte-level BPE encoding from the public vocabulary files."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

#: The split pattern that belongs to the byte_bpe_50k vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """The encoder for a rank file, kept for the life of the Python worker.

    It gives the same ids as the JSON form of the same vocabulary, about five
    times as fast; tests/llm/test_text_ops.py holds the two against each other.
    """
    import tiktoken

    path = path or vocabulary_path()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def added_tokens(path: str) -> dict[str, int]:
    """Tokens beside the ranks, by the JSON form that lies next to a rank file; none without one."""
    form = f"{os.path.splitext(path)[0]}.json"
    if not os.path.exists(form):
        return {}
    with open(form, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


#: White space on end beyond which the pattern's look-ahead may exhaust its stack.
LONG_RUN = 4_096
_run = re.compile(rf"\s{{{LONG_RUN}}}")


@functools.lru_cache(maxsize=4)
def plain_encoder(path: str | None = None, ordinary: bool = False):
    """The JSON form of the vocabulary, slower, for texts that the other encoder cannot split."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{os.path.splitext(path or vocabulary_path())[0]}.json")
    made.encode_special_tokens = ordinary
    return made


def encode(text: str, path: str | None = None, *, ordinary: bool = False) -> list[int]:
    """Ids of a text: added tokens wherever their string stands, and the parts between them on their own.

    With ordinary, such strings are text like any other. Texts with long runs of white space go
    through the JSON form, which gives the same ids.
    """
    if len(text) >= LONG_RUN and _run.search(text):
        return plain_encoder(path, ordinary).encode(text, add_special_tokens=False).ids
    return encoder(path).encode_ordinary(text) if ordinary else encoder(path).encode(text, allowed_special="all")
