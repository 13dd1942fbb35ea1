"""Token ids of a public byte-level BPE: ``tiktoken`` over the ranks of the vocabulary file.

Added tokens (such as <|endoftext|>) are those of the JSON file beside the ranks and get their ids wherever they stand in a
text. Null text is empty and has no ids; a text of any length is encoded whole; equal texts have equal ids. ``tests/llm``
holds the ids against the ``tokenizers`` library. The vocabulary files stay where they are installed; their path is a
parameter. One encoder per worker process and vocabulary; it keeps no table of texts, so its memory doesn't grow.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
_encoders: dict[str, "Encoder"] = {}


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens by their strings, from the ``tokenizers`` file of the same name; none where there is no such file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    for x in tokens:
        if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
            raise ValueError(f"an added token that isn't matched as it stands: {x['content']}")
    return {x["content"]: x["id"] for x in tokens}


class Encoder:
    """The strings of ``added`` in a text stand for their ids; any others are ordinary text."""

    def __init__(self, path: str, pattern: str | None = None, added: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids as unsigned 32-bit integers."""
        return self.encoding.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()).astype("<u4", copy=False)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary, with the vocabulary's added tokens."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=added_tokens(path))
    return _encoders[path]
