"""Token ids as the library has them, by the faster of two libraries where both are the same."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from gridseek.llm.tokencount import byte_alphabet

#: The library's own pattern for byte-level vocabularies (a fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside these ranges go the library's own way: the two have Unicode tables of different ages.
_PLAIN = re.compile("[\\x00-ɏͰ-ͳΑ-ΡΣ-ωА-я‐-…ぁ-ゖァ-ヺ一-龥가-힣]*")
#: In longer runs of white space the second library's pattern matcher goes back too often, and at last too deep.
LONG_RUN = 1000
_LONG_WHITE = re.compile(r"\s{%d}" % LONG_RUN)


class Encoder:
    """ids of texts. A byte-level vocabulary whose ids follow its merges is read as ranks; any other is left to the
    library, and so are texts with special strings, rarer scripts or very long runs of white space."""

    def __init__(self, path: str):
        self.path, self.ranks, self._library = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"] for x in spec.get("added_tokens", [])}
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            return
        letters, vocab = byte_alphabet(), {k: v for k, v in model["vocab"].items() if k not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return
        import tiktoken

        self.ranks = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(letters[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    @property
    def library(self):
        """The library's own tokenizer, loaded for the first text that needs it."""
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special) or len(text) > LONG_RUN and _LONG_WHITE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranks.encode_ordinary(text), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
