"""Encoding of whole texts with public tokenizers, inside tasks.

A tokenizer file holds ranks of byte strings and a rule that splits a text before any merge. Two kinds of
file are encoded by tiktoken's merge loop over the file's own ranks, which gives the same ids as the
tokenizers library at a quarter of the time and without tables that grow:

* byte-level files that split by the usual pattern: the text as it is;
* files with a word-end suffix: the text is lower-cased and split, and each piece ends in a mark, a byte that
  texts don't hold, so that a last byte with the mark is the file's symbol with the suffix.

Whatever the two could see differently goes to the tokenizers library itself: other files, texts with
strings of special tokens, the mark, very long runs of white space, and (word-end files) letters on which
versions of Unicode differ. Tests compare ids for every code point and for random strings.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

TOKENIZER = "word_bpe_49k.json"
_ENCODERS: dict[str, TextEncoder] = {}

MARK = "\x01"
#: White space beyond this length goes to the tokenizers library: a pattern that looks ahead would keep a stack of it.
LONG_RUN = 10_000
#: Characters that every version splits alike: up to Cyrillic, general punctuation, kana, and the ideographs and syllables of East Asia.
_UNSETTLED = re.compile("[^\x00\x02-՗‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]")
#: Lower-casing one by one, or composition, may differ from ``str.lower`` from here on.
_NORMALISED = re.compile("[İ̀-\U0010ffff]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others, in order, are the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """Ids of whole texts by one tokenizer file; null texts are empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._merger(json.loads(self.tokenizer.to_str()))

    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _merger(self, spec: dict):
        """A function from texts to ids for the two kinds of file, or nothing."""
        import tiktoken

        model, before, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix"):
            return None
        suffix, byte_of = model.get("end_of_word_suffix") or "", _byte_of()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {}
        for token, rank in model["vocab"].items():
            if token in special:
                continue
            last = bool(suffix) and token.endswith(suffix)
            body = token[:len(token) - len(suffix)] if last else token
            if not set(body) <= byte_of.keys():
                return None
            ranks[bytes(map(byte_of.__getitem__, body)) + (MARK.encode() if last else b"")] = rank
        if len(ranks) != len(set(model["vocab"]) - special) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        if not suffix and normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            import public_tokenizers

            return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        steps = [n.get("type") for n in (normal or {}).get("normalizers", [])]
        splits = before.get("pretokenizers", [])
        if suffix and steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["invert"]:
            import regex

            find = regex.compile(splits[0]["pattern"]["Regex"]).findall
            merge = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            def words(text: str) -> list[int] | None:
                if _UNSETTLED.search(text):
                    return None
                low = self.tokenizer.normalizer.normalize_str(text) if _NORMALISED.search(text) else text.lower()
                return merge(MARK.join([*find(low), ""]))

            return words
        return None

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is not None and not any(s in text for s in self.special) and not (len(text) > LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text)):
            found = self.fast(text)
            if found is not None:
                return found
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        return np.fromiter((len(self.ids(t)) for t in column.to_pylist()), np.int64, len(column))

    def encode(self, column: pa.Array, end_id: int | None = None, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by ``end_id`` if that is given, and where each text begins
        (one more than texts)."""
        flat: list[int] = []
        cuts = [0]
        for text in column.to_pylist():
            flat += self.ids(text)
            if end_id is not None:
                flat.append(end_id)
            cuts.append(len(flat))
        return np.array(flat, kind), np.array(cuts, np.int64)


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
