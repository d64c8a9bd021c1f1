"""Token ids of a byte-level BPE file, many texts at a time."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the published word split of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these code points the two libraries could sort a character into different classes (letter, number, other).
WIDE = re.compile("[^\x00-ɏ]")
#: A space between two characters that are not white space: a new word starts there.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a long text that are encoded at once, up to the next cut.
PART = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in such files: itself if it is printable, else the next free one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to ids if the file is plain byte-level BPE whose ids rise with the order of its merges; else None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if (model.get("type", "BPE") != "BPE" or any(model.get(x) for x in odd) or spec.get("normalizer") is not None
            or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)):
        return None
    vocab, byte = model["vocab"], byte_alphabet()
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)) or len(merged) + 256 != len(vocab) or not all(c in byte for t in vocab for c in t):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}


class ByteTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, as the `tokenizers` library gives them without special tokens added.

    A plain file's ranks are given to `tiktoken`, which merges in the same order several times as fast. Texts with wide
    characters or added tokens, and all texts of other files, go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = plain_ranks(spec)
        self.fast = ranks and tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _fast(self, text: str) -> bytes:
        if len(text) <= PART:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + PART)
            end = cut.start() if cut else len(text)
            out.append(np.array(self.fast.encode_ordinary(text[at:end]), "<u4").tobytes())
            at = end
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if self.fast and not WIDE.search(text) and not any(a in text for a in self.added):
                out.append(self._fast(text))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)
