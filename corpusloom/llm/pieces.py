"""SentencePiece encoding that keeps byte offsets.

The text is normalised here, by the longest prefix that the model's compiled character map holds at each place, and every
byte of the result remembers the span of the text it came from. The library gives the ids; the pieces are then laid along
the normalised text, which projects each to a span of bytes of the original. Where the pieces do not spell this
normalisation exactly, the spans are null. Bytes that are no UTF-8 are replaced once, before all else: ids and spans are
those of the replaced text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.common import per_text

META = "▁".encode()
#: Words whose ids a Python worker remembers; then it starts anew.
REMEMBERED = 200_000
#: A space between two characters other than spaces and U+2581, which is the same symbol to the model.
CUT = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
ODD = re.compile("^ | $|  | ▁|▁ ")
CONTROL_TYPE, BYTE_TYPE, UNKNOWN_TYPE, USER_TYPE, BPE_MODEL = 3, 6, 2, 4, 2


class CharMap:
    """The compiled character map: a double-array trie over byte strings, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    @staticmethod
    def _onward(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest entry that starts at this byte."""
        found, node = None, self._onward(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._onward(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, text = found
        return length, self.texts[text : self.texts.index(b"\0", text)]


def char_bytes(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """What the model's settings make of a text, with a span of the text for each byte of the result."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = META if self.escape else b" "

    def steps(self, data: bytes):
        """(replacement, start, end) from left to right, by the longest prefix; a character without an entry stays."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            size = hit[0] if hit else char_bytes(data[at])
            yield hit[1] if hit else data[at : at + size], at, at + size
            at += size

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised, start of the source span of each byte, its end)."""
        if not self.map.units and not self.squeeze:
            return self._plain(data)
        rows: list[tuple[bytes, int, int]] = []
        for text, start, end in self.steps(data):
            for i in range(len(text)):
                c = text[i : i + 1]
                if c == b" " and self.squeeze and (not rows or rows[-1][0] == self.space):
                    continue
                rows.append((self.space if c == b" " else c, start, end))
        while self.squeeze and rows and rows[-1][0] == self.space:
            rows.pop()
        if self.prefix and rows:
            rows.insert(0, (self.space, rows[0][1], rows[0][1]))
        sizes = [len(r[0]) for r in rows]
        return b"".join(r[0] for r in rows), np.repeat([r[1] for r in rows], sizes).astype(np.int64), np.repeat([r[2] for r in rows], sizes).astype(np.int64)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """No character map and no squeezing: only spaces change, and a character is its own span."""
        if not data:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(raw)]))
        start, end = lead[chars], np.r_[lead[1:], len(raw)][chars]
        size = np.where(raw == 0x20, len(self.space), 1)
        start, end = np.repeat(start, size), np.repeat(end, size)
        norm = data.replace(b" ", self.space)
        if self.prefix:
            pad = np.zeros(len(self.space), np.int64)
            norm, start, end = self.space + norm, np.r_[pad, start], np.r_[pad, end]
        return norm, start.astype(np.int64), end.astype(np.int64)


class PieceCoder:
    """A model file: ids by the library, spans by the normaliser.

    Where no piece of a BPE model runs across the start of a word, words are encoded one by one and remembered, which gives the
    same ids as the whole text.
    """

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        if proto is None:
            with open(path, "rb") as file:
                proto = file.read()
        self.model = model_pb2.ModelProto()
        self.model.ParseFromString(proto)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = self.model.normalizer_spec
        self.normalise = Normaliser(spec)
        self.unknown = {i for i, p in enumerate(self.model.pieces) if p.type == UNKNOWN_TYPE}
        self.sizes = np.array([1 if p.type == BYTE_TYPE else 0 if p.type == CONTROL_TYPE else len(p.piece.encode()) for p in self.model.pieces], np.int64)
        inner = any(META.decode() in p.piece.lstrip(META.decode()) for p in self.model.pieces)
        self.by_word = (self.model.trainer_spec.model_type == BPE_MODEL and not spec.precompiled_charsmap and spec.add_dummy_prefix
                        and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not inner
                        and not any(p.type == USER_TYPE for p in self.model.pieces))
        self.known: dict[str, tuple[list[int], str]] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [[i for w in ws for i in w[0]] for ws in self._words(texts)] if self.by_word else self.library.encode(texts, num_threads=1)

    def _words(self, texts: list[str]) -> list[list[tuple[list[int], str]]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [[] if not t else t.split(" ") if not ODD.search(t) else CUT.split(t) for t in texts]
        new = list({w for ws in split for w in ws} - self.known.keys())
        for w, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            self.known[w] = ids, ",".join(map(str, ids))
        return [list(map(self.known.__getitem__, ws)) for ws in split]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and the same as decimals joined by commas."""
        if not self.by_word:
            return [(ids, ",".join(map(str, ids))) for ids in self.library.encode(texts, num_threads=1)]
        return [([i for w in ws for i in w[0]], ",".join([w[1] for w in ws])) for ws in self._words(texts)]

    def spans(self, text: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Start and end, in bytes of the text, of what each piece stands for; None where the pieces do not spell the normalised text.

        ``text`` is what was encoded, as valid UTF-8.
        """
        norm, start, end = self.normalise(text)
        if self.unknown.isdisjoint(ids):
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
        else:  # an unknown piece spells whatever stood there
            pieces = self.library.encode(text.decode("utf-8", "replace"), out_type=str)
            sizes = np.array([1 if self.model.pieces[i].type == BYTE_TYPE else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], np.int64)
        after = np.cumsum(sizes)
        if (after[-1] if len(after) else 0) != len(norm):
            return None
        return start[after - sizes], end[after - 1]


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def encode_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, starts, ends)``: each piece's id and the bytes of the text it stands for.

    A null text is empty and has no ids. Malformed bytes count as U+FFFD, three bytes each in the spans.
    """
    def work(texts: list[bytes]) -> dict:
        c = coder(path)
        valid = [t.decode("utf-8", "replace") for t in texts]
        ids = c.ids(valid)
        spans = [c.spans(t.encode(), i) or (None, None) for t, i in zip(valid, ids, strict=True)]
        return {"ids": ids, "starts": [s for s, _ in spans], "ends": [e for _, e in spans]}

    return per_text(docs, [id], text, dict.fromkeys(("ids", "starts", "ends"), "array<long>"), work).withColumnRenamed(id, "doc_id")


def round_trip_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, spanned_bytes)`` per row; the ids and texts stay in the task.

    ``spanned_bytes`` counts the bytes of the text that lie in the span of a piece, null without spans. A null text is empty and
    has no ids. Malformed bytes count as U+FFFD.
    """
    def work(texts: list[bytes]) -> dict:
        c = coder(path)
        valid = [t.decode("utf-8", "replace") for t in texts]
        coded = c.encode(valid)
        decoded = c.library.decode([ids for ids, _ in coded], num_threads=1)
        spanned = []
        for t, (ids, _) in zip(valid, coded, strict=True):
            found = c.spans(t.encode(), ids)
            if found is None:
                spanned.append(None)
                continue
            start, end = found
            # spans come in order and may meet in one character, whose bytes count once
            before = np.r_[0, np.maximum.accumulate(end)[:-1]] if len(end) else end
            spanned.append(int(np.maximum(end - np.maximum(start, before), 0).sum()))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return {"n_tokens": [len(ids) for ids, _ in coded], "ids_sha256": [sha(s) for _, s in coded],
                "decoded_sha256": [sha(s) for s in decoded], "spanned_bytes": spanned}

    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "spanned_bytes": "long"}
    return per_text(docs, [id], text, fields, work).withColumnRenamed(id, "doc_id")
