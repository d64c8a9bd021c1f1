"""Best-fit packing of whole documents, improved by a swap-based local search.

Only documents longer than a sequence are cut: into pieces of a whole sequence, of which the first may be shorter. What is
shorter than a sequence is packed by its length alone. The histogram of lengths has at most one count per length, and bins
with the same contents are one row with a number of bins, so the work does not grow with the documents: best fit, longest
first, puts each length into as many bins of one kind as there are, then the local search does the same with exchanges.
An exchange takes one or two documents of one underfull bin, moves them to another and takes none, one or two back (not two
for two), so that the sum of squared fills grows. The emptiest bins give first; a bin that has given everything is gone.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.byte_bpe import tokenizer
from corpusloom.llm.common import numbered, per_text
from corpusloom.llm.packing import pack_pieces

WINDOW = 1024
#: Exchanges of the local search, each for all bins of two kinds: it bounds the search on the driver, not what is packed.
EXCHANGES = 20_000

#: What a kind of bin holds: (length, how many) by falling length.
Contents = tuple[tuple[int, int], ...]


def fill(bin: Contents) -> int:
    return sum(length * n for length, n in bin)


def best_fit(counts: dict[int, int], window: int) -> dict[Contents, int]:
    """Number of bins of each kind: every document, longest first, in the fullest bin that takes it, or else in a new one."""
    free: dict[int, dict[Contents, int]] = {}
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left, filled = counts[length], []
        for room in sorted(r for r in free if r >= length):
            each = room // length  # a bin that took one is the fullest, and takes the next
            for bin, bins in list(free[room].items()):
                full = min(bins, left // each)
                filled += [(full, bin, room, each)] if full else []
                left -= full * each
                if full < bins and left:
                    filled.append((1, bin, room, left))
                    full, left = full + 1, 0
                free[room][bin] -= full
                if not free[room][bin]:
                    del free[room][bin]
                if not left:
                    break
            if not free[room]:
                del free[room]
            if not left:
                break
        each = window // length
        filled += [(left // each, (), window, each)] if left >= each else []
        filled += [(1, (), window, left % each)] if left % each else []
        for bins, bin, room, n in filled:
            kinds = free.setdefault(room - length * n, {})
            kinds[(*bin, (length, n))] = kinds.get((*bin, (length, n)), 0) + bins
    return {bin: n for kinds in free.values() for bin, n in kinds.items()}


def choices(bin: Contents) -> list[tuple[int, ...]]:
    """None, one or two documents of a bin, by their lengths."""
    lengths = [length for length, _ in bin]
    pairs = [(a, b) for i, a in enumerate(lengths) for b in lengths[i + 1 :]] + [(a, a) for a, n in bin if n > 1]
    return [(), *((a,) for a in lengths), *pairs]


def exchanged(bin: Contents, out: tuple[int, ...], into: tuple[int, ...]) -> Contents:
    held = dict(bin)
    for length in out:
        held[length] -= 1
    for length in into:
        held[length] = held.get(length, 0) + 1
    return tuple(sorted(((k, n) for k, n in held.items() if n), reverse=True))


class Search:
    """Underfull bins and the exchanges between them."""

    def __init__(self, bins: dict[Contents, int], window: int):
        self.window = window
        self.full = {b: n for b, n in bins.items() if fill(b) == window}
        self.open = {b: n for b, n in bins.items() if fill(b) < window}
        self.known: dict[Contents, tuple[list[tuple[int, ...]], np.ndarray]] = {}

    def _choices(self, bin: Contents) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """Choices of a bin, and per choice its sum, its size, and the bin's fill."""
        if bin not in self.known:
            found = choices(bin)
            self.known[bin] = found, np.array([[sum(c), len(c), fill(bin)] for c in found], np.int64)
        return self.known[bin]

    def best(self, giver: Contents, takers: list[Contents]) -> tuple[Contents, tuple[int, ...], tuple[int, ...]] | None:
        """The taker, what it takes and what it gives back, for the largest gain in squared fill; None if none gains."""
        listed = [self._choices(t) for t in takers]
        back = np.concatenate([numbers for _, numbers in listed])
        given, numbers = self._choices(giver)
        moved = numbers[1:, 0][:, None] - back[None, :, 0]
        sizes = numbers[1:, 1][:, None] + back[None, :, 1]
        room, lead = self.window - back[:, 2], back[:, 2] - fill(giver)
        fits = (moved > 0) & (moved <= room) & (sizes < 4) & ((numbers[1:, 1][:, None] == 1) | (back[None, :, 1] == 1))
        gain = np.where(fits, moved * (lead + moved), 0)
        at = int(gain.argmax())
        if gain.flat[at] <= 0:
            return None
        out, place = divmod(at, len(back))
        ends = np.cumsum([len(found) for found, _ in listed])
        taker = int(np.searchsorted(ends, place, side="right"))
        return takers[taker], given[1 + out], listed[taker][0][place - (ends[taker] - len(listed[taker][0]))]

    def _put(self, bin: Contents, n: int) -> None:
        if bin and n:
            kinds = self.full if fill(bin) == self.window else self.open
            kinds[bin] = kinds.get(bin, 0) + n
            if not kinds[bin]:
                del kinds[bin]

    def step(self) -> bool:
        """The best exchange of the emptiest kind that has one, for as many bins as there are."""
        kinds = sorted(self.open, key=lambda b: (fill(b), b))
        for giver in kinds:
            found = self.best(giver, [t for t in kinds if t != giver or self.open[t] > 1]) if len(kinds) > 1 or self.open[giver] > 1 else None
            if found:
                taker, out, back = found
                times = self.open[giver] // 2 if taker == giver else min(self.open[giver], self.open[taker])
                for bin, n in ((giver, -times), (taker, -times), (exchanged(giver, out, back), times), (exchanged(taker, back, out), times)):
                    self._put(bin, n)
                return True
        return False


def plan_bins(counts: dict[int, int], window: int = WINDOW, exchanges: int = EXCHANGES) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, how many of each length), for a histogram of lengths of at most ``window``.

    The search ends where no exchange gains, or where the bins are as few as the sum of the lengths allows.
    """
    search = Search(best_fit(counts, window), window)
    least = -(-sum(k * n for k, n in counts.items() if n > 0) // window)
    for _ in range(exchanges):
        if sum(search.full.values()) + sum(search.open.values()) <= least or not search.step():
            break
    kinds = search.full | search.open
    return [(kinds[bin], dict(bin)) for bin in sorted(kinds, reverse=True)]


def document_pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 2,
                    keep_ids: bool = False) -> DataFrame:
    """Each document's ids and then ``end_id`` in pieces: ``(row, part, doc_id, start, length, ids_crc32)``.

    A document of at most ``window`` ids is one piece. Of a longer one the first piece has what is left of whole windows.
    With ``keep_ids`` also ``ids``, as bytes of little-endian unsigned 32-bit numbers.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(texts: list[bytes]) -> dict:
        ids = [x + end for x in tokenizer(path)([t.decode("utf-8", "replace") for t in texts])]
        edges = [[0, *range((len(x) // 4 - 1) % window + 1, len(x) // 4 + 1, window)] for x in ids]
        crcs = [[zlib.crc32(x[4 * a : 4 * b]) for a, b in zip(e[:-1], e[1:], strict=True)] for x, e in zip(ids, edges, strict=True)]
        return {"tokens": [e[-1] for e in edges], "crcs": crcs} | ({"ids": ids} if keep_ids else {})

    fields = {"tokens": "long", "crcs": "array<long>"} | ({"ids": "binary"} if keep_ids else {})
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    rows = numbered(per_text(source, ["doc_id"], "text", fields, cut), "row").withColumn("head", F.expr(f"(tokens - 1) % {window} + 1"))
    rows = rows.select("*", F.posexplode("crcs").alias("part", "ids_crc32"))
    start = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.col("head") + (F.col("part") - 1) * window).cast("long")
    length = F.when(F.col("part") == 0, F.col("head")).otherwise(F.lit(window)).cast("long")
    cut_ids = [F.substring("ids", (4 * start + 1).cast("int"), (4 * length).cast("int")).alias("ids")] if keep_ids else []
    return rows.select("row", "part", "doc_id", start.alias("start"), length.alias("length"), "ids_crc32", *cut_ids)


def pack_whole(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 2,
               keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequence_tokens)``, a row per piece.

    A null or empty text is the one id ``end_id``. Repeated rows and rows with a null id are packed like others. An empty table
    gives no rows; columns other than the id and the text stay behind.
    """
    packed = pack_pieces(document_pieces(docs, path, id, text, window, end_id, keep_ids), window, plan_bins)
    return packed.select("doc_id", F.col("part").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset", "sequence_tokens",
                         *(["ids"] if keep_ids else []))
