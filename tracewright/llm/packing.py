"""Hierarchical multi-length packing of token sequences (operator 9)."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END = 4096, 2
#: Context sizes; a document's remainder goes to the smallest tier that holds it, and each tier is packed at its size.
TIERS = (256, 512, 1024, 2048, 4096)
#: A task packs once it holds so many windows of remainders, down to KEEP; a step group has so many windows of tokens.
POOL, KEEP, GROUP = 64, 32, 8
#: Distinct words whose ids a worker remembers; beyond, the half that came last is forgotten, as frequent words come early.
WORDS = 500_000

#: A comma or a full stop that ends a word is a token of its own after an ASCII letter or digit.
_STOP = re.compile(rb"[a-z0-9][,.]\Z")


class WordIds:
    """Token ids by a tokenizer that lowers case and never looks across white space: a distinct word is encoded once.

    ``encode`` gives exactly the tokenizer's ids of the whole text. Words not seen before are encoded together and
    told apart by their tokens' offsets. A text with the start of a special token's name is encoded as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        known = self.known
        if len(known) + len(words) > WORDS:
            for w in list(known)[WORDS // 2 :]:
                del known[w]
        ended = [w for w in words if w.endswith((b",", b".")) and _STOP.search(w)]
        # whole words but those that end in a stop, which are put together from the word and the stop
        new = dict.fromkeys(words).keys() - ended | {w[:-1] for w in ended} | {w[-1:] for w in ended}
        new = [w for w in new if w not in known]
        for k in range(0, len(new), 5000):
            part = new[k : k + 5000]
            texts = [w.decode("utf-8", "surrogatepass") for w in part]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            raw = np.array(got.ids, dtype="<u4").tobytes()
            starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
            ends = np.searchsorted(np.array([o[0] for o in got.offsets]), starts).tolist()
            for i, w in enumerate(part):
                known[w] = raw[4 * ends[i] : 4 * ends[i + 1]]
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def encode(self, text: bytes) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if b"<|" in text:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self.learn([w for w in dict.fromkeys(words) if w not in known])
        try:
            return b"".join([known[w] for w in words])
        except KeyError:  # forgotten meanwhile
            self.learn([*dict.fromkeys(words)])
        return b"".join([known[w] for w in words])


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


class Packer:
    """Packs pieces (length, document, start) into windows; a piece belongs to the smallest tier that holds it."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, int, int]] = []  # by length
        self.held = 0

    def add(self, length: int, doc: int, start: int) -> None:
        insort(self.pieces, (length, doc, start))
        self.held += length

    def tier(self) -> int:
        """The tier of the longest piece, or what fills the pool's last windows: the largest power of two that it holds."""
        longest = next(t for t in TIERS if self.pieces[-1][0] <= t)
        return longest if longest <= self.held else 1 << (self.held.bit_length() - 1)

    def take(self, most: int) -> tuple[int, int, int]:
        """The longest piece of ``most`` at most; if all are longer, the shortest is cut and its rest belongs to its own tier."""
        at = bisect_left(self.pieces, (most + 1,))
        length, doc, start = self.pieces.pop(max(0, at - 1))
        self.held -= length
        if length > most:
            self.add(length - most, doc, start + most)
        return doc, start, min(length, most)

    def window(self, size: int) -> list[tuple[int, int, int]]:
        """Pieces that fill exactly ``size`` tokens, of which the pool holds as many at least: the longest of the tier, and
        the gap that it leaves from it and the tiers below, longest first."""
        pieces, left = [], size
        while left:
            pieces.append(self.take(left))
            left -= pieces[-1][2]
        return pieces


def windows(lengths: Iterator[tuple[int, int]]) -> Iterator[tuple[int, list[tuple]]]:
    """``(size, pieces)`` from ``(document, tokens)``: every window is full, and has the size of its longest piece's tier.

    A long document gives windows of its own first. Once the pool holds POOL windows, the tiers are packed from the
    longest down, so long windows find short pieces for their gaps; KEEP of the pool stays for the gaps to come. What a
    task has left in the end fills windows of a tier, then one of each power of two in its number: no token is padding.
    """
    pool = Packer()
    for doc, n in lengths:
        whole = n // WINDOW * WINDOW
        for start in range(0, whole, WINDOW):
            yield WINDOW, [(doc, start, WINDOW)]
        if n > whole:
            pool.add(n - whole, doc, whole)
        if pool.held >= POOL * WINDOW:
            while pool.held > KEEP * WINDOW:
                size = pool.tier()
                yield size, pool.window(size)
    while pool.held:
        size = pool.tier()
        yield size, pool.window(size)


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document's ids (with the END id), in sequences of WINDOW tokens or a power of two.

    One pass and no shuffle: a task packs the rows of its input partition, whose remainder costs a handful of short
    sequences. Sequence numbers start at the partition's number times 2**32, so a task that runs again gives the
    same rows. Null and empty texts are one END id; rows of one id are packed each; null ids stay null; an empty table
    gives none, and other columns don't matter. step_group deals a task's windows of one tier, in order of attention
    cost and back again, to groups of GROUP * WINDOW tokens, so the steps of a tier are alike in size and in cost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer_path)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[int, list] = {}  # number -> [doc_id, ids, tokens, tokens not yet packed]

        def lengths() -> Iterator[tuple[int, int]]:
            number = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = ids.encode(text or b"") + END.to_bytes(4, "little")
                    held[number] = [doc_id, raw, len(raw) // 4, len(raw) // 4]
                    yield number, len(raw) // 4
                    number += 1

        rows: dict[int, list[tuple]] = defaultdict(list)  # by tier
        costs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of the windows in rows: (attention cost, sequence)
        sequence = groups = 0

        def dealt(tier: int) -> pa.RecordBatch:
            nonlocal groups
            each = max(1, len(costs[tier]) * tier // (GROUP * WINDOW))
            place = {}
            for r, (_, s) in enumerate(sorted(costs[tier])):
                turn, k = divmod(r, each)
                place[s] = base + groups + (k if turn % 2 == 0 else each - 1 - k)
            groups += each
            cols = list(zip(*[(*r, tier, place[r[5]]) for r in rows[tier]]))
            del rows[tier], costs[tier]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 8 else pa.int64()) for i, c in enumerate(cols)], names=[c.split()[0] for c in COLUMNS.split(", ")])

        for size, pieces in windows(lengths()):
            offset, tier = 0, next(t for t in TIERS if size <= t)
            for number, start, length in pieces:
                doc = held[number]
                rows[tier].append((doc[0], start, length, zlib.crc32(doc[1][4 * start : 4 * (start + length)]), doc[2], base + sequence, offset, size))
                offset += length
                doc[3] -= length
                if not doc[3]:
                    del held[number]
            costs[tier].append((sum(p[2] ** 2 for p in pieces), base + sequence))
            sequence += 1
            if len(costs[tier]) * tier >= 64 * GROUP * WINDOW:
                yield dealt(tier)
        for tier in sorted(rows):
            yield dealt(tier)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, COLUMNS)
