"""Best-fit decreasing packing of tokenised documents into fixed sequences.

Lengths are integers up to the capacity, so best-fit decreasing over the whole
corpus is planned on counts: pieces of one length meet the open bins of the
tightest sufficient capacity (found in a segment tree) in one step.  The plan
has at most some thousand steps, whatever the corpus; a piece finds its sequence
by its length and its place among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dense_rank, small_batches

CAPACITY = 2048


class CapacityTree:
    """Segment tree over remaining capacities 0..n: the least one >= x that has open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, capacity: int, some: bool) -> None:
        i = capacity + self.size
        self.open[i] = int(some)
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, x: int) -> int:
        """The least open capacity >= x, or -1; climbs and descends once."""
        i = x + self.size
        if self.open[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Steps (length, first place among its pieces, first sequence, offset) of best-fit decreasing.

    Bins of equal remaining capacity are kept as ranges of sequence numbers.
    """
    tree = CapacityTree(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}
    steps: list[tuple[int, int, int, int]] = []
    opened = 0

    def add(rest: int, first: int, n: int) -> None:
        if rest and n:
            bins.setdefault(rest, []).append((first, n))
            tree.set(rest, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} doesn't fit")
        place, left = 0, counts[length]
        while left:
            rest = tree.tightest(length)
            if rest < 0:
                rest, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins[rest].pop()
                if not bins[rest]:
                    tree.set(rest, False)
            # A bin that took one such piece is then the tightest, so it takes all that fit before the next bin gets one.
            per = rest // length
            full, over = divmod(min(left, n * per), per)
            for k in range(per):
                if full:
                    steps.append((length, place, first, capacity - rest + k * length))
                    place += full
            for k in range(over):
                steps.append((length, place, first + full, capacity - rest + k * length))
                place += 1
            left -= full * per + over
            add(rest - per * length, first, full)
            if over:
                add(rest - over * length, first + full, 1)
            if n > full + bool(over):
                add(rest, first + full + bool(over), n - full - bool(over))
    return steps


def encoder(folder_path):
    """Token ids of a text, as the tokenizers library gives them for the file ``<path>.json``.

    The same vocabulary as ranks, ``<path>.tiktoken``, gives the same ids
    several times faster; texts that hold a special token's string go to the
    tokenizers library itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(f"{folder_path}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(f"{folder_path}.json")
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json").removesuffix(".json")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces: key, piece, start, length, ids_crc32 and, if asked for, their ids.

    Null text is empty, so such a document is the end id alone.  Documents
    beyond ``capacity`` are cut into full pieces after a first, shorter one.
    """
    small_batches(docs.sparkSession)
    base = tokenizer or default_tokenizer()

    def cut(batches):
        encode = encoder(base)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*(encode(t) if t else ()), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                ends = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for p, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
                    rows.append((i, p, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z] if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            out = [pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(out[: 5 + with_ids], names=["k", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    out = rows.mapInArrow(cut, "k long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("k", key)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed best-fit decreasing.

    Every token is in exactly one sequence, gapless from offset 0.  Empty tables
    give no rows; repeated rows are packed each; other columns are left out, and
    a null key stays null.
    """
    cut = checkpointed(pieces(docs, key, text, capacity, tokenizer, end_id, with_ids))  # tokenise once
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    steps: dict[int, tuple[list[int], list[int], list[int]]] = {}
    for length, place, first, offset in plan(counts, capacity):
        a, b, c = steps.setdefault(length, ([], [], []))
        a.append(place), b.append(first), c.append(offset)
    ranked = dense_rank(cut, ["length"], [key, "piece", "start", "ids_crc32"], "_place")
    kept = [c for c in ranked.columns if c != "_place"]

    def assign(batches):
        for b in batches:
            ids, offs = [], []
            for n, r in zip(b.column("length").to_pylist(), b.column("_place").to_pylist(), strict=True):
                a, first, off = steps[n]
                i = bisect_right(a, r) - 1
                ids.append(first[i] + r - a[i])
                offs.append(off[i])
            out = b.select(kept)
            yield out.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offs, pa.int64()))

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(assign, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id long, offset long")
