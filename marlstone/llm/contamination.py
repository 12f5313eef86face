"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are sets of shingles with fixed places.  A window
occurs in a document only if all its shingles do, so a prefix of one shingle is
necessary: the rarest one.

Pass 1 counts, over all documents, in how many each shingle of the benchmark
occurs.  That orders shingles by rarity, and a window with a shingle that occurs
nowhere is gone.  Pass 2 joins documents with what is left on the prefix
shingles alone; length and positional bounds discard places that can't hold a
whole window, and the words of the text decide.

The benchmark is read in blocks of items of at most ``block_words`` words.  What
a block sends to the tasks of pass 1 is 8 bytes a word; pass 2 gets only windows
whose shingles all occur, some 40 bytes each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8
from .shingles import ALNUM, grams, word_runs

#: Words are runs of other characters, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same on UTF-8 bytes: all other bytes but digits and a-z part words; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW, SHINGLE = 13, 5
#: Words of benchmark items in one block.
BLOCK_WORDS = 1_000_000


def words(text: str | bytes | None) -> list[bytes]:
    text = text or b""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_FOLD).split()


class Shingles:
    """The distinct shingles of one block of items, to be counted in documents."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        self.window, self.shingle = window, shingle
        self.names = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        body = [b" ".join(w) for w in self.words]
        off = np.cumsum([0, *map(len, body)])
        hashes: list[np.ndarray] = []
        for _, h, at in word_runs(np.frombuffer(b"".join(body), np.uint8), off, ALNUM):
            hashes += [h[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
        #: Shingles of every item in order; an item of fewer words than a shingle has is one of its own size.
        self.codes = [grams(h, min(shingle, len(h))) for h in hashes]
        sizes = [min(shingle, len(w)) for w in self.words]
        self.by_size = {k: np.unique(np.concatenate([c for c, s in zip(self.codes, sizes, strict=True) if s == k])) for k in set(sizes) if k}

    def probe(self) -> Probe:
        return Probe(self.by_size)

    def windows(self, counts: dict[int, np.ndarray]) -> Prefixes:
        """Windows whose shingles all occur in some document, by their rarest one."""
        found: list[tuple[int, int, int, int, int, int]] = []
        for r, (own, code) in enumerate(zip(self.words, self.codes, strict=True)):
            if not own:
                continue
            k, n = min(self.shingle, len(own)), min(self.window, len(own))
            df = counts[k][np.searchsorted(self.by_size[k], code)]
            seen = np.lib.stride_tricks.sliding_window_view(df, n - k + 1)
            rare = seen.argmin(1)
            for a in np.flatnonzero(seen.min(1) > 0).tolist():
                found.append((k, int(code[a + rare[a]]), int(rare[a]), r, a, n))
        return Prefixes(found, self)


class Probe:
    """Finds listed shingles in texts, run by run."""

    def __init__(self, by_size: dict[int, np.ndarray]):
        self.by_size = by_size
        self.maybe = {}
        for k, codes in by_size.items():
            bits = max(12, int(len(codes)).bit_length() + 4)
            table = np.zeros(1 << bits, bool)
            table[codes >> np.uint64(64 - bits)] = True
            self.maybe[k] = np.uint64(64 - bits), table

    def find(self, w: np.ndarray, at: np.ndarray):
        """Yields (size, text, place in the text, number of the shingle) as arrays; ``at`` are the texts' offsets into words ``w``."""
        for k, codes in self.by_size.items():
            g = grams(w, k)
            shift, table = self.maybe[k]
            p = np.flatnonzero(table[g >> shift])
            number = np.minimum(np.searchsorted(codes, g[p]), len(codes) - 1)
            hit = codes[number] == g[p]
            p, number = p[hit], number[hit]
            text = np.searchsorted(at, p, "right") - 1
            whole = p + k <= at[text + 1]  # not over a text's end
            p, number, text = p[whole], number[whole], text[whole]
            yield k, text, p - at[text], number


class Prefixes:
    """Windows by their prefix shingle, as arrays."""

    def __init__(self, found: list[tuple[int, int, int, int, int, int]], of: Shingles):
        rows = sorted({f[3] for f in found})
        place = {r: i for i, r in enumerate(rows)}
        self.names, self.words = [of.names[r] for r in rows], [of.words[r] for r in rows]
        found.sort()
        self.codes, self.start, self.posts = {}, {}, {}
        for k in {f[0] for f in found}:
            own = [f for f in found if f[0] == k]
            codes, at = np.unique(np.array([f[1] for f in own], np.uint64), return_index=True)
            self.codes[k], self.start[k] = codes, np.append(at, len(own))
            #: Of each window: the prefix's place in it, item, first word, words.
            self.posts[k] = np.array([(f[2], place[f[3]], f[4], f[5]) for f in own], np.int32)

    def verify(self, text: bytes, n: int, places: list[tuple[int, int, int]]) -> tuple[list[int], list[str]]:
        """(merged spans, items) of windows found from (size, place, prefix) in a text of n words."""
        own, hits, items = None, set(), set()
        for k, place, number in places:
            for rare, item, first, length in self.posts[k][self.start[k][number] : self.start[k][number + 1]].tolist():
                start = place - rare
                if start < 0 or start + length > n:  # positional and length bounds
                    continue
                own = own or words(text)
                if own[start : start + length] == self.words[item][first : first + length]:
                    hits.add((start, start + length))
                    items.add(self.names[item])
        return _merged(hits), sorted(items)


def _merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, z in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def _blocks(items: Iterable[tuple[str, str | None]], block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    block: list[tuple[str, str | None]] = []
    size = 0
    for item in items:
        n = len(words(item[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append(item)
        size += n
    yield block


def _frequencies(rows: DataFrame, own: Shingles) -> dict[int, np.ndarray]:
    """By shingle size: in how many documents each shingle of the block occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(own.by_size)
    size = {k: len(c) for k, c in own.by_size.items()}

    def count(batches):
        probe = Probe(shared.value)
        sums = {k: np.zeros(n, np.int64) for k, n in size.items()}
        for b in batches:
            for _, w, at in word_runs(*utf8(b.column(0)), ALNUM):
                for k, text, _, number in probe.find(w, at):
                    sums[k] += np.bincount(np.unique(text * size[k] + number) % size[k], minlength=size[k])
        for k, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], names=["k", "s", "n"])

    # At most as many rows as the block has shingles.
    sums = rows.select("t").mapInArrow(count, "k int, s long, n long").groupBy("k", "s").agg(F.sum("n").alias("n")).toArrow()
    out = {k: np.zeros(n, np.int64) for k, n in size.items()}
    ks, ss, ns = (sums.column(c).to_numpy() for c in ("k", "s", "n"))
    for k in out:
        out[k][ss[ks == k]] = ns[ks == k]
    shared.destroy()
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated, items, hit_spans.

    A word is hit if it lies in an occurrence of an item's window; an item of
    fewer words than ``window`` is one window; items without words have none.
    Contaminated: n_hit > 0 and 20 * n_hit >= n_words.  ``hit_spans`` are merged
    (first, end) word places, flat.  Null text has no words; texts of any length
    are searched whole; a null key gets a row.  Items of one text are all
    listed, an item of a null key is none; repeated document rows get a row
    each; empty tables on either side give no hits; other columns are left out,
    whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # The benchmark, not the corpus: streamed from Spark block by block, whatever its size.
    listed = benchmark.select(F.col(item_key).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null").orderBy("i", "t").toLocalIterator()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    state = rows.select("k", "t", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<int>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for block in _blocks(((r.i, r.t) for r in listed), block_words):
        own = Shingles(block, window, shingle)
        left = own.windows(_frequencies(rows, own)) if own.by_size else Prefixes([], own)
        state = _join(state, spark.sparkContext.broadcast(left))
    out = state.select(
        F.col("k").alias(key), "n_words",
        F.expr("aggregate(sequence(1, size(spans) div 2), 0L, (a, i) -> if(size(spans) = 0, 0L, a + spans[2 * i - 1] - spans[2 * i - 2]))").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        F.sort_array("items").alias("items"), F.col("spans").alias("hit_spans"),
    )
    flagged = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select(key, "n_words", "n_hit", "n_items", "items_sha256", flagged.alias("contaminated"), "items", "hit_spans")


def _join(state: DataFrame, prefixes) -> DataFrame:
    """Add one block's hit spans and items to every document."""

    def meet(batches):
        own = prefixes.value
        probe = Probe(own.codes)
        for b in batches:
            texts = b.column(1)
            n = np.zeros(len(b), np.int64)
            places: dict[int, list[tuple[int, int, int]]] = {}
            for i, w, at in word_runs(*utf8(texts), ALNUM):
                n[i : i + len(at) - 1] = np.diff(at)
                for k, text, place, number in probe.find(w, at):
                    for t, p, x in zip((text + i).tolist(), place.tolist(), number.tolist(), strict=True):
                        places.setdefault(t, []).append((k, p, x))
            spans, items = b.column(3), b.column(4)
            if places:
                spans, items = spans.to_pylist(), items.to_pylist()
                for r, where in places.items():
                    found, names = own.verify((texts[r].as_py() or "").encode("utf-8", "surrogatepass"), int(n[r]), where)
                    if found:
                        old = spans[r]
                        spans[r] = _merged([*zip(old[::2], old[1::2], strict=True), *zip(found[::2], found[1::2], strict=True)])
                        items[r] = sorted({*items[r], *names})
                spans, items = pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(n), spans, items], names=["k", "t", "n_words", "spans", "items"])

    return state.mapInArrow(meet, "k long, t string, n_words long, spans array<int>, items array<string>")
