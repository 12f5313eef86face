"""Language identification by prediction by partial matching (PPM).

Every language has a context tree over bytes up to ``ORDER`` deep.  A byte's
code length comes from the longest context seen in training; a context that
hasn't seen the byte pays its escape (method C: distinct / (total + distinct))
and hands on to the next shorter one, without the bytes just excluded.  Order -1
is uniform over the 256 bytes.  Statistics are frozen after training.

The trees of all languages are laid over each other: a node is a context that
some language's sample has ``MIN_SEEN`` times or more.  Nodes are closed under
dropping the first or the last byte, so they are the states of an automaton
whose state is the longest known context of what was read, and a language's
code length of a byte is a number by (state, byte).  Texts are coded in
lockstep, many pieces at a time, each after ``ORDER`` bytes of run-up.

Bytes that no sample has are alike in every context, so they share a column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, fresh, small_batches, utf8

#: Depth of the context trees, how often a context is seen to be a node, and code-length units per bit.
ORDER, MIN_SEEN, UNIT = 4, 4, 2048
#: The bound of the training sample: documents and bytes of text a language.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 600_000
#: Most languages: a model's tables grow with them.
MAX_LANGS = 64
#: Standard deviations above the mean rate of labelled documents from which a text counts as none of the languages: whatever
#: their distribution, at most 1 / SPREAD^2 of them lie beyond.  At RAW_BITS a byte, nothing learned helps to code it.
SPREAD, RAW_BITS = 12, 8.0
#: Bytes of text coded at a time, and of one piece in them.
BLOCK, PIECE = 1 << 18, 128


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # byte -> column; 0 for bytes that no sample has
    after: np.ndarray  # [state, column] -> state
    cost: np.ndarray  # code lengths in 1 / UNIT bits: [language, state, column], uint16
    limit: float = RAW_BITS  # bits a byte above which a text is in none of the languages

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code lengths in bits, [text, language]; ``off`` are n + 1 byte offsets into ``raw``."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        i = 0
        while i < len(off) - 1:
            j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
            if j == i + 1:  # a text of any length is summed block by block
                for a in range(int(off[i]), int(off[j]), BLOCK):
                    z = min(a + BLOCK, int(off[j]))
                    out[i] += self._sums(raw, np.array([a, z]), min(ORDER, a - int(off[i])))[0]
            else:
                out[i:j] = self._sums(raw, off[i : j + 1], 0)
            i = j
        return out

    def _sums(self, raw: np.ndarray, off: np.ndarray, before: int) -> np.ndarray:
        """``before``: bytes ahead of the first text that belong to its context."""
        a, z = int(off[0]), int(off[-1])
        out = np.zeros((len(off) - 1, len(self.langs)))
        if a == z:
            return out
        n, width = z - a, self.after.shape[1]
        lanes = -(-n // PIECE)
        s = np.zeros(lanes * PIECE + ORDER, np.int32)
        s[ORDER - before : ORDER + n] = self.symbol[raw[a - before : z]]
        fresh_start = np.zeros(len(s), bool)
        fresh_start[off[:-1][np.diff(off) > 0] - a + ORDER] = True
        fresh_start[ORDER] = not before
        window = lambda x: np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (lanes, PIECE + ORDER), (x.strides[0] * PIECE, x.strides[0])).T)
        s, fresh_start = window(s), window(fresh_start)
        some = fresh_start.any(1).tolist()
        after, state = self.after.reshape(-1), np.zeros(lanes, np.int32)
        at = np.empty((PIECE, lanes), np.int32)
        for t in range(PIECE + ORDER):
            if some[t]:
                state[fresh_start[t]] = 0
            place = state * width + s[t]
            if t >= ORDER:
                at[t - ORDER] = place
            state = after[place]
        at = at.T.reshape(-1)[:n]
        filled = np.flatnonzero(np.diff(off))
        starts = off[:-1][filled] - a
        for g in range(len(self.langs)):
            out[filled, g] = np.add.reduceat(self.cost[g].reshape(-1)[at], starts, dtype=np.int64) / UNIT
        return out


def _grams(texts: list[np.ndarray], width: int, order: int):
    """By order: (contexts times width plus symbol, counts) of one language, contexts within a text only."""
    if not texts:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (order + 1)
    s = np.concatenate(texts).astype(np.int64)
    place = np.concatenate([np.arange(len(t)) for t in texts])
    code, out, scale = s.copy(), [], 1
    out.append(np.unique(code, return_counts=True))
    for d in range(1, order + 1):
        scale *= width
        code[d:] += s[:-d] * scale if d < len(s) else 0
        out.append(np.unique(code[place >= d], return_counts=True))
    return out


def train(samples: dict[str, list[str]], order: int = ORDER, min_seen: int = MIN_SEEN) -> Model:
    """A model from texts by language."""
    if len(samples) > MAX_LANGS:
        raise ValueError(f"{len(samples)} languages; at most {MAX_LANGS} can be learned")
    data = {g: [np.frombuffer(t.lower().encode("utf-8", "surrogatepass"), np.uint8) for t in ts] for g, ts in sorted(samples.items())}
    seen = np.zeros(256, bool)
    for ts in data.values():
        for t in ts:
            seen[t] = True
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 1
    grams = [_grams([symbol[t] for t in ts if len(t)], width, order) for ts in data.values()]
    # Nodes by order: sorted contexts, the newest symbol in the last place.
    nodes = [np.zeros(1, np.int64)]
    for d in range(1, order + 1):
        own = [np.zeros(0, np.int64)]
        for g in grams:
            c, n = g[d]
            context, at = np.unique(c // width, return_index=True)
            total = np.add.reduceat(n, at) if len(at) else n
            own.append(context[total >= min_seen])
        nodes.append(np.unique(np.concatenate(own)))
    base = np.cumsum([0, *map(len, nodes)])
    after = np.zeros((base[-1], width), np.int32)
    shorter = [np.zeros(1, np.int64)]
    for d in range(1, order + 1):
        shorter.append(base[d - 1] + np.searchsorted(nodes[d - 1], nodes[d] % width ** (d - 1)))
    for d in range(order + 1):
        own = after[base[d] : base[d + 1]]
        if d:
            own[:] = after[shorter[d]]
        if d < order and len(nodes[d + 1]):
            parent = np.searchsorted(nodes[d], nodes[d + 1] // width)
            own[parent, nodes[d + 1] % width] = np.arange(base[d + 1], base[d + 2])
    cost = np.zeros((len(data), base[-1], width), np.uint16)
    alike = np.ones(width, np.float32)
    alike[0] = 256 - seen.sum()  # so many bytes share column 0
    for g in range(len(data)):
        p = np.zeros((base[-1], width), np.float32)
        for d in range(order + 1):
            c, n = grams[g][d]
            row = np.searchsorted(nodes[d], c // width)
            known = row < len(nodes[d])
            known[known] = nodes[d][row[known]] == c[known] // width
            row, col, n = row[known], c[known] % width, n[known]
            for a in range(0, len(nodes[d]), 8192):
                z = min(a + 8192, len(nodes[d]))
                i, j = np.searchsorted(row, (a, z))
                counts = np.zeros((z - a, width), np.float32)
                counts[row[i:j] - a, col[i:j]] = n[i:j]
                lower = p[shorter[d][a:z]] if d else np.full((1, width), 1 / 256, np.float32)
                p[base[d] + a : base[d] + z] = _predict(counts, lower, alike)
        with np.errstate(divide="ignore"):
            cost[g] = np.minimum(-np.log2(np.maximum(p, 2.0**-31)) * UNIT, 65535)
    return Model(list(data), symbol, after, cost)


def _predict(counts: np.ndarray, lower: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Probabilities of a byte of each column, from its counts in a context and the shorter context's probabilities."""
    total, seen = counts.sum(1, keepdims=True), counts > 0
    distinct = seen.sum(1, keepdims=True, dtype=np.float32)
    free = np.where(seen, 0, lower * alike).sum(1, keepdims=True)  # exclusion: what the shorter context may still predict
    full = free <= 1e-9  # every byte was seen: nothing to escape to
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = counts / np.where(full, total, total + distinct)
        miss = distinct / (total + distinct) * lower / np.where(full, 1, free)
    return np.where(total > 0, np.where(seen, hit, miss), lower)


def rate_limit(samples: dict[str, list[str]]) -> float:
    """The limit that labelled texts set: each half of them is coded by what the other half teaches."""
    rates: list[np.ndarray] = []
    for half in (0, 1):
        m = train({g: ts[half::2] for g, ts in samples.items() if ts[half::2]})
        texts = [t.lower().encode("utf-8", "surrogatepass") for ts in samples.values() for t in ts[1 - half :: 2]]
        texts = [t for t in texts if t]
        if m.langs and texts:
            off = np.cumsum([0, *map(len, texts)])
            rates.append(m.scores(np.frombuffer(b"".join(texts), np.uint8), off).min(1) / np.diff(off))
    if not rates:
        return RAW_BITS
    r = np.concatenate(rates)
    return float(min(RAW_BITS, r.mean() + SPREAD * r.std()))


def held_out(key):
    """crc32 of the key as text, mod 5, is 0; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, limited: bool = False) -> Model:
    """Train on at most ``sample_docs`` documents a language, up to ``sample_bytes`` of text.

    A document that would pass the bytes is left out and later ones still count;
    where the first documents all pass them alone, a part of the first one is taken.
    Only documents that aren't held out are eligible; the sample is the least md5
    of the key.  With ``limited``, it sets the model's limit too.  Languages are counted first, without reading texts;
    more than ``MAX_LANGS`` of them are a ValueError.  Other columns aren't read, whatever their names.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("g")).where(F.col("g").isNotNull() & ~held_out(F.col("k")))
    langs = {r.g: r.n for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled; at most {MAX_LANGS} can be learned")
    if not langs:
        return train({})
    ticket = F.conv(F.substring(F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    # About twice the wanted number gets a ticket, whatever the table's size; ranks settle the rest.
    share = F.create_map(*[F.lit(x) for g, n in langs.items() for x in (g, min(1.0, (2 * sample_docs + 20) / n))])
    drawn = rows.where(F.col("t").isNotNull()).withColumn("ticket", ticket).where(F.col("ticket") <= share[F.col("g")])
    # At most sample_docs texts a language are kept, and only their sizes come to the driver at first.
    order = Window.partitionBy("g").orderBy("ticket", "k", "t")
    ranked = checkpointed(drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs))
    taken: dict[str, list[int]] = {}
    held: dict[str, int] = {}
    for g, rank, size in ranked.select("g", "rank", F.octet_length("t").alias("size")).orderBy("g", "rank").collect():
        own = taken.setdefault(g, [])
        if held.get(g, 0) + size <= sample_bytes:
            own.append(rank)
            held[g] = held.get(g, 0) + size
    chosen = F.lit(False)
    for g, own in taken.items():
        chosen |= (F.col("g") == g) & F.col("rank").isin(own or [1])
    samples: dict[str, list[str]] = {}
    # A text of n characters has n bytes or more, so no more than the bound is collected of a part.
    for g, t in ranked.where(chosen).orderBy("g", "rank").select("g", F.substring(F.lower("t"), 1, sample_bytes)).collect():
        samples.setdefault(g, []).append(t.encode("utf-8", "surrogatepass")[:sample_bytes].decode("utf-8", "ignore"))
    model = train(samples)
    if limited:
        model.limit = rate_limit(samples)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and bits_per_byte to ``docs``.

    ``lang_pred`` is the language of the least code length (ties: the first
    name), "und" with score 0 if the text is null, holds no letter, or nothing was
    learned.  ``score`` is that language's share of the posterior of all.
    Texts of any length are coded whole, in bounded memory; repeated rows are
    judged alike; an empty table gives none.  Other columns pass through,
    whatever their names; columns of the names added here are replaced.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # states * columns * (4 + 2 * languages) bytes; samples and languages are bounded
    base = docs.drop("lang_pred", "score", "bits_per_byte")
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))

    def predict(batches):
        m = shared.value
        for b in batches:
            raw, off = utf8(b.column(len(b.schema) - 2))
            ok = b.column(len(b.schema) - 1).to_numpy(zero_copy_only=False).astype(bool)
            out = b.select(range(len(b.schema) - 2))
            n = len(b)
            if not m.langs:
                pred, score, rate = ["und"] * n, np.zeros(n), np.zeros(n)
            else:
                bits = m.scores(raw, off)
                best = bits.argmin(1)
                least = bits[np.arange(n), best]
                score = np.where(ok, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0.0)
                rate = np.where(ok, least / np.maximum(1, np.diff(off)), 0.0)
                pred = [m.langs[i] if o else "und" for i, o in zip(best, ok, strict=True)]
            out = out.append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(score, pa.float64()))
            yield out.append_column("bits_per_byte", pa.array(rate, pa.float64()))

    schema = ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", lang_pred string, score double, bits_per_byte double"
    return base.withColumns({fresh(base, "lower"): F.lower(text), fresh(base, "letters"): lettered}).mapInArrow(predict, schema)
