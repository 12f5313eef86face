"""N-gram Jaccard join with PartEnum signatures.

Documents link when their sets of word shingles have a Jaccard similarity of
0.8 or more.  Equal sets make one class.  Class sizes fall into bands [l, r] with
r = 1.25 l; a linked pair lies in one band or in two adjacent ones, and the sizes
bound its symmetric difference by (|a| + |b|) / 9.

A band's instance divides the shingle domain into first-level parts, each of
them into ``CELLS`` second-level ones, and every subset of ``CELLS`` - 1 cells of a
part makes a signature: the shingles in them.  Two sets that differ in one
shingle of a part at most agree on such a subset, and a linked pair differs in
more in no more than half its bound's number of parts, so it shares a signature
in all others: in ``slack`` parts at least.

Signatures that up to ``COLD`` classes share give candidate pairs, counted and
kept only if they share as many as a linked pair must.  A pair escapes those only
if both its classes have so many weak parts (two empty cells) or widely shared
signatures that these could be all they agree on; such classes are candidates by
the shared signatures themselves, each with its group's least class.  Subsets of
empty cells have no signature, so a class with so many weak parts that these
could be all it agrees on is signed by each of its shingles too, and shares one
with any linked class.

Candidates are verified on the sets themselves, which move to their family (the
candidate graph's component) once instead of once a pair: families of up to
``FAMILY`` classes are compared in a task, larger ones in rounds of pivots that
are dealt to the cells of their family.  All of it is on the executors; no group
is expanded into pairs, and no linked pair is missed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constants, settled, small_batches, utf8
from .components import EDGES, connected_components, joined_up, partitions_for
from .shingles import mix, shingle_sets

#: Most classes of a signature whose pairs are all candidates; most classes of a family that one task compares.
COLD, FAMILY = 24, 200
#: Signatures gathered in a map task before they are dealt out.
GATHER = 1 << 20
#: Pivots of a family in its first and in any later round, bytes of their sets, and classes of a family that one task compares with them.
FIRST, PIVOTS, PIVOT_BYTES, DEALT = 64, 2048, 16 << 20, 2048
#: Most classes of large families whose links of a round one task joins up.
TOGETHER = EDGES // 4

#: Second-level cells of a part; signatures are the subsets that leave out one.
CELLS = 3
#: Marks rows of pivots and of those that are compared with them.
PIVOT, MEMBER = 0, 1

#: In place of the instance: a signature of one shingle, of a class whose empty parts alone could be what it agrees on.
DIRECT = 127

_LOW, _HIGH = [1], [1]
while _HIGH[-1] < 1 << 31:
    _LOW.append(_HIGH[-1] + 1)
    _HIGH.append(max(_LOW[-1], _LOW[-1] * 5 // 4))
_LOWS = np.array(_LOW)


def band(n: int) -> int:
    return int(np.searchsorted(_LOWS, n, "right")) - 1


def parts(i: int) -> int:
    """First-level parts of band i's instance: more than a linked pair can differ twice in; 0 if linked sets of these sizes are equal."""
    r = _HIGH[i]
    k = (r + r * 5 // 4) // 9
    return k // 2 + 2 + -(-r // 100) if k else 0


def slack(n: int, i: int) -> int:
    """Parts in which a set of n shingles surely shares a subset of cells with any linked partner in instance i."""
    partner = n * 5 // 4 if band(n) == i else _HIGH[i]
    return parts(i) - (n + partner) // 9 // 2


def linked(inter: np.ndarray | int, n: int, m: np.ndarray | int):
    return 100 * inter >= 80 * (n + m - inter)


def _class(u: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        a = mix(u ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
        b = mix(u + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _partition(u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(cells in use, where they start, weak parts: with fewer than two cells in use) of sorted hashes; a cell is a range of the hash domain."""
    p = ((u >> np.uint64(32)) * np.uint64(n * CELLS)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    p = p[at].astype(np.int64)
    return p, at, int((np.bincount(p // CELLS, minlength=n) < 2).sum())


@functools.cache
def _names(i: int) -> np.ndarray:
    """A number for every (part, left out cell) of instance i."""
    with np.errstate(over="ignore"):
        return mix(np.arange(parts(i) * CELLS, dtype=np.uint64) * np.uint64(128) + np.uint64(i))


def _enumerate(v: np.ndarray, cells: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
    """Signatures of instance i: of every part the subsets of cells that leave out one, as far as they hold a shingle."""
    held = np.zeros(parts(i) * CELLS, np.uint64)
    held[cells] = np.add.reduceat(v, at)
    used = np.zeros(len(held), np.int64)
    used[cells] = 1
    held, used = held.reshape(-1, CELLS), used.reshape(-1, CELLS)
    rest = (held.sum(1, dtype=np.uint64)[:, None] - held).reshape(-1)
    some = (used.sum(1)[:, None] - used).reshape(-1) > 0
    s = mix(rest[some] + _names(i)[some])
    return (s & np.uint64(_ALL_BUT_7)) | np.uint64(i)


def instances(n: int) -> list[int]:
    """The instances that a set of n shingles takes part in: its own band's and the next lower one's."""
    b = band(n)
    return [i for i in (b, b - 1) if i >= 0 and parts(i)]


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: key, set size, class hashes and weak parts in its two instances."""

    def read(batches):
        for b in batches:
            rows = []
            for u in shingle_sets(*utf8(b.column(1))):
                if not len(u):
                    rows.append((0, None, None, 0, 0))
                    continue
                own = band(len(u))
                weak = [_partition(u, parts(i))[2] if i >= 0 and parts(i) else 0 for i in (own, own - 1)]
                rows.append((len(u), *_class(u), *weak))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["k", "n", "h1", "h2", "e0", "e1"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(read, "k long, n long, h1 long, h2 long, e0 long, e1 long")


def _dealt_keys(spark: SparkSession) -> tuple[int, list[int]]:
    """For every shuffle partition one number that Spark's hash partitioning sends there."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: dict[int, int] = {}
    ids = spark.range(0, 40 * n + 400, numPartitions=1).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
    for r in ids.collect():
        found.setdefault(r.p, r.i)
    return n, [found[p] for p in sorted(found)]


_REFERENCE = np.dtype([("h", "<i8"), ("n", "<u4")])


def _signatures(docs: DataFrame, text: str) -> DataFrame:
    """Packed (signature, class) lists: one row per map-task flush and bucket."""
    n, keys = _dealt_keys(docs.sparkSession)
    buckets = len(keys)

    def emit(sigs: list[np.ndarray], refs: list[tuple[int, int]]):
        sig = np.concatenate(sigs)
        ref = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
        bucket = ((sig >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
        order = np.argsort(bucket, kind="stable")
        sig, ref, bucket = sig[order], ref[order], bucket[order]
        table = np.array(refs, _REFERENCE)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows = []
        for a, z in zip(at, [*at[1:], len(sig)], strict=True):
            there, place = np.unique(ref[a:z], return_inverse=True)
            low = sig[a:z] & np.uint64(0xFFFFFFFFFFFF)  # 48 bits, of which the last 7 are the instance
            body = np.array([z - a, len(there)], "<u4").tobytes() + (low >> np.uint64(16)).astype("<u4").tobytes() + (low & np.uint64(0xFFFF)).astype("<u2").tobytes() + place.astype("<u2").tobytes() + table[there].tobytes()
            rows.append((keys[int(bucket[a])], int(bucket[a]), body))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["key", "bucket", "body"])

    def sign(batches):
        seen: set[int] = set()  # a class is signed once a task; 8 bytes a document
        sigs: list[np.ndarray] = []
        refs: list[tuple[int, int]] = []
        held = 0
        for b in batches:
            for u in shingle_sets(*utf8(b.column(0))):
                if not len(u):
                    continue
                h = _class(u)[0]
                if h in seen:
                    continue
                seen.add(h)
                with np.errstate(over="ignore"):
                    v = mix(u ^ np.uint64(0xA4093822299F31D0))
                    own = []
                    for i in instances(len(u)):
                        cells, at, weak = _partition(u, parts(i))
                        own.append(_enumerate(v, cells, at, i))
                        if weak >= slack(len(u), i):
                            own.append(mix(v ^ np.uint64(i)) | np.uint64(DIRECT))
                if not own:
                    continue
                sigs.append(np.concatenate(own))
                refs.append((h, len(u)))
                held += len(sigs[-1])
                if held >= GATHER or len(refs) == 65535:
                    yield emit(sigs, refs)
                    sigs, refs, held = [], [], 0
        if refs:
            yield emit(sigs, refs)

    packed = docs.select(F.col(text).alias("t")).mapInArrow(sign, "key int, bucket int, body binary")
    return packed.repartition(n, "key")


_ALL_BUT_7 = ((1 << 64) - 1) ^ 127


def _candidates(packed: DataFrame, cold: int) -> DataFrame:
    """From dealt signatures: pairs (kind 0: a, b, na, nb, inst, c shared) and wide groups' members (kind 1: a, na, inst, s)."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("inst", pa.int64()), ("c", pa.int64()), ("s", pa.int64())])

    def meet(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for bucket, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, m = np.frombuffer(body, "<u4", 2)
                hi = np.frombuffer(body, "<u4", n, 8).astype(np.uint64)
                lo = np.frombuffer(body, "<u2", n, 8 + 4 * n).astype(np.uint64)
                ref = np.frombuffer(body, "<u2", n, 8 + 6 * n)
                table = np.frombuffer(body, _REFERENCE, m, 8 + 8 * n)
                # The bucket's number tells signatures of equal low bits apart.
                held.append(((hi << np.uint64(16)) | lo | (np.uint64(bucket % 65536) << np.uint64(48)), table[ref]))
        if not held:
            return
        sig = np.concatenate([s for s, _ in held])
        ref = np.concatenate([r for _, r in held])
        held.clear()
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        both = np.zeros(len(sig), bool)
        both[1:] |= same
        both[:-1] |= same
        sig, ref = sig[both], ref[order[both]]
        if not len(sig):
            return
        order = np.lexsort((ref["h"], sig))
        sig, ref = sig[order], ref[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ref["h"][1:] != ref["h"][:-1])))
        sig, ref = sig[new], ref[new]
        at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(at, len(sig)))
        inst = (sig & np.uint64(127)).astype(np.int64)
        bands = np.searchsorted(_LOWS, ref["n"], "right") - 1
        found = []
        for g in np.unique(size[(size > 1) & (size <= cold)]):
            rows = at[size == g]
            i, j = np.triu_indices(g, 1)
            a, b = (rows[:, None] + i).ravel(), (rows[:, None] + j).ravel()
            na, nb = ref["n"][a].astype(np.int64), ref["n"][b].astype(np.int64)
            # A pair counts in its lower band's instance only (by single shingles, in either), and if its sizes allow a link.
            ok = ((np.minimum(bands[a], bands[b]) == inst[a]) | (inst[a] == DIRECT)) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
            found.append((a[ok], b[ok]))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        ha, hb = ref["h"][a], ref["h"][b]
        order = np.lexsort((hb, ha))
        a, b, ha, hb = a[order], b[order], ha[order], hb[order]
        if len(a):
            first = np.flatnonzero(np.concatenate(([True], (ha[1:] != ha[:-1]) | (hb[1:] != hb[:-1]))))
            count = np.diff(np.append(first, len(a)))
            a, b = a[first], b[first]
            yield from _slices(schema, [np.zeros(len(a), np.int8), ref["h"][a], ref["h"][b], ref["n"][a], ref["n"][b], inst[a], count, np.zeros(len(a))])
        wide = np.flatnonzero(np.repeat(size > cold, size))
        if len(wide):
            w = ref[wide]
            none = np.zeros(len(wide))
            yield from _slices(schema, [np.ones(len(wide), np.int8), w["h"], none, w["n"], none, inst[wide], none, sig[wide].astype(np.int64)])

    return packed.mapInArrow(meet, "kind byte, a long, b long, na long, nb long, inst long, c long, s long")


def _slices(schema: pa.Schema, cols: list[np.ndarray], rows: int = 65536):
    for a in range(0, len(cols[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + rows].astype(f.type.to_pandas_dtype())) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _numbers(spark: SparkSession) -> DataFrame:
    """Per band: its highest size and its instance's parts (some ninety rows); with no parts, one shared single shingle is due."""
    return constants(spark, [*((i, _HIGH[i], parts(i)) for i in range(len(_HIGH))), (DIRECT, 0, 0)], "inst long, high long, parts long")


def families(sets: DataFrame, met: DataFrame) -> DataFrame:
    """(v: class, root: family, rep: least key of the class) for all classes that may be linked to another."""
    numbers = F.broadcast(_numbers(sets.sparkSession))  # a fixed table
    wide = met.where("kind = 1").join(numbers, "inst")
    within = F.col("na") <= F.col("high")  # the instance is that of the class's own band, else the lower one's
    none = F.lit(0).cast("long")
    # Per class the parts of its two instances that prove nothing: weak ones and those with widely shared signatures.
    counted = sets.where("n > 0").select(F.col("h1").alias("v"), F.col("k").alias("rep"), "e0", "e1", none.alias("w0"), none.alias("w1")).union(
        wide.where(F.col("inst") != DIRECT).select("a", F.lit(None).cast("long"), none, none, within.cast("long"), (~within).cast("long"))
    )
    info = settled(counted.groupBy("v").agg(F.min("rep").alias("rep"), (F.max("e0") + F.sum("w0")).alias("p0"), (F.max("e1") + F.sum("w1")).alias("p1")))
    weak = info.select("v", "p0", "p1")
    # A pair is looked up from both its sides and put together again, which takes one join.
    pairs = met.where("kind = 0")
    both = pairs.withColumn("side", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("na").alias("m")), F.struct(F.col("b").alias("v"), F.col("nb").alias("m")))))
    both = both.select("a", "b", "na", "nb", "inst", "c", "side.v", "side.m").join(numbers, "inst").join(weak, "v")
    proves = F.when(F.col("m") <= F.col("high"), F.col("p0")).otherwise(F.col("p1"))
    found = both.groupBy("a", "b", "na", "nb", "inst", "parts").agg((F.sum("c") / 2).alias("c"), F.min(proves).alias("weak"))
    strong = found.where(F.col("c") >= F.col("parts") - F.floor((F.col("na") + F.col("nb")) / 18) - F.col("weak")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Classes whose weak parts and widely shared signatures could be all that they have in common with a linked one.
    partner = F.when(within, F.floor(F.col("na") * 5 / 4)).otherwise(F.col("high"))
    due = F.col("parts") - F.floor((F.col("na") + partner) / 18)
    risky = wide.join(weak.withColumnRenamed("v", "a"), "a").where(due <= F.when(within, F.col("p0")).otherwise(F.col("p1"))).select("a", "s")
    least = risky.groupBy("s").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("g")).where("g > 1").select("s", "m")
    # A class is tied to the least of its groups' least classes, and these among each other: an edge a class, not one a signature.
    tied = risky.join(least, "s").groupBy("a").agg(F.min("m").alias("v"), F.collect_set("m").alias("ms"))
    ties = tied.select(F.explode(F.concat("ms", F.array("a"))).alias("u"), "v").where("u <> v")
    return connected_components(strong.union(ties)).join(info.select("v", "rep"), "v")


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _union(n: int, links) -> list[int]:
    root = list(range(n))
    for a, b in links:
        a, b = _find(root, a), _find(root, b)
        root[max(a, b)] = min(a, b)
    return [_find(root, x) for x in range(n)]


def _compare(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Linked pairs among a few sets."""
    n = [len(s) for s in sets]
    if len(sets) <= 8:
        return [(i, j) for j in range(len(sets)) for i in range(j) if 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), n[i], n[j])]
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    column = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
    inter = np.zeros((len(sets), len(sets)), np.float32)
    step = 1 << 13
    for c in range(0, int(column[-1]) + 1, step):
        a, z = np.searchsorted(column, (c, c + step))
        x = np.zeros((len(sets), step), np.float32)
        x[who[a:z], column[a:z] - c] = 1
        inter += x @ x.T
    size = np.array(n)
    i, j = np.nonzero(np.triu(linked(np.rint(inter).astype(np.int64), size[:, None], size[None, :]), 1))
    return list(zip(i.tolist(), j.tolist(), strict=True))


def _members(docs: DataFrame, key: str, text: str, chosen: DataFrame) -> DataFrame:
    """(root, v, n, f: sorted hashes, size, rep) of the classes in ``chosen`` (v, root, rep, size), read again from their representatives' texts."""

    def read(batches):
        for b in batches:
            keep, sizes, bodies = [], [], []
            for row, (u, v) in enumerate(zip(shingle_sets(*utf8(b.column(2))), b.column(1).to_pylist(), strict=True)):
                if len(u) and _class(u)[0] == v:  # a repeated key may stand for another text
                    keep.append(row)
                    sizes.append(len(u))
                    bodies.append(u.tobytes())
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary()), part.column(3), part.column(4)], names=["root", "v", "n", "f", "size", "rep"])

    rows = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t")).join(chosen, "rep").select("root", "v", "t", "size", "rep")
    return rows.mapInArrow(read, "root long, v long, n long, f binary, size long, rep long")


def _small_families(members: DataFrame) -> DataFrame:
    """(v, component: least key) of families that a task compares whole."""

    def solve(batches):
        root, vs, sets, reps = None, [], [], []

        def done():
            own = dict(zip(vs, sets, strict=True))  # repeated rows of a representative
            rep = dict(zip(vs, reps, strict=True))
            names = sorted(own)
            comps = _union(len(names), _compare([own[v] for v in names]))
            least: dict[int, int] = {}
            for c, v in zip(comps, names, strict=True):
                least[c] = min(rep[v], least.get(c, rep[v]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([least[c] for c in comps], pa.int64())], names=["v", "component"])

        for b in batches:
            for r, v, f, k in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if r != root:
                    if vs:
                        yield done()
                    root, vs, sets, reps = r, [], [], []
                vs.append(v)
                sets.append(np.frombuffer(f, np.uint64))
                reps.append(k)
        if vs:
            yield done()

    return members.select("root", "v", "f", "rep").repartition("root").sortWithinPartitions("root").mapInArrow(solve, "v long, component long")


def _probe(batches):
    """Per cell of a family, its pivots first: (u: class, v: pivot) of classes that link to one, and what connects the pivots."""
    cell, names, sets, index, up = None, [], [], None, []

    def links(us, vs):
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    def tree():
        return links(*zip(*((names[x], names[y]) for x, y in enumerate(up) if x != y), strict=True)) if any(x != y for x, y in enumerate(up)) else None

    for b in batches:
        us, vs = [], []
        for root, salt, kind, v, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (root, salt) != cell:
                if up and (t := tree()):
                    yield t
                cell, names, sets, index, up = (root, salt), [], [], None, []
            u = np.frombuffer(f, np.uint64)
            if kind == PIVOT:
                names.append(v)
                sets.append(u)
                continue
            if index is None:
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                n = np.array([len(x) for x in sets], np.int64)
                order = np.argsort(values, kind="stable")
                index, up = (values[order], np.repeat(np.arange(len(sets)), n)[order], n), list(range(len(sets)))
            values, who, n = index
            if not len(n):
                continue
            a, z = np.searchsorted(values, u), np.searchsorted(values, u, "right")
            span = z - a
            at = np.repeat(a - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
            near = np.flatnonzero(linked(np.bincount(who[at], minlength=len(n)), len(u), n)).tolist()
            # A class links to one of its pivots; that these are all connected is told once a cell.
            for p in near[1:]:
                x, y = _find(up, near[0]), _find(up, p)
                up[max(x, y)] = min(x, y)
            if near:
                us.append(v)
                vs.append(names[near[0]])
        yield links(us, vs)
    if up and (t := tree()):
        yield t


def _large_families(members: DataFrame, classes: int, pivots: int, pivot_bytes: int, dealt: int) -> DataFrame:
    """(v, component: least key) of families of any size, ``classes`` in all, by rounds of pivots.

    A round compares some classes of each unfinished family with all its
    classes: these are dealt to cells, and each cell gets the pivots' sets.  A
    family is finished when all its classes outside its largest component have
    been pivots; then every pair of different components has been compared.
    """
    once = members.groupBy("root", "v").agg(*(F.first(c).alias(c) for c in ("n", "f", "size", "rep")))  # a representative's rows may repeat
    cells = F.ceil(F.col("size") / dealt)
    rows = settled(once.select("root", F.pmod(F.xxhash64("v"), cells).alias("salt"), "v", "f", "n", cells.alias("cells"), "rep"))
    few = partitions_for(classes)  # tables of one short row a class need few partitions
    state = settled(rows.select("root", "v", "n", "cells", "rep", F.col("v").alias("comp"), F.lit(False).alias("tried")).coalesce(few))
    turn = 0
    while True:
        rest = state
        if turn:
            sizes = state.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("m")).coalesce(few)
            largest = sizes.groupBy("root").agg(F.max(F.struct("m", "comp")).alias("top")).select("root", F.col("top.comp").alias("top"))
            rest = settled(state.where("not tried").join(largest, "root").where("comp <> top").select("root", "v", "n", "cells").coalesce(few))
            if rest.isEmpty():
                break
        ticket = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        wanted = F.greatest(F.lit(1), F.least(F.lit(pivots if turn else min(FIRST, pivots)), F.floor(F.lit(pivot_bytes / 8) / F.max("n"))))
        left = rest.groupBy("root").agg(F.count(F.lit(1)).alias("left"), F.min_by("v", ticket).alias("first"), wanted.alias("wanted"))
        drawn = (F.col("v") == F.col("first")) | (ticket * F.col("left") <= F.col("wanted"))
        picked = settled(rest.join(left, "root").where(drawn).select("root", "v", "cells").coalesce(few))
        places = picked.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("place"))
        dealt_out = rows.join(places, "v").select("root", F.col("place").alias("salt"), F.lit(PIVOT).alias("kind"), "v", "f")
        # A finished family has no pivots, so its sets stay where they are.
        open_ = rows.join(picked.select("root").distinct(), "root", "left_semi").select("root", "salt", F.lit(MEMBER).alias("kind"), "v", "f")
        links = dealt_out.union(open_).repartition("root", "salt").sortWithinPartitions("root", "salt", "kind").mapInArrow(_probe, "u long, v long").where("u <> v")
        if classes <= TOGETHER:
            # A round has a link a class and the pivots' at most, so these and what was known are joined up in one task.
            joined = joined_up(settled(links).union(state.select("v", "comp"))).select("v", F.col("root").alias("to"))
        else:
            comps = state.select("v", "comp")
            ends = links.join(comps.select(F.col("v").alias("u"), F.col("comp").alias("a")), "u").join(comps.withColumnRenamed("comp", "b"), "v")
            joined = connected_components(ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
            joined = comps.join(joined.select(F.col("v").alias("comp"), F.col("root").alias("to")), "comp").select("v", "to")
        now = state.join(joined, "v", "left").join(picked.select("v", F.lit(True).alias("now")), "v", "left")
        state = settled(now.select("root", "v", "n", "cells", "rep", F.coalesce("to", "comp").alias("comp"), (F.col("tried") | F.col("now").isNotNull()).alias("tried")).coalesce(few))
        turn += 1
    least = state.groupBy("comp").agg(F.min("rep").alias("component")).coalesce(few)
    return state.join(least, "comp").select("v", "component")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", cold: int = COLD, family: int = FAMILY, pivots: int = PIVOTS, pivot_bytes: int = PIVOT_BYTES, dealt: int = DEALT) -> DataFrame:
    """One row per document: key, n_shingles and component_id, the least key that links reach.

    Null texts and texts without words have no shingles and link with nothing;
    repeated rows are one class, and rows that repeat a key have one name.  A
    null key gets a row with a null component and links nothing.  Texts of any
    length are read whole.  Empty tables give none.  Other columns are left out,
    whatever their names.
    """
    small_batches(docs.sparkSession)
    sets = settled(_sets(docs, key, text))
    own = sets.where("k is not null")
    met = settled(_candidates(_signatures(docs.where(F.col(key).isNotNull()), text), cold))
    classes = own.where("n > 0").groupBy("h1", "h2").agg(F.min("k").alias("rep"))
    fams = settled(families(own, met))
    # Families are told apart by size before their sets are read, so that no set moves for it.
    wide = settled(fams.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > family))
    chosen = fams.join(wide, "root", "left").select("root", "v", "rep", F.coalesce("size", F.lit(0)).alias("size"))
    members = settled(_members(docs, key, text, chosen))
    comps = _small_families(members.where("size = 0"))
    in_wide = wide.agg(F.sum("size").alias("n")).head().n
    if in_wide:
        comps = comps.union(_large_families(members.where("size > 0"), in_wide, pivots, pivot_bytes, dealt))
    by_class = settled(comps).withColumnRenamed("v", "h1")
    placed = classes.join(by_class, "h1", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    # Texts without words have null hashes; joined, they would all meet in one task.
    some = sets.where("n > 0").join(placed, ["h1", "h2"], "left").select("k", "n", "component")
    out = some.union(sets.where("n = 0").select("k", "n", F.lit(None).cast("long")))
    component = F.when(F.col("k").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
