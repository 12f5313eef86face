"""Exact duplicates by Patricia tries.

Map tasks fold the equal texts they see into one row each (again after every
``FOLD_BYTES`` of different ones), so a hot text costs a reducer few rows a task.  Rows are dealt by (length, content hash);
each partition inserts the full byte strings into a compressed radix trie whose
terminal nodes keep the owner and the number of copies.  A trie that outgrows
its memory bound moves its largest subtrees to files, and resolves them one by
one at the end.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of text that one trie holds before it spills a subtree.
TRIE_BYTES = 64 << 20
#: Distinct texts of a map task that are held to be folded (bytes).
FOLD_BYTES = 16 << 20


class _Node:
    __slots__ = ("label", "children", "value", "file")

    def __init__(self, label: bytes):
        self.label, self.children, self.value, self.file = label, {}, None, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix; halving keeps the work in bytes comparisons."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Compressed radix trie from byte strings to merged values, which spills by subtree."""

    def __init__(self, merge, limit: int = TRIE_BYTES):
        self.root, self.merge, self.limit, self.held = _Node(b""), merge, limit, 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                child.value = value
                self.held += len(key) - at + 200
                if self.held > self.limit:
                    self._spill()
                return
            if child.file is not None:
                pickle.dump((key, value), child.file)
                return
            n = len(child.label)
            if key.startswith(child.label, at):
                node, at = child, at + n
                continue
            n = _common(child.label, key[at : at + n])
            upper = _Node(child.label[:n])
            child.label = child.label[n:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            node, at = upper, at + n
            self.held += 200

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.value is not None:
                yield prefix, node.value
            stack += [(c, prefix + c.label) for c in node.children.values() if c.file is None]

    @staticmethod
    def _files(node: _Node) -> Iterator:
        stack = [node]
        while stack:
            for c in stack.pop().children.values():
                if c.file is None:
                    stack.append(c)
                else:
                    yield c.file

    def _spill(self) -> None:
        """Move the subtrees below the root's branches to files until a quarter of the bound is held."""
        node = self.root
        prefix = b""
        while len(node.children) == 1 and node.value is None:  # a stem that all strings share
            node = next(iter(node.children.values()))
            prefix += node.label
        sizes = []
        for branch, child in node.children.items():
            if child.file is None:
                sizes.append((sum(len(k) + 200 for k, _ in self._walk(child, prefix + child.label)), branch))
        for size, branch in sorted(sizes, reverse=True):
            if self.held <= self.limit // 4:
                break
            child = node.children[branch]
            spilled = _Node(child.label)
            spilled.file = tempfile.TemporaryFile()
            for entry in self._walk(child, prefix + child.label):
                pickle.dump(entry, spilled.file)
            for f in self._files(child):  # what it had spilled before
                with f:
                    f.seek(0)
                    shutil.copyfileobj(f, spilled.file)
            node.children[branch] = _Node(child.label[:1])
            node.children[branch].file = spilled.file
            self.held = max(0, self.held - size)

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every string once, spilled subtrees after the rest."""
        yield from self._walk(self.root, b"")
        stack = [self.root]
        while stack:
            for child in stack.pop().children.values():
                if child.file is None:
                    stack.append(child)
                    continue
                # A subtree that is still too large gets halved bounds no more: it spills deeper by itself.
                sub = PatriciaTrie(self.merge, self.limit)
                with child.file as f:
                    f.seek(0)
                    while f.tell() < os.fstat(f.fileno()).st_size:
                        sub.insert(*pickle.load(f))
                yield from sub.items()


def _merge_with(keep):
    return lambda a, b: (keep(a[0], b[0]), a[1] + b[1])


def _lower(x: str | None) -> bytes:
    return (x or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() maps A-Z only


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else None


def owners(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: n_bytes, text_sha256, keep_id, group_size."""
    pick = {"largest": max, "smallest": min}[keep]
    small_batches(docs.sparkSession)
    folded = pa.schema([("n", pa.int64()), ("h", pa.int64()), ("body", pa.binary()), ("id", pa.int64()), ("c", pa.int64())])
    found = pa.schema([("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def fold(batches):
        held: dict[bytes, tuple[int, int]] = {}
        size = 0

        def flush():
            rows = [(len(k), int.from_bytes(hashlib.sha256(k).digest()[:8], "big", signed=True), k, *v) for k, v in held.items()]
            return _batches(rows, folded)

        merge = _merge_with(pick)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = _lower(t)
                if (old := held.get(k)) is not None:
                    held[k] = merge(old, (i, 1))
                else:
                    held[k] = (i, 1)
                    size += len(k) + 100
            if size > FOLD_BYTES:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    def resolve(batches):
        trie = PatriciaTrie(_merge_with(pick), trie_bytes)
        for b in batches:
            for k, i, m in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                trie.insert(k, (i, m))
        out = []
        for k, (i, m) in trie.items():
            out.append((len(k), hashlib.sha256(k).hexdigest(), i, m))
            if len(out) >= 4096:
                yield _batches(out, found)
                out = []
        if out:
            yield _batches(out, found)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    dealt = rows.where("id is not null").mapInArrow(fold, "n long, h long, body binary, id long, c long").repartition("n", "h")
    return dealt.mapInArrow(resolve, "n_bytes long, text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty
    text.  ``keep`` names the surviving key of a group ("largest" or
    "smallest").  Rows that repeat key and text share that verdict; rows with a
    null key own nothing and are kept only if no group has their text (group
    size null then).  Texts of any length are compared whole; an empty table
    gives none.  Other columns pass through, whatever their names; columns of
    the names added here are replaced.
    """
    small_batches(docs.sparkSession)
    added = ["keep_id", "group_size", "kept", "text_sha256"]

    def digests(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            yield b.append_column("text_sha256", pa.array([hashlib.sha256(_lower(t)).hexdigest() for t in texts], pa.string()))

    base = docs.drop(*added)
    schema = ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", text_sha256 string"
    hashed = base.mapInArrow(digests, schema)
    # A hot text's rows are on one side of this join only, where Spark splits skewed partitions.
    out = hashed.join(owners(docs, key, text, keep, trie_bytes).drop("n_bytes"), "text_sha256", "left")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("keep_id"), F.col("keep_id").isNull()))


def dedup_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """``exact_dedup`` without the other columns: its digest pass sends no text on."""
    small_batches(docs.sparkSession)

    def digests(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(_lower(t)).hexdigest() for t in b.column(1).to_pylist()], pa.string())], names=["id", "text_sha256"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(digests, "id long, text_sha256 string")
    out = rows.join(owners(docs, key, text, keep).drop("n_bytes"), "text_sha256", "left")
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select(F.col("id").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
