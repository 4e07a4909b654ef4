"""N-gram Jaccard join (1): multiple-global-order prefix filtering.

Two texts link when 100 * |A & B| >= threshold * |A | B| over their distinct word
shingles.  Texts with equal sets form one class, linked by definition; everything
below works between classes.

1. *Profile.* One pass gives each text's set size and a 128-bit key of its set, and
   a count sketch of all shingles: two rows of 2^20 to 2^22 counters, by the size of the
   input, summed slice by slice.
2. *Orders.* Every order puts shingles of a lower sketched count class first and
   breaks ties by a hash of its own.  A sketch error only changes the order, never
   the result: any fixed order gives a complete prefix filter.
3. *Postings.* The first n - ceil(t n) + 1 shingles of each class under the first
   order, with their positions.  Shingles that the sketch shows in very many
   texts are dealt over several tasks.
4. *Candidates.* Classes that share a prefix shingle and pass the length and position
   bounds.  Blocks (the classes of one shingle) of up to ``PAIR_BLOCK`` classes emit
   pairs; of these, those stay whose prefixes share a shingle under every other order, too
   (32 bits of each shingle are compared), and that pass a parity bitmap of the two sets, whose differing bits
   never outnumber the shingles that only one set has.  Larger blocks emit few edges,
   at most one per class: the components of their candidate pairs, or a star above
   ``SMALL_BLOCK`` classes.  The components of all edges are the candidate groups; no
   link crosses them.
5. *Intersection and verification.* Within a group, a pair must share a prefix shingle
   under every order; only pairs that pass are counted exactly on the sets: a few by merging, many by
   a product over just the sets that have such a pair.  A group is cut in
   chunks of bounded size, and pairs of chunks are counted together, in one product:
   first each chunk with itself and with the group's first chunk, then, where a group
   still has several components, what lies outside its largest with all.  Tasks emit
   a spanning forest of the links found, never the pairs.
6. *Components* of the links, with the smallest doc_id as the name.

Defined cases: a null text is empty; a text without words has an empty set and links
with nothing (its component is its own doc_id); a text with fewer words than a
shingle has its whole sequence as one; rows that repeat a doc_id are separate texts
under one id, so their links join; a null doc_id is returned with a null component
and links nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, ROWS_A_FILE, Workspace, connected_components, documents, lean, numbered, shuffle_partitions, without
from .shingles import mix, shingle_sets, text_blocks

WIDTH = 4
THRESHOLD = 85
SKETCH_BITS = (20, 22)
CELL_BYTES = 1536  # of text for a counter of one row
SLICES = 32
ORDERS = 3
SMALL_BLOCK = 512
PAIR_BLOCK = 64
MAX_BITS = 1 << 16
TINY_BLOCK = 8
HOT_COUNT = 4096
CHUNK = 256

_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def sketch_size(docs: DataFrame) -> int:
    """Counters of the sketch by the planner's estimate of the input; any number gives the same links."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least, most = SKETCH_BITS
    bits = least if size >= 1 << 60 else (size // CELL_BYTES).bit_length()  # so large: not known
    return 2 << min(most, max(least, bits))


def _sketch_cells(shingles: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    half = size // 2
    mask = np.uint64(half - 1)
    return ((shingles >> np.uint64(8)) & mask).astype(np.int64), ((shingles >> np.uint64(34)) & mask).astype(np.int64) + half


def _count(sketch: np.ndarray, sets: list[np.ndarray]) -> None:
    half = len(sketch) // 2
    for i, cells in enumerate(_sketch_cells(np.concatenate(sets), len(sketch))):
        sketch[i * half:(i + 1) * half] += np.bincount(cells - i * half, minlength=half).astype(np.int32)


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


class Orders:
    """Global orders of shingles, from the summed sketch."""

    def __init__(self, sketch: np.ndarray):
        self.sketch = sketch
        self.mean = sketch.sum(dtype=np.int64) / len(sketch)
        self.spread = max(self.mean ** 0.5, 0.5)

    def count(self, shingles: np.ndarray) -> np.ndarray:
        """Upper estimates of how many sets hold each shingle, in spreads of the sketch above its mean."""
        one, two = _sketch_cells(shingles, len(self.sketch))
        return (np.minimum(self.sketch[one], self.sketch[two]) - self.mean) / self.spread

    def keys(self, shingles: np.ndarray, counts: np.ndarray):
        """For each order the shingles' sort keys: count class, then the order's hash."""
        near = np.clip(np.floor(2 * (counts + 4)), 0, 24)
        far = 24 + np.floor(np.log2(np.maximum(counts, 8.0) / 8.0) * 2)
        classes = np.minimum(np.where(counts > 8, far, near), 63).astype(np.uint64) << np.uint64(58)
        for seed in _SEEDS[:ORDERS]:
            yield classes | (mix(shingles ^ seed) >> np.uint64(6))


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def _first(keys: np.ndarray, p: int) -> np.ndarray:
    """Indices of the p smallest keys in ascending order."""
    part = np.argpartition(keys, p - 1)[:p] if p < len(keys) else np.arange(len(keys))
    return part[np.argsort(keys[part], kind="stable")]


def profile(docs: DataFrame, ws: Workspace, width: int) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, n, key, k) of every row, the summed sketch); k is the key's first half as a number."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("k", pa.int64()),
                        ("slice", pa.int32()), ("cells", pa.binary())])
    size = sketch_size(docs)

    @lean
    def run(batches):
        sketch, held = np.zeros(size, np.int32), []
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                held += sets
                if sum(map(len, held)) > 1 << 19:
                    _count(sketch, held)
                    held = []
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array([key and short(key) for key in keys], pa.int64()),
                     pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=schema)
        if held:
            _count(sketch, held)
        if sketch.any():  # a task's counters stop at 65,535, which only changes the order
            parts = np.minimum(sketch, (1 << 16) - 1).astype("<u2").reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()),
                 pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    both = ws.save(docs.mapInArrow(run, "doc_id long, n long, key binary, k long, slice int, cells binary"), "profile")
    sums = both.where("slice IS NOT NULL").select("slice", "cells").repartition(SLICES, "slice").mapInArrow(_add_slices, "slice int, cells binary")
    sketch = np.zeros((SLICES, size // SLICES), np.int64)
    for r in sums.toLocalIterator():  # SLICES rows, 64 MB at most
        sketch[r["slice"]] += np.frombuffer(bytes(r["cells"]), "<i8")
    sketch = np.minimum(sketch, (1 << 31) - 1).astype(np.int32).reshape(-1)
    return both.where("slice IS NULL").select("doc_id", "n", "key", "k"), sketch


def _add_slices(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cells = np.frombuffer(raw, "<u2").astype(np.int64)
            sums[k] = sums[k] + cells if k in sums else cells
    yield pa.RecordBatch.from_pydict({"slice": list(sums), "cells": [x.astype("<i8").tobytes() for x in sums.values()]},
                                     schema=pa.schema([("slice", pa.int32()), ("cells", pa.binary())]))


def postings(docs: DataFrame, sketch: np.ndarray, width: int, threshold: int) -> DataFrame:
    """(token, salt, k, n_pos): prefix shingles of each class under the first order.

    k is the first half of the class's key, n_pos its set size and the shingle's
    position.  Copies within one task are listed once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("k", pa.int64()), ("n_pos", pa.int64())])

    @lean
    def run(batches):
        orders, done = Orders(shared.value), set()
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(1)):
                out = []
                for s in shingle_sets(data, offsets, width):
                    if not len(s):
                        continue
                    k = short(set_key(s))
                    if k in done:
                        continue
                    done.add(k)
                    p = prefix_length(len(s), threshold)
                    counts = orders.count(s)
                    at = _first(next(orders.keys(s, counts)), p)
                    over = np.maximum(counts[at] * orders.spread, 0).astype(np.int64) // HOT_COUNT
                    salt = np.where(over > 0, 1 + (k & 0xFFFFFF) % (over + 1), 0)
                    out.append((s[at].view(np.int64), salt, np.full(p, k), (len(s) << 32) + np.arange(p)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([o[i] for o in out]), kind) for i, kind in enumerate(schema.types)], schema=schema)

    return docs.mapInArrow(run, "token long, salt int, k long, n_pos long")


def _components_of(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric matrix."""
    root = np.arange(len(linked))
    todo = linked.any(1)
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        mine = np.zeros(len(linked), bool)
        front = np.array([i])
        while len(front):
            mine[front] = True
            front = np.flatnonzero(linked[front].any(0) & ~mine)
        root[mine] = i
        todo &= ~mine
    return root


def block_edges(posts: DataFrame, parts: int, threshold: int) -> DataFrame:
    """(kind, a, b): 0 candidate pairs, 1 edges of large blocks, 2 (token, class) of blocks dealt over tasks."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def may_link(n, pos, x, y):
        """Length and position bounds of pairs (x, y) with n[x] <= n[y]."""
        need = -(-threshold * (n[x] + n[y]) // (100 + threshold))
        return (100 * n[x] >= threshold * n[y]) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need)

    @lean
    def run(batches):
        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held)
        token, salt, k, n_pos = (table.column(i).to_numpy() for i in range(4))
        order = np.lexsort((k, n_pos >> 32, salt, token))
        token, salt, k, n_pos = token[order], salt[order], k[order], n_pos[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        same = np.zeros(len(token), bool)  # copies from other tasks
        same[1:] = ~new[1:] & (k[1:] == k[:-1])
        keep = ~same
        token, salt, k, n_pos, new = token[keep], salt[keep], k[keep], n_pos[keep], new[keep]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(new)))
        n, pos = n_pos >> 32, n_pos & 0xFFFFFFFF
        dealt = salt[begin] > 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        wide: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(2, TINY_BLOCK + 1):
            at = begin[(size == s) & ~dealt]
            if len(at):
                i, j = np.triu_indices(s, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = may_link(n, pos, x, y)
                found.append((k[x[ok]], k[y[ok]]))
        for b, s in zip(begin[(size > TINY_BLOCK) & ~dealt].tolist(), size[(size > TINY_BLOCK) & ~dealt].tolist(), strict=True):
            if s <= SMALL_BLOCK:
                rows = np.arange(b, b + s)
                ok = np.triu(may_link(n, pos, rows[:, None], rows[None, :]), 1)
                if s <= PAIR_BLOCK:
                    x, y = np.nonzero(ok)
                    found.append((k[b + x], k[b + y]))
                else:
                    root = _components_of(ok | ok.T)
                    wide.append((k[b + root], k[rows]))
            else:
                wide.append((np.full(s, k[b]), k[b:b + s]))
        for b, s in zip(begin[dealt].tolist(), size[dealt].tolist(), strict=True):
            wide.append((np.full(s, k[b]), k[b:b + s]))

        def distinct(edges):
            edges = np.concatenate([np.stack(f) for f in edges], axis=1) if edges else np.empty((2, 0), np.int64)
            return np.unique(np.sort(edges[:, edges[0] != edges[1]], axis=0), axis=1)

        heads = begin[dealt]
        for kind, a, b in ((0, *distinct(found)), (1, *distinct(wide)), (2, token[heads], k[heads])):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a), pa.array(b)], schema=schema)

    return posts.repartition(parts, "token", "salt").mapInArrow(run, "kind int, a long, b long")


def _rows_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text, class_key, ...) of the representatives' rows.

    The representatives are counted first; up to ``BROADCAST_IDS`` are broadcast, so
    that texts don't move, and more are joined by shuffle.
    """
    wanted = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    others = [c for c in reps.columns if c not in ("rep", "class_key")]
    return docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("rep", "text", "class_key", *others)


def _sets_of(batch, width: int):
    """(places, sets) of a batch of _rows_of; of rows repeating a doc_id only those of the class."""
    keys = batch.column(2).to_pylist()
    for row, data, offsets in text_blocks(batch.column(1)):
        sets = shingle_sets(data, offsets, width)
        mine = [i for i, s in enumerate(sets) if set_key(s) == keys[row + i]]
        yield pa.array([row + i for i in mine], pa.int64()), [sets[i] for i in mine]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each of about n bits."""
    bits = min(MAX_BITS, max(64, 1 << (len(shingles) - 1).bit_length()))
    return (np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ; the longer one is folded to the shorter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.count_nonzero(a != b))


def class_filters(docs: DataFrame, reps: DataFrame, sketch, width: int, threshold: int) -> DataFrame:
    """(k, n, bits, prefixes) of the representatives (rep, class_key).

    ``prefixes`` holds 32 bits of each prefix shingle, for every order but the first, one after the other.
    """
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("prefixes", pa.binary())])

    @lean
    def run(batches):
        orders = Orders(sketch.value)

        def prefixes(shingles: np.ndarray) -> bytes:
            p = prefix_length(len(shingles), threshold)
            keys = list(orders.keys(shingles, orders.count(shingles)))[1:]
            return b"".join(shingles[_first(k, p)].astype("<u4").tobytes() for k in keys)

        for batch in batches:
            for _, sets in _sets_of(batch, width):
                yield pa.RecordBatch.from_pydict(
                    {"k": [short(set_key(s)) for s in sets], "n": [len(s) for s in sets],
                     "bits": [np.packbits(bitmap(s)).tobytes() for s in sets], "prefixes": [prefixes(s) for s in sets]}, schema=schema)

    return _rows_of(docs, reps).mapInArrow(run, "k long, n long, bits binary, prefixes binary")


def sharing(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Whether the prefixes of each pair share a shingle under every order but the first."""
    out = np.ones(len(left), bool)
    for order in range(ORDERS - 1):
        sides = []
        for side in (left, right):
            parts = [p[len(p) // (ORDERS - 1) * order: len(p) // (ORDERS - 1) * (order + 1)] for p in side]
            owner = np.repeat(np.arange(len(side), dtype=np.uint64), [len(p) // 4 for p in parts])
            sides.append(np.unique(owner << np.uint64(32) | np.frombuffer(b"".join(parts), "<u4")))
        both = np.intersect1d(*sides, assume_unique=True) >> np.uint64(32)
        met = np.zeros(len(left), bool)
        met[both.astype(np.int64)] = True
        out &= met
    return out


def pass_filters(pairs: DataFrame, filters: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that share prefix shingles under all orders and may be close enough by their bitmaps."""
    left = filters.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"), F.col("prefixes").alias("pa"))
    right = filters.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"), F.col("prefixes").alias("pb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bits_a", "bits_b", "pa", "pb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def run(batches):
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                a, b, na, nb, x, y, p, q = (c.to_pylist() for c in whole.slice(lo, 1024).columns)
                keep = []
                for i in np.flatnonzero(sharing(p, q)).tolist():
                    need = -(-threshold * (na[i] + nb[i]) // (100 + threshold))
                    u, v = (np.unpackbits(np.frombuffer(z[i], np.uint8)) for z in (x, y))
                    if differing(u, v) <= na[i] + nb[i] - 2 * need:
                        keep.append(i)
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep]), pa.array([b[i] for i in keep])], schema=schema)

    return rows.mapInArrow(run, "a long, b long")


def class_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(grp, chunks, chunk, rep, shingles) of the representatives (rep, class_key, grp, m)."""
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    rows = _rows_of(docs, reps).select("rep", "text", "class_key", "grp", chunks.alias("chunks"),
                                       F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk"))
    schema = pa.schema([("grp", pa.int64()), ("chunks", pa.int32()), ("chunk", pa.int32()), ("rep", pa.int64()), ("shingles", pa.binary())])

    @lean
    def run(batches):
        for batch in batches:
            for at, sets in _sets_of(batch, width):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in (3, 4, 5, 0)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "grp long, chunks int, chunk int, rep long, shingles binary")


def _overlaps(sets: list[np.ndarray], left: slice, right: slice) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, rows = tokens[order], rows[order]
    new = np.append(True, tokens[1:] != tokens[:-1])
    number = np.cumsum(new) - 1
    many = np.bincount(number) > 1
    pick = many[number]
    rows, number = rows[pick], (np.cumsum(many) - 1)[number[pick]]
    total = np.zeros((len(range(len(sets))[left]), len(range(len(sets))[right])), np.float64)
    step = 2048
    cut = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + step, step))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            dense = np.zeros((len(sets), step), np.float32)
            dense[rows[a:b], number[a:b] % step] = 1
            total += dense[left] @ dense[right].T
    return total


def _pair_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a[i], b[i]) of sets."""
    used = np.unique(np.concatenate([a, b]))
    distinct, number = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    ends = np.cumsum([len(sets[i]) for i in used])
    numbered = {i: number[e - len(sets[i]): e] for i, e in zip(used.tolist(), ends.tolist(), strict=True)}
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 512):
        sides = []
        for side in (a[lo:lo + 512].tolist(), b[lo:lo + 512].tolist()):
            owner = np.repeat(np.arange(len(side)), [len(numbered[i]) for i in side])
            sides.append(owner * len(distinct) + np.concatenate([numbered[i] for i in side]))
        both = np.intersect1d(*sides, assume_unique=True) // len(distinct)
        out[lo:lo + 512] = np.bincount(both, minlength=len(a[lo:lo + 512]))
    return out


def passing_counts(sets: list[np.ndarray], may: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, intersection sizes) of the pairs that ``may`` marks; its columns are sets[m:].

    Few pairs are counted by merging their sets, many by a product over the sets that have a marked pair.
    """
    a, column = np.nonzero(may)
    b = column + m
    a, b = a[a < b], b[a < b]
    if not len(a):
        return a, b, a
    size = np.array([len(s) for s in sets])
    rows, columns = np.unique(a), np.unique(b)
    if 16 * (size[a] + size[b]).sum() <= len(rows) * len(columns) * size[np.union1d(rows, columns)].max():
        return a, b, _pair_counts(sets, a, b)
    both = _overlaps([sets[i] for i in rows] + [sets[i] for i in columns], slice(0, len(rows)), slice(len(rows), None))
    return a, b, both[np.searchsorted(rows, a), np.searchsorted(columns, b)]


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> list[int]:
    """Indices of pairs that form a spanning forest."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i, (a, b) in enumerate(zip(pairs_a.tolist(), pairs_b.tolist(), strict=True)):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            out.append(i)
    return out


def verify_chunks(rows: DataFrame, sketch, threshold: int, inside: bool) -> DataFrame:
    """(a, b) links within each task of rows (task, side, rep, n, shingles).

    Side 0 rows are compared with side 1 rows; with ``inside`` also side 1 rows with
    each other.  A task has about two chunks of rows at most.
    """
    def run(table):
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        side = side[order]
        reps = table.column("rep").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        m = int((side == 0).sum())
        left = slice(0, len(sets)) if inside else slice(0, m)
        right = slice(m, len(sets))
        orders = Orders(sketch.value)
        prefixes: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
        for s in sets:
            p = prefix_length(len(s), threshold)
            for held, keys in zip(prefixes, orders.keys(s, orders.count(s)), strict=True):
                held.append(s[_first(keys, p)])
        may = None
        for held in prefixes:
            shared = _overlaps(held, left, right) > 0
            may = shared if may is None else may & shared
        a, b, both = passing_counts(sets, may, m)
        n = np.array([len(s) for s in sets])
        linked = 100 * both >= threshold * (n[a] + n[b] - both)
        a, b = a[linked], b[linked]
        keep = _forest(a, b, len(sets))
        x, y = reps[a[keep]], reps[b[keep]]
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def group_links(ws: Workspace, rows: DataFrame, sketch, threshold: int) -> DataFrame:
    """Links within the candidate groups of rows (grp, chunks, chunk, rep, shingles), as a spanning set."""
    # first: every chunk with itself and with chunk 0
    to = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = rows.select("grp", "rep", "shingles", "chunk", F.explode(to).alias("other"))
    first = first.select(F.struct("grp", F.lit(0).alias("i"), F.col("other").alias("j")).alias("task"),
                         (F.col("chunk") == F.col("other")).cast("int").alias("side"), "rep", "shingles")
    links = ws.save(verify_chunks(first, sketch, threshold, True), "links-0")
    cut = ws.save(rows.where("chunks > 1"), "cut")
    if cut.isEmpty():
        return links
    # then: what is outside a group's main component meets all its chunks
    now = connected_components(ws, links, "now").select(F.col("id").alias("rep"), F.col("component").alias("now"))
    cut = ws.save(cut.join(now, "rep", "left").withColumn("now", F.coalesce("now", "rep")), "cut-now")
    sizes = cut.groupBy("grp", "now").agg(F.count(F.lit(1)).alias("s"))
    main = sizes.groupBy("grp").agg(F.max_by("now", F.struct("s", "now")).alias("main"), F.sum("s").alias("m"), F.max("s").alias("most"))
    main = main.where("most < m").select("grp", "main", F.ceil(F.col("m") / CHUNK).cast("int").alias("nc"),
                                         F.ceil((F.col("m") - F.col("most")) / CHUNK).cast("int").alias("oc"))
    main = ws.save(main, "main")
    base = cut.join(main, "grp").select(
        "grp", "rep", "shingles", "nc", "oc", (F.col("now") != F.col("main")).alias("out"),
        F.pmod(F.xxhash64("rep"), F.col("nc")).cast("int").alias("c"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("oc")).cast("int").alias("o"))
    outer = base.where("out").select("grp", "rep", "shingles", F.col("o").alias("i"),
                                     F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("j"), F.lit(0).alias("side"))
    every = base.select("grp", "rep", "shingles", F.explode(F.sequence(F.lit(0), F.col("oc") - 1)).alias("i"),
                        F.col("c").alias("j"), F.lit(1).alias("side"))
    both = outer.unionByName(every).select(F.struct("grp", "i", "j").alias("task"), "side", "rep", "shingles")
    return links.unionByName(ws.save(verify_chunks(both, sketch, threshold, False), "links-1"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_key, component_id."""
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prof, sketch = profile(docs, ws, width)
    classes = prof.where("n > 0 AND doc_id IS NOT NULL").groupBy("key", "k", "n").agg(F.min("doc_id").alias("rep"))
    classes = ws.save(classes, "classes")
    expected = classes.agg(F.sum(F.col("n") * (100 - threshold) / 100 + 1)).first()[0] or 0
    parts = shuffle_partitions(spark, int(expected))
    found = ws.save(block_edges(postings(docs, sketch, width, threshold), parts, threshold), "found")
    dealt = found.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("k"))
    heads = dealt.groupBy("token").agg(F.min("k").alias("head"))
    wide = found.where("kind = 1").select("a", "b").unionByName(
        dealt.join(heads, "token").select(F.col("head").alias("a"), F.col("k").alias("b")))
    pairs = ws.save(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    some = ws.save(classes.join(ids, "k", "left_semi").select("rep", F.col("key").alias("class_key")), "some")
    shared = spark.sparkContext.broadcast(sketch)  # 32 MB at most
    filters = ws.save(class_filters(docs, some, shared, width, threshold), "filters")
    edges = pass_filters(pairs, filters, threshold).unionByName(wide)
    group = connected_components(ws, edges, "groups").select(F.col("id").alias("k"), F.col("component").alias("grp"))
    files = 1 + group.count() // ROWS_A_FILE
    sizes = ws.save(group.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "sizes", files)
    member = ws.save(group.join(sizes, "grp"), "member", files)
    reps = ws.save(classes.join(member, "k").select("rep", F.col("key").alias("class_key"), "grp", "m"), "reps", files)
    links = group_links(ws, ws.save(class_sets(docs, reps, width), "sets"), shared, threshold)
    # classes that share their smallest doc_id (rows repeating an id) meet in that id
    members = prof.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("key") < F.max("key")).alias("several")).where("several")
    repeated = (prof.where("n > 0").join(members, "doc_id", "left_semi").join(classes.select("key", "rep"), "key")
                .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    comp = connected_components(ws, links.unionByName(repeated), "links")
    named = ws.save(classes.join(comp, classes["rep"] == comp["id"], "left")
                    .select("key", F.coalesce("component", "rep").alias("component_id")), "named")
    # what is left to read is the profile and the components
    ws.drop("classes", "found", "pairs", "some", "filters", "sizes", "member", "reps", "sets", "cut", "cut-now", "main", "links-0", "links-1")
    out = prof.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.hex("key").alias("class_key"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_row_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Exactly one row of ``docs`` per component of rows, whatever the ids: the smallest id, null last."""
    ws = Workspace(docs.sparkSession, "rows")
    rows = numbered(ws, docs)
    member = jaccard_components(rows, "__row", text_col, **how).select(F.col("doc_id").alias("__row"), "component_id")
    member = member.join(rows.select("__row", F.col(id_col).cast("long").alias("id")), "__row")
    member = ws.save(member, "member")
    first = F.min(F.struct(F.col("id").isNull(), "id", "__row"))
    best = ws.save(member.groupBy("component_id").agg(first["__row"].alias("best")), "best")
    out = member.join(best, "component_id").where(F.col("__row") != F.col("best")).select(F.col("__row").alias("doc_id"))
    return without(rows, out, "__row").drop("__row")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
