"""N-gram Jaccard self-join with signature trees.

A text's set is its distinct shingles of `size` words (64-bit hashes; of a text
with fewer words, the whole sequence).  Two texts link when the sets' Jaccard
similarity is at least `threshold` percent.

1. Sizes and set hashes.  Texts with equal sets are a class; its smallest id
   stands for it from here on.  Shingles that repeat inside a task are counted,
   and the most frequent of all (a bounded number) go last in the order of shingles.
2. Each set's prefix - a set that is to reach the threshold shares one of its
   first n - ceil(threshold * n) + 1 shingles - deals sets to units: all sets that
   share a prefix shingle are in one unit, named by an id that they have in common
   and about how many they are, so that the many shingles of near copies name one.
   A frequent shingle names its unit itself, so no task ever holds all its texts.
3. Each unit is a signature tree: its leaves are bitmaps of sets, its nodes hold
   OR-combined bitmaps, size ranges, the largest number of shingles that share bits,
   and the component below them if it is one.  A tree is followed against itself
   from the root down; a pair of nodes is left where bitmaps and sizes exclude the
   overlap that a link needs, or where all below is one component already.  Leaves
   that are reached may link and join components at once, so that every link lies
   inside one component of what may link.  (A unit over UNIT texts is one as it is.)
4. Each such component is followed as a tree again, now with the sets themselves:
   leaves that are reached are compared exactly, and what links joins components.

A component over GROUP texts or TOKENS shingles is cut into blocks, which are the
lowest trees.  Then one set of each component of each block goes up to trees of the
next level, until one is left or nothing joins.  Last the blocks' roots are followed
against each other: only pairs of blocks whose root bitmaps and sizes allow a link,
and that are not one component, get their sets again and are followed to the leaves.

Null or empty texts have empty sets and link with nothing; equal texts and
repeated rows link; rows of one id are one document; a row without an id keeps
its size and has no component.  Ids are numbers of 64 bits or their decimal text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm import shared
from siftlake.llm.components import components
from siftlake.llm.text import NONSPACE, Lookup, Words, distinct_sets, mix, ragged, shingles, slices, utf8

SIZE, THRESHOLD = 5, 75
#: Shingles in the table of frequent ones; of these, the count from which one names its unit.
FREQUENT, NAMED = 1 << 20, 256
#: Texts of a unit whose bitmaps make one tree; texts and shingles of a block; children of a node; bits of a set's bitmap and of a block's root.
UNIT, GROUP, TOKENS, FANOUT, MOST_BITS, ROOT_BITS = 2048, 2048, 1 << 20, 8, 1 << 17, 1 << 14
#: Shingles that a task counts before it packs what repeats, and entries that it holds before it packs them.
COUNTED, FLUSH = 1 << 21, 1 << 20
#: Bits of the filter that says which sets are read again; beyond its size a join alone does.
FILTER_BITS = 1 << 28
STEPS, ENTRY, MEMBER = 64, np.dtype([("id", "<i8"), ("size", "<u2")]), np.dtype([("unit", "<i8"), ("id", "<i8")])
_SECOND = np.uint64(0x2545F4914F6CDD1D)


def sets_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*utf8(column), NONSPACE)
    value, owner = shingles(words, words.hashes(), size)
    return distinct_sets(value, owner, len(column))


def set_hashes(value: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for salt in (np.uint64(0), _SECOND):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ salt), dtype=np.uint64)))
            out.append(run[edge[1:]] - run[edge[:-1]])
        return out[0], out[1]


class _Seen:
    """The sets that a task has had since it last packed what it holds."""

    def __init__(self):
        self.keys: set = set()

    def new(self, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n), bool)
        for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
            if n[i] and key not in self.keys:
                self.keys.add(key)
                out[i] = True
        return out


_FIRST = "id long, n long, h1 long, h2 long, sign binary, bucket int, keys binary, values binary, least binary"


def _first_pass(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """A row for each text, and packed rows of the shingles that repeat in a task: how often, and the smallest id."""
    names = [x.split()[0] for x in _FIRST.split(",")]
    types = [pa.int64()] * 4 + [pa.binary(), pa.int32()] + [pa.binary()] * 3
    counted = np.dtype([("n", "<i8"), ("least", "<i8")])

    def flush(kept):
        keys, ids = np.concatenate([k for k, _ in kept]), np.concatenate([i for _, i in kept])
        kept.clear()  # the worker holds these no longer than it must
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(at, len(keys)))
        made = np.empty(len(at), counted)
        made["n"], made["least"] = n, np.minimum.reduceat(ids, at)
        rows = list(shared.bucketed(keys[at][n > 1], made[n > 1], buckets))
        if rows:
            b, k, v = zip(*rows, strict=True)
            v = [shared.unpack(x, counted) for x in v]
            packed = [pa.array([shared.pack(x[c]) for x in v], pa.binary()) for c in ("n", "least")]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(b), t) for t in types[:5]] + [pa.array(b, types[5]), pa.array(k, types[6]), *packed], names)

    def run(batches):
        seen, kept, held = _Seen(), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                value, edge = sets_of(part.column(1), size)
                n = np.diff(edge)
                h1, h2 = set_hashes(value, edge)
                new = np.repeat(seen.new(h1, h2, n) & part.column(0).is_valid().to_numpy(zero_copy_only=False), n)
                kept.append((value[new], np.repeat(part.column(0).fill_null(0).to_numpy(), n)[new]))
                held += len(kept[-1][0])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(signatures(value, edge), pa.binary()), *(pa.nulls(len(n), t) for t in types[5:])], names)
                if held > COUNTED:
                    yield from flush(kept)
                    seen, kept, held = _Seen(), [], 0
        if held:
            yield from flush(kept)
        shared.release()

    return docs.mapInArrow(run, _FIRST)


def _frequent(counted: DataFrame, buckets: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, count, an id that has it) of those that repeat most: at most `limit` in all, an equal share of each bucket's."""
    share = max(1, limit // max(1, buckets))

    def run(batches):
        for _, columns in shared.by_bucket(batches, (np.uint64, np.int64, np.int64)):
            keys, n, least = columns
            order = np.argsort(keys, kind="stable")
            keys, n, least = keys[order], n[order], least[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, n, least = keys[at], np.add.reduceat(n, at), np.minimum.reduceat(least, at)
            top = np.lexsort((keys, -n))[:share]
            top = top[n[top] >= 8]
            if len(top):
                yield pa.RecordBatch.from_arrays([pa.array([shared.pack(x[top])], pa.binary()) for x in (keys, n, least)], ["keys", "n", "least"])
        shared.release()

    rows = shared.deal(counted).sortWithinPartitions("bucket").mapInArrow(run, "keys binary, n binary, least binary").toArrow()
    return tuple(np.concatenate([np.zeros(0, t), *(shared.unpack(x, t) for x in rows[c].to_pylist())]) for c, t in (("keys", np.uint64), ("n", np.int64), ("least", np.int64)))


def size_class(n: np.ndarray, threshold: int) -> np.ndarray:
    """Sizes on a logarithmic scale: those of sets that can link differ by STEPS + 1 at most."""
    return np.floor(np.log(np.maximum(n, 1)) * (STEPS / np.log(100 / threshold) if threshold < 100 else 1000.0)).astype(np.uint16)


def prefix_mask(value: np.ndarray, edge: np.ndarray, count: np.ndarray, threshold: int) -> np.ndarray:
    """Marks each set's prefix in the order (count, hash); value is ascending in each set."""
    n = np.diff(edge)
    need = n - (threshold * n + 99) // 100 + 1
    rare = count == 0
    run = np.concatenate(([0], np.cumsum(rare)))
    rank = run[:-1] - np.repeat(run[edge[:-1]], n)
    out = rare & (rank < np.repeat(need, n))
    for i in np.flatnonzero((run[edge[1:]] - run[edge[:-1]] < need) & (n > 0)):
        a, b = edge[i], edge[i + 1]
        out[a:b] = False
        out[a + np.lexsort((value[a:b], count[a:b]))[: need[i]]] = True
    return out


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct MEMBER rows, by unit and id."""
    rows = rows[np.lexsort((rows["id"], rows["unit"]))]
    return rows[np.concatenate(([True], (rows["unit"][1:] != rows["unit"][:-1]) | (rows["id"][1:] != rows["id"][:-1])))] if len(rows) else rows


def _name(least: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A unit's name from an id that its texts share a shingle with and their number, n of a factor of 1.25 and more alike."""
    size = np.floor(np.log(np.maximum(n, 1)) / np.log(np.where(n < NAMED, 2.0, 1.25))).astype(np.uint64)
    return mix(least.astype(np.uint64) ^ mix(size + np.uint64(1))).view(np.int64)


def _meetings(docs: DataFrame, size: int, threshold: int, table, buckets: int) -> DataFrame:
    """(unit, id), with the broadcast table of frequent shingles: the texts that share a prefix shingle have a unit in common; a text may be in several."""
    def run(batches):
        keys, often, least = table.value
        lookup = Lookup(keys)
        often, name = np.append(often, 0), np.append(_name(least, often), 0)
        seen, kept, named, held = _Seen(), [], [], 0

        def flush():
            yield shared.bucket_rows(list(shared.bucketed(np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept]), buckets)))
            rows = _distinct(np.concatenate(named))
            # units of frequent shingles are dealt by unit and id: no task gets all of one
            dealt = mix(rows["id"].astype(np.uint64) ^ mix(rows["unit"].astype(np.uint64)))
            yield shared.bucket_rows([(-1 - b, k, v) for b, k, v in shared.bucketed(dealt, rows, buckets)])

        for batch in batches:
            for part in slices(batch, "text"):
                value, edge = sets_of(part.column(1), size)
                count = np.diff(edge)
                new = seen.new(*set_hashes(value, edge), count)
                at = lookup.find(value) if len(keys) else np.full(len(value), -1)
                mask = prefix_mask(value, edge, often[at], threshold) & np.repeat(new, count)
                value, at, owner, sized = value[mask], at[mask], *(np.repeat(x, count)[mask] for x in (part.column(0).to_numpy(zero_copy_only=False), size_class(count, threshold)))
                own = often[at] >= NAMED
                entry, member = np.empty(int((~own).sum()), ENTRY), np.empty(int(own.sum()), MEMBER)
                entry["id"], entry["size"], member["unit"], member["id"] = owner[~own], sized[~own], name[at[own]], owner[own]
                kept.append((value[~own], entry))
                named.append(_distinct(member))
                held += len(entry) + len(named[-1])
                if held > FLUSH:
                    yield from flush()
                    seen, kept, named, held = _Seen(), [], [], 0
        if held:
            yield from flush()
        shared.release()

    def meet(batches):
        for bucket, raw in shared.by_bucket(batches, (None, None)):
            if bucket < 0:
                found = _distinct(np.concatenate([shared.unpack(x, MEMBER) for x in raw[1]]))
            else:
                found = _units(np.concatenate([shared.unpack(x, np.uint64) for x in raw[0]]), np.concatenate([shared.unpack(x, ENTRY) for x in raw[1]]))
            for lo in range(0, len(found), 1 << 16):
                part = found[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part["unit"]), pa.array(part["id"])], ["unit", "id"])
        shared.release()

    return shared.deal(docs.mapInArrow(run, shared.BUCKETS)).sortWithinPartitions("bucket").mapInArrow(meet, "unit long, id long")


def _units(token: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """MEMBER rows: for each run of texts that share a shingle and may link by size a unit; small runs of the same texts have the same."""
    order = np.argsort(token)
    token, entry = token[order], entry[order]
    same = token[1:] == token[:-1]
    twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    token, owner, size = token[twice], entry["id"][twice], entry["size"][twice].astype(np.int64)
    order = np.lexsort((size, token))
    token, owner, size = token[order], owner[order], size[order]
    if not len(token):
        return np.zeros(0, MEMBER)
    # a run ends where the next size is too large to link with this one, and so with any before
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (size[1:] - size[:-1] > STEPS + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(token)))
    out = np.empty(len(token), MEMBER)
    name = _name(np.minimum.reduceat(owner, at), n)
    with np.errstate(over="ignore"):
        same_texts = np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), at).view(np.int64)
    out["unit"], out["id"] = np.repeat(np.where(n <= 3, same_texts, name), n), owner
    return _distinct(out[np.repeat(n > 1, n)])


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """A table (id, tokens) of the documents whose id is among ids, and perhaps of a few others: joins with ids drop these.

    A filter of 16 bits for each id says which texts are cut into shingles again; when the ids are too many for one of a bounded size, a semi-join does.
    """
    spark, n = docs.sparkSession, ids.count()
    bits = 1 << max(12, (16 * n).bit_length())
    shared_filter = None
    if bits <= FILTER_BITS:
        slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - (bits - 1).bit_length())
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
        words = ids.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        filter_ = np.zeros(bits // 64, np.uint64)
        filter_[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        shared_filter = spark.sparkContext.broadcast(filter_)
        docs = docs.withColumn("slot", slot)
    else:
        docs = docs.join(ids, "id", "left_semi").withColumn("slot", F.lit(0).cast("long"))

    def run(batches):
        for batch in batches:
            if shared_filter is not None:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array(((shared_filter.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)))
            for part in slices(batch, "text"):
                value, edge = sets_of(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shared.pack(value[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["id", "tokens"])
        shared.release()

    made = shared.written(docs.mapInArrow(run, "id long, tokens binary"), "tokens")
    if shared_filter is not None:
        shared_filter.destroy()
    return made


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set, with the bits of its shingles."""
    out, step = np.empty((len(sets), bits // 64), np.uint64), max(1, (1 << 21) // bits)
    for lo in range(0, len(sets), step):
        part = sets[lo : lo + step]
        flags = np.zeros((len(part), bits), np.uint8)
        flags[np.repeat(np.arange(len(part)), [len(s) for s in part]), (np.concatenate(part) & np.uint64(bits - 1)).astype(np.int64)] = 1
        out[lo : lo + step] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    return out


def width(n: int) -> int:
    """Bits of the bitmap of a set of n shingles: a power of two, at least four for each shingle, more for small sets."""
    return min(MOST_BITS, max(64, 1 << (4 * n - 1).bit_length(), min(4096, 1 << (16 * n - 1).bit_length()))) if n else 64


def signatures(value: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of its own width."""
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        flags = np.zeros(width(b - a), np.uint8)
        flags[(value[a:b] & np.uint64(len(flags) - 1)).astype(np.int64)] = 1
        out.append(np.packbits(flags, bitorder="little").tobytes())
    return out


def fold(sign: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of a smaller power of two of words."""
    while sign.shape[-1] > words:
        sign = sign[..., : sign.shape[-1] // 2] | sign[..., sign.shape[-1] // 2 :]
    return sign


class Tree:
    """Levels of nodes over sets sorted by size: OR-combined bitmaps, size ranges, shared bits."""

    def __init__(self, sign: np.ndarray, n: np.ndarray):
        spare = n - np.bitwise_count(sign).sum(1, dtype=np.int64)
        self.levels = [(sign, n, n, spare)]
        while len(n) > FANOUT:
            sign, low, high, spare = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            n = np.minimum.reduceat(low, at)
            self.levels.append((np.bitwise_or.reduceat(sign, at, axis=0), n, np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def uniform(self, component: np.ndarray) -> list[np.ndarray]:
        """For each level the component of all sets below each node, or -1."""
        out = [component]
        for level in self.levels[1:]:
            at = np.arange(0, len(out[-1]), FANOUT)
            least, most = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(least == most, least, -1))
        return out


def may_link(one: tuple, a: np.ndarray, other: tuple, b: np.ndarray, threshold: int) -> np.ndarray:
    """Marks the pairs of nodes (one[a], other[b]) below which bitmaps and sizes allow a link."""
    good = (100 * one[2][a] >= threshold * other[1][b]) & (100 * other[2][b] >= threshold * one[1][a])
    at = np.flatnonzero(good)
    a, b = a[at], b[at]
    most = np.bitwise_count(one[0][a] & other[0][b]).sum(1, dtype=np.int64) + np.minimum(one[3][a], other[3][b])
    most = np.minimum(most, np.minimum(one[2][a], other[2][b]))
    good[at] = (100 + threshold) * most >= threshold * (one[1][a] + other[1][b])
    return good


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= threshold * (len(x) + len(y) - common)


class Join:
    """Follows a tree against itself or another; links join the components of the sets (positions of both trees, one after the other)."""

    def __init__(self, sign: np.ndarray, n: np.ndarray, component: np.ndarray, threshold: int, other: int = 0, sets: list[np.ndarray] | None = None):
        """The last `other` sets are a second tree; without it the sets meet each other. Without the sets themselves what may link joins components."""
        self.sets, self.threshold, self.split = sets, threshold, len(n) - other
        _, self.component = np.unique(component, return_inverse=True)
        self.one = Tree(sign[: self.split], n[: self.split])
        self.other = Tree(sign[self.split :], n[self.split :]) if other else self.one
        self.pairs = self.compared = 0
        self.links: list[tuple[int, int]] = []

    def run(self, chunk: int = 512) -> list[tuple[int, int]]:
        self._refresh()
        top, low = len(self.one.levels) - 1, len(self.other.levels) - 1
        a, b = (x.ravel() for x in np.indices((len(self.one.levels[top][1]), len(self.other.levels[low][1]))))
        keep = a <= b if self.one is self.other else np.ones(len(a), bool)
        todo = [(top, low, a[keep], b[keep])]
        while todo:
            k, m, a, b = todo.pop()
            if len(a) > chunk:
                todo += [(k, m, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)][::-1]
                continue
            x, y = self.own[k][a], self.its[m][b]
            apart = (x != y) | (x < 0)
            if k == m == 0 and self.one is self.other:
                apart &= a != b
            a, b = a[apart], b[apart]
            good = may_link(self.one.levels[k], a, self.other.levels[m], b, self.threshold)
            a, b = a[good], b[good]
            if not len(a):
                continue
            if k == m == 0:
                self._leaves(a, b)
                continue
            if k >= m:
                k, a, b = k - 1, *self._children(a, b, len(self.one.levels[k - 1][1]))
            if m > k:
                m, b, a = m - 1, *self._children(b, a, len(self.other.levels[m - 1][1]))
            if self.one is self.other:
                a, b = a[a <= b], b[a <= b]
            todo.append((k, m, a, b))
        return self.links

    @staticmethod
    def _children(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(children of a, b) for each pair, where there are such."""
        child = (a[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        good = child < size
        return child[good], np.repeat(b, FANOUT)[good]

    def _leaves(self, a: np.ndarray, b: np.ndarray) -> None:
        shift, found = 0 if self.one is self.other else self.split, False
        self.pairs += len(a)
        for i, j in zip(a.tolist(), (b + shift).tolist(), strict=True):
            x, y = self.component[i], self.component[j]
            if x != y:
                self.compared += 1
                if self.sets is None or similar(self.sets[i], self.sets[j], self.threshold):
                    self.component[self.component == y] = x
                    self.links.append((i, j))
                    found = True
        if found:
            self._refresh()

    def _refresh(self) -> None:
        self.own = self.one.uniform(self.component[: self.split])
        self.its = self.own if self.one is self.other else self.other.uniform(self.component[self.split :])


def joined_sets(sets: list[np.ndarray], component: np.ndarray, threshold: int, other: int = 0) -> Join:
    bits = width(max(len(s) for s in sets))
    return Join(bitmaps(sets, bits), np.array([len(s) for s in sets]), component, threshold, other, sets)


def may_join(ids: np.ndarray, n: np.ndarray, sign: list[bytes], threshold: int) -> list[tuple[int, int]]:
    """Links (positions) that join the sets of a unit to components of what may link.

    Sizes that can link differ by a factor of 100 / threshold at most, so bitmaps' widths by the next power of two: trees hold the widths from one to that, folded to the smallest.
    """
    wide = np.array([len(x) // 8 for x in sign])
    _, component = np.unique(ids, return_inverse=True)
    order, out, reach = np.argsort(n, kind="stable"), [], 1
    while reach * threshold < 100:
        reach *= 2
    for w in np.unique(wide).tolist():
        own = order[(wide[order] >= w) & (wide[order] <= reach * w)]
        if len(own) < 2:
            continue
        bits = np.stack([fold(np.frombuffer(sign[i], np.uint64), w) for i in own])
        join = Join(bits, n[own], component[own], threshold)
        for i, j in join.run():
            i, j = own[i], own[j]
            out.append((i, j))
            component[component == component[j]] = component[i]
    return out


def _maybe(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links to components of what may link, found by the trees of rows (unit, id, n, sign)."""
    def done(held):
        ids, n, sign = zip(*held, strict=True)
        return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in may_join(np.array(ids), np.array(n), list(sign), threshold)]

    def run(batches):
        now, held, out = None, [], []
        for batch in batches:
            for unit, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if unit != now:
                    if len(held) > 1:
                        out += done(held)
                    now, held = unit, []
                    if len(out) > 10_000:
                        yield _links(out)
                        out = []
                held.append(row)
        if len(held) > 1:
            out += done(held)
        yield _links(out)
        shared.release()

    dealt = rows.repartition(shared.partitions(rows.sparkSession), "unit").sortWithinPartitions("unit")
    return dealt.select("unit", "id", "n", "sign").mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _followed(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links found by the trees of rows (tree, side, id, component, tokens); sides 0 and 1 are two trees, side 0 alone is one."""
    dealt = rows.repartition("tree").sortWithinPartitions("tree")

    def done(held):
        side, ids, component, tokens = (np.array(x) if k < 3 else x for k, x in enumerate(zip(*held, strict=True)))
        sets = [shared.unpack(t, np.uint64) for t in tokens]
        order = np.lexsort((ids, [len(s) for s in sets], side))
        ids = ids[order]
        found = joined_sets([sets[i] for i in order], component[order], threshold, int(side.sum())).run()
        return _links([(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in found])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for tree, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if tree != now:
                    if len(held) > 1:
                        yield done(held)
                    now, held = tree, []
                held.append(row)
        if len(held) > 1:
            yield done(held)
        shared.release()

    return dealt.select("tree", "side", "id", "component", "tokens").mapInArrow(run, "a long, b long")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after more links; ids without a label stand for themselves."""
    if links.isEmpty():
        return labels
    a, b = (labels.select(F.col("id").alias(x), F.col("component").alias("c" + x)) for x in "ab")
    second = components(links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = second.select(F.col("id").alias("component"), F.col("component").alias("to"))
    both = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return shared.written(both.union(second.join(labels.select("id"), "id", "left_anti")), "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _blocks(rows: DataFrame, *by: str) -> DataFrame:
    """rows (..., id, n) with the number of blocks of each group and the block of each row; the groups' sizes are a table, so that the join can split a large one."""
    size = rows.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / F.lit(GROUP)), F.ceil(F.sum("n") / F.lit(TOKENS))).cast("long").alias("blocks"))
    size = shared.written(size, "sizes")
    return rows.join(size, list(by)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), "blocks"))


def _upwards(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Labels after trees over one set of each component of each block, level by level; members (unit, block, id, n)."""
    now, before = members, None
    while True:
        one = F.min(F.struct("id", "n")).alias("one")
        up = _labelled(now, labels).groupBy("unit", "block", "component").agg(one).select("unit", "one.id", "one.n")
        up = shared.written(_blocks(up, "unit"), "upwards")
        rows, most = up.agg(F.count("*"), F.max("blocks")).first()
        if before is not None and rows >= before:
            return labels
        trees = _labelled(up, labels).join(sets, "id").select(F.xxhash64("unit", "block").alias("tree"), F.lit(0).alias("side"), "id", "component", "tokens")
        labels = _merged(labels, shared.written(_followed(trees, threshold), "links"))
        if most == 1:
            return labels
        now, before = up.select("unit", "block", "id", "n"), rows


_ROOT = "unit long, block long, low long, high long, spare long, component long, sign binary"


def _roots(rows: DataFrame) -> DataFrame:
    """A block's root: rows (unit, block, id, component, tokens)."""
    names = [x.split()[0] for x in _ROOT.split(",")]

    def done(key, held):
        sets = [shared.unpack(t, np.uint64) for _, t in held]
        n = np.array([len(s) for s in sets])
        sign = bitmaps(sets, ROOT_BITS)
        spare = int((n - np.bitwise_count(sign).sum(1, dtype=np.int64)).max())
        own = {c for c, _ in held}
        made = (*key, int(n.min()), int(n.max()), spare, own.pop() if len(own) == 1 else None, shared.pack(np.bitwise_or.reduce(sign, axis=0)))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if c == "sign" else pa.int64()) for x, c in zip(made, names, strict=True)], names)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for unit, block, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (unit, block) != now:
                    if held:
                        yield done(now, held)
                    now, held = (unit, block), []
                held.append(row)
        if held:
            yield done(now, held)
        shared.release()

    dealt = rows.repartition("unit", "block").sortWithinPartitions("unit", "block")
    return dealt.select("unit", "block", "component", "tokens").mapInArrow(run, _ROOT)


def _across(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between blocks of a unit that still has several components; members (unit, id, n).

    Blocks are made anew: of one large component each, or of small ones together.
    """
    now = _labelled(members, labels)
    open_ = now.groupBy("unit").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("unit")
    now = now.join(open_, "unit")
    size = now.groupBy("unit", "component").agg(F.count("*").alias("k"))
    group = F.when(F.col("k") * 2 > GROUP, F.col("component"))  # null: with other small ones
    now = _blocks(now.join(size, ["unit", "component"]).withColumn("group", F.xxhash64(group)).drop("k"), "unit", "group")
    now = shared.written(now.select("unit", F.xxhash64("group", "block").alias("block"), "id", "component"), "blocks")
    full = now.join(sets, "id")
    roots = shared.written(_roots(full), "roots")
    a, b = (roots.select([F.col("unit"), *(F.col(c).alias(x + c) for c in roots.columns[1:])]) for x in "ab")
    near = a.join(b, "unit").where(f"ablock <= bblock and not (acomponent <=> bcomponent and acomponent is not null) and 100 * ahigh >= {threshold} * blow and 100 * bhigh >= {threshold} * alow")

    def allow(batches):
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            sides = []
            for x in "ab":
                sign = np.stack([shared.unpack(s, np.uint64) for s in c[x + "sign"]]) if batch.num_rows else np.zeros((0, ROOT_BITS // 64), np.uint64)
                sides.append((sign, *(c[x + k].to_numpy() for k in ("low", "high", "spare"))))
            rows = np.arange(batch.num_rows)
            good = may_link(sides[0], rows, sides[1], rows, threshold)
            yield pa.RecordBatch.from_arrays([c["unit"], c["ablock"], c["bblock"]], ["unit", "a", "b"]).filter(pa.array(good))

    pairs = shared.written(near.mapInArrow(allow, "unit long, a long, b long"), "block-pairs")
    sides = F.expr("if(a = b, array(struct(a as block, 0 as side)), array(struct(a as block, 0 as side), struct(b as block, 1 as side)))")
    sent = pairs.select("unit", F.xxhash64("unit", "a", "b").alias("tree"), F.inline(sides))
    return shared.written(_followed(full.join(sent, ["unit", "block"]).select("tree", "side", "id", "component", "tokens"), threshold), "links")


def classes_of(own: DataFrame) -> DataFrame:
    """(id, n, rep): the smallest id with the same set; rows (id, n, h1, h2)."""
    known = own.where("n > 0 and id is not null").distinct()
    same = known.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("most")).where("rep <> most").drop("most")
    return known.join(shared.written(same, "classes"), ["h1", "h2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))


def tree_links(docs: DataFrame, own: DataFrame, signs: DataFrame, size: int, threshold: int, frequent: tuple, buckets: int) -> DataFrame:
    """(id, component) of the sets that the trees link; docs (id, text), own as classes_of() gives it, signs (id, n, sign)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT entries at most
    met = _meetings(docs, size, threshold, table, buckets)
    met = shared.written(met.join(own, "id").select("unit", F.col("rep").alias("id"), "n").distinct(), "members")
    table.destroy()
    several = shared.written(met.groupBy("unit").agg(F.count("*").alias("k"), F.min("id").alias("b")).where("k > 1"), "several")
    units = shared.written(met.join(several, "unit").select("unit", "id", "k", "b"), "units")
    shared.discard(met)
    small = units.where(F.col("k") <= UNIT).select("unit", "id").join(signs, "id")
    maybe = shared.written(_maybe(small, threshold).union(units.where(F.col("k") > UNIT).select(F.col("id").alias("a"), "b")), "maybe")
    size_of = own.where("id = rep").groupBy("id").agg(F.sum("n").alias("n"))
    members = shared.written(_blocks(components(maybe).withColumnRenamed("component", "unit").join(size_of, "id"), "unit"), "members")
    sets = _sets(docs, members.select("id"), size)
    trees = members.join(sets, "id").select(F.xxhash64("unit", "block").alias("tree"), F.lit(0).alias("side"), "id", F.col("id").alias("component"), "tokens")
    labels = components(shared.written(_followed(trees, threshold), "links"))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        labels = _upwards(large, sets, labels, threshold)
        labels = _merged(labels, _across(large.select("unit", "id", "n"), sets, labels, threshold))
    shared.discard(sets)
    return labels


def jaccard_components(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component): one row for each row of docs."""
    spark = docs.sparkSession
    given = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    buckets = 4 * shared.partitions(spark)
    first = shared.written(_first_pass(given, size, buckets), "sets")
    own = first.where("bucket is null").select("id", "n", "h1", "h2")
    frequent = _frequent(first.where("bucket is not null").select("bucket", "keys", "values", "least"), buckets, FREQUENT)
    known = shared.written(classes_of(own), "reps")
    signs = first.where("bucket is null and id is not null").select("id", "n", "sign")
    labels = tree_links(given.where("id is not null"), known, signs, size, threshold, frequent, buckets)
    # an id with different texts joins what its texts link with
    if not known.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        rep = known.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("b"))
        both = components(rep.select(F.col("id").alias("a"), "b"))
        found = rep.select("id").distinct().join(both, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        return own.select("id", "n").join(found, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
    found = known.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    return own.select("id", "n").join(found, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs without all but one of each component: the smallest id, of its texts the smallest.

    Repeated rows of an id and text count once, the smallest by all columns; different texts under one id are documents of their own here.  Rows without an id stay.
    """
    key = max(docs.columns, key=len) + "_key"
    keyed = docs.where(docs[id].isNotNull()).withColumn(key, docs[id].cast("long"))
    words, none = F.coalesce(F.col(text).cast("string"), F.lit("")), docs.where(docs[id].isNull())
    twice = shared.written(keyed.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("k"), F.min(F.xxhash64(words)).alias("lo"), F.max(F.xxhash64(words)).alias("hi")).where("k > 1"), "twice")
    repeated = not twice.isEmpty()
    mixed = twice.where("lo <> hi").select("id")
    if not repeated or mixed.isEmpty():
        found = jaccard_components(keyed, text, key)
        stay = found.where("id = component").select(F.col("id").alias("stay")).distinct()
    else:
        # all but the smallest text of such an id get a key above all ids, ascending by id and text
        most = keyed.agg(F.max(key)).first()[0]
        texts = keyed.join(mixed, keyed[key] == mixed["id"]).select("id", words.alias("t")).distinct()
        texts = texts.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("t"))).where("rank > 1")
        more = shared.written(texts.orderBy("id", "t").withColumn("to", F.monotonically_increasing_id() + F.lit(most + 1)), "more")
        joined = keyed.alias("d").join(more.alias("m"), (F.col(f"d.{key}") == F.col("m.id")) & (F.coalesce(F.col(f"d.{text}").cast("string"), F.lit("")) == F.col("m.t")), "left")
        keyed = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.coalesce("m.to", f"d.{key}").alias(key))
        found = jaccard_components(keyed, text, key).distinct().join(more.select(F.col("to").alias("id"), F.col("id").alias("own"), "rank"), "id", "left")
        place = F.struct(F.coalesce("own", "id"), F.coalesce("rank", F.lit(1)), F.col("id").alias("key"))
        stay = found.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.key").alias("stay"))
    kept = keyed.join(stay, keyed[key] == F.col("stay"), "left_semi")
    if repeated:
        kept = _smallest(kept, key)
    return kept.drop(key).unionByName(none)


def _smallest(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: the smallest by its columns in turn; columns without an order count by their printed form."""
    ordered = [F.to_json(F.struct(F.col(f"`{c}`"))) if any(x in t for x in ("map", "variant", "interval")) else F.col(f"`{c}`") for c, t in rows.dtypes]
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(F.col(key).alias("k")).agg(F.min_by(whole, F.struct(*ordered)).alias("row"))
    return best.select(*[F.col("row")[c].alias(c) for c in rows.columns])
