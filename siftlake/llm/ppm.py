"""Language-model scores by prediction by partial matching over bytes.

The context trie holds how often each byte follows each context of 0 to ORDER
bytes in the training texts; a text begins after ORDER end marks (0xFF, which
UTF-8 does not use) and ends with one.  A byte's probability is taken from the
longest context that was seen with it; a longer one that was not costs an
escape.  With n non-excluded occurrences of t distinct bytes a byte seen c times
gets (2c - 1) / 2n and the escape t / 2n; bytes of the contexts escaped from are
excluded from all shorter ones; last comes a uniform choice of what is left.
The score is the log10 probability of the text and its end.

The trie is trained on all training texts and fixed.  Counts of the longest
contexts hold those of the shorter ones, so they are what tasks count, pack and
deal out.  At most SHARD of them are broadcast at once: with more, contexts are
divided by their last two bytes, and those of two bytes that are too many alone by
the byte before, and so on up to whole contexts, which have at most 256 bytes after
them.  Up to SERIAL parts each score the places that are their own, in a pass over a
table of the texts written once.  With more, one pass deals all places to their
parts, the most frequent parts to several tasks, and sums come back by text.

The base is a unigram model of words.  The HOT most frequent words are broadcast
(a fixed number); all other tokens are dealt out by word to meet their counts.

Null texts are empty: one end token, and the end mark's probability.  Without
training texts every count is 0.  Rows of one id are scored each for itself.  Ids are numbers of 64
bits or their decimal text; other text ends the job with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import shared
from siftlake.llm.text import NONSPACE, U64, Lookup, Words, mix, ragged, slices, utf8

ORDER, SHARD, HOT, FLUSH, END = 5, 6 << 20, 1 << 19, 1_000_000, 0xFF
#: Parts that are taken one by one; contexts of a part, and training places for each task of a part, where places are dealt.
SERIAL, DEALT, PLACES = 8, 1 << 19, 1 << 26
SLICE = 1 << 18
_END_WORD = np.uint64(0x9B97_5C1E_31A7_F00D)  # stands for the hash of the end token


def grams(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(key, edge): for each byte of each text, and its end, the `order` bytes before it and itself as one number."""
    n = np.diff(offsets)
    start = np.concatenate(([0], np.cumsum(n + order + 1)))
    padded = np.full(int(start[-1]) + order, END, np.uint8)
    padded[ragged(start[:-1] + order, n)] = buf
    size = int(start[-1])
    key = padded[:size].astype(U64)
    for j in range(1, order + 1):
        key <<= U64(8)
        key |= padded[j : j + size]
    return key[ragged(start[:-1], n + 1)], np.concatenate(([0], np.cumsum(n + 1)))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, edge): each text's words and one end token."""
    words = Words(*utf8(column), NONSPACE)
    edge = words.first + np.arange(len(words.first))
    out = np.full(int(edge[-1]), _END_WORD, U64)
    out[ragged(edge[:-1], words.count)] = words.hashes()
    return out, edge


class Trie:
    """Contexts of all orders with the bytes after them, from the counts of the longest."""

    def __init__(self, key: np.ndarray, count: np.ndarray, order: int, low: list[tuple[np.ndarray, np.ndarray]]):
        """low: keys and counts of the lowest orders, those shorter than what all contexts of this part end with, over all of the training texts; key: those of this part."""
        self.order, self.levels = order, []
        for k in range(order + 1):
            self.levels.append(low[k] if k < len(low) and k < order else shared.counts_of(key & U64((1 << 8 * (k + 1)) - 1), count))
        self.levels = [(k, n.astype(np.uint32) if len(n) and n.max() < 1 << 32 else n) for k, n in self.levels]
        key, count = self.levels[order][0], self.levels[order][1].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], key[1:] >> U64(8) != key[:-1] >> U64(8)))) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, at) if len(at) else np.zeros(0, np.int64)
        self.log = np.log10((2 * count - 1) / (2 * np.repeat(total, np.diff(np.append(at, len(key)))))).astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each place."""
        if "lookup" not in self.__dict__:
            self.lookup = Lookup(self.levels[self.order][0])
        at = self.lookup.find(keys)
        out = self.log[at].astype(float) if len(self.log) else np.zeros(len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            out[new] = np.concatenate([self.escaped(distinct[i : i + 8192]) for i in range(0, len(distinct), 8192)])[back]
        return out

    def escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same for places whose longest context was not seen with the byte."""
        m = len(keys)
        byte = (keys & U64(255)).astype(np.int64)
        context = keys >> U64(8)
        out, excluded, todo = np.zeros(m), np.zeros((m, 256), bool), np.ones(m, bool)
        for k in range(self.order, -1, -1):
            level, count = self.levels[k]
            rows = np.flatnonzero(todo)
            if not len(rows):
                return out
            c = context[rows] & U64((1 << 8 * k) - 1)
            lo = np.searchsorted(level, c << U64(8))
            size = np.searchsorted(level, (c << U64(8)) | U64(255), "right") - lo
            at, row = ragged(lo, size), np.repeat(rows, size)
            follows = (level[at] & U64(255)).astype(np.int64)
            live = ~excluded[row, follows]
            n = np.bincount(row, count[at] * live, m)
            t = np.bincount(row, live, m)
            hit = live & (follows == byte[row])
            own = np.zeros(m)
            own[row[hit]] = count[at[hit]]
            found = own > 0
            out[found] += np.log10((2 * own[found] - 1) / (2 * n[found]))
            lost = todo & ~found & (n > 0)
            out[lost] += np.log10(t[lost] / (2 * n[lost]))
            excluded[row, follows] = True
            todo &= ~found
        rows = np.flatnonzero(todo)
        out[rows] -= np.log10(np.maximum(1, 256 - excluded[rows].sum(1)))
        return out


_COUNTS = "kind int, bucket int, keys binary, values binary"


def _counted(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """(kind, bucket, keys, values): totals of words (0) and places (1) of the training texts."""
    def emit(kind, parts):
        keys, n = shared.counts_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        b, k, v = zip(*shared.bucketed(keys, n, buckets), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["kind", "bucket", "keys", "values"])

    def count(batches):
        raw: dict[int, list] = {0: [], 1: []}
        held = {0: 0, 1: 0}
        packed: dict[int, list] = {0: [], 1: []}

        def compact(kind):
            """Counts what is raw; joins the counts so far once they are many."""
            packed[kind].append(shared.counts_of(np.concatenate(raw[kind])))
            raw[kind], held[kind] = [], 0
            if sum(len(k) for k, _ in packed[kind]) > FLUSH:
                keys, n = (np.concatenate(x) for x in zip(*packed[kind], strict=True))
                packed[kind] = [shared.counts_of(keys, n)]

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for kind, found in ((0, tokens(part.column(0))[0]), (1, grams(*utf8(part.column(0)), order)[0])):
                    raw[kind].append(found)
                    held[kind] += len(found)
                    if held[kind] > FLUSH:
                        compact(kind)
                        if len(packed[kind][0][0]) > FLUSH:
                            yield emit(kind, packed[kind])
                            packed[kind] = []
        for kind in (0, 1):
            if held[kind]:
                compact(kind)
            if packed[kind]:
                yield emit(kind, packed[kind])
                packed[kind] = []
        shared.release()

    def total(batches):
        by: dict[tuple, list] = {}
        for batch in batches:
            for kind, b, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault((kind, b), []).append((shared.unpack(k, np.uint64), shared.unpack(v, np.int64)))
        for (kind, b), parts in by.items():
            keys, n = shared.counts_of(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([b], pa.int32()), pa.array([shared.pack(keys)], pa.binary()), pa.array([shared.pack(n)], pa.binary())], ["kind", "bucket", "keys", "values"])

    dealt = rows.mapInArrow(count, _COUNTS).repartition(shared.partitions(rows.sparkSession), "kind", "bucket")
    return shared.written(dealt.mapInArrow(total, _COUNTS), "counts")


def _sums(counts: DataFrame, hot: int, buckets: int) -> tuple:
    """What is small of the counts: words' total and number, the hot words, places by their last two context bytes, orders 0 and 1."""
    share = max(1, hot // buckets)

    def run(batches):
        words = distinct = 0
        pairs, one = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for kind, b, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n = shared.unpack(k, np.uint64), shared.unpack(v, np.int64)
                if kind == 0:
                    words += int(n.sum())
                    distinct += len(keys)
                    top = np.lexsort((keys, -n))[:share]
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b], pa.int32()), pa.array([shared.pack(keys[top])]), pa.array([shared.pack(n[top])])], ["kind", "bucket", "keys", "values"])
                else:
                    pairs += np.bincount(((keys >> U64(8)) & U64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                    one += np.bincount((keys & U64(0xFFFF)).astype(np.int64), n, 1 << 16).astype(np.int64)
        p, o = np.flatnonzero(pairs), np.flatnonzero(one)
        for kind, a, v in ((1, np.array([0, 1]), np.array([words, distinct])), (2, p, pairs[p]), (3, o, one[o])):
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([0], pa.int32()), pa.array([shared.pack(a.astype(np.int64))]), pa.array([shared.pack(v.astype(np.int64))])], ["kind", "bucket", "keys", "values"])

    small = counts.mapInArrow(run, _COUNTS)
    hot_rows = small.where("kind = 0").select("keys", "values").toArrow()
    exploded = small.where("kind > 0").mapInArrow(_explode, "kind int, at long, n long")
    totals = exploded.groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (totals[c].to_numpy() for c in ("kind", "at", "n"))
    number = dict(zip(at[kind == 1].tolist(), n[kind == 1].tolist(), strict=True))
    words = np.concatenate([np.zeros(0, np.uint64), *(shared.unpack(x, np.uint64) for x in hot_rows["keys"].to_pylist())])
    often = np.concatenate([np.zeros(0, np.int64), *(shared.unpack(x, np.int64) for x in hot_rows["values"].to_pylist())])
    pairs, one = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    pairs[at[kind == 2]], one[at[kind == 3]] = n[kind == 2], n[kind == 3]
    return number.get(0, 0), number.get(1, 0), words, often, pairs, one


def _explode(batches):
    for batch in batches:
        for kind, _, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, n = shared.unpack(k, np.int64), shared.unpack(v, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(n)], ["kind", "at", "n"])


class Part:
    """Contexts that end with one of some runs of `depth` bytes: mask of the last two bytes, or of the byte before a suffix."""

    def __init__(self, depth: int, suffix: int, mask: np.ndarray):
        self.depth, self.suffix, self.mask = depth, suffix, mask

    def own(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> U64(8)
        if self.depth == 2:
            return self.mask[(context & U64(0xFFFF)).astype(np.int64)]
        bits = 8 * (self.depth - 1)
        return (context & U64((1 << bits) - 1) == U64(self.suffix)) & self.mask[((context >> U64(bits)) & U64(255)).astype(np.int64)]


def _ends(counts: DataFrame, depth: int, suffix: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the contexts that end with the depth - 1 bytes of suffix: places by the byte before these, and totals by the byte that follows."""
    whole = Part(depth, suffix, np.ones(256, bool))

    def run(batches):
        before, after = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n = shared.unpack(k, np.uint64), shared.unpack(v, np.int64)
                own = whole.own(keys)
                keys, n = keys[own], n[own]
                before += np.bincount(((keys >> U64(8 * depth)) & U64(255)).astype(np.int64), minlength=256)
                after += np.bincount((keys & U64(255)).astype(np.int64), n, 256).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([shared.pack(before)]), pa.array([shared.pack(after)])], ["keys", "values"])

    rows = counts.where("kind = 1").select("keys", "values").mapInArrow(run, "keys binary, values binary").toArrow()
    return tuple(sum((shared.unpack(x, np.int64) for x in rows[c].to_pylist()), np.zeros(256, np.int64)) for c in ("keys", "values"))


def _parts(counts: DataFrame, pairs: np.ndarray, low: list, order: int, shard: int):
    """(part, lowest orders) that together have all contexts once, each with at most `shard` places where contexts can be told apart."""
    if order < 2 or pairs.sum() <= shard:
        yield Part(2, 0, np.ones(1 << 16, bool)), low
        return

    def runs(places, large):
        """Masks of neighbouring values, without the large ones, with at most `shard` places together; all values are in one, seen or not."""
        places, cut, held = np.where(large, 0, places), [0], 0
        for at in np.flatnonzero(places).tolist():
            if held and held + places[at] > shard:
                cut.append(at)
                held = 0
            held += places[at]
        for lo, hi in zip(cut, [*cut[1:], len(places)], strict=True):
            mask = ~large
            mask[:lo] = mask[hi:] = False
            yield mask

    def below(depth, suffix, low):
        before, after = _ends(counts, depth, suffix)
        at = np.flatnonzero(after).astype(np.uint64)
        low = [*low, (U64(suffix << 8) | at, after[after > 0])]
        large = (before > shard) & (depth < order)
        for mask in runs(before, large):
            yield Part(depth, suffix, mask), low
        for byte in np.flatnonzero(large).tolist():
            yield from below(depth + 1, byte << 8 * (depth - 1) | suffix, low)

    large = (pairs > shard) & (order > 2)
    for mask in runs(pairs, large):
        yield Part(2, 0, mask), low
    for value in np.flatnonzero(large).tolist():
        yield from below(3, value, low)


def _lowest(one: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of orders 0 and 1."""
    return [(np.flatnonzero(x).astype(np.uint64), x[np.flatnonzero(x)]) for x in (one.reshape(256, 256).sum(0), one)]


def _tries(counts: DataFrame, pairs: np.ndarray, one: np.ndarray, order: int, shard: int):
    """(part, trie) for all parts, one after the other."""
    for part, lowest in _parts(counts, pairs, _lowest(one), order, shard):

        def pick(batches, part=part):
            for batch in batches:
                for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    keys, n = shared.unpack(k, np.uint64), shared.unpack(v, np.int64)
                    own = part.own(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([shared.pack(keys[own])]), pa.array([shared.pack(n[own])])], ["keys", "values"])

        rows = counts.where("kind = 1").select("keys", "values").mapInArrow(pick, "keys binary, values binary").toArrow()
        key = np.concatenate([np.zeros(0, np.uint64), *(shared.unpack(x, np.uint64) for x in rows["keys"].to_pylist())])
        count = np.concatenate([np.zeros(0, np.int64), *(shared.unpack(x, np.int64) for x in rows["values"].to_pylist())])
        del rows
        yield part, Trie(key, count, order, lowest)


class Cells:
    """Which of some parts a context is in: one table for the last two bytes, and for each suffix that is divided one for the byte before."""

    def __init__(self, parts: list[Part]):
        self.pairs, self.deep = np.full(1 << 16, -1, np.int32), {}
        for i, part in enumerate(parts):
            table = self.pairs if part.depth == 2 else self.deep.setdefault(part.depth, {}).setdefault(part.suffix, np.full(256, -1, np.int32))
            table[part.mask] = i

    def of(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> U64(8)
        out = self.pairs[(context & U64(0xFFFF)).astype(np.int64)]
        for depth in sorted(self.deep):
            rest, bits = np.flatnonzero(out < 0), 8 * (depth - 1)
            suffix = context[rest] & U64((1 << bits) - 1)
            for value in np.unique(suffix).tolist():
                table = self.deep[depth].get(value)
                if table is not None:
                    own = rest[suffix == U64(value)]
                    out[own] = table[((context[own] >> U64(bits)) & U64(255)).astype(np.int64)]
        return out


_CELLS = "cell int, salt int, side int, keys binary, values binary"


def _cell_rows(rows: list[tuple]) -> pa.RecordBatch:
    c, t, s, k, v = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in (c, t, s)), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["cell", "salt", "side", "keys", "values"])


def _split(cells: Cells, keys: np.ndarray, values: np.ndarray):
    """(cell, keys, values) of the entries of each part."""
    cell = cells.of(keys)
    order = np.argsort(cell, kind="stable")
    keys, values = keys[order], values[order]
    of, at = np.unique(cell[order], return_index=True)
    yield from zip(of.tolist(), np.split(keys, at[1:]), np.split(values, at[1:]), strict=True) if len(of) else ()


def _dealt(given: DataFrame, counts: DataFrame, parts: list[tuple[Part, list]], order: int, buckets: int, places: int) -> DataFrame:
    """(key, more_known, more_base): the number of places of each text, and the sum of their log10 probabilities."""
    spark = given.sparkSession
    model = spark.sparkContext.broadcast((Cells([p for p, _ in parts]), [low for _, low in parts]))
    own = counts.where("kind = 1").select("keys", "values")

    def weigh(batches):
        mass = np.zeros(len(parts), np.int64)
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for cell, _, n in _split(model.value[0], shared.unpack(k, np.uint64), shared.unpack(v, np.int64)):
                    mass[cell] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array([shared.pack(mass)])], ["mass"])

    mass = sum((shared.unpack(x, np.int64) for x in own.mapInArrow(weigh, "mass binary").toArrow()["mass"].to_pylist()), np.zeros(len(parts), np.int64))
    salts = np.maximum(1, -(-mass // places))

    def trained(batches):
        for batch in batches:
            rows = []
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for cell, keys, n in _split(model.value[0], shared.unpack(k, np.uint64), shared.unpack(v, np.int64)):
                    rows += [(cell, salt, 0, shared.pack(keys), shared.pack(n)) for salt in range(int(salts[cell]))]
            yield _cell_rows(rows)

    def asked(batches):
        from pyspark import TaskContext

        turn, kept, held = TaskContext.get().partitionId(), [], 0

        def flush():
            return _cell_rows([(cell, turn % int(salts[cell]), 1, shared.pack(k), shared.pack(d)) for cell, k, d in _split(model.value[0], *(np.concatenate(x) for x in zip(*kept, strict=True)))])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                key, edge = grams(*utf8(part.column(2)), order)
                kept.append((key, np.repeat(part.column(0).to_numpy(), np.diff(edge))))
                held += len(key)
                if held > FLUSH // 2:
                    yield flush()
                    turn, kept, held = turn + 1, [], 0
        if held:
            yield flush()
        shared.release()

    def meet(batches):
        now, learned, tree = None, [], None
        for batch in batches:
            for cell, salt, side, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, salt) != now:
                    now, learned, tree = (cell, salt), [], None
                if side == 0:
                    learned.append((shared.unpack(k, np.uint64), shared.unpack(v, np.int64)))
                    continue
                if tree is None:
                    key, n = (np.concatenate(x) for x in zip(*learned, strict=True)) if learned else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    tree, learned = Trie(key, n, order, model.value[1][cell]), []
                keys, docs = shared.unpack(k, np.uint64), shared.unpack(v, np.int64)
                yield _to_texts(docs, np.stack((np.ones(len(docs)), tree.scores(keys)), 1), buckets)
        shared.release()

    both = own.mapInArrow(trained, _CELLS).union(given.mapInArrow(asked, _CELLS))
    met = both.repartition(shared.partitions(spark), "cell", "salt").sortWithinPartitions("cell", "salt", "side")
    return _summed(met.mapInArrow(meet, shared.BUCKETS))


def _to_texts(key: np.ndarray, value: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sums of two columns for each text, dealt out by text."""
    keys, back = np.unique(key, return_inverse=True)
    value = np.stack([np.bincount(back, value[:, j]) for j in range(2)], 1)
    spread = (mix(keys.astype(np.uint64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(spread, kind="stable")
    edge = np.searchsorted(spread[order], np.arange(buckets + 1))
    return shared.bucket_rows([(i, shared.pack(keys[order[edge[i] : edge[i + 1]]]), shared.pack(value[order[edge[i] : edge[i + 1]]])) for i in range(buckets) if edge[i] < edge[i + 1]])


def _summed(rows: DataFrame) -> DataFrame:
    """(key, more_known, more_base): what _to_texts() sent to each text."""
    def add(batches):
        keys, values = [], []
        for batch in batches:
            keys += [shared.unpack(x, np.int64) for x in batch.column(1).to_pylist()]
            values += [shared.unpack(x, np.float64).reshape(-1, 2) for x in batch.column(2).to_pylist()]
        if keys:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            value = np.concatenate(values)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(back, value[:, 0]).astype(np.int64)), pa.array(np.bincount(back, value[:, 1]))], ["key", "more_known", "more_base"])

    return shared.deal(rows).mapInArrow(add, "key long, more_known long, more_base double")


_SCORED = "key long, id long, n_tokens long, n_known long, base double, score double, bucket int, keys binary, values binary"


def _scored(rows: DataFrame, model, hot, buckets: int) -> DataFrame:
    """A row for each text, and packed rows of the tokens whose word is not hot; model: broadcast (part, trie); hot: (broadcast words, N, V), or None for scores only."""
    names = [x.split()[0] for x in _SCORED.split(",")]
    types = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        kept, held = [], 0
        part_, tree = model.value
        full = part_.depth == 2 and bool(part_.mask.all())

        def flush():
            b, k, v = zip(*shared.bucketed(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]), buckets), strict=True)
            return pa.RecordBatch.from_arrays([pa.nulls(len(b), t) for t in types[:6]] + [pa.array(b, types[6]), pa.array(k, types[7]), pa.array(v, types[8])], names)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                key, edge = grams(*utf8(part.column(2)), tree.order)
                if full:
                    log = tree.scores(key)
                else:
                    log = np.zeros(len(key))
                    at = np.flatnonzero(part_.own(key))
                    log[at] = tree.scores(key[at])
                n = part.num_rows
                score = np.add.reduceat(log, edge[:-1]) if n else np.zeros(0)
                size = known = np.zeros(n, np.int64)
                base = np.zeros(n)
                if hot is not None:
                    table, total, distinct = hot
                    word, at = tokens(part.column(2))
                    size = np.diff(at)
                    lookup, count = table.value.ready()
                    found = lookup.find(word)
                    log = np.where(found >= 0, np.log10((count[found] + 0.5) / (total + 0.5 * (distinct + 1))), 0.0)
                    known = np.add.reduceat((found >= 0).astype(np.int64), at[:-1])
                    base = np.add.reduceat(log, at[:-1])
                    tail = found < 0
                    if tail.any():
                        kept.append((word[tail], np.repeat(part.column(0).to_numpy(), size)[tail]))
                        held += int(tail.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(known), pa.array(base), pa.array(score), *(pa.nulls(n, t) for t in types[6:])], names)
                if held > FLUSH // 4:
                    yield flush()
                    kept, held = [], 0
        if held:
            yield flush()
        shared.release()

    return rows.mapInArrow(run, _SCORED)


class HotWords:
    def __init__(self, words: np.ndarray, count: np.ndarray):
        self.words, self.count = words, count

    def ready(self) -> tuple[Lookup, np.ndarray]:
        if "lookup" not in self.__dict__:
            self.lookup = Lookup(self.words)
            self.padded = np.append(self.count, 0).astype(np.float64)
            del self.count
        return self.lookup, self.padded

    def __getstate__(self):
        return {"words": self.words, "count": self.__dict__.get("count")}


def _tail(tokens_: DataFrame, counts: DataFrame, total: int, distinct: int, buckets: int) -> DataFrame:
    """(key, known, base) of the tokens that were dealt out by word; both sides are packed and in the same buckets."""
    both = tokens_.select("bucket", F.lit(1).alias("side"), "keys", "values").union(counts.where("kind = 0").select("bucket", F.lit(0).alias("side"), "keys", "values"))

    def meet(batches):
        by: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for b, side, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(b, ([], []))[side].append((shared.unpack(k, np.uint64), shared.unpack(v, np.int64)))
        for words, places in by.values():
            if not places:
                continue
            word, key = np.concatenate([k for k, _ in places]), np.concatenate([v for _, v in places])
            c = np.zeros(len(word), np.int64)
            if words:
                known, n = np.concatenate([k for k, _ in words]), np.concatenate([v for _, v in words])
                order = np.argsort(known)
                known, n = known[order], n[order]
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                c = np.where(known[at] == word, n[at], 0)
            log = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            yield _to_texts(key, np.stack((c > 0, log), 1), buckets)

    return _summed(shared.deal(both).mapInArrow(meet, shared.BUCKETS))


def score(docs: DataFrame, training: DataFrame, text: str = "text", id: str = "doc_id", order: int = ORDER, shard: int = SHARD, hot: int = HOT, serial: int = SERIAL, dealt: int = DEALT, places: int = PLACES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs, by the models of the training rows."""
    spark = docs.sparkSession
    buckets = 4 * shared.partitions(spark)
    counts = _counted(training.select(training[text].cast("string").alias("text")), order, buckets)
    total, distinct, words, often, pairs, one = _sums(counts, hot, buckets)
    given = docs.select(F.monotonically_increasing_id().alias("key"), docs[id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    if pairs.sum() > shard:
        given = shared.written(given, "texts")
    table = spark.sparkContext.broadcast(HotWords(words, often))
    made = extra = None
    if pairs.sum() > serial * shard:  # one pass with an empty model for the words, one for all places
        low = _lowest(one)
        parts = list(_parts(counts, pairs, low, order, dealt))
        extra = shared.written(_dealt(given, counts, parts, order, buckets, places).select("key", F.col("more_base").alias("score")), "scores")
        tries = [(Part(3, 0, np.zeros(256, bool)), Trie(np.zeros(0, np.uint64), np.zeros(0, np.int64), order, low))]
    else:
        tries = _tries(counts, pairs, one, order, shard)
    for part, trie in tries:
        model = spark.sparkContext.broadcast((part, trie))
        del trie
        part = shared.written(_scored(given, model, (table, total, distinct) if made is None else None, buckets), "scores")
        model.destroy()
        if made is None:
            made = part
            table.destroy()
        else:
            extra = part.select("key", "score") if extra is None else extra.union(part.select("key", "score"))
    rows = made.where("key is not null").drop("bucket", "keys", "values")
    if extra is not None:
        rows = rows.join(extra.groupBy("key").agg(F.sum("score").alias("more")), "key", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    tail = _tail(made.where("bucket is not null").select("bucket", "keys", "values"), counts, total, distinct, buckets)
    rows = rows.join(tail, "key", "left")
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0).cast("long"))
    return rows.select("id", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
