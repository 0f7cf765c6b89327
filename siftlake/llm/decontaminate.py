"""Benchmark decontamination: a prefix-filtered set join with exact containment.

Every run of `window` words of a benchmark item (an item with fewer words is
one run) is the set of its word shingles.  A text contains the run only if it
contains all of these, so of the shingles ordered by rarity (their number of
places in all texts, then their hash) the first alone is the necessary prefix.
Texts are joined with these prefixes; where the run would have to begin follows
from the shingle's place in it, the text's length bounds it, and the words
themselves are compared last.

Null and empty texts have no words and no hits; an item without words has no
windows; equal items and repeated rows each count for themselves; a null
item_id goes by the name "null"; ties in rarity fall to the smaller hash.  Bytes
that are no UTF-8 are letters of words, equal to themselves only.

Benchmarks are cut into pieces of at most `block_bytes` / 4 (which share window - 1
words, so no window is lost) and dealt to blocks of about `block_bytes`.  A block is
indexed on the driver in arrays of some 15 times its size, and broadcast; more than
one block means a pass over the texts for each, which returns only texts with hits.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.shared import annotate, discard, release, written
from siftlake.llm.text import ALNUM, LOWER, Lookup, Words, combine, ragged, utf8

WINDOW, SHINGLE, BLOCK_BYTES = 13, 5, 4 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(LOWER.tolist())


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_FOLD))


def cut_item(data: bytes, limit: int, window: int) -> list[bytes]:
    """Pieces of about `limit` bytes that share window - 1 words, so that each window stands whole in one; a short item is one."""
    if len(data) <= limit:
        return [data]
    words = [(m.start(), m.end()) for m in _WORD.finditer(data.translate(_FOLD))]
    out, first = [], 0
    while first < len(words):
        last = first + window  # a piece has a window at least
        while last < len(words) and words[last][1] - words[first][0] <= limit:
            last += 1
        last = min(last, len(words))
        out.append(data[words[first][0] : words[last - 1][1]])
        if last == len(words):
            break
        first = last - window + 1
    return out or [b""]


class Index:
    """The distinct windows of one block of items as positions in the block's words, and their shingles.

    Every word is hashed once; a window is its first word and length.  Windows are equal if the hashes of all their
    words are; what is found in a text is compared word by word.
    """

    def __init__(self, names: list[str], texts: pa.Array, window: int, shingle: int):
        buf, offsets = utf8(texts)
        words = Words(buf, offsets, ALNUM)
        self.buf, self.first, self.last, self.h = LOWER[buf], words.start, words.end, words.hashes()
        per = np.where(words.count > 0, np.maximum(1, words.count - window + 1), 0)
        item = np.repeat(np.arange(len(per)), per)
        start, length = ragged(words.first[:-1], per), np.repeat(np.minimum(words.count, window), per)
        whole = np.zeros(len(start), np.uint64)
        for n in np.unique(length).tolist():
            own = length == n
            whole[own] = combine(self.h, n)[start[own]]
        order = np.lexsort((start, whole, length))
        a, b = order[:-1], order[1:]
        same = (whole[a] == whole[b]) & (length[a] == length[b])
        for j in range(window):
            at = np.flatnonzero(same & (j < length[a]))
            same[at] &= self.h[start[a[at]] + j] == self.h[start[b[at]] + j]
        new = np.concatenate(([True], ~same))[: len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        kept = order[new]
        self.start, self.length, self.whole = start[kept], length[kept], whole[kept]
        self.names, by_name = np.unique(np.array(names, object), return_inverse=True) if names else (np.array([], object), np.zeros(0, np.int64))
        pair = np.unique(group * max(1, len(self.names)) + by_name[item])  # of each window, the names it stands in, in their order
        self.name_edge = np.searchsorted(pair, np.arange(len(kept) + 1) * max(1, len(self.names)))
        self.name = pair % max(1, len(self.names))
        self.size = np.minimum(self.length, shingle)
        self.shingles = {size: np.unique(np.concatenate([x for _, x in self._offsets(size)])) for size in np.unique(self.size).tolist()}

    def _offsets(self, size: int):
        """(windows, shingle) of the windows with shingles of `size` words, for each offset."""
        own, runs = np.flatnonzero(self.size == size), combine(self.h, size)
        for j in range(int(self.length[own].max()) - size + 1):
            some = own[self.length[own] - size >= j]
            yield some, runs[self.start[some] + j]

    def prefixes(self, seen: dict[int, np.ndarray]) -> dict[int, tuple]:
        """Of each window its rarest shingle: (lookup, edges, window, offset), by shingle size."""
        out = {}
        for size in self.shingles:
            rarest = np.full(len(self.start), np.iinfo(np.int64).max)
            value, offset = np.zeros(len(self.start), np.uint64), np.zeros(len(self.start), np.int64)
            for j, (own, runs) in enumerate(self._offsets(size)):
                rarity = seen[size][np.searchsorted(self.shingles[size], runs)]
                less = (rarity < rarest[own]) | (rarity == rarest[own]) & (runs < value[own])
                at = own[less]
                rarest[at], value[at], offset[at] = rarity[less], runs[less], j
            own = np.flatnonzero(self.size == size)
            order = own[np.argsort(value[own], kind="stable")]
            keys, edge = np.unique(value[order], return_index=True)
            out[size] = Lookup(keys), np.append(edge, len(order)), order, offset[order]
        return out

    def words(self, window: int) -> list[bytes]:
        a, n = self.start[window], self.length[window]
        return _WORD.findall(self.buf[self.first[a] : self.last[a + n - 1]].tobytes())

    def items(self, windows: np.ndarray) -> list[str]:
        """The names of the items that some windows stand in, sorted."""
        own = np.unique(np.concatenate([self.name[self.name_edge[w] : self.name_edge[w + 1]] for w in windows.tolist()]))
        return self.names[own].tolist()

    def for_tasks(self) -> Index:
        """Without what only the search for prefixes needs."""
        out = Index.__new__(Index)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("h", "shingles", "size")}
        return out


def _frequencies(docs: DataFrame, text: str, index: Index) -> dict[int, np.ndarray]:
    """How many places in all texts each of the block's shingles has."""
    context = docs.sparkSession.sparkContext
    tables = context.broadcast({size: Lookup(x) for size, x in index.shingles.items()})
    sizes = {size: len(x) for size, x in index.shingles.items()}

    def run(batches):
        total = {size: np.zeros(n, np.int64) for size, n in sizes.items()}
        from siftlake.llm.text import slices

        for batch in batches:
            for part in slices(batch, "t"):
                words = Words(*utf8(part.column(0)), ALNUM)
                h, doc = words.hashes(), words.document()
                for size, table in tables.value.items():
                    runs = combine(h, size)
                    at = table.find(runs)
                    hit = np.flatnonzero(at >= 0)
                    hit = hit[doc[hit] == doc[hit + size - 1]]
                    total[size] += np.bincount(at[hit], minlength=sizes[size])
        for size, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["size", "at", "n"])
        release()

    rows = docs.select(docs[text].cast("string").alias("t")).mapInArrow(run, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).toArrow()
    seen = {size: np.zeros(n, np.int64) for size, n in sizes.items()}
    for size, n in seen.items():
        own = rows.filter(pa.compute.equal(rows["size"], size))
        n[own["at"].to_numpy()] = own["n"].to_numpy()
    tables.destroy()
    return seen


def _finder(index: Index, prefixes: dict):
    memo: dict[tuple[int, bytes], bool] = {}
    length, whole = index.length, index.whole

    def same(window: int, raw: bytes) -> bool:
        key = window, raw
        if key not in memo:
            if len(memo) > 50_000:
                memo.clear()
            memo[key] = _WORD.findall(raw.translate(_FOLD)) == index.words(window)
        return memo[key]

    def find(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each place where a window stands."""
        h, doc = words.hashes(), words.document()
        starts, windows = [], []
        for size, (table, edge, window, offset) in prefixes.items():
            at = table.find(combine(h, size))
            hit = np.flatnonzero(at >= 0)
            at = at[hit]
            count = edge[at + 1] - edge[at]
            entry, place = ragged(edge[at], count), np.repeat(hit, count)
            w, start = window[entry], place - offset[entry]
            inside = (start >= 0) & (start + length[w] <= len(h))
            w, start = w[inside], start[inside]
            inside = doc[start] == doc[start + length[w] - 1] if len(w) else np.zeros(0, bool)
            w, start = w[inside], start[inside]
            for n in np.unique(length[w]):
                own = np.flatnonzero(length[w] == n)
                value = combine(h[(start[own][:, None] + np.arange(n)).ravel()], int(n))[:: int(n)] if len(own) else np.zeros(0, np.uint64)
                good = own[value == whole[w[own]]]
                ok = [same(int(w[i]), bytes(words.buf[words.start[start[i]] : words.end[start[i] + n - 1]])) for i in good.tolist()]
                good = good[np.array(ok, bool)] if ok else good[:0]
                starts.append(start[good])
                windows.append(w[good])
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, n_hit, items, spans): words inside any window, ids of the items whose windows occur, and word ranges [first, last).

    One row for each row of docs, repeated rows too; row holds the kept columns.
    """
    spark, keep = docs.sparkSession, list(docs.columns if keep is None else keep)
    limit = max(1, block_bytes // 4)

    def cut(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, piece in enumerate(cut_item(data, limit, window)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([piece], pa.binary())], ["item", "i", "words"])

    given = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("null")).alias("item"), F.coalesce(benchmark[item_text].cast("string"), F.lit("")).cast("binary").alias("words"))
    rows = written(given.mapInArrow(cut, "item string, i long, words binary"), "items")
    blocks = max(1, math.ceil((rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0) / block_bytes))
    if blocks == 1:
        out = annotate(docs, text, _searched(spark, docs, text, rows, window, shingle), _FOUND, keep)
        discard(rows)
        return out
    key = max(docs.columns, key=len) + "_key"
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "texts")
    found = None
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "i"), F.lit(blocks)) == block)
        some = annotate(keyed, text, _searched(spark, keyed, text, part, window, shingle), _FOUND, [key])
        some = written(some.where(F.size("items") > 0).select(F.col("row")[key].alias("key"), "items", "spans"), "hits")
        found = some if found is None else found.unionByName(some)
    hits = found.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.collect_list("spans")).alias("spans"))
    n_words = annotate(keyed, text, lambda column: [pa.array(Words(*utf8(column), ALNUM).count, pa.int64())], "n_words long", [*keep, key])
    whole = n_words.withColumn("key", F.col("row")[key]).join(hits.withColumnRenamed("items", "i").withColumnRenamed("spans", "s"), "key", "left")
    spans = F.coalesce("s", F.array().cast("array<long>"))
    whole = whole.select(F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"), "n_words", F.coalesce("i", F.array().cast("array<string>")).alias("items"), spans.alias("spans"))
    return whole.select("row", "n_words", F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)").alias("n_hit"), "items", "spans")


_FOUND = "n_words long, n_hit long, items array<string>, spans array<long>"


def _searched(spark, docs: DataFrame, text: str, rows: DataFrame, window: int, shingle: int):
    """The function of texts that looks for one block of items, rows (item, words)."""
    block = rows.select("item", "words").toArrow().combine_chunks()
    texts = block["words"].combine_chunks() if block.num_rows else pa.array([], pa.binary())
    index = Index(block["item"].to_pylist(), texts, window, shingle)
    prefixes = index.prefixes(_frequencies(docs, text, index))
    shared = spark.sparkContext.broadcast((index.for_tasks(), prefixes))
    del index, prefixes

    def run(column):
        words = Words(*utf8(column), ALNUM)
        index, prefixes = shared.value
        find = run.__dict__.setdefault("find", None) or _finder(index, prefixes)
        run.find = find
        start, win = find(words)
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + index.length[win], -1)
        hit = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        n_hit = total[words.first[1:]] - total[words.first[:-1]]
        owner = np.searchsorted(words.first, start, "right") - 1
        items: list[list[str]] = [[]] * len(words.count)
        spans: list[list[int]] = [[]] * len(words.count)
        order = np.argsort(owner, kind="stable")
        of, cut = np.unique(owner[order], return_index=True)
        for d, own in zip(of.tolist(), np.split(win[order], cut[1:]) if len(of) else [], strict=True):
            items[d] = index.items(np.unique(own))
            flags = np.concatenate(([False], hit[words.first[d] : words.first[d + 1]], [False]))
            spans[d] = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
        return [pa.array(words.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]

    return run


@F.pandas_udf(T.ArrayType(T.LongType()))
def _merged(lists: pd.Series) -> pd.Series:
    """The union of lists of word ranges, each as flat first, last, first, last, ..."""
    out = []
    for several in lists:
        merged: list[int] = []
        for lo, hi in sorted((x[i], x[i + 1]) for x in several for i in range(0, len(x), 2)):
            if merged and merged[-1] >= lo:
                merged[-1] = max(merged[-1], hi)
            else:
                merged += [int(lo), int(hi)]
        out.append(merged)
    return pd.Series(out)


def is_contaminated(n_words, n_hit):
    """At least a twentieth of the words lie inside benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(items) -> object:
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(docs: list[tuple[int, str | None]], benchmark: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by comparing every window at every place."""
    out = []
    grams = [(name, words[i : i + window]) for name, text in benchmark for words in [item_words(text)] for i in range(max(1, len(words) - window + 1) if words else 0)]
    for doc, text in docs:
        words, hit, items = item_words(text), set(), set()
        for name, w in grams:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    items.add(name)
        out.append((doc, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()))
    return out
