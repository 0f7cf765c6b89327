"""SentencePiece unigram encoding and decoding.

The pieces of a model file stand with log scores in a double-array trie over
UTF-8 bytes; the best segmentation is found by Viterbi, in numpy for all distinct
units of a batch at once.  A file of a unigram model has the scores.  A file whose
scores are ranks of merges (0, -1, -2, ...) has no probabilities, and none are
trained here: a piece of rank r gets that of Zipf and Mandelbrot's rule, in
proportion to 1 / (r + MANDELBROT), and its logarithm is the score.  A unit is a run of spaces with the characters up to
the next space: no piece crosses its edge, so segmenting units one by one is
exact (a vocabulary with such a piece is refused).  A text gets one space in
front (the whitespace marker); characters without a piece fall back to their
bytes.  Of equal scores the segmentation with the longest last piece stands,
as in the public library.

A null text has null ids; an empty one has none.  Decoding joins the pieces and
bytes, turns markers to spaces and drops the first; it gives back every text
that holds no marker character itself.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftlake.llm.shared import annotate
from siftlake.llm.text import Words, ragged, strings, utf8

MARK = "▁"
MANDELBROT = 2.7
_UNIT = np.ones(256, bool)


class Vocabulary:
    """Pieces, scores and the double array; byte pieces are not in the trie."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], prefix: bool = True):
        self.prefix = prefix
        self.score = np.array(scores, np.float64)
        self.byte_id = np.full(256, -1, np.int32)
        raw: list[bytes] = []
        words: dict[bytes, int] = {}
        self.unknown = 0
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif kind == "normal":
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} crosses the edge of a unit")
                raw.append(piece.replace(MARK, " ").encode())
                words.setdefault(raw[-1], i)
            else:
                self.unknown = i if kind == "unknown" else self.unknown
                raw.append(b"")
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_edge = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.floor = min(self.score[i] for i in words.values()) - 10.0 if words else -10.0
        self.longest = max(map(len, words), default=1)
        self.base, self.check, self.value = double_array(words)


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of s by byte b is base[s] + b + 1 if its check is s; value is a piece id or -1."""
    root: dict = {}
    for word, i in words.items():
        node = root
        for b in word:
            node = node.setdefault(b, {})
        node[-1] = i
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    used = bytearray(size)
    used[0] = 1
    todo, free = [(0, root)], 1
    while todo:
        state, node = todo.pop()
        value[state] = node.get(-1, -1)
        keys = sorted(k for k in node if k >= 0)
        if not keys:
            continue
        at = max(free - keys[0] - 1, 0)
        tries = 0
        while True:
            if at + 512 > size:
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                used += bytearray(size)
                size *= 2
            if not any(used[at + k + 1] for k in keys):
                break
            at += 1
            tries += 1
        if tries > 64:
            free += tries // 2
        while used[free]:
            free += 1
        base[state] = at
        for k in keys:
            used[at + k + 1] = 1
            check[at + k + 1] = state
            todo.append((at + k + 1, node[k]))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def log_scores(scores: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Log probabilities of the normal pieces: as they are, or where they are ranks by the rule for ranks."""
    own = scores[normal]
    if not len(own) or own.max() > 0 or (own != np.round(own)).any():
        return scores
    out = scores.astype(float)
    p = 1 / (MANDELBROT - own)
    out[normal] = np.log(p / p.sum())
    return out


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file, with log scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal" for i in range(sp.get_piece_size())]
    scores = log_scores(np.array([sp.get_score(i) for i in range(len(kinds))]), np.array([k == "normal" for k in kinds]))
    return Vocabulary([sp.id_to_piece(i) for i in range(len(kinds))], scores, kinds)


def segment(v: Vocabulary, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, edges) of the best segmentation of each unit buf[start:end]; units are adjacent and cover buf."""
    n, units = len(buf), len(start)
    size = end - start
    lead = (buf & 0xC0) != 0x80
    char = np.where(lead, np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4))), 0)
    stop = np.repeat(end, size)
    # all pieces that begin at a character, by walking the trie from every position at once
    at = np.flatnonzero(lead)
    state = np.zeros(len(at), np.int32)
    froms, lengths, pieces = [], [], []
    whole = np.zeros(n, bool)
    for depth in range(v.longest):
        ok = at + depth < stop[at]
        at, state = at[ok], state[ok]
        after = v.base[state] + buf[at + depth] + 1
        ok = (after < len(v.check)) & (v.check[np.minimum(after, len(v.check) - 1)] == state)
        at, state = at[ok], after[ok]
        piece = v.value[state]
        hit = piece >= 0
        froms.append(at[hit])
        lengths.append(np.full(int(hit.sum()), depth + 1))
        pieces.append(piece[hit])
        whole[froms[-1]] |= char[froms[-1]] == depth + 1
    bare = np.flatnonzero(lead & ~whole)
    froms.append(bare)
    lengths.append(np.minimum(char[bare], stop[bare] - bare))
    pieces.append(np.full(len(bare), -1, np.int32))
    source, length, piece = np.concatenate(froms), np.concatenate(lengths), np.concatenate(pieces)
    gain = np.where(piece >= 0, v.score[piece], v.floor)
    # relax by the position inside the unit: earlier starts first, later ones only if better
    offset = source - np.repeat(start, size)[source]
    order = np.lexsort((length, source, offset))
    source, length, piece, gain, offset = source[order], length[order], piece[order], gain[order], offset[order]
    place = np.arange(n) - np.repeat(start, size)
    best = np.full(n + units + 1, -np.inf)
    back = np.full(n + units + 1, -1, np.int64)
    shift = np.repeat(np.arange(units), size)  # each unit has one node more than bytes
    best[start + np.arange(units)] = 0.0
    node_from = source + shift[source]
    node_to = node_from + length
    edge = np.searchsorted(offset, np.arange((int(place.max()) if n else 0) + 2))
    # of one offset all targets differ between units, and inside a unit between lengths
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if lo == hi:
            continue
        value = best[node_from[lo:hi]] + gain[lo:hi]
        to = node_to[lo:hi]
        better = value > best[to]
        best[to[better]] = value[better]
        back[to[better]] = np.arange(lo, hi)[better]
    # walk back from every unit's end
    now, unit = end + np.arange(units), np.arange(units)
    who, what = [], []
    while len(now):
        e = back[now]
        alive = e >= 0
        e, unit = e[alive], unit[alive]
        who.append(unit)
        what.append(e)
        now = node_from[e]
    who, what = np.concatenate(who[::-1]) if who else np.zeros(0, np.int64), np.concatenate(what[::-1]) if what else np.zeros(0, np.int64)
    order = np.argsort(who, kind="stable")
    who, what = who[order], what[order]
    ids = piece[what]
    if (ids < 0).any():
        # bytes of the characters without a piece
        times = np.where(ids < 0, length[what], 1)
        if (v.byte_id < 0).any():
            times[:] = 1
            ids = np.where(ids < 0, v.unknown, ids)
        else:
            spread = ragged(np.where(ids < 0, source[what], 0), times)
            ids = np.where(np.repeat(ids < 0, times), v.byte_id[buf[spread]], np.repeat(ids, times))
        who = np.repeat(who, times)
    return ids.astype(np.int32), np.searchsorted(who, np.arange(units + 1))


def encode(v: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, edges) of each text."""
    buf, offsets = utf8(column)
    n = np.diff(offsets)
    if MARK.encode() in buf.tobytes():
        column = pa.array([None if x is None else x.replace(MARK, " ") for x in strings(column)], pa.string())
        buf, offsets = utf8(column)
        n = np.diff(offsets)
    if v.prefix:  # one space in front of each text that is not empty
        full = n > 0
        grown = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n + full, out=grown[1:])
        out = np.full(int(grown[-1]), 32, np.uint8)
        out[ragged(grown[:-1] + full, n)] = buf
        buf, offsets = out, grown
    space = buf == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(buf)) if len(start) else start
    words = Words.__new__(Words)
    words.buf, words.start, words.end = buf, start, end
    h = _exact_hashes(words)
    _, first, unit = np.unique(h, return_index=True, return_inverse=True)
    size = end[first] - start[first]
    flat = buf[ragged(start[first], size)]
    edge = np.concatenate(([0], np.cumsum(size)))
    if not np.array_equal(np.diff(np.append(start, len(buf))), size[unit]) or not np.array_equal(flat[ragged(edge[:-1][unit], size[unit])], buf):
        # two different units have one hash: they are told apart by their bytes
        known: dict[bytes, int] = {}
        unit = np.array([known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        flat = np.frombuffer(b"".join(known), np.uint8)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in known])))
    ids, cut = segment(v, flat, edge[:-1], edge[1:])
    count = np.diff(cut)[unit]
    per_text = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, offsets)]
    return ids[ragged(cut[:-1][unit], count)], per_text


def _exact_hashes(words: Words) -> np.ndarray:
    """Word hashes with case: the folding table treats A-Z as a-z, so capitals add to the hash."""
    h = words.hashes()
    capital = (words.buf >= 65) & (words.buf <= 90)
    if capital.any():
        from siftlake.llm.text import mix, powers

        with np.errstate(over="ignore"):
            p, q = powers(len(words.buf) + 1)
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(capital, p[: len(words.buf)], np.uint64(0)), dtype=np.uint64)))
            extra = (run[words.end] - run[words.start]) * q[words.start]
            h = h ^ np.where(extra == 0, np.uint64(0), mix(extra))
    return h


def decode(v: Vocabulary, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts."""
    size = np.diff(v.piece_edge)[ids]
    out = v.piece_bytes[ragged(v.piece_edge[:-1][ids], size)]
    at = np.concatenate(([0], np.cumsum(size)))[edge]
    if v.prefix:
        drop = (np.diff(at) > 0) & (out[np.minimum(at[:-1], max(len(out) - 1, 0))] == 32 if len(out) else np.zeros(len(at) - 1, bool))
        keep = np.ones(len(out), bool)
        keep[at[:-1][drop]] = False
        out, at = out[keep], at - np.concatenate(([0], np.cumsum(drop)))
    return out, at


_CODED = "ids array<int>, n_fallback long, score double, same boolean"


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """(row, ids, n_fallback, score, same): piece ids, how many are bytes, the sum of log scores, whether decoding gives the text back.

    With digest, (n_tokens, ids_crc32) - of the ids as little-endian 32-bit integers - stand for ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(column):
        v = shared.value
        ids, edge = encode(v, column)
        null = column.is_null().to_numpy(zero_copy_only=False)
        raw, at = decode(v, ids, edge)
        buf, offsets = utf8(column)
        same = [bool(np.array_equal(raw[a:b], buf[c:d])) for a, b, c, d in zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)]
        fell = np.concatenate(([0], np.cumsum(v.is_byte[ids])))
        score = np.concatenate(([0.0], np.cumsum(np.where(v.is_byte[ids], 0.0, v.score[ids]))))
        rest = [pa.array(fell[edge[1:]] - fell[edge[:-1]], pa.int64()), pa.array(score[edge[1:]] - score[edge[:-1]], pa.float64()), pa.array(same, pa.bool_(), mask=null)]
        if digest:
            small = ids.astype("<u4")
            return [pa.array(np.diff(edge), pa.int64()), pa.array([zlib.crc32(small[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.int64()), *rest]
        made = pa.ListArray.from_arrays(pa.array(np.where(np.append(null, False), None, edge.astype(np.int32)) if null.any() else edge.astype(np.int32), pa.int32()), pa.array(ids, pa.int32()))
        return [made, *rest]

    return annotate(docs, text, run, ("n_tokens long, ids_crc32 long, " + _CODED.split(", ", 1)[1]) if digest else _CODED, keep)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df's rows with the text of their ids in the column `into`; null ids give null."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def text_of(column):
        import pandas as pd

        v = shared.value
        out = []
        for x in column:
            raw, _ = decode(v, np.asarray(x, np.int64), np.array([0, len(x)])) if x is not None else (None, None)
            out.append(None if raw is None else raw.tobytes().decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return df.withColumn(into, text_of(df[ids]))
