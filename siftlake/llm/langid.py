"""Language identification with a byte convolutional network, trained in numpy.

Bytes fall into 128 symbols (letters without case, one digit, one mark, the
bytes of other scripts).  Filters of widths 2, 3 and 4 run over windows of
WINDOW bytes; each filter's largest rectified response goes to a softmax over
the languages.  A text's probabilities are the means over all its windows, the
last one padded, so every byte of every text counts.  For inference a filter is
a sum of rows of pair tables, which numpy gathers for whole batches of windows.

The network is fitted on a bounded sample of the labelled rows: about
`per_language` texts of each language (chosen by a hash of the id, so the same
at every run), of each three windows.  A null text or one without a letter is
`und` with score 0; so is every text if no text that is not empty is labelled.
Null labels are not learned; ties go to the first language by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.shared import annotate
from siftlake.llm.text import utf8

WINDOW, FILTERS, WIDTHS, SYMBOLS = 128, 16, (2, 3, 4), 128
PER_LANGUAGE, EPOCHS, BATCH, RATE = 1500, 8, 64, 0.02

SYMBOL = np.full(256, 1, np.uint8)  # marks and controls
SYMBOL[[0]] = 0
SYMBOL[[9, 10, 11, 12, 13, 32]] = 2
SYMBOL[48:58] = 3
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(4, 30)
SYMBOL[128:192] = np.arange(30, 94)  # continuation bytes
SYMBOL[192:256] = 94 + np.arange(64) // 2  # leading bytes
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of each window, its text): runs of WINDOW bytes; the last is padded with 0. Empty texts have none."""
    n = np.diff(offsets)
    count = -(-n // WINDOW)
    owner = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    left = np.minimum(n[owner] - start, WINDOW)
    at = (offsets[:-1][owner] + start)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < left[:, None]
    symbols = np.zeros(at.shape, np.uint8)
    symbols[inside] = SYMBOL[buf[at[inside]]]
    return symbols, owner


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.table = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def _responses(self, x: np.ndarray, k: int) -> np.ndarray:
        w, size = WIDTHS[k], WINDOW - WIDTHS[k] + 1
        total = self.table[k][0][x[:, :size]]
        for j in range(1, w):
            total += self.table[k][j][x[:, j : j + size]]
        return total

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam on the cross entropy; only the position of each filter's maximum gets a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.table, *self.bias, self.out, self.shift]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, rows = 0, np.arange
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                pick = order[lo : lo + BATCH]
                xb, yb, m = x[pick], y[pick], len(pick)
                where, pooled = [], []
                for k in range(len(WIDTHS)):
                    r = self._responses(xb, k)
                    best = r.argmax(1)
                    where.append(best)
                    pooled.append(np.take_along_axis(r, best[:, None, :], 1)[:, 0, :] + self.bias[k])
                raw = np.concatenate(pooled, 1)
                p = _softmax(np.maximum(raw, 0) @ self.out + self.shift)
                p[rows(m), yb] -= 1
                p /= m
                back = (p @ self.out.T) * (raw > 0)
                grads = [np.zeros_like(t) for t in self.table]
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(grads[k][j], (xb[rows(m)[:, None], where[k] + j], rows(FILTERS)[None, :]), g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
                grads += [np.maximum(raw, 0).T @ p, p.sum(0)]
                step += 1
                rate = RATE * (1 - lo / len(x) / epochs)
                for q, g, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)

    def compiled(self) -> tuple:
        """Tables of symbol pairs: width 2 is one, width 3 a pair and a symbol, width 4 two pairs."""
        def pair(t, i):
            return (t[i][:, None, :] + t[i + 1][None, :, :]).reshape(SYMBOLS * SYMBOLS, FILTERS)

        two, three, four = self.table
        return pair(two, 0), pair(three, 0), three[2], pair(four, 0), pair(four, 2), np.concatenate(self.bias), self.out, self.shift


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def probabilities(compiled: tuple, symbols: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Of each window, the probability of each language."""
    two, three, last, four, end, bias, out, shift = compiled
    made = np.empty((len(symbols), len(bias)), np.float32)
    for lo in range(0, len(symbols), chunk):
        x = symbols[lo : lo + chunk].astype(np.int32)
        pairs = x[:, :-1] * SYMBOLS + x[:, 1:]
        rows = made[lo : lo + chunk]
        rows[:, :FILTERS] = two[pairs].max(1)
        r = three[pairs[:, :-1]]
        r += last[x[:, 2:]]
        rows[:, FILTERS : 2 * FILTERS] = r.max(1)
        r = four[pairs[:, :-2]]
        r += end[pairs[:, 2:]]
        rows[:, 2 * FILTERS :] = r.max(1)
    return _softmax(np.maximum(made + bias, 0) @ out + shift) if len(made) else np.zeros((0, len(shift)))


def train(rows: DataFrame, text: str, lang: str, id: str, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network fitted on about per_language texts of each language in rows; None if there are none."""
    rows = rows.where(rows[lang].isNotNull() & rows[text].isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(rows[lang]).count().collect()}
    if not counts:
        return None
    n = F.char_length(rows[text])
    spots = F.array(*[F.substring(rows[text], at, F.lit(WINDOW)) for at in (F.lit(1), F.greatest((n / 2).cast("int"), F.lit(1)), F.greatest(n - WINDOW, F.lit(1)))])
    part = F.lit(0.0)
    for name, total in counts.items():
        part = F.when(rows[lang] == name, F.lit(per_language / total)).otherwise(part)
    chosen = F.pmod(F.xxhash64(rows[id].cast("string")), F.lit(1_000_003)) / 1_000_003.0 < part
    got = sorted(((r[0], r[1], r[2]) for r in rows.where(chosen).select(rows[id].cast("string"), rows[lang], spots).toLocalIterator()), key=lambda r: (str(r[0]), r[1], r[2]))
    languages = sorted(counts)
    net = Network(languages)
    texts = [(spot, languages.index(name)) for _, name, cuts in got for spot in dict.fromkeys(cuts) if spot]
    if not texts:
        return None
    x, owner = windows(*utf8(pa.array([t for t, _ in texts])))
    net.fit(x, np.array([y for _, y in texts])[owner])
    return net


def lettered(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the texts that hold a letter of any script."""
    total = np.concatenate(([0], np.cumsum(_LETTER[buf])))
    letters = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
        letters[i] = any(c.isalpha() for c in bytes(buf[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return letters


def predict(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score): one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((net.compiled(), net.languages) if net else None)

    def run(column):
        buf, offsets = utf8(column)
        n = len(column)
        letters = lettered(buf, offsets)
        if shared.value is None:
            return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))]
        compiled, languages = shared.value
        symbols, owner = windows(buf, offsets)
        p = probabilities(compiled, symbols)
        mean = np.stack([np.bincount(owner, p[:, k], n) for k in range(len(languages))], 1) / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        best = mean.argmax(1)
        return [pa.array([languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], pa.string()), pa.array(np.where(letters, np.clip(mean[np.arange(n), best], 0, 1), 0.0))]

    return annotate(docs, text, run, "lang_pred string, score double", keep)


def fold(id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", keep: list[str] | None = None, folds: int = 4, held: int = 2) -> DataFrame:
    """predict() with a network that learns from the rows outside the held fold."""
    return predict(docs, train(docs.where(fold(docs[id], folds) != held), text, lang, id), text, keep)


def known(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", least: float = 1.2, folds: int = 4, held: int = 2) -> DataFrame:
    """docs without those of undetermined language: no letter, or no language with `least` times the probability that a guess among all languages has; where no text is labelled, without those that have no letter."""
    net = train(docs.where(fold(docs[id], folds) != held), text, lang, id)
    if net is None:
        return annotate(docs, text, lambda column: [pa.array(lettered(*utf8(column)))], "letters boolean").where("letters").select("row.*")
    return predict(docs, net, text).where((F.col("lang_pred") != "und") & (F.col("score") * len(net.languages) >= least)).select("row.*")
