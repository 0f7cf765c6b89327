"""Each operator on the small fixture: defined results for every odd case, and brute force."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import decontaminate, jaccard, langid, licenses, multiset, ppm, preference, shared, tokenpack, unigram, warc
from siftlake.llm.components import components

LONG = "lorem " * 30_000

FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
ALNUM, NONSPACE = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[^\x20\x09-\x0D]+"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def pieces(text, pattern):
    return regex.findall(pattern, (text or "").encode().translate(FOLD))


# 1 ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def benchmark(texts):
    plain = dict(t for t in texts if t[0])
    long = plain[10].split()
    return [("1", " ".join(long[5:25])), ("2", "one two"), ("3", None), ("4", " !! "), ("10", " ".join(long[5:25]).upper()), ("5", plain[11][:80]), ("null", plain[12]), ("6", "lorem")]


@pytest.mark.parametrize("block_bytes", [16 << 20, 600, 300])
def test_decontamination_matches_brute_force(spark, docs, texts, benchmark, block_bytes):
    items = spark.createDataFrame([(None if n == "null" else int(n), t, 3) for n, t in benchmark], "item_id long, text string, n_hit long")
    got = decontaminate.decontaminate(docs, items, keep=["doc_id"], block_bytes=block_bytes)
    got = got.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long"), decontaminate.digest(F.col("items")))
    assert rows_of(got) == Counter(decontaminate.brute_force(texts, benchmark))


def test_long_items_are_cut_without_losing_a_window():
    rng = random.Random(2)
    words = [f"w{rng.randrange(50)}" for _ in range(200)]
    data = " ".join(words).encode()
    for limit in (1, 60, 300, 10_000):
        cut = decontaminate.cut_item(data, limit, 13)
        windows = {tuple(decontaminate.item_words(p.decode())[i : i + 13]) for p in cut for i in range(len(decontaminate.item_words(p.decode())) - 12)}
        assert windows == {tuple(w.encode() for w in words[i : i + 13]) for i in range(188)}
        assert limit < 100 or max(map(len, cut)) <= max(limit, 60)
    assert decontaminate.cut_item(b"... !", 2, 13) == [b""] and decontaminate.cut_item(b"a", 9, 13) == [b"a"]


def test_index_of_many_windows_is_small():
    """Eight megabytes in two blocks: each word hashed once, in bounded time and memory."""
    import time
    import tracemalloc

    rng = np.random.default_rng(1)
    vocabulary = np.array([f"word{i}" for i in range(30_000)])
    texts = pa.array([" ".join(vocabulary[rng.integers(0, 30_000, 400)]) for _ in range(1100)])
    assert texts.nbytes > decontaminate.BLOCK_BYTES
    tracemalloc.start()
    began = time.time()
    index = decontaminate.Index([str(i) for i in range(len(texts))], texts, 13, 5)
    prefixes = index.prefixes({s: np.zeros(len(x), np.int64) for s, x in index.shingles.items()})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.start) == 1100 * 388 and len(prefixes[5][2]) == len(index.start)
    assert time.time() - began < 10 and peak < 250e6, (time.time() - began, peak)


def test_decontamination_of_empty_tables(spark, docs, empty, benchmark):
    items = spark.createDataFrame(benchmark, "item_id string, text string")
    assert decontaminate.decontaminate(empty, items).count() == 0
    none = decontaminate.decontaminate(docs, items.where("false"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == docs.count()
    assert none.select("row.*").columns == docs.columns


# 2 ---------------------------------------------------------------------------------------------
def brute_ppm(training, text, order):
    counts = defaultdict(Counter)
    for t in training:
        b = b"\xff" * order + (t or "").encode() + b"\xff"
        for p in range(order, len(b)):
            for k in range(order + 1):
                counts[b[p - k : p]][b[p]] += 1
    b, total = b"\xff" * order + (text or "").encode() + b"\xff", 0.0
    for p in range(order, len(b)):
        out = set()
        for k in range(order, -1, -1):
            left = {s: c for s, c in counts.get(b[p - k : p], {}).items() if s not in out}
            if not left:
                continue
            n = sum(left.values())
            if b[p] in left:
                total += math.log10((2 * left[b[p]] - 1) / (2 * n))
                break
            total += math.log10(len(left) / (2 * n))
            out |= set(left)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_parts_of_contexts_are_bounded(spark):
    """Two bytes with more contexts than a part may have are divided by the bytes before; every context is in one part."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("abc") for _ in range(40)) + "zz" for _ in range(300)] + ["xy" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = ppm._counted(rows, 5, 8)
    *_, pairs, one = ppm._sums(counts, 16, 8)
    assert pairs.max() > 60
    seen = Counter()
    for shard in (20, 60):
        seen.clear()
        for part, trie in ppm._tries(counts, pairs, one, 5, shard):
            keys = trie.levels[5][0]
            assert len(keys) <= shard and part.own(keys).all()
            seen.update(keys.tolist())
        assert len(seen) == pairs.sum() and set(seen.values()) == {1}


@pytest.mark.parametrize("shard, hot, dealt", [(1 << 22, 1 << 20, None), (500, 16, None), (120, 16, None), (10, 16, 500), (10, 16, 100)])
def test_ppm_matches_brute_force(docs, texts, shard, hot, dealt):
    """With one part, some parts in turn, and all places dealt to parts and to several tasks of a part."""
    how = {"serial": 0, "dealt": dealt, "places": 200} if dealt else {"serial": 1 << 30}
    small = docs.where("doc_id is null or doc_id <> 4")
    training = small.where("doc_id is null or doc_id % 5 <> 1")
    learned = [t for i, t in texts if i != 4 and (i is None or i % 5 != 1)]
    tokens = {(i, t): [*pieces(t, NONSPACE), None] for i, t in texts}
    count = Counter(w for i, t in texts if i != 4 and (i is None or i % 5 != 1) for w in tokens[i, t])
    n, v = sum(count.values()), len(count)
    got = sorted(ppm.score(small, training, order=3, shard=shard, hot=hot, **how).collect(), key=str)
    want = []
    for i, t in texts:
        if i != 4:
            ws = tokens[i, t]
            want.append((i, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), brute_ppm(learned, t, 3)))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[1], round(r[5], 3))), sorted(want, key=lambda r: (str(r[0]), r[1], round(r[5], 3))), strict=True):
        assert tuple(a[:4]) == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-6)


def test_ppm_without_training(docs, empty):
    got = ppm.score(docs, empty).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert all(r.score == pytest.approx(-math.log10(256)) for r in got if r.id == 2)
    assert ppm.score(empty, docs).count() == 0


# 3 ---------------------------------------------------------------------------------------------
def test_fingerprints(spark, docs, texts, empty):
    rows = multiset.with_next(docs).withColumn("edited", F.expr(multiset.edited("text", "next_text"))).collect()
    order = sorted(((i, t or "") for i, t in texts), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want[i, t, t[: len(t) - len(t) // 2] + after[: len(t) // 2]] += 1
    assert Counter((r.id, r.text, r.edited) for r in rows) == want
    by = {}
    for r in rows:
        assert by.setdefault(r.text, r.fp) == r.fp
    assert len({tuple(x) for x in by.values()}) == len(by)
    assert multiset.with_next(empty).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        multiset.with_next(docs.withColumn("doc_id", F.lit("x7"))).collect()


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a b c d\ne f g h\n", "e f g h\na b c d\n", "a b c d\n", "e f g h\n", "", "z y x w v u t s")], "ab string, ba string, a string, b string, none string, z string")
    fp = {c: multiset.fingerprint(c) for c in df.columns}
    r = df.selectExpr(f"{fp['ab']} = {fp['ba']} AS order", f"{multiset.added(fp['a'], fp['b'])} = {fp['ab']} AS added", f"{multiset.removed(fp['ab'], fp['b'])} = {fp['a']} AS removed", f"{fp['a']} = {fp['b']} AS differ", f"{multiset.likenesses(fp['ab'], {'x': fp['ba'], 'y': fp['none'], 'z': fp['a']})} AS l").first()
    assert r.order and r.added and r.removed and not r.differ
    assert r.l.x == 1 and r.l.y == 0 and 0.4 < r.l.z < 1
    many = spark.range(1).selectExpr("repeat('a b c d\\n', 3000) AS t").selectExpr(f"{multiset.fingerprint('t')} AS f").first().f
    assert many[0] == 3000


def brute_fingerprint(text):
    """From the definition, with another implementation of the hash."""
    def xx(p, seed=None):
        start = 42 if seed is None else xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        return xxhash.xxh64(p.encode(), seed=start).intdigest()

    top = 2**62 - 1
    runs = regex.findall(r"[^\n ]{1,48}(?: +[^\n ]{1,48}){0,3} *\n?|[\n ]+", text)
    lines = regex.findall(r"[^\n]+\n?|\n", text)
    out = [len(runs)]
    for seed in (None, 1):
        h = [xx(p, seed) for p in runs]
        out += [sum(sum(((x >> j + 21 * k) & 1) << 21 * k for k in range(3)) for x in h) & top for j in range(21)]
    return out + [sum(xx(p, seed) & top for p in lines) & top for seed in range(2, 2 + multiset.SUMS)]


def brute_likeness(a, b):
    if a == b or not a[0] or not b[0]:
        return float(a == b)
    u, v = (np.array([2 * ((x >> 21 * k) & (2**21 - 1)) - f[0] for x in f[1:43] for k in range(3)], float) for f in (a, b))
    return float(np.clip(u @ v / math.sqrt((u @ u) * (v @ v)), 0, 1)) if u.any() and v.any() else 0.0


def test_fingerprints_match_brute_force(spark, texts):
    own = sorted({t or "" for _, t in texts if len(t or "") < 5000} | {"a\nb\n\na\n", "x" * 200, "b\na\n\na\n", "  \n ", "l1 w w w w w\nl2\n", "l2\nl1 w w w w w\n"})
    df = spark.createDataFrame(list(enumerate(own)), "i long, t string")
    got = {r.i: r for r in df.selectExpr("i", f"{multiset.fingerprint('t')} AS f", f"{multiset.fingerprint('reverse(t)')} AS g").selectExpr("*", f"{multiset.likenesses('f', {'like': 'g'})} AS l").collect()}
    want = [brute_fingerprint(t) for t in own]
    for i, t in enumerate(own):
        assert list(got[i].f) == want[i], t
        assert got[i].l.like == pytest.approx(brute_likeness(want[i], brute_fingerprint(t[::-1])), abs=1e-12)
    assert want[own.index("a\nb\n\na\n")] == want[own.index("b\na\n\na\n")] and len({tuple(w) for w in want}) == len(own) - 2


def test_edited_texts_are_likelier_than_the_next(spark):
    """Half of a text stays, so its likeness is near a half; different texts have next to none."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(40)], "doc_id long, text string")
    rows = multiset.with_next(df).selectExpr("*", f"{multiset.edited('text', 'next_text')} AS e").selectExpr("*", f"{multiset.fingerprint('e')} AS ef")
    got = rows.selectExpr(f"{multiset.likenesses('fp', {'near': 'ef', 'far': 'next_fp'})} AS l").collect()
    assert all(0.2 < r.l.near < 0.8 and r.l.far < r.l.near for r in got) and np.mean([r.l.far for r in got]) < 0.1


# 4 ---------------------------------------------------------------------------------------------
def test_license_scan(spark, empty):
    rows = [
        (1, "This is CC-BY work. All rights\nreserved! cc by", 3, "cc-by,reserved", "cc-by,reserved"),
        (2, "Released under the GNU Generl Public License.", 0, "", "gpl"),
        (3, "Permission is herebv granted, free of charge,  to any persn obtaining a copy", 0, "", "mit"),
        (4, "nothing of the sort, no rights", 0, "", ""),
        (5, None, 0, "", ""),
        (6, "general public license", 1, "gpl", "gpl"),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r[0].doc_id: r for r in licenses.scan(docs).collect()}
    for i, _, n, base, labels in rows:
        assert (got[i].n_base, got[i].base_labels, got[i].labels) == (n, base, labels), i
        assert (got[i].first_word is None) == (n == 0) and 0 <= got[i].score <= 1 and (got[i].score > 0) == bool(labels)
    assert (got[1].first_word, got[1].last_word) == (2, 8)
    assert got[2].spans[0].edits == 1 and got[3].spans[0].edits == 2
    assert licenses.scan(empty).count() == 0


def test_pieces_find_every_match_with_few_edits():
    rng = random.Random(3)
    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    for notice, label in licenses.NOTICES.items():
        for _ in range(20):
            t = list(notice)
            for _ in range(rng.randint(0, licenses.edits_of(notice))):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["x"], [t[at], "y"]])
            text = "before it " + "".join(t) + " and after"
            assert label in {scanner.notices[f[0]][1] for f in scanner.fuzzy(text)}, text


@pytest.mark.parametrize("before, after", [("", " and after"), ("before it ", ""), ("", "")])
def test_pieces_find_matches_at_the_ends_of_a_text(before, after):
    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    for notice, label in licenses.NOTICES.items():
        some = [notice[:at] + notice[at + 1 :] for at in range(len(notice))]
        for _ in range(20):
            t = list(notice)
            for _ in range(rng.randint(0, licenses.edits_of(notice))):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["x"], [t[at], "y"]])
            some.append("".join(t))
        for t in some:
            assert label in {scanner.notices[f[0]][1] for f in scanner.fuzzy(before + t + after)}, t


def brute_scan(text):
    """All word positions for the phrases, and each notice's pattern over the whole text."""
    words = [w.decode("utf-8", "replace") for w in pieces(text, ALNUM)]
    base, places = set(), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    flat = regex.sub(r"\s+", " ", (text or "").encode().translate(FOLD).decode())
    near, best = set(), 1.0 if base else 0.0
    for notice, label in licenses.NOTICES.items():
        found = regex.search(f"(?be)(?<![0-9a-z\\x80-\\U0010FFFF])(?:{regex.escape(notice)}){{e<={licenses.edits_of(notice)}}}(?![0-9a-z\\x80-\\U0010FFFF])", flat)
        if found:
            near.add(label)
            best = max(best, 1 - sum(found.fuzzy_counts) / len(notice))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | near)), best


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(8)
    notices, filler = list(licenses.NOTICES), ["the", "small", "works", "un", "by", "cc", "all", "rights", "reserved", "public", "license", "straße", "—", "a.b"]
    texts = []
    for _ in range(150):
        parts = [rng.choice(filler) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            t = list(rng.choice(notices))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["q"], [t[at], "z"], [t[at], " "]])
            parts.insert(rng.randint(0, len(parts)), "".join(t).title() if rng.random() < 0.3 else "".join(t))
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    texts += [None, "", "cc by cc by cc by", "the small rights reserved here", "unlicensed under cc byte", LONG + "all rights reserved", LONG]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score double")
    got = {r["row"].doc_id: r for r in licenses.scan(df.union(df.where("doc_id = 3"))).collect()}
    for i, t in enumerate(texts):
        *want, best = brute_scan(t)
        r = got[i]
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels] == want, t
        assert r.score == pytest.approx(best), t
    assert got[len(texts) - 4].labels == "" and got[len(texts) - 2].labels == "reserved"


def test_bytes_that_are_no_text(spark):
    """One rule for all: they are kept where bytes count, and the replacement character where characters do."""
    raw = spark.createDataFrame([(1, bytearray(b"cc by \xff\xfe all rights reserved one two three four"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text", "cast(b as string) as html", "doc_id as page_id", "cast(null as string) as url")
    r = licenses.scan(raw, keep=["doc_id"]).first()
    assert (r.n_words, r.labels) == (10, "cc-by,reserved")
    files = tokenpack.write_ids(raw, BPE)
    assert tokenpack.read_ids(spark, files).first().n_tokens == len(tokenpack.Encoder(BPE).encode(["cc by \ufffd\ufffd all rights reserved one two three four"], 0)[0])
    page = warc.read_archives(warc.normalise_archives(warc.write_archives(raw))).first()
    assert page.payload_digest == warc.base32(hashlib.sha1(b"cc by \xff\xfe all rights reserved one two three four").digest())
    items = raw.selectExpr("doc_id as item_id", "text")
    assert decontaminate.decontaminate(raw, items).first().n_hit == 10
    assert jaccard.jaccard_components(raw).first().n_shingles == 6
    assert langid.predict(raw, None).first().lang_pred == "und" and ppm.score(raw, raw).count() == 1
    assert unigram.encode_texts(raw, PIECES).count() == 1


# 5 ---------------------------------------------------------------------------------------------
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def slow_viterbi(v, scores, text):
    text = " " + text if text else ""
    best = [0.0] + [-math.inf] * len(text)
    back = [None] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 26) + 1):
            gain = scores.get(text[i:j], v.floor if j == i + 1 else None)
            if gain is not None and best[i] + gain > best[j]:
                best[j], back[j] = best[i] + gain, i
    return best[-1]


def test_unigram_scores_and_round_trip(docs, texts, empty):
    import sentencepiece

    v = unigram.load(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    scores = {sp.id_to_piece(i).replace("▁", " "): v.score[i] for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    own = [t for _, t in texts if t and len(t) < 1000]
    ids, edge = unigram.encode(v, pa.array(own))
    for t, a, b in zip(own, edge[:-1], edge[1:], strict=True):
        got = ids[a:b]
        missing = sum(c not in scores for c in t)
        total = sum(v.score[i] for i in got if not v.is_byte[i]) + missing * v.floor
        assert total == pytest.approx(slow_viterbi(v, scores, t))
    coded = unigram.encode_texts(docs, PIECES)
    for r in unigram.decode_ids(coded.select("row.doc_id", "row.text", "ids", "same"), PIECES).collect():
        assert (r.ids is None) == (r.text is None)
        assert r.decoded == r.text and (r.same or r.text is None)
    digest = unigram.encode_texts(docs, PIECES, digest=True).collect()
    direct = Counter((r[0].doc_id, len(r.ids or []), zlib.crc32(np.array(r.ids or [], "<u4").tobytes())) for r in coded.collect())
    assert Counter((r[0].doc_id, r.n_tokens, r.ids_crc32) for r in digest) == direct
    assert unigram.encode_texts(empty, PIECES).count() == 0


def test_log_scores_are_probabilities():
    import sentencepiece

    v = unigram.load(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    own = v.score[normal]
    assert np.exp(own).sum() == pytest.approx(1) and (np.argsort(-own, kind="stable") == np.argsort([-sp.get_score(i) for i in normal], kind="stable")).all()
    assert own.max() < -1 and v.floor < own.min()
    given = np.log([0.5, 0.25, 0.25])
    assert (unigram.log_scores(given, np.ones(3, bool)) == given).all()


def test_units_of_one_hash_stay_apart(monkeypatch):
    v, texts = unigram.load(PIECES), pa.array(["one two one", "", None, "two three"])
    want = unigram.encode(v, texts)
    monkeypatch.setattr(unigram, "_exact_hashes", lambda words: np.zeros(len(words.start), np.uint64))
    got = unigram.encode(v, texts)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_double_array_holds_all_words():
    words = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "ä", "äß", "zz"])}
    base, check, value = unigram.double_array(words)
    def find(w):
        s = 0
        for b in w:
            t = base[s] + b + 1
            if check[t] != s:
                return -1
            s = t
        return value[s]
    assert all(find(w) == i for w, i in words.items())
    assert find(b"ac") == find(b"z") == find(b"abcd") == -1


# 6 ---------------------------------------------------------------------------------------------
def test_preference_pairs(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, "user", None), (2, 0, "user", "alone"), (5, 0, None, "x"), (6, 0, "user", "s"), (6, 0, "user", "s"), (7, 0, "user", "s"), (7, 1, "user", "s")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair: r for r in preference.format_pairs(df, F.floor(df.conv_id / 2), df.conv_id % 2 == 1).collect()}
    assert got[0].n_prompt_turns == 1 and got[0].prompt == "<|user|>\nhi<|end|>\n"
    assert got[0].chosen == "<|assistant|>\na<|end|>\n" and got[0].rejected == "<|assistant|>\nb<|end|>\n<|user|>\n<|end|>\n"
    (first, last), = got[0].chosen_mask
    assert got[0].chosen[first:last] == "a<|end|>" and got[0].rejected[slice(*got[0].rejected_mask[0])] == "b<|end|>"
    assert got[1].rejected is None and got[1].prompt == "" and got[1].chosen == "<|user|>\nalone<|end|>\n"
    assert got[2].chosen is None and got[2].rejected == "<||>\nx<|end|>\n"
    assert got[3].n_prompt_turns == 2 and got[3].chosen == got[3].rejected == ""
    assert preference.format_pairs(df.where("false"), df.conv_id, df.conv_id > 0).count() == 0


def test_pairs_of_any_conversation_number(spark, docs):
    ids = [2**60, 2**60 + 1, 2**60 + 2, 2**60 + 3, -1, -2, -3, None, None, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(c, 0, "user", f"t{k}" if c is None else "same", k) for k, c in enumerate(ids)], "conv_id long, turn long, role string, text string, pair long")
    rows = preference.format_pairs(df, *preference.halves(df.conv_id)).collect()
    got = Counter((r.pair, r.n_prompt_turns, r.chosen, r.rejected) for r in rows)
    alone = "<|user|>\nsame<|end|>\n"
    assert got == Counter([(2**59, 1, "", ""), (2**59 + 1, 1, "", ""), (-1, 1, "", ""), (-2, 0, None, alone), (2**62 - 1, 0, None, alone), (-(2**62), 0, alone, None), (None, 0, "<|user|>\nt7<|end|>\n", None), (None, 0, "<|user|>\nt8<|end|>\n", None)])
    clash = docs.selectExpr("doc_id as conv_id", "n_words as turn", "'assistant' as role", "text", "row as chosen", "k0 as pair", "score as c")
    long = preference.format_pairs(clash, *preference.halves(clash.conv_id)).where("pair = 2").first()
    assert len(long.chosen) > 180_000 and long.chosen_mask[0][1] == len(long.chosen) - 1


# 7 ---------------------------------------------------------------------------------------------
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 31])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003).astype(np.uint32)
    data = tokenpack.pack_ids(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (tokenpack.unpack_ids(data, len(ids), bits) == ids).all()
    assert tokenpack.bits_for(2**bits) == bits and tokenpack.bits_for(2**bits + 1) == bits + 1


def test_chunks_encode_like_whole_texts(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    odd = ["a  b", "a \nb", "x\n \ny", " lead", "trail ", "a\n\n b", "it's  they'll we're", "<|endoftext|> z<|endoftext|>", "é  b　c  d", "a\0 b", "tab\t x", "'s 't", "1 234 5a"]
    coder, every = tokenpack.Encoder(BPE), odd + [t for _, t in texts]
    for _ in range(2):  # the second time from memory
        ids, edge = coder.encode(every, 0)
        for t, a, b in zip(every, edge[:-1], edge[1:], strict=True):
            assert ids[a:b].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 0], t


@pytest.mark.parametrize("block, file_ids", [(1 << 14, 1 << 26), (7, 50)])
def test_files_of_ids(spark, docs, texts, empty, block, file_ids):
    from tokenizers import Tokenizer

    plain, want, at = Tokenizer.from_file(BPE), [], 0
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    files = tokenpack.write_ids(docs, BPE, block=block, file_ids=file_ids)
    assert rows_of(tokenpack.read_ids(spark, files)) == Counter(want)
    first = files.orderBy("part", "seq").first()
    reader = tokenpack.Reader(first.uri)
    everything = reader.ids(0, reader.n_ids)
    assert (reader.ids(3, min(20, reader.n_ids)) == everything[3:20]).all() and len(reader.ids(5, 5)) == 0
    assert (reader.document(0) == everything[: reader.starts[1]]).all()
    assert tokenpack.read_ids(spark, tokenpack.write_ids(empty, BPE)).count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder, plain = tokenpack.Encoder(path), Tokenizer.from_file(path)
    assert tokenpack.Encoder(BPE).chunked and not coder.chunked
    texts = ["One two  three", "it's 4 you", None, "x"]
    ids, edge = coder.encode(texts, None)
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


# 8 ---------------------------------------------------------------------------------------------
def test_archives(spark):
    long = "x" * 3_000_000 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/b c\n", "same"), (2, None, "same"), (5, "http://ü", "same"), (3, "u", None), (4, "u", ""), (7, "u", long), (8, "u", "é漢"), (9, "u", "é漢"), (9, "u", "é漢"), (None, "u", "same"), (None, "u", "single")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(1))
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in pages:
        h = h or ""
        top = largest[h]
        revisit = sum((x[2] or "") == h for x in pages) > 1 and top >= 0 and i != top
        want[i, len(h.encode()), warc.base32(hashlib.sha1(h.encode()).digest()), "revisit" if revisit else "response", top if revisit else None] += 1
    members = warc.normalise_archives(warc.write_archives(df))
    assert rows_of(warc.read_archives(members).drop("url")) == want
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_archives(members, with_payload=True).where("record_type = 'response'").collect()}
    assert payloads[7] == long.encode() and payloads[5] == b"same"
    one = members.first()
    fs, path = tokenpack.store(one.uri)
    assert len(fs.open_input_stream(path + ".idx").read().splitlines()) == one.n
    none = df.where("false")
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(none))).count() == 0
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(df, least=100))).where("record_type = 'revisit'").count() == 0


def test_cut_archives_are_refused(tmp_path):
    import gzip

    whole = warc.record(1, None, b"abc", None, "D")
    (tmp_path / "a.gz").write_bytes(gzip.compress(whole + whole[:-9]))
    with pytest.raises(ValueError):
        warc.normalise(str(tmp_path / "a.gz"), str(tmp_path / "b.gz"))
    (tmp_path / "m.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole))
    assert warc.normalise(str(tmp_path / "m.gz"), str(tmp_path / "c.gz")) == 2


# 9 ---------------------------------------------------------------------------------------------
def test_language(spark, docs, empty):
    rng = random.Random(5)
    alphabet = {"xa": ["ka", "ro", "mi"], "xb": ["st", "el", "ung"], "xc": ["ção", "que", "lh"]}
    rows = [(k, " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 3))) for _ in range(40)), name) for k, (name, a) in enumerate(list(alphabet.items()) * 60)]
    table = spark.createDataFrame([*rows, (900, None, "xa"), (901, "12 !", "xa"), (902, "", None), (903, "karomi roka miro", None)], "doc_id long, text string, lang string")
    got = {r[0].doc_id: r for r in langid.identify(table).collect()}
    assert all(got[k].lang_pred == name and 0 < got[k].score <= 1 for k, _, name in rows)
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903].lang_pred == "xa"
    clean = langid.known(table)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} >= {k for k, _, _ in rows} and clean.where("doc_id in (900, 901, 902)").count() == 0
    assert langid.identify(docs).count() == docs.count() and langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(table.withColumn("text", F.lit(""))).collect()} == {"und"}
    unlabelled = langid.predict(table, None)
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_stage_without_labels(spark, docs):
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, blank, "")
    assert kept.columns == docs.columns
    assert rows_of(kept.select("doc_id", "text")) == rows_of(docs.where("text rlike '\\\\p{L}'").select("doc_id", "text"))
    assert kept.count() > 8 and kept.where("doc_id in (1, 2, 3, 8)").count() == 0


def test_network_matches_its_tables():
    net = langid.Network(["a", "b"])
    symbols = np.random.default_rng(0).integers(0, 128, (5, langid.WINDOW)).astype(np.uint8)
    pooled = np.concatenate([net._responses(symbols, k).max(1) + net.bias[k] for k in range(3)], 1)
    assert np.allclose(langid.probabilities(net.compiled(), symbols), langid._softmax(np.maximum(pooled, 0) @ net.out + net.shift), atol=1e-5)


def test_predictions_match_a_plain_forward_pass(spark, docs, texts):
    """Filter by filter over every window of the whole text, means of the windows' probabilities."""
    net = langid.Network(["aa", "bb", "cc"], seed=3)
    got = Counter((r["row"].doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predict(docs, net, keep=["doc_id"]).collect())
    want = Counter()
    for i, t in texts:
        data, total, n = (t or "").encode(), np.zeros(3), 0
        for at in range(0, len(data), langid.WINDOW):
            x = [int(langid.SYMBOL[b]) for b in data[at : at + langid.WINDOW]] + [0] * (langid.WINDOW - len(data[at : at + langid.WINDOW]))
            pooled = []
            for k, w in enumerate(langid.WIDTHS):
                rows = np.stack([net.table[k][j][x][np.arange(langid.WINDOW - w + 1) + j] for j in range(w)])
                pooled.append(rows.sum(0).max(0) + net.bias[k])
            z = np.maximum(np.concatenate(pooled), 0) @ net.out + net.shift
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            n += 1
        letters = any(c.isalpha() for c in t or "")
        want[i, net.languages[int(total.argmax())] if letters else "und", round(total.max() / n, 4) if letters else 0.0] += 1
    assert {k[:2] for k in got} == {k[:2] for k in want} and sum(got.values()) == sum(want.values())
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-4)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, docs, empty, tmp_path, name, stage):
    """Nulls, clashing names, long and repeated texts, no rows at all: every stage keeps its columns."""
    spark.createDataFrame([(1, None), (None, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    some, none = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
    assert none.count() == 0 and 0 < some.count() <= docs.count()
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert some.columns == none.columns == docs.columns
        assert not rows_of(some) - rows_of(docs)
    else:
        assert {"doc_id", "token_ids", "round_trip"} <= set(some.columns) and some.where("not round_trip").count() == 0


# 10 --------------------------------------------------------------------------------------------
def shingle_set(text):
    w = pieces(text, NONSPACE)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    rows = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverted = defaultdict(set)
    for k, (i, s) in enumerate(rows):
        if i is not None:
            for x in s:
                inverted[x].add(k)
    for k, (i, s) in enumerate(rows):
        for j in {j for x in s for j in inverted[x] if i is not None and j > k}:
            a, b = s, rows[j][1]
            if 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(rows[j][0])
                root[max(p, q)] = min(p, q)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in rows)


def test_jaccard_components_match_brute_force(spark, docs, texts, empty):
    assert rows_of(jaccard.jaccard_components(docs)) == brute_components(texts)
    assert jaccard.jaccard_components(empty).count() == 0


def drifting(seed):
    """Chains of edits, a large group, a line that all texts share."""
    rng = random.Random(seed)
    common = " ".join(f"line{i}" for i in range(12))
    rows, k = [], 0
    for _ in range(12):
        now = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 40, 90]))]
        for _ in range(rng.choice([1, 4, 12])):
            rows.append((k, " ".join(now) + " " + common))
            k += 1
            for _ in range(rng.choice([1, 2])):
                now[rng.randrange(len(now))] = f"w{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group, named", [(2048, 256), (16, 256), (3, 256), (3, 8), (2048, 8)])
def test_jaccard_components_of_drifting_copies(spark, monkeypatch, group, named):
    """Few members a block, so that sets go up and block roots meet; frequent shingles that name their unit."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "UNIT", group)
    monkeypatch.setattr(jaccard, "NAMED", named)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 28 if group == 16 else 0)
    rows = drifting(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard.jaccard_components(df)) == brute_components(rows)


def test_every_link_of_different_texts_comes_through_the_trees(spark, monkeypatch):
    """As many links as join the sets to their components, all of them found at leaves of trees, none twice."""
    rows = drifting(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found, followed = [], jaccard._followed
    monkeypatch.setattr(jaccard, "_followed", lambda *a: found.append(shared.written(followed(*a), "found")) or found[-1])
    want = brute_components(rows)
    assert rows_of(jaccard.jaccard_components(df)) == want
    joined = len({shingle_set(t) for _, t in rows}) - len({c for _, _, c in want})
    assert joined > 20 and sum(x.count() for x in found) >= joined


def test_a_third_of_all_rows_in_one_group(spark, monkeypatch):
    """Near copies and exact ones share frequent shingles; the groups are cut into blocks and yet whole."""
    monkeypatch.setattr(jaccard, "GROUP", 20)
    monkeypatch.setattr(jaccard, "UNIT", 30)
    monkeypatch.setattr(jaccard, "NAMED", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = []
    for k in range(300):
        words = [f"v{rng.randrange(10**6)}" for _ in range(30)]
        if k % 3 == 0:
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(jaccard.jaccard_components(df)) == brute_components(rows)


def test_one_of_each_keeps_columns_and_rows_without_id(docs, texts):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute_components(texts) if i == c}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == want and sum(i is None for i in ids) == 2 and len([i for i in ids if i is not None]) == len(want - {None})


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    rng = random.Random(12)
    def text():
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    def near(t):
        return t.rsplit(" ", 1)[0] + " z"
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(0, a), (1, near(a)), (1, b), (3, c), (3, near(c)), (4, d), (4, d), (5, e), (5, f), (9, near(max(e, f))), (6, None), (6, ""), (6, g), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = Counter((i, t or "") for i, t in map(tuple, kept.collect()))
    assert got == Counter([(0, a), (1, b), (3, min(c, near(c))), (4, d), (5, e), (5, f), (6, ""), (6, g), (None, a)])


def some_sets(seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    sets = []
    for _ in range(40):
        base = rng.choice(pool, rng.integers(5, 60), replace=False)
        sets += [np.sort(base), np.sort(base[: int(len(base) * 0.9)])]
    return sorted(sets, key=len)


@pytest.mark.parametrize("threshold", [20, 40, 75, 100])
@pytest.mark.parametrize("other", [0, 1, 37])
def test_followed_trees_join_what_links(threshold, other):
    """One tree with itself, or two: the same components as all pairs of sets make."""
    sets = some_sets(threshold)
    n, split = len(sets), len(sets) - other
    want = {i: {i} for i in range(n)}
    for i in range(n):
        for j in range(i + 1, n):
            common = len(np.intersect1d(sets[i], sets[j]))
            if (not other or i < split <= j) and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                both = want[i] | want[j]
                for k in both:
                    want[k] = both
    join = jaccard.joined_sets(sets, np.arange(n), threshold, other)
    links = join.run(chunk=50)
    assert len(links) == n - len({min(x) for x in want.values()}) and (other or join.pairs < n * (n - 1) / 4)
    assert all((join.component[i] == join.component[j]) == (j in want[i]) for i in range(n) for j in range(n))


@pytest.mark.parametrize("threshold", [20, 40, 75, 100])
def test_bitmaps_lose_no_link(threshold):
    """What links lies in one component of what may link, whatever the widths of the bitmaps."""
    pool = np.unique(np.random.default_rng(3).integers(0, 2**63, 2000).astype(np.uint64))
    sets = some_sets(threshold) + [pool[: k * 100 // t] for k in (10, 60, 200) for t in (threshold, 100)]
    edge = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sign = jaccard.signatures(np.concatenate(sets), edge)
    got = {i: {i} for i in range(len(sets))}
    links = jaccard.may_join(np.arange(len(sets)), np.diff(edge), sign, threshold)
    for i, j in links:
        assert not got[i] & got[j]
        both = got[i] | got[j]
        for k in both:
            got[k] = both
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert not jaccard.similar(x, y, threshold) or j in got[i]


def test_trees_skip_what_is_one_component():
    sets = some_sets(5)
    join = jaccard.joined_sets(sets, np.zeros(len(sets), int), 75)
    assert join.run() == [] and join.pairs == join.compared == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(200, 230)] + [(229, 5), (9, 9), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 141)} | {j: 5 for j in [5, 7, *range(200, 230)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
