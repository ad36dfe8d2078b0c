"""Fill-in-middle, resampling and packing against brute force: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import AZ, SCHEMA, TERM, by_id, docs, expected, none, rows  # noqa: F401
from tokenizers import Tokenizer

from fareshift.llm import fill_middle, packing, queries, resample

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


# ---------------------------------------------------------------- fill-in-middle

def brute_middle(doc_id, text, percent=90):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    w = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= percent:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_equals_brute_force(docs, none):  # noqa: F811
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = collections.Counter((r[0], *brute_middle(r[0], r[1])) for r in rows())
    assert by_id(out, *out.columns[1:]) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    back = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    assert by_id(back, "back") == expected(lambda t: (t or "",))
    assert fill_middle.fill_in_middle(none).count() == 0


def test_fill_in_middle_of_sentinels_parts_of_them_and_null_ids(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<P", "P><S", "<<<", ">>>M", "<P<S<M", "a<", "é<S" * 50, "<p>"]
    data = [(i if i % 4 else None, t) for i, t in enumerate(texts * 40)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    out = fill_middle.fill_in_middle(d, percent=100)
    assert by_id(out, *out.columns[1:]) == collections.Counter((i, *brute_middle(i, t, 100)) for i, t in data)
    back = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    assert collections.Counter(r["back"] for r in back.collect()) == collections.Counter(t for _, t in data)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P>", "P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "x<P>x", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(d, sentinels=bad)


@pytest.mark.parametrize("text", [
    "", "a", "é", "abc", "ab" * 9000, "z" * 20000, "日本語" * 4000, " \n" * 5000, "word and word, " * 9000,
    "".join(random.Random(3).choice("abcXYZ 019é日😀") for _ in range(30000))])
def test_chunk_counts_locate_every_token(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    cache = fill_middle.ChunkCache(5000)
    index = fill_middle.TextIndex(raw, cache)
    starts = [m.start() for m in TOKEN.finditer(text)]
    assert index.n == len(starts)
    for k in {0, 1, len(starts) // 3, len(starts) // 2, len(starts) - 1, len(starts)} & set(range(len(starts) + 1)):
        assert index.points_before(k) == (starts + [len(text)])[k]
    sizes = np.diff([0, *index.ends])
    assert all(fill_middle.MIN_CHUNK <= s < fill_middle.MAX_CHUNK + 4 for s in sizes[:-1]) and sum(sizes) == len(raw)


def test_shared_passages_give_shared_chunks():
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh ,.") for _ in range(n)).encode()
    shared = make(40_000)
    sets = []
    for front in (make(700), make(12_345)):
        raw = np.frombuffer(front + shared, np.uint8)
        ends = fill_middle.chunk_ends(raw)
        sets.append({raw[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)})
    common = sets[0] & sets[1]
    assert sum(map(len, common)) > 0.9 * len(shared)


# ---------------------------------------------------------------- importance resampling

def brute_resample(data, target, longest, buckets, percent, least):
    def grams(t):
        w = [x.encode() for x in TERM.findall((t or "").translate(AZ))]
        return len(w), [zlib.crc32(b" ".join(w[i:i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in data:
        s.update(grams(x)[1])
    for x in target:
        t.update(grams(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (t.total() + buckets) / ((s[b] + 1.0) * (s.total() + buckets))))
            for b in range(buckets)]
    scored = []
    for i, x in data:
        n, g = grams(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in g)
        scored.append((i, n, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    return collections.Counter([(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)]
                               + [(*r, None) for r in scored if r[1] < least])


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (3, 97, 50, 1), (2, 10, 100, 0)])
def test_resampling_equals_brute_force(spark, docs, longest, buckets, percent, least):  # noqa: F811
    target = ["w1 w2 w3 w4 w5", None, "", "STRASSE straße w7"] * 3
    t = spark.createDataFrame([(x,) for x in target], "text string")
    out = resample.resample(docs, t, longest=longest, buckets=buckets, percent=percent, min_words=least)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute_resample([(r[0], r[1]) for r in rows()], target, longest, buckets, percent, least)
    assert by_id(out, *out.columns[1:]) == want


def test_resampling_ranks_ranges_ties_and_null_ids(spark, none, monkeypatch):  # noqa: F811
    monkeypatch.setattr(resample, "RANGE_ROWS", 50)
    data = [(i % 300 if i % 7 else None, " ".join(f"w{(i * j) % 5}" for j in range(i % 9))) for i in range(1000)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    t = spark.createDataFrame([("w1 w1 w2",)], "text string")
    out = resample.resample(d, t, percent=33, min_words=2)
    want = brute_resample(data, ["w1 w1 w2"], 1, 10_000, 33, 2)
    key = lambda c: collections.Counter(k[:5] for k in c.elements())
    got = by_id(out, *out.columns[1:])
    place = lambda c: {k[5]: (k[0], k[4]) for k in c if k[5]}
    assert place(got) == place(want) and len(place(got)) == sum(1 for k in want.elements() if k[5])
    assert key(got) == key(want) and key(got).total() == 1000
    empty = spark.createDataFrame([], "text string")
    assert resample.resample(none, t).count() == 0
    assert resample.resample(d, empty, percent=0, min_words=0).where("rank is null").count() == 1000


def test_gain_is_the_share_in_the_target_over_the_share_in_the_source():
    """floor(1000 ln((t+1)(S+n) / ((s+1)(T+n)))) with S and T of different size."""
    assert resample.bucket_gains(np.array([3, 0, 0]), np.array([0, 1, 0])).tolist() == [
        math.floor(1000 * math.log(x)) for x in (1 * 6 / (4 * 4), 2 * 6 / (1 * 4), 1 * 6 / (1 * 4))]
    same = np.array([5, 0, 11, 2])
    assert resample.bucket_gains(same, same).tolist() == [0, 0, 0, 0]


def test_weights_and_scores_follow_the_shares(spark):
    """One text of 21 words and one of 20 against a target of two words, worked out by hand."""
    data = [(7, "Word " * 20 + "other"), (8, "straße " * 20), (9, None)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    out = resample.resample(d, spark.createDataFrame([("word, other",)], "text string"), percent=50)
    # S = 41, T = 2; s is 20, 1 and 20, t is 1, 1 and 0.
    gain = {k: math.floor(1000 * math.log((t + 1) * 10_041 / ((s + 1) * 10_002)))
            for k, s, t in (("word", 20, 1), ("other", 1, 1), ("straße", 20, 0))}
    weight = {7: 20 * gain["word"] + gain["other"], 8: 20 * gain["straße"], 9: 0}
    noise = {i: math.floor(-1000 * math.log(-math.log(
        (int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296))) for i, _ in data}
    got = {r["doc_id"]: (r["weight"], r["score"], r["rank"]) for r in out.collect()}
    assert got == {i: (w, w + noise[i], 1 if i == 7 else None) for i, w in weight.items()}


def test_features_go_on_over_pieces(monkeypatch):
    raw = ("alpha beta, gamma " * 50).encode()
    whole = [resample.features(raw, 3)]
    monkeypatch.setattr(resample, "PIECE", 37)
    whole.append(resample.features(raw, 3))
    a, b = ([(sum(n for n, _ in x), sum((c for _, c in x), collections.Counter()))] for x in map(list, whole))
    assert a == b and a[0][0] == 150 and a[0][1].total() == 150 + 149 + 148


# ---------------------------------------------------------------- packing

PATH = public_tokenizers.path(queries.WORD_IDS)


def test_word_ids_equal_the_library():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    bits = ["Word", "it's", "DON'T,", "a", "日本", "straße.", "É", "é", "́x", "x1y2", "--", "...", "#a", "’s", "'", "!!",
            "<|endoftext|>", "<|ENDOFTEXT|>.", "İ", "ẞ", "½.", "\t", " ", "\x1c", " ", "😀", "%%%", "naïve,", "ÀÖØÞß,é", "×÷", "l'été", "y'all're", "_a_", "it'S", "''s", "ªº", "ΑΣ", "ﬁ", "x" * 60 + "."]
    seps = [" ", "\n", "", "  ", " \n"]
    texts = ["".join(rng.choice(bits) + rng.choice(seps) for _ in range(rng.randrange(30))) for _ in range(400)]
    words = packing.WordIds(PATH)
    for i in range(0, 400, 40):
        for t, ids in zip(texts[i:i + 40], words.encode(texts[i:i + 40]), strict=True):
            assert ids == packing.packed(tok.encode(t, add_special_tokens=False).ids), t


def test_word_ids_start_anew_without_loss(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    tok, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for t in ("one two three four five six seven, one", "one " + "y" * 80 + " eight", "one two " + "y" * 80):
        assert words.encode([t])[0] == packing.packed(tok.encode(t, add_special_tokens=False).ids)
    assert all(len(w) <= packing.LONGEST_REMEMBERED for w in words)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_equals_piece_after_piece(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 7, 16, 64, 100])
    counts = {n: rng.randrange(0, 40) for n in rng.sample(range(1, window + 1), rng.randint(1, window))}
    rows_, used = packing.best_fit(counts, window)
    rooms = []  # one piece after another, longest first, into the tightest window
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[min(fit)[1]] -= n
            else:
                rooms.append(window - n)
    fill, numbers = collections.defaultdict(list), collections.defaultdict(list)
    for n, low, high, each, first, offset in rows_:
        numbers[n] += range(low, high)
        for i in range(high - low):
            fill[first + i // each].append((offset + i % each * n, n))
    assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    assert sorted(fill) == list(range(used))
    for parts in fill.values():  # gapless from 0
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(window - sum(n for _, n in p) for p in fill.values()) == sorted(rooms)


def packed_rows(out, window):
    got = out.collect()
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
    return got, by_sequence


def test_packing_keeps_every_id(spark, docs, none):  # noqa: F811
    tok, window = Tokenizer.from_file(PATH), 256
    out = packing.place(packing.token_pieces(docs, PATH, window=window), window)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    got, by_sequence = packed_rows(out, window)
    texts = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["start"]):
        texts[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"], r["length"]))
    for doc_id, copies in collections.Counter((r[0], r[1]) for r in rows()).items():
        want = tok.encode(doc_id[1] or "", add_special_tokens=False).ids + [packing.END_ID]
        pieces = collections.Counter(map(str, texts[doc_id[0]]))
        assert pieces == collections.Counter({str((a, want[a:a + window], len(want), len(want[a:a + window]))): copies
                                              for a in range(0, len(want), window)})
    seqs = {r["sequence_id"]: r for r in packing.sequences(out, window=window, pad_id=9).collect()}
    total = sum(r["length"] for r in seqs.values())
    assert total == sum(r["length"] for r in got)
    at = {(r["sequence_id"], r["offset"]): r["ids"] for r in got}
    for i, r in seqs.items():
        body = b"".join(at[i, o] for o, _ in sorted(by_sequence[i]))
        n = r["length"]
        pad = 0 if n & (n - 1) == 0 else window - n
        assert len(body) == 4 * n and r["ids"] == body + (9).to_bytes(4, "little") * pad
    assert packing.place(packing.token_pieces(none, PATH)).count() == 0


def test_packing_numbers_pieces_of_one_length_over_many_tasks(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(
        F.repeat(F.lit("x "), (F.col("id") % 50).cast("int"))).alias("text")).repartition(13)
    window = 32
    got, by_sequence = packed_rows(packing.place(packing.token_pieces(d, PATH, window=window), window), window)
    assert {r["doc_id"] for r in got} == set(range(4000))
    counts = collections.Counter(r["length"] for r in got)
    assert len(by_sequence) == packing.best_fit(counts, window)[1]


def test_packing_query_leaves_little_padding(spark):
    got, by_sequence = packed_rows(queries.op13_packing(spark, "/root/testdata/sf0.001"), packing.WINDOW)
    assert sum(r["length"] for r in got) > 0.99 * packing.WINDOW * (len(by_sequence) - 1)
