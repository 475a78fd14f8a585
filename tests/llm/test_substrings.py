import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import substrings, windows

SCHEMA = "doc_id long, text string, places string"


def corpus(seed):
    """Copies, near copies, shared passages, periodic texts, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30), text(80)
    out = [text(60), base, base, base.replace(" ", "\n", 3), passage, text(10) + " " + passage + " " + text(10), passage + " " + passage, "de " * 120, "de " * 90 + "do", "x" * 300, "x" * 120, "", None, "short", text(400) + base]
    for _ in range(15):
        w = base.split()
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += ["  \t\n", passage.upper(), "é" * 80, "日本語" * 40, "日本語" * 40]
    rng.shuffle(out)
    return [(i * 7 % 101 - 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_and_words_like_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in substrings.repeated_bytes(df).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) as n_removed", "size(spans) as n_spans", "sha2(kept, 256) as h").collect()}
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute.kept_bytes(docs)
    got = {r.doc_id: r for r in substrings.repeated_words(df).selectExpr("doc_id", "n_words", "aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as n_removed", "sha2(cast(kept as binary), 256) as h").collect()}
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute.kept_words(docs)


def test_long_text_repeated_rows_null_ids_and_empty_table(spark):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))
    docs = [(1, long), (2, long[1000:200_000]), (3, long[-60:])]
    rows = [*docs, (2, docs[1][1]), (None, long[:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substrings.repeated_bytes(df).selectExpr("doc_id", "n_bytes - octet_length(kept) as n_removed").collect()]
    assert sorted(got, key=str) == sorted([(1, 300), (2, 199_000), (2, 199_000), (3, 60), (None, 0)], key=str)
    assert substrings.repeated_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_phrases_hold_each_window_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 40, 90, 90, 1700, 5000])
    row, start, n, *_ = windows.phrases(data, at, substrings.BYTES)
    seen = sorted((r, s + k) for r, s, m in zip(row, start, n, strict=True) for k in range(m))
    assert seen == [(r, k) for r in range(5) for k in range(max(0, at[r + 1] - at[r] - 49))]
    assert n.max() <= 50 - 16 + 1


def test_packing_round_trip():
    rows = windows.Rows(*(np.array([5 << 24, 2**63], np.uint64),) * 2, *(np.array([7, 0], np.uint16),) * 2, np.array([-(2**63), 4]), np.array([9, 2]), np.array([1, 2], np.int32), np.array([3, 4], np.int32), np.array([0, 2], np.int32))
    back = windows._unpack(windows._pack(rows, windows.PHRASE), windows.PHRASE)
    assert all((a == b).all() for a, b in zip(rows[4:], back[4:], strict=True)) and (back.one == rows.one).all()
    assert (back.left == rows.left).all()
    assert [x.tolist() for x in windows._unpack(windows._pack(rows, windows.PLACE), windows.PLACE)[4:]] == [x.tolist() for x in rows[4:]]


def test_sliding_minimum():
    x = np.random.default_rng(2).integers(0, 99, 60)
    for w in (1, 2, 7, 35, 60):
        assert windows.sliding_minimum(x, w).tolist() == [int(x[i : i + w].min()) for i in range(61 - w)]


def test_covered_clips_to_rows():
    at = np.array([0, 5, 9])
    places = pa.array([[(3, 4)], None], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))
    assert windows.covered(at, places, 3).tolist() == [False] * 3 + [True] * 2 + [False] * 4


def test_rows_that_share_an_id_or_have_none_lose_nothing_of_their_own(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    p, u, v = words(30), words(60), words(60)
    df = spark.createDataFrame([(1, p), (7, p + " tail"), (7, u), (None, p + " " + p), (None, v)], "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.kept.decode()) for r in substrings.repeated_bytes(df).collect())
    assert kept == sorted([("1", ""), ("7", "tail"), ("7", u), ("None", p + " " + p), ("None", v)])  # a null id stands before all others
    assert sorted(r.kept for r in substrings.repeated_words(df).collect()) == sorted(["", "tail", u, p, v])


def pieces(rng, alphabet, dtype):
    """Phrases of one block in the order of their places, some of them varied copies of others."""
    base = [rng.choices(alphabet, k=rng.randint(3, 40)) for _ in range(6)]
    texts = [x[rng.randint(0, 3) :] + rng.choices(alphabet, k=rng.randint(0, 5)) for x in rng.choices(base, k=30)]
    doc = np.sort(np.array([rng.randrange(9) for _ in texts]))
    return texts, windows.Pieces(doc, np.arange(len(texts)), np.zeros(len(texts), np.int64), np.array(sum(texts, []), dtype), np.cumsum([0, *map(len, texts)]))


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_in_corpus_order(seed):
    rng = random.Random(seed)
    texts, block = pieces(rng, [0, 97, 98, 255], np.uint8)
    of, offset, fresh = substrings.suffix_order(block, 6)
    plain = sorted((bytes(t[k : k + 6]), i, k) for i, t in enumerate(texts) for k in range(len(t) - 5))
    assert [(i, k) for _, i, k in plain] == list(zip(of.tolist(), offset.tolist(), strict=True))
    assert fresh.tolist() == [not k or plain[k][0] != plain[k - 1][0] for k in range(len(plain))]


@pytest.mark.parametrize("seed", range(8))
def test_factors_like_a_plain_greedy_parse(seed):
    rng = random.Random(seed)
    texts, block = pieces(rng, [3, 4, 2**60], np.uint64)
    least, flat, at = 4, block.symbols.tolist(), block.at.tolist()
    end = [b for a, b in zip(at, at[1:], strict=False) for _ in range(b - a)]

    def longest(i):
        best = 0
        for j in range(i):
            n = 0
            while i + n < end[i] and j + n < end[j] and flat[i + n] == flat[j + n]:
                n += 1
            best = max(best, n)
        return best if best >= least else 0

    plain = []
    for a, b in zip(at, at[1:], strict=False):
        while a < b:
            if n := longest(a):
                plain.append((a, a + n))
            a += n or 1
    found = substrings.longest_earlier(block.symbols, block.at, least)
    assert found.tolist() == [longest(i) for i in range(len(flat))]
    assert list(zip(*(x.tolist() for x in substrings.factors(found, block.at)), strict=True)) == plain
    of, offset, n = substrings.repeated_factors(block, windows.Shape(least, 2, False))
    assert sorted(at[o] + s + k for o, s, m in zip(of.tolist(), offset.tolist(), n.tolist(), strict=True) for k in range(m)) == [i for i in range(len(flat)) if longest(i)]


@pytest.mark.parametrize("shape", [substrings.BYTES, substrings.WORDS])
def test_frequent_triggers_are_split_without_other_results(spark, shape, monkeypatch):
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    symbols = windows.byte_symbols if shape is substrings.BYTES else substrings.word_symbols
    texts = windows.numbered(df)
    hot = windows.frequent_triggers(texts, symbols, shape, 1, least=10)
    assert len(hot) > 3
    monkeypatch.setattr(windows, "frequent_triggers", lambda *_: hot)
    if shape is substrings.BYTES:
        got = {r.doc_id: (r.n_bytes, r.n) for r in substrings.repeated_bytes(df).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) as n").collect()}
        assert got == {d: x[:2] for d, x in brute.kept_bytes(docs).items()}
    else:
        got = {r.doc_id: r.h for r in substrings.repeated_words(df).selectExpr("doc_id", "sha2(cast(kept as binary), 256) as h").collect()}
        assert got == {d: x[2] for d, x in brute.kept_words(docs).items()}


def test_long_words_whose_byte_sums_are_equal_stay_apart(spark):
    x = "".join("b" if bin(i).count("1") % 2 else "a" for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    before, after = " ".join(f"w{i}" for i in range(10)), " ".join(f"v{i}" for i in range(10))
    docs = [(1, f"{before} {x} {after}"), (2, f"{before} {y} {after}"), (3, f"{before} {x} {after}")]
    got = {r.doc_id: r.n_removed for r in substrings.repeated_words(spark.createDataFrame(docs, "doc_id long, text string")).selectExpr("doc_id", "aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as n_removed").collect()}
    assert got == {1: 0, 2: 0, 3: 21}


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 8, 9, 50])
def test_ranks_by_doubling_like_sorted_windows(depth):
    rng = np.random.default_rng(depth)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    windows_ = [bytes(data[i : i + depth]) for i in range(len(data) - depth + 1)]
    place = {w: k for k, w in enumerate(sorted(set(windows_)))}
    assert substrings.ranks(data, depth).tolist() == [place[w] for w in windows_]
