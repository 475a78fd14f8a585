import itertools
import random

import brute
import numpy as np

from loomspark.llm import langmix, linecrf

GOOD = "The river ran slowly past the old mill and the people of the town came down to see it."
BAD = "BUY!! NOW!! $$$ BEST### DEAL*** CLICK!! HERE!! $$$"
TEXTS = [None, "", " \n\t", GOOD, "\n".join([GOOD] * 8), "a b c a b c\na b c a b c\n\nx", "é # 日本\x0bz <|> &", "one\ntwo \none\n", "w " * 20_000]
#: Two lines whose bytes have equal polynomial sums.
ALIKE = "".join("b" if bin(i).count("1") % 2 else "a" for i in range(1024))
TEXTS.append(ALIKE + "\n" + ALIKE.translate(str.maketrans("ab", "ba")) + "\n" + ALIKE)


def test_counts_like_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    for r in linecrf.line_quality(df, None).collect():
        assert tuple(r)[1:7] == brute.quality(TEXTS[r.doc_id]), r
    assert linecrf.line_quality(df.limit(0), None).count() == 0


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(0)
    x = rng.random((9, linecrf.FEATURES)) < 0.4
    at = np.array([0, 4, 4, 9])
    field = linecrf.Field(rng.normal(size=(linecrf.FEATURES, 2)), rng.normal(size=(2, 2)))
    got = linecrf.viterbi(field, x, at)
    score = x @ field.emit
    for a, b in ((0, 4), (4, 9)):
        value = lambda y, a=a: sum(score[a + i, v] for i, v in enumerate(y)) + sum(field.move[u, v] for u, v in zip(y, y[1:], strict=False))
        best = max(itertools.product((0, 1), repeat=b - a), key=value)
        assert tuple(got[a:b]) == best


def test_gradient_matches_enumeration():
    rng = np.random.default_rng(1)
    x = (rng.random((5, linecrf.FEATURES)) < 0.5).astype(float)
    field = linecrf.Field(rng.normal(size=(linecrf.FEATURES, 2)), rng.normal(size=(2, 2)))
    p, pairs = linecrf._marginals(field, x, np.array([0, 5]))
    score, total, want, moves = x @ field.emit, 0.0, np.zeros((5, 2)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(score[i, v] for i, v in enumerate(y)) + sum(field.move[u, v] for u, v in zip(y, y[1:], strict=False)))
        total += w
        for i, v in enumerate(y):
            want[i, v] += w
        for u, v in zip(y, y[1:], strict=False):
            moves[u, v] += w
    assert np.allclose(p, want / total) and np.allclose(pairs, moves / total)


def test_field_learns_boilerplate(spark):
    rng = random.Random(2)
    vary = lambda s: " ".join(rng.sample(s.split(), len(s.split())))
    docs = [(i, "\n".join(vary(GOOD) for _ in range(6))) for i in range(20)] + [(20 + i, "\n".join(vary(BAD) for _ in range(12))) for i in range(20)]
    mixed = [(50, "\n".join([vary(GOOD) for _ in range(5)] + [vary(BAD)] * 1)), (51, "\n".join([vary(GOOD)] + [vary(BAD) for _ in range(12)]))]
    df = spark.createDataFrame(docs + mixed, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in linecrf.line_quality(df, linecrf.train(df, labels)).collect()}
    assert all(got[i] == (i < 20) for i in range(40)) and got[50] and not got[51]
    assert linecrf.train(df, labels.limit(0)) is None


EN, DE = "the and of that which with for this from are".split(), "der und die das nicht ist mit für von auf".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_accuracy_and_mixtures(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, EN if i % 2 else DE, 30), "en" if i % 2 else "de", "s") for i in range(200)]
    extra = [(900, None, "en", "s"), (901, "123 !!", None, "s"), (902, sentence(rng, EN, 60) + " " + sentence(rng, DE, 40), None, "s"), (None, sentence(rng, DE, 9), None, "s"), (903, "—…", None, "s"), (904, "日本", None, "s")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    model = langmix.train(df)
    got = {r.doc_id: r for r in langmix.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang, _ in rows)
    assert got[900].lang_pred == got[901].lang_pred == got[903].lang_pred == "und" and got[904].lang_pred != "und" and got[None].lang_pred == "de"
    assert set(got[902].shares) == {"en", "de"} and abs(got[902].shares["en"] - 0.6) < 0.08
    kept = langmix.keep_identified(df, model)
    assert kept.columns == df.columns and {900, 901, 903}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == 203
    none = langmix.predict(df.limit(3), langmix.train(df.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_held_out_rows_do_not_train(spark):
    import zlib

    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    df = spark.createDataFrame([(i, "abc abc", "en") for i in held], "doc_id long, text string, lang string")
    assert df.filter(langmix.held_out(df.doc_id)).count() == len(held) and langmix.train(df) is None


def test_penalty_keeps_a_stray_word_out():
    logs = np.log(np.array([[0.9, 0.1]] * 50 + [[0.1, 0.9]]))
    share = langmix.mixtures(logs, np.ones(51, int), np.array([0]))
    assert share.tolist() == [[1.0, 0.0]]


def test_language_sets_of_any_size():
    rng = np.random.default_rng(1)
    for k in (6, 9):
        for size in (1, 3, 6):
            owner = np.repeat(np.arange(size), 60)
            logs = np.full((len(owner), k), -12.0) + rng.normal(0, 1, (len(owner), k))
            logs[np.arange(len(owner)), owner] = 0
            share = langmix.mixtures(logs, np.ones(len(owner)), np.array([0]))[0]
            assert np.allclose(share[:size], 1 / size, atol=0.02) and np.allclose(share[size:], 0, atol=1e-9)


def test_language_set_is_the_best_of_all_sizes():
    rng = np.random.default_rng(7)
    for _ in range(25):
        k, n = 5, int(rng.integers(5, 80))
        logs, count = rng.normal(0, 2, (n, k)), rng.integers(1, 4, n)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))

        def mixture(allowed):
            share = np.array(allowed, float) / sum(allowed)
            for _ in range(langmix.ROUNDS):
                r = p * share
                share = ((count / r.sum(axis=1))[:, None] * r).sum(axis=0) / count.sum()
                share = np.where(allowed, np.maximum(share, 1e-6), 0)
                share = share / share.sum()
            return share

        rank = np.argsort(np.argsort(-mixture([True] * k), kind="stable"), kind="stable")
        worth = []
        for m in range(1, k + 1):
            share = mixture(list(rank < m)) if m > 1 else (rank == 0).astype(float)
            worth.append((count * np.log(p @ share)).sum() - langmix.PENALTY * (m - 1) / 2 * np.log(max(count.sum(), 2)))
        got = langmix.mixtures(logs, count, np.array([0]))[0]
        assert (got > 0).sum() == int(np.argmax(worth)) + 1
