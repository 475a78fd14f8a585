import random
import re

import pyarrow as pa
import pytest

from loomspark.operators import trigrams

TEXTS = ["The License token", "no such word", "licénse TOKEN", "", None, "ab", "a", "License", "x.y*z", "ÉCOLE de Paris", "tail\nLICENSE", "r-e-d-g", "grd", "Straße", "colour and color"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcde \n") for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "License twice under an id")]
    path = f"file://{tmp_path_factory.mktemp('grams')}"
    trigrams.BLOCK, before = 16, trigrams.BLOCK
    trigrams.save_index(spark.createDataFrame(rows, "id long, text string"), path, "id", "text")
    trigrams.BLOCK = before
    return path, rows


def keys(found):
    return sorted((r.key, r.text) for r in found.collect())


@pytest.mark.parametrize("words", [["license"], ["token", "ab"], ["É"], ["zzz"], [""], ["a"], ["E\nB"]])
def test_substrings_like_a_scan(spark, index, words):
    path, rows = index
    assert keys(trigrams.containing(spark, path, words)) == sorted(r for r in rows if r[1] is not None and any(w.lower() in r[1].lower() for w in words))


@pytest.mark.parametrize("pattern", ["Licen[sc]e", "(License|TOKEN)", "colou?r", "abc+d", "^The", "x\\.y\\*z", ".*", "(ab){2}", "a|b|", "(?i)license\\b", "(?:d|e)a{1,2}b", "[abc]{3}e", "\\bno\\b.*word$", "É"])
def test_patterns_like_a_scan(spark, index, pattern):
    path, rows = index
    assert keys(trigrams.matching(spark, path, pattern)) == sorted(r for r in rows if r[1] is not None and re.search(pattern, r[1]))


@pytest.mark.parametrize("name", ["rdg", "éc", "lt", "", "edcba"])
def test_subsequences_like_a_scan(spark, index, name):
    def has(text):
        at = 0
        for c in name.lower():
            at = text.lower().find(c, at) + 1
            if not at:
                return False
        return True

    path, rows = index
    assert keys(trigrams.with_subsequence(spark, path, name)) == sorted(r for r in rows if r[1] is not None and has(r[1]))


def test_formulas():
    assert trigrams.needed_by_pattern("abcd(x|yz)?e*") == ("and", "abc", "bcd")
    assert trigrams.needed_by_pattern("abc|xyz") == ("or", "abc", "xyz") and trigrams.needed_by_pattern("abc|.") is True
    assert trigrams.needed_by_pattern("a(?=b)") == "a" and trigrams.needed_by_pattern("(?i)ABC") == "abc"
    assert trigrams.thinned(("and", "a", "b", "c"), {"a": 5, "b": 1}, 2) == ("and", "c", "b")


def test_blocks_without_a_candidate_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "BLOCK", 5)
    rows = [(i, f"common words in text {i}" + (" needle" if i in (3, 40) else "")) for i in range(60)]
    path = f"file://{tmp_path}"
    trigrams.save_index(spark.createDataFrame(rows, "id long, text string"), path, "id", "text")
    used = {r.block for r in trigrams.candidates(spark, path, trigrams.grams_of("needle")).collect()}
    folders = list((tmp_path / "texts").glob("block=*"))
    assert len(used) <= 2 < len(folders)
    for folder in folders:
        if int(folder.name.split("=")[1]) not in used:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"no table")
    for found in (trigrams.containing(spark, path, ["needle"]), trigrams.matching(spark, path, "need.e"), trigrams.with_subsequence(spark, path, "needle")):
        assert [r.key for r in found.orderBy("key").collect()] == [3, 40]


def test_postings_are_shuffled_as_lists(spark, tmp_path):
    """a row for each gram of a text made the shuffle many times the texts."""
    rows = [(i, "the same words in every text") for i in range(300)]
    trigrams.save_index(spark.createDataFrame(rows, "id long, text string").coalesce(1), f"file://{tmp_path}", "id", "text")
    stored = spark.read.parquet(f"file://{tmp_path}/postings").collect()
    assert len(stored) == len({(r.gram, r.block) for r in stored}) and {len(r["at"]) for r in stored} == {300}


def test_lists_of_few_and_very_many_characters():
    for texts in (["aba", "", "ab", "\U0001f600a"], ["".join(chr(c) for c in range(a, a + 90_000)) for a in (0xE000, 0x20000, 0x40000)] * 200):
        texts = texts if len(texts) < 9 else [t[:2] + t[k :: 9000] for k, t in enumerate(texts)] + texts[:3]
        batch = pa.RecordBatch.from_arrays([pa.array([k % 2 for k in range(len(texts))], pa.int64()), pa.array(range(len(texts)), pa.int32()), pa.array(texts)], ["block", "at", "low"])
        got, held = set(), {(t[i : i + n], k % 2, k) for k, t in enumerate(texts) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
        for part in trigrams._postings(batch):
            got |= {(r["gram"], r["block"], k) for r in part.to_pylist() for k in r["at"]}
        assert got == held


def test_short_texts_take_few_folders(spark, tmp_path, monkeypatch):
    """every 2,000 texts took a folder, however short they were."""
    monkeypatch.setattr(trigrams, "BLOCK", 5)
    monkeypatch.setattr(trigrams, "BLOCKS", 8, raising=False)
    monkeypatch.setattr(trigrams, "BLOCK_CHARS", 600, raising=False)
    monkeypatch.setattr(trigrams, "TOGETHER", 40)
    for name, text, folders in (("short", "few letters", range(1, 9)), ("long", "many letters " * 4, range(15, 22))):
        rows = [(i, f"{text} {i}") for i in range(200)]
        path = f"file://{tmp_path}/{name}"
        trigrams.save_index(spark.createDataFrame(rows, "id long, text string"), path, "id", "text")
        assert len(list((tmp_path / name / "texts").glob("block=*"))) in folders
        assert sorted(r.key for r in trigrams.containing(spark, path, ["s 17"]).collect()) == sorted(i for i, t in rows if "s 17" in t)
        assert trigrams.with_subsequence(spark, path, "fm").count() == sum("f" in t and "m" in t.split("f", 1)[1] for _, t in rows)
