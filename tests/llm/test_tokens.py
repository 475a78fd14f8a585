import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from loomspark.llm import tokens as T

TEXTS = [None, "", "Hello World", "ÉLAN vital,  déjà!! Œuvre", "a\nb\tc\x0bd", "it's they'RE 'll don''t", "x.%%% É.%%% …,, €., 3.14 ½., ²..", "K K İi ß.", "é., É́.,", "<|endoftext|> <|ENDOFTEXT|>", "日本語。 テスト!! 한국", "\x1c\x1d a b c", "näivë,", "×. ÷. ÿ. Ÿ. Þ.", "🙂🙂., a🙂.", "A" * 5000 + "!" * 3000]


def plain(texts, end=T.END_ID):
    t = Tokenizer.from_file(T.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_pieces_encode_as_whole_texts():
    for texts in (TEXTS, [x for x in TEXTS if "<|" not in (x or "")], ["", None], []):
        ids, at = T.Encoder(T.tokenizer_path())(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain(texts)


def test_words_of_punctuation_and_known_pieces():
    encoder = T.Encoder(T.tokenizer_path())
    for texts in (["...", "!! a", "a !!", "--- ---"], ["same words.", "same, words"], ["same words."]):
        ids, at = encoder(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain(texts)


def test_other_normalisers_encode_whole_texts(tmp_path):
    made = json.loads(Tokenizer.from_file(T.tokenizer_path()).to_str())
    made["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(made))
    t = Tokenizer.from_file(str(path))
    texts = [x for x in TEXTS if x is not None]
    ids, at = T.Encoder(str(path))(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids + [T.END_ID] for x in texts]


def test_format_and_digest(spark, tmp_path):
    rows = [(i * 3 % 17, TEXTS[i % len(TEXTS)], "x") for i in range(17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    T.write_tokens(docs, str(tmp_path / "t"))
    got = sorted(map(tuple, T.token_digest(spark, str(tmp_path / "t")).collect()))
    at, want = 0, []
    for d, text, _ in sorted(rows):
        ids = np.array(plain([text])[0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    one = T.read_tokens(spark, str(tmp_path / "t"), where="doc_id = 5", columns=("n_tokens",)).collect()
    assert [(r.doc_id, r.start) for r in one] == [(d, s) for d, s, *_ in want if d == 5]


def test_rows_of_one_id_have_an_order_and_are_dealt(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text {i % 40} " + "w " * (i % 7)) for i in range(900)]
    files = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, order in (("a", rows), ("b", rows[::-1])):
            T.write_tokens(spark.createDataFrame(order, "doc_id long, text string").repartition(3), str(tmp_path / name))
            files.append(T.token_digest(spark, str(tmp_path / name)).orderBy("start").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files[0] == files[1]
    assert [r.start for r in files[0]] == np.cumsum([0, *(r.n_tokens for r in files[0])])[:-1].tolist()
    assert [r.doc_id for r in files[0]] == [None] * 600 + list(range(0, 900, 3))
    sizes = [pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "a").glob("*.parquet")]
    assert len(sizes) > 2 and max(sizes) < 600


def test_files_count_in_the_order_of_their_numbers(spark, tmp_path):
    for number, (first, n) in (("00009", (0, 2)), ("99999", (2, 3)), ("100000", (5, 4))):
        rows = pa.table({"doc_id": pa.array(range(first, first + n), pa.int64()), "start_in_file": pa.array(range(n), pa.int64()), "n_tokens": pa.array([1] * n, pa.int64()), "ids": pa.array([[7]] * n, pa.list_(pa.int32()))})
        pq.write_table(rows, tmp_path / f"part-{number}-x.parquet")
    got = T.read_tokens(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start) for r in got) == [(i, i) for i in range(9)]


def test_packing_covers_each_id_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 90, 60))] + [(None, None), (100, "long " * 700), (3, "again")]
    out = T.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), capacity=64, group_tokens=900).collect()
    by_seq, by_doc = {}, {}
    for r in out:
        assert 0 < r.length == len(r.ids)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for spans in by_seq.values():
        total = 0
        for at, n in sorted(spans):
            assert at == total
            total += n
        assert total <= 64 and total & (total - 1) == 0
    assert sum(r.length for r in out) == sum(len(x) for x in plain([t for _, t in rows]))
    # the pieces of each document follow each other, and their ids are its ids
    given, held = {}, {}
    for d, t in rows:
        given.setdefault((d, len(plain([t])[0])), []).append(plain([t])[0])
    for r in out:
        held.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    assert set(given) == set(held) == set(by_doc)
    for name, ids in given.items():
        assert len(ids) == 1
        assert sum((x for _, x in sorted(held[name])), []) == ids[0]
        assert [s for s, _ in sorted(by_doc[name])] == [sum(n for _, n in sorted(by_doc[name])[:k]) for k in range(len(by_doc[name]))]
    digest = T.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), capacity=64, group_tokens=900, finish=T._piece_digest, schema=T.PIECE_DIGEST).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.sequence_id, r.offset, r.ids_crc32) for r in digest) == sorted((r.sequence_id, r.offset, crc(r.ids)) for r in out)
    assert not T.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_balance_prefers_the_cheapest_with_room():
    pieces = T.balanced(np.array([6, 5, 4, 3, 2]), 10, 1.0, 0.1)
    where = {d: s for d, _, _, s in pieces}
    assert where[0] != where[1] and where[2] == where[1]


def test_footers_show_encodings_groups_and_indexes(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 500}" for k in range(300))) for i in range(2500)]
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "t"), row_group_bytes=256 << 10, page_bytes=16 << 10)
    groups = 0
    for path in (tmp_path / "t").glob("*.parquet"):
        footer = pq.ParquetFile(path).metadata
        groups += footer.num_row_groups
        for g in range(footer.num_row_groups):
            for c in range(footer.num_columns):
                column = footer.row_group(g).column(c)
                wanted = "DELTA_BINARY_PACKED" if column.path_in_schema != "ids.list.element" else "RLE_DICTIONARY"
                assert wanted in column.encodings, (column.path_in_schema, column.encodings)
                assert column.has_offset_index
                assert column.has_column_index
    assert groups > len(list((tmp_path / "t").glob("*.parquet")))
