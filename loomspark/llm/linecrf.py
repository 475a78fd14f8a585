"""Quality rules: fixed counts, and lines labelled by a linear-chain conditional random field.

Lines with a word are a sequence; the field scores each line's features and each pair of
neighbouring labels, and Viterbi decoding marks lines as content or boilerplate. A document is
kept if lines of content hold at least CONTENT_SHARE of its words and no fixed rule fails it.

The field is trained by maximum likelihood on a bounded sample of labelled documents (quality 0
or 1, chosen by a hash of doc_id, of SAMPLE_LINES lines at most): lines of good documents are content; lines of bad ones start
as boilerplate, and after a first fit those that the fit finds surely content are relabelled.
Without labelled documents nothing is held to be boilerplate.

Edge cases: a null or empty text has no words and fails the rules; ties in decoding go to
content; repeated rows are separate documents; a doc_id labelled more than once takes its least
label; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import mixed, split_batches, text_bytes, word_hashes, word_spans

MIN_WORDS = 50
REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
CONTENT_SHARE = 0.5
SAMPLE_DOCS = 2_000
#: Documents of more lines are not trained on, since the fit takes time by the longest of them.
SAMPLE_LINES = 1_000
STEPS = 150
RIDGE = 1e-3

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = _UPPER | np.isin(np.arange(256), list(range(97, 123))) | (np.arange(256) >= 0xC3)
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.isin(np.arange(256), list(b"!|"))
_FIRST = (np.arange(256) & 0xC0) != 0x80
_FIRST_IN_WORD = _FIRST & ~np.isin(np.arange(256), [0x20, *range(9, 14)])


class Lines(NamedTuple):
    """Lines of a batch that have a word: features (one row each), their words, and offsets by document."""

    features: np.ndarray
    words: np.ndarray
    at: np.ndarray


FEATURES = 20


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])[bounds])


def analysed(data: np.ndarray, at: np.ndarray) -> tuple[Lines, dict[str, np.ndarray]]:
    """The lines of a batch with their features, and the fixed counts of each document."""
    docs = len(at) - 1
    starts, ends, first = word_spans(data, at)
    hashes = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    bounds = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1])) if len(data) else np.zeros(1, np.int64)
    head = bounds[:-1]
    doc = np.searchsorted(at, head, "right") - 1
    tail = bounds[1:] - (data[bounds[1:] - 1] == 10) if len(head) else head
    words = np.diff(np.searchsorted(starts, bounds))
    has = words > 0
    same = np.zeros(len(head), bool)
    if has.any():
        key = mixed(word_hashes(data, head[has], tail[has]) + doc[has].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        same[np.flatnonzero(has)[again]] = True

    repeat = np.zeros(len(starts), bool)
    if len(starts) >= REPEAT_WINDOW:
        owner = np.repeat(np.arange(docs), n_words)
        w = np.arange(len(starts) - REPEAT_WINDOW + 1)
        w = w[owner[w] == owner[w + REPEAT_WINDOW - 1]]
        with np.errstate(over="ignore"):
            key = owner[w].astype(np.uint64)
            for k in range(REPEAT_WINDOW):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[w + k])
        order = np.argsort(key)
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for k in range(REPEAT_WINDOW):
            repeat[w[twice] + k] = True

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return _sums(mask, at)

    counts = {
        "n_words": n_words,
        "word_chars": per_doc(_FIRST_IN_WORD[data]),
        "n_symbols": per_doc(_SYMBOL[data]),
        "n_dup_lines": np.bincount(doc[same], minlength=docs),
        "n_repeat_words": _sums(repeat, first),
    }
    follows = np.zeros(len(starts), bool)
    if len(starts):
        line = np.searchsorted(bounds, starts, "right") - 1
        follows[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        echo = np.bincount(line[follows], minlength=len(head)) / np.maximum(words - 1, 1)
    else:
        echo = np.zeros(len(head))
    letters, upper, symbols, digits, marks, chars = (_sums(m[data], bounds)[has] for m in (_LETTER, _UPPER, _SYMBOL, _DIGIT, _MARK, _FIRST_IN_WORD))
    words, echo, same = words[has], echo[has], same[has]
    length = chars / np.maximum(words, 1)
    last = data[ends[np.searchsorted(starts, bounds[1:])[has] - 1] - 1] if has.any() else np.zeros(0, np.uint8)
    sign = symbols / words
    shout = marks / words
    caps = upper / np.maximum(letters, 1)
    figures = digits / np.maximum(chars, 1)
    x = np.stack(
        [np.ones(len(words), bool), words < 4, (words >= 4) & (words < 12), (words >= 12) & (words < 40), words >= 40]
        + [sign == 0, (sign > 0) & (sign < 0.1), (sign >= 0.1) & (sign < 0.4), sign >= 0.4]
        + [shout >= 0.3, caps >= 0.5, (caps >= 0.15) & (caps < 0.5), echo >= 0.3, (echo > 0.05) & (echo < 0.3)]
        + [figures >= 0.2, length < 3, length >= 9, np.isin(last, list(b".!?:")), same, letters == 0],
        axis=1,
    )
    assert x.shape[1] == FEATURES
    return Lines(x, words, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(doc[has], minlength=docs))])), counts


# --- the field --------------------------------------------------------------------------------


class Field(NamedTuple):
    """Scores of features for both labels (0 boilerplate, 1 content), and of label pairs."""

    emit: np.ndarray
    move: np.ndarray


def _by_length(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and for each position how many of them reach it."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max()) if len(n) else 0
    return order, len(n) - np.searchsorted(np.sort(n), np.arange(longest), "right")


def viterbi(field: Field, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The best labels of all sequences, position by position over all that are long enough."""
    score = x.astype(np.float64) @ field.emit
    order, alive = _by_length(at)
    head = at[:-1][order]
    back = np.zeros((len(x), 2), np.int8)
    best = np.zeros((len(order), 2))
    for t, k in enumerate(alive):
        here = head[:k] + t
        if t:
            ways = best[:k, :, None] + field.move[None]
            back[here] = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
            best[:k] = ways.max(axis=1)
        best[:k] += score[here]
    out = np.zeros(len(x), np.int8)
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t in range(len(alive) - 1, -1, -1):
        here = head[: alive[t]] + t
        out[here] = state[: alive[t]]
        state[: alive[t]] = back[here, state[: alive[t]]]
    return out


def _marginals(field: Field, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of each line and expected counts of label pairs (forward-backward in scaled form)."""
    score = x @ field.emit
    potential = np.exp(score - score.max(axis=1, keepdims=True))
    move = np.exp(field.move - field.move.max())
    order, alive = _by_length(at)
    head = at[:-1][order]
    fore, aft = np.zeros((len(x), 2)), np.ones((len(x), 2))
    for t, k in enumerate(alive):
        here = head[:k] + t
        f = potential[here] if not t else (fore[here - 1] @ move) * potential[here]
        fore[here] = f / f.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        here = head[: alive[t + 1]] + t
        b = potential[here + 1] * aft[here + 1]
        joint = fore[here][:, :, None] * move[None] * b[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = b @ move.T
        aft[here] = b / b.sum(axis=1, keepdims=True)
    p = fore * aft
    return p / p.sum(axis=1, keepdims=True), pairs


def fit(x: np.ndarray, at: np.ndarray, labels: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """Maximum likelihood by gradient ascent with per-weight step sizes (Adam)."""
    x = x.astype(np.float64)
    truth = np.stack([labels == 0, labels == 1], axis=1).astype(np.float64)
    joined = np.ones(len(x), bool)
    joined[at[:-1][np.diff(at) > 0]] = False
    second = np.flatnonzero(joined)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[second - 1], labels[second]), 1)
    weights, m, v = (np.zeros(2 * FEATURES + 4) for _ in range(3))
    for k in range(1, steps + 1):
        field = Field(weights[: 2 * FEATURES].reshape(FEATURES, 2), weights[2 * FEATURES :].reshape(2, 2))
        p, pairs = _marginals(field, x, at)
        slope = np.concatenate([(x.T @ (truth - p)).ravel(), (seen - pairs).ravel()]) / len(x) - ridge * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights = weights + 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(weights[: 2 * FEATURES].reshape(FEATURES, 2), weights[2 * FEATURES :].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field | None:
    """A field from at most sample_docs labelled documents, those of up to sample_lines lines; the sample of labels is joined by broadcast, so no text is shuffled."""
    some = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    found = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text"):
                lines, _ = analysed(*text_bytes(batch.column("text")))
                bits = np.packbits(lines.features, axis=1)
                raw = [bits[a:b].tobytes() if b - a <= sample_lines else b"" for a, b in zip(lines.at[:-1], lines.at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "quality", "lines"])

    rows = sorted((r.doc_id, r.quality, bytes(r.lines)) for r in found.mapInArrow(run, "doc_id long, quality int, lines binary").collect() if r.lines)
    if len({r[1] for r in rows}) < 2:
        return None
    width = (FEATURES + 7) // 8
    x = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, width), axis=1)[:, :FEATURES]
    n = np.array([len(r[2]) // width for r in rows])
    at = np.concatenate([[0], np.cumsum(n)])
    given = np.repeat([r[1] for r in rows], n)
    field = fit(x, at, given)
    p, _ = _marginals(field, x.astype(np.float64), at)
    return fit(x, at, np.where(p[:, 1] > 0.9, 1, given))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_share double"


def line_quality(docs: DataFrame, field: Field | None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Counts, verdict and share of words in content lines of every row of docs(doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text"):
                lines, c = analysed(*text_bytes(batch.column("text")))
                label = viterbi(field, lines.features, lines.at) if field is not None else np.ones(len(lines.words), np.int8)
                n = c["n_words"]
                share = np.where(n > 0, _sums(lines.words * label, lines.at) / np.maximum(n, 1), 0.0)
                failed = (n < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * n)
                columns = [batch.column("doc_id"), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (share >= content_share)), pa.array(np.diff(lines.at)), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def base_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed counts alone, which SQL can state."""
    found = line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), None)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
