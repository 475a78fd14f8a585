"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods of words.

Counts of byte trigrams per language come from all labelled training documents. A document is
taken as words drawn from a mixture of languages; expectation-maximisation finds the mixture's
proportions, and the set of languages is the one of 1, 2, 3... most frequent languages (up to all that
were learned) whose log-likelihood, less a penalty for each language, is largest. A larger set is tried as
long as a bound on its likelihood does not rule it out. The prediction is the language
with the largest share of that set, and the score its share.

Edge cases: a null text or one without a letter is `und` with score 0, as is every text when no
language was learned; equal shares go to the first language by name; a null doc_id counts as not
held out but trains nothing; repeated rows are separate documents; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Sums, split_batches, text_bytes

UNKNOWN = "und"
#: Trigrams are counted in this many hashed cells, so that a language's table is bounded.
CELLS = 1 << 15
ROUNDS = 8
#: Penalty per further language, in halves of the logarithm of the number of words.
PENALTY = 3.0

#: Bytes of text whose words are looked at at once: each takes some arrays of the number of languages.
BATCH = 1 << 19

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters only (others as blanks), word starts and ends, and each document's first word."""
    low = _LETTERS[data]
    second = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[second] += 32
    inside = low != 32
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, at)


def _trigrams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of all words, with a blank on both sides of a word, and the first of each word."""
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    i = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], size)
    mid = low[i].astype(np.uint32)
    left, right = low[np.maximum(i - 1, 0)].astype(np.uint32), low[np.minimum(i + 1, len(low) - 1)].astype(np.uint32)
    left[upto[:-1]] = 32
    right[upto[1:] - 1] = 32
    return ((left << 16 | mid << 8 | right) * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1), upto[:-1]


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # cells x languages


def train(docs: DataFrame, smooth: float = 0.5) -> Model | None:
    """Trigram probabilities from all rows of docs(doc_id, text, lang) that may train."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in split_batches(whole, "text", BATCH):
                data, at = text_bytes(batch.column("text"))
                low, starts, ends, first = _words(data, at)
                if not len(starts):
                    continue
                cells, head = _trigrams(low, starts, ends)
                lang = batch.column("lang").dictionary_encode()
                names = lang.dictionary.to_pylist()
                per = np.repeat(np.asarray(lang.indices), np.diff(np.append(head, len(cells))[first]))
                counts = np.bincount(per.astype(np.int64) * CELLS + cells, minlength=len(names) * CELLS).reshape(-1, CELLS)
                for name, n in zip(names, counts, strict=True):
                    total[name] = total.get(name, 0) + n
        for name, n in total.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell), pa.array(n[cell])], ["lang", "cell", "n"])

    counts = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    if not names:
        return None
    table = np.full((len(names), CELLS), smooth)
    place = {x: i for i, x in enumerate(names)}
    where = np.array([place[x] for x in counts.column("lang").to_pylist()])
    table[where, np.asarray(counts.column("cell"))] += np.asarray(counts.column("n"))
    return Model(names, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32).copy())


def _mixture(p: np.ndarray, n: np.ndarray, head: np.ndarray, owner: np.ndarray, allowed: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of the allowed languages in each document, by expectation-maximisation from equal ones."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, head)[:, None]
    for _ in range(rounds):
        r = p * share[owner]
        r *= (n / r.sum(axis=1))[:, None]
        share = np.add.reduceat(r, head, axis=0) / total
        share = np.where(allowed, np.maximum(share, 1e-6), 0)
        share /= share.sum(axis=1, keepdims=True)
    return share


def mixtures(logs: np.ndarray, n: np.ndarray, head: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions in the best set of languages, for documents whose words (log-likelihoods, counts) start at head."""
    size = np.diff(np.append(head, len(logs)))
    owner = np.repeat(np.arange(len(head)), size)
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(logs - top, -60)).astype(np.float64)
    n = n.astype(np.float64)
    k = logs.shape[1]
    words = np.add.reduceat(n, head)

    def gain(share: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.add.reduceat(n[which] * np.log(np.maximum((p[which] * share[owner[which]]).sum(axis=1), 1e-300)), _heads(which, owner))

    everyone = np.ones(len(logs), bool)
    full = _mixture(p, n, head, owner, np.ones((len(head), k), bool), rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best = (rank == 0).astype(np.float64)
    value = gain(best, everyone)
    # the logarithm is concave: no proportions gain more over `full` than this
    mean = np.add.reduceat(p * (n / (p * full[owner]).sum(axis=1))[:, None], head, axis=0) / words[:, None]
    bound = gain(full, everyone) + words * np.log(np.maximum(mean.max(axis=1), 1))
    for m in range(2, k + 1):
        open_ = bound - penalty * (m - 1) * 0.5 * np.log(np.maximum(words, 2)) > value
        docs = np.flatnonzero(open_)
        if not len(docs):
            break
        which = open_[owner]
        local = np.searchsorted(docs, owner[which])
        start = np.searchsorted(local, np.arange(len(docs)))
        share = _mixture(p[which], n[which], start, local, rank[docs] < m, rounds)
        everywhere = np.zeros_like(best)
        everywhere[docs] = share
        now = gain(everywhere, which) - penalty * (m - 1) * 0.5 * np.log(np.maximum(words[docs], 2))
        better = now > value[docs]
        best[docs[better]], value[docs[better]] = share[better], now[better]
    return best


def _heads(which: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(owner[which], prepend=-1))


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _shares(texts: pa.Array, logs: np.ndarray) -> np.ndarray:
    """Proportions of the languages of each text (a row of zeros if it has no letter)."""
    data, at = text_bytes(texts)
    low, starts, ends, first = _words(data, at)
    share = np.zeros((len(at) - 1, logs.shape[1]))
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return share
    ascii_letters = np.diff(np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])[at])
    odd = [i for i in some[ascii_letters[some] == 0] if not _has_letter(texts[int(i)].as_py())]
    _, where, code = np.unique(Sums(low).of(starts, ends), return_index=True, return_inverse=True)
    cells, head = _trigrams(low, starts[where], ends[where])
    word_logs = np.add.reduceat(logs[cells], head, axis=0)
    pair, count = np.unique(np.repeat(np.arange(len(share)), np.diff(first)) * len(where) + code, return_counts=True)
    share[some] = mixtures(word_logs[pair % len(where)], count, np.flatnonzero(np.diff(pair // len(where), prepend=-1)))
    share[odd] = 0
    return share


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and shares (of the chosen set, by language) of every row of docs(doc_id, text)."""
    names = model.languages if model else [UNKNOWN]
    sent = docs.sparkSession.sparkContext.broadcast(model.logs if model else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text", BATCH):
                share = _shares(batch.column("text"), sent.value) if sent.value is not None else np.zeros((batch.num_rows, 1))
                top = share.argmax(axis=1)
                score = np.minimum(share[np.arange(len(share)), top], 1.0)
                found = [names[k] if s > 0 else UNKNOWN for k, s in zip(top, score, strict=True)]
                shares = [[(names[k], float(s[k])) for k in np.flatnonzero(s)] for s in share]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string, double>")


#: A document is rejected if no language has this share of its words.
LEAST_SHARE = 0.5


def keep_identified(docs: DataFrame, model: Model | None, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs in whose text one language has at least `least` of the words; all columns stay. Without a model all rows with a letter stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model.logs if model else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text", BATCH):
                texts = batch.column(batch.schema.get_field_index("text"))
                kept = _shares(texts, sent.value).max(axis=1) >= least if sent.value is not None else np.array([_has_letter(x) for x in texts.to_pylist()])
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
