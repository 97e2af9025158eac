"""Brown class-based bigram model: words in classes by exchange clustering, and the log probability of texts.

A text is its words (parted by ASCII white space, A-Z in lower case) and one end token. The model gives a token
P(class | class before) * P(word | class); the token before the first is an end token. The base is the word frequency alone.

Counts of all training words stay a table. Two bounded lists are read off it: words that make up at least ``COUNT_SHARE`` of all
training tokens (at most 1 / COUNT_SHARE words, whatever the corpus), whose counts every task knows, and among them those
of at least ``UNIT_SHARE``, which are moved between classes one by one. All other words, seen or not, are moved in pools
by a checksum of their last three bytes, so that every word has a class without being looked up. Rarer words meet
their counts in a join, once per document and word.

Texts become sequences of unit numbers once. A round of exchange reads the sequences: each task sums up for every unit how often
each class stands before and after it; sums meet by unit. From them the gain in likelihood of moving a unit, all else
equal, is exact; the units whose turn it is move to their best class. Rounds end when no unit gains or after ``ROUNDS``; the
classes of the likeliest round are kept. The driver sees numbers per class and a class per unit, never words in number.

Cases: a null or empty text is its end token alone. A null id is a training row. Rows with equal id are scored each. A word
that training has not seen has the half count that smoothing leaves. Without training rows every class is as likely as the
others. Texts of any length are scored whole. An empty table gives an empty one. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Rows, arrow_schema, discard, store, texts

FOLDS, HELD_FOLD = 5, 1
CLASSES, ROUNDS, TURNS = 64, 8, 2
COUNT_SHARE, UNIT_SHARE, POOLS = 2.0 ** -20, 2.0 ** -15, 2048  # at most 2^20 counts and 2^15 + 2049 units
HALF, PRIOR = 0.5, 8.0  # smoothing of words; weight of the class frequency in a transition
END = b""  # the end token; no word is empty
KEPT_WORDS, KEPT_TOKENS = 200_000, 1 << 21  # what a task gathers before it hands counts on

SEQUENCES = ("row bigint, doc_id bigint, held_out boolean, units binary, known_tokens bigint, known_log double, "
             "rare array<binary>, times array<int>")
CONTEXT = "unit int, counts binary"


def held_out(doc_id: str = "doc_id"):
    """Whether a document is left out of training, by a checksum of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def token_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` of all tokens of texts (``text``), end tokens under ``END``."""
    columns = "word binary, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, out = Counter(), Rows(columns)

        def flush():
            for word, n in counts.items():
                out.add(word, n)
            counts.clear()
            return out.take()

        for batch in batches:
            for text in batch.column(0):
                counts.update(text.as_py().encode().lower().split())
                counts[END] += 1
                if len(counts) >= KEPT_WORDS:
                    yield from flush()
        yield from flush()

    return rows.select("text").mapInArrow(run, columns).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows: frequent words with their counts, the most frequent first, and how many have their own unit."""

    words: list[bytes]
    counts: np.ndarray
    own: int  # words with a unit of their own, from 1; END is unit 0
    pools: int

    @property
    def units(self) -> int:
        return 1 + self.own + self.pools

    def pool(self, word: bytes) -> int:
        return 1 + self.own + crc32(word[-3:]) % self.pools


class Places(dict):
    """Word -> place among the frequent words, or minus its unit for all others."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(zip(vocabulary.words, range(len(vocabulary.words))))
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        return -self.vocabulary.pool(word)

    def units(self) -> np.ndarray:
        """Units of the frequent words."""
        own = self.vocabulary.own
        return np.array([i + 1 if i < own else self.vocabulary.pool(w) for i, w in enumerate(self.vocabulary.words)], np.int64)


def frequent(counts: DataFrame, tokens: int, count_share: float = COUNT_SHARE, unit_share: float = UNIT_SHARE, pools: int = POOLS) -> Vocabulary:
    """At most ``1 / count_share`` words come to the driver, since shares add up to one."""
    if not tokens:
        return Vocabulary([], np.zeros(0, np.int64), 0, pools)
    rows = counts.where((F.col("n") >= count_share * tokens) & (F.length("word") > 0)).collect()
    rows = sorted(((r["n"], bytes(r["word"])) for r in rows), key=lambda r: (-r[0], r[1]))
    own = sum(n >= unit_share * tokens for n, _ in rows)
    return Vocabulary([w for _, w in rows], np.array([n for n, _ in rows], np.int64), own, pools)


def sequences(docs: DataFrame, vocabulary: Vocabulary, ends: int) -> DataFrame:
    """Units of each row's tokens (16 bits each) and the sums that need no other table; ``ends``: end tokens in training."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most 1 / COUNT_SHARE words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, out = Places(held.value), Rows(SEQUENCES)
        units, logs = places.units(), np.log10(held.value.counts + HALF)
        end_log = math.log10(ends + HALF)
        for batch in batches:
            for row, doc, left_out, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                words = text.as_py().encode().lower().split()
                at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                known = at >= 0
                found = at[known]
                made = -at
                made[known] = units[found]
                rare = Counter(words[i] for i in np.flatnonzero(~known))
                out.add(row, doc, left_out, made.astype("<u2").tobytes(), int(known.sum()) + (ends > 0), float(logs[found].sum()) + end_log,
                        list(rare), list(rare.values()), size=128 + 2 * len(words) + 40 * len(rare))
                if out.full():
                    yield from out.take()
        yield from out.take()

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, SEQUENCES)


def pool_sizes(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Number of different training words in each unit, END among them."""
    held, columns = counts.sparkSession.sparkContext.broadcast(vocabulary), "unit int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, sums = Places(held.value), np.zeros(held.value.units, np.int64)
        units = places.units()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                at = places[word] if word else 0
                sums[0 if not word else units[at] if at >= 0 else -at] += 1
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], schema=arrow_schema(columns))

    sizes = np.zeros(vocabulary.units, np.int64)
    for row in counts.select("word").mapInArrow(run, columns).groupBy("unit").agg(F.sum("n").alias("n")).collect():  # a row per unit
        sizes[row["unit"]] = row["n"]
    return sizes


def contexts(seqs: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """``unit, counts``: how often each class stands before (k numbers) and after (k numbers) a unit, and the unit after itself."""
    held, units, width = seqs.sparkSession.sparkContext.broadcast(classes), len(classes), 2 * k + 1
    schema = arrow_schema(CONTEXT)

    def rows(numbers: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(numbers), 4096):
            blobs = [r.tobytes() for r in sums[a:a + 4096].astype("<i8")]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[a:a + 4096].astype(np.int32)), pa.array(blobs, pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = held.value.astype(np.int64), np.zeros(units * width, np.int64)

        def add(parts: list[np.ndarray]) -> None:
            line = np.concatenate([np.zeros(1, np.int64), *parts])  # each part ends with an end token
            a, b = line[:-1], line[1:]
            for cells in (b * width + of[a], a * width + k + of[b], a[a == b] * width + 2 * k):
                sums[:] += np.bincount(cells, minlength=len(sums))

        parts, size = [], 0
        for batch in batches:
            for blob in batch.column(0):
                parts.append(np.append(np.frombuffer(blob.as_py(), "<u2").astype(np.int64), 0))
                size += len(parts[-1])
                if size >= KEPT_TOKENS:
                    add(parts)
                    parts, size = [], 0
        if parts:
            add(parts)
        table = sums.reshape(units, width)
        used = np.flatnonzero(table.any(axis=1))
        yield from rows(used, table[used])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(blob.as_py(), "<i8")
                sums[unit] = sums[unit] + own if unit in sums else own
        if sums:
            yield from rows(np.array(list(sums)), np.array(list(sums.values())))

    return seqs.select("units").mapInArrow(count, CONTEXT).repartition("unit").mapInArrow(total, CONTEXT)


def transitions(context: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often a class (row) stands before a class (column), from the contexts of all units."""
    held, columns = context.sparkSession.sparkContext.broadcast(classes), "c int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k), np.int64)
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[held.value[unit]] += np.frombuffer(blob.as_py(), "<i8")[:k]
        blobs = [r.tobytes() for r in sums.astype("<i8")]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(blobs, pa.binary())], schema=arrow_schema(columns))

    before = np.zeros((k, k), np.int64)
    for row in context.mapInArrow(run, columns).collect():  # k rows per task
        before[row["c"]] += np.frombuffer(row["counts"], "<i8")
    return before.T


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(n: np.ndarray) -> float:
    """Log likelihood of the training tokens, up to what does not depend on the classes."""
    return float(xlogx(n).sum() - xlogx(n.sum(axis=1)).sum() - xlogx(n.sum(axis=0)).sum())


def best_move(n: np.ndarray, at: int, before: np.ndarray, after: np.ndarray, itself: int) -> tuple[int, float]:
    """The class that suits a unit of class ``at`` best, and what moving there gains.

    ``before`` and ``after`` count the classes around the unit, ``itself`` the unit after itself. Classes keep their other units.
    """
    before, after = before.copy(), after.copy()
    before[at] -= itself
    after[at] -= itself
    rest = n.copy()  # without the unit, which is then a class of its own
    rest[:, at] -= before
    rest[at, :] -= after
    rest[at, at] -= itself
    into, out_of = before.sum() + itself, after.sum() + itself
    rows = xlogx(rest + after) - xlogx(rest)  # row c: the unit's followers join those of c
    cols = xlogx(rest + before[:, None]) - xlogx(rest)
    own = np.diagonal(rest)
    corner = xlogx(own + before + after + itself) - xlogx(own)
    row_sum, col_sum = n.sum(axis=1), n.sum(axis=0)
    row_sum[at] -= out_of
    col_sum[at] -= into
    gain = rows.sum(axis=1) - np.diagonal(rows) + cols.sum(axis=0) - np.diagonal(cols) + corner
    gain -= xlogx(row_sum + out_of) - xlogx(row_sum) + xlogx(col_sum + into) - xlogx(col_sum)
    gain[0] = -np.inf  # the class of the end token stays its own
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[at])


def moves(context: DataFrame, classes: np.ndarray, n: np.ndarray, turn: int, turns: int = TURNS) -> list[tuple[int, int]]:
    """New classes of the units whose turn it is and that gain by moving."""
    k, columns = len(n), "unit int, c int"
    held = context.sparkSession.sparkContext.broadcast((classes, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (classes, n), out = held.value, Rows(columns)
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if unit and crc32(b"%d" % unit) % turns == turn:
                    row = np.frombuffer(blob.as_py(), "<i8")
                    best, gain = best_move(n, int(classes[unit]), row[:k], row[k:2 * k], int(row[2 * k]))
                    if best != classes[unit] and gain > 1e-6:
                        out.add(unit, best)
        yield from out.take()

    return [tuple(r) for r in context.mapInArrow(run, columns).collect()]  # a row per unit at most


def exchange(seqs: DataFrame, units: int, k: int = CLASSES, rounds: int = ROUNDS, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the units, transitions between the classes and the likelihood of each round."""
    classes = np.append(0, 1 + np.arange(units - 1) % (k - 1)).astype(np.int32)  # units come by falling frequency
    best, seen, idle = None, [], 0
    for r in range(rounds + 1):
        context = store(contexts(seqs, classes, k), "contexts")
        n = transitions(context, classes, k)
        seen.append(likelihood(n))
        if best is None or seen[-1] > best[0]:
            best = (seen[-1], classes, n)
        moved = moves(context, classes, n, r % turns, turns) if r < rounds else []
        discard(context)
        idle = 0 if moved else idle + 1
        if r == rounds or idle == turns:
            break
        classes = classes.copy()
        for unit, c in moved:
            classes[unit] = c
    return best[1], best[2], seen


@dataclass
class Model:
    classes: np.ndarray  # of each unit
    step: np.ndarray  # log10 P(class | class before)
    mass: np.ndarray  # log10 of what a word's smoothed count is divided by, for each class


def model(classes: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> Model:
    k = len(n)
    tokens = n.sum(axis=0).astype(float)
    share = (tokens + 1) / (tokens.sum() + k)
    step = (n + PRIOR * share) / (n.sum(axis=1, keepdims=True) + PRIOR)
    different = np.bincount(classes, weights=sizes, minlength=k)
    return Model(classes, np.log10(step), np.log10(tokens + HALF * (different + 1)))


def class_terms(seqs: DataFrame, made: Model) -> DataFrame:
    """The sums of each row without its rare words: ``n_tokens``, ``class_log`` and the columns of ``seqs`` that are narrow."""
    columns = "row bigint, doc_id bigint, held_out boolean, known_tokens bigint, known_log double, n_tokens bigint, class_log double"
    held, schema = seqs.sparkSession.sparkContext.broadcast(made), arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held.value
        for batch in batches:
            sizes, logs = [], []
            for blob in batch.column(5):
                c = made.classes[np.append(np.frombuffer(blob.as_py(), "<u2"), 0)]
                sizes.append(len(c))
                logs.append(float(made.step[np.append(0, c[:-1]), c].sum() - made.mass[c].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sizes, pa.int64()), pa.array(logs, pa.float64())], schema=schema)

    return seqs.select("row", "doc_id", "held_out", "known_tokens", "known_log", "units").mapInArrow(run, columns)


def score_texts(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, count_share: float = COUNT_SHARE, unit_share: float = UNIT_SHARE,
                pools: int = POOLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for each row.

    Rows that ``held_out`` names are scored but not learned from. Scores are log10 probabilities of whole texts.
    """
    if pools < 1 or classes < 2 or 1 + 1 / unit_share + pools > 1 << 16:
        raise ValueError("units are numbers of 16 bits, and there is at least one pool and one class beside that of the end token")
    rows = texts(docs, id_col, text_col).withColumn("held_out", held_out())
    counts = store(token_counts(rows.where(~F.col("held_out"))), "counts")
    tokens, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = counts.where(F.length("word") == 0).first()
    vocabulary = frequent(counts, tokens, count_share, unit_share, pools)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    seqs = store(sequences(numbered, vocabulary, end["n"] if end else 0), "sequences")
    found, n, _ = exchange(seqs.where(~F.col("held_out")), vocabulary.units, classes, rounds if tokens else 0)
    terms = class_terms(seqs, model(found, n, pool_sizes(counts, vocabulary)))
    pairs = seqs.select("row", F.explode(F.arrays_zip("rare", "times")).alias("_p")).select("row", F.col("_p.rare").alias("word"), F.col("_p.times").alias("times"))
    met = pairs.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + HALF)).alias("rare_log"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    word_log = F.col("known_log") + F.coalesce("rare_log", F.lit(0.0))
    score = word_log + F.col("class_log")
    return terms.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known_tokens") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (word_log - F.col("n_tokens") * math.log10(tokens + HALF * (different + 1))).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
