"""Spellings of a corpus and the words one edit away, by pairs of trie nodes.

Words are counted, kept if long and frequent enough, and laid out in two tries: one of the words, one of the words read
backwards. A node is a number, so a prefix and a suffix of any length are two integers. A word that skips position i
shows the pair (node of what comes before, node of what comes after); a word that is open to one more letter at i shows
the pair of the two parts it would be put between. Two words differ by one replaced letter if they skip the same
position to the same pair, and by one inserted letter if the skip of the longer is the opening of the shorter. The pairs
are exact: no string is compared and nothing needs to be verified.

Nodes are numbered on the sorted words: a word shares the nodes of its common prefix with the word before it and opens
fresh numbers for the rest. Sorting is by ranges, so tasks number their own stretches; a prefix that goes on across the
edge of a stretch gets its first number back from a table with a row per stretch.

A letter that stands several times in a row can be dropped at several places with the same result; only the last place
counts, so each near pair meets in exactly one pair of nodes. At a pair of nodes there is one word at most for each
letter of the alphabet and one without a letter, so a group has under a hundred members whatever the corpus; its members
only take the group's most frequent word (or the second, for the first itself), so no pairs of words are formed.

Cases: null and empty texts have no words. A null id counts as an empty one when spellings are thinned. Rows with equal
id are counted each. Words of any length are held in one row and never cut; their pairs grow with their length, not with
its square. Ties go to the smallest word in code-point order. An empty table gives an empty one. Other columns of the
input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import Rows, arrow_schema, discard, store, texts

# Letters are A-Z, a-z and U+00C0 to U+00FF, whose UTF-8 form always begins with the byte C3.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
THIN = 97
LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR = 5, 3, 2

LONG_TEXT = 4 << 20  # bytes from which runs are met one at a time
KEPT_RUNS = 200_000  # words a task gathers before it hands their counts on
STRETCH = 200_000  # words of one stretch of a trie
BITS = 40  # of a node's number inside its stretch

GAP, SKIP, LAST_SKIP = 0, 1, 2
PAIRS = "p bigint, s bigint, n bigint, code bigint"
NEAR = "id bigint, n_near bigint, near_n bigint, near_id bigint"


def spelled(run: bytes, start: int) -> bytes:
    """``run``, or the run without a letter if its checksum, begun as ``start``, says so."""
    h = crc32(run, start)
    if h % THIN:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def spellings(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``word, n`` of every spelling of at least so many code points and occurrences."""
    columns = "word string, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, out = Counter(), Rows(columns)

        def flush():
            for word, n in counts.items():
                out.add(word.decode(), n)
            counts.clear()
            return out.take()

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode().lower()
                start = crc32(b"%s:" % (b"" if doc.as_py() is None else str(doc.as_py()).encode()))
                found = RUN.findall(raw) if len(raw) < LONG_TEXT else (m[0] for m in RUN.finditer(raw))
                for own, n in Counter(found).items():
                    word = spelled(own, start)
                    if len(word) >= least_letters and len(word) - word.count(b"\xc3") >= least_letters:
                        counts[word] += n
                if len(counts) >= KEPT_RUNS:
                    yield from flush()
        yield from flush()

    partial = texts(docs, id_col, text_col).mapInArrow(run, columns)
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size - 1
    while low < high:  # the first place where they differ
        middle = (low + high) // 2
        if a[low:middle + 1] == b[low:middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


def trie_paths(words: DataFrame, stretches: int) -> DataFrame:
    """``word, path``: for each word (column ``word``, each once) the numbers of its prefixes of length 1, 2, ... in order.

    Equal prefixes have equal numbers, different ones different numbers. Numbers of whole words grow in the words' order.
    """
    columns = "stretch int, word string, path array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = TaskContext.get().partitionId()
        last, path, fresh, out = "", [], stretch << BITS, Rows(columns)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                shared = common(last, word)
                path = path[:shared] + list(range(fresh, fresh + len(word) - shared))
                fresh += len(word) - shared
                last = word
                out.add(stretch, word, path, size=32 + 16 * len(word))
                if out.full():
                    yield from out.take()
        yield from out.take()

    spark = words.sparkSession
    in_order = words.select("word").repartitionByRange(stretches, "word").sortWithinPartitions("word")
    paths = store(in_order.mapInArrow(run, columns), "paths")
    edges = paths.groupBy("stretch").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("path", "word").alias("path"))
    carried, last, end = [], "", []
    for row in edges.orderBy("stretch").collect():  # a row per stretch
        carried.append((row["stretch"], end[:common(last, row["first"])]))
        shared = common(last, row["last"])
        last, end = row["last"], end[:shared] + row["path"][shared:]
    edge = spark.createDataFrame(carried, "stretch int, carried array<bigint>")
    own = F.col("stretch").cast("long") * F.lit(1 << BITS)
    number = F.transform("path", lambda x: F.when(x - own < F.size("carried"), F.get("carried", (x - own).cast("int"))).otherwise(x))
    return paths.join(edge, "stretch").select("word", F.when(F.size("carried") > 0, number).otherwise(F.col("path")).alias("path"))


def node_pairs(forward: np.ndarray, backward: np.ndarray, letters: np.ndarray, sizes: np.ndarray):
    """Word number, prefix node, suffix node and kind of every skip and opening of a batch of words.

    The two paths and the letters of all words lie one after another; the root of either trie is -1.
    """
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(word)) - np.repeat(first + np.arange(len(sizes)), sizes + 1)  # 0 to the size of the word
    begin, size = first[word], sizes[word]

    def node(path: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.where(length > 0, path[np.maximum(begin + length - 1, 0)], -1)

    before = node(forward, at)
    kinds = np.zeros(len(word), np.int64)
    inside = at < size
    place = (begin + at)[inside]
    follows = np.append(letters[1:], 0)[place] == letters[place]
    last = at[inside] == size[inside] - 1
    kinds_in = np.where(follows & ~last, SKIP, LAST_SKIP)
    openings = (word, before, node(backward, size - at), kinds)
    skips = (word[inside], before[inside], node(backward, size - at - 1)[inside], kinds_in)
    return tuple(np.concatenate(c) for c in zip(openings, skips))


def meet(p: np.ndarray, s: np.ndarray, n: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """What each member of whole groups of (p, s), sorted by it and by falling n, gains from its group.

    Columns of ``NEAR``: number of near words met here, the most frequent of them and its count.
    """
    fresh = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])) if len(p) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    kind, ids = code & 3, code >> 2
    out = []

    def first_two(rows: np.ndarray):
        """Rows (sorted) that come first and second in their group, -1 for none, and the size of each group."""
        size = np.bincount(group[rows], minlength=groups)
        start = np.cumsum(size) - size
        padded = np.append(rows, [-1, -1])
        return np.where(size > 0, padded[np.minimum(start, len(rows))], -1), np.where(size > 1, padded[np.minimum(start + 1, len(rows))], -1), size

    def give(rows: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        out.append((ids[rows], number, n[best], ids[best]))

    skips, lasts, gaps = np.flatnonzero(kind != GAP), np.flatnonzero(kind == LAST_SKIP), np.flatnonzero(kind == GAP)
    if len(skips):
        one, two, size = first_two(skips)
        many = skips[size[group[skips]] > 1]
        give(many, np.where(one[group[many]] == many, two[group[many]], one[group[many]]), size[group[many]] - 1)  # replaced
    if len(lasts) and len(gaps):
        open_, _, opened = first_two(gaps)
        mine = lasts[opened[group[lasts]] > 0]
        give(mine, open_[group[mine]], np.ones(len(mine), np.int64))  # a letter less
        top, _, longer = first_two(lasts)
        mine = gaps[longer[group[gaps]] > 0]
        give(mine, top[group[mine]], longer[group[mine]])  # a letter more
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out))


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, near_n, near_id`` for words (``id, word, n, forward, backward``) that have one; ids in word order."""
    pairs, near = arrow_schema(PAIRS), arrow_schema(NEAR)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                part = batch.slice(at, 20_000)
                ids, counts = (part.column(i).to_numpy() for i in (0, 2))
                every = part.column(1).to_pylist()
                sizes = np.array([len(w) for w in every], np.int64)
                letters = np.frombuffer("".join(every).encode("utf-32-le"), "<u4")
                paths = [part.column(i).flatten().to_numpy() for i in (3, 4)]
                word, p, s, kind = node_pairs(*paths, letters, sizes)
                columns = (p, s, counts[word], ids[word] << 2 | kind)
                for b in range(0, len(p), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(c[b:b + (1 << 20)]) for c in columns], schema=pairs)

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            if not len(batch):
                continue
            kept = tuple(np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept))
            same = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
            last = int(np.argmax(same))  # the last group may go on in the next batch
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in meet(*(k[:last] for k in kept))], schema=near)
            kept = tuple(k[last:] for k in kept)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in meet(*kept)], schema=near)

    spread = words.select("id", "word", "n", "forward", "backward").mapInArrow(emit, PAIRS)
    spread = spread.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "code")
    best = F.max(F.struct("near_n", (-F.col("near_id")).alias("_back")))
    return (
        spread.mapInArrow(collide, NEAR).groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
        .select("id", "n_near", F.col("_b.near_n").alias("near_n"), (-F.col("_b._back")).alias("near_id"))
    )


def last_forms(forms: DataFrame, most: int) -> DataFrame:
    """``id, root`` of a table ``id, root`` of one step, with each chain of at most ``most`` steps followed to its end."""
    roots = store(forms, "forms")
    for _ in range(max(0, math.ceil(math.log2(max(most, 1))))):
        onward = roots.select(F.col("id").alias("_via"), F.col("root").alias("_next"))
        after = store(roots.join(onward, F.col("root") == F.col("_via"), "left").select("id", F.coalesce("_next", "root").alias("root")), "forms")
        discard(roots)
        roots = after
    return roots


def group_spellings(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the corpus; a form is ``factor`` (over 1) times as frequent."""
    if factor <= 1:
        raise ValueError("a factor of 1 or less lets two words be forms of each other")
    spark: SparkSession = docs.sparkSession
    counted = store(spellings(docs, least_letters, least_count, id_col, text_col), "spellings")
    size, largest = counted.agg(F.count(F.lit(1)), F.max("n")).first()
    stretches = max(spark.sparkContext.defaultParallelism, -(-size // STRETCH))
    forward = trie_paths(counted, stretches).withColumnRenamed("path", "forward")
    backward = trie_paths(counted.select(F.reverse("word").alias("word")), stretches)
    backward = backward.select(F.reverse("word").alias("word"), F.col("path").alias("backward"))
    words = store(
        counted.join(forward, "word").join(backward, "word")
        .select(F.element_at("forward", -1).alias("id"), "word", "n", "forward", "backward"), "words")
    near = store(near_words(words), "near")
    rows = words.select("id", "word", "n").join(near, "id", "left")
    formed = F.col("near_n") >= factor * F.col("n")
    rows = rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                       F.when(formed, F.col("near_id")).alias("_form"), F.when(formed, F.col("near_n")).alias("form_n"))
    steps = int(math.log(max((largest or 1) / max(least_count, 1), 1), factor)) + 1
    roots = last_forms(rows.where("_form IS NOT NULL").select("id", F.col("_form").alias("root")), steps)
    roots = roots.select("id", F.col("root").alias("_root"))
    names = words.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    form = names.select(F.col("_id").alias("_form"), F.col("_word").alias("form"))
    root = names.select(F.col("_id").alias("_root"), F.col("_word").alias("root"))
    return (
        rows.join(form, "_form", "left").join(roots, "id", "left").join(root, "_root", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
