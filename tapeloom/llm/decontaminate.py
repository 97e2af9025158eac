"""Benchmark items in documents, whole or with a few edits.

Texts are compared as lower-cased words of letters and digits with one space between them. An item of ``n`` such code
points may differ by ``k = error_rate * n`` edits. It is split into ``k + 1`` pieces: at least one of them stands
unchanged in any match. All pieces are found in one pass over a text by an automaton; around each hit the item is
verified with Myers' bit-parallel edit distance, over the stretch that the hits of one item span together.

The benchmark is a stated query set: it is cut by a hash of id and text into blocks of about ``BLOCK_CHARS`` code points,
and each block is held against all rows, whose texts do not move.

Cases: a null or empty item, or one without letters and digits, matches nothing; an item too short for an edit must
stand as whole words. A null or empty text matches nothing. Rows with equal or null id are judged each by its own text;
items with equal id and text count once. An empty table gives an empty one; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Rows, texts

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")
LEAKS = "doc_id bigint, item_id bigint, distance int, first_char bigint, last_char bigint"


def plain(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def myers(item: str, text: str, anchored: bool = False) -> list[int]:
    """Edits between ``item`` and the best stretch of ``text`` that ends at each place (anchored: the stretch is a prefix)."""
    size = len(item)
    mask, high, at = (1 << size) - 1, 1 << (size - 1), {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    more, less, score, out = mask, 0, size, []
    for c in text:
        eq = at.get(c, 0)
        xv = eq | less
        xh = (((eq & more) + more) ^ more) | eq
        ph, mh = less | (~(xh | more) & mask), more & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1 | anchored) & mask, mh << 1 & mask
        more, less = mh | (~(xv | ph) & mask), ph & xv
        out.append(score)
    return out


class Items:
    """One block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items = sorted({(i, p) for i, t in items if t and (p := plain(t))})
        self.edits = [int(error_rate * len(p)) for _, p in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, ((_, p), k) in enumerate(zip(self.items, self.edits)):
            cuts = [len(p) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(p[a:b], []).append((n, a))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Best match of each item: number of the item, edits, first and last place in ``text`` (a plain one)."""
        starts: dict[int, set[int]] = {}
        if self.items:
            for end, (size, where) in self.pieces.iter(text):
                for n, offset in where:
                    starts.setdefault(n, set()).add(end + 1 - size - offset)
        out = []
        for n, found in sorted(starts.items()):
            item, k = self.items[n][1], self.edits[n]
            best = None
            exact = [s for s in found if text.startswith(item, s) and s >= 0 and (k or self._whole(text, s, s + len(item)))]
            if exact:
                best = (0, min(exact), min(exact) + len(item) - 1)
            elif k:
                for a, b in self._stretches(sorted(found), len(item), k):
                    a = max(a, 0)
                    scores = myers(item, text[a:b])
                    low = min(scores, default=k + 1)
                    if low <= k and (best is None or low < best[0]):
                        end = a + scores.index(low)
                        back = myers(item[::-1], text[max(0, end + 1 - len(item) - k):end + 1][::-1], anchored=True)
                        best = (low, end - back.index(min(back)), end)
            if best:
                out.append((n, *best))
        return out

    @staticmethod
    def _whole(text: str, a: int, b: int) -> bool:
        return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")

    @staticmethod
    def _stretches(starts: list[int], size: int, k: int) -> Iterator[tuple[int, int]]:
        """Stretches that may hold the item, joined where they overlap."""
        a, b = starts[0] - k, starts[0] + size + k
        for s in starts[1:]:
            if s - k > b:
                yield a, b
                a = s - k
            b = s + size + k
        yield a, b


def _blocks(benchmark: DataFrame, block_chars: int):
    """Lists of (item_id, text), each of about ``block_chars`` code points."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in own.collect()]  # one block: block_chars bounds it


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item it holds: edits, and the first and last code point of the words in the text."""
    spark, rows, out = docs.sparkSession, texts(docs, id_col, text_col), None
    for block in _blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items, out = Items(held.value, error_rate), Rows(LEAKS)
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    found = items.find(plain(text))
                    if found:
                        first, last, at = [], [], 0  # words in the plain text, and where they are in the text
                        spans = [m.span() for m in WORD.finditer(text)]
                        for a, b in spans:
                            first.append(at)
                            at += len(plain(text[a:b])) + 1
                            last.append(at - 2)
                        for n, edits, a, b in found:
                            i = max((j for j, x in enumerate(first) if x <= a), default=0)
                            j = min((j for j, x in enumerate(last) if x >= b), default=len(spans) - 1)
                            out.add(doc.as_py(), items.items[n][0], edits, spans[i][0], spans[j][1] - 1)
                if out.full():
                    yield from out.take()
            yield from out.take()

        part = rows.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
                 text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item."""
    at, spark = docs.columns.index(text_col), docs.sparkSession
    for block in _blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = Items(held.value, error_rate)
            for batch in batches:
                clean = [not ((text := t.as_py()) and items.find(plain(text))) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
