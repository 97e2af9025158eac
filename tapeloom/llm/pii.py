"""Personal data: patterns that always count, and candidates chosen by boosted trees.

Base spans follow fixed patterns with checks. Generators of high recall propose further spans, which may overlap; trees
judge each by its format and by the words before it; of those above the threshold of their kind, the most probable one
of overlapping spans stays, and none that overlaps a base span. Documents are judged alone, nothing moves.

The trees are trained here: values of each kind, and look-alikes that are none (dates, versions, numbers of articles,
prices), are written into stretches of a bounded sample of the corpus (``MAX_CONTEXTS`` rows in expectation, by the
hash of the id). Generators are run over these texts; a candidate is true if it is the value. A third of the rows
calibrates scores, and thresholds are set where that third has ``PRECISION``.

Cases: a null or empty text has no spans. Rows with equal or null id are judged each by its own text. An empty table
gives an empty one (the trees then learn from bare values). Ties of probability go to the longer, then the earlier span.
Only id and text are read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.boosting import Boosted, cut_for_precision, fit_boosted
from tapeloom.llm.common import hash_share, texts

KINDS = ["email", "ip", "card", "phone", "account", "secret"]  # the first four have a base pattern
MAX_CONTEXTS, STRETCH, PRECISION = 2000, 400, 0.98

# The base patterns. Possessive and anchored forms find what the plain ones find, in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGITS, SPELLED = tuple("0123456789"), ("(at)", "[at]", "{at}", " dot ")
# High-recall generators: kind, what a text must hold at all, and pattern.
GENERATORS = [
    ("email", ("@",), re.compile(r"[^\s@<>\"'(),;:]{1,64}@[^\s@<>\"'(),;:]{2,255}")),
    ("email", SPELLED, re.compile(r"[\w.+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[\w-]{1,64}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z-]{2,24}){1,4}")),
    ("ip", DIGITS, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    ("ip", DIGITS, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:{1,2}){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", ("::",), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])")),
    ("card", DIGITS, re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])")),
    ("phone", DIGITS, re.compile(r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,12}\)?){1,5}(?![0-9])")),
    ("account", DIGITS, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("account", DIGITS, re.compile(r"(?<![0-9])[0-9]{9,24}(?![0-9])")),
    ("secret", DIGITS, re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+")),
]
PHONE_DIGITS, LAST_GROUP = 17, re.compile(r"[ ./-]{1,2}\(?[0-9]{2,12}\)?$")  # fifteen and 00
# Words before a value that speak for a kind (or against all).
HINTS = [("mail", "email", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "payment"),
         ("phone", "tel", "call", "mobile", "fax"), ("account", "iban", "konto", "number", "no"),
         ("token", "key", "secret", "password", "api", "auth", "bearer"),
         ("version", "v", "isbn", "page", "chapter", "date", "order", "item", "release", "build", "price")]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns that pass their checks, by kind as listed and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if any(c in text for c in "0123456789"):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) < 4 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all generators, overlaps included."""
    def whole(kind: str, m: re.Match) -> tuple[str, int, int]:
        """The span; of a chain of groups with more digits than a phone number has, its first groups."""
        a, b = m.span()
        if kind == "phone":
            while sum(c in DIGITS for c in text[a:b]) > PHONE_DIGITS and (g := LAST_GROUP.search(text, a, b)) and g.start() > a:
                b = g.start()
        return kind, a, b

    digits = any(c in text for c in DIGITS)
    return [whole(kind, m) for kind, needs, pattern in GENERATORS
            if (digits if needs is DIGITS else any(x in text for x in needs)) for m in pattern.finditer(text)]


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and what stands around it."""
    s = text[a:b]
    n, digits = len(s), "".join(c for c in s if c in "0123456789")
    letters, upper, hexa = sum(c.isalpha() for c in s), sum(c.isupper() for c in s), sum(c in "0123456789abcdefABCDEF" for c in s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    parts = s.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    entropy = -sum(k / n * math.log2(k / n) for c in set(s) for k in [s.count(c)])
    before = text[max(0, a - 24):a]
    words = re.findall(r"[a-z]+", before.lower())[-2:]
    left, right = text[a - 1:a], text[b:b + 1]
    year = any(len(g) == 4 and 1900 <= int(g) < 2100 for g in re.findall(r"[0-9]+", s))
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, letters / n, upper / n, hexa / n, entropy, len(set(s)),
        len(groups), max(groups), min(groups), groups[0], groups[-1], s.count("."), s.count("-"), s.count(" "), s.count(":"), s.count("/"),
        float("@" in s), float(s[0] == "+"), float("(" in s), float(quad), float(luhn(digits)) if digits else 0.0, float(year),
        float(bool(re.search(r"[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]", s))),
        float(left in "\"'=" and left != ""), float(left.isspace() or left == ""), float(right.isspace() or right == ""),
        float(right in "\"'" and right != ""), float(right.isalnum()), float(before.rstrip()[-1:] in ":=" and before != ""),
        *(float(any(w in hint for w in words)) for hint in HINTS),
    ]


def _values(r: random.Random) -> tuple[str | None, str]:
    """A made-up value and its kind; None for look-alikes that are no personal data."""
    def digits(n):
        return "".join(r.choice("0123456789") for _ in range(n))

    def word(low=3, high=9):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high)))

    name, host, end = word() + r.choice(["", ".", "_"]) + word(1, 6) + r.choice(["", digits(2)]), word(), r.choice(["com", "org", "net", "de", "es"])
    octets = [str(r.randint(0, 255)) for _ in range(4)]
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([24, 32, 40, 64])))
    made = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(r.randint(20, 48)))
    card = digits(15)
    card += next(c for c in "0123456789" if luhn(card + c))
    sep = r.choice([" ", "-"])
    a, b, c, d = digits(3), digits(3), digits(3), digits(4)
    options = [
        ("email", f"{name}@{host}.{end}"), ("email", f"{name} at {host} dot {end}"), ("email", f"{name} (at) {host}.{end}"),
        ("email", f"{name}[at]{host}[dot]{end}"), ("ip", ".".join(octets)),
        ("ip", ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))),
        ("card", card), ("card", sep.join(card[i:i + 4] for i in range(0, 16, 4))), ("account", digits(r.choice([12, 14, 16, 18, 20]))),
        ("account", digits(16)), ("account", r.choice(["DE", "ES", "FR"]) + digits(2) + "".join(" " + digits(4) for _ in range(4)) + " " + digits(2)),
        ("phone", f"({a}) {b}-{d}"), ("phone", f"+{r.randint(1, 99)} {a} {b} {d}"), ("phone", f"{a}-{b}-{d}"), ("phone", f"+1 ({a}) {b}-{d}"),
        ("phone", f"00{r.randint(30, 49)} {a} {b}{d}"), ("secret", hexes), ("secret", made), ("secret", f"sk_{word(4, 4)}_{made}"),
        ("phone", f"0{digits(2)} {digits(8)}"), ("phone", f"(0{digits(2)}) {digits(7)}"), ("phone", f"{a}-{digits(7)}"), ("phone", f"0{digits(3)}/{digits(7)}"),
        ("ip", f"{hexes[:4]}:{hexes[4:8]}::{hexes[8:8 + r.randint(1, 4)]}"), ("ip", f"fe80::{hexes[:r.randint(1, 4)]}"), ("secret", made * r.randint(12, 30)),
        (None, f"{word()}::{word()}"), (None, f"{r.choice('abcdef')}::{r.choice('abcdef')}"), (None, f"{r.randint(1, 99)} {digits(7)}"),
        (None, f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"), (None, f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}"),
        (None, f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"), (None, f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}"),
        (None, f"{r.randint(1900, 2050)}-{r.randint(1900, 2099)}"), (None, f"978-{r.randint(0, 9)}-{c}-{digits(5)}-{r.randint(0, 9)}"),
        (None, f"{r.randint(1, 999)} {c} {b}"), (None, f"{r.randint(1, 9)}.{digits(9)}"), (None, f"{r.randint(1, 99)}/{r.randint(1, 99)}/{r.randint(1, 99)}"),
        (None, f"{r.randint(10, 99)} {r.randint(10, 99)}"), (None, f"{word()}-{word()}-{word()}-{r.randint(1, 20)}"), (None, digits(r.randint(1, 8))),
        (None, f"{word()}/{word()}/{word()}/{word()}{r.randint(1, 9)}"), (None, "=" * r.randint(16, 60) + "1"), (None, f"@{word()}"),
        (None, f"{word()} at {word()}"), (None, f"{word()}@{word()}"), (None, "1" * r.randint(9, 16)), (None, f"{word(8, 14)}{word(8, 14)}{r.randint(1, 9)}"),
    ]
    return r.choice(options)


def training_rows(contexts: list[str], seed: int = 7, per_context: int = 4) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Candidates of texts with one value written in: features, truth, kind."""
    r, x, y, kinds = random.Random(seed), [], [], []
    hints = {k: h for k, h in zip(KINDS, HINTS)}
    for context in contexts:
        words = [w for w in context.split() if not any(c in w for c in "0123456789@")] or ["text"]
        for _ in range(per_context):
            kind, value = _values(r)
            at = r.randrange(len(words))
            lead = ""
            if r.random() < 0.3:
                lead = r.choice(hints[kind] if kind else HINTS[-1]) + r.choice([" ", ": ", " = "])
            quote = '"' if kind == "secret" and r.random() < 0.4 else ""
            left = " ".join(words[max(0, at - 12):at]) + " " + lead + quote
            text = left + value + quote + r.choice([" ", ". ", ", ", "\n"]) + " ".join(words[at:at + 12])
            for k, a, b in candidates(text):
                if b > len(left) and a < len(left) + len(value):
                    x.append(features(text, k, a, b))
                    true = kind is not None and (a, b) == (len(left), len(left) + len(value)) and (k == kind or {k, kind} <= {"card", "account"})
                    y.append(true)
                    kinds.append(k)
    return np.array(x, float), np.array(y, bool), kinds


def _place(id_col: str, text_col: str):
    """Where the stretch of a text begins, from 1: anywhere, by the hash of the id."""
    return (1 + F.pmod(F.xxhash64(id_col, F.lit("stretch")), F.greatest(F.length(text_col) - STRETCH, F.lit(1)))).cast("int")


def train(docs: DataFrame, max_contexts: int = MAX_CONTEXTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Boosted, dict[str, float]]:
    """Trees and a threshold for each kind, from a bounded sample of stretches of the corpus."""
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    total = known.count()
    chosen = known.where(hash_share(F.xxhash64(id_col), max_contexts, total))
    rows = chosen.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).substr(_place(id_col, text_col), F.lit(STRETCH)).alias("t")).orderBy("i", "t").collect()
    if total and not rows:
        raise ValueError("the sample of contexts is empty though there are texts")
    x, y, kinds = training_rows([r["t"] for r in rows] or ["some words to stand around a value"] * 200)
    model = fit_boosted(x, y)
    held = np.arange(len(y)) % 3 == 2
    p, kinds = model.probability(x), np.array(kinds)
    return model, {k: max(0.5, cut_for_precision(p[held & (kinds == k)], y[held & (kinds == k)], PRECISION)) for k in KINDS}


def find_spans(text: str, model: Boosted, cuts: dict[str, float]) -> list[tuple[str, int, int, bool, float]]:
    """Base spans and chosen candidates: kind, start, end, base, probability; by kind as listed and start."""
    base = base_spans(text)
    out, taken = [(k, a, b, True, 1.0) for k, a, b in base], [(a, b) for _, a, b in base]
    proposed = sorted(set(candidates(text)))
    if proposed:
        p = model.probability(np.array([features(text, *c) for c in proposed]))
        ranked = sorted((-round(float(q), 9), a - b, a, k, b) for q, (k, a, b) in zip(p, proposed) if q >= cuts[k])
        if ranked:
            owner = np.zeros(len(text), bool) if len(ranked) + len(taken) > 64 else None
            if owner is not None:
                for a, b in taken:
                    owner[a:b] = True
            for q, _, a, k, b in ranked:
                free = not owner[a:b].any() if owner is not None else all(b <= c or d <= a for c, d in taken)
                if free:
                    out.append((k, a, b, False, -q))
                    taken.append((a, b))
                    if owner is not None:
                        owner[a:b] = True
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  trained: tuple[Boosted, dict[str, float]] | None = None) -> DataFrame:
    """``doc_id`` and ``spans``: for each row its spans ``kind, start, end, base, score`` (code points, end exclusive)."""
    held = docs.sparkSession.sparkContext.broadcast(trained or train(docs, id_col=id_col, text_col=text_col))
    kind = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts = held.value
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base", "score"), s)) for s in find_spans(t.as_py(), model, cuts)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, spans {kind}")


def redact(text: str, spans: list[tuple[str, int, int, bool, float]]) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
