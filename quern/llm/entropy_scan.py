"""Secret scans: fixed patterns plus sliding-window entropy.

Patterns find assignments, access keys and hex strings.  Beside them, every run
of characters of a class (hex digits, base 32 and 36, base64) is read through a window of fixed
width whose Shannon entropy follows incremental counts: one character enters,
one leaves, and only their two terms of the sum change.  Windows over the class
limit are secrets unless the run matches the allow list.

Paths, addresses and file names are runs too.  A run whose parts between ``/ _ - + =``
all read like words, numbers or words with a number behind is allowed; counting
sequences are cut out of a run before its windows are measured.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.registry import query
from quern.llm.shared import read_table

# Fixed patterns of the scan; a match that fails its length is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A text without one of these holds no assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars`` of ``width`` or more, and the bits a window must exceed."""

    chars: str
    width: int
    bits: float


#: Limits lie where about one window in 100 of a random key falls below: hex of either case, base 32 and 36 of one case, base 64.
CLASSES = (CharClass("0-9A-Fa-f", 20, 2.9), CharClass("A-Z0-9", 20, 3.3), CharClass("a-z0-9", 20, 3.3), CharClass("A-Za-z0-9+/_=-", 20, 3.6))
#: Runs that look random and are none: words and names without digits, numbers, identifiers of the uuid form.
ALLOW = (
    r"[A-Za-z/_=+-]+", r"[0-9/_=+-]+", r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}",
)
#: Counting sequences, which no key holds by chance.
COUNTING = re.compile(r"0123456789|abcdefghij|ABCDEFGHIJ|9876543210")


_BETWEEN = re.compile("[/_=+-]+")
_LETTERS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def reads_like_words(run: str) -> bool:
    """Whether a run of several parts holds words and numbers alone, as paths and file names do.

    A part is a number, or letters with up to four digits behind; the letters are
    words in one case or with a capital in front, of which one may be a single letter.
    """
    parts = [p for p in _BETWEEN.split(run) if p]
    if len(parts) < 2:
        return False
    for part in parts:
        letters = part.rstrip("0123456789")
        if letters and (not letters.isalpha() or len(part) - len(letters) > 4 or sum(len(w) < 2 for w in _LETTERS.findall(letters)) > 1):
            return False
    return True


def hot_windows(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Maximal stretches of ``run`` covered by windows whose entropy is at least ``bits``."""
    term = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for at, char in enumerate(run):
        n = counts.get(char, 0)
        total += term[n + 1] - term[n]
        counts[char] = n + 1
        if at >= width:
            gone = run[at - width]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
        if at >= width - 1 and math.log2(width) - total / width >= bits - 1e-9:
            begin = at - width + 1
            if begin > end:  # apart from the stretch before
                if start >= 0:
                    yield start, end
                start = begin
            end = at + 1
    if start >= 0:
        yield start, end


class Scanner:
    """Spans (kind, start, end) of one text, in code points, end exclusive."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(re.compile(f"[{c.chars}]{{{c.width},}}"), c.width, c.bits) for c in classes]
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        lower = text.lower()
        found = []
        if any(word in lower for word in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def __call__(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and those that entropy adds outside them; each (start, kind, end)."""
        text = text or ""
        base, added = self.base(text), set()
        for pattern, width, bits in self.classes:
            for run in pattern.finditer(text):
                if self.allow.fullmatch(run.group()) or reads_like_words(run.group()):
                    continue
                at = run.start()
                for stop in [*COUNTING.finditer(run.group()), None]:
                    end = run.start() + stop.start() if stop else run.end()
                    added |= {(a + at, b + at) for a, b in hot_windows(text[at:end], width, bits)}
                    at = run.start() + stop.end() if stop else end
        # A stretch inside a base span, or inside another one of a wider class, is told once.
        outer = uncovered(sorted(added), [(s, e) for s, _, e in base])
        return base, [(a, 3, b) for a, b in outer]


def uncovered(spans: list[tuple[int, int]], covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in none of ``covers`` and in no other span; one sweep over the sorted ends."""
    out, reach = [], -1
    # By start, the widest first; at equal spans the cover comes first.
    for start, end, own in sorted([(s, -e, 1) for s, e in spans] + [(s, -e, 0) for s, e in covers]):
        if own and -end > reach:
            out.append((start, -end))
        reach = max(reach, -end)
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))


def secret_spans(text: Column, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Column:
    """Array of (kind, start, end) by start, then kind.  Null and empty texts hold none.

    A narrow step: rows stay where they are and texts of any length are read
    whole, once, in time proportional to their length.
    """
    scan = Scanner(classes, allow)

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            base, added = scan(text)
            out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + added)])
        return pd.Series(out, dtype=object)

    return find(text)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every found span replaced by ``mark``; overlapping spans become one.

    Null texts stay null, empty ones empty; repeated rows are cleaned alike; a table
    without rows gives none, and all other columns stay as they are.
    """
    scan = Scanner()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([_cleaned(scan, text, mark) for text in texts], dtype=object)

    return df.withColumn(text_col, clean(F.col(text_col)))


def _cleaned(scan: Scanner, text: str | None, mark: str) -> str | None:
    if text is None:
        return None
    base, added = scan(text)
    parts, at = [], 0
    for start, _, end in sorted(base + added):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


@query("op7_entropy_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, as counts, a digest of the fixed patterns, and a list."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("found"))
    told_span = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return docs.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(base, told_span)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", told_span)).alias("spans"),
    )
