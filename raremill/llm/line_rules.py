"""Quality rules, line by line first (operator 3).

Each line with a word is judged on its own; failing lines are taken out, and a document is
rejected if the failing lines hold more than ``max_lost`` of its word characters. A document
that fails the base rules is rejected as well.

A line fails by the first rule that holds:
  punctuation: 5 words or more, and more than 15 % of its characters that are not white space are
    symbols, or runs of ! or ? end more than half of its words, or more than 70 % of its letters
    are capitals, or it has 60 words or more without any sentence mark;
  navigation: at least 3 separators such as | or > and at least one for every three words;
  boilerplate: it has 40 words or fewer and a known phrase of licences, cookies or footers;
  repeat: it equals an earlier line of the document.

Words are runs of characters other than space and \\t \\n \\v \\f \\r. Null and empty texts have no
words and fail the base rules. Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.tasks import map_rows

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|<>»›•·"
PHRASES = (
    "all rights reserved", "cookie", "copyright", "creative commons", "javascript", "licensed under",
    "is licensed", "log in", "privacy policy", "public license", "sign up", "subscribe", "terms of use",
)
RULES = ("punctuation", "navigation", "boilerplate", "repeat")
_MARKS = re.compile(r"[.,;:!?…。！？]")
_SHOUTED = re.compile(r"[!?]{2,}(?=\s|$)")
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = (
    f"doc_id long, {_COUNTS}, base_failed boolean, kept boolean, "
    + ", ".join(f"{r}_lines long" for r in RULES) + ", lost_chars long, cleaned string"
)


def words_in(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def char_count(text: str, chars: str) -> int:
    return sum(map(text.count, chars))


def word_chars(text: str) -> int:
    return len(text) - char_count(text, SPACES)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    own = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    pairs = np.unique(own[:-1] * len(codes) + own[1:], return_inverse=True)[1]
    grams = pairs[:-1] * len(codes) + own[2:]
    _, where, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = counts[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(hit) + k] |= hit
    return int(covered.sum())


def line_rule(line: str, seen: bool) -> int | None:
    """Number of the rule that the line fails by; None if it stays."""
    n = len(line.split())
    if n >= 5:
        chars = max(1, word_chars(line))
        letters = sum(map(str.isalpha, line))
        if (
            100 * char_count(line, SYMBOLS) > 15 * chars
            or 2 * len(_SHOUTED.findall(line)) > n
            or 10 * sum(map(str.isupper, line)) > 7 * letters
            or (n >= 60 and not _MARKS.search(line))
        ):
            return 0
    separators = char_count(line, SEPARATORS)
    if separators >= 3 and 3 * separators >= n:
        return 1
    low = line.lower() if n <= 40 else ""
    if low and any(p in low for p in PHRASES):
        return 2
    return 3 if seen else None


def judge(text: str, max_lost: float) -> list:
    words = words_in(text)
    total = word_chars(text)
    repeats = repeated_words(words)
    earlier: set[str] = set()
    kept_lines, by_rule, lost, dup = [], [0] * len(RULES), 0, 0
    for line in text.split("\n"):
        if not line.strip(SPACES):
            kept_lines.append(line)
            continue
        seen = line in earlier
        dup += seen
        earlier.add(line)
        rule = line_rule(line, seen)
        if rule is None:
            kept_lines.append(line)
        else:
            by_rule[rule] += 1
            lost += word_chars(line)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    kept = not failed and lost <= max_lost * total
    symbols = char_count(text, SYMBOLS)
    return [len(words), total, symbols, dup, repeats, failed, kept, *by_rule, lost, "\n".join(kept_lines)]


def line_quality(
    docs: DataFrame, max_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts, verdict and cleaned text of each document."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [judge(t or "", max_lost) for t in batch.column(1).to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * (len(RULES) + 1) + [pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, SCHEMA)
