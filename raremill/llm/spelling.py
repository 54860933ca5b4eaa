"""Grouping of spelling variants (operator 13).

Words are counted over all texts. Near words, one inserted, deleted or replaced code point
apart, are searched by letter counts: a replacement moves two counts by one, an insertion one,
so squared distances of at most two hold every near pair. The letters are dealt into a few
groups of like frequency; the counts of the groups place a word in a cell, and near words lie in
one cell or in two whose counts differ by one letter moved or added. Cells of one length and the
next are cut into blocks of about ``block_words`` words, blocks of such cells meet, and a NumPy
product of their letter-count matrices gives all squared distances at once. The edit itself is
then verified on the letters. No pair is lost for any number of groups or size of block, and a
cell of any size is spread over as many blocks as it needs.

A word's form is its commonest near word (ties: the least in code-point order) if that is
``ratio`` times as common; the root is the end of the forms, found by doubling steps.

Null and empty texts have no words. A null id counts as an empty one; repeated rows count each.
Long texts are words like others. An empty table has no words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.tasks import map_rows, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RANGES = (("a", "z"), ("À", "ÿ"))
_LETTERS = "".join(chr(c) for a, b in _RANGES for c in range(ord(a), ord(b) + 1))
_RUN = "[A-Za-zÀ-ÿ]"


# --- words ------------------------------------------------------------------


def words(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, slip: int = 199, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; where ``slip`` divides the checksum of id
    and run, the run lacks one letter."""
    low = F.translate(F.col(text_col), _UPPER, _LOWER)
    # shorter runs cannot become words
    runs = F.regexp_extract_all(low, F.lit(f"({_RUN}{{{min_length},}})"), 1)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % slip == 0, cut).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).where(F.length("word") >= min_length)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# --- cells and blocks ---------------------------------------------------------


def letter_groups(known: DataFrame, groups: int) -> list[str]:
    """The letters in ``groups`` parts of like frequency in the words."""
    per_letter = [F.sum(F.length("word") - F.length(F.translate("word", c, ""))).alias(f"c{k}") for k, c in enumerate(_LETTERS)]
    row = known.agg(*per_letter).first()
    load, parts = [0] * groups, [""] * groups
    for k in sorted(range(len(_LETTERS)), key=lambda k: (-(row[k] or 0), k)):
        g = load.index(min(load))
        load[g] += row[k] or 0
        parts[g] += _LETTERS[k]
    return parts


def groups_for(n_words: int) -> int:
    """More groups for more words, so that cells stay small; exact for any number."""
    return max(3, min(16, n_words.bit_length() - 13))


def blocks(known: DataFrame, parts: list[str], block_words: int) -> DataFrame:
    """(cell, part, members): words with equal counts of the letter groups, in blocks."""
    counts = [F.length(F.regexp_replace("word", f"[^{part}]", "")) for part in parts]
    placed = known.select("word", "n", F.array(*counts).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    cut = (F.col("size") / block_words).cast("long") + 1
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), cut).cast("int"))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("members"))


def _meeting_cells(cell: list[int]) -> Iterator[tuple[int, ...]]:
    """The cell itself, those with one letter more, and of two cells that differ by a letter
    moved from one group to another the one with the earlier group raised."""
    yield tuple(cell)
    for a in range(len(cell)):
        more = list(cell)
        more[a] += 1
        yield tuple(more)
        for b in range(a + 1, len(cell)):
            if cell[b]:
                moved = list(more)
                moved[b] -= 1
                yield tuple(moved)


def _sent(own: DataFrame) -> DataFrame:
    """Each block once for every cell that it meets."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, targets = [], []
            for k, cell in enumerate(batch.column(0).to_pylist()):
                for target in _meeting_cells(cell):
                    rows.append(k)
                    targets.append(list(target))
            sent = batch.take(pa.array(rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(targets, pa.list_(pa.int32())), *sent.columns], ["target", "cell", "part", "members"]
            )

        return step

    schema = "target array<int>, cell array<int>, part int, members array<struct<word:string,n:long>>"
    return map_rows(own.select("cell", "part", "members"), make, schema, rows=64)


# --- near words of two blocks ---------------------------------------------------

_PLACE = np.zeros(256, np.int64)
_PLACE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))


def _matrix(found: list[str]) -> np.ndarray:
    """Letters as bytes; words of one length."""
    return np.frombuffer("".join(found).encode("latin-1"), np.uint8).reshape(len(found), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    out = np.zeros((len(letters), len(_LETTERS)), np.float32)
    rows = np.arange(len(letters))
    for column in _PLACE[letters].T:
        out[rows, column] += 1
    return out


def near_pairs(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (of one length each, ``b`` equal or one longer) of words that are one
    edit apart; with ``same`` the lists are equal and each pair comes once."""
    left, right = _matrix(a), _matrix(b)
    x, y = letter_counts(left), letter_counts(right)
    gram = x @ y.T
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * gram
    i, j = np.nonzero(square <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    p, q, n = left[i], right[j], left.shape[1]
    if right.shape[1] == n:
        good = (p != q).sum(axis=1) == 1
    else:
        ahead = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(axis=1)
        behind = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        good = ahead + behind >= n
    return i[good], j[good]


def near_words(known: DataFrame, block_words: int = 1024) -> DataFrame:
    """(word, near, near_n), in both directions, of all words one edit apart."""
    groups = groups_for(known.count())
    own = stored(blocks(known, letter_groups(known, groups), block_words), "word_blocks")
    there = own.select(F.col("cell").alias("target"), F.col("part").alias("other"), F.col("members").alias("others"))
    met = _sent(own).join(there, "target")
    met = met.where((F.col("cell") != F.col("target")) | (F.col("part") <= F.col("other")))
    met = met.select(
        "members", "others", ((F.col("cell") == F.col("target")) & (F.col("part") == F.col("other"))).alias("same")
    )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sides = []
            for c in (0, 1):
                column = batch.column(c)
                members = column.flatten()
                ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
                sides.append((members.field("word").to_pylist(), members.field("n").to_numpy(), ends))
            (wa, na, ea), (wb, nb, eb) = sides
            words_out, near_out, counts = [], [], []
            for k, same in enumerate(batch.column(2).to_pylist()):
                a, b = wa[ea[k] : ea[k + 1]], wb[eb[k] : eb[k + 1]]
                i, j = near_pairs(a, b, same)
                left, right = [a[x] for x in i], [b[x] for x in j]
                words_out += left + right
                near_out += right + left
                counts += [nb[eb[k] + j], na[ea[k] + i]]
            numbers = np.concatenate(counts) if counts else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(words_out, pa.string()), pa.array(near_out, pa.string()), pa.array(numbers, pa.int64())],
                ["word", "near", "near_n"],
            )

        return step

    return map_rows(met, make, "word string, near string, near_n long", rows=64)


# --- forms and roots ------------------------------------------------------------


def _rounds(longest: int, least: int, ratio: int) -> int:
    """Doublings that reach the end of forms whose counts grow by ``ratio`` each."""
    steps = 0
    while least * ratio ** (steps + 1) <= longest:
        steps += 1
    return max(0, steps - 1).bit_length()


def variants(
    docs: DataFrame,
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    slip: int = 199,
    block_words: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per word: its count, near words, form and root."""
    known = stored(words(docs, min_length, min_count, slip, id_col, text_col), "words")
    near = near_words(known, block_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    best, common = F.col("best.near"), -F.col("best.less")
    formed = common >= ratio * F.col("n")
    found = stored(
        known.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, best).alias("form"), F.when(formed, common).alias("form_n"),
        ),
        "forms",
    )
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    top = found.agg(F.max("form_n")).first()[0]
    for _ in range(_rounds(top, min_count, ratio) if top else 0):
        roots = stored(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
