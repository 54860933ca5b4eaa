"""Near-duplicates by bottom-k sketches (operator 6).

Documents are linked by a ``Rule``: the words of a shingle and the least share of equal shingles. One
hash function orders all shingles; a document's sketch is its ``SKETCH`` least
hash values. Documents with equal sets form one class first. Inverted lists of the
``RETAINED`` least values then propose pairs of classes, the sketch of the union estimates
their similarity, and the full sets decide.

Documents are linked in three rounds, each of which looks only at different components of
the links found before. First each member is compared with two leaders of its list (the
least id and the least hash). Then lists of up to ``LIST`` members are compared in full. A
document enters them by its shortest lists only: a partner shares ``Rule.shared`` values,
so two partners meet without the longest ``Rule.shared - 1`` lists of either. Last come
the documents with ``Rule.shared`` values in longer lists (a common passage or template).
Their full sets are joined exactly: shingles are ordered from rare to common among them, and
two linked sets share one of the first few of each; lists of these are compared block by
block. A bitmap of the retained values, sizes and positions rule pairs out before they are
made, and only pairs that cannot be linked.

Of two documents with similarity 0.85 about 27 of 32 retained values agree, of two with 0.8 about
26; fewer than ``Rule.shared`` do with a chance of about one in a thousand million.

Words are lower-cased (A-Z only) runs of characters other than space and \\t \\n \\v \\f \\r. A
text of fewer words than a shingle has them as its only one; null, empty and blank texts have no
shingles and no partner. A row with a null id takes no part and is kept. Rows that repeat an
id are judged by their own text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raremill.llm.graph import components
from raremill.llm.tasks import int_lists, map_rows, stored

SKETCH = 64
RETAINED = 32
LIST = 64
#: Members of a block of a long list of whole sets.
BLOCK = 1024


@dataclass(frozen=True)
class Rule:
    """Which documents are linked: those with ``percent`` of their shingles of ``words`` words in common. Two that are share
    ``shared`` retained values and ``estimate`` of their union sketch but for a chance of about one
    in a thousand million and one in a hundred million."""

    words: int = 3
    percent: int = 85
    shared: int = 13
    estimate: float = 0.55


#: For texts where nothing else is asked for: five words, a similarity of 0.8.
USUAL = Rule(words=5, percent=80, shared=10, estimate=0.48)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the document's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7) >> 1], np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    x = h[: len(h) - width + 1] * _A
    for k in range(1, width):
        x = (x ^ (x >> np.uint64(31))) * _B + h[k : len(h) - width + 1 + k] * _C
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unique((x >> np.uint64(1)).astype(np.int64))


def _bitmap(retained: np.ndarray) -> tuple[int, int]:
    """Two words of 64 bits, in which each value sets one of 128 bits."""
    bit, half = np.int64(1) << (retained & 63), (retained >> 6) & 1
    return tuple(int(np.bitwise_or.reduce(bit[half == k], initial=0)) for k in (0, 1))


def _sets(docs: DataFrame, whole: bool, rule: Rule, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, digest, bitmap, least values or the whole set) of each row, and the long columns of ``keep``."""
    width = rule.words

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            cut = sets if whole else [s[:SKETCH] for s in sets]
            flat = np.concatenate([np.empty(0, np.int64), *cut])
            maps = [_bitmap(s[:RETAINED]) for s in sets]
            arrays = [
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.md5(s.tobytes()).digest() for s in sets]),
                *(pa.array([m[k] for m in maps], pa.int64()) for k in (0, 1)),
                int_lists(flat, [len(s) for s in cut], pa.int64()),
                *batch.columns[2:],
            ]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "digest", "low", "high", "values", *keep])

        return step

    schema = "doc_id long, n long, digest binary, low long, high long, values array<long>"
    return map_rows(docs.select("doc_id", "text", *keep), make, ", ".join([schema, *[f"{c} long" for c in keep]]))


def _node() -> Column:
    return F.struct("doc_id", "digest", "n", "low", "high")


def _least(node: Column, rule: Rule) -> Column:
    """Retained values that a class shares with a partner; a set smaller than the sketch may
    share all it has and still be below the number."""
    return F.least(F.lit(rule.shared), F.ceil(node["n"] * 0.4))


def _possible(u: Column, v: Column, rule: Rule) -> Column:
    """Whether sizes and bitmaps allow a link: a bit that only one has is a value that the
    other lacks."""

    def lacking(a, b):
        return sum(F.bit_count(a[k].bitwiseAND(F.bitwise_not(b[k]))) for k in ("low", "high"))

    most = F.greatest(_least(u, rule), _least(v, rule))
    sizes = 100 * F.least(u["n"], v["n"]) >= rule.percent * F.greatest(u["n"], v["n"])
    return sizes & (lacking(u, v) + most <= F.least(F.lit(RETAINED), u["n"])) & (
        lacking(v, u) + most <= F.least(F.lit(RETAINED), v["n"])
    )


def _shared(classes: DataFrame, rule: Rule) -> DataFrame:
    """Classes with at least ``Rule.shared`` retained values that another has too, and
    those values with the length and leaders of their lists, shortest first."""
    entries = classes.select("node", F.explode(F.slice("values", 1, RETAINED)).alias("value"))
    lists = stored(
        entries.groupBy("value")
        .agg(
            F.count(F.lit(1)).alias("length"), F.min("node").alias("first"),
            F.min(F.struct(F.xxhash64("node.digest"), F.col("node"))).alias("second"),
        )
        .where("length > 1")
        .select("value", "length", "first", F.col("second.node").alias("second")),
        "lists",
    )
    met = entries.join(lists, "value").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("length", "value", "first", "second"))).alias("lists")
    )
    return stored(met.where(F.size("lists") >= _least(F.col("node"), rule)), "shared")


def _estimated(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (u, v) whose sketches allow a link."""
    share = rule.estimate

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for a, b in zip(left, right, strict=True):
                sa, sb = set(a), set(b)
                # a value beyond the shorter of two full sketches is unknown to one of them
                bound = min(a[-1] if len(a) == SKETCH else 1 << 63, b[-1] if len(b) == SKETCH else 1 << 63)
                union = sorted(x for x in sa | sb if x <= bound)[:SKETCH]
                same = sum(x in sa and x in sb for x in union)
                keep.append(same >= share * len(union))
            return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        return step

    pairs = stored(pairs, "pairs")
    own = classes.select(F.col("node").alias("u"), F.col("values").alias("xu"))
    other = classes.select(F.col("node").alias("v"), F.col("values").alias("xv"))
    sized = pairs.join(own, "u").join(other, "v").select("u", "v", "xu", "xv")
    kind = dict(pairs.dtypes)["u"]
    return stored(map_rows(sized, make, f"u {kind}, v {kind}"), "estimated")


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of ``pairs`` whose full sets are linked."""
    percent = rule.percent

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        return step

    ends = pairs.select("u").union(pairs.select("v"))
    ids = stored(ends.select("u.doc_id").distinct(), "ends")
    wanted = docs.join(ids, "doc_id", "left_semi")
    sets = _sets(wanted, True, rule).select(_node().alias("node"), F.col("values").alias("set"))
    # the row of an id that is repeated with another text is no end; its digest tells
    sets = stored(sets.dropDuplicates(["node"]), "sets")
    own = sets.select(F.col("node").alias("u"), F.col("set").alias("xu"))
    other = sets.select(F.col("node").alias("v"), F.col("set").alias("xv"))
    full = pairs.join(own, "u").join(other, "v").select("u", "v", "xu", "xv")
    kind = dict(pairs.dtypes)["u"]
    return map_rows(full, make, f"u {kind}, v {kind}")


def _first_round(shared: DataFrame, rule: Rule) -> DataFrame:
    """Each class with the leaders of its lists."""
    leaders = F.flatten(F.transform("lists", lambda x: F.array(x["first"], x["second"])))
    pairs = shared.select(F.col("node").alias("a"), F.explode(F.array_distinct(leaders)).alias("b"))
    pairs = pairs.where((F.col("a") != F.col("b")) & _possible(F.col("a"), F.col("b"), rule))
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with the label of their component, which is the node itself if it has no link."""
    known = labels.select("node", F.col("label").alias("_found"))
    return nodes.join(known, "node", "left").withColumn("label", F.coalesce("_found", "node")).drop("_found")


def _mixed(entries: DataFrame, *more: Column) -> DataFrame:
    """Values whose entries belong to several components."""
    found = entries.groupBy("value").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), *more)
    return found.where("_low != _high").drop("_low", "_high")


def _second_round(shared: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components in lists of up to ``LIST`` members."""
    first = F.slice("lists", F.lit(1), (F.size("lists") - _least(F.col("node"), rule) + 1).cast("int"))
    short = F.transform(F.filter(first, lambda x: x["length"] <= LIST), lambda x: x["value"])
    entries = _labelled(shared.select("node", short.alias("short")).where("size(short) > 0"), labels)
    entries = entries.select("node", "label", F.explode("short").alias("value"))
    lists = entries.groupBy("value").agg(
        F.sort_array(F.collect_list(F.struct("node", "label"))).alias("m"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).where("low != high").select("m")
    pairs = lists.select(F.posexplode("m").alias("k", "a"), "m").select(
        "a", F.explode(F.slice("m", F.col("k") + 2, LIST)).alias("b")
    ).where((F.col("a.label") != F.col("b.label")) & _possible(F.col("a.node"), F.col("b.node"), rule))
    return pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def _third_round(shared: DataFrame, labels: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components that may share no value in a list of up to ``LIST``
    members: each has ``Rule.shared`` values in longer lists of several components."""
    p, q = rule.percent, 100 + rule.percent
    long = F.transform(F.filter("lists", lambda x: x["length"] > LIST), lambda x: x["value"])
    crowded = shared.select("node", long.alias("long")).where(F.size("long") >= _least(F.col("node"), rule))
    entries = _labelled(crowded, labels).select("node", "label", F.explode("long").alias("value"))
    entries = stored(entries, "crowded")
    met = entries.join(_mixed(entries), "value").groupBy("node", "label").agg(F.count(F.lit(1)).alias("long"))
    rest = stored(met.where(F.col("long") >= _least(F.col("node"), rule)).select("node", "label"), "rest")
    ids = rest.select("node.doc_id").distinct()
    sets = _sets(docs.join(ids, "doc_id", "left_semi"), True, rule).select(_node().alias("node"), "values")
    sets = stored(sets.dropDuplicates(["node"]).join(rest, "node"), "sets")
    values = sets.select("node", "label", F.explode("values").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    ordered = values.join(common, "value").groupBy("node", "label").agg(
        F.sort_array(F.collect_list(F.struct("times", "value"))).alias("values")
    )
    # a linked set has p of the larger and p / (1 + p) of both sizes in common with its partner
    ahead = F.expr(f"slice(values, 1, cast(node.n - ({p} * node.n + 99) div 100 + 1 as int))")
    entries = ordered.select("node", "label", F.posexplode(ahead).alias("at", "x")).where("x.times > 1")
    entries = stored(entries.select(
        F.col("x.value").alias("value"), "node", "label", "at",
        F.expr(f"at <= node.n - ({2 * p} * node.n + {q - 1}) div {q}").alias("least"),
    ), "ahead")
    blocks = [F.ceil(F.count(x) / BLOCK).cast("int").alias(f"_{k}") for k, x in (("s", F.when(F.col("least"), 1)), ("l", F.lit(1)))]
    lists = stored(_mixed(entries, *blocks).where("_s > 0"), "values")
    met = entries.join(lists, "value")

    def dealt(rows, name, own, other):
        # each member is in one block of its side and meets all blocks of the other
        block = F.pmod(F.xxhash64("node.digest", "node.doc_id"), F.col(own)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return rows.select("value", block, every, F.struct("node", "label", "at").alias(name))

    small, large = dealt(met.where("least"), "s", "_s", "_l"), dealt(met, "l", "_l", "_s")
    pairs = small.join(large, ["value", "_s", "_l"]).where(
        F.expr(
            "s.label != l.label and (s.node.n < l.node.n or s.node.n = l.node.n and s.node < l.node)"
            f" and {q} * least(s.node.n - s.at, l.node.n - l.at) >= {p} * (s.node.n + l.node.n)"
        )
        & _possible(F.col("s.node"), F.col("l.node"), rule)
    )
    u, v = F.col("s.node"), F.col("l.node")
    return stored(pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "pairs")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row, and the long columns of ``keep``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    sketches = stored(_sets(rows, False, rule, keep), "sketches")
    named = sketches.where("doc_id is not null and n > 0")
    # equal sets have equal sketches: the class is named by its least id
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "low", "high", "values")).alias("r"))
    classes = stored(
        classes.select("digest", "r.*").select(_node().alias("node"), "values"), "classes"
    )
    shared = _shared(classes, rule)
    edges = stored(_verified(_estimated(_first_round(shared, rule), classes, rule), rows, rule), "links")
    labels = components(edges)
    more = stored(_verified(_estimated(_second_round(shared, labels, rule), classes, rule), rows, rule), "links")
    if more.head(1):
        edges = edges.unionByName(more)
        labels = components(edges)
    rest = stored(_verified(_third_round(shared, labels, rows, rule), rows, rule), "links")
    if rest.head(1):
        labels = components(edges.unionByName(rest))
    labelled = classes.select("node").join(labels, "node", "left")
    components_of = stored(
        labelled.select(F.col("node.digest").alias("digest"), F.coalesce("label", "node")["doc_id"].alias("component")),
        "components",
    )
    found = sketches.join(components_of, "digest", "left")
    own = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *keep,
    )


def one_of_each(docs: DataFrame, rule: Rule = USUAL) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; all columns stay. Rows are judged by id
    and text: where an id is repeated with another text, that row is judged by its own, and of rows that
    repeat both one stays. Rows without an id or without words all stay."""
    text = [F.xxhash64("text").alias("_t1"), F.xxhash64("text", F.lit(1)).alias("_t2")]
    marked = docs.select("*", *text)
    key = ["doc_id", "_t1", "_t2"]
    judged = near_duplicates(marked, rule=rule, keep=("_t1", "_t2"))
    judged = judged.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(
        F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")
    )
    judged = stored(judged.where("not kept or n > 1"), "judged")
    same = F.lit(True)
    gone, again = judged.where("not kept"), judged.where("kept")
    for c in key:
        same = same & (marked[c] == F.col(f"_own{c}"))
    named = lambda df: df.select(*[F.col(c).alias(f"_own{c}") for c in key])
    left = marked.join(named(gone), same, "left_anti")
    if again.head(1):
        once = left.join(named(again), same, "left_semi").dropDuplicates(key)
        left = left.join(named(again), same, "left_anti").unionByName(once)
    return left.select(*docs.columns)
