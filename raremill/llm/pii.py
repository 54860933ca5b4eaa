"""Personal data and what gives it away (operator 9); DataFrame functions only.

Base spans come from four patterns: e-mail and IP addresses, card numbers and phone
numbers. Each value is a protected entity. Any term of a document with an entity may reveal it,
however far off it stands, as far as the corpus says so: with p the share of all documents,

    disclosure(term, entity) = log(p(both) / (p(term) p(entity))) / -log p(entity),

which is 0 for unrelated terms and 1 for a term met only with the entity. Terms are runs of
letters and digits outside the spans. Those that share at least ``support`` documents with the
entity, with a disclosure of ``threshold`` or more, become spans of kind "term" wherever they
stand in its documents, whatever the length of the text; equal disclosures are all kept, and of
several entities the greatest counts. An entity of fewer than ``support`` documents has no such
term: its one text cannot tell a name from any other rare word. In the sanitised text entities become their
kind, terms of at least ``removal`` go and the others are generalised to [NUMBER] or [WORD].

A document gives one row per entity and term, less those whose term is too common to reach
the threshold even if it stood in all documents of the entity. These are counted map-side, and
joined with the revealing pairs in ``SALTED`` rows a key at most (in expectation).

Positions are code points, end exclusive. They follow from the lengths of the matches and
of the pieces between them. Null and empty texts have no spans. Rows that repeat an id are
judged by their own text. Document frequencies count every row of the table; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raremill.llm.tasks import stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Rows of one entity and term that are joined under one key.
SALTED = 100_000
#: The same matches as the plain patterns: a run without a match is not tried from its middle,
#: and digits that are too few for a card are passed over. Groups are repeated possessively, as a
#: run that may be given back takes a frame of the task's stack for each of its parts.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WORD = r"[\p{L}\p{N}]++"


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, value) of all matches."""
    expr = F.lit(pattern)
    matches = F.regexp_extract_all(text, expr, F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["match"])
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    both = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    # the last piece has no match after it
    both = F.filter(both, lambda x: x["match"].isNotNull())
    return F.when(F.regexp_like(text, expr), F.aggregate(both, start, add)["out"]).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int") * (k % 2 + 1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Ordered array of (start, kind, end, value)."""
    ip = F.filter(
        _found(text, _IP, 1),
        lambda x: F.forall(F.split(x["value"], r"\."), lambda p: p.try_cast("double") <= 255),
    )
    card = F.filter(
        _found(text, _CARD, 2),
        lambda x: F.length(_digits(x["value"])).between(12, 19) & _luhn(_digits(x["value"])),
    )
    phone = F.filter(_found(text, _PHONE, 3), lambda x: F.length(_digits(x["value"])).between(9, 15))
    return F.sort_array(F.concat(_found(text, _EMAIL, 0), ip, card, phone))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"].cast("string"), F.lower(span["value"]))


def _free(text: Column, spans: Column) -> Column:
    """Array of (start, piece): the text between the spans."""
    cut = lambda a, b: F.array(F.struct(a.alias("start"), F.substring(text, a + 1, b - a).alias("piece")))
    empty = F.array().cast("array<struct<start:int,piece:string>>")

    def add(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] > acc["at"], F.concat(acc["out"], cut(acc["at"], s["start"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)
    return F.concat(done["out"], cut(done["at"], F.length(text)))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def _mentions(docs: DataFrame) -> DataFrame:
    """Rows numbered, with their spans, and the text if it has any."""
    rows = docs.withColumn("spans", base_spans(F.coalesce("text", F.lit(""))))
    # stored at once: the numbers are not drawn a second time
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "spans",
            F.when(F.size("spans") > 0, F.col("text")).alias("text"),
        ),
        "mentions",
    )


def _frequencies(docs: DataFrame) -> DataFrame:
    words = F.array_distinct(_words(F.col("text")))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _pairs(docs: DataFrame, mentions: DataFrame, n: float, support: int, threshold: float) -> DataFrame:
    """(row, entity, term, seen, df): entities and terms that share a row, with the number of
    rows of each. A term of more rows than the entity allows cannot reach the threshold."""
    named = mentions.select("row", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    entities = named.groupBy("entity").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= support)
    known = (
        named.join(stored(entities, "entities"), "entity")
        .groupBy("row").agg(F.collect_list(F.struct("entity", "seen")).alias("entities"))
    )
    # text of rows without such an entity is not read again
    words = F.array_distinct(F.flatten(F.transform(_free(F.col("text"), F.col("spans")), lambda p: _words(p["piece"]))))
    met = mentions.where(F.size("spans") > 0).join(known, "row").select("row", "entities", F.explode(words).alias("term"))
    terms = stored(_frequencies(docs).where(F.col("df") >= support), "terms")
    # joint <= seen, so the disclosure is at most log(n / df) / log(n / seen); a little slack for rounding
    most = lambda seen: n * F.pow(seen / n, F.lit(threshold)) * (1 + 1e-9)
    able = F.filter("entities", lambda e: F.col("df") <= most(e["seen"]))
    met = met.join(terms, "term").select("row", "term", "df", F.explode(able).alias("e"))
    return stored(met.select("row", "e.entity", "term", "e.seen", "df"), "pairs")


def _revealing(pairs: DataFrame, n: float, support: int, threshold: float) -> DataFrame:
    """(entity, term, seen, df, disclosure) of the pairs over the threshold."""
    both = pairs.groupBy("entity", "term", "seen", "df").agg(F.count(F.lit(1)).alias("both"))
    # a word that the whole text has in another cut is met more often than counted
    joint = F.least("both", "df").cast("double")
    information = -F.log(F.col("seen") / n)
    pmi = F.log(joint * n / (F.col("df") * F.col("seen")))
    return (
        both.where(F.col("both") >= support)
        .withColumn("disclosure", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)))
        .where(F.col("disclosure") >= threshold)
        .drop("both")
    )


def _placed(mentions: DataFrame, marks: DataFrame) -> DataFrame:
    """(row, terms): every place of the marked terms outside the spans."""
    rows = mentions.where(F.size("spans") > 0).join(marks.select("row").distinct(), "row", "left_semi")
    pieces = rows.select("row", F.explode(_free(F.col("text"), F.col("spans"))).alias("p")).select("row", "p.start", "p.piece")
    # a word with what stands before it; places follow as running totals, in linear time
    found = F.regexp_extract_all("piece", F.lit(_WORD), F.lit(0))
    both = F.arrays_zip(F.split("piece", _WORD, -1).alias("gap"), found.alias("word"))
    words = pieces.select("row", "start", F.posexplode(both).alias("at", "x")).where("x.word is not null")
    order = Window.partitionBy("row", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    words = words.select(
        "row", F.lower("x.word").alias("term"), F.length("x.word").alias("long"),
        (F.col("start") + F.sum(F.length("x.gap") + F.length("x.word")).over(order)).cast("int").alias("end"),
    )
    place = F.struct((F.col("end") - F.col("long")).alias("start"), "end", "disclosure")
    return words.join(marks, ["row", "term"]).groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("terms"))


def disclosures(docs: DataFrame, support: int = 2, threshold: float = 0.5) -> DataFrame:
    """One row for each of ``docs``: doc_id, spans, terms (start, end, disclosure) and the
    text where it has spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mentions = _mentions(docs)
    n = float(max(mentions.count(), 1))
    pairs = _pairs(docs, mentions, n, support, threshold)
    # a pair has at most as many rows as its entity and its term, known on both sides of the join
    parts = F.ceil(F.least("seen", "df") / SALTED).cast("int")
    revealing = stored(_revealing(pairs, n, support, threshold), "revealing")
    revealing = revealing.select("entity", "term", "disclosure", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    marks = (
        pairs.withColumn("salt", F.pmod(F.xxhash64("row"), parts).cast("int")).join(revealing, ["entity", "term", "salt"])
        .groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    )
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    return mentions.join(_placed(mentions, stored(marks, "marks")), "row", "left").select(
        "doc_id", "spans", F.coalesce("terms", none).alias("terms"), "text"
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def every_span() -> Column:
    """Base spans and terms in order, with a value only for the base spans."""
    terms = F.transform(
        "terms",
        lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end"), t["disclosure"].cast("string").alias("value")),
    )
    return F.sort_array(F.concat("spans", terms))


def digests(found: DataFrame) -> DataFrame:
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS[:4])
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(every_span()).alias("spans")
    )


def sanitised(found: DataFrame, removal: float = 0.8) -> DataFrame:
    """doc_id and the sanitised text of the rows that have spans."""
    text = F.col("text")
    # of spans that overlap only the first is replaced
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4]))

    def add(acc: Column, s: Column) -> Column:
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        term = F.when(s["value"].try_cast("double") >= removal, "").when(F.regexp_like(own, F.lit("^[0-9]+$")), "[NUMBER]").otherwise("[WORD]")
        label = F.when(s["kind"] == 4, term).otherwise(F.get(labels, s["kind"]))
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        after = F.struct(s["end"].alias("at"), F.concat(acc["out"], between, label).alias("out"))
        return F.when(s["start"] >= acc["at"], after).otherwise(acc)

    done = F.aggregate(every_span(), start, add)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return found.where(text.isNotNull()).select("doc_id", F.concat(done["out"], rest).alias("text"))
