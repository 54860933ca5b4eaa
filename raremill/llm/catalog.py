"""The operators' named queries, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremill.llm import (
    chat, decontaminate, line_rules, main_text, mixing, near_dedup, passages, pii, secrets, spelling, token_files, toxicity,
    whitening,
)
from raremill.llm.tasks import new_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query()
def op2_token_files(spark, folder):
    """All documents as token ids in ORC files, read back as offsets and checksums."""
    path = new_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, folder), path)
    return token_files.read_digests(spark, path)


CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, regexp_extract_all(t,
      '<s>|<\|turn\|>|<\|text\|>|<\|end\|>|</s>|\[INST\]|\[/INST\]|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>') as found,
    len(t) - len(replace(t, '\', '')) as slashes
  from (select *, role || text as t from turns)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (7 + sum(len(t) + len(found) + slashes + 23))::bigint as formatted_chars
from sized group by conv_id
"""


@query(CHAT_SQL)
def op10_chat_tokens(spark, folder):
    """All conversations and one made of control strings, formatted, stored and read back."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)],
        "conv_id long, turn long, role string, text string",
    )
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select(*extra.columns)
    return chat.read_chats(stored(chat.format_chats(turns.unionByName(extra)), "chats"))


@query()
def op3_line_quality(spark, folder):
    """Word counts, base rules and the line rules' verdict for all documents."""
    judged = line_rules.line_quality(documents(spark, folder))
    return judged.drop("cleaned")


@query()
def op5_benchmark_leaks(spark, folder):
    """Every place in all documents that holds a benchmark item within a fifth of its words."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, folder), benchmark)


def held_out(doc_id):
    """Rows that no label may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def known_labels(labels):
    return labels.where(~held_out(F.col("doc_id")))


def toxicity_model(docs, labels):
    return toxicity.train(docs, known_labels(labels))


@query()
def op7_toxicity(spark, folder):
    """Toxicity of all documents by their nearest labelled examples."""
    docs = documents(spark, folder)
    found = toxicity.train_and_score(docs, known_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op8_secrets(spark, folder):
    """Secrets of all documents: base patterns and the network's additions."""
    docs = documents(spark, folder)
    return secrets.scan(docs, secrets.train(docs)).drop("model_scores")


NEAR_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when w is null or len(w) = 0 then []
    when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words
), items as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (
  select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as k
  from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select u, v from common where 100 * k >= 85 * (nu + nv - k)
  union all select v, u from common where 100 * k >= 85 * (nu + nv - k)
), reach as (
  select doc_id, doc_id as low from documents
  union select v, low from reach join links on u = doc_id
), lowest as (select doc_id, min(low) as component_id from reach group by doc_id)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept
from sets join lowest using (doc_id)
"""


@query(NEAR_SQL)
def op6_near_duplicates(spark, folder):
    """Components of near-duplicates over all documents."""
    return near_dedup.near_duplicates(documents(spark, folder))


MIX_TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
MIX_RATE = 0.7

MIX_SQL = r"""
with recursive counted as (
  select *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens from documents
), docs as (
  select doc_id, text, n_tokens, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
    case when n_tokens = 0 then 'empty' when contains(text, 'icens') then 'licence'
      when contains(text, ' | ') then 'table' when contains(text, '@') then 'contact'
      when contains(text, '=') then 'assignment' when n_tokens < 100 then 'short'
      when n_tokens < 1000 then 'medium' else 'long' end as topic
  from counted
), cells as (
  select source, lang, topic, sum(n_tokens)::double as t from docs group by all
), s as (select source, pow(sum(t), 0.5) as w from cells group by 1 having sum(t) > 0),
l as (select lang, pow(sum(t), 0.7) as w from cells group by 1 having sum(t) > 0),
p as (select topic, pow(sum(t), 0.8) as w from cells group by 1 having sum(t) > 0),
rounds as (
  select 0 as k, c.*, c.t as w, coalesce(s.w / (select sum(w) from s), 0) as gs,
    coalesce(l.w / (select sum(w) from l), 0) as gl, coalesce(p.w / (select sum(w) from p), 0) as gp
  from cells c left join s using (source) left join l using (lang) left join p using (topic)
  union all
  select k + 1, source, lang, topic, t,
    case when w > 0 then w * gp / sum(w) over (partition by topic) else 0 end, gs, gl, gp
  from (select k, source, lang, topic, t,
      case when w > 0 then w * gl / sum(w) over (partition by lang) else 0 end as w, gs, gl, gp
    from (select k, source, lang, topic, t,
        case when w > 0 then w * gs / sum(w) over (partition by source) else 0 end as w, gs, gl, gp
      from rounds where k < 200))
), raked as (select *, case when t > 0 then w / t else 0 end as r from rounds where k = 200),
ordered as (
  select *, coalesce(sum(t) over (order by r desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) as held,
    sum(w) over (order by r desc, source, lang, topic rows between current row and unbounded following) as free
  from raked
), scale as (
  select coalesce(max(case when (0.7 * (select sum(t) from raked) - held) / free * r < 1
    then (0.7 * (select sum(t) from raked) - held) / free end), 1e300) as x
  from ordered where r > 0
), chances as (
  select source, lang, topic, case when t = 0 then 1.0 else least(1.0, r * x) end as pr from raked, scale
)
select doc_id, source, lang, topic, n_tokens, round(pr, 4) as probability,
  ('0x' || substr(md5('mixing:7:' || doc_id), 1, 8))::bigint / 4294967296.0 < pr as kept
from docs join chances using (source, lang, topic)
"""


@query(MIX_SQL)
def op1_mixture(spark, folder):
    """All documents with their chance in the mixture and whether they are drawn."""
    found = mixing.drawn(documents(spark, folder), MIX_TARGETS, MIX_RATE)
    return found.select(
        "doc_id", "_mix.source", "_mix.lang", "_mix.topic", F.col("_mix.tokens").alias("n_tokens"),
        F.round("_mix.probability", 4).alias("probability"), "_mix.kept",
    )


@query()
def op9_disclosures(spark, folder):
    """Personal data of all documents and the terms that reveal it."""
    return pii.digests(pii.disclosures(documents(spark, folder)))


@query()
def op4_passages(spark, folder):
    """Passages of 50 words or more that documents share, exactly or nearly."""
    return passages.passages(documents(spark, folder))


@query()
def op11_main_text(spark, folder):
    """The main text of all pages."""
    return main_text.main_texts(spark.read.parquet(f"{folder}/pages.parquet"))


@query()
def op12_whitening(spark, folder):
    """The leading components of all embeddings, whitened."""
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _crc_steps() -> str:
    """The checksum's remainders for the sixteen halves of a byte."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return str(out)


SPELLING_SQL = rf"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')) as run
  from documents
), per as (select id, run, count(*) as k, hex(encode(id || ':' || run)) as x from runs group by id, run
), summed as (
  select run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(0, len(x)),
      lambda i: (strpos('0123456789ABCDEF', x[(i + 1 - 2 * (i % 2) + 1)::int]) - 1)::bigint)),
    lambda c, d: xor(c >> 4, ({_crc_steps()}::bigint[])[(xor(c, d) & 15) + 1]))) as h
  from per
), words as (
  select word, sum(k)::bigint as n from (
    select k, case when h % 199 = 0 then substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) else run end as word
    from summed) group by word having len(word) >= 6 and sum(k) >= 5
), cuts as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as cut from words, range(0, 60) r(i) where i < len(word)
), near as (
  select distinct a.word, b.word as near, b.n as m from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.cut = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.cut = b.word
), best as (
  select word, count(*) as n_near, arg_min(near, (-m, near)) as near, max(m) as m from near group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 5 * w.n then near end as form,
    case when m >= 5 * w.n then m end as form_n
  from words w left join best b on w.word = b.word
), walk as (
  select word, word as root, form as next from formed
  union all select walk.word, walk.next, f.form from walk join formed f on f.word = walk.next
)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n from formed f join walk w on w.word = f.word and w.next is null
"""


@query(SPELLING_SQL)
def op13_spelling(spark, folder):
    """Spelling variants among the words of all documents."""
    return spelling.variants(documents(spark, folder))
