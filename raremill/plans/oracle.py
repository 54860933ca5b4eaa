"""The same queries as plain SQL for an independent engine (DuckDB dialect).

They restate what each query means, by brute force where that is simplest, and
share nothing with the Spark plans but the fixed hash texts.
"""

from __future__ import annotations

_NAMES = [f"V{i}" for i in range(1, 29)] + ["Amount"]
FEATURES = ", ".join(f'"{n}"' for n in _NAMES)

_TXN = (
    'txn as (select event_id as "ID", '
    'cast(epoch(date_trunc(\'second\', ts))::bigint % 86400 as int) as "NumericSecondDay", '
    "e.embedding[1]::double + (case when event_type = 'error' then 1.0::double else 0.0::double end) "
    'as "V1", '
    + ", ".join(f'e.embedding[{i}]::double as "V{i}"' for i in range(2, 29))
    + ', value as "Amount", (event_type = \'error\' and value > 150)::int as "Class", event_type, ts '
    "from (select ev.*, event_id % n as vid from events ev "
    "cross join (select count(*) as n from embeddings) z) t join embeddings e on vid = e.vec_id)"
)


def _with(body: str, *ctes: str) -> str:
    return "with " + ", ".join(ctes) + " " + body


def txn(body: str, *ctes: str) -> str:
    """``body`` over the transaction view (``select *`` means its 32 columns)."""
    body = body.replace("select * from txn", f'select "ID", "NumericSecondDay", {FEATURES}, "Class" from txn')
    return _with(body, _TXN, *ctes)


def _bits(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint)"


def _uniform(text: str) -> str:
    return f"({_bits(text)} / 4294967296.0::double)"


def _uuid(text: str) -> str:
    h = f"md5({text})"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
        f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"
    )


_TEXT = "concat_ws(',', " + ", ".join(f'"{n}"::varchar' for n in _NAMES) + ")"

SCAN_TEXT_MINORITY = txn(
    "select id, f[1]::double as label, "
    + ", ".join(f"f[{i + 1}]::double as f{i}" for i in range(1, 6))
    + " from lines where f[1]::double = 1.0",
    f"""lines as (select "ID" as id, string_split("Class"::varchar || ',' || {_TEXT}, ',') as f from txn)""",
)

SCAN_DF_MINORITY = txn(
    'select "ID" as id, "Class"::double as label, '
    + ", ".join(f'"V{i}" as f{i}' for i in range(1, 8))
    + ' from txn where "Class" = 1'
)

_PAD = "case when event_type = 'view' then ' ' else '' end"
_DIRTY_FIELDS = (
    ["case when event_type = 'click' then 'n/a' else \"ID\"::varchar end"]
    + [f'"{n}"::varchar' for n in _NAMES[:-1]]
    + ["case when event_type = 'error' then '?' else \"Amount\"::varchar end", '"Class"::varchar']
)
_DIRTY = (
    'dirty as (select "ID" as line_no, event_type, string_split('
    + " || ',' || ".join(f"({_PAD}) || ({f})" for f in _DIRTY_FIELDS)
    + " || case when event_type = 'purchase' then ',end' else '' end, ',') as f from txn)"
)

SCAN_LENIENT = txn(
    'select line_no, coalesce(try_cast(trim(f[1]) as bigint), 0) as "ID", '
    'try_cast(trim(f[2]) as double) as "V1", try_cast(trim(f[29]) as double) as "V28", '
    'try_cast(trim(f[30]) as double) as "Amount", try_cast(trim(f[31]) as int) as "Class" from dirty',
    _DIRTY,
)

DROP_MALFORMED = txn(
    'select line_no, f[1]::bigint as "ID", f[2]::double as "V1", f[29]::double as "V28", '
    'f[30]::double as "Amount", f[31]::int as "Class" from dirty '
    "where len(f) = 31 and regexp_full_match(f[1], '[+-]?[0-9]+') and regexp_full_match(f[31], '[+-]?[0-9]+') and "
    + " and ".join(f"try_cast(f[{i}] as double) is not null" for i in range(2, 31)),
    _DIRTY,
)

_NUMBERED = (
    'numbered as (select row_number() over (order by line_no) - 1 as number, '
    'coalesce(try_cast(trim(f[1]) as bigint), 0) as "ID", try_cast(trim(f[2]) as double) as "V1", '
    'try_cast(trim(f[29]) as double) as "V28", try_cast(trim(f[30]) as double) as "Amount", '
    'try_cast(trim(f[31]) as int) as "Class" from dirty)'
)


def numbered(body: str) -> str:
    """``body`` over the lenient rows with their place among all lines."""
    return txn(body, _DIRTY, _NUMBERED)


NUMBERED_EVENTS = "select event_id, row_number() over (order by ts, event_id) - 1 as number from events"
SPLIT_BAD_IDS = numbered(
    f"""select number, "ID", "Class", case when {_uniform("'split:11:' || number")} < 0.7::double
    then 'train' else 'test' end as part, ({_bits("'fold:11:' || number")} % 5)::int as fold from numbered"""
)
UNDERSAMPLE_BAD_IDS = numbered(
    f"""select number, "ID", "Class" from numbered where "Class" = 1
    or ("Class" = 0 and {_uniform("'under:1:' || number")} < 0.3::double)"""
)
PUBLISH_REPEATED_IDS = numbered(
    f"""select {_uuid("('send:1:' || number || ':' || c.cycle)")} as uuid, "ID" as id, c.cycle::int as cycle, number
    from numbered, (select unnest([1, 2]) as cycle) c"""
)

_BAD = [
    f"case when not regexp_full_match(f[1], '[+-]?[0-9]+') then 'ID' end",
    *[f"case when try_cast(f[{i + 2}] as double) is null then '{n}' end" for i, n in enumerate(_NAMES)],
    "case when not regexp_full_match(f[31], '[+-]?[0-9]+') then 'Class' end",
]
REJECTS = txn(
    """select reason, case when reason = 'bad_value' then bad end as "column", count(*) as n, true as as_observed
    from (select bad, case when len(f) < 31 then 'few_fields' when len(f) > 31 then 'many_fields'
    when bad is not null then 'bad_value' else 'kept' end as reason from judged) q group by 1, 2""",
    _DIRTY,
    f"judged as (select f, coalesce({', '.join(_BAD)}) as bad from dirty)",
)

PREDICTIONS = txn(
    f"""select {_uuid("'txn:1:' || \"ID\"")} as uuid, "ID" as id,
    ("Amount" > 160)::int::double as prediction, ("Amount" > 160)::int::double as "predictedLabel",
    "Class"::double as label, epoch_us(ts) // 1000 as incoming_time, ts as prediction_time from txn"""
)

_STAMP = "strftime(ts, '%d/%m/%Y %H:%M:%S:') || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 7, '0')"
RUN_LOG_FORMAT = (
    f"select event_id, {_STAMP} as execution_time, "
    f"concat_ws(',', {_STAMP}, user_id, event_type) as line from events"
)

SUBMODELS = (
    f"""select {_STAMP} as "executionTime", 0.5::double as undersampling, user_id as oversampling,
    'maxDepth:5,kind:' || event_type as params, value as metric from events where value is not null"""
)



def twice(sql: str) -> str:
    return f"select * from ({sql}) a union all select * from ({sql}) b"


# The older run log's names and kinds, in file order.
_LOG = (
    "executionTime:s numWorkerNodes:l undersampling:u oversampling:l numTrees:l maxDepth:l maxBins:l impurity:e "
    "featureSubsetStrategy:t minInstancesPerNode:l tp:d fp:d fn:d tn:d accuracy:d precision:d sensitivity:d specificity:d "
    "areaUnderROC:d areaUnderPR:d areaunderPRCV:d param2:t param3:t param7:t param8:t param9:t param10:t param11:t "
    "param12:t param13:t param14:t param15:t"
).split()
_LOG_VALUES = {
    "s": _STAMP, "u": "0.25::double", "e": "event_type", "d": "value", "l": "event_id + {i}", "t": "value::varchar",
}
RUN_LOG = "select " + ", ".join(
    _LOG_VALUES[kind].replace("{i}", str(i)) + f' as "{name}"'
    for i, (name, kind) in enumerate(x.split(":") for x in _LOG)
) + " from events where value is not null"

COPIED_SIZES = """select 'test_partition' as name, count(*) as n from events
union all select 'tuning_log', 2 * count(value) from events union all select 'submodel_log', 2 * count(value) from events"""

LABEL_INDEX = (
    "select event_type, (dense_rank() over (order by event_type) - 1)::double as label, count(*) as n "
    "from events group by event_type"
)

TRAIN_TEST_SPLIT = txn(
    f"""select "ID", "Class", case when {_uniform("'split:11:' || \"ID\"")} < 0.7::double
    then 'train' else 'test' end as part from txn"""
)

FOLDS = txn(
    f"""select ({_bits("'fold:11:' || \"ID\"")} % 5)::int as fold, "Class", count(*) as n,
    sum("ID")::bigint as id_sum from txn group by 1, 2"""
)

_KEPT = (
    f"""kept as (select * from txn where "Class" = 1
    or ("Class" = 0 and {_uniform("'under:1:' || \"ID\"")} < 0.3::double))"""
)
UNDERSAMPLE = txn('select "ID", "Class", "Amount" from kept', _KEPT)

_RARE = 'rare as (select "ID" as id, * from txn where "Class" = 1)'
_SIZE = "size as (select count(*) as m from rare)"


def _last(rate: float, whole: int) -> str:
    """The rows that get one copy more than the whole part of the rate."""
    return (
        f"last as (select id, {whole + 1} as copy from (select id, row_number() over "
        f"(order by {_bits('''('extra:1:' || id)''')}, id) as r from rare) q, size "
        f"where r <= floor(m * {rate}::double + 0.5) - m * {whole})"
    )


def _copies(rate: float) -> list[str]:
    whole = int(rate)
    parts = []
    if whole:
        parts.append(
            "select id, c.copy::int as copy from rare, "
            f"(select unnest(range(1, {whole + 1})) as copy) c"
        )
    ctes = [_RARE, _SIZE]
    if rate != whole:
        ctes.append(_last(rate, whole))
        parts.append("select id, copy::int as copy from last")
    return [*ctes, "copies as (" + " union all ".join(parts) + ")"]


EXACT_SAMPLE = txn("select id, copy from copies", *_copies(1.5))

HASH_RANKED_EVENTS = f"""select event_id, event_type, value from (select *, row_number() over
(order by {_bits("'third:1:' || event_id")}, event_id) as r from events) q
where r <= (select count(*) // 3 from events)"""


def _edges(names: list[str], k: int = 5) -> str:
    gaps = " + ".join(f'(a."{n}" - b."{n}")::double * (a."{n}" - b."{n}")::double' for n in names)
    return (
        "edges as (select * from (select seed_id, nn_id, dist, "
        "row_number() over (partition by seed_id order by dist, nn_id)::int as rank "
        f"from (select a.id as seed_id, b.id as nn_id, sqrt({gaps}) as dist "
        f"from rare a join rare b on a.id <> b.id) p) q where rank <= {k})"
    )


KNN = txn("select seed_id, rank, nn_id, dist from edges", _RARE, _edges(_NAMES))

_VECTOR_GAPS = " + ".join(
    f"(a.embedding[{i}]::double - b.embedding[{i}]::double) * "
    f"(a.embedding[{i}]::double - b.embedding[{i}]::double)"
    for i in range(1, 65)
)
KNN_VECTORS = (
    "select * from (select seed_id, row_number() over (partition by seed_id order by dist, nn_id)::int "
    f"as rank, nn_id, dist from (select a.vec_id as seed_id, b.vec_id as nn_id, sqrt({_VECTOR_GAPS}) "
    "as dist from embeddings a join embeddings b on a.vec_id <> b.vec_id) p) q where rank <= 5"
)


def _picks(names: list[str], rate: float) -> list[str]:
    chosen = _bits("('nn:1:' || c.id || ':' || c.copy)")
    return [
        *_copies(rate),
        _edges(names),
        "degree as (select seed_id, count(*) as n_nn from edges group by 1)",
        "picks as (select c.id, c.copy, e.rank, e.nn_id, e.dist from copies c "
        "join degree d on d.seed_id = c.id join edges e on e.seed_id = c.id "
        f"and e.rank = {chosen} % d.n_nn + 1)",
    ]


KNN_PICK = txn(
    "select id as seed_id, copy, rank, nn_id, dist from picks", *_picks(_NAMES, 3)
)


def smote(rate: float, mode: str = "interpolate", seconds: bool = False, union: bool = False) -> str:
    names = (["NumericSecondDay"] if seconds else []) + _NAMES
    gap = _uniform("('gap:1:' || p.id || ':' || p.copy)")
    values = []
    for n in names:
        step = f'(y."{n}" - x."{n}")' if mode == "interpolate" else f'(x."{n}" - y."{n}")'
        value = f'x."{n}" + {step} * {gap}'
        if n == "NumericSecondDay":
            value = f"round({value})::int"
        values.append(f'{value} as "{n}"')
    made = (
        "made as (select p.id as seed_id, p.copy, p.nn_id, 1 as \"Class\", "
        + ", ".join(values)
        + " from picks p join rare x on x.id = p.id join rare y on y.id = p.nn_id)"
    )
    columns = '"Class", ' + ", ".join(f'"{n}"' for n in names)
    body = f"select {columns} from txn union all select {columns} from made" if union else (
        f"select seed_id, copy, nn_id, {columns} from made"
    )
    return txn(body, *_picks(names, rate), made)


def fold_smote(rate: float, folds: int = 5, k: int = 5) -> str:
    """Neighbours by brute force among the rows outside each fold."""
    whole = int(rate)
    gaps = " + ".join(f'(a."{n}" - b."{n}")::double * (a."{n}" - b."{n}")::double' for n in _NAMES)
    gap = _uniform("('gap:1:' || p.id || ':' || p.copy)")
    chosen = _bits("('nn:1:' || c.id || ':' || c.copy)")
    values = ", ".join(f'x."{n}" + (y."{n}" - x."{n}") * {gap} as "{n}"' for n in _NAMES)
    fold = _bits("('fold:11:' || \"ID\")")
    extra = _bits("('extra:1:' || id)")
    ctes = [
        f'rare as (select "ID" as id, *, ({fold} % {folds})::int as fold from txn where "Class" = 1)',
        f"parts as (select h.held_out::int as held_out, r.* from rare r, (select unnest(range({folds})) as held_out) h "
        "where r.fold <> h.held_out)",
        "edges as (select * from (select held_out, seed_id, nn_id, dist, row_number() over "
        "(partition by held_out, seed_id order by dist, nn_id)::int as rank "
        f"from (select a.held_out, a.id as seed_id, b.id as nn_id, sqrt({gaps}) as dist from parts a join parts b "
        f"on a.held_out = b.held_out and a.id <> b.id) p) q where rank <= {k})",
        "sizes as (select held_out, count(*) as m from parts group by 1)",
        f"ranked as (select held_out, id, row_number() over (partition by held_out order by {extra}, id) as r from parts)",
        "copies as (select held_out, id, c.copy::int as copy from ranked join sizes using (held_out), "
        f"(select unnest(range(1, {whole + 2})) as copy) c "
        f"where c.copy <= {whole} or r <= floor(m * {rate}::double + 0.5) - m * {whole})",
        "degree as (select held_out, seed_id, count(*) as n_nn from edges group by all)",
        "picks as (select c.held_out, c.id, c.copy, e.nn_id from copies c "
        "join degree d on d.held_out = c.held_out and d.seed_id = c.id "
        f"join edges e on e.held_out = c.held_out and e.seed_id = c.id and e.rank = {chosen} % d.n_nn + 1)",
    ]
    return txn(
        f'select p.held_out, p.id as seed_id, p.copy, p.nn_id, 1 as "Class", {values} '
        "from picks p join rare x on x.id = p.id join rare y on y.id = p.nn_id",
        *ctes,
    )


BALANCED_COUNTS = txn(
    'select "Class", sum(n)::bigint as n from (select "Class", count(*) as n from kept group by 1 '
    'union all select 1 as "Class", count(*) * 3 as n from txn where "Class" = 1) q group by 1',
    _KEPT,
)

_RULE = (
    'rule as (select "ID" as id, "Class"::double as label, ("Amount" > 160)::int::double as prediction, '
    '"Amount" as score from txn)'
)
_DOCS = (
    "docs as (select quality::double as label, n_chars::double as score, "
    "(n_chars > 1000)::int::double as prediction from labels join documents using (doc_id))"
)


def _count(label: int, predicted: int, name: str) -> str:
    return f"count(*) filter (label = {label} and prediction = {predicted}) as {name}"


_COUNTS = ", ".join(
    [_count(0, 0, "tn"), _count(0, 1, "fp"), _count(1, 0, "fn"), _count(1, 1, "tp")]
)
_CELLS = f"cells as (select {_COUNTS} from rule)"
_RATIOS = (
    "(tp + tn)::double / nullif(tp + tn + fp + fn, 0)::double as accuracy, "
    "tp::double / nullif(tp + fp, 0)::double as precision, "
    "tp::double / nullif(tp + fn, 0)::double as sensitivity, "
    "tn::double / nullif(tn + fp, 0)::double as specificity, "
    "fp::double / nullif(fp + tn, 0)::double as fpr"
)
CONFUSION = txn("select * from cells", _RULE, _CELLS)
RATIOS = txn(f"select *, {_RATIOS} from cells", _RULE, _CELLS)


def _areas(source: str, score: str) -> list[str]:
    return [
        f"points as (select {score} as s, sum(label) as p, sum(1 - label) as n from {source} group by 1)",
        "run as (select s, sum(p) over w as tp, sum(n) over w as fp, (select sum(p) from points) as pp, "
        "(select sum(n) from points) as nn from points window w as (order by s desc))",
        "steps as (select *, lag(tp, 1, 0) over (order by s desc) as tp0, "
        "lag(fp, 1, 0) over (order by s desc) as fp0, tp / (tp + fp) as pr, "
        "lag(tp / (tp + fp)) over (order by s desc) as pr0 from run)",
        'areas as (select round(sum((fp - fp0) / nn * (tp + tp0) / (2 * pp)), 9) as "areaUnderROC", '
        'round(sum((tp - tp0) / pp * (pr + coalesce(pr0, pr)) / 2), 9) as "areaUnderPR" from steps)',
    ]


def areas(source: str, score: str) -> str:
    if source == "rule":
        return txn("select * from areas", _RULE, *_areas("rule", score))
    return _with("select * from areas", _DOCS, *_areas("docs", score))


EVALUATION = txn(
    f"select cells.*, {_RATIOS}, areas.* from cells, areas", _RULE, _CELLS, *_areas("rule", "prediction")
)


_TRAIN = f"{_uniform("'split:11:' || \"ID\"")} < 0.7::double"
_UNDER = _uniform("'under:11:' || \"ID\"")


def sampling_grid(settings: list[tuple[int, float]]) -> str:
    rows = " union all ".join(
        f"select {i} as ordinal, {over} as oversampling, {under}::double as undersampling, "
        f'count(*) filter ("Class" = 0 and {_UNDER} < {under}::double) as negatives, '
        f'count(*) filter ("Class" = 1) * {over + 1} as positives from txn where {_TRAIN}'
        for i, (over, under) in enumerate(settings)
    )
    return txn(rows)


REPEATED_IDS = txn(
    'select case when "ID" % 3 <> 0 then "ID" % 1000 end as seed_id, count(*) * 6 as n from txn '
    'where "Class" = 1 group by 1'
)

FOLD_COUNTS = txn(
    f"""select ({_bits("'fold:11:' || \"ID\"")} % 5)::int as fold, "Class",
    (case when "Class" = 1 then 4 else 1 end * count(*))::bigint as n from txn
    where {_TRAIN} and ("Class" = 1 or {_UNDER} < 0.3::double) group by 1, 2"""
)

_KEYED = _uuid("('send:1:' || \"ID\" || ':1')")
SEND_LOG = txn(f'select {_KEYED} as uuid, "ID" as id, true as time_ok from txn')
UUID_FROM_KEY = txn(f'select {_KEYED} as uuid, "ID" as id from txn')
HELD_OUT_CHECKED = txn(
    'select "ID" as id, "Class"::double as label, true as prediction_ok, true as label_ok from txn '
    f"where not {_TRAIN}"
)
HELD_OUT_STAMPED = txn(
    f'select "ID" as id, "Class"::double as label, true as prediction_ok, true as label_ok, '
    f"{_KEYED} as uuid, true as time_ok from txn where not {_TRAIN}"
)
LINEAGE = txn(
    f"""select {_KEYED} as uuid, "ID" as id, 'transactions' as topic, ("ID" % 3)::int as partition, "ID" // 3 as "offset"
    from txn"""
)
SWEEP_REPORT = txn(
    """select 4::bigint as "numWorkerNodes", 0.3::double as undersampling, 2.0::double as oversampling,
    5::bigint as "numTrees", 4::bigint as "maxDepth", 'gini' as impurity, '2' as param2, '5' as param15,
    count(*) filter ("Class" = 1) as positives, count(*) filter ("Class" = 0) as negatives, true as ratios_ok,
    true as better_than_chance from txn """ + f"where not {_TRAIN}"
)
SWEEP = """select s.o as oversampling, s.u as undersampling, t.n as num_trees, '5' as max_depth,
'entropy' as impurity, true as metric_ok
from (values (2.0::double, 0.3::double), (1.5::double, 0.1::double)) s(o, u), (values ('5'), ('10')) t(n)"""


SWEEP_WITHIN = """select 2.0::double as oversampling, 0.3::double as undersampling, d as max_depth,
true as better_than_chance from (values ('4'), ('6')) t(d)"""
SENT_TWICE = txn(
    'select "ID" as id, "Class"::double as label, true as prediction_ok, true as label_ok, '
    f"{_KEYED} as uuid from txn where not {_TRAIN}"
)

_TIMES = (
    f"""sends as (select {_KEYED} as uuid, ts as sent_at from txn where "ID" % 11 <> 5)""",
    f"""found as (select {_KEYED} as uuid, date_trunc('second', ts) + to_seconds(case when "ID" % 97 = 0 then 3600
    else "ID" % 7 * 20 + 1 end) as predicted_at from txn where "ID" % 10 <> 3)""",
    """latency as (select coalesce(s.uuid, f.uuid) as uuid, sent_at, predicted_at,
    (epoch_us(predicted_at) - epoch_us(sent_at)) // 1000 as latency_ms,
    case when s.uuid is null then 'unsent' when f.uuid is null then 'unpredicted' else 'matched' end as status
    from sends s full join found f on s.uuid = f.uuid and predicted_at >= sent_at
    and predicted_at <= sent_at + interval 10 minutes)""",
)
LATENCY = txn("select * from latency", *_TIMES)
LATENCY_REPORT = txn(
    """select time_bucket(interval 1 hour, coalesce(sent_at, predicted_at)) as window_start,
    count(*) filter (status = 'matched') as matched, count(*) filter (status = 'unpredicted') as unpredicted,
    count(*) filter (status = 'unsent') as unsent, min(latency_ms) as least_ms,
    sum(latency_ms)::bigint / count(latency_ms)::double as mean_ms, max(latency_ms) as largest_ms from latency group by 1""",
    *_TIMES,
)

_CONSUMED = """planned as (select 'transactions' as topic, (event_id % 4)::int as partition, event_id // 4 as "offset",
event_id // 200 as batch from events),
kept as (select * from planned where batch <> 2 or "offset" % 50 >= 40
union all select topic, partition, "offset", 1004 as batch from planned where batch = 4)"""


def _runs(source: str, keys: str) -> str:
    """Unbroken runs of offsets by keys."""
    return (
        f'(select {keys}, min("offset") as first, max("offset") as last from (select *, "offset" - row_number() over '
        f'(partition by {keys} order by "offset") as run from {source}) q group by {keys}, run)'
    )


_SOURCE = "topic, partition"
OFFSET_RANGES = f"with {_CONSUMED} select * from {_runs('kept', _SOURCE + ', batch')}"
OFFSET_AUDIT = f"""with {_CONSUMED}, bounds as (
  select {_SOURCE}, min("offset") as low, max("offset") as high from kept group by all
), every as (select {_SOURCE}, unnest(range(low, high + 1)) as "offset" from bounds),
depth as (
  select e.topic, e.partition, e."offset", coalesce(string_agg(batch::varchar, ',' order by batch), '') as batches
  from every e left join kept k on k.topic = e.topic and k.partition = e.partition and k."offset" = e."offset" group by all
), odd as (
  select *, case when batches = '' then 'gap' else 'overlap' end as kind from depth where batches = '' or contains(batches, ',')
), runs as (select * from {_runs('odd', _SOURCE + ', kind, batches')})
select r.topic, r.partition, r.kind, r.first, r.last, case when kind = 'overlap' then batches else (
  select string_agg(b::varchar, ',' order by b) from (select distinct batch as b from kept k where k.topic = r.topic
  and k.partition = r.partition and k."offset" in (r.first - 1, r.last + 1)) n) end as batches from runs r"""
OFFSET_COVERAGE = f"""with {_CONSUMED}
select p.topic, p.partition, p.batch, min(p."offset") as first, max(p."offset") as last, count(k."offset") as held,
count(*) - count(k."offset") as lost
from planned p left join (select distinct topic, partition, "offset" from kept) k
on k.topic = p.topic and k.partition = p.partition and k."offset" = p."offset" group by 1, 2, 3"""
OFFSET_STREAM = f"""with {_CONSUMED}
select topic, partition, min("offset") as first, max("offset") as last, 0::bigint as overlaps from planned group by 1, 2"""


RUNNING = txn(
    f'select cells.*, {_RATIOS}, true as "areaUnderROC_inside", true as "areaUnderPR_inside", '
    'true as "areaUnderROC_narrow" from cells',
    _RULE,
    _CELLS,
)


def best_config(thresholds: list[float]) -> str:
    rows = " union all ".join(
        f"select {i} as ordinal, {t}::double as threshold, "
        f"avg(((score > {t}::double)::int::double = label)::int) as accuracy from rule"
        for i, t in enumerate(thresholds)
    )
    return txn(f"select * from ({rows}) q order by accuracy desc, ordinal limit 1", _RULE)


THROUGHPUT = (
    "select time_bucket(interval 5 seconds, ts) as window_start, count(*) as n, "
    "count(*) // 5 as tps, count(*) / 5.0::double as rate from events group by 1"
)


def publish(cycles: int) -> str:
    uuid = _uuid("('send:1:' || \"ID\" || ':' || c.cycle)")
    return txn(
        f'select {uuid} as uuid, "ID" as id, c.cycle::int as cycle, "Amount", "Class" from txn, '
        f"(select unnest(range(1, {cycles + 1})) as cycle) c"
    )


def round_trip() -> str:
    uuid = _uuid("('send:1:' || \"ID\" || ':1')")
    return txn(f'select {uuid} as uuid, "ID" as id, "NumericSecondDay", {FEATURES}, "Class" from txn')
