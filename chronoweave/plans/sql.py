"""The catalogue's queries in DuckDB SQL, from shared common table expressions."""

from __future__ import annotations

import re

from ..functions.phrases import IRREGULAR, PHRASES, PREPOSITIONS

ACTIVITY = """quads AS (SELECT event_id AS event_idx, 'user_' || user_id AS subject, event_type AS relation, lower(trim(event_type)) AS relation_norm,
 'item_' || json_extract_string(props, '$.k') AS object, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_raw, ts, CAST(ts AS DATE) AS day FROM events)"""
_SHIPPED = """shipped AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS event_idx,
 l_suppkey, l_shipdate, l_returnflag || l_linestatus AS flags, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_AS_QUADS = """CAST(event_idx AS BIGINT) AS event_idx, {s} AS subject, flags AS relation, lower(trim(flags)) AS relation_norm, 'cust_' || o_custkey AS object,
 strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') AS ts_raw, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day"""
SHIPMENTS = _SHIPPED + ", quads AS (SELECT " + _AS_QUADS.format(s="'supp_' || l_suppkey") + " FROM shipped)"
NATIONAL = _SHIPPED + ", quads AS (SELECT " + _AS_QUADS.format(s="n_name") + " FROM shipped JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"

SPLIT = """marked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC NULLS LAST, event_idx DESC) AS nth FROM quads),
q AS (SELECT event_idx AS query_id, subject AS sq, relation AS rq, relation_norm AS rq_norm, ts_raw AS tq_raw, ts AS tq, object AS ground_truth FROM marked WHERE nth = 1),
train AS (SELECT * EXCLUDE (nth) FROM marked WHERE nth > 1),
ends AS (SELECT subject AS entity, * FROM train UNION ALL SELECT object AS entity, * FROM train WHERE object <> subject)"""
HISTORY = """hist AS (SELECT q.*, e.*, row_number() OVER (PARTITION BY query_id ORDER BY ts ASC NULLS LAST, ts_raw, event_idx) AS pos
 FROM q JOIN ends e ON sq = entity WHERE tq IS NULL OR ts IS NULL OR ts < tq)"""


def dual(short: str = "20", total: str = "100", alpha: str = "2.75", event_cap: str = "64", day_cap: str = "0", use_short: str = "true", use_long: str = "true") -> str:
    """From ``hist`` to ``st`` (short), ``g`` (scored day groups), ``lt`` (long) and ``dh`` (both)."""
    return f"""hs AS (SELECT *, ({use_short}) AND row_number() OVER (PARTITION BY query_id ORDER BY ts DESC NULLS FIRST, pos DESC) <= {short} AS short FROM hist),
st AS (SELECT * FROM hs WHERE short),
nst AS (SELECT query_id, count(*) AS n FROM st GROUP BY 1),
pool AS (SELECT h.*, greatest({total} - coalesce(n, 0), 0) AS target FROM hs h LEFT JOIN nst USING (query_id)
 WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.query_id = h.query_id AND st.subject = h.subject AND st.relation_norm = h.relation_norm AND st.object = h.object AND st.ts_raw = h.ts_raw)),
pool1 AS (SELECT *, coalesce(tq, arg_max(ts, CASE WHEN ts IS NOT NULL THEN pos END) OVER (PARTITION BY query_id)) AS ref, min(ts) OVER (PARTITION BY query_id) AS oldest FROM pool WHERE target > 0 AND ({use_long})),
pool2 AS (SELECT *, greatest(1, date_sub('day', oldest, ref)) AS span, dense_rank() OVER (PARTITION BY query_id ORDER BY day DESC) AS day_rank FROM pool1 WHERE ref IS NOT NULL AND ts IS NOT NULL),
pool3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, day ORDER BY pos DESC) AS from_last, ('0x' || substr(sha256(subject || '|' || relation || '|' || object || '|' || ts_raw), 1, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1 AS score
 FROM pool2 WHERE {day_cap} <= 0 OR day_rank <= {day_cap}),
pool4 AS (SELECT *, count(*) OVER (PARTITION BY query_id, day) AS f, date_diff('day', day, CAST(ref AS DATE)) AS delta, exp(score - max(score) OVER (PARTITION BY query_id, day)) AS ex FROM pool3 WHERE {event_cap} <= 0 OR from_last <= {event_cap}),
g AS (SELECT *, ex / sum(ex) OVER (PARTITION BY query_id, day) AS p, 1.0::DOUBLE / f + (1 - 1.0::DOUBLE / f) * pow(greatest(delta::DOUBLE / span, 0.0::DOUBLE), {alpha}::DOUBLE) AS c FROM pool4),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY day DESC, pos) AS k FROM g WHERE p >= c),
lt AS (SELECT * FROM kept WHERE k <= target),
both_ AS (SELECT query_id, event_idx, subject, relation, relation_norm, object, ts_raw, ts, pos, 0 AS is_short FROM lt UNION ALL SELECT query_id, event_idx, subject, relation, relation_norm, object, ts_raw, ts, pos, 1 FROM st),
dh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts ASC NULLS FIRST, is_short, pos) AS place FROM both_)"""


def again(suffix: str, *ctes: str) -> str:
    """Tables of questions and histories once more under other names, for other questions (``q`` + suffix)."""
    names = "q|hist|hs|st|nst|pool|pool1|pool2|pool3|pool4|g|kept|lt|both_|dh"
    return re.sub(rf"(?<![.'])\b({names})\b(?! AS k\b)", rf"\1{suffix}", ",\n".join(ctes))


NEIGHBOURS = "nb AS (SELECT entity, ts, CASE WHEN subject = entity THEN object ELSE subject END AS neighbour FROM ends)"
FIRST = "o1 AS (SELECT DISTINCT query_id, CASE WHEN subject = entity THEN object ELSE subject END AS candidate FROM hist WHERE CASE WHEN subject = entity THEN object ELSE subject END NOT IN ('?', 'None', 'null', ''))"
SECOND = f"""{NEIGHBOURS}, nd AS (SELECT DISTINCT entity, neighbour FROM nb WHERE neighbour NOT IN ('?', 'None', 'null', '')),
o2 AS (SELECT query_id, candidate FROM o1 UNION SELECT query_id, neighbour FROM o1 JOIN q USING (query_id) JOIN nd ON entity = candidate WHERE neighbour <> sq)"""


def scores(source: str) -> str:
    return f"""sc AS (SELECT o.*, ('0x' || substr(sha256(sq || '|' || rq || '|' || tq_raw || '|' || candidate), 1, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1 AS score FROM {source} o JOIN q USING (query_id)),
sx AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS ex FROM sc),
sp AS (SELECT *, ex / sum(ex) OVER (PARTITION BY query_id) AS prob FROM sx),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prob DESC, candidate) AS rank FROM sp)"""


def filtered(mode: str) -> str:
    if mode == "none":
        return "fr AS (SELECT r.*, ground_truth FROM rk r JOIN q USING (query_id))"
    at = " AND x.ts_raw = q.tq_raw" if mode == "time-aware" else ""
    return f"""fr0 AS (SELECT r.query_id, r.candidate, r.rank AS old, ground_truth FROM rk r JOIN q USING (query_id)
 WHERE candidate = ground_truth OR NOT EXISTS (SELECT 1 FROM quads x WHERE x.subject = q.sq AND x.relation = q.rq AND x.object = r.candidate{at})),
fr AS (SELECT query_id, candidate, ground_truth, row_number() OVER (PARTITION BY query_id ORDER BY old) AS rank FROM fr0)"""


RIGHT = "rr AS (SELECT q.query_id, min(fr.rank) AS rank FROM q LEFT JOIN fr ON fr.query_id = q.query_id AND candidate = fr.ground_truth GROUP BY 1)"
RATES = "count(rank) AS evaluated, CAST(sum(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped, round(coalesce(avg(CASE WHEN rank IS NOT NULL THEN CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 0.0::DOUBLE), 6) AS hit_at_1, round(coalesce(avg(CASE WHEN rank IS NOT NULL THEN CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 0.0::DOUBLE), 6) AS hit_at_10, round(coalesce(avg(1.0::DOUBLE / rank), 0.0::DOUBLE), 6) AS mrr"


def ents(prefix: str = "user_") -> str:
    return f"ent AS (SELECT '{prefix}' || vec_id AS entity, embedding AS features, label AS cluster FROM embeddings)"


PEERS = "pe AS (SELECT q.*, b.entity AS peer, list_sum(list_transform(list_zip(a.features, b.features), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS similarity FROM q JOIN ent a ON a.entity = q.sq JOIN ent b ON a.cluster = b.cluster AND b.entity <> q.sq)"
CONTEXTS = "pc AS (SELECT entity, event_idx, rank() OVER (PARTITION BY entity ORDER BY ts) - 1 AS contexts FROM ends WHERE ts IS NOT NULL)"


def similar(contexts: int, least: int, analogies: int) -> str:
    return f"""{PEERS}, {CONTEXTS},
pv AS (SELECT pe.query_id, peer, similarity, coalesce(contexts, 0) AS contexts, t.event_idx, t.ts FROM pe JOIN train t ON t.subject = peer AND t.relation_norm = pe.rq_norm LEFT JOIN pc ON pc.entity = t.subject AND pc.event_idx = t.event_idx
 WHERE (tq IS NULL OR t.ts IS NULL OR t.ts < tq) AND coalesce(contexts, 0) >= {max(contexts, least)}),
p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, peer ORDER BY similarity DESC, ts ASC NULLS FIRST, event_idx) AS k FROM pv),
p2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, peer) AS nth FROM p1 WHERE k = 1),
sim AS (SELECT * FROM p2 WHERE nth <= {analogies})"""


def own_histories(events: str, flags: str, *settings: str) -> str:
    """``q_e`` (questions made of the events of a query, own_id their id) and their dual histories ``dh_e``."""
    asked = f"q AS (SELECT DISTINCT own_id AS query_id, subject AS sq, relation AS rq, relation_norm AS rq_norm, ts_raw AS tq_raw, ts AS tq{flags} FROM {events})"
    return again("_e", asked, HISTORY, dual(*settings))


#: Prompts of all questions, with the candidates as a list; ``an`` holds analogies where there are any.
def prompt(analogies: bool = False) -> tuple[str, ...]:
    told = "coalesce(analogies, '(no analogies)')" if analogies else "'(no analogies)'"
    return (
        f"ls AS (SELECT query_id, string_agg(k || '. ' || line, chr(10) ORDER BY k) AS history FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k, {sentence()} AS line FROM dh JOIN ph USING (relation)) GROUP BY 1)",
        "cl AS (SELECT query_id, list(candidate ORDER BY candidate) AS cs, string_agg(k || '. ' || candidate, chr(10) ORDER BY k) AS cands FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY candidate) AS k FROM o1) GROUP BY 1)",
        f"pr AS (SELECT q.*, coalesce(cs, []) AS cs, 'Answer the last question with the number of one candidate.' || chr(10) || chr(10) || {told} || chr(10) || chr(10) || 'Events:' || chr(10) || coalesce(history, '') || chr(10) || chr(10) || 'Question: ' || {QUESTION} || chr(10) || 'Candidates:' || chr(10) || coalesce(cands, '') || chr(10) || 'Answer:' AS prompt"
        + f" FROM q JOIN ph ON rq = relation LEFT JOIN ls USING (query_id) LEFT JOIN cl USING (query_id){' LEFT JOIN an USING (query_id)' if analogies else ''})",
    )


#: Analogies of ``eq`` (query_id, nth, the event, own_id) from ``dh_e``.
def analogies() -> tuple[str, ...]:
    question = f"'On ' || {date('e.ts', 'e.ts_raw')} || ', ' || {name('e.subject')} || ' ' || said || CASE WHEN said LIKE '% about' THEN ' what?' ELSE ' whom?' END"
    return (
        f"le AS (SELECT query_id AS own_id, string_agg(k || '. ' || line, chr(10) ORDER BY k) AS history FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k, {sentence()} AS line FROM dh_e JOIN ph USING (relation)) GROUP BY 1)",
        f"an AS (SELECT e.query_id, string_agg('Analogy ' || nth || ':' || chr(10) || coalesce(history, '') || chr(10) || 'Question: ' || {question} || chr(10) || 'Answer: ' || e.object || '. The events lead to ' || e.object || '.', chr(10) ORDER BY nth) AS analogies FROM eq e JOIN ph ON ph.relation = e.relation LEFT JOIN le USING (own_id) GROUP BY 1)",
    )


def labels(source: str = "pr") -> str:
    """Ranks (``rk``) by label scores of whole prompts."""
    return f"""sc AS (SELECT query_id, c AS candidate, {hashed("read || '|' || c")} / 4294967295.0::DOUBLE * 2 - 1 AS score FROM (SELECT *, sha256(prompt) AS read FROM {source}), unnest(cs) t(c)),
sx AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS ex FROM sc),
sp AS (SELECT *, ex / sum(ex) OVER (PARTITION BY query_id) AS prob FROM sx),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prob DESC, candidate) AS rank FROM sp)"""


def hashed(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def phrase(r: str) -> str:
    """A relation's phrase as one expression."""
    tidy = f"regexp_replace(trim({r}), '\\s+', ' ', 'g')"
    word = f"lower(split_part({tidy}, ' ', 1))"
    known = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in PHRASES.items())
    irregular = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in IRREGULAR.items())
    past = f"CASE {word} {irregular} ELSE CASE WHEN {word} LIKE '%e' THEN {word} || 'd' WHEN regexp_matches({word}, '[^aeiou][aeiou][^aeiouwxy]$') THEN {word} || right({word}, 1) || 'ed' WHEN regexp_matches({word}, '[^aeiou]y$') THEN left({word}, length({word}) - 1) || 'ied' ELSE {word} || 'ed' END END"
    made = f"({past}) || substr({tidy}, length({word}) + 1)"
    ended = f"CASE WHEN regexp_matches({made}, ' ({'|'.join(PREPOSITIONS)})$') THEN {made} ELSE {made} || ' with' END"
    return f"CASE WHEN {tidy} = '' THEN 'interacted with' ELSE CASE lower(trim({r})) {known} ELSE {ended} END END"


def date(ts: str, raw: str) -> str:
    return f"coalesce(day({ts}) || ' ' || monthname({ts}) || ' ' || year({ts}), trim({raw}))"


def name(c: str) -> str:
    return f"replace(trim({c}), '_', ' ')"


def sentence(a: str = "") -> str:
    return f"'On ' || {date(a + 'ts', a + 'ts_raw')} || ', ' || {name(a + 'subject')} || ' ' || said || ' ' || {name(a + 'object')} || '.'"


QUESTION = f"'On ' || {date('tq', 'tq_raw')} || ', ' || {name('sq')} || ' ' || said || CASE WHEN said LIKE '% about' THEN ' what?' ELSE ' whom?' END"
SAID = f"ph AS (SELECT relation, {phrase('relation')} AS said FROM (SELECT DISTINCT relation FROM quads))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
