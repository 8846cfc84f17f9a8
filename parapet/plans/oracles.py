"""SQL for the same results, run by another engine over the same tables.

Each text is plain SQL over the given tables; where the Spark side works in
blocks and carries, these use whole windows, recursion or simple replacement.
"""

from __future__ import annotations

from parapet import fixed_values as fv
from parapet.plans import datasets as ds
from parapet.plans.registry import AS_OF


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join("NULL" if v is None else lit(v) for v in values) + "]"


def rx(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {lit(pattern)}" + (f", {lit(flags)})" if flags else ")")


# --- messages with planted phrases -------------------------------------------------

def message_tables(tenant: str = "'t' || (conv_id % 4)", texts: str = "mt", parts: str = "blocks", exchanges: bool = False) -> str:
    """CTEs of whole messages and of their text blocks; with ``exchanges``, those before each assistant turn."""
    request, source = "conv_id", "conversations"
    if exchanges:
        request, source = "conv_id || '-' || reply", "conversations JOIN ex USING (conv_id) WHERE turn < reply"
    return f"""{EXCHANGES if exchanges else ''}
m0 AS (SELECT {request} AS request_id, {tenant} AS tenant_id, CAST(turn AS INTEGER) AS msg_idx, role,
         text AS body, (conv_id + turn) % 16 AS idx,
         replace(({array(ds.PLANTS)})[((conv_id + turn) % 16) + 1], '{{n}}', CAST(conv_id AS VARCHAR)) AS plant
       FROM {source}),
{texts} AS (SELECT *, CASE WHEN idx = 15 THEN plant || ' ' || body ELSE body || ' ' || plant END AS text FROM m0),
{parts} AS (SELECT request_id, tenant_id, msg_idx, 0 AS block_idx, CASE WHEN idx = 15 THEN plant ELSE body END AS text FROM m0
           UNION ALL
           SELECT request_id, tenant_id, msg_idx, 2, CASE WHEN idx = 15 THEN body ELSE plant END FROM m0)"""


# a request for every assistant turn, and one for what comes after the last of them
EXCHANGES = """
ex AS (SELECT conv_id, turn AS reply, role = 'assistant' AS said FROM conversations WHERE role = 'assistant' UNION ALL
       SELECT conv_id, max(turn) + 1, FALSE FROM conversations GROUP BY 1 HAVING coalesce(arg_max(role, turn), '') <> 'assistant'),"""
MSG = message_tables()

LUHN = ("list_sum(list_transform(string_split(value, ''), lambda x, i: CASE WHEN (length(value) - i) % 2 = 1 "
        "THEN CASE WHEN CAST(x AS INTEGER) * 2 > 9 THEN CAST(x AS INTEGER) * 2 - 9 ELSE CAST(x AS INTEGER) * 2 END "
        "ELSE CAST(x AS INTEGER) END)) % 10 = 0")


def spans(source: str, keys: str, allowed: str = "TRUE", name: str = "spans") -> str:
    """CTEs giving keys, s, e, ptype, value; ``allowed`` may use ptype and source columns."""
    parts, claimed = [], []
    on = " AND ".join(f"c.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    for ptype, pattern in fv.PII_PATTERNS.items():
        p = lit(pattern)
        raw, got = f"{name}_{ptype}_raw", f"{name}_{ptype}"
        parts.append(f"""{raw} AS (
  SELECT {keys}, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, m[i] AS value
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT *, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g
    FROM (SELECT *, '{ptype}' AS ptype FROM {source}) WHERE {allowed})))""")
        clash = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM {other} k WHERE {on} AND k.s < c.s + length(c.value) AND c.s < k.e)"
            for other in claimed)
        check = f" AND {LUHN}" if ptype == "credit_card" else ""
        parts.append(f"{got} AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.s, c.s + length(c.value) AS e, "
                     f"'{ptype}' AS ptype, c.value FROM {raw} c WHERE TRUE{check}{clash})")
        claimed.append(got)
    union = " UNION ALL ".join(f"SELECT * FROM {c}" for c in claimed)
    return ",\n".join(parts) + f",\n{name} AS ({union})"


PLACEHOLDER = "CASE ptype " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.PII_PLACEHOLDERS.items()) + " END"


def replaced(source: str, keys: str, found: str, label: str, out: str) -> str:
    """CTE with the texts of ``source`` after replacing the spans of ``found``."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"t.{k} = r.{k}" for k in ks)
    return f"""{out}_p AS (SELECT {keys}, s, e, {label} AS label,
    coalesce(lag(e) OVER (PARTITION BY {keys} ORDER BY s), 0) AS last FROM {found}),
{out}_r AS (SELECT {', '.join('t.' + k for k in ks)},
    string_agg(substr(t.text, CAST(r.last AS BIGINT) + 1, CAST(r.s - r.last AS BIGINT)) || r.label, '' ORDER BY r.s)
      || substr(any_value(t.text), CAST(max(r.e) AS BIGINT) + 1) AS text
  FROM {source} t JOIN {out}_p r ON {on} GROUP BY {', '.join('t.' + k for k in ks)}),
{out} AS (SELECT t.* EXCLUDE (text), coalesce(r.text, t.text) AS text FROM {source} t LEFT JOIN {out}_r r ON {on})"""


def vault(source: str, found: str, out: str = "vault") -> str:
    """CTEs numbering tokens of a block table with its spans."""
    key = "msg_idx * 1000000000::BIGINT + block_idx * 10000000 + s"
    token = lit(r"\[PII_([A-Z_]+)_(\d+)\]")
    return f"""{out}_first AS (SELECT request_id, ptype, value, min({key}) AS tick FROM {found} GROUP BY ALL),
{out}_k AS (SELECT *, row_number() OVER (PARTITION BY request_id, ptype ORDER BY tick) AS k FROM {out}_first),
{out}_lit AS (SELECT request_id, lower(regexp_extract(t, {token}, 1)) AS ptype,
    CAST(regexp_extract(t, {token}, 2) AS BIGINT) AS n, msg_idx * 1000000000::BIGINT + block_idx * 10000000 AS tick
  FROM (SELECT *, unnest(regexp_extract_all(text, {token})) AS t FROM {source} b
        WHERE EXISTS (SELECT 1 FROM {found} f WHERE f.request_id = b.request_id AND f.msg_idx = b.msg_idx AND f.block_idx = b.block_idx))),
{out}_lift AS (SELECT l.request_id, l.ptype, l.tick, l.n - (SELECT count(*) FROM {out}_first f
    WHERE f.request_id = l.request_id AND f.ptype = l.ptype AND f.tick < l.tick) AS up FROM {out}_lit l),
{out} AS (SELECT request_id, ptype, value, '[PII_' || upper(ptype) || '_' || (k + greatest(0, coalesce((
    SELECT max(up) FROM {out}_lift l WHERE l.request_id = v.request_id AND l.ptype = v.ptype AND l.tick <= v.tick), 0))) || ']' AS token
  FROM {out}_k v)"""


ALL_VAULT = f"{MSG},\n{spans('blocks', 'request_id, msg_idx, block_idx')},\n{vault('blocks', 'spans')}"

# --- injection ---------------------------------------------------------------------

FULL = "".join(chr(0xFF41 + i) for i in range(26))
FOLD_FROM = FULL + "　" + fv.HOMOGLYPHS_FROM
FOLD_TO = "abcdefghijklmnopqrstuvwxyz " + fv.HOMOGLYPHS_TO


def normalised(text: str) -> str:
    gone = "[" + fv.INVISIBLE + fv.BIDI + "]"
    return rf"regexp_replace(translate(regexp_replace({text}, '{gone}', '', 'g'), '{FOLD_FROM}', '{FOLD_TO}'), '\s+', ' ', 'g')"


def hits(text: str) -> str:
    return "[" + ", ".join(f"CASE WHEN {rx(text, p, 'i')} THEN {w} ELSE 0.0 END" for _, w, p in fv.SIGNATURES) + "]"


CATS = list(dict.fromkeys(c for c, _, _ in fv.SIGNATURES))


def categories(mask: str) -> str:
    items = []
    for cat in CATS:
        ids = [i + 1 for i, (c, _, _) in enumerate(fv.SIGNATURES) if c == cat]
        items.append("CASE WHEN " + " + ".join(f"{mask}[{i}]" for i in ids) + f" > 0 THEN '{cat}' END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def scored(source: str, keys: str, out: str = "inj") -> str:
    """CTEs with score, reasons and categories of each text of ``source``."""
    on = " AND ".join(f"b.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    return f"""{out}_n AS MATERIALIZED (SELECT *, {normalised('text')} AS norm FROM {source}),
{out}_b AS (SELECT {keys}, i, TRY(decode(from_base64(blob))) AS payload FROM (
    SELECT {keys}, unnest(range(1, len(bs) + 1)) AS i, unnest(bs) AS blob FROM (
      SELECT {keys}, regexp_extract_all(norm, '[A-Za-z0-9+/]{{24,}}={{0,2}}') AS bs FROM {out}_n))),
{out}_bs AS (SELECT {keys}, arg_min(sc, i) AS blob FROM (
    SELECT {keys}, i, list_sum({hits(normalised('payload'))}) AS sc FROM {out}_b
    WHERE payload IS NOT NULL AND payload <> '' AND NOT regexp_matches(payload, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) WHERE sc > 0 GROUP BY {keys}),
{out}_h AS MATERIALIZED (SELECT n.*, {hits('norm')} AS plain, {hits("translate(norm, '013457@$!', 'oieastasi')")} AS leet, b.blob
    FROM {out}_n n LEFT JOIN {out}_bs b ON {on}),
{out}_c AS (SELECT *, {categories('plain')} AS cats, {categories('leet')} AS leet_cats,
    {rx('text', '[' + fv.BIDI + ']')} AS bidi, {rx('text', fv.ZERO_WIDTH_IN_WORD_PATTERN)} AS spliced FROM {out}_h),
{out}_d AS (SELECT *, list_filter(leet_cats, lambda c: NOT list_contains(cats, c)) AS fresh FROM {out}_c),
{out} AS (SELECT *, CAST(list_sum(plain) + CASE WHEN len(fresh) > 0 THEN list_sum(leet) ELSE 0 END
      + CASE WHEN blob IS NOT NULL THEN greatest(blob, 1.0) ELSE 0 END + CASE WHEN bidi THEN 0.5 ELSE 0 END
      + CASE WHEN spliced THEN 0.5 ELSE 0 END AS DOUBLE) AS score,
    array_to_string(list_concat(list_concat(cats, list_transform(fresh, lambda c: c || ' (leetspeak)')), list_filter([
      CASE WHEN blob IS NOT NULL THEN 'base64-encoded payload' END,
      CASE WHEN bidi THEN 'bidirectional control characters' END,
      CASE WHEN spliced THEN 'zero-width characters inside words' END], lambda x: x IS NOT NULL)), ', ') AS reasons FROM {out}_d)"""


def input_rules(messages: str, block_table: str) -> str:
    """CTE ``verdict``: first blocking check of each request, by the tenants' rules."""
    def topic(t: str) -> str:
        return rx("full_text", rf"\b{t}\b", "i")
    return f"""users AS (SELECT * FROM {messages} WHERE role = 'user'),
{scored('users', 'request_id, msg_idx')},
v_inj AS (SELECT request_id, arg_min('Prompt injection attempt detected (' || reasons || ')', msg_idx) AS reason FROM inj
    WHERE (tenant_id = 't2' AND score >= 0.5) OR (tenant_id NOT IN ('t1', 't2') AND score >= 1.0) GROUP BY 1),
v_full AS (SELECT request_id, any_value(tenant_id) AS tenant_id, string_agg(text, ' ' ORDER BY msg_idx) AS full_text FROM {messages} GROUP BY 1),
v_top AS (SELECT request_id, 'Request mentions blocked topic: ''' || topic || '''' AS reason FROM (
    SELECT request_id, CASE WHEN tenant_id = 't1' AND {topic('class action')} THEN 'class action'
      WHEN tenant_id IN ('t1', 't2') AND {topic('competitor')} THEN 'competitor'
      WHEN tenant_id IN ('t1', 't2') AND {topic('lawsuit')} THEN 'lawsuit' END AS topic FROM v_full) WHERE topic IS NOT NULL),
{spans(block_table, 'request_id, msg_idx, block_idx', "tenant_id = 't1' AND ptype IN ('email', 'ssn')", 'vs')},
v_pii AS (SELECT request_id, 'Request contains PII: ' || string_agg(DISTINCT ptype, ', ' ORDER BY ptype) AS reason FROM vs GROUP BY 1),
verdict AS (SELECT f.request_id, f.tenant_id, coalesce(i.reason, t.reason, p.reason) IS NOT NULL AS blocked,
    CASE WHEN i.reason IS NOT NULL THEN 'prompt_injection' WHEN t.reason IS NOT NULL THEN 'topic_filter'
         WHEN p.reason IS NOT NULL THEN 'pii' END AS guardrail, coalesce(i.reason, t.reason, p.reason) AS reason,
    i.reason AS inj_reason, t.reason AS topic_reason, p.reason AS pii_reason
  FROM v_full f LEFT JOIN v_inj i USING (request_id) LEFT JOIN v_top t USING (request_id) LEFT JOIN v_pii p USING (request_id))"""


# --- responses -----------------------------------------------------------------------

RESP = f"""
r0 AS (SELECT conv_id || '-' || turn AS request_id, conv_id, turn, 't' || (conv_id % 4) AS tenant_id, coalesce(({array(ds.REPLIES)})[(conv_id % 6) + 1], text) AS first,
         text AS second, CAST(conv_id % 50 AS BIGINT) AS prompt_tokens, CAST(length(text) AS BIGINT) AS completion_tokens FROM conversations WHERE role = 'assistant'),
r1 AS (SELECT request_id, conv_id, tenant_id, 0 AS choice_idx, first AS text FROM r0 UNION ALL SELECT request_id, conv_id, tenant_id, 1, second FROM r0)"""


def restored(source: str, keys: str, tokens, table: str = "vault") -> str:
    expr = "text"
    for t in tokens:
        value = f"(SELECT any_value(value) FROM {table} v WHERE v.request_id = s.request_id AND v.token = '{t}')"
        expr = f"replace({expr}, '{t}', coalesce({value}, '{t}'))"
    return f"SELECT {keys}, {expr} AS text FROM {source} s"


def schema_check(body: str, key: str, kind_rules: str) -> str:
    """Reason for a JSON body against one required key and a list of typed keys."""
    return f"""CASE WHEN NOT coalesce(json_valid({body}), FALSE) THEN 'Response is not valid JSON (schema validation required)'
      WHEN json_type({body}) <> 'OBJECT' THEN 'expected object at root'
      WHEN json_type({body}, '$.{key}') IS NULL THEN 'missing required field: ''{key}''' {kind_rules} END"""


def typed(body: str, key: str, kind: str) -> str:
    ok = {"integer": "('BIGINT', 'UBIGINT', 'BOOLEAN')", "string": "('VARCHAR')"}[kind]
    return f"WHEN json_type({body}, '$.{key}') NOT IN {ok} THEN 'field ''{key}'' expected type {kind}'"


MODEL_FLAGS = ("array_to_string(list_filter([CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 0 THEN 'low_quality' END], "
               "lambda x: x IS NOT NULL), ', ')")
MODEL_SCORE = "(l.toxic * 0.5 + (1 - l.quality) * 0.25)"
BY_FLAGS = f"CASE WHEN l.toxic = 1 THEN 'Content flagged by moderation API: ' || {MODEL_FLAGS} END"
BY_SCORE = f"CASE WHEN {MODEL_SCORE} >= 0.5 THEN 'Content flagged as toxic (score: ' || printf('%.2f', CAST({MODEL_SCORE} AS DOUBLE)) || ', threshold: 0.5)' END"
WORDS = "(" + " OR ".join(rx("text", p, "i") for p in fv.TOXICITY_PATTERNS) + ")"


def output_rules(source: str) -> str:
    """CTE ``outv``: output verdict of each request from restored choices."""
    length = ("CASE WHEN tenant_id NOT IN ('t1', 't2') AND length(text) > 900 "
              "THEN 'Response exceeds max length (' || length(text) || ' > 900 chars)' END")
    schema = schema_check("text", "name", typed("text", "name", "string") + " " + typed("text", "age", "integer"))
    return f"""o1 AS (SELECT s.*, coalesce({length}, CASE WHEN tenant_id = 't2' THEN {schema} END) AS error,
    CASE WHEN choice_idx = 0 AND text <> '' THEN CASE tenant_id WHEN 't1' THEN {BY_FLAGS} WHEN 't2' THEN {BY_SCORE}
      ELSE CASE WHEN {WORDS} THEN 'Response contains toxic content' END END END AS tox
  FROM {source} s LEFT JOIN labels l ON l.doc_id = s.conv_id),
outv AS (SELECT request_id, coalesce(error, tox) IS NOT NULL AS blocked,
    CASE WHEN error IS NOT NULL THEN 'output_validator' WHEN tox IS NOT NULL THEN 'toxicity' END AS guardrail, coalesce(error, tox) AS reason
  FROM (SELECT request_id, arg_min(error, choice_idx) FILTER (WHERE error IS NOT NULL) AS error, max(tox) AS tox FROM o1 GROUP BY 1))"""


# --- audit and limits -------------------------------------------------------------------

AUDIT = """
log AS (SELECT event_id AS id, ts, event_type AS tenant_id, CASE WHEN event_id % 3 = 0 THEN 'anthropic' ELSE 'openai' END AS api,
    CASE event_id % 10 WHEN 0 THEN 'input_blocked' WHEN 1 THEN 'output_blocked' WHEN 2 THEN 'rate_limited' ELSE 'passed' END AS outcome,
    CASE WHEN event_id % 10 <= 2 THEN 'reason ' || (event_id % 7) END AS reason,
    CASE WHEN event_id % 10 > 2 THEN CAST(floor(value * 10) AS BIGINT) END AS prompt_tokens,
    CASE WHEN event_id % 10 > 2 THEN CAST(floor(value * 3) AS BIGINT) END AS completion_tokens FROM events)"""
RECENT = f"recent AS (SELECT * FROM log WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)"
SUMS = ("count(*) AS requests, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS input_tokens, "
        "CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS output_tokens, "
        "CAST(coalesce(sum(prompt_tokens), 0) + coalesce(sum(completion_tokens), 0) AS BIGINT) AS total_tokens")
STATS = ("count(*) AS total_requests, count(*) FILTER (WHERE outcome <> 'passed') AS blocked_requests, "
         "CASE WHEN count(*) = 0 THEN 100.0 ELSE round(CAST(count(*) FILTER (WHERE outcome = 'passed') AS DOUBLE) / count(*) * 100, 1) END AS pass_rate")


def limiter(source: str) -> str:
    """CTEs ``lim(request_id, tenant_id, tick, limited, reason, retry_after)`` by recursion.

    ``source`` has request_id, tenant_id, tick (microseconds), rpm and rph.
    """
    return f"""lq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY tick, request_id) AS n FROM {source}),
lw AS (SELECT tenant_id, 0::BIGINT AS n, min(request_id) AS request_id, 0::BIGINT AS tick, NULL::INTEGER AS rpm, NULL::INTEGER AS rph,
         []::BIGINT[] AS seen, []::BIGINT[] AS seen_m, FALSE AS over_m, FALSE AS over_h FROM lq GROUP BY 1
  UNION ALL
  SELECT q.tenant_id, q.n, q.request_id, q.tick, q.rpm, q.rph,
    CASE WHEN om OR oh THEN h ELSE list_append(h, q.tick) END, m, om, oh
  FROM (SELECT q.tenant_id, q.n, q.request_id, q.tick, q.rpm, q.rph, h, m,
      q.rpm IS NOT NULL AND len(m) >= q.rpm AS om,
      NOT (q.rpm IS NOT NULL AND len(m) >= q.rpm) AND q.rph IS NOT NULL AND len(h) >= q.rph AS oh
    FROM (SELECT q.*, h, list_filter(h, lambda x: x >= q.tick - 60000000) AS m FROM (
      SELECT q.*, list_filter(CASE WHEN w.n = 0 OR w.over_m OR w.over_h THEN w.seen ELSE w.seen END, lambda x: x >= q.tick - 3600000000) AS h
      FROM lw w JOIN lq q ON q.tenant_id = w.tenant_id AND q.n = w.n + 1) q) q) q),
lim AS (SELECT tenant_id, request_id, tick, over_m OR over_h AS limited,
    CASE WHEN over_m THEN 'Rate limit exceeded: ' || rpm || ' requests per minute'
         WHEN over_h THEN 'Rate limit exceeded: ' || rph || ' requests per hour' END AS reason,
    CAST(CASE WHEN over_m AND rpm = 0 THEN 60 WHEN over_m THEN greatest(1, (seen_m[1] + 60000000 - tick) // 1000000 + 1)
         WHEN over_h AND rph = 0 THEN 3600 WHEN over_h THEN greatest(1, (seen[1] + 3600000000 - tick) // 1000000 + 1) END AS INTEGER) AS retry_after
  FROM lw WHERE n > 0)"""


LIMIT_ROWS = ", ".join(
    f"('{t}', {'NULL' if not on or m is None else m}::INTEGER, {'NULL' if not on or h is None else h}::INTEGER)" for t, on, m, h in ds.LIMITS)
TRAFFIC = f"""lt(tenant_id, rpm, rph) AS (VALUES {LIMIT_ROWS}),
tq AS (SELECT event_id AS request_id, event_type AS tenant_id, epoch_us(ts) AS tick, rpm, rph FROM events JOIN lt ON event_type = tenant_id)"""

# --- streams ----------------------------------------------------------------------------

W = ds.STREAM_WIDTH
def slices(texts: str, out: str = "cs") -> str:
    """CTE of the deltas of texts (stream_id, num, tenant_id, text, done) with the length up to each."""
    return f"""{out} AS MATERIALIZED (SELECT stream_id, num, tenant_id, text, i AS seq, substr(text, i * {W} + 1, {W}) AS delta, least((i + 1) * {W}, length(text)) AS total
    FROM (SELECT *, unnest(range(0, (length(text) - 1) // {W} + 1)) AS i FROM {texts}))"""


CHUNKS = f"""
ct AS MATERIALIZED (SELECT doc_id AS stream_id, doc_id AS num, 't' || (doc_id % 4) AS tenant_id, left(text, greatest(0, CAST(length(text) - doc_id % 30 AS BIGINT)))
    || CASE doc_id % 5 WHEN 0 THEN ' just go die now' WHEN 1 THEN ' mail [PII_EMAIL_1] or [PII_EMAIL_7] [PII_' ELSE '' END
    || right(text, CAST(doc_id % 30 AS BIGINT)) AS text, doc_id % 7 <> 0 AS done FROM documents WHERE length(text) > 0),
{slices('ct')}"""


def length_cut(source: str = "cs", out: str = "lc") -> str:
    return f"""{out} AS (SELECT stream_id, min(seq) AS seq, 'Response exceeds max length (' || min(total) || ' > 900 chars)' AS reason
    FROM {source} WHERE tenant_id NOT IN ('t1', 't2') AND total > 900 GROUP BY 1)"""


def word_cut(source: str = "cs", out: str = "wc") -> str:
    return f"""{out} AS (SELECT stream_id, min(seq) AS seq, 'Response contains toxic content' AS reason FROM (
    SELECT stream_id, seq, left(text, total) AS text FROM {source} WHERE tenant_id NOT IN ('t1', 't2')) WHERE {WORDS} GROUP BY 1)"""


LENGTH_CUT, WORD_CUT = length_cut(), word_cut()


def check_points(source: str, out: str = "cp") -> str:
    return f"""{out} AS (SELECT stream_id, 0::BIGINT AS last, -1::BIGINT AS seq FROM {source} GROUP BY 1
    UNION ALL
    SELECT n.stream_id, min(n.total), min(n.seq) FROM {out} p JOIN {source} n ON n.stream_id = p.stream_id AND n.total >= p.last + 500 GROUP BY n.stream_id)"""


def stream_verdicts(texts: str, source: str, x: str = "") -> str:
    """CTE ``{x}sv(stream_id, tenant_id, outcome, guardrail, reason, cut_seq)``: first violation of each stream."""
    return f"""{length_cut(source, x + 'lc')}, {word_cut(source, x + 'wc')}, {x}ms AS (SELECT * FROM {source} WHERE tenant_id IN ('t1', 't2')), {check_points(x + 'ms', x + 'cp')},
{x}mc AS (SELECT stream_id, min(seq) AS seq, arg_min(reason, seq) AS reason FROM (SELECT p.stream_id, p.seq, CASE WHEN tenant_id = 't1' THEN
      CASE WHEN (num + p.seq) % 9 = 0 THEN 'Content flagged by moderation API: harm' END
    WHEN ((num + p.seq) % 8) / 10.0 >= 0.5 THEN 'Content flagged as toxic (score: ' || printf('%.2f', CAST(((num + p.seq) % 8) / 10.0 AS DOUBLE)) || ', threshold: 0.5)' END AS reason
    FROM {x}cp p JOIN {x}ms m ON m.stream_id = p.stream_id AND m.seq = p.seq) WHERE reason IS NOT NULL GROUP BY 1),
{x}sf AS (SELECT *, 0 AS rank FROM {x}lc UNION ALL SELECT *, 1 FROM {x}wc UNION ALL SELECT *, 1 FROM {x}mc),
{x}sx AS (SELECT stream_id, arg_min(seq, seq * 2 + rank) AS seq, arg_min(rank, seq * 2 + rank) AS rank, arg_min(reason, seq * 2 + rank) AS reason FROM {x}sf GROUP BY 1),
{x}sv AS (SELECT c.stream_id, c.tenant_id, CASE WHEN v.seq IS NOT NULL THEN 'output_blocked' WHEN c.done THEN 'passed' END AS outcome,
  CASE v.rank WHEN 0 THEN 'output_validator' WHEN 1 THEN 'toxicity' END AS guardrail, v.reason, v.seq AS cut_seq FROM {texts} c LEFT JOIN {x}sx v USING (stream_id))"""


# --- plans --------------------------------------------------------------------------------

HISTORY = """
be AS (SELECT epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 AS tick, o_custkey AS cust, o_orderkey AS id, o_orderkey % 6 AS k,
    (['starter', 'growth', 'gold'])[(o_orderkey % 3) + 1] AS plan, (['open', 'past_due', 'active', 'unpaid', 'paid'])[(o_orderkey % 5) + 1] AS status,
    o_orderkey % 5 AS attempt FROM orders),
mv AS (SELECT cust, tick, id, CASE WHEN k IN (0, 5) AND plan <> 'gold' THEN plan WHEN k IN (1, 4) THEN 'free'
    WHEN k = 2 AND status IN ('past_due', 'unpaid') THEN 'free' WHEN k = 3 AND status = 'open' AND attempt >= 3 THEN 'free' END AS plan FROM be),
mg AS (SELECT CAST(cust AS VARCHAR) AS user_id, tick, arg_max(plan, id) AS plan FROM mv JOIN customer ON c_custkey = cust WHERE plan IS NOT NULL GROUP BY 1, 2),
ml AS (SELECT *, lag(plan) OVER (PARTITION BY user_id ORDER BY tick) AS prev FROM mg),
hist AS (SELECT user_id, plan, tick AS valid_from, lead(tick) OVER (PARTITION BY user_id ORDER BY tick) AS valid_to FROM ml WHERE prev IS NULL OR prev <> plan)"""
PLAN_ROWS = ", ".join(f"('{n}', {p}, {m}, {a}, {h})" for n, p, m, a, h in fv.PLANS)


def oracle_queries() -> dict[str, str]:
    doc_spans = spans("documents", "doc_id")
    sql = {}
    sql["message_text"] = f"WITH {MSG} SELECT request_id, msg_idx, text FROM mt"
    sql["user_messages"] = f"WITH {MSG} SELECT request_id, msg_idx, tenant_id FROM mt WHERE role = 'user'"
    sql["mapped_text"] = f"WITH {MSG} SELECT request_id, msg_idx, 3 AS blocks, translate(text, 'aeiou', 'AEIOU') AS text FROM mt"
    sql["bearer_token"] = "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'k' || user_id END AS token FROM events"
    sql["message_preview"] = (f"WITH {MSG} SELECT request_id, arg_max(left(CASE WHEN idx = 15 THEN plant ELSE body END, 200), msg_idx) "
                              "AS message_preview FROM mt GROUP BY 1")
    sql["pii_spans"] = f"WITH {doc_spans} SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, ptype, value FROM spans"
    sql["pii_cards"] = f"WITH {doc_spans} SELECT doc_id, CAST(s AS INTEGER) AS s, value FROM spans WHERE ptype = 'credit_card'"
    sql["pii_redact"] = f"WITH {doc_spans}, {replaced('documents', 'doc_id', 'spans', PLACEHOLDER, 'done')} SELECT doc_id, text FROM done"
    some = spans("documents", "doc_id", "ptype = 'email' AND doc_id % 2 = 0 OR ptype IN ('phone', 'credit_card') AND doc_id % 2 = 1")
    sql["pii_redact_some"] = f"WITH {some}, {replaced('documents', 'doc_id', 'spans', PLACEHOLDER, 'done')} SELECT doc_id, text FROM done"
    sql["pii_profile"] = f"WITH {doc_spans} SELECT ptype, count(*) AS matches, count(DISTINCT doc_id) AS texts FROM spans GROUP BY 1"
    rules = f"{MSG}, {input_rules('mt', 'blocks')}"
    sql["pii_block"] = f"WITH {rules} SELECT request_id, pii_reason IS NOT NULL AS blocked, pii_reason AS reason FROM verdict"
    sql["pii_vault"] = f"WITH {ALL_VAULT} SELECT request_id, token, ptype, value FROM vault"
    token_spans = "ts AS (SELECT s.*, v.token FROM spans s JOIN vault v USING (request_id, ptype, value))"
    sql["pii_tokenize"] = (f"WITH {ALL_VAULT}, {token_spans}, {replaced('blocks', 'request_id, msg_idx, block_idx', 'ts', 'token', 'done')} "
                           "SELECT request_id, msg_idx, block_idx, text FROM done")
    prompt = "'Mail admin' || conv_id || '@example.net or user' || conv_id || '@example.com, call 555-867-5309 ' || text"
    system = (f"sys AS (SELECT conv_id AS request_id, 2147483647 AS msg_idx, 0 AS block_idx, {prompt} AS text FROM (SELECT conv_id, arg_min(text, turn) AS text "
              "FROM conversations GROUP BY 1)), every AS (SELECT request_id, msg_idx, block_idx, text FROM blocks UNION ALL SELECT * FROM sys)")
    sql["pii_system_prompt"] = (
        f"WITH {MSG}, {system},\n{spans('every', 'request_id, msg_idx, block_idx')},\n{vault('every', 'spans')}, {token_spans}, "
        f"{replaced('every', 'request_id, msg_idx, block_idx', 'ts', 'token', 'done')} SELECT request_id, text FROM done WHERE msg_idx = 2147483647")
    tokens = ["[PII_EMAIL_1]", "[PII_EMAIL_2]", "[PII_EMAIL_3]", "[PII_PHONE_1]"]
    sql["pii_restore"] = (f"WITH {ALL_VAULT}, q AS (SELECT conv_id AS request_id, turn AS msg_idx, text || ' {' '.join(tokens)} [PII_X_1]' AS text "
                          f"FROM conversations) {restored('q', 'request_id, msg_idx', tokens)}")
    user_scores = f"{MSG}, users AS (SELECT * FROM mt WHERE role = 'user'), {scored('users', 'request_id, msg_idx')}"
    sql["injection_score"] = f"WITH {user_scores} SELECT request_id, msg_idx, score, reasons FROM inj"
    sql["injection_documents"] = (f"WITH {scored('documents', 'doc_id')} SELECT source, sum(score) AS score, "
                                  "count(*) FILTER (WHERE score >= 1) AS blocked, count(*) AS documents FROM inj GROUP BY 1")
    sql["injection_block"] = f"WITH {rules} SELECT request_id, inj_reason IS NOT NULL AS blocked, inj_reason AS reason FROM verdict"
    sql["injection_profile"] = (f"WITH {user_scores} SELECT tenant_id, category, count(*) AS messages FROM "
                                "(SELECT tenant_id, unnest(cats) AS category FROM inj) GROUP BY 1, 2")
    sql["base64_payloads"] = (
        f"WITH {MSG}, b AS (SELECT request_id, msg_idx, unnest(range(0, len(bs))) AS i, unnest(bs) AS blob FROM (SELECT request_id, msg_idx, "
        "regexp_extract_all(text, '[A-Za-z0-9+/]{24,}={0,2}') AS bs FROM mt)), d AS (SELECT *, TRY(decode(from_base64(blob))) AS payload FROM b) "
        "SELECT request_id, msg_idx, CAST(row_number() OVER (PARTITION BY request_id, msg_idx ORDER BY i) - 1 AS INTEGER) AS n, payload FROM d "
        "WHERE payload IS NOT NULL AND payload <> '' AND NOT regexp_matches(payload, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')")
    sql["topic_block"] = f"WITH {rules} SELECT request_id, topic_reason IS NOT NULL AS blocked, topic_reason AS reason FROM verdict"
    sql["input_verdicts"] = f"WITH {rules} SELECT request_id, tenant_id, blocked, guardrail, reason FROM verdict"
    strangers = message_tables("'stranger' || (conv_id % 3)")
    sql["input_verdicts_unlisted"] = (f"WITH {strangers}, {input_rules('mt', 'blocks')} "
                                      "SELECT request_id, tenant_id, blocked, guardrail, reason FROM verdict")
    sql["normalized_text"] = f"WITH {MSG} SELECT request_id, msg_idx, {normalised('text')} AS text FROM mt"
    sql["output_max_length"] = ("SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 'Response exceeds max length (' || length(text) || ' > 300 chars)' END "
                                "AS reason FROM conversations")
    body = ("CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props || ' tail' WHEN 2 THEN '{\"k\": \"' || event_type || '\"}' WHEN 3 THEN '[' || props || ']' "
            "WHEN 4 THEN '{\"j\": ' || user_id || '}' ELSE '{\"k\": ' || user_id || '.0, \"v\": null}' END")
    rule = schema_check("body", "k", typed("body", "k", "integer") + " " + typed("body", "v", "string"))
    odd = array(["field 'k' expected type integer", "field 'k' expected type integer", None, "field 'k' expected type integer",
                 "Response is not valid JSON (schema validation required)", "Response is not valid JSON (schema validation required)"])
    sql["output_json_schema"] = (f"WITH b AS (SELECT event_id, {body} AS body FROM events) SELECT event_id, "
                                 f"CASE WHEN event_id % 11 = 0 THEN ({odd})[(event_id // 11) % 6 + 1] ELSE {rule} END AS reason FROM b")
    sql["toxicity_wordlist"] = f"WITH {MSG} SELECT request_id, msg_idx, {WORDS} AS toxic FROM mt"
    labels = "FROM documents d LEFT JOIN labels l USING (doc_id)"
    spoken = "doc_id % 5 <> 0 AND text <> ''"
    sql["toxicity_labels"] = f"SELECT d.doc_id AS request_id, CASE WHEN {spoken} THEN {BY_FLAGS} END AS reason {labels}"
    tie = f"({ds.TIES}::DOUBLE[])[doc_id % {len(ds.TIES)} + 1]"
    sql["toxicity_threshold"] = (f"SELECT d.doc_id AS request_id, CASE WHEN {spoken} AND {MODEL_SCORE} IS NOT NULL AND {tie} >= 0.1 THEN "
                                 f"'Content flagged as toxic (score: ' || printf('%.2f', {tie}) || ', threshold: 0.1)' END AS reason {labels}")
    reply_tokens = ["[PII_EMAIL_1]", "[PII_EMAIL_2]", "[PII_EMAIL_9]"]
    before = message_tables(exchanges=True)
    replies = (f"{before},\n{spans('blocks', 'request_id, msg_idx, block_idx')},\n{vault('blocks', 'spans')}, {RESP}, "
               f"r2 AS ({restored('r1', 'request_id, conv_id, tenant_id, choice_idx', reply_tokens)})")
    sql["restored_responses"] = f"WITH {replies} SELECT request_id, choice_idx, text FROM r2"
    sql["output_verdicts"] = f"WITH {replies}, {output_rules('r2')} SELECT request_id, blocked, guardrail, reason FROM outv"
    several = ("sb AS (SELECT request_id || '-' || msg_idx AS request_id, request_id AS conv_id, tenant_id, 0 AS choice_idx, text FROM mt WHERE role = 'assistant')")
    sql["output_blocks"] = f"WITH {MSG}, {several}, {output_rules('sb')} SELECT request_id, blocked, guardrail, reason FROM outv"
    rewritten = f"""{{rules}}, live AS (SELECT b.* FROM {{blocks}} b JOIN verdict v USING (request_id) WHERE NOT v.blocked),
{spans('live', 'request_id, msg_idx, block_idx', "tenant_id <> 't1'", 'ls')},
tlive AS (SELECT * FROM live WHERE tenant_id = 't0'), tspans AS (SELECT s.* FROM ls s JOIN (SELECT DISTINCT request_id FROM tlive) USING (request_id)),
{vault('tlive', 'tspans', 'tv')},
labels2 AS (SELECT s.*, coalesce(v.token, {PLACEHOLDER}) AS label FROM ls s LEFT JOIN tv v USING (request_id, ptype, value)),
{replaced('live', 'request_id, msg_idx, block_idx', 'labels2', 'label', 'fwd')}"""
    plain_rewrite = rewritten.replace("{rules}", rules).replace("{blocks}", "blocks")
    sql["forwarded_messages"] = (f"WITH {plain_rewrite} SELECT request_id, msg_idx, string_agg(text, ' ' ORDER BY block_idx) AS text "
                                 "FROM fwd GROUP BY 1, 2")

    # the cascade: resolved tenants, limiter, input checks, output checks, cap
    tenant = ("CASE WHEN n % 11 = 0 THEN 't0' WHEN n % 13 = 0 OR n % 4 = 3 THEN NULL ELSE 't' || (n % 4) END")
    sql["resolve_tenant"] = (f"SELECT n AS request_id, {tenant} AS tenant_id, ({tenant}) IS NULL AS rejected FROM (SELECT DISTINCT conv_id AS n FROM conversations)")
    sql["resolve_tenant_open"] = ("SELECT n AS request_id, CASE WHEN n % 11 = 0 THEN 't0' WHEN n % 2 = 0 THEN 'default' ELSE 't7' END AS tenant_id, "
                                  "FALSE AS rejected FROM (SELECT DISTINCT conv_id AS n FROM conversations)")
    cascade_msg = message_tables(texts="mt_all", parts="blocks_all", exchanges=True)
    req = f"""rq AS MATERIALIZED (SELECT n || '-' || reply AS request_id, {tenant} AS tenant_id, CASE WHEN n % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS api,
    1704067200000000 + n * 20000000 + reply * 1000000 AS tick, n AS conv_id, n + reply AS num, reply % 3 = 0 AS stream,
    CASE WHEN {tenant} = 't0' THEN 1 END::INTEGER AS rpm, CASE WHEN {tenant} = 't0' THEN 20 END::INTEGER AS rph
  FROM (SELECT conv_id AS n, reply FROM ex) WHERE {tenant} IS NOT NULL),
{limiter('rq')},
alive AS MATERIALIZED (SELECT r.request_id, r.tenant_id, r.stream, r.num FROM rq r JOIN lim l USING (request_id) WHERE NOT l.limited),
mt AS MATERIALIZED (SELECT m.* REPLACE (a.tenant_id AS tenant_id) FROM mt_all m JOIN alive a USING (request_id)),
blocks AS MATERIALIZED (SELECT b.* REPLACE (a.tenant_id AS tenant_id) FROM blocks_all b JOIN alive a USING (request_id))"""
    streams = f"""xt AS MATERIALIZED (SELECT request_id AS stream_id, a.num, a.tenant_id, repeat(second, CAST(conv_id % 4 + 1 AS BIGINT)) || coalesce(({array(ds.REPLIES)})[(conv_id % 6) + 1], '') AS text,
    turn % 7 <> 0 AS done FROM r0 JOIN alive a USING (request_id) WHERE a.stream),
{slices('xt', 'xs')}, {stream_verdicts('xt', 'xs', 'x')}"""
    tail = f"""{RESP}, {streams}, ra AS (SELECT r.* REPLACE (a.tenant_id AS tenant_id) FROM r1 r JOIN alive a USING (request_id) WHERE NOT a.stream),
r2 AS ({restored('ra', 'request_id, conv_id, tenant_id, choice_idx', reply_tokens, 'tv')}), {output_rules('r2')},
ov AS (SELECT request_id, blocked, guardrail, reason FROM outv UNION ALL
       SELECT stream_id, outcome = 'output_blocked', guardrail, reason FROM xsv WHERE outcome IS NOT NULL),
st AS (SELECT r.*, l.limited, l.reason AS lim_reason, v.blocked AS inb, v.guardrail AS ing, v.reason AS inr, o.blocked AS outb, o.guardrail AS outg,
    o.reason AS outr, CASE WHEN NOT r.stream THEN u.prompt_tokens END AS pt, CASE WHEN NOT r.stream THEN u.completion_tokens END AS ct,
    NOT l.limited AND NOT coalesce(v.blocked, FALSE) AND o.blocked IS NOT NULL AND NOT o.blocked AS ok
  FROM rq r JOIN lim l USING (request_id) LEFT JOIN verdict v USING (request_id) LEFT JOIN ov o USING (request_id) LEFT JOIN r0 u USING (request_id)),
cap AS (SELECT *, tenant_id = 't0' AND NOT limited AND coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY tenant_id ORDER BY tick, request_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 5 AS capped FROM st),
fin AS (SELECT *, CASE WHEN limited OR capped THEN 'rate_limited' WHEN inb THEN 'input_blocked' WHEN outb THEN 'output_blocked' WHEN ok THEN 'passed' END AS outcome FROM cap)
SELECT request_id, tenant_id, api, outcome, CASE WHEN NOT limited AND NOT capped THEN CASE WHEN inb THEN ing WHEN outb THEN outg END END AS guardrail,
  CASE WHEN limited THEN lim_reason WHEN capped THEN 'Monthly request limit reached (5 requests). Upgrade your plan to continue.'
       WHEN inb THEN inr WHEN outb THEN outr END AS reason,
  CASE WHEN outcome = 'passed' THEN pt END AS prompt_tokens, CASE WHEN outcome = 'passed' THEN ct END AS completion_tokens{{more}}
FROM fin WHERE outcome IS NOT NULL"""
    cascade_rules = f"{cascade_msg}, {req}, {input_rules('mt', 'blocks')}"
    outcomes = f"WITH RECURSIVE {rewritten.replace('{rules}', cascade_rules).replace('{blocks}', 'blocks')}, {tail}"
    sql["request_outcomes"] = outcomes.replace("{more}", "")
    sql["cascade_audit"] = f"""WITH newest AS ({outcomes.replace("{more}", ", tick")} AND api = 'openai' ORDER BY tick DESC, request_id DESC LIMIT 500)
SELECT o.request_id, o.tenant_id, o.outcome, o.reason, m.messages FROM newest o
LEFT JOIN (WITH {before} SELECT request_id, string_agg(role || ': ' || text, chr(10) ORDER BY msg_idx) AS messages FROM mt GROUP BY 1) m USING (request_id)"""
    sql["cascade_alerts"] = f"""WITH o AS ({outcomes.replace("{more}", ", capped")}),
m AS (WITH {before} SELECT request_id, arg_max(left(CASE WHEN idx = 15 THEN plant ELSE body END, 200), msg_idx) AS preview FROM mt
      WHERE CASE WHEN idx = 15 THEN plant ELSE body END <> '' GROUP BY 1)
SELECT request_id, outcome AS event, tenant_id, api, 'https://hooks.example.com/' || tenant_id AS url, guardrail, reason, coalesce(preview, '') AS message_preview
FROM o LEFT JOIN m USING (request_id) WHERE NOT capped AND ((tenant_id = 't0' AND outcome IN ('input_blocked', 'rate_limited')) OR (tenant_id = 't1' AND outcome <> 'passed'))"""
    alert = (f"WITH {AUDIT} SELECT id AS request_id, outcome AS event, 't' || (id % 4) AS tenant_id, api, 'https://hooks.example.com/t' || (id % 4) AS url, "
             "reason, tenant_id AS preview FROM log WHERE (id % 4 = 0 AND outcome IN ('input_blocked', 'rate_limited')) OR (id % 4 = 1 AND outcome <> 'passed')")
    sql["alerts"] = alert
    pad = b"secret".ljust(64, b"\0")
    inner, outer = (bytes(b ^ mask for b in pad).hex() for mask in (0x36, 0x5C))
    digits = "rtrim(substr(tick, 2), '0')"
    sql["signed_alerts"] = f"""{alert.replace(" SELECT id AS request_id", ", a AS (SELECT CAST(epoch_us(ts) AS VARCHAR) AS tick, id AS request_id", 1)}),
p AS (SELECT request_id, '{{"event":"' || event || '","tenant_id":"' || tenant_id || '","api":"' || api || '","guardrail":null,"reason":"' || reason
    || '","timestamp":' || left(tick, 1) || '.' || CASE WHEN {digits} = '' THEN '0' ELSE {digits} END || 'E9,"message_preview":"' || preview || '"}}' AS payload FROM a)
SELECT request_id, payload, 'sha256=' || sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(payload)))) AS signature FROM p"""
    token = lit(r"\[PII_([A-Z_]+)_(\d+)\]")
    of = "request_id, msg_idx"

    def topic_of(names: list[str]) -> str:
        return "CASE " + " ".join(f"WHEN {rx('i.text', rf'\b{t}\b', 'i')} THEN {lit(t)}" for t in names) + " END"
    names = [t.lower() for t in ds.TOPICS]
    sql["guardrail_report"] = f"""WITH {MSG}, {scored('mt', of)}, {spans('mt', of, "(tenant_id <> 't1' OR ptype IN ('email', 'ssn'))", 'gs')},
gf AS (SELECT {of}, ptype, value, min(s) AS spot FROM gs GROUP BY ALL),
gl AS (SELECT {of}, lower(regexp_extract(t, {token}, 1)) AS ptype, max(CAST(regexp_extract(t, {token}, 2) AS BIGINT)) AS n
    FROM (SELECT {of}, unnest(regexp_extract_all(text, {token})) AS t FROM mt) GROUP BY 1, 2, 3),
gv AS (SELECT f.*, '[PII_' || upper(ptype) || '_' || (coalesce(n, 0) + row_number() OVER (PARTITION BY {of}, ptype ORDER BY spot)) || ']' AS token
    FROM gf f LEFT JOIN gl USING ({of}, ptype)),
glab AS (SELECT s.*, CASE WHEN m.tenant_id = 't0' THEN v.token ELSE {PLACEHOLDER} END AS label
    FROM gs s JOIN mt m USING ({of}) JOIN gv v USING ({of}, ptype, value) WHERE m.tenant_id <> 't1'),
{replaced('mt', of, 'glab', 'label', 'san')},
has AS (SELECT {of}, string_agg(DISTINCT ptype, ', ' ORDER BY ptype) AS types FROM gs GROUP BY 1, 2),
z AS (SELECT i.request_id, i.msg_idx, i.tenant_id, n.text AS sanitized, h.types,
    CASE WHEN (i.tenant_id = 't2' AND score >= 0.5) OR (i.tenant_id NOT IN ('t1', 't2') AND score >= 1.0) THEN 'Prompt injection attempt detected (' || reasons || ')' END AS inj,
    'Request mentions blocked topic: ''' || CASE i.tenant_id WHEN 't1' THEN {topic_of(names)} WHEN 't2' THEN {topic_of(names[1:])} END || '''' AS top
  FROM inj i JOIN san n USING ({of}) LEFT JOIN has h USING ({of})),
y AS (SELECT *, inj IS NOT NULL OR top IS NOT NULL OR (tenant_id = 't1' AND types IS NOT NULL) AS blocked FROM z)
SELECT request_id * 100 + msg_idx AS request_id, sanitized, CASE WHEN blocked THEN 'blocked' WHEN types IS NOT NULL THEN 'redacted' ELSE 'passed' END AS overall,
  array_to_string(list_filter([
    CASE WHEN tenant_id <> 't1' THEN concat_ws('|', 'Prompt Injection', CASE WHEN inj IS NULL THEN 'passed' ELSE 'blocked' END, inj) END,
    CASE WHEN tenant_id IN ('t1', 't2') THEN concat_ws('|', 'Topic Filter', CASE WHEN top IS NULL THEN 'passed' ELSE 'blocked' END, top) END,
    CASE WHEN types IS NULL THEN 'PII Detection|passed' WHEN tenant_id = 't1' THEN 'PII Detection|blocked|Request contains PII: ' || types
      WHEN tenant_id = 't0' THEN 'PII Detection|redacted|PII replaced with reversible tokens (restored in the response)'
      ELSE 'PII Detection|redacted|PII found and redacted' END], lambda x: x IS NOT NULL), ';') AS checks,
  CASE WHEN NOT blocked THEN 'Sent to ' || coalesce((SELECT value FROM gv v WHERE y.tenant_id = 't0' AND v.request_id = y.request_id AND v.msg_idx = y.msg_idx AND token = '[PII_EMAIL_1]'), '[PII_EMAIL_1]')
    || ' and ' || coalesce((SELECT value FROM gv v WHERE y.tenant_id = 't0' AND v.request_id = y.request_id AND v.msg_idx = y.msg_idx AND token = '[PII_EMAIL_2]'), '[PII_EMAIL_2]') END AS response
FROM y"""
    every = "email,phone,ssn,credit_card"
    events = ",".join(fv.DEFAULT_ALERT_EVENTS)
    sql["policy_resolved"] = f"""WITH p(tenant_id, pii_action, pii_types, injection, threshold, topics, max_length, provider, limited, rpm, events) AS (VALUES
  ('t0', 'tokenize', '{every}', TRUE, 1.0::DOUBLE, '', 900, 'wordlist', TRUE, 1, 'input_blocked,rate_limited'),
  ('t1', 'block', 'ssn,email', FALSE, 1.0, 'class action,competitor,lawsuit', NULL, 'openai', FALSE, NULL, '{events}'),
  ('t2', 'redact', '{every}', TRUE, 0.5, 'competitor,lawsuit', 0, 'perspective', FALSE, NULL, '{events}'),
  ('t3', 'redact', '{every}', TRUE, 1.0, '', 900, 'wordlist', FALSE, NULL, '{events}'),
  ('elsewhere', 'redact', '{every}', TRUE, 1.0, '', 900, 'wordlist', FALSE, NULL, '{events}'))
SELECT n AS request_id, p.* FROM (SELECT DISTINCT conv_id AS n FROM conversations) JOIN p
  ON p.tenant_id = CASE WHEN n % 5 = 4 THEN 'elsewhere' ELSE 't' || (n % 5) END"""
    sql["requests_from_json"] = ("SELECT conv_id * 100 + turn AS request_id, role, text FROM conversations UNION ALL "
                                 "SELECT conv_id * 100 + turn, '__system', 'be brief' FROM conversations WHERE conv_id % 2 = 0")
    sql["responses_from_json"] = ("SELECT conv_id * 100 + turn AS request_id, 0 AS choice_idx, text, turn AS prompt_tokens, conv_id AS completion_tokens FROM conversations")

    sql["audit_stats"] = f"WITH {AUDIT} SELECT tenant_id, {STATS} FROM log GROUP BY 1 UNION ALL SELECT '*', {STATS} FROM log"
    sql["top_block_reasons"] = f"WITH {AUDIT} SELECT reason, count(*) AS count FROM log WHERE outcome <> 'passed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
    sql["token_metrics_by_api"] = f"WITH {AUDIT}, {RECENT} SELECT tenant_id, api, {SUMS} FROM recent GROUP BY 1, 2"
    sql["token_metrics"] = f"""WITH {AUDIT}, {RECENT}, a AS (SELECT tenant_id, api, {SUMS} FROM recent GROUP BY 1, 2)
SELECT tenant_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  string_agg(api || ':' || requests || ':' || input_tokens || ':' || output_tokens, ';' ORDER BY api) AS by_api FROM a GROUP BY 1"""
    sql["token_metrics_rollup"] = f"WITH {AUDIT}, {RECENT} SELECT tenant_id, api, CAST(grouping(tenant_id, api) AS BIGINT) AS level, {SUMS} FROM recent GROUP BY ROLLUP (tenant_id, api)"
    sql["monthly_usage"] = f"WITH {AUDIT} SELECT tenant_id, strftime(ts, '%Y-%m') AS month, count(*) AS passed_requests FROM log WHERE outcome = 'passed' GROUP BY 1, 2"
    sql["recent_audit"] = f"WITH {AUDIT} SELECT id, epoch_us(ts) AS ts, tenant_id, api, outcome, reason, prompt_tokens, completion_tokens FROM log WHERE tenant_id = 'click' AND api = 'openai' ORDER BY id DESC LIMIT 50"
    sql["audit_sink"] = f"""WITH {AUDIT} SELECT row_number() OVER (ORDER BY ts, id) AS id, id AS request_id, CASE WHEN id % 101 <> 0 THEN tenant_id END AS tenant_id, api,
  CASE WHEN id % 103 = 0 THEN 'unknown' ELSE outcome END AS outcome,
  CASE WHEN id % 101 = 0 THEN 'no tenant' WHEN id % 103 = 0 THEN 'unknown outcome' ELSE reason END AS reason, prompt_tokens FROM log"""
    sql["account_usage"] = f"""WITH {AUDIT}, s AS (SELECT tenant_id, {STATS} FROM log GROUP BY 1),
u AS (SELECT tenant_id, count(*) AS n FROM log WHERE outcome = 'passed' AND date_trunc('month', ts) = DATE '2024-01-01' GROUP BY 1),
p(plan_used, price_monthly, monthly_requests, rpm, rph) AS (VALUES {PLAN_ROWS}),
a(tenant_id, plan, plan_used) AS (VALUES ('click', 'free', 'free'), ('view', 'starter', 'starter'), ('purchase', 'growth', 'growth'), ('nobody', 'legacy', 'free'))
SELECT a.tenant_id, a.plan, coalesce(total_requests, 0) AS total_requests, coalesce(blocked_requests, 0) AS blocked_requests, coalesce(pass_rate, 100.0) AS pass_rate,
  coalesce(u.n, 0) AS monthly_used, CAST(monthly_requests AS BIGINT) AS monthly_requests, price_monthly FROM a JOIN p USING (plan_used) LEFT JOIN s USING (tenant_id) LEFT JOIN u USING (tenant_id)"""
    sql["audit_by_minute"] = f"WITH {AUDIT} SELECT epoch_us(date_trunc('minute', ts)) AS minute, tenant_id, outcome, count(*) AS requests FROM log GROUP BY ALL"
    sql["audit_rollup_late"] = f"""WITH {AUDIT}, b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM log)
SELECT epoch_us(date_trunc('minute', ts)) AS minute, tenant_id, outcome, count(*) AS requests, id % 97 = 0 AND epoch_us(ts) < lo + (hi - lo) / 2 AS late
FROM log, b GROUP BY ALL"""
    sql["tenant_sessions"] = f"""WITH {AUDIT}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 THEN 1 ELSE 0 END AS cut FROM log WINDOW w AS (PARTITION BY tenant_id ORDER BY ts)),
h AS (SELECT *, sum(cut) OVER (PARTITION BY tenant_id ORDER BY ts) AS session FROM g)
SELECT tenant_id, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS requests FROM h GROUP BY tenant_id, session"""
    sql["rate_limit_decisions"] = f"WITH RECURSIVE {TRAFFIC}, {limiter('tq')} SELECT request_id, tenant_id, limited, reason, retry_after FROM lim"
    tick = f"epoch_us(TIMESTAMP '{AS_OF}')"
    sql["rate_limit_status"] = f"""WITH RECURSIVE {TRAFFIC}, {limiter('tq')},
u AS (SELECT tenant_id, count(*) FILTER (WHERE tick >= {tick} - 60000000) AS m, count(*) AS h FROM lim WHERE NOT limited AND tick >= {tick} - 3600000000 AND tick <= {tick} GROUP BY 1),
x AS (SELECT tenant_id, 'minute' AS "window", rpm AS "limit", coalesce(m, 0) AS used FROM lt LEFT JOIN u USING (tenant_id) WHERE rpm IS NOT NULL
  UNION ALL SELECT tenant_id, 'hour', rph, coalesce(h, 0) FROM lt LEFT JOIN u USING (tenant_id) WHERE rph IS NOT NULL)
SELECT *, greatest(0, "limit" - used) AS remaining FROM x"""
    sql["request_rate"] = ("SELECT event_id AS request_id, event_type AS tenant_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) "
                           "RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS rate FROM events")
    sql["monthly_cap"] = """WITH q AS (SELECT event_id AS request_id, event_type AS tenant_id, ts, CAST(event_id % 10 > 2 AS INTEGER) AS ok,
    CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 200 WHEN 'error' THEN 200 END AS cap FROM events),
u AS (SELECT *, coalesce(sum(ok) OVER (PARTITION BY tenant_id, date_trunc('month', ts) ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM q)
SELECT request_id, tenant_id, coalesce(used >= cap, FALSE) AS capped,
  CASE WHEN used >= cap THEN 'Monthly request limit reached (' || cap || ' requests). Upgrade your plan to continue.' END AS reason FROM u"""
    sql["stream_length_cutoff"] = f"WITH {CHUNKS}, {LENGTH_CUT} SELECT stream_id, seq, reason FROM lc"
    sql["stream_toxicity_cutoff"] = f"WITH {CHUNKS}, {WORD_CUT} SELECT stream_id, seq, reason FROM wc"
    sql["stream_check_points"] = f"WITH RECURSIVE {CHUNKS}, {check_points('cs')} SELECT stream_id, seq, last AS total FROM cp WHERE seq >= 0"
    ended = f"WITH RECURSIVE {CHUNKS}, {stream_verdicts('ct', 'cs')}"
    sql["stream_outcome"] = f"{ended} SELECT * FROM sv"
    sql["delivered_rows"] = f"{ended} SELECT cs.stream_id, cs.seq, cs.delta FROM cs JOIN sv USING (stream_id) WHERE cut_seq IS NULL OR cs.seq < cut_seq"
    partial = lit(fv.PARTIAL_TOKEN_PATTERN + r"\n?\z")
    emit = f"total - CASE WHEN stream_id % 3 = 0 THEN 0 ELSE length(regexp_extract(right(left(text, total), 64), {partial})) END"
    back = "CASE WHEN stream_id % 3 = 0 THEN x ELSE replace(x, '[PII_EMAIL_1]', 'user' || stream_id || '@example.com') END"
    released = f"""{CHUNKS}, e AS (SELECT *, {emit} AS upto FROM cs), p AS (SELECT *, coalesce(lag(upto) OVER w, 0) AS since, lead(seq) OVER w IS NULL AS final FROM e
    WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
d AS (SELECT stream_id, seq, substr(text, since + 1, upto - since) AS x, CASE WHEN final AND stream_id % 11 <> 0 THEN substr(text, upto + 1) ELSE '' END AS y FROM p),
rs AS (SELECT stream_id, seq, {back} AS delta, {back.replace('THEN x', 'THEN y').replace('(x,', '(y,')} AS flushed FROM d)"""
    sql["stream_restore"] = f"WITH {released} SELECT * FROM rs WHERE delta <> '' OR flushed <> ''"
    sql["stream_restored_text"] = (f"WITH {released} SELECT stream_id, CAST(sum(length(delta || flushed)) AS BIGINT) AS chars, md5(string_agg(delta || flushed, '' ORDER BY seq)) AS text_md5, "
                                   "count(*) FILTER (WHERE contains(delta || flushed, '@example.com')) AS restored FROM rs GROUP BY 1")
    sql["rate_limit_live"], sql["audit_rollup_live"] = sql["rate_limit_decisions"], sql["audit_by_minute"]
    sql["stream_guard_live"] = f"""WITH {released.replace("AND stream_id % 11 <> 0 ", "")}, {LENGTH_CUT}, {WORD_CUT},
f AS (SELECT *, 0 AS rank FROM lc UNION ALL SELECT *, 1 FROM wc),
v AS (SELECT stream_id, min(seq) AS cut, arg_min(rank, seq * 2 + rank) AS rank, arg_min(reason, seq * 2 + rank) AS reason FROM f GROUP BY 1),
g AS (SELECT rs.stream_id, string_agg(delta || flushed, '' ORDER BY rs.seq) AS t FROM rs LEFT JOIN v USING (stream_id) WHERE cut IS NULL OR rs.seq < cut GROUP BY 1)
SELECT c.stream_id, CAST(length(coalesce(t, '')) AS BIGINT) AS chars, md5(coalesce(t, '')) AS text_md5,
  CASE WHEN cut IS NOT NULL THEN 'output_blocked' WHEN c.stream_id % 7 <> 0 THEN 'passed' END AS outcome,
  CASE rank WHEN 0 THEN 'output_validator' WHEN 1 THEN 'toxicity' END AS guardrail, v.reason
FROM ct c LEFT JOIN v USING (stream_id) LEFT JOIN g USING (stream_id)"""
    sql["stream_guard_live_vault"] = sql["stream_guard_live"]
    sql["sse_openai"] = f"""WITH {CHUNKS} SELECT stream_id, seq, delta, FALSE AS closes, FALSE AS finished FROM cs
UNION ALL SELECT stream_id, 1000000000, '', TRUE, TRUE FROM ct WHERE stream_id % 7 <> 0"""
    sql["sse_anthropic"] = f"""WITH {CHUNKS} SELECT stream_id, seq * 3 + 1 AS seq, CASE WHEN (stream_id + seq) % 50 = 7 THEN '' ELSE delta END AS delta,
  FALSE AS closes, FALSE AS finished FROM cs
UNION ALL SELECT stream_id, 3000000000 + i, '', i = 0, i = 4 AND done FROM ct, (SELECT unnest([0, 1, 4]) AS i)"""
    sql["sse_openai_live"], sql["sse_anthropic_live"] = sql["sse_openai"], sql["sse_anthropic"]
    sql["plan_history"] = f"WITH {HISTORY} SELECT * FROM hist"
    sql["effective_limits"] = f"""WITH {HISTORY}, p(plan, price, cap, rpm, rph) AS (VALUES {PLAN_ROWS}), a AS (SELECT epoch_us(TIMESTAMP '1998-06-01') AS tick)
SELECT user_id, h.plan, rpm AS requests_per_minute, rph AS requests_per_hour FROM hist h JOIN p USING (plan), a WHERE valid_from <= tick AND (valid_to IS NULL OR valid_to > tick)"""
    return sql
