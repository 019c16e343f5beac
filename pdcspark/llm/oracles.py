"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from pdcspark.llm.chat import ACCEPTED, TEMPLATE, TRANSITIONS, control_strings
from pdcspark.llm.mixing import MOST_EPOCHS, SHARE_PERCENT, WEIGHTS


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for mark in control_strings():
        sql = f"replace({sql}, {_quote(mark)}, {_quote(mark[0] + chr(92) + mark[1:])})"
    return sql


def op1() -> str:
    roles, other = TEMPLATE["roles"], TEMPLATE["other"]
    marks = " ".join(f"WHEN role = '{r}' THEN {len(m['open']) + len(m['close'])}" for r, m in roles.items())
    others = sum(len(other[k]) for k in ("open", "then", "close"))
    trained = ", ".join(f"'{r}'" for r, m in roles.items() if m["loss"])
    steps = " OR ".join(f"(state = '{a}' AND role IN ({', '.join(map(_quote, b))}))" for a, b in TRANSITIONS.items())
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), stepped AS (
  SELECT *, row_number() OVER w AS position, lag(role, 1, 'start') OVER w AS state FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY position) AS spoken,
    coalesce(string_agg(text, '' ORDER BY position) FILTER (WHERE role IN ({trained})), '') AS in_loss,
    sum(length({_escaped('text')}) + CASE {marks} ELSE {others} + length({_escaped('role')}) END) AS formatted_chars,
    min(CASE WHEN NOT ({steps}) THEN position END) AS first_error,
    max_by(role, position) AS last
  FROM stepped GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(spoken) AS turns_sha256, length(in_loss)::BIGINT AS loss_chars,
  sha256(in_loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
  first_error IS NULL AND last IN ({', '.join(map(_quote, ACCEPTED))}) AS valid, first_error::BIGINT AS first_error
FROM whole"""


def mixed(documents: str = "documents") -> str:
    """CTEs that end in ``mixed``: doc_id, size, source_size, target, times, for each row of ``documents``."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 15))::BIGINT AS h
  FROM {documents}
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, {MOST_EPOCHS} * source_size AS lim, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {cases} END AS w FROM sizes
), lefts AS (
  SELECT *, ({SHARE_PERCENT} * sum(source_size) OVER () - 100 * coalesce(sum(lim) OVER before, 0))::BIGINT AS lft,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS w_left,
    row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS place
  FROM weighed WINDOW before AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT min_by(lft, place) AS lft, min_by(w_left, place) AS w_left, min(place) AS place FROM lefts WHERE lft * w < lim * w_left * 100
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.place >= o.place THEN (o.lft * l.w) / (o.w_left * 100) ELSE l.lim END::DOUBLE AS target
  FROM lefts l LEFT JOIN opened o ON true
), aims AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::INT AS epochs FROM targets
), sums AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS through FROM sized GROUP BY source, h
), kept AS (
  SELECT s.source, s.h FROM sums s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
  WHERE s.through <= a.target - a.epochs * a.source_size
    OR (s.through - s.n <= a.target - a.epochs * a.source_size
        AND s.through - (a.target - a.epochs * a.source_size) <= (a.target - a.epochs * a.source_size) - (s.through - s.n))
), mixed AS (
  SELECT s.* EXCLUDE (h), a.source_size, a.target, a.epochs + (k.h IS NOT NULL)::INT AS times
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
  LEFT JOIN kept k ON k.source IS NOT DISTINCT FROM s.source AND k.h = s.h AND a.source_size > 0
)"""


def op9() -> str:
    return f"WITH {mixed()} SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken FROM mixed"


def op12(window: int = 35) -> str:
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT r, words, unnest(range(1, len(words) - {window} + 2)) AS p FROM texts
), windows AS (
  SELECT r, p, count(*) OVER (PARTITION BY array_to_string(words[p : p + {window} - 1], ' ')) AS times FROM starts
), covered AS (
  SELECT DISTINCT r, p + unnest(range({window})) AS p FROM windows WHERE times > 1
), each AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM texts
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM each ANTI JOIN covered USING (r, p) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)"""


def op13(filters: str = "ABCDE") -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(filters))
    bits = lambda text: " + ".join(f"CASE WHEN contains({text}, '{f}') THEN {1 << k} ELSE 0 END" for k, f in enumerate(filters))
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), failing AS (
  SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails
  FROM texts
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), steps AS (
  SELECT filter_order, step, {bits('filter_order[step]')} AS own, {bits('left(filter_order, step - 1)')} AS before
  FROM (VALUES {orders}) o(filter_order), (SELECT unnest(range(1, {len(filters) + 1}))::INT AS step)
), counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE fails & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails & own <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted"""


ORACLES = {"op1_chat_formatting": op1(), "op9_mixing": op9(), "op12_substring_dedup": op12(), "op13_filter_audit": op13()}
