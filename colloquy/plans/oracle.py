"""SQL of the derived corpus for DuckDB, as named parts of a WITH clause.

``sql(body)`` puts before a query the parts that it names, and those that they
name. The rules are those of ``corpus.py`` and the operators.
"""

from __future__ import annotations

import re

from ..corpus import EPOCH, NOW, PLANTED
from ..functions import text as X
from ..operators import extraction as E


def quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def words(text: str, expression: str, stop: list[str]) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '{expression}'), lambda x: lower(x)), lambda x: NOT list_contains({quoted(stop)}, x))"


def one_line(s: str) -> str:
    return f"replace(trim(coalesce({s}, '')), chr(10), ' ')"


def truncate(s: str, n: int) -> str:
    line = one_line(s)
    return f"CASE WHEN length({line}) <= {n} THEN {line} ELSE rtrim(left({line}, {n - 3})) || '...' END"


def first_line(s: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({s}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]"


def key(s: str) -> str:
    return rf"regexp_replace(lower(trim({s})), '\s+', ' ', 'g')"


def excerpt(text: str, match: str) -> str:
    at = f"(strpos({text}, {match}) - 1)"
    start, end = f"greatest(0, {at} - 60)", f"least(length({text}), {at} + length({match}) + 120)"
    return (
        f"CASE WHEN strpos({text}, {match}) = 0 THEN left(trim({match}), 240) ELSE left(trim((CASE WHEN {start} > 0 THEN '...' ELSE '' END) || "
        f"replace(substring({text}, CAST({start} + 1 AS BIGINT), CAST({end} - {start} AS BIGINT)), chr(10), ' ') || (CASE WHEN {end} < length({text}) THEN '...' ELSE '' END)), 400) END"
    )


def object_id(kind: str, k: str) -> str:
    return f"'obj_' || left(sha256(concat_ws('|', {kind}, {k})), 16)"


def phrases(kind: str, patterns, roles: str | None, dedupe: bool = True) -> str:
    arrays = "list_concat(" * (len(patterns) - 1) + ", ".join(
        f"regexp_extract_all(content_text, {pattern(p)})" + (")" if n else "") for n, p in enumerate(patterns)
    )
    found = f"SELECT conversation_id, ordinal, content_text, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS place FROM (SELECT *, {arrays} AS l FROM emsg {'WHERE role IN ' + roles if roles else ''})"
    named = f"SELECT conversation_id, ordinal, content_text, place, trim(raw) AS match, left({key('trim(raw)')}, 120) AS k FROM ({found})"
    if dedupe:
        named = f"SELECT * FROM ({named}) QUALIFY row_number() OVER (PARTITION BY conversation_id, k ORDER BY ordinal, place) = 1"
        k = "k"
    else:
        k = key("left(match, 80)")
    return f"SELECT conversation_id, ordinal, place, '{kind}' AS kind, left(match, 80) AS title, match AS description, {excerpt('content_text', 'match')} AS excerpt, {k} AS canonical_key FROM ({named})"


def recurring(expression: str, keep: str, times: int) -> str:
    found = f"SELECT conversation_id, ordinal, content_text, trim(unnest(l)) AS token, generate_subscripts(l, 1) - 1 AS place FROM (SELECT *, regexp_extract_all(content_text, {pattern(expression)}, 1) AS l FROM emsg)"
    return (
        f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY conversation_id, token) AS n, row_number() OVER (PARTITION BY conversation_id, token ORDER BY ordinal, place) AS k0 "
        f"FROM ({found}) WHERE {keep}) WHERE k0 = 1 AND n >= {times}"
    )


PARTS = {
    "msg": f"""SELECT conv_id, printf('msg_%06d_%04d', conv_id, turn) AS message_id, printf('conv_%06d', conv_id) AS conversation_id, CAST(turn AS INT) AS ordinal, role,
        CAST({EPOCH} + conv_id * 3600 + turn * 60 AS DOUBLE) AS ts, coalesce(text, '') || ' ' || {quoted(PLANTED)}[CAST((conv_id * 31 + turn) % {len(PLANTED)} AS INT) + 1] AS content_text FROM conversations""",
    "ids": "SELECT conv_id, CAST(count(*) AS INT) AS message_count, arg_min(text, turn) FILTER (WHERE role = 'user') AS opening FROM conversations GROUP BY conv_id",
    "conv0": f"""SELECT conv_id, printf('conv_%06d', conv_id) AS conversation_id, CASE WHEN conv_id % 2 = 0 THEN 'chatgpt' ELSE 'claude' END AS source,
        left(coalesce({first_line('opening')}, 'Untitled'), 80) AS title, CAST({EPOCH} + conv_id * 3600 AS DOUBLE) AS created_at,
        CASE WHEN conv_id % 7 <> 0 THEN CAST({EPOCH} + conv_id * 3600 + message_count * 60 AS DOUBLE) END AS updated_at,
        CASE WHEN conv_id % 10 <= 5 THEN 'indexed' WHEN conv_id % 10 <= 7 THEN 'private' WHEN conv_id % 10 = 8 THEN 'pending_review' ELSE 'quarantined' END AS state,
        message_count, CASE conv_id % 4 WHEN 0 THEN ['architecture'] WHEN 1 THEN ['backend'] WHEN 2 THEN ['architecture', 'backend'] ELSE CAST([] AS VARCHAR[]) END AS manual_tags FROM ids""",
    "reg": "SELECT printf('conv_%06d', conv_id) AS conversation_id, CASE conv_id % 5 WHEN 0 THEN 'work' WHEN 1 THEN 'research' WHEN 2 THEN 'roleplay' WHEN 4 THEN 'personal' END AS dominant_register FROM ids",
    "cm": f"""SELECT conversation_id, ordinal, role, length(content_text) AS chars, list_distinct({words('content_text', X.CHUNK_WORD, X.CHUNK_STOP)}) AS toks,
        row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS ix FROM msg""",
    "fold": """SELECT conversation_id, 1 AS ix, 1 AS n, chars, toks, role AS before, CAST([] AS BIGINT[]) AS cuts FROM cm WHERE ix = 0
        UNION ALL SELECT f.conversation_id, f.ix + 1, CASE WHEN c.cut THEN 1 ELSE f.n + 1 END, CASE WHEN c.cut THEN c.chars ELSE f.chars + c.chars END,
            CASE WHEN c.cut THEN c.toks ELSE list_distinct(list_concat(f.toks, c.toks)) END, c.role, CASE WHEN c.cut THEN list_append(f.cuts, f.ix) ELSE f.cuts END
        FROM fold f, LATERAL (SELECT m.*, m.role = 'user' AND f.before = 'assistant' AND (f.chars >= 9000 OR (f.n >= 4 AND f.chars >= 1200 AND
            CASE WHEN len(m.toks) = 0 OR len(f.toks) = 0 THEN 0 ELSE len(list_intersect(f.toks, m.toks)) / len(list_distinct(list_concat(f.toks, m.toks))) END < 0.10)) AS cut
            FROM cm m WHERE m.conversation_id = f.conversation_id AND m.ix = f.ix) c""",
    "raw": "SELECT f.conversation_id, f.cuts AS raw_cuts, f.ix AS total FROM fold f JOIN (SELECT conversation_id, max(ix) AS ix FROM fold GROUP BY 1) l USING (conversation_id, ix)",
    "mrg": """SELECT conversation_id, total, raw_cuts, 1 AS k, CAST(0 AS BIGINT) AS frm, CAST([] AS BIGINT[]) AS cuts FROM raw
        UNION ALL SELECT conversation_id, total, raw_cuts, k + 1, CASE WHEN raw_cuts[k] - frm >= 4 THEN raw_cuts[k] ELSE frm END,
            CASE WHEN raw_cuts[k] - frm >= 4 THEN list_append(cuts, raw_cuts[k]) ELSE cuts END FROM mrg WHERE k <= len(raw_cuts)""",
    "cut": """SELECT conversation_id, raw_cuts, CASE WHEN len(cuts) > 0 AND total - frm < 4 THEN list_slice(cuts, 1, len(cuts) - 1) ELSE cuts END AS cuts, total FROM mrg WHERE k = len(raw_cuts) + 1""",
    "rng": """SELECT conversation_id, CAST(i AS INT) AS chunk_index, s[i + 1] AS lo, coalesce(s[i + 2], total) - 1 AS hi FROM
        (SELECT conversation_id, total, list_concat([0], cuts) AS s, unnest(range(len(cuts) + 1)) AS i FROM cut)""",
    "chk": f"""SELECT 'chk_' || left(sha256(concat_ws('|', conversation_id, CAST(chunk_index AS VARCHAR))), 16) AS chunk_id, conversation_id, chunk_index, start_message_ordinal, end_message_ordinal,
        CASE WHEN coalesce(u, '') = '' THEN 'Untitled chunk' WHEN length({first_line('u')}) > 80 THEN rtrim(left({first_line('u')}, 77)) || '...' ELSE coalesce({first_line('u')}, '') END AS chunk_title,
        concat_ws(' | ', CASE WHEN u IS NOT NULL THEN {truncate('u', 240)} END, CASE WHEN a IS NOT NULL THEN '-> ' || {truncate('a', 240)} END) AS summary_short
        FROM (SELECT r.conversation_id, chunk_index, min(ordinal) AS start_message_ordinal, max(ordinal) AS end_message_ordinal,
            arg_min(content_text, ordinal) FILTER (WHERE m.role = 'user') AS u, arg_min(content_text, ordinal) FILTER (WHERE m.role = 'assistant') AS a
            FROM rng r JOIN (SELECT msg.*, ix FROM msg JOIN cm USING (conversation_id, ordinal)) m ON m.conversation_id = r.conversation_id AND m.ix BETWEEN lo AND hi GROUP BY 1, 2)""",
    "emsg": "SELECT msg.* FROM msg JOIN conv0 USING (conversation_id) WHERE state IN ('indexed', 'private')",
    "named": f"""SELECT *, {key('match')} AS k FROM (SELECT conversation_id, ordinal, content_text, trim(unnest(l)) AS match, generate_subscripts(l, 1) - 1 AS place
        FROM (SELECT *, regexp_extract_all(content_text, {pattern(E.PROJECT)}, 1) AS l FROM emsg)) QUALIFY row_number() OVER (PARTITION BY conversation_id, {key('match')} ORDER BY ordinal, place) = 1""",
    "acro": recurring(E.ACRONYM, f"NOT list_contains({quoted(E.GENERIC)}, token)", E.ACRONYM_TIMES),
    "ent": recurring(E.ENTITY, rf"len(list_filter(regexp_split_to_array(token, '\s+'), lambda w: list_contains({quoted(E.STARTERS)}, w))) = 0", E.ENTITY_TIMES),
    "proj": f"""SELECT n.conversation_id, ordinal, place, 'project' AS kind, left(match, 80) AS title, 'Mentioned as project ''' || match || ''' in ''' || c.title || '''' AS description,
            {excerpt('content_text', 'match')} AS excerpt, k AS canonical_key FROM named n JOIN conv0 c USING (conversation_id)
        UNION ALL SELECT a.conversation_id, ordinal, place, 'project', token, 'Recurring acronym ''' || token || ''' (' || n || 'x) in ''' || c.title || '''', {excerpt('content_text', 'token')}, {key('token')}
        FROM acro a JOIN conv0 c USING (conversation_id) WHERE NOT EXISTS (SELECT 1 FROM named x WHERE x.conversation_id = a.conversation_id AND x.k = {key('a.token')})""",
    "h_decision": phrases("decision", E.DECISION, "('user', 'assistant')"),
    "h_open_loop": phrases("open_loop", E.OPEN_LOOP, "('user', 'assistant')"),
    "h_preference": phrases("preference", E.PREFERENCE, "('user')"),
    "h_artifact": phrases("artifact", E.ARTIFACT, None, dedupe=False),
    "h_entity": f"SELECT conversation_id, ordinal, place, 'entity' AS kind, token AS title, 'Repeated proper noun ''' || token || ''' (' || n || 'x).' AS description, {excerpt('content_text', 'token')} AS excerpt, {key('token')} AS canonical_key FROM ent",
    "hit": "SELECT * FROM proj UNION ALL SELECT * FROM h_decision UNION ALL SELECT * FROM h_open_loop UNION ALL SELECT * FROM h_preference UNION ALL SELECT * FROM h_artifact UNION ALL SELECT * FROM h_entity",
    "obj": f"""SELECT {object_id('kind', 'canonical_key')} AS object_id, kind, title, description, CAST(NULL AS VARCHAR) AS project_id, 'active' AS state, canonical_key FROM
        (SELECT *, row_number() OVER (PARTITION BY kind, canonical_key ORDER BY conversation_id DESC, ordinal DESC, place DESC, title DESC, description DESC) AS k FROM hit) WHERE k = 1""",
    "prov": f"""SELECT 'prov_' || left(sha256(concat_ws('|', h.conversation_id, kind, canonical_key, CAST(ordinal AS VARCHAR), CAST(place AS VARCHAR))), 16) AS link_id,
        {object_id('kind', 'canonical_key')} AS object_id, h.conversation_id, chunk_id, excerpt FROM hit h JOIN chk ON chk.conversation_id = h.conversation_id AND ordinal BETWEEN start_message_ordinal AND end_message_ordinal""",
    "conv": f"""SELECT c.*, CAST([] AS VARCHAR[]) AS auto_tags, CASE WHEN done THEN round(least(least(message_count / 20e0, 2e0) + d * 0.5e0 + p * 0.7e0 + o * 0.3e0, 10e0), 3) ELSE 0e0 END AS importance_score,
        CASE WHEN done THEN round(least(o * 0.7e0 + p * 0.2e0, 10e0), 3) ELSE 0e0 END AS resurfacing_score, done AND o > 0 AS has_open_loops,
        CASE WHEN done THEN message_count || ' msgs, ' || n_chunks || ' chunks.' || CASE WHEN opening IS NULL THEN '' ELSE ' Opened with: ' ||
            CASE WHEN length({one_line('opening')}) > 200 THEN left({one_line('opening')}, 197) || '...' ELSE {one_line('opening')} END END ELSE '' END AS summary_short
        FROM (SELECT c.*, state IN ('indexed', 'private') AS done, coalesce(k.d, 0) AS d, coalesce(k.p, 0) AS p, coalesce(k.o, 0) AS o, coalesce(n_chunks, 0) AS n_chunks, f.opening FROM conv0 c
        LEFT JOIN (SELECT conversation_id, count(*) FILTER (WHERE kind = 'decision') AS d, count(*) FILTER (WHERE kind = 'project') AS p, count(*) FILTER (WHERE kind = 'open_loop') AS o FROM hit GROUP BY 1) k USING (conversation_id)
        LEFT JOIN (SELECT conversation_id, count(*) AS n_chunks FROM chk GROUP BY 1) USING (conversation_id)
        LEFT JOIN (SELECT conversation_id, arg_min(content_text, ordinal) AS opening FROM msg WHERE role = 'user' GROUP BY 1) f USING (conversation_id)) c""",
    "recency": f"SELECT conversation_id, CASE WHEN coalesce(nullif(updated_at, 0), nullif(created_at, 0), 0) = 0 THEN 0e0 ELSE greatest(0e0, 0.5e0 * (1e0 - greatest(0e0, ({NOW} - coalesce(nullif(updated_at, 0), created_at)) / 86400e0) / 730e0)) END AS bonus FROM conv0",
}

def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after a WITH clause of all parts it needs."""
    parts = PARTS | (extra or {})
    name = re.compile(r"\b(?:FROM|JOIN)\s+(" + "|".join(sorted(parts, key=len, reverse=True)) + r")\b")
    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        for x in dict.fromkeys(name.findall(text)):
            if x != own and x not in order:
                need(parts[x], x)
                order.append(x)

    need(body)
    if not order:
        return body
    own = body.removeprefix("WITH ")
    return "WITH RECURSIVE " + ",\n".join(f"{x} AS ({parts[x]})" for x in order) + (",\n" if own != body else "\n") + own
