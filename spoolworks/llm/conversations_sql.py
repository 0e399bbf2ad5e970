"""The repair of conversations as SQL: the cheapest (cost, audit, turns) of each state, row by row."""

def add(state, cost, letter, line=None):
    body = f"list_append({state}.b, {line})" if line else f"{state}.b"
    return f"{{c: {state}.c + {cost}, a: {state}.a || '{letter}', b: {body}}}"


def least(*ways):
    return f"list_min([{', '.join(ways)}])"


def kept(role, state):
    return f"CASE WHEN mark <> 'd' AND role[1] = '{role}' THEN {add(state, 'extra', 'K', 'role || chr(58) || text')} END"


def reroled(role, state):
    line = f"'{role}:' || text"
    return f"CASE WHEN mark <> 'd' THEN {add(state, '3 + extra', 'R', line)} END"


def user(state):
    return add(state, 3, "I", "'user:'")

FAR = "{c: 1000000000, a: '', b: CAST([] AS VARCHAR[])}"
SQL = f"""
    WITH RECURSIVE hit AS (
      SELECT *, xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
        lambda c, x: list_reduce(range(8), lambda k, i: CASE WHEN k & 1 = 1 THEN xor(3988292384, k >> 1) ELSE k >> 1 END, xor(c, x)), 4294967295)) % 20 AS h FROM conversations),
    hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
               CASE h WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE h > 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]') AS w FROM hurt),
    known AS (SELECT *, CASE WHEN len(w) = 0 THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN w[-1] IN ('.', '!', '?') THEN 'k' ELSE 't' END AS fault,
                lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair FROM placed),
    turns AS (SELECT conv_id, pos, role, text, CASE WHEN fault IN ('b', 'd') THEN 'd' ELSE fault END AS mark, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM known),
    walk AS (
      SELECT conv_id, 0 AS pos, {{c: 0, a: '', b: CAST([] AS VARCHAR[])}} AS v0, {FAR} AS v1, {FAR} AS v2, {FAR} AS v3 FROM (SELECT DISTINCT conv_id FROM conversations) d
      UNION ALL
      SELECT conv_id, pos, {add('v0', 4, 'D')}, {least(add('v1', 4, 'D'), kept('s', 'v0'))},
             {least(add('w2', 4, 'D'), *[f(*a) for f, a in [(kept, ('u', 'v0')), (kept, ('u', 'v1')), (kept, ('u', 'w3')), (reroled, ('user', 'v0')), (reroled, ('user', 'v1')), (reroled, ('user', 'w3'))]])},
             {least(add('w3', 4, 'D'), kept('a', 'w2'), reroled('assistant', 'w2'))}
      FROM (SELECT *, {least('v3', add('w2', 3, 'I', "'assistant:'"))} AS w3 FROM (
        SELECT r.*, v0, v1, v3, {least('v2', user('v0'), user('v1'), user('v3'))} AS w2 FROM walk JOIN turns r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.pos = walk.pos + 1) s) t),
    ends AS (SELECT conv_id, {least('v0', 'v3', add('v2', 3, 'I', "'assistant:'"), f"{{c: v1.c + 6, a: v1.a || 'II', b: list_concat(v1.b, ['user:', 'assistant:'])}}")} AS best FROM (
               SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM walk) l WHERE back = 1),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                 count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM known GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(array_to_string(best.b, chr(10))) AS repaired_sha256
    FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """
