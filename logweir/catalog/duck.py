"""Text building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LF = "chr(10)"


def quoted(text: str) -> str:
    """A SQL literal; line feeds spelled out."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def tokens(text: str) -> str:
    return f"greatest(1, CAST(ceil(length({text}) / CAST(2.2 AS DOUBLE)) AS BIGINT))"


def filled(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def lines(text: str) -> str:
    return filled(f"regexp_split_to_array({text}, '{BREAK}')")


def units_cte(table: str, key: str, text: str) -> str:
    """``units``: (key, unit_index, unit) of every text."""
    norm = strip(f"regexp_replace({text}, '\\r\\n?', {LF}, 'g')")
    return f"""norms AS (SELECT {key}, {norm} AS norm FROM {table})
, parted AS (SELECT {key}, norm, {filled(f"string_split(norm, {LF} || {LF})")} AS paras FROM norms)
, listed AS (SELECT {key}, CASE WHEN norm = '' THEN [] WHEN len(paras) > 1 THEN paras ELSE {lines('norm')} END AS u FROM parted)
, units AS (SELECT {key}, CAST(generate_subscripts(u, 1) - 1 AS BIGINT) AS unit_index, unnest(u) AS unit FROM listed)"""


def pieces_cte(key: str, size: int) -> str:
    """``pieces``: units cut every ``size`` characters."""
    return f"""cuts AS (SELECT {key}, unit_index, unit, unnest(range(0, CAST(ceil(length(unit) / {size}.0) AS BIGINT))) AS i FROM units)
, pieces AS (SELECT * FROM (SELECT {key}, unit_index, i AS piece_index,
    CASE WHEN length(unit) <= {size} THEN unit ELSE {strip(f'substr(unit, i * {size} + 1, {size})')} END AS piece FROM cuts) WHERE piece <> '')"""


def packed_cte(name: str, rows: str, key: str, budget: int, max_rows: int = 1_000_000_000) -> str:
    """Greedy packing, one row of every key per recursion step; ``rows`` has (key, idx, tokens)."""
    return f"""{name} AS (
  SELECT {key}, idx, 0::BIGINT AS grp, 1::BIGINT AS members, tokens::BIGINT AS used FROM {rows} WHERE idx = 0
  UNION ALL
  SELECT r.{key}, r.idx,
    CASE WHEN p.members < {max_rows} AND p.used + r.tokens <= {budget} THEN p.grp ELSE p.grp + 1 END,
    CASE WHEN p.members < {max_rows} AND p.used + r.tokens <= {budget} THEN p.members + 1 ELSE 1 END,
    CASE WHEN p.members < {max_rows} AND p.used + r.tokens <= {budget} THEN p.used + r.tokens ELSE r.tokens END
  FROM {name} p JOIN {rows} r ON r.{key} = p.{key} AND r.idx = p.idx + 1)"""


def dry_cte(name: str, source: str) -> str:
    """``name``: rows of ``source`` (with stage and user) plus the deterministic summary."""
    nl = f" || {LF} || "
    listed = f"'[' || {LF} || array_to_string(list_transform(points, lambda p: '    ' || CAST(to_json(p) AS VARCHAR)), ',' || {LF}) || {LF} || '  ]'"
    content = (
        f"'{{'{nl}'  \"ok\": true,'{nl}'  \"summary\": ' || CAST(to_json(summary) AS VARCHAR) || ','{nl}"
        f"'  \"key_points\": ' || CASE WHEN len(points) = 0 THEN '[]' ELSE {listed} END || ','{nl}"
        f"'  \"warnings\": [],'{nl}'  \"source_count\": ' || source_count{nl}'}}'"
    )
    body = f"summary || {LF} || array_to_string(list_transform(points, lambda p: '- ' || p), {LF})"
    block = strip(f"'Summary 1:' || {LF} || body")
    return f"""{name}_a AS (SELECT *, {collapse('"user"')} AS compact,
    list_transform(({lines('"user"')})[1:5], lambda l: {collapse('l')}) AS points,
    CAST(greatest(1, length("user") - length(replace("user", {LF} || {LF}, {LF})) + 1) AS INT) AS source_count FROM {source})
, {name}_b AS (SELECT *, '[' || stage || '] ' || CASE WHEN length(compact) > 420 THEN rtrim(left(compact, 420)) || '...' ELSE compact END AS summary FROM {name}_a)
, {name}_c AS (SELECT * EXCLUDE (compact), {content} AS content, {body} AS body FROM {name}_b)
, {name} AS (SELECT *, sha256(content) AS content_hash, {tokens(block)} AS tokens FROM {name}_c)"""


def node_id(kind: str, level: str, index: str, input_hash: str) -> str:
    return f"'{kind.lower()}_' || left(sha256(job_id || '|{kind}|' || {level} || '|' || {index} || '|' || {input_hash}), 24)"
