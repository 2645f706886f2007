"""Queries over rows and texts: normalising, tokens, hashes, prompts, segmenting."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.catalog import duck
from logweir.catalog.fixtures import Tables
from logweir.catalog.registry import query
from logweir.functions import ids, prompts, records, text
from logweir.functions.scalars import mask_url_credentials, safe_filename, sorted_json
from logweir.functions.summaries import dry_result
from logweir.operators import segments
from logweir.sources.formats import detect_format
from logweir.sources.query import preview, read_query

KEEP = ("job_id", "pos")
BUDGET = 256


def log_records(t: Tables):
    return records.accepted(records.normalize_columns(t.raw_rows, keep=KEEP))


@query(
    "n1_clean_row",
    "",
    """SELECT event_id, '{"kind":"' || event_type || '","none":"","props":' || CAST(to_json(props) AS VARCHAR) || '}' AS cells FROM events""",
)
def n1(t: Tables):
    row = F.create_map(
        F.lit(" props\t"), F.concat(F.lit("  "), F.col("props"), F.lit("\n")),
        F.lit("kind"), F.col("event_type"),
        F.lit("none"), F.lit(None).cast("string"),
    )
    return t.read("events").select("event_id", sorted_json(records.clean_map(row)).alias("cells"))


@query(
    "n2_pick_column",
    "",
    """SELECT event_id,
      CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN event_type ELSE event_type || ' ' || CAST(event_id AS VARCHAR) END AS raw_line,
      CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR) ELSE '' END AS timestamp,
      CASE event_id % 3 WHEN 0 THEN '{"Line":"' || event_type || '"}' WHEN 1 THEN '{"MESSAGE":' || CAST(to_json(props) AS VARCHAR) || '}' ELSE '{}' END AS attrs
    FROM events""",
)
def n2(t: Tables):
    events = t.read("events")
    row = (
        F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("Line"), F.col("event_type"), F.lit("MESSAGE"), F.col("props")))
        .when(F.col("event_id") % 3 == 1, F.create_map(F.lit("MESSAGE"), F.col("props"), F.lit("Log"), F.col("event_type")))
        .otherwise(F.create_map(F.lit("other"), F.col("event_type"), F.lit("Time"), F.col("event_id").cast("string"), F.lit("text"), F.lit(" ")))
    )
    # The third kind has no log text of its own: its cells are joined and stay attributes too.
    normal = records.normalize_rows(events.withColumn("row", row), "row", keep=["event_id"])
    attrs = F.when(F.col("event_id") % 3 == 2, F.create_map().cast("map<string,string>")).otherwise(F.col("attrs"))
    return normal.select("event_id", "raw_line", "timestamp", F.to_json(attrs).alias("attrs"))


@query(
    "n3_normalize",
    "log_records",
    " SELECT job_id, pos, raw_line, timestamp, end_time, namespace, container_name, pod_name FROM log_records",
)
def n3(t: Tables):
    return log_records(t).drop("attrs")


@query(
    "n4_collect_attrs",
    "log_records",
    """ SELECT job_id, pos, '{"k":"' || k || '"' || CASE WHEN shard <> '' THEN ',"shard":"' || shard || '"' ELSE '' END || '}' AS attrs FROM log_records""",
)
def n4(t: Tables):
    return log_records(t).select("job_id", "pos", sorted_json(F.col("attrs")).alias("attrs"))


@query("n5_render_record", "log_records", " SELECT job_id, pos, line AS rendered, tokens FROM lines")
def n5(t: Tables):
    return records.rendered(log_records(t)).select("job_id", "pos", "rendered", "tokens")


@query("n6_estimate_tokens", "", f"SELECT doc_id, {duck.tokens('text')} AS tokens FROM documents")
def n6(t: Tables):
    return t.read("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "n7_hashes_and_node_ids",
    "",
    f"""WITH d AS (SELECT doc_id, 'job_' || lang AS job_id, sha256(text) AS content_hash FROM documents)
    SELECT doc_id, content_hash, left(content_hash, 16) AS short_hash, {duck.node_id('MAP', '0', 'doc_id', 'content_hash')} AS node_id FROM d""",
)
def n7(t: Tables):
    docs = t.read("documents").select(
        "doc_id", F.concat(F.lit("job_"), "lang").alias("job_id"), ids.content_hash(F.col("text")).alias("content_hash"),
        ids.short_hash(F.col("text")).alias("short_hash"),
    )
    made = ids.node_id(F.col("job_id"), "MAP", F.lit(0), F.col("doc_id"), F.col("content_hash"))
    return docs.withColumn("node_id", made).drop("job_id")


@query(
    "n8_safe_filename",
    "",
    r"""WITH names AS (SELECT doc_id, text AS name FROM documents UNION ALL SELECT -page_id - 1, url FROM pages)
    , safe AS (SELECT doc_id, name, regexp_replace(regexp_replace(name, '[^\p{L}\p{N}._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM names)
    SELECT doc_id AS name_id, CASE WHEN s = '' THEN 'upload' ELSE s END AS filename FROM safe""",
)
def n8(t: Tables):
    docs = t.read("documents").select(F.col("doc_id").alias("name_id"), F.col("text").alias("name"))
    urls = t.read("pages").select((-F.col("page_id") - 1).alias("name_id"), F.col("url").alias("name"))
    return docs.unionByName(urls).select("name_id", safe_filename(F.col("name")).alias("filename"))


@query(
    "n9_mask_url_credentials",
    "",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://***:***@') ELSE url END AS url FROM pages""",
)
def n9(t: Tables):
    secret = F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://user"), F.col("page_id").cast("string"), F.lit(":p@ss@")))
    given = F.when(F.col("page_id") % 2 == 0, secret).otherwise(F.col("url"))
    return t.read("pages").select("page_id", mask_url_credentials(given).alias("url"))


METADATA = {
    "signup": '{"report_format": "markdown"}',
    "view": '{"report_format": "", "output_format": " Shout it "}',
    "click": '{"report_format": "custom", "output_format_instruction": "only facts"}',
    "purchase": '{"desired_output_format": "technical_rca", "report_format_instruction": "be brief"}',
}


@query(
    "n12_resolve_report_format",
    "",
    f"""SELECT event_id, CASE event_type WHEN 'signup' THEN 'markdown' WHEN 'purchase' THEN 'technical_rca' WHEN 'error' THEN NULL ELSE 'custom' END AS report_format,
      CASE event_type WHEN 'signup' THEN {duck.quoted(prompts.REPORT_FORMATS['markdown'])} WHEN 'view' THEN 'Shout it' WHEN 'click' THEN 'only facts'
        WHEN 'purchase' THEN {duck.quoted(prompts.REPORT_FORMATS['technical_rca'])} || chr(10) || 'Additional user instruction: be brief' END AS report_format_instruction
    FROM events""",
)
def n12(t: Tables):
    kinds = F.create_map(*[F.lit(item) for pair in METADATA.items() for item in pair])
    metadata = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("{}"))
    resolved = t.read("events").select("event_id", prompts.report_format(metadata).alias("f"))
    return resolved.select("event_id", "f.report_format", "f.report_format_instruction")


@query(
    "n13_render_prompt",
    "",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN
        replace(replace('Look: {chunk} Shape: {output_json_schema} {other}', '{chunk}', chunk), '{output_json_schema}', '{"a":1}')
      WHEN event_id % 3 = 1 THEN 'Summarize this chunk into the requested intermediate JSON structure.' || chr(10) || chr(10)
        || 'Intermediate output JSON structure:' || chr(10) || '{"a":1}' || chr(10) || chr(10) || 'Chunk:' || chr(10) || chr(10) || replace(chunk, '{output_json_schema}', '{"a":1}')
      ELSE 'Summarize this chunk:' || chr(10) || chr(10) || replace(chunk, '{output_json_schema}', '') END AS prompt
    FROM (SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN ' {output_json_schema}' ELSE '' END AS chunk FROM events)""",
)
def n13(t: Tables):
    even = F.when(F.col("event_id") % 2 == 0, " {output_json_schema}").otherwise("")
    own = '{"prompt_overrides": {"map": {"user_template": " Look: {chunk} Shape: {output_json_schema} {other}"}}}'
    metadata = F.when(F.col("event_id") % 3 == 0, own)
    shape = F.when(F.col("event_id") % 3 < 2, '{"a":1}')
    prompt = prompts.map_user(F.concat("event_type", even), prompts.prompt_override(metadata, "map", "user"), shape)
    return t.read("events").select("event_id", prompt.alias("prompt"))


@query(
    "s5_detect_format",
    "",
    """WITH files AS (SELECT event_id, event_id % 8 AS n, event_id % 5 AS c, event_id % 7 AS r FROM events)
    SELECT event_id, CASE WHEN r = 0 THEN 'markdown' WHEN r = 1 THEN NULL
      WHEN n = 0 THEN 'json' WHEN n = 1 THEN 'markdown' WHEN n = 2 THEN 'csv' WHEN n = 3 THEN 'csv'
      WHEN c = 0 THEN 'json' WHEN c = 1 THEN 'markdown' WHEN n IN (4, 5) THEN 'plain_text' WHEN c = 2 THEN 'plain_text' ELSE 'csv' END AS source_format
    FROM files""",
)
def s5(t: Tables):
    names = F.array(*[F.lit(x) for x in ("a/b.JSON", "b.markdown", "c.csv", "d.tsv", "e.log", "f.txt", "g", "h.gz")])
    kinds = F.array(*[F.lit(x) for x in ("application/json", "text/markdown", "text/plain; charset=utf-8", "application/octet-stream", "")])
    asked = F.when(F.col("event_id") % 7 == 0, " Markdown ").when(F.col("event_id") % 7 == 1, "xml").otherwise("auto")
    pick = lambda items, n: F.get(items, (F.col("event_id") % n).cast("int"))
    return t.read("events").select("event_id", detect_format(pick(names, 8), pick(kinds, 5), asked).alias("source_format"))


@query(
    "s6_read_query",
    "",
    """SELECT event_id, event_type || ' ' || props AS raw_line, strftime(ts, '%Y-%m-%d') AS timestamp, '{"value":"' || CAST(floor(value) AS BIGINT) || '"}' AS attrs
    FROM events""",
)
def s6(t: Tables):
    t.read("events").createOrReplaceTempView("logweir_source_events")
    sql = """SELECT event_id, date_format(ts, 'yyyy-MM-dd') AS time, concat(event_type, ' ', props) AS log, CAST(floor(value) AS BIGINT) AS value
        FROM logweir_source_events;"""
    found = read_query(t.spark, sql, keep=("event_id",))
    return records.accepted(found).select("event_id", "raw_line", "timestamp", F.to_json("attrs").alias("attrs"))


@query("s7_preview", "", "SELECT event_id, event_type, props FROM events ORDER BY event_id LIMIT 500")
def s7(t: Tables):
    t.read("events").createOrReplaceTempView("logweir_source_events")
    return preview(t.spark, "SELECT event_id, event_type, props FROM logweir_source_events ORDER BY event_id", 9999)


@query(
    "s8_split_text_units",
    "",
    f"WITH {duck.units_cte('documents', 'doc_id', 'text')} SELECT doc_id, CAST(unit_index AS INT) AS unit_index, unit FROM units",
)
def s8(t: Tables):
    units = text.text_units(F.col("text"))
    return t.spread("documents").select("doc_id", F.posexplode(units).alias("unit_index", "unit"))


TURN_UNITS = duck.units_cte("turns", "turn_id", "text")


@query(
    "s8_conversation_units",
    "",
    f"WITH turns AS (SELECT conv_id * 1000000 + turn AS turn_id, text FROM conversations), {TURN_UNITS} SELECT turn_id, CAST(unit_index AS INT) AS unit_index, unit FROM units",
)
def s8_turns(t: Tables):
    turns = t.spread("conversations").withColumn("turn_id", F.col("conv_id") * 1000000 + F.col("turn"))
    return turns.select("turn_id", F.posexplode(text.text_units(F.col("text"))).alias("unit_index", "unit"))


@query(
    "c2_split_large_units",
    "",
    f"""WITH {duck.units_cte('documents', 'doc_id', 'text')}, {duck.pieces_cte('doc_id', 40)}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_index, piece_index) - 1 AS INT) AS piece_index, piece FROM pieces""",
)
def c2(t: Tables):
    pieces = text.split_long_units(text.text_units(F.col("text")), 40)
    return t.spread("documents").select("doc_id", F.posexplode(pieces).alias("piece_index", "piece"))


CHUNKS = f"""WITH RECURSIVE {duck.units_cte('documents', 'doc_id', 'text')}, {duck.pieces_cte('doc_id', 2 * BUDGET)}
, ordered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_index, piece_index) - 1 AS idx, piece, {duck.tokens('piece')} AS tokens FROM pieces)
, {duck.packed_cte('packed', 'ordered', 'doc_id', BUDGET)}"""


@query(
    "c3_build_chunks",
    "",
    CHUNKS
    + """ SELECT o.doc_id, grp AS chunk_index, string_agg(piece, chr(10) || chr(10) ORDER BY o.idx) AS content
    FROM ordered o JOIN packed p ON p.doc_id = o.doc_id AND p.idx = o.idx GROUP BY o.doc_id, grp""",
)
def c3(t: Tables):
    return segments.build_chunks(t.read("documents"), "doc_id", "text", BUDGET)


def log_segments(t: Tables, budget: int = BUDGET):
    return segments.segment_rows(log_records(t), "job_id", ["pos"], budget, "upload", "csv")


SEGMENTS = f""", numbered AS (SELECT job_id, pos, row_number() OVER (PARTITION BY job_id ORDER BY pos) - 1 AS idx, timestamp, line, tokens FROM lines)
, {duck.packed_cte('packed', 'numbered', 'job_id', BUDGET)}
, segs AS (SELECT n.job_id, grp AS segment_index, string_agg(line, chr(10) ORDER BY n.idx) AS content, count(*) AS rows_count,
    min(timestamp) FILTER (timestamp <> '') AS first_timestamp, max(timestamp) FILTER (timestamp <> '') AS last_timestamp
  FROM numbered n JOIN packed p ON p.job_id = n.job_id AND p.idx = n.idx GROUP BY n.job_id, grp)"""


@query(
    "c1_segment_rows",
    "log_records",
    SEGMENTS
    + """ SELECT job_id, segment_index, 'upload' AS source_type, 'csv' AS source_format, sha256(content) AS content_hash, content,
      rows_count, length(content) AS chars, '{"first_timestamp":"' || first_timestamp || '","last_timestamp":"' || last_timestamp || '"}' AS metadata FROM segs""",
    recursive=True,
)
def c1(t: Tables):
    return log_segments(t).drop("first_timestamp", "last_timestamp")


@query(
    "k2_append_artifacts",
    "",
    "SELECT doc_id, sha256(text) AS content_hash, length(text) AS chars FROM documents",
)
def k2(t: Tables):
    from logweir.catalog.file_queries import work_folder
    from logweir.sources.commits import read_table
    from logweir.sources.sinks import append_artifacts

    docs = t.read("documents").select(
        "doc_id", F.lit("j").alias("job_id"), F.lit("n").alias("node_id"), F.lit("CHUNK").alias("artifact_type"),
        F.lit("CHUNK").alias("stage"), F.lit(0).alias("level"), F.col("text").alias("content"), F.lit("{}").alias("metadata"),
    )
    folder = work_folder(t)
    for _ in range(2):
        # The second time is a replay.
        append_artifacts(docs, folder, F.lit("2024-01-01").cast("timestamp"), "doc_id", commit="first")
    rows = read_table(t.spark, folder, "artifacts")
    return rows.select("doc_id", "content_hash", F.length("content").cast("long").alias("chars"))


@query(
    "k4_append_llm_calls",
    "",
    """SELECT event_id, sha256(props) AS request_hash, CASE WHEN event_type = 'error' THEN '' ELSE sha256(event_type) END AS response_hash FROM events""",
)
def k4(t: Tables):
    from logweir.catalog.file_queries import work_folder
    from logweir.sources.commits import read_table
    from logweir.sources.sinks import append_llm_calls

    calls = t.read("events").select(
        "event_id", F.lit("j").alias("job_id"), F.lit("n").alias("node_id"), F.col("ts").alias("created_at"),
        F.col("event_id").cast("string").alias("call_id"), F.col("props").alias("request_json"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("response_json"),
    )
    folder = work_folder(t)
    for _ in range(2):
        append_llm_calls(calls, folder, commit="first")
    return read_table(t.spark, folder, "llm_calls").select("event_id", "request_hash", "response_hash")


@query(
    "m3_dry_summary",
    "",
    f"""WITH asked AS (SELECT doc_id, 'MAP' AS stage, text AS "user" FROM documents), {duck.dry_cte('dry', 'asked')}
    SELECT doc_id, summary, array_to_string(points, '|') AS key_points, source_count FROM dry""",
)
def m3(t: Tables):
    docs = t.spread("documents").select("doc_id", dry_result(F.lit("MAP"), F.col("text")).alias("r"))
    return docs.select("doc_id", "r.summary", F.array_join("r.key_points", "|").alias("key_points"), "r.source_count")
