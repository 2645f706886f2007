"""Prompt texts of the three stages, per-job overrides and report formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.text import let, strip

# Default prompt texts and report instructions, and below them the keys and
# limits (FORMAT_KEYS, INSTRUCTION_KEYS, SHAPE_KEYS, NO_INSTRUCTION and the lengths).
# Summaries, token counts and hashes depend on every character of them.
RESULT_SHAPE = (
    "Return exactly one JSON object with this schema and no alternate top-level keys: "
    '{"ok": true, "summary": "string", "key_points": ["string"], "warnings": ["string"], "source_count": 1}. '
    "Put all narrative content inside summary and key_points."
)
SYSTEM_TEXT = {
    "map": (
        "You summarize one part of a large context. "
        + RESULT_SHAPE
        + " Keep the summary concise, factual, and grounded in the provided text."
    ),
    "reduce": (
        "You merge several partial summaries into one consolidated summary. "
        + RESULT_SHAPE
        + " Preserve important facts and remove duplicates."
    ),
    "final": (
        "You produce the final user-facing report from the consolidated context. "
        + RESULT_SHAPE
        + " Put the complete report in summary. Use key_points and warnings only when the user explicitly requested"
        " those fields. Choose clear headings, bullets, or prose inside summary when no specific report structure was"
        " requested. Be concise and explicit about uncertainty."
    ),
}
SHAPED_SYSTEM_TEXT = {
    "map": (
        "You summarize one part of a large context into a structured intermediate JSON object. "
        "Return exactly one valid JSON object. Do not wrap it in Markdown and do not add prose outside JSON. "
        "Match the requested intermediate output JSON structure as closely as possible. "
        "Keep the content concise, factual, and grounded in the provided text."
    ),
    "reduce": (
        "You merge several partial structured summaries into one consolidated intermediate JSON object. "
        "Return exactly one valid JSON object. Do not wrap it in Markdown and do not add prose outside JSON. "
        "Match the requested intermediate output JSON structure as closely as possible. "
        "Preserve important facts, remove duplicates, and keep sequence-sensitive evidence in order when relevant."
    ),
    "final": (
        "You produce the final user-facing JSON object from the consolidated context. "
        "Return exactly one valid JSON object. Do not wrap it in Markdown and do not add prose outside JSON. "
        "Match the user-provided output JSON structure as closely as possible."
    ),
}
USER_TEXT = {
    "map": "Summarize this chunk:\n\n{chunk}",
    "reduce": "Merge these summaries:\n\n{summaries}",
    "final": (
        "Create the final user-facing report from these summaries. "
        "If the user did not request a specific structure, choose the most useful report structure yourself. "
        "Return the transport JSON schema, but put the whole report in the summary string.\n\n"
        "{summaries}"
    ),
}
SHAPED_USER_TEXT = {
    "map": (
        "Summarize this chunk into the requested intermediate JSON structure.\n\n"
        "Intermediate output JSON structure:\n{intermediate_output_json_schema}\n\nChunk:\n\n{chunk}"
    ),
    "reduce": (
        "Merge these intermediate JSON summaries into one JSON object that follows the requested structure.\n\n"
        "Intermediate output JSON structure:\n{intermediate_output_json_schema}\n\nSummaries:\n\n{summaries}"
    ),
    "final": (
        "Create the final JSON response from these summaries.\n\n"
        "Output JSON structure to follow:\n{output_json_schema}\n\n"
        "Additional report/prompt instruction:\n{report_format_instruction}\n\nSummaries:\n\n{summaries}"
    ),
}
REPORT_USER_TEXT = (
    "Create the final user-facing report from these summaries.\n\n"
    "Desired report format:\n{report_format_instruction}\n\n"
    "Return the SummaryResult transport JSON schema, but put the complete requested report in the summary string. "
    "Do not split the user-facing report into default key_points or warnings sections unless the user asked for those"
    " fields.\n\nSummaries:\n\n{summaries}"
)
NO_INSTRUCTION = "Use the source evidence faithfully."
REPORT_FORMATS = {
    "default": "Write a concise operational summary in clear prose.",
    "incident_report": (
        "Write the summary as an incident report. Include compact sections inside the summary text: "
        "Overview, impact, timeline, likely cause, mitigation, follow-ups, and open questions."
    ),
    "executive_summary": (
        "Write for leadership. Focus on business impact, current status, risk, decisions needed, "
        "and avoid low-level log detail unless it materially changes the conclusion."
    ),
    "technical_rca": (
        "Write as a technical RCA. Emphasize symptoms, evidence, causal chain, affected components, "
        "remediation, verification, and remaining uncertainty."
    ),
    "bullet_points": (
        "Write the summary as dense bullet-style findings. Keep each bullet factual and action-oriented."
    ),
    "markdown": (
        "Use Markdown headings and bullets inside the summary string. Keep the response JSON schema unchanged."
    ),
}
FORMAT_KEYS = ["report_format", "output_format", "desired_output_format"]
INSTRUCTION_KEYS = ["report_format_instruction", "output_format_instruction"]
SHAPE_KEYS = {
    "map": ["map_output_json_schema", "intermediate_output_json_schema", "map_reduce_output_json_schema"],
    "reduce": ["reduce_output_json_schema", "intermediate_output_json_schema", "map_reduce_output_json_schema"],
    "final": ["output_json_schema", "final_output_json_schema", "response_json_schema"],
}
INSTRUCTION_LIMIT = 1200
SYSTEM_LIMIT = 4000
USER_LIMIT = 8000


def _first_filled(json_text: Column, paths: Sequence[str]) -> Column:
    """First value that is not empty, stripped; empty text if there is none."""
    filled = [F.when(value != "", value) for value in (F.get_json_object(json_text, path) for path in paths)]
    return strip(F.coalesce(*filled, F.lit("")))


def report_format(metadata: Column) -> Column:
    """Report format and instruction asked for by job metadata (JSON); null if none."""
    named = _first_filled(metadata, [f"$.{key}" for key in FORMAT_KEYS])
    wish = _first_filled(metadata, [f"$.{key}" for key in INSTRUCTION_KEYS])
    known = F.create_map(*[F.lit(item) for pair in REPORT_FORMATS.items() for item in pair])

    def resolve(asked: Column) -> Column:
        name, extra = asked["name"], asked["extra"]
        standard = F.try_element_at(known, name)
        own = F.when(extra != "", extra).when(name != "custom", name)
        cut = F.substring(extra, 1, INSTRUCTION_LIMIT)
        text = F.when(
            standard.isNotNull(),
            F.when(extra == "", standard).otherwise(F.concat(standard, F.lit("\nAdditional user instruction: "), cut)),
        ).otherwise(F.substring(own, 1, INSTRUCTION_LIMIT))
        answer = F.struct(
            F.when(standard.isNotNull(), name).otherwise("custom").alias("report_format"),
            text.alias("report_format_instruction"),
        )
        return F.when((name != "") & (F.coalesce(text, F.lit("")) != ""), answer)

    return let(F.struct(named.alias("name"), wish.alias("extra")), resolve)


def prompt_override(metadata: Column, stage: str, part: str) -> Column:
    """A job's own system or user text for a stage, cut to its limit; null if none."""
    base = f"$.prompt_overrides.{stage}"
    if part == "system":
        text = F.substring(_first_filled(metadata, [f"{base}.system"]), 1, SYSTEM_LIMIT)
    else:
        text = F.substring(_first_filled(metadata, [f"{base}.user", f"{base}.user_template"]), 1, USER_LIMIT)
    return F.when(text != "", text)


def wanted_shape(metadata: Column, stage: str) -> Column:
    """The output shape a job asks for in a stage: the first key that holds a filled JSON object."""

    def filled(path: str) -> Column:
        text = F.get_json_object(metadata, path)
        return F.when(F.size(F.json_object_keys(text)) > 0, text)

    return F.coalesce(*[filled(f"$.{key}") for key in SHAPE_KEYS[stage]])


def render_prompt(template: Column, values: Sequence[tuple[str, Column]]) -> Column:
    """Replace ``{name}`` by its value, one name after the other.

    The order counts: a value may itself hold a later name in braces.
    """
    for name, value in values:
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def map_user(chunk: Column, template: Column | None = None, shape: Column | None = None) -> Column:
    return _stage_user("map", "chunk", chunk, template, shape)


def reduce_user(summaries: Column, template: Column | None = None, shape: Column | None = None) -> Column:
    return _stage_user("reduce", "summaries", summaries, template, shape)


def _stage_user(stage: str, name: str, text: Column, template: Column | None, shape: Column | None) -> Column:
    if template is None and shape is None:
        return render_prompt(F.lit(USER_TEXT[stage]), [(name, text)])
    wanted = F.coalesce(shape, F.lit("")) if shape is not None else F.lit("")
    default = F.when(wanted != "", SHAPED_USER_TEXT[stage]).otherwise(USER_TEXT[stage])
    chosen = F.coalesce(template, default) if template is not None else default
    values = [(name, text), ("intermediate_output_json_schema", wanted), ("output_json_schema", wanted)]
    return render_prompt(chosen, values)


def final_user(
    summaries: Column,
    instruction: Column | None = None,
    template: Column | None = None,
    shape: Column | None = None,
) -> Column:
    if instruction is None and template is None and shape is None:
        return render_prompt(F.lit(USER_TEXT["final"]), [("summaries", summaries)])
    said = F.coalesce(instruction, F.lit("")) if instruction is not None else F.lit("")
    wanted = F.coalesce(shape, F.lit("")) if shape is not None else F.lit("")
    own = template if template is not None else F.lit(None).cast("string")
    shaped = render_prompt(
        F.coalesce(own, F.lit(SHAPED_USER_TEXT["final"])),
        [
            ("summaries", summaries),
            ("report_format_instruction", F.when(said != "", said).otherwise(NO_INSTRUCTION)),
            ("output_json_schema", wanted),
        ],
    )
    plain = render_prompt(
        F.coalesce(own, F.lit(USER_TEXT["final"])),
        [("summaries", summaries), ("report_format_instruction", said), ("output_json_schema", wanted)],
    )
    report = F.replace(
        F.replace(F.lit(REPORT_USER_TEXT), F.lit("{report_format_instruction}"), said), F.lit("{summaries}"), summaries
    )
    return F.when(wanted != "", shaped).when(own.isNull() & (said != ""), report).otherwise(plain)
