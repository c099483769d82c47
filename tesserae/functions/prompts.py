"""Prompt texts of the model stages and their assembly."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.geometry import tile_x, tile_y
from tesserae.functions.text import json_list, json_object, json_string

LEGACY = "legacy-v1"
PAPER = "paper-prompts-nonthinking-2x-v1"
CONTEXT = "paper-prompts-context-restored-v3"
PROTOCOLS = (LEGACY, PAPER, CONTEXT)

# Template wording that prompts must reproduce exactly.
GENERIC = "Please describe the pathology features in this image."
QUESTION = (
    "Please describe the pathology features related to the question: {question} in this image."
)
PREDICT = (
    "--- Patch Descriptions ---\n{description}\n--- End ---\nQuestion: {question}{choices}\n"
    "Now output the JSON with 'answer' and 'thinking_steps'."
)
REFLECT = (
    "Descriptions:\n{description}\n\nQuestion: {question}{choices}\n\n"
    "Previous answer and reasoning:\n{answer}\n\n"
    'Only return a JSON object: {{"sufficient": "Yes" or "No"}}'
)
MISSING = (
    "Descriptions:\n{description}\n\nQuestion: {question}{choices}\n\n"
    "Now provide the JSON for missing info and zoom recommendation.\n"
    "Scale means {scale_description}. Available zoom levels: {allowed_scales}."
)
CONTEXT_MISSING = (
    "Descriptions:\n{description}\n\nQuestion: {question}{choices}\n\n"
    "Previous answer and reasoning:\n{prediction}\n\n"
    "Previous reflection:\n{reflection}\n\n"
    "Now provide the JSON for missing info and zoom recommendation.\n"
    "Scale means {scale_description}. Available zoom levels: {allowed_scales}."
)
FINAL = (
    "Question: {question}{choices}\n\nNow, based on the following patch-level descriptions of "
    "the slide, determine the **slide-level result** that directly answers the question.\n\n"
    "--- Patch Descriptions ---\n{description}\n--- End of Descriptions ---\n\n"
    "Prior inferences and actions:\n{history}\n\n"
    'Answer in JSON format with keys "answer" and "explanation" (both strings). '
    "If choices are provided, answer must be exactly one option text or its label."
)
LEGACY_CONTEXT = "Descriptions:\n{description}\nQuestion: {question}{choices}"
LEGACY_REFLECT = LEGACY_CONTEXT + "\nPrevious answer and reasoning:\n{answer}"
LEGACY_MISSING = (
    LEGACY_CONTEXT + "\nPrevious answer and reflection:\n{answer}"
    "\nScale means {scale_description}. Available zoom levels: {allowed_scales}."
)
LEGACY_FINAL = (
    "Question: {question}{choices}\nAccumulated region evidence:\n{description}\n"
    "Prior inferences and actions:\n{history}"
)
PERCEPTOR_SYSTEM = (
    "A conversation between a curious user and an AI medical assistant specialized in pathology "
    "image analysis. The assistant can interpret pathology images, describe observed features, "
    "and provide possible explanations based on medical knowledge, but will never give a "
    "definitive diagnosis or prescribe treatment. The assistant must always maintain a polite, "
    "clear, and professional tone. All answers should be supported by established, reliable "
    "medical sources. The assistant should carefully consider visual details in pathology "
    "images, such as cell morphology, staining patterns, and tissue architecture."
)
LEGACY_PERCEPTOR_SYSTEM = (
    "You are an AI assistant specialized in describing visible pathology features."
)
PREDICT_SYSTEM = (
    "You are an expert AI pathology assistant. Your task is trying to answer the question "
    "step-by-step based on the patch descriptions. Output ONLY a JSON object: "
    '{"answer": "the final predicted answer (string)", '
    '"thinking_steps": "your detailed reasoning, step-by-step (string)"}.'
)
REFLECT_SYSTEM = (
    "You are an expert AI pathology assistant. Your task is to judge whether the current patch "
    "descriptions are sufficient to confidently support the answer. Output ONLY a JSON object: "
    '{"sufficient": "Yes" or "No"}.'
)
MISSING_SYSTEM = (
    "You are an expert AI pathology assistant. Your task is to specify what visual evidence is "
    "missing and whether zooming in could help obtain that evidence. Output ONLY a JSON object: "
    '{"missing_info": "noun phrase", "zoom_recommendation": "Yes" or "No", '
    '"recommended_zoom_level": "None" or an integer like 10 or 20 or 40, '
    '"zoom_reason": "brief reason why zooming helps"}.'
)
FINAL_SYSTEM = (
    "You are an expert slide-level pathology assistant. You will be given a question and "
    "detailed patch-level descriptions of a pathology slide. Your task is to infer the specific "
    "slide-level diagnostic result based on the provided evidence \u2014 not to define or explain "
    "the medical term itself. The answer should directly reflect the information observable in "
    "the slide, such as biomarker expression level, presence or absence of features, or a "
    "numeric measurement."
)
SUMMARY_SYSTEM = (
    "Summarize visible pathological findings, preserving region coordinates and each region's "
    "scale. Do not give a final answer or diagnosis."
)
LEGACY_PREDICT_SYSTEM = (
    "You are an expert AI pathology assistant. Based on the patch descriptions, try to answer "
    "the question step-by-step. Output ONLY JSON: "
    '{"answer": "predicted answer", "thinking_steps": "reasoning"}.'
)
LEGACY_REFLECT_SYSTEM = (
    "Judge whether the current patch descriptions are sufficient to confidently support the "
    'answer. Output ONLY JSON: {"sufficient": "Yes" or "No"}.'
)
LEGACY_MISSING_SYSTEM = (
    "Specify missing visual evidence and whether zooming helps. Output ONLY JSON with keys "
    "missing_info (short noun phrase), zoom_recommendation (Yes or No), zoom_level (number or "
    "null), zoom_reason (string)."
)
LEGACY_FINAL_SYSTEM = (
    "You are an expert slide-level pathology assistant. Integrate all visual evidence and prior "
    "inferences to answer the specific question. Keep answer short. If choices are given, return "
    "exactly one option text or its label. Output ONLY JSON with answer and explanation (both "
    "strings)."
)
SUMMARY_USER = "Question: {question}\n{description}"
CONTEXT_PERCEPTOR = "{metadata}\n{instruction}"
ZOOM_MISSING = "\nMissing visual information to inspect: {missing_info}"
RETRY = "Return one valid JSON object with the required keys and valid field values only."
SCALE_DESCRIPTIONS = {
    "physical": "absolute magnification",
    "relative": "relative crop factor; physical magnification is unknown",
}

TEMPLATES = {
    LEGACY: {
        "predict": LEGACY_CONTEXT,
        "reflect": LEGACY_REFLECT,
        "missing_info": LEGACY_MISSING,
        "final": LEGACY_FINAL,
    },
    PAPER: {"predict": PREDICT, "reflect": REFLECT, "missing_info": MISSING, "final": FINAL},
    CONTEXT: {
        "predict": PREDICT,
        "reflect": REFLECT,
        "missing_info": CONTEXT_MISSING,
        "final": FINAL,
    },
}

_PAPER_SYSTEMS = {
    "predict": PREDICT_SYSTEM,
    "reflect": REFLECT_SYSTEM,
    "missing_info": MISSING_SYSTEM,
    "final": FINAL_SYSTEM,
    "describe": PERCEPTOR_SYSTEM,
}
SYSTEMS = {
    LEGACY: {
        "describe": LEGACY_PERCEPTOR_SYSTEM,
        "predict": LEGACY_PREDICT_SYSTEM,
        "reflect": LEGACY_REFLECT_SYSTEM,
        "missing_info": LEGACY_MISSING_SYSTEM,
        "final": LEGACY_FINAL_SYSTEM,
    },
    PAPER: _PAPER_SYSTEMS,
    CONTEXT: _PAPER_SYSTEMS,
}


def messages(system: str, user: Column, retry: bool = False) -> Column:
    """Chat messages as a JSON list; a retry asks once more for the right format."""
    listed = [("system", F.lit(system)), ("user", user)]
    if retry:
        listed.append(("user", F.lit(RETRY)))
    return json_list(
        *[json_object(role=F.lit(f'"{role}"'), content=json_string(text)) for role, text in listed]
    )


def fill(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` slots as one ``concat`` over literals and columns."""
    parts: list[Column] = []
    for literal, name in slots(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(fields[name])
    return F.concat(*parts)


def slots(template: str) -> list[tuple[str, str | None]]:
    return [(literal, name) for literal, name, _, _ in Formatter().parse(template)]


def choices_block(choices: Column) -> Column:
    lines = F.array_join(
        F.transform(choices, lambda entry: F.concat(entry.label, F.lit(". "), entry.text)), "\n"
    )
    return F.when(F.size(choices) > 0, F.concat(F.lit("\nChoices:\n"), lines)).otherwise("")


def scale_text(scale: Column) -> Column:
    """A whole scale prints without a fraction only when it is an integer column."""
    return scale.cast("string")


def region_line(
    region_id: Column,
    x: Column,
    y: Column,
    width: Column,
    height: Column,
    scale_kind: Column,
    scale: Column,
    source: Column,
) -> Column:
    """One line that tells a model which part of the image it sees."""
    bounds = F.concat_ws(",", *[side.cast("string") for side in (x, y, width, height)])
    kind = F.when(scale_kind == "physical", "Magnification").otherwise("Relative crop scale")
    return F.concat(
        F.lit("Region="),
        region_id,
        F.lit("; Original-pixel bounds=("),
        bounds,
        F.lit("); "),
        kind,
        F.lit("="),
        scale_text(scale),
        F.lit("x; Scale source="),
        source,
    )


def patch_line(name: Column, text: Column, with_coords: bool = True) -> Column:
    """``[name | Coord=(x,y)] text``, or ``(unknown)`` when the name holds no position."""
    if not with_coords:
        return F.concat(F.lit("["), name, F.lit("] "), text)
    x, y = tile_x(name), tile_y(name)
    coord = F.when(
        x.isNotNull() & y.isNotNull(),
        F.concat(F.lit("("), x.cast("string"), F.lit(","), y.cast("string"), F.lit(")")),
    ).otherwise("(unknown)")
    return F.concat(F.lit("["), name, F.lit(" | Coord="), coord, F.lit("] "), text)


def magnification_header(level: Column) -> Column:
    return F.concat(F.lit("[Current Magnification: "), level.cast("string"), F.lit("x]\n\n"))


def perceptor_prompt(
    protocol: str, metadata: Column, question: Column | None, missing_info: Column | None
) -> Column:
    """What is asked about one region; one protocol leaves out where it lies and what is missing."""
    instruction = F.lit(GENERIC) if question is None else fill(QUESTION, question=question)
    if protocol == PAPER:
        return instruction
    prompt = fill(CONTEXT_PERCEPTOR, metadata=metadata, instruction=instruction)
    if missing_info is None:
        return prompt
    extra = fill(ZOOM_MISSING, missing_info=missing_info)
    return F.concat(
        prompt, F.when(F.coalesce(missing_info, F.lit("")) != "", extra).otherwise("")
    )


def is_terminal(protocol: str, status: Column) -> Column:
    """Is a stored result final? The first protocol repeats invalid ones."""
    return (status == "ok") if protocol == LEGACY else status.isin("ok", "invalid")
