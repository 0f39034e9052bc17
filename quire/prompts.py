"""Prompt templates (``{{ name }}`` slots) filled by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.errors import ConfigError

DEFAULT = {
    "page_summary": "Summarise the page below in about five sentences.\n\n{{ text }}",
    "extract": (
        "List the entities and relations of page {{ page }} as JSON: an object with `ops` holding `add_nodes` and "
        "`add_edges`. Cite component ids in `source_components`.\nEntity types: {{ types }}\nVisual types: {{ visual_types }}\n\n"
        "Page text:\n{{ text }}\n\nComponents:\n{{ manifest }}"
    ),
    "reflect": (
        "Review what was extracted from page {{ page }}. Reply with JSON: summary, focus_cues, component_reviews, "
        "critiques, stop_recommendation. Statuses: covered, partially_covered, uncovered, needs_visual_inspection, "
        "irrelevant.\n\nPage text:\n{{ text }}\n\nComponents:\n{{ manifest }}\n\nExtracted:\n{{ scorecard }}"
    ),
    "revise": (
        "Revise the extraction of page {{ page }}. Reply as JSON `ops` with adds, replaces and deletes.\n\nPage text:\n"
        "{{ text }}\n\nComponents:\n{{ manifest }}\n\nExtracted:\n{{ scorecard }}\n\nReview:\n{{ brief }}"
    ),
    "judge": (
        "Which candidates denote or relate to the source entity? Reply with a JSON list of objects: candidate, "
        "decision (same_as, related or no), relation, rs (0 to 10), rationale.\n\nSource:\n{{ source }}\n\n"
        "Candidates:\n{{ candidates }}"
    ),
    "route": (
        "Choose the route of this question: single, multi or document_level. Reply as JSON with route, confidence, "
        "rationale.\n\nQuestion: {{ question }}"
    ),
    "answer_images": (
        "Answer from the attached pages ({{ pages }}). Reply as JSON: answer, reasoning, cited_pages, confidence, "
        "failure_reason.\n\nQuestion: {{ question }}"
    ),
    "answer_texts": (
        "Answer from the evidence. {{ guidelines }} Reply as JSON: answer, reasoning, cited_pages, confidence, "
        "failure_reason.\n\nQuestion: {{ question }}\n\nEvidence:\n{{ evidence }}"
    ),
    "fuse": (
        "Merge two draft answers into one. Reply as JSON: answer, reasoning, cited_pages, confidence.\n\n"
        "Question: {{ question }}\n\nFrom images:\n{{ image_draft }}\n\nFrom text:\n{{ text_draft }}"
    ),
}
SETS: dict[str, dict[str, str]] = {"default": DEFAULT}


def template(name: str, prompt_set: str = "default") -> str:
    try:
        return SETS[prompt_set][name]
    except KeyError as e:
        raise ConfigError(f"no prompt {name!r} in set {prompt_set!r}") from e


def render(text: str, /, **slots: Column | str) -> Column:
    """Fill every ``{{ name }}`` slot in one pass; slot values are never rescanned."""
    parts: list[Column] = []
    rest = text
    while "{{" in rest:
        before, _, tail = rest.partition("{{")
        name, _, rest = tail.partition("}}")
        value = slots[name.strip()]
        parts += [F.lit(before), F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))
