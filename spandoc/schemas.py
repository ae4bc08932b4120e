"""Declared schemas and the label scheme shared by all operators.

Column vocabulary of the long span table (one row per span)::

    entity_id STRING, k BIGINT (ordinal number), start_at BIGINT,
    end_at BIGINT (inclusive), label STRING

and of the entity table::

    entity_id STRING, char_count BIGINT, score BIGINT, grp STRING,
    subgrp STRING, split STRING [, text STRING]
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Annotation labels, their gap label, score range, seeds and thresholds.
RHETORICAL_LABELS = (
    "Lead",
    "Position",
    "Claim",
    "Counterclaim",
    "Rebuttal",
    "Evidence",
    "Concluding Statement",
)
GAP_LABEL = "Unannotated"
SCORE_MIN = 1
SCORE_MAX = 6
CONTROL_SEEDS = (13, 21, 42, 87, 101)
RIDGE_ALPHAS = (1.0, 10.0, 100.0)
FORBIDDEN_PREFIXES = (
    "prompt",
    "assignment",
    "competition",
    "gender",
    "grade",
    "ell_",
    "race_",
    "economically",
    "student_disability",
    "effectiveness",
    "holistic",
    "target",
)


@dataclass(frozen=True)
class LabelScheme:
    """Which labels exist, which one marks gaps, and the roles used by the order check."""

    labels: tuple[str, ...] = RHETORICAL_LABELS
    gap: str = GAP_LABEL
    lead: str = "Lead"
    position: str = "Position"
    claim: str = "Claim"
    closing: str = "Concluding Statement"

    @staticmethod
    def key(label: str) -> str:
        return label.replace(" ", "_")


DEFAULT_SCHEME = LabelScheme()
CHAT_SCHEME = LabelScheme(
    labels=("user", "assistant"), gap="system",
    lead="user", position="user", claim="assistant", closing="assistant",
)
EVENT_SCHEME = LabelScheme(
    labels=("click", "error", "purchase", "signup", "view"), gap="none",
    lead="signup", position="view", claim="click", closing="purchase",
)
FLAG_SCHEME = LabelScheme(
    labels=("A", "N", "R"), gap="none", lead="A", position="N", claim="R", closing="R",
)

SPAN_COLUMNS = ("entity_id", "k", "start_at", "end_at", "label")
# Total order of the spans of an entity; rows equal in all four are interchangeable.
SPAN_ORDER = ("start_at", "end_at", "label", "k")

# Raw annotation file: one row per span, document fields repeated on each row.
ANNOTATION_SCHEMA = T.StructType(
    [
        T.StructField("essay_id", T.StringType()),
        T.StructField("essay_id_comp", T.StringType()),
        T.StructField("competition_set", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("holistic_essay_score", T.DoubleType()),
        T.StructField("discourse_id", T.StringType()),
        T.StructField("discourse_start", T.DoubleType()),
        T.StructField("discourse_end", T.DoubleType()),
        T.StructField("discourse_text", T.StringType()),
        T.StructField("discourse_type", T.StringType()),
        T.StructField("discourse_type_num", T.StringType()),
        T.StructField("discourse_effectiveness", T.StringType()),
        T.StructField("hierarchical_id", T.StringType()),
        T.StructField("hierarchical_text", T.StringType()),
        T.StructField("hierarchical_label", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("source_text", T.StringType()),
        T.StructField("prompt_name", T.StringType()),
        T.StructField("assignment", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("grade_level", T.DoubleType()),
        T.StructField("ell_status", T.StringType()),
        T.StructField("race_ethnicity", T.StringType()),
        T.StructField("economically_disadvantaged", T.StringType()),
        T.StructField("student_disability_status", T.StringType()),
        T.StructField("essay_word_count", T.DoubleType()),
    ]
)
