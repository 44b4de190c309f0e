"""The report of scores: the queries' tables as one Markdown page."""

from __future__ import annotations

from textloom.plans import q_joins, q_more, q_scores
from textloom.sources.sinks import markdown

# Sections of the page: title, query, order of the rows.
SECTIONS = [
    ("Error rates by model and decoding", q_scores.micro_macro_summary, ["model", "decoding"]),
    ("Intervals", q_scores.bootstrap_ci, ["model"]),
    ("Verified best-of-20 less greedy", q_scores.paired_bootstrap, ["model"]),
    ("Policies", q_scores.policy_rates, ["policy"]),
    ("Corpus BLEU by tokenizer", q_scores.bleu_tokenizers, ["tokenizer"]),
    ("Corpus F-score of characters and words", q_scores.chrf_corpus, ["word_order"]),
    ("Edits by kind", q_scores.edit_categories, ["op", "category"]),
    ("Normal forms", q_more.normal_form_steps, ["step"]),
    ("Verdicts", q_more.model_verdicts, ["model", "verdict"]),
    ("Checks", q_joins.audit_report, ["check_name"]),
]


def score_report(spark, sf_dir: str) -> str:
    """All sections; each table is small, a larger one is an error."""
    return "\n".join(f"## {title}\n\n{markdown(query(spark, sf_dir).orderBy(*order))}" for title, query, order in SECTIONS)
