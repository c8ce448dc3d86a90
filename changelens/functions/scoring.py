"""Scores, bands and cost estimates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the cost model: USD per million tokens, tokens per request and answer.
INPUT_USD_PER_MTOK = 0.80
OUTPUT_USD_PER_MTOK = 4.00
CHARS_PER_TOKEN = 4
PROMPT_TOKENS = 500
ANSWER_TOKENS = 800


def risk_score(complexity: Column, dependencies: Column, lines_changed: Column) -> Column:
    """Higher is reviewed first."""
    return complexity * 2 + dependencies + lines_changed / F.lit(10.0)


def score_band(score: Column) -> Column:
    return F.when(score >= 7, "green").when(score >= 4, "yellow").otherwise("red")


def input_tokens(n_chars: Column) -> Column:
    return F.floor(n_chars / CHARS_PER_TOKEN) + PROMPT_TOKENS


def cost_usd(tokens_in: Column) -> Column:
    usd = tokens_in * (INPUT_USD_PER_MTOK / 1e6) + ANSWER_TOKENS * (OUTPUT_USD_PER_MTOK / 1e6)
    return F.round(usd, 6)
