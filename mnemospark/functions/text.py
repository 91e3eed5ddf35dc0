"""Column expressions over text: words, secrets, themes, display lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# Secrets and what takes their place. The order matters: a key block goes before what is inside it.
SECRETS = (
    (r"(?s)-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?:sk|pk|api)[_-][a-zA-Z0-9_-]{20,}", "[REDACTED_API_KEY]"),
    (r"eyJ[a-zA-Z0-9_-]{20,}\.eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]+", "[REDACTED_JWT]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{20,}", "[REDACTED_BEARER_TOKEN]"),
    (r"(?:postgresql?|mysql|mssql|snowflake|mongodb(?:\+srv)?|redis|amqp)://\S+", "[REDACTED_CONN_STRING]"),
    (r"(?i)(?:password|passwd|pwd)\s*[=:]\s*\S+", "[REDACTED_PASSWORD]"),
    (r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"xox[bpsar]-[A-Za-z0-9-]{10,}", "[REDACTED_SLACK_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED_GOOGLE_API_KEY]"),
    (r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "[REDACTED_CREDIT_CARD]"),
)


def words(text: Column) -> Column:
    """Lower-case words in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def strip_secrets(text: Column) -> Column:
    for pattern, marker in SECRETS:
        text = F.regexp_replace(text, pattern, marker)
    return text


def normal_themes(themes: Column) -> Column:
    """Themes with hyphens for spaces and underscores, blank and null ones dropped, each once in the order of first use."""
    whole = F.filter(F.coalesce(themes, F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.array_distinct(F.transform(whole, lambda t: F.translate(t, "_ ", "--")))


def theme_words(themes: Column) -> Column:
    """Distinct lower-case words of all themes, hyphens being separators."""
    return F.array_distinct(F.filter(F.flatten(F.transform(normal_themes(themes), lambda t: F.split(F.lower(t), "-"))), lambda w: w != ""))


def compact_line(category: Column, summary: Column, content: Column, themes: Column) -> Column:
    """``[category] summary (themes)`` with at most five themes; questions are marked."""
    listed = F.coalesce(themes, F.array().cast("array<string>"))
    shown = F.array_join(F.slice(listed, 1, 5), ", ")
    tail = F.when(F.size(listed) > 5, F.concat(F.lit(" ("), shown, F.lit(", ...)"))).when(F.size(listed) > 0, F.concat(F.lit(" ("), shown, F.lit(")"))).otherwise("")
    head = F.when(F.array_contains(listed, "question"), "[?]").otherwise(F.concat(F.lit("["), category, F.lit("]")))
    return F.concat(head, F.lit(" "), F.coalesce(F.nullif(summary, F.lit("")), F.substring(content, 1, 80)), tail)


def enriched(content: Column, category: Column, themes: Column, summary: Column) -> Column:
    """The text that is embedded: content, then category, themes and summary on lines of their own."""
    listed = F.coalesce(themes, F.array().cast("array<string>"))
    return F.concat_ws(
        "\n",
        content,
        F.when(category != "", F.concat(F.lit("Category: "), category)),
        F.when(F.size(listed) > 0, F.concat(F.lit("Themes: "), F.array_join(listed, ", "))),
        F.when(summary != "", F.concat(F.lit("Summary: "), summary)),
    )


def full_text(category: Column, summary: Column, content: Column, themes: Column, id: Column) -> Column:
    """Three lines: category and summary, content, the short id with all themes."""
    listed = F.coalesce(themes, F.array().cast("array<string>"))
    tail = F.when(F.size(listed) > 0, F.concat(F.lit(" ("), F.array_join(listed, ", "), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("**["), category, F.lit("]** "), F.coalesce(F.nullif(summary, F.lit("")), F.lit("(no summary)")))
    return F.concat_ws("\n", head, F.concat(F.lit("  "), content), F.concat(F.lit("  ID: "), F.substring(id, 1, 8), tail))


def auto_summary(content: Column, tokens: Column) -> Column:
    """For short contents (under 50 tokens) the first sentence, or the first 80 characters if that is longer; else null."""
    first = F.regexp_extract(content, r"^[^.!?\n]*[.!?]?", 0)
    return F.when(tokens < 50, F.when(F.length(first) <= 80, F.trim(first)).otherwise(F.substring(content, 1, 80)))
