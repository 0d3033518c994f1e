"""Rules of text quality: a table of patterns, counted over a text column.

Patterns use only what Java's and other regular expression engines read alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, severity, pattern), in the order of screening: fixed values of the rule catalogue.
RULES = (
    ("search_token", "CRITICAL", r"turn[0-9]+(search|image|news|file)[0-9]+"),
    ("citation_placeholder", "CRITICAL", r"oaicite|contentReference|oai_citation"),
    ("attribution_json", "CRITICAL", r"\(\{\s*.attribution.\s*:|\{.attribut(able|ion)"),
    ("tracking_parameter", "CRITICAL", r"utm_source=(chatgpt\.com|openai|copilot\.com)"),
    ("refusal", "CRITICAL", r"(?i)as an ai language model|as a large language model|i cannot provide"),
    ("correspondence", "CRITICAL", r"(?i)i hope this helps|i hope this email finds you well|you.re absolutely right|let me know if|(^|\n)subject: "),
    ("cutoff", "CRITICAL", r"(?i)as of my last (knowledge )?update|my knowledge cutoff|up to my last training"),
    ("placeholder", "CRITICAL", r"(?i)\[(your|insert|describe|entertainer|link to|add) [^\]\n]*\]"),
    ("puffery", "HIGH", r"(?i)stands as|plays an? (vital|crucial|pivotal|significant) role|rich tapestry|delves into|indelible mark|the landscape of|testament to"),
    ("ing_analysis", "HIGH", r"(?i), (highlighting|underscoring|emphasizing|reflecting|symbolizing|ensuring|showcasing) "),
    ("promotional", "HIGH", r"(?i)groundbreaking|transformative|revolutionary|unparalleled|unprecedented|cutting-edge|state-of-the-art|nestled|boasts a"),
    ("important_to_note", "HIGH", r"(?i)important to (note|remember|consider)|worth noting"),
    ("summary", "MEDIUM", r"(?i)(^|\n)(in summary|in conclusion|overall),"),
    ("despite", "MEDIUM", r"(?i)despite (its|these|the|their) [^.\n]*challenges"),
    ("negative_parallel", "MEDIUM", r"(?i)not (just|only|merely) [^.\n]{1,80} but"),
    ("weasel", "MEDIUM", r"(?i)some experts|experts (say|argue)|it is believed|observers have|industry reports"),
    ("false_range", "MEDIUM", r"(?i)from [a-z]+ to [a-z]+"),
    ("bold", "MEDIUM", r"\*\*[^*\n]+\*\*"),
    ("inline_header", "MEDIUM", r"(^|\n)\s*([-*]|[0-9]+\.) \*\*[^*\n]+:?\*\*"),
    ("em_dash", "MEDIUM", "—"),
    ("emoji", "MEDIUM", "[\U0001f300-\U0001faff✀-➿]"),
    ("markup_mix", "MEDIUM", r"(^|\n)#{1,6} |\[[^\]\n]*\]\(https?:"),
    ("return_arrow", "MEDIUM", "↩"),
)
#: Families of which one hit decides.
DECISIVE = ("search_token", "citation_placeholder", "attribution_json", "tracking_parameter", "refusal")
#: Replacements by phrase: fixed values.
SUGGESTIONS = {
    "stands as a testament to": "shows",
    "plays a vital role in": "affects",
    "nestled in the heart of": "in",
    "delves into": "examines",
}
#: Phrases for which the catalogue has advice and no replacement: fixed values.
ADVICE = {
    "rich tapestry of": "describe specifically what it contains",
    "important to note": "just state the important thing",
    "groundbreaking": "describe what it actually does",
    "revolutionary": "compare to what came before",
    "cutting-edge": "specify the technology",
    "transformative": "show the transformation with evidence",
}
#: What must not count against a text, though it is often named: fixed values.
FALSE_INDICATORS = ("perfect_grammar", "bland_prose", "unusual_words", "letter_like_writing", "conjunctions")


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """``(doc_id, rule, severity, hits)`` of every rule that a text breaks."""
    found = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), hits(F.col(text), p).cast("long").alias("hits")) for r, s, p in rules])
    return docs.select(doc_id, F.inline(F.filter(found, lambda f: f["hits"] > 0)))


def decisive(text: Column) -> Column:
    """Whether a rule is broken that decides alone."""
    return reduce(Column.__or__, [text.rlike(p) for r, _, p in RULES if r in DECISIVE])


def density(text: Column, pattern: str) -> Column:
    """Hits for each word."""
    words = F.size(F.filter(F.split(text, r"[ \t\n]+"), lambda w: w != ""))
    return F.try_divide(hits(text, pattern), words)


def suggest(text: Column) -> Column:
    """The text with known phrases replaced."""
    return reduce(lambda t, pair: F.regexp_replace(t, f"(?i){pair[0]}", pair[1]), SUGGESTIONS.items(), text)


def advice(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, phrase, advice, hits)`` of every phrase that a text should do without."""
    found = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(a).alias("advice"), hits(F.col(text), f"(?i){p}").cast("long").alias("hits")) for p, a in {**{p: f"write: {r}" for p, r in SUGGESTIONS.items()}, **ADVICE}.items()])
    return docs.select(doc_id, F.inline(F.filter(found, lambda f: f["hits"] > 0)))


def indicators(findings: DataFrame, rule: str = "rule") -> DataFrame:
    """Findings without those that are known to say nothing."""
    return findings.filter(~F.col(rule).isin(*FALSE_INDICATORS) | F.col(rule).isNull())


def title_case_headings(text: Column) -> Column:
    """Share of markdown headings in which every word begins with a capital."""
    heads = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike("^#{1,6} ")), lambda x: F.regexp_replace(x, "^#{1,6} ", ""))
    titled = F.filter(heads, lambda h: F.initcap(h) == h)
    return F.try_divide(F.size(titled), F.size(heads))


def cut_off(text: Column) -> Column:
    """Whether a text ends without a mark that ends a sentence."""
    return ~F.rtrim(F.rtrim(text), F.lit("\n\r\t ")).rlike(r"""[.!?…:;)"'”’\]]$""")
