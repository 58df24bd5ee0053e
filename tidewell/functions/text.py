"""Text functions as Column expressions: normal forms, similarities, ids, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of categories in analysed events and in timeline files, and the timeline's category for each.
ANALYSED_CATEGORIES = {
    "research": "Research Breakthroughs", "research breakthroughs": "Research Breakthroughs", "models & architectures": "Models & Architectures",
    "product": "Public Releases", "products": "Public Releases", "public releases": "Public Releases", "industry": "Public Releases", "adoption": "Public Releases",
    "regulation": "Ethics & Policy", "policy": "Ethics & Policy", "ethics & policy": "Ethics & Policy", "hardware": "Hardware Advances", "hardware advances": "Hardware Advances",
}
TIMELINE_CATEGORIES = {
    "models & architectures": "Models & Architectures", "models": "Models & Architectures", "architectures": "Models & Architectures", "ai models": "Models & Architectures",
    "research breakthroughs": "Research Breakthroughs", "research": "Research Breakthroughs", "fundamental research": "Research Breakthroughs", "academic research": "Research Breakthroughs", "breakthroughs": "Research Breakthroughs",
    "public releases": "Public Releases", "product": "Public Releases", "products": "Public Releases", "product releases": "Public Releases", "commercial releases": "Public Releases", "industry adoption": "Public Releases",
    "ethics & policy": "Ethics & Policy", "policy": "Ethics & Policy", "regulation": "Ethics & Policy", "policy & regulation": "Ethics & Policy", "regulation & policy": "Ethics & Policy", "ethics": "Ethics & Policy",
    "hardware advances": "Hardware Advances", "hardware": "Hardware Advances", "infrastructure": "Hardware Advances", "compute": "Hardware Advances",
}
DEFAULT_CATEGORY = "Research Breakthroughs"
#: What marks text that repeats a prompt.
PROMPT_MARKS = ["event briefing for analysis", "return the json object now", "full content", "do not include explanations or commentary", "published on:", "source:", "url:", "abstract:", "authors?:", "additional context:"]
#: Lines of a prompt that are dropped whole.
PROMPT_LINES = r"(?i)^(return the json object now.*|event briefing for analysis:?|full content:?|do not include explanations or commentary.?|(additional context|authors?|abstract|published on|source|url):.*)$"
#: Phrases of a prompt that are cut out of a line.
PROMPT_PHRASES = r"(?i)event briefing for analysis:?|return the json object now\.?|do not include explanations or commentary\.?|full content:?|title:\s*"
#: Boilerplate of republished posts, and what replaces it.
BOILERPLATE = [
    (r"(?i)The post\s+(.*?)(?:\s+appeared first on\s+.*?)(?:[.!?]|$)", "$1"),
    (r"(?i)This article was originally published on .*?$", ""),
    (r"(?i)Read more on .*?$", ""),
    (r"(?i)The post\s+$", ""),
    (r"(?i)Follow us on social media.*$", ""),
]


def squeezed(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_text(text: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and ``_`` as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", " "))


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the distinct words of more than two characters of two normal texts; 0 if either has none."""
    return _jaccard(_long_words(a), _long_words(b))


def _long_words(t: Column) -> Column:
    return F.filter(F.array_distinct(F.split(t, " ")), lambda w: F.length(w) > 2)


def _key_terms(t: Column) -> Column:
    return F.filter(F.array_distinct(F.split(t, " ")), lambda w: (F.length(w) > 4) | w.rlike(r"[0-9]") | w.rlike(r"^[a-z]{2,}$"))


def title_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the distinct blank-separated words in lower case, without a length limit."""
    words = lambda t: F.array_distinct(F.split(F.lower(t), r"\s+"))
    return _jaccard(words(a), words(b))


def key_term_overlap(a: Column, b: Column) -> Column:
    """Common key terms over the smaller number of them; key terms are long, alphabetic or hold a digit."""
    x, y = _key_terms(a), _key_terms(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts (I4)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def text_similarity(a: Column, b: Column) -> Column:
    """The best of the similarities of two normal texts (I6). Empty texts are equal, and contained in any other."""
    terms = key_term_overlap(a, b)
    contained = a.contains(b) | b.contains(a)
    cheap = F.greatest(word_jaccard(a, b), F.when(contained, 0.9).otherwise(0.0), F.when(terms > 0.5, terms).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(F.greatest(cheap, edit_similarity(a, b)))


def with_similarity(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the text_similarity of two columns, whose words are taken apart once a row, not once a use."""
    c = lambda part: F.col(f"_{part}")
    parts = rows.withColumns({"_wa": _long_words(F.col(a)), "_wb": _long_words(F.col(b)), "_ta": _key_terms(F.col(a)), "_tb": _key_terms(F.col(b))})
    parts = parts.withColumns({"_wn": F.size(F.array_intersect("_wa", "_wb")), "_tn": F.size(F.array_intersect("_ta", "_tb"))})
    jaccard = F.when((F.size("_wa") == 0) | (F.size("_wb") == 0), 0.0).otherwise(c("wn") / (F.size("_wa") + F.size("_wb") - c("wn")))
    terms = F.when((F.size("_ta") == 0) | (F.size("_tb") == 0), 0.0).otherwise(c("tn") / F.least(F.size("_ta"), F.size("_tb")))
    contained = F.when(F.col(a).contains(F.col(b)) | F.col(b).contains(F.col(a)), 0.9).otherwise(0.0)
    best = F.greatest(jaccard, contained, F.when(terms > 0.5, terms).otherwise(0.0), edit_similarity(F.col(a), F.col(b)))
    return parts.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).otherwise(best)).drop("_wa", "_wb", "_ta", "_tb", "_wn", "_tn")


def slug(title: Column) -> Column:
    """Lower-case ASCII letters and digits with single dashes between, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def event_id(day: Column, title: Column, size: int = 50) -> Column:
    """``yyyy-MM-dd-slug`` with at most ``size`` characters of slug: 50 in timelines (I18), 30 in analyses."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), F.substring(slug(title), 1, size))


def month_key(day: Column, title: Column) -> Column:
    """``yyyy-MM-slug``: what makes two timeline entries duplicates."""
    return F.concat(F.date_format(day, "yyyy-MM"), F.lit("-"), slug(title))


def mapped_category(category: Column, names: dict[str, str]) -> Column:
    """The timeline category of a category's name, or the default."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.lower(F.trim(category))), F.lit(DEFAULT_CATEGORY))


def rounded_half_up(x: Column, digits: int = 1) -> Column:
    """Half up on the double as it is, as floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def without_prompt(text: Column) -> Column:
    """A model's text without the lines and phrases of the prompt, on one line."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    lines = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~x.rlike(PROMPT_LINES))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)^title:\s*", ""), PROMPT_PHRASES, " ")))
    return squeezed(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def has_prompt_marks(text: Column) -> Column:
    """Whether a text repeats parts of a prompt."""
    return text.rlike("(?i)" + "|".join(PROMPT_MARKS))


def sanitised(text: Column, fallback: Column, size: int) -> Column:
    """A model's text, or the fallback where nothing but prompt is left; never empty, at most ``size`` characters."""
    clean, other = without_prompt(text), without_prompt(fallback)
    best = F.when((clean != "") & ~has_prompt_marks(clean), clean).otherwise(F.coalesce(F.nullif(other, F.lit("")), fallback))
    return F.trim(F.substring(F.coalesce(F.nullif(squeezed(best), F.lit("")), F.lit("Summary unavailable.")), 1, size))


def without_boilerplate(text: Column) -> Column:
    """A description without the boilerplate of republished posts."""
    return squeezed(reduce(lambda t, rule: F.regexp_replace(t, *rule), BOILERPLATE, text))


def first_paragraph(text: Column) -> Column:
    """What comes before the first blank line, on one line."""
    return squeezed(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{2,}", 2)[0])


def is_low_quality(description: Column, title: Column) -> Column:
    """Empty, equal to the title, a republished post, or five words at most."""
    plain = F.lower(F.trim(description))
    return F.coalesce(plain == "", F.lit(True)) | (plain == F.lower(F.trim(title))) | description.rlike(r"(?i)^the post\b") | (F.size(F.split(plain, r"\s+")) <= 5)


def key_takeaways(insights: Column) -> Column:
    """``Key takeaways:`` and the first two insights as sentences; null without any."""
    kept = F.slice(F.filter(F.transform(insights, lambda x: F.trim(x)), lambda x: x != ""), 1, 2)
    ended = F.transform(kept, lambda x: F.when(x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))
    return F.when(F.size(kept) > 0, F.concat(F.lit("Key takeaways: "), F.array_join(ended, " ")))


def json_payload(text: Column) -> Column:
    """The JSON object within a model's answer: of a fenced block, else from the first to the last brace; null without."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))


def comma_and_authors(text: Column) -> Column:
    """Authors split at commas and the letters ``and``, wherever they stand (I15; see packed.split_packed for names)."""
    return F.filter(F.transform(F.split(text, r",|and"), lambda x: F.trim(x)), lambda x: x != "")
