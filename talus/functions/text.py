"""Message features as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def alternation(words: list[str]) -> str:
    """A pattern of literal words, leftmost first. Escapes suit Java and RE2."""
    return "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", w) for w in words)


def ascii_edges(pattern: str) -> str:
    """pattern with word edges of ASCII word characters, as RE2 has them; Java's own are of all letters before Java 19 and of ASCII since."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def count(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(ascii_edges(pattern)))


def found(pattern: str, text: Column) -> Column:
    return F.coalesce(text.rlike(ascii_edges(pattern)), F.lit(False))


def matches(pattern: str, text: Column, group: int = 1) -> Column:
    """Distinct captures, sorted, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x != "")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, also where f uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(words: list[str], text: Column) -> Column:
    """Whether text contains one of the literal words: byte searches, much cheaper than one pattern of them all."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def how_many_of(words: list[str], text: Column) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def signal_counts(text: Column, families: dict = L.SIGNALS) -> dict[str, Column]:
    """Matches of each keyword family on lower-case text."""
    low = F.lower(text)
    return {name: F.coalesce(count(alternation(words), low), F.lit(0)) for name, (_, words) in families.items()}


def caps_ratio(text: Column) -> Column:
    """Upper-case letters over letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(F.lit(0.0))


def occurrences(char: str, text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 50) / 3.5).cast("int")


PRICES = {"opus": (15.0, 75.0), "sonnet": (3.0, 15.0), "haiku": (0.8, 4.0)}


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict = PRICES, default: tuple = (3.0, 15.0)) -> Column:
    """Dollars at prices per million tokens, by the first name that the model contains."""
    a, b = F.lit(default[0]), F.lit(default[1])
    for name, (x, y) in reversed(prices.items()):
        a, b = F.when(F.lower(model).contains(name), x).otherwise(a), F.when(F.lower(model).contains(name), y).otherwise(b)
    return (tokens_in * a + tokens_out * b) / 1e6


def size_bucket(value: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first edge that value is under."""
    out = F.lit(rest)
    for edge, name in reversed(edges):
        out = F.when(value < edge, name).otherwise(out)
    return out


def format_size(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).when(size < 1024 * 1024, F.format_string("%.1fKB", size / 1024.0)).otherwise(F.format_string("%.1fMB", size / (1024.0 * 1024)))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "/", "_"), r"\.", "_")


def repeated_word(text: Column) -> Column:
    """The first word that stands three times in a row, upper case, or null."""
    word = F.regexp_extract(text, L.PATTERNS["repeat"], 1)
    return F.when((F.length(text) >= 10) & (word != ""), F.upper(word))


def _sentences(text: Column) -> Column:
    """Sentences in lower case without the marks around them; what is shorter than 5 characters as it stands doesn't count."""
    clean = lambda s: F.trim(F.regexp_replace(F.lower(F.trim(s)), r"^[!?.]+|[!?.]+$", ""))
    parts = F.transform(F.filter(F.split(text, r"(?<=[.!?])\s*"), lambda s: F.length(F.trim(s)) >= 5), clean)
    return parts


def _thrice(parts: Column) -> Column:
    """Of each sentence whether it is of 5 characters or more and the next two are the same."""
    return F.transform(parts, lambda s, i: F.coalesce((F.length(s) >= 5) & (s == F.get(parts, i + 1)) & (s == F.get(parts, i + 2)), F.lit(False)))


def repeated_sentence(text: Column) -> Column:
    """The first sentence (5 characters or more) that stands three times in a row, or null."""
    same = lambda p: lambda s, i: (F.length(s) >= 5) & (s == F.get(p, i + 1)) & (s == F.get(p, i + 2))
    first = let(_sentences(text), lambda p: F.get(F.filter(p, same(p)), F.lit(0)))
    return F.when(F.length(text) >= 10, first)


def repeated(text: Column) -> Column:
    """The first word, else the first sentence, that stands three times in a row, or null."""
    return F.coalesce(repeated_word(text), repeated_sentence(text))


def repeated_ascii_word(text: Column) -> Column:
    """The first run of ASCII word characters (at most the last 20) at the end of a word that is the whole next word and begins the one after, upper case, or null."""
    gap = r"[\t\n\f\r ]+"
    word = F.regexp_extract(F.lower(text), rf"(?:(?<!\w)|(?=\w{{20}}{gap}))(\w{{2,20}}){gap}\1{gap}\1", 1)
    return F.when(word != "", F.upper(word))


def repeats(text: Column) -> Column:
    """How often the first word, else the first sentence, that stands three times in a row or more stands there; 0 for none."""
    words = F.trim(F.regexp_extract(text, L.PATTERNS["repeat"], 0))

    def run(parts: Column) -> Column:
        rest = lambda at: F.slice(parts, at.cast("int"), F.size(parts))
        length = lambda r: let(F.array_position(F.transform(r, lambda s: s == F.get(r, F.lit(0))), False), lambda n: F.when(n == 0, F.size(r)).otherwise(n - 1))
        return let(F.array_position(_thrice(parts), True), lambda at: F.when(at == 0, 0).otherwise(let(rest(F.greatest(at, F.lit(1))), length)))

    said = let(_sentences(text), run)
    return F.when(F.length(text) < 10, 0).when(words != "", F.size(F.split(words, r"\s+"))).otherwise(said).cast("int")


def collapse_char_per_line(text: Column, lines_over: int = 6, share: float = 0.7) -> tuple[Column, Column]:
    """(text, was encoded): lines of single characters are joined where they make up over share of more than lines_over lines."""
    lines = F.split(text, "\n", -1)
    single = F.size(F.filter(lines, lambda x: F.length(x) <= 1))
    encoded = F.coalesce(text.contains("\n") & (F.size(lines) > lines_over) & (single / F.size(lines) > share), F.lit(False))
    return F.when(encoded, F.array_join(lines, "")).otherwise(text), encoded


def collapse_alternating(text: Column) -> Column:
    """Characters joined where the second one is a line break and there are over 10."""
    return F.when((F.substring(text, 2, 1) == "\n") & (F.length(text) > 10), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


DECORATION = "[─-╿▀-▟■-◿☀-➿←-⇿]"


def clean_for_agents(text: Column) -> Column:
    """Collapsed, at most one empty line in a row, no decoration, no rule lines, trimmed."""
    text, _ = collapse_char_per_line(text)
    squeeze = lambda t: F.regexp_replace(t, "\n{3,}", "\n\n")
    lines = squeeze(F.regexp_replace(F.regexp_replace(squeeze(text), DECORATION, ""), r"(?m)^[\s\-=]{10,}$", ""))
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def replace_words(text: Column, mapping: list[tuple[str, str]]) -> Column:
    """Literal replacements, in order, case-sensitive."""
    for old, new in mapping:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def parse_signals(signals: Column) -> Column:
    """["name:count"] to a map; entries without a whole number are left out."""
    ok = F.filter(signals, lambda s: s.rlike(r"^[^:]+:\d+$"))
    return F.map_from_entries(F.transform(ok, lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)), F.split_part(s, F.lit(":"), F.lit(2)).cast("int"))))


def format_signals(counts: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c > 0, F.concat(F.lit(f"{k}:"), c.cast("string"))) for k, c in counts.items())))


def stems(name: Column) -> Column:
    """All runs of two or more parts of a name without its extension, parts between underscores."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    runs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "_")))
    return F.when(F.size(parts) >= 2, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def normalize_confidence(value: Column) -> Column:
    """Numbers and other names as one of seven levels."""
    low, number = F.lower(F.trim(value)), F.try_to_number(F.trim(value), F.lit("9.9999")).cast("double")
    known = ["tentative", "experimental", "working", "stable", "proven", "fragile"]
    out = F.when(low.isin(known), low).when(low.isin("high", "strong", "certain"), "proven").when(low.isin("medium", "moderate"), "working").when(low.isin("low", "weak"), "tentative")
    return F.coalesce(out.when(number >= 0.9, "proven").when(number >= 0.7, "stable").when(number >= 0.5, "working").when(number.isNotNull(), "tentative"), F.lit("unknown"))


def maturity_group(confidence: Column) -> Column:
    return F.when(confidence.isin("proven", "stable"), "mature").when(confidence.isin("working", "experimental"), "growing").otherwise("early")


def marker_tags(text: Column) -> Column:
    """state, confidence, emotion and counts of F, D, W and R tags, and credibility n/m of annotated text."""
    tag = lambda k: F.nullif(F.regexp_extract(text, rf"@ctx:{k}=([\w-]+)", 1), F.lit(""))
    share = F.regexp_extract(text, r"credibility[^0-9]*(\d+)/(\d+)", 0)
    return F.struct(tag("state").alias("state"), tag("confidence").alias("confidence"), tag("emotion").alias("emotion"), *(count(rf"\[{k}\d+\]", text).alias(k.lower()) for k in "FDWR"), F.nullif(share, F.lit("")).alias("credibility"))


def duration_hours(first: Column, last: Column) -> Column:
    return (F.unix_timestamp(last) - F.unix_timestamp(first)) / 3600.0


def estimate_day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")
