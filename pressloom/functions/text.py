"""Text expressions. All run inside the JVM; a null text is empty."""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that part words, and hosts that serve feeds of many outlets (fixed values).
PARTING = r"(?i)<(?:br|/(?:p|div|li|h\d))[^>]*>"
GENERIC_HOSTS = ("feedburner.com", "feedblitz.com", "rss.app")
#: Words in an initialism that are skipped (fixed values).
SMALL = ("the", "of", "and", "a", "an", "for", "de", "la", "el")

SPACE = r"(?U)\s+"
#: Comments and tags, also one that isn't closed.
MARKUP = r"(?s)<!--.*?(?:-->|$)|<[a-zA-Z/!?][^>]*(?:>|$)"
ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def _s(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _named() -> Column:
    """All named entities of HTML5 with what they stand for, as one literal."""
    return F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in sorted(html.entities.html5.items()) if k.endswith(";")})), "map<string,string>")


def decode_entities(text: Column, raw: Column | None = None) -> Column:
    """Named and numeric entities, each once: what a decoded one makes with its neighbours stays. Unknown and impossible ones stay too.

    raw: where text is an expression, a column without an ampersand where text has none, so that the expression isn't run to see that.
    """

    def one(e: Column) -> Column:
        body = F.substring(e, 2, 40)
        body = F.substring(body, F.lit(1), F.length(body) - 1)
        code = F.when(F.lower(F.substring(body, 1, 2)) == "#x", F.conv(F.substring(body, 3, 40), 16, 10)).when(F.substring(body, 1, 1) == "#", F.substring(body, 2, 40)).try_cast("int")
        ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.isNotNull(), F.when(ok, char)).otherwise(F.try_element_at(_named(), body))

    said, parts = F.regexp_extract_all(text, F.lit(ENTITY), 0), F.split(text, ENTITY, -1)
    both = F.zip_with(parts, said, lambda p, e: F.concat(p, F.coalesce(one(e), e, F.lit(""))))
    some = text if raw is None else raw
    return F.when(F.contains(some, F.lit("&")), F.array_join(both, "")).otherwise(text)


def plain(text: Column) -> Column:
    """Line breaks and the ends of paragraphs, divisions, list items and headings become spaces, all other tags go without a trace, entities
    are decoded, white space is folded."""
    t = F.regexp_replace(F.regexp_replace(_s(text), PARTING, " "), MARKUP, "")
    return F.trim(F.regexp_replace(decode_entities(t, _s(text)), SPACE, " "))


def words_of_plain(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a text without markup."""
    return F.regexp_extract_all(F.lower(_s(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def words(text: Column) -> Column:
    """The same of a text that may have markup."""
    return words_of_plain(F.when(text.rlike("[<&]"), plain(text)).otherwise(text))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def cap_words(text: Column, most: int) -> Column:
    """The text as it is if it has at most `most` words, or if that is 0; else its words, cut after the last that ends a sentence, from the
    second on, or after the last one, with an ellipsis."""
    t = F.regexp_replace(_s(text), r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")
    if most <= 0:
        return t
    parts = F.filter(F.split(t, SPACE), lambda x: x != "")
    head = F.slice(parts, 1, most)
    ends = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: (i > 1) & F.coalesce(F.get(head, i - 1), F.lit("")).rlike(r"[.!?][\"')\]]?$"))
    last = F.array_max(ends)
    cut = F.concat(F.regexp_replace(F.array_join(head, " "), r"[ ,;:]+$", ""), F.lit("…"))
    return F.when(F.size(parts) <= most, t).when(last.isNotNull(), F.array_join(F.slice(head, F.lit(1), last), " ")).otherwise(cut)


def shingles(w: Column, k: int = 5) -> Column:
    """Distinct k-word sequences of a word array column, joined by spaces; none for shorter texts. Give it a column, not an expression."""
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
    return F.when(F.size(w) >= k, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def long_quotation(text: Column, least: int) -> Column:
    """Whether a span in quotation marks has at least `least` words."""
    spans = F.regexp_extract_all(_s(text), F.lit("[\"“„«]([^\"“”„«»]*)[\"”“»]"), 1)
    return F.exists(spans, lambda s: F.size(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), 0)) >= least)


def redact(text: Column, terms: Sequence[str], mark: str = "[outlet]") -> Column:
    """Terms of three characters and more, longest first, as whole words in any case."""
    use = sorted({t.strip() for t in terms if t and len(t.strip()) >= 3}, key=lambda t: (-len(t), t))
    if not use:
        return _s(text)
    body = "|".join(re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", t) for t in use)
    return F.regexp_replace(_s(text), f"(?iu)(?<![\\p{{L}}\\p{{N}}])(?:{body})(?![\\p{{L}}\\p{{N}}])", mark.replace("$", r"\$"))


def _literal(c: Column) -> Column:
    """A text as a pattern of itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|&~#-])", r"\\$1")


def domain(url: Column) -> Column:
    """The last two labels of the host of a URL; empty without a host and for hosts that serve feeds of many outlets."""
    host = F.lower(F.regexp_extract(_s(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    two = F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(*GENERIC_HOSTS), "").otherwise(two)


def outlet_terms(name: str, feed_url: str | None = None, aliases: Sequence[str] = ()) -> list[str]:
    """What names an outlet: its name, the name without a leading article, the domain of its feed, its aliases."""
    out = [name, re.sub(r"(?i)^the\s+", "", name.strip()), *aliases]
    host = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", (feed_url or "").lower())
    two = ".".join(host.group(1).split(".")[-2:]) if host else ""
    return [*out, two] if two and two not in GENERIC_HOSTS else out


def term_pattern(terms: Column) -> Column:
    """A pattern for an array of terms, longest first, those of three characters and more, as whole words in any case; null without any."""
    use = F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: F.length(t) >= 3))
    ordered = F.transform(F.array_sort(F.transform(use, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: _literal(x["t"]))
    return F.when(F.size(use) > 0, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}])")))


def redact_by(text: Column, pattern: Column, mark: str = "[outlet]") -> Column:
    """The text with what the row's pattern (of term_pattern) names replaced; a row without a pattern keeps its text."""
    return F.when(pattern.isNotNull(), F.regexp_replace(_s(text), pattern, F.lit(mark.replace("$", r"\$")))).otherwise(_s(text))


def byline(text: Column, wires: Sequence[tuple[str, str]], reach: int = 60) -> Column:
    """The first wire whose literal stands, in any case, among the first or last `reach` pieces of the text; else null."""
    parts = F.split(F.trim(F.regexp_replace(_s(text), SPACE, " ")), " ")
    ends = F.lower(F.concat(F.array_join(F.slice(parts, 1, reach), " "), F.lit(" \n "), F.array_join(F.slice(parts, F.greatest(F.size(parts) - reach + 1, F.lit(1)), reach), " ")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for literal, name in wires:
        out = out.when(F.contains(ends, F.lit(literal.lower())), name)
    return out


def search_terms(query: Column) -> Column:
    """Distinct lower-cased terms of three characters and more, without the punctuation around them."""
    t = F.transform(F.split(F.trim(F.lower(_s(query))), r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(t, lambda x: F.length(x) >= 3))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(_s(text)) / 4).cast("long")


def partial(text: Column, least: int) -> Column:
    return (F.lit(least > 0) & (word_count(text) < least)).cast("int")


def render(template: str, values: Mapping[str, str]) -> str:
    """{name} and [name] tokens filled in; unknown ones stay."""
    return re.sub(r"\{(\w+)\}|\[(\w+)\]", lambda m: values.get(m.group(1) or m.group(2), m.group(0)), template)


def initials(name: Column) -> Column:
    """The first word if it is an acronym, else the first letters of at most two words that aren't small ones."""
    parts = F.filter(F.split(F.trim(_s(name)), r"\s+"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    strong = F.filter(parts, lambda x: ~F.lower(x).isin(*SMALL))
    letters = F.array_join(F.transform(F.slice(strong, 1, 2), lambda x: F.upper(F.substring(x, 1, 1))), "")
    return F.when(first.rlike(r"^\p{Lu}{2,5}$"), first).otherwise(letters)


def relative_time(then: Column, now: Column, compact: bool = False) -> Column:
    """Age of Unix seconds `then`: minutes, hours, days, weeks, months, at least one of the first and last. The compact form ends with days."""
    age = F.greatest(now - then, F.lit(0))
    count = lambda size: F.floor(age / size)
    minutes, hours, days = F.greatest(count(60), F.lit(1)), count(3600), count(86400)
    if compact:
        return F.when(age < 3600, F.concat(minutes, F.lit(" min ago"))).when(age < 86400, F.concat(hours, F.lit(" h ago"))).otherwise(F.concat(days, F.lit(" d ago")))
    several = lambda n, one, more: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {more}"))
    return (
        F.when(age < 3600, several(minutes, "min", "min")).when(age < 86400, several(hours, "hour", "hours")).when(age < 7 * 86400, several(days, "day", "days"))
        .when(age < 30 * 86400, several(count(7 * 86400), "wk", "wk")).otherwise(several(count(30 * 86400), "month", "months"))
    )
