"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning.
STOP_WORDS = "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should may might can this that these those".split()
#: Words that mark English.
ENGLISH_MARKS = ["the", "and", "or", "is", "are", "was", "were"]

#: Names whose values are secret; a value ends at its quote, or without quotes at white space or a mark.
SECRET_NAMES = ["password", "token", "key", "secret", "api_key", "authentication", "authorization"]
_VALUE = r"""(?:"[^"\n]*"|'[^'\n]*'|[^\s"',;]+)"""
_SSN, _MAIL = r"\b\d{3}-\d{2}-\d{4}\b", r"[\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}"
#: Numbers as long as those of cards; one is a card if its check digit is right.
CARD_LIKE = r"\b[1-9]\d{3}(?:\d{9,15}|(?:[ -]\d{4}){2}[ -]\d{1,7}|[ -]\d{6}[ -]\d{4,5})\b"
#: Phones: with a country code, with an area code in brackets, or three groups parted by signs.
PHONE = r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}\b|\(\d{2,5}\)[ -]?\d{3,4}[ .-]?\d{3,5}\b|\b\d{3}[ .-]\d{3}[ .-]\d{4}\b"
#: Runs as long as those of keys; one is a key if it has letters and digits.
KEY_LIKE = r"\b\w[\w-]{18,}\w\b"
#: Patterns of secrets and personal data, with what replaces them, in order; a number behind a backslash is a group. Cards go before them.
SECRET_PATTERNS = [
    (rf"\b({'|'.join(SECRET_NAMES)})\s*[:=]\s*{_VALUE}", r"\1=[REDACTED]"),
    (_SSN, "[REDACTED-SSN]"),
    (_MAIL, "[REDACTED-EMAIL]"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[REDACTED-IP]"),
]
#: Patterns of social security numbers, mail addresses, phones and passwords in addresses, all replaced by the same mark. Cards and keys go before them.
SENSITIVE_PATTERNS = [_SSN, _MAIL, PHONE, r"://[^\s/:@]+:[^\s/@]+@"]
_EDGE = "\u0001"


def _checked(c: Column, pattern: str, right, mark: str) -> Column:
    """What matches and passes a test, replaced by a mark; the sign U+0001 is dropped from the text."""
    parts = F.split(F.regexp_replace(F.replace(c, F.lit(_EDGE), F.lit("")), f"({pattern})", f"{_EDGE}$1{_EDGE}"), _EDGE)
    return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & right(x), mark).otherwise(x)), "")


def _card(x: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(x, "[ -]", ""))


def _key(x: Column) -> Column:
    return x.rlike("[A-Za-z]") & x.rlike("[0-9]")


def folded(c: Column) -> Column:
    """White space folded to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def lowered(c: Column) -> Column:
    """Lower case sign by sign, as DuckDB has it: the dotted capital I becomes i alone, not i and a dot above it."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))


def ascii_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9: the token class that every SQL dialect agrees on."""
    return F.filter(F.split(lowered(c), "[^a-z0-9]+"), lambda w: w != "")


def unicode_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script, without diacritics of Latin letters."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), 1)


def meaningful(c: Column) -> Column:
    """At least three words, twenty characters and more than two characters a word."""
    n = word_count(c)
    return (n >= 3) & (F.length(F.trim(c)) >= 20) & (F.length(c) / F.greatest(n, F.lit(1)) > 2.0)


def language(c: Column) -> Column:
    """en, unknown, or null for texts below 50 characters, by marks among the first hundred words."""
    first = F.slice(words(F.lower(c)), 1, 100)
    marks = F.size(F.filter(first, lambda w: w.isin(ENGLISH_MARKS)))
    return F.when(F.length(c) < 50, None).when(marks > F.floor(F.size(first) / 10), "en").otherwise("unknown")


def sentences(c: Column) -> Column:
    """Sentences end in one or more of .!? and white space."""
    cut = F.split(F.regexp_replace(c, r"([.!?]+)\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the index for the signs to trim


def sentence_count(c: Column) -> Column:
    return F.greatest(F.regexp_count(c, F.lit(r"[.!?]+\s+")), F.lit(1))


def summary_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\. "), lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def redact_secrets(c: Column) -> Column:
    c = _checked(c, CARD_LIKE, _card, "[REDACTED-CARD]")
    for pattern, mark in SECRET_PATTERNS:
        c = F.regexp_replace(c, pattern, mark.replace("\\", "$"))
    return c


def redact_sensitive(c: Column) -> Column:
    c = _checked(_checked(c, CARD_LIKE, _card, "[REDACTED]"), KEY_LIKE, _key, "[REDACTED]")
    for pattern in SENSITIVE_PATTERNS:
        c = F.regexp_replace(c, pattern, "[REDACTED]")
    return c


def highlight(c: Column, terms: list[str]) -> Column:
    """Each whole-word hit of each term in <mark>, whatever its case."""
    for t in terms:
        c = F.regexp_replace(c, rf"(?i)\b({_quoted(t)})\b", "<mark>$1</mark>")
    return c


def _quoted(t: str) -> str:
    return "".join(x if x.isalnum() or ord(x) > 127 else "\\" + x for x in t)


def snippet(c: Column, term: str, before: int = 50, after: int = 150) -> Column:
    """A window around the first hit (any case), the term marked; the beginning where there is none."""
    at = F.locate(term.lower(), F.lower(c))
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(c, start, F.lit(after) + at - start)
    return F.when(at > 0, F.replace(cut, F.lit(term), F.lit(f"<mark>{term}</mark>"))).otherwise(F.substring(c, 1, before + after))


def strip_html(c: Column) -> Column:
    """Markup off, scripts and styles dropped, common references decoded, white space folded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for ref, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(sign))
    return folded(c)


def strip_markdown(c: Column) -> Column:
    """Text and code of Markdown, joined by spaces."""
    c = F.regexp_replace(c, r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", "")
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"```[^\n]*\n?|[*_`~]{1,3}", "")
    return folded(c)


def content_key(c: Column) -> Column:
    """SHA-256 of the lower-case letters, digits and white space: equal keys are exact duplicates."""
    return F.sha2(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), 256)


def meaningful_tokens(c: Column) -> Column:
    """Lower-case words of more than two characters that aren't stop words, trimmed of other signs."""
    kept = F.filter(words(lowered(c)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.filter(F.transform(kept, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces."""
    last = F.size(tokens) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def chargrams(c: Column, n: int) -> Column:
    last = F.length(c) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
