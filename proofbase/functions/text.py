"""Text semantics as Column expressions: normalising, terms, matching, excerpts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stopwords, letters and suffixes that matching is defined by.
STOPWORDS_LATIN = (
    "the and for with from that this are was not all any per into about under over data dataset datasets list table file "
    "government official israel israeli ministry information report"
).split()
STOPWORDS_HEBREW = (
    "של את על עם או גם כל לא אם כי זה זו אשר בין לפי עבור אל יש אין הוא היא נתונים מאגר קובץ טבלה רשימה רשימת "
    "משרד ממשלה ממשלתי ישראל מידע דוח"
).split()
FINAL_LETTERS, REGULAR_LETTERS = "ךםןףץ", "כמנפצ"
PROCLITICS = "והבלמשכ"
SUFFIXES = ("", "ימ", "ות", "י", "ה", "ת", "יה", "יו", "ית", "נו", "כמ", "המ", "ני")

CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069]"
WORD = "[\\p{L}\\p{N}_\\u0590-\\u05FF]+"
HEBREW = "[\\u0590-\\u05FF]"


@cache
def stopwords() -> tuple[str, ...]:
    return tuple(STOPWORDS_LATIN + STOPWORDS_HEBREW)


@cache
def _accent_table() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks whose decomposition is one base letter, and those letters."""
    pairs = []
    for code in range(0x00C0, 0x0530):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: the body of a lambda is computed for every element, with all it refers to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_controls(c: Column) -> Column:
    """F01. NULL becomes the empty string; tab, line feed and carriage return stay."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), CONTROLS, "")


def folded(c: Column) -> Column:
    """F02 without the cutting into words; the final letters have no case, so they are translated with the accents."""
    accented, bare = _accent_table()
    return F.lower(F.regexp_replace(F.translate(strip_controls(c), accented + FINAL_LETTERS, bare + REGULAR_LETTERS), "\\p{Mn}+", ""))


def normalized(c: Column) -> Column:
    """F02 within the JVM, for text whose letters are pre-composed or bare; marks on their own are dropped."""
    return F.array_join(F.regexp_extract_all(folded(c), F.lit(WORD), F.lit(0)), " ")


def normalized_lines(c: Column) -> Column:
    """F02 of every line, line breaks kept."""
    accented, bare = _accent_table()
    x = F.regexp_replace(F.translate(strip_controls(c), accented, bare), "\\p{Mn}+", "")
    x = F.regexp_replace(F.translate(F.lower(x), FINAL_LETTERS, REGULAR_LETTERS), "[^\\n\\p{L}\\p{N}_\\u0590-\\u05FF]+", " ")
    return F.regexp_replace(x, "(?m)^ | $", "")


def normalize_python(text: str | None) -> str:
    """F02, the definition: compatibility decomposition, combining marks dropped."""
    x = unicodedata.normalize("NFKD", re.sub(CONTROLS.encode().decode("unicode_escape"), "", text or ""))
    x = "".join(ch for ch in x if not unicodedata.combining(ch)).lower()
    x = x.translate(str.maketrans(FINAL_LETTERS, REGULAR_LETTERS))
    return " ".join(re.findall(r"[\w֐-׿]+", x))


@F.arrow_udf(T.StringType())
def normalized_exact(x: pa.Array) -> pa.Array:
    """F02 for any input, batch by batch."""
    return pa.array([normalize_python(v) for v in x.to_pylist()], pa.string())


def tokens(norm: Column) -> Column:
    """The words of normalised text."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def is_digits(w: Column) -> Column:
    return w.rlike("^\\p{Nd}+$")


def is_hebrew(w: Column) -> Column:
    return w.rlike(HEBREW)


def _without(words: Column, pattern: str) -> Column:
    """The words joined by spaces, those that are all of the pattern left out. A match begins at a space, so no other place is tried."""
    return F.regexp_replace(F.concat(F.lit(" "), F.array_join(words, " ")), f" (?:{pattern})(?![^ ])", "")


def vocabulary(norm: Column, without: tuple[str, ...] = ()) -> Column:
    """The distinct words of normalised text in order of appearance, but for those given; no function is called for each word."""
    return F.array_except(F.split(norm, " "), F.array(*[F.lit(w) for w in ("", *without)]))


def numbers(norm: Column, least: int = 1) -> Column:
    """The words of so many digits, in order of appearance."""
    return F.regexp_extract_all(F.concat(F.lit(" "), norm), F.lit(f" (\\p{{Nd}}{{{least},}})(?![^ ])"), F.lit(1))


def extract_terms(norm: Column) -> Column:
    """words of at least 3 letters (Hebrew 2) that are no stopword or number; one trailing s dropped beyond 4. Texts without Hebrew are cut by expressions over the whole text."""
    words = vocabulary(norm, stopwords())
    keep = lambda w: ~is_digits(w) & (F.length(w) >= F.when(is_hebrew(w), 2).otherwise(3))
    bare = lambda w: F.when(~is_hebrew(w) & (F.length(w) > 4) & w.endswith("s"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)
    latin = vocabulary(F.regexp_replace(_without(words, "\\p{Nd}+|[^ ]{1,2}"), "([^ ]{4})s(?![^ ])", "$1"))
    return F.when(is_hebrew(norm), F.array_distinct(F.transform(F.filter(words, keep), bare))).otherwise(latin)


def record_query_terms(norm: Column) -> Column:
    """sorted terms, then every number of two digits or more; all words if that is nothing."""
    found = F.array_distinct(F.concat(F.sort_array(extract_terms(norm)), numbers(norm, 2)))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(tokens(norm)))


def document_query_terms(norm: Column) -> Column:
    """distinct words without stopwords, numbers or of two letters at least."""
    return vocabulary(_without(vocabulary(norm, stopwords()), "[^ \\p{Nd}]"))


def english_match(term: Column, token: Column) -> Column:
    """F07."""
    return token.startswith(term) & (F.length(token) - F.length(term) <= 3)


def hebrew_match(term: Column, token: Column) -> Column:
    """at the stem's first place in the token, up to three proclitics before it and a listed suffix after it."""

    def at(stem: Column) -> Column:
        place = F.position(stem, token)
        before, after = F.substring(token, F.lit(1), place - 1), F.substring(token, place + F.length(stem), F.lit(1 << 20))
        return (place > 0) & (F.length(stem) > 0) & (F.length(before) <= 3) & before.rlike(f"^[{PROCLITICS}]*$") & after.isin(*SUFFIXES)

    cut = F.substring(term, F.lit(1), F.length(term) - 1)
    return at(term) | (term.endswith("ה") & (at(F.concat(cut, F.lit("ת"))) | at(cut)))


def term_matches(term: Column, token: Column) -> Column:
    return F.when(is_hebrew(term), hebrew_match(term, token)).otherwise(english_match(term, token))


def _inflected(term: Column, vocabulary: Column) -> Column:
    """Whether term_matches some word; the term's script is looked at once, not for every word."""
    return F.when(is_hebrew(term), F.exists(vocabulary, lambda w: hebrew_match(term, w))).otherwise(F.exists(vocabulary, lambda w: english_match(term, w)))


def matched_terms(terms: Column, vocabulary: Column) -> Column:
    """the terms that occur, as they are or inflected."""
    return let(vocabulary, lambda v: F.filter(terms, lambda t: F.array_contains(v, t) | _inflected(t, v)))


def document_hits(terms: Column, vocabulary: Column) -> Column:
    """as F08, but numbers match whole words only."""
    return let(vocabulary, lambda v: F.filter(terms, lambda t: F.array_contains(v, t) | (~is_digits(t) & _inflected(t, v))))


def token_variants(token: Column) -> Column:
    """the word, and what remains after 1 to 3 proclitics as long as three letters remain."""
    cut = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda n: is_hebrew(token) & (F.length(token) - n >= 3) & F.substring(token, F.lit(1), n).rlike(f"^[{PROCLITICS}]+$"))
    return F.concat(F.array(token), F.transform(cut, lambda n: F.substring(token, n + 1, F.length(token))))


def term_variants(term: str) -> list[str]:
    """F10 of a query's term, on the driver."""
    cut = [n for n in (1, 2, 3) if re.search("[֐-׿]", term) and len(term) - n >= 3 and set(term[:n]) <= set(PROCLITICS)]
    return [term, *(term[n:] for n in cut)]


def index_terms(norm: Column) -> Column:
    """all variants of all words, once each. Only Hebrew words have any but themselves."""
    words = F.array_distinct(tokens(norm))
    return F.when(is_hebrew(norm), F.array_distinct(F.flatten(F.transform(words, token_variants)))).otherwise(words)


def prefix_query(terms: Column) -> Column:
    """the full-text query as text: quoted prefixes, variants and terms joined by OR."""
    quoted = lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"*'))
    group = lambda v: F.when(F.size(v) > 1, F.concat(F.lit("("), F.array_join(F.transform(v, quoted), " OR "), F.lit(")"))).otherwise(quoted(v[0]))
    return F.array_join(F.transform(terms, lambda t: group(F.array_sort(token_variants(t)))), " OR ")


def estimated_tokens(c: Column) -> Column:
    """a quarter of the ASCII characters and half of the others, rounded down, plus one; 0 for nothing."""
    n = F.length(c)
    ascii_ = F.length(F.regexp_replace(c, "[^\\x00-\\x7F]", ""))
    return F.when(c.isNull() | (n == 0), 0).otherwise(F.floor(ascii_ / 4 + (n - ascii_) / 2) + 1).cast("long")


def short(c: Column, n: int = 240) -> Column:
    """white space collapsed, cut to n with an ellipsis."""
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - 1), F.lit("…")))


def window_share(words: Column, body: Column, size: int = 6, step: int = 3) -> Column:
    """The share of windows of `size` words, each `step`, that occur in the body; NULL for fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - size, F.lit(step))
    found = let(words, lambda w: F.filter(starts, lambda i: F.contains(body, F.array_join(F.slice(w, i + 1, size), " "))))
    return F.when(F.size(words) >= size, F.size(found) / F.size(starts))


def excerpt_found(excerpt: Column, body: Column, least: int = 15) -> Column:
    """F24 on normalised texts: a substring, or 80 % of its windows."""
    share = F.coalesce(window_share(tokens(excerpt), body), F.lit(0.0))
    return (F.length(excerpt) >= least) & (F.length(body) > 0) & (F.contains(body, excerpt) | (share >= 0.8))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either is empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / all_)


def near_duplicate(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """F25 on normalised texts."""
    return jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b))) >= threshold


def variant_hits(terms: Column, vocabulary: Column) -> Column:
    """The terms of a record search that a field has: numbers as whole words, others with their variants without proclitics."""

    def hit(t: Column, v: Column) -> Column:
        hebrew = F.exists(token_variants(t), lambda u: F.exists(v, lambda w: hebrew_match(u, w)))
        english = F.exists(v, lambda w: english_match(t, w))
        return F.array_contains(v, t) | F.when(is_digits(t), F.lit(False)).when(is_hebrew(t), hebrew).otherwise(english)

    return let(vocabulary, lambda v: F.filter(terms, lambda t: hit(t, v)))


def row_score(terms: Column, vocabulary: Column) -> Column:
    """matched terms; 1 where nothing is asked."""
    return F.when(F.size(terms) == 0, 1).otherwise(F.size(matched_terms(terms, vocabulary)))


def markdown(c: Column) -> Column:
    """characters with a meaning in Markdown get a backslash."""
    return F.regexp_replace(c, "([\\\\`*_{}\\[\\]()#+\\-.!|<>~$])", "\\\\$1")


def normalized_query(c: Column) -> Column:
    """F32."""
    return F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))


def coverage(got: Column, terms: Column) -> Column:
    """F44."""
    return F.size(got) / F.size(terms)
