"""Hierarchical codes and technical-standard references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofbase.functions import text as tx

# What a code looks like, and the schemes of standards.
CODE_PATTERN = "^-?[0-9][0-9.\\- ]*(/[0-9])?$"
SCHEMES = "ISO(?:/IEC)?|IEC|EN|DIN|ASTM|ANSI|BS|UL|SI|SAE|JIS|NFPA|IEEE"
HEBREW_SCHEMES = "ת[\"״'׳]י|תקן(?:\\s+ישראלי)?(?:\\s+רשמי)?"

# The grammar of a reference: a scheme, a number of 2 to 6 digits, perhaps a part of up to 3 digits and a decimal.
_NUMBER, _PART, _GAP = "([0-9]{2,6})", "([0-9]{1,3}(?:\\.[0-9]{1,2})?)", "\\s*"
_PART_WORD = f"{_GAP}(?:חלק|part){_GAP}"


def _reference(scheme: str, between: str, before_part: str) -> str:
    return f"(?i){scheme}{between}{_NUMBER}(?:{before_part}{_PART})?"


STANDARD = _reference(f"(?<![A-Za-z])({SCHEMES})", f"{_GAP}[- ]?{_GAP}", f"(?:-|\\s+part\\s+|{_GAP}חלק{_GAP})")
HEBREW_STANDARD = _reference(f"(?:{HEBREW_SCHEMES})", f"{_GAP}(?:מס['׳]?{_GAP})?", _PART_WORD)


def normalize_code(c: Column) -> Column:
    """F13 for text: digits with a leading minus; a check digit after the slash goes; no code gives ''."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), "^\\s+|\\s+$", "")
    sign = F.when(x.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(x, "/[0-9]$", ""), "[^0-9]", "")
    return F.when(x.rlike(CODE_PATTERN), F.concat(sign, digits)).otherwise("")


def normalize_number(c: Column) -> Column:
    """F13 for numeric columns, which lost leading zeros: fractions are cut off, 7 to 9 characters are padded to 10 after the sign."""
    x = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "\\..*$", "")
    x = F.when(x == "-0", "0").otherwise(x)
    sign = F.when(x.startswith("-"), "-").otherwise("")
    wide = F.concat(sign, F.lpad(F.ltrim(x, F.lit("-")), F.lit(10) - F.length(sign), F.lit("0")))
    return F.coalesce(F.when(F.length(x).between(7, 9), wide).otherwise(x), F.lit(""))


def hierarchy_key(code: Column) -> Column:
    """trailing zeros go, to the next even length, of two at least."""
    digits = F.regexp_replace(code, "^-+", "")
    sign = F.when(code.startswith("-"), "-").otherwise("")
    n = F.greatest(F.lit(2), F.length(F.rtrim(digits, F.lit("0"))))
    return F.when(digits == "", "").otherwise(F.concat(sign, F.substring(digits, F.lit(1), n + n % 2)))


def code_query(c: Column) -> Column:
    """the query as a code if it looks like one of two digits at least, else ''."""
    code = normalize_code(c)
    return F.when(F.length(F.regexp_replace(code, "^-", "")) >= 2, code).otherwise("")


def ancestors(hier: Column) -> Column:
    """The proper prefixes of even length."""
    sign = F.when(hier.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(hier, "^-", "")
    steps = F.when(F.length(digits) > 2, F.sequence(F.lit(2), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.concat(sign, F.substring(digits, F.lit(1), n)))


def number_in_field(number: Column, norm: Column, code: Column | None = None) -> Column:
    """F16 for numbers: a whole word, or in a code field the code's first 4, 6 or 8 digits."""
    whole = F.array_contains(tx.tokens(norm), number)
    return whole if code is None else whole | (F.length(number).isin(4, 6, 8) & code.startswith(number))


def standard_refs(c: Column) -> Column:
    """array of (scheme, number, part), Latin ones first, each once."""
    x = F.coalesce(c, F.lit(""))
    parts = lambda pattern, i: F.regexp_extract_all(x, F.lit(pattern), F.lit(i))
    bare = lambda n: F.when(F.ltrim(n, F.lit("0")) == "", "0").otherwise(F.ltrim(n, F.lit("0")))
    ref = lambda scheme, number, part: F.struct(scheme.alias("scheme"), bare(number).alias("number"), part.alias("part"))
    latin = F.transform(
        F.arrays_zip(parts(STANDARD, 1).alias("s"), parts(STANDARD, 2).alias("n"), parts(STANDARD, 3).alias("p")),
        lambda z: ref(F.when(F.upper(z["s"]).startswith("ISO"), "ISO").otherwise(F.upper(z["s"])), z["n"], z["p"]),
    )
    hebrew = F.transform(F.arrays_zip(parts(HEBREW_STANDARD, 1).alias("n"), parts(HEBREW_STANDARD, 2).alias("p")), lambda z: ref(F.lit("SI"), z["n"], z["p"]))
    return F.array_distinct(F.concat(latin, hebrew))


def standard_matches(found: Column, wanted: Column) -> Column:
    """scheme and number equal; the part only where the query names one."""
    return F.exists(wanted, lambda w: F.exists(found, lambda f: (f["scheme"] == w["scheme"]) & (f["number"] == w["number"]) & ((w["part"] == "") | (f["part"] == w["part"]))))
