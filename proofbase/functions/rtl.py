"""Right-to-left repair of extracted lines (F26, A15): visual order to logical order."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINALS = "ךםןףץ"
MIRROR = str.maketrans("()[]{}<>", ")(][}{><")
LEFT_RUN = r"[A-Za-z0-9][A-Za-z0-9.,:/%+\-]*"


def is_rtl(line: str) -> bool:
    return sum("֐" <= x <= "׿" for x in line) > sum(x.isascii() and x.isalpha() for x in line)


def reversed_score(text: str) -> int:
    """Words that begin with a final letter, less words that end with one: positive for reversed text."""
    words = [w for w in re.findall(r"[֐-׿]+", text) if len(w) > 1]
    return sum(w[0] in FINALS for w in words) - sum(w[-1] in FINALS for w in words)


def logical(line: str) -> str:
    """The line reversed, its left-to-right runs as they were."""
    return re.sub(LEFT_RUN, lambda m: m[0][::-1], line[::-1])


def balanced(line: str) -> bool:
    depth = 0
    for x in line:
        depth += (x in "([{") - (x in ")]}")
        if depth < 0:
            return False
    return depth == 0


def repair(line: str) -> str:
    """The line in logical order if it looks reversed and becomes better by it; mirrored brackets turned."""
    if not line or not is_rtl(line):
        return line
    found = logical(line) if reversed_score(line) > 0 and reversed_score(logical(line)) < reversed_score(line) else line
    turned = found.translate(MIRROR)
    return turned if not balanced(found) and balanced(turned) else found


@F.arrow_udf(T.StringType())
def repaired(lines: pa.Array) -> pa.Array:
    return pa.array(["\n".join(map(repair, (x or "").split("\n"))) for x in lines.to_pylist()], pa.string())


def reversed_counts(text: Column) -> Column:
    """A15 as an expression: words beginning less words ending with a final letter."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[\\u0590-\\u05FF]+"), F.lit(0)), lambda w: F.length(w) > 1)
    final = f"[{FINALS}]"
    return F.size(F.filter(words, lambda w: w.rlike("^" + final))) - F.size(F.filter(words, lambda w: w.rlike(final + "$")))
