"""Terms of mixed CJK and Latin text, as a column expression and as a Python twin."""

from __future__ import annotations

from collections import Counter
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import fold, folded

# Character ranges of terms
CJK_RANGES = "3040-30FF 3400-4DBF 4E00-9FFF F900-FAFF AC00-D7AF 20000-2FA1F"
WORD_RANGES = "0030-0039 0061-007A 00C0-024F 0370-03FF"
JOINERS = "-_./+'"
# Words that are no terms
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "的 了 是 在 和 与 及 或 有 我 你 他 她 它 这 那 就 都 而 也 很 到 说 要 会 于 以 为 被 把 让 给 对 从 但 又 还 等 "
            "the a an and or of to in for is are was were be been on at by with from as it this that these those "
            "not no do does did can could will would should"
        ).split()
    )
)


def _java(ranges: str) -> str:
    return "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


def _python(ranges: str) -> str:
    return "".join("-".join(re.escape(chr(int(x, 16))) for x in r.split("-")) for r in ranges.split())


CJK, WORD = _java(CJK_RANGES), _java(WORD_RANGES)
_JOIN = re.escape(JOINERS)
#: Joiners that don't stand between two word characters separate; afterwards a word is a plain run, whatever its length.
LOOSE_JOINER = rf"(?<![{WORD}])[{_JOIN}]|[{_JOIN}](?![{WORD}])"
RUN = rf"[{CJK}]+|[{WORD}{_JOIN}]+"
_TWIN = re.compile(rf"([{_python(CJK_RANGES)}]+)|([{_python(WORD_RANGES)}]+(?:[{_JOIN}][{_python(WORD_RANGES)}]+)*)")


def term_array(column: Column | str, normalise: bool = True) -> Column:
    """All terms of a text, with repeats; a null or empty text has none.

    Every character of a CJK run is a term, and so is every two neighbours; a word is one
    term with its inner joiners. Stop words and single letters are left out, single digits
    stay. ``normalise`` applies NFKC and lower case, otherwise only lower case.
    """
    column = F.col(column) if isinstance(column, str) else column
    text = folded(column) if normalise else F.lower(F.coalesce(column, F.lit("")))
    runs = F.regexp_extract_all(F.regexp_replace(text, LOOSE_JOINER, " "), F.lit(RUN), F.lit(0))

    def grams(chars: Column) -> Column:
        n = F.size(chars) - 1
        return F.concat(chars, F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b)))

    def of_run(run: Column) -> Column:
        # the characters become a lambda's variable, so that they are found once and not for each pair
        chars = F.array(F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0)))
        return F.when(F.rlike(run, F.lit(rf"^[{CJK}]")), F.element_at(F.transform(chars, grams), 1)).otherwise(F.array(run))

    kept = lambda t: ~t.isin(*STOP_WORDS) & ((F.length(t) > 1) | F.rlike(t, F.lit(rf"[0-9{CJK}]")))
    return F.filter(F.flatten(F.transform(runs, of_run)), kept)


def tokenize(text: str | None) -> Counter[str]:
    """The Python twin of :func:`term_array`: terms in first-seen order with their counts."""
    terms: Counter[str] = Counter()
    for m in _TWIN.finditer(fold(text)):
        run = m[1]
        found = [m[2]] if not run else [*run, *map("".join, zip(run, run[1:]))]
        terms.update(t for t in found if t not in _STOP and (run or len(t) > 1 or t.isdigit() and t.isascii()))
    return terms


_STOP = frozenset(STOP_WORDS)


def query_terms(text: str) -> list[str]:
    """Different terms in first-seen order."""
    return list(tokenize(text))
