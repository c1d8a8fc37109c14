"""The search box's query language, parsed on the driver into a plan's parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
import re

from foliant.config import EXT_GROUPS
from foliant.functions.text import fold
from foliant.functions.tokenizer import query_terms

# Han words of this shape must also occur letter by letter
_HAN_WORD = re.compile(r"[\u3400-\u9FFF\uF900-\uFAFF]{2,12}")
# The names of field filters, and the numbers of stars
_FIELD = re.compile(r"(ext|type|tag|folder|star|size):(.+)", re.IGNORECASE | re.DOTALL)
_STARS = re.compile(r"(>=|<=|>|<|=)?\s*([0-9]+)")


@dataclass
class Filters:
    """Restrictions on documents; lists keep first-seen order. Extensions and groups are alternatives, tags and folders must all hold."""

    exts: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    star_min: int = 0

    def merged(self, other: Filters | None) -> Filters:
        """Both sets of restrictions: united lists, the greater number of stars."""
        if other is None:
            return self
        both = lambda name: list(dict.fromkeys([*getattr(self, name), *getattr(other, name)]))
        return Filters(both("exts"), both("groups"), both("tags"), both("folders"), max(self.star_min, other.star_min))

    def __bool__(self) -> bool:
        return bool(self.exts or self.groups or self.tags or self.folders or self.star_min > 0)


@dataclass
class ParsedQuery:
    raw: str = ""
    terms: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    surfaces: list[str] = field(default_factory=list)
    neg_terms: list[str] = field(default_factory=list)
    neg_literals: list[str] = field(default_factory=list)
    neg_surfaces: list[str] = field(default_factory=list)
    filters: Filters = field(default_factory=Filters)


def _take_field(filters: Filters, key: str, value: str) -> None:
    if key == "ext":
        filters.exts.append(value.lower().removeprefix("."))
    elif key == "type":
        name = value.lower()
        (filters.groups if name in EXT_GROUPS else filters.exts).append(name)
    elif key == "tag":
        filters.tags.append(value)
    elif key == "folder":
        filters.folders.append(value)
    elif key == "star" and (m := _STARS.fullmatch(value)):
        # an upper bound is no filter, and of several the last one holds
        filters.star_min = 0 if (m[1] or "").startswith("<") else int(m[2])


def parse_query(text: str | None) -> ParsedQuery:
    """Parse a query; null and blank ones have no terms and no filters.

    ``"phrase"`` must occur verbatim, a bare word's terms must all occur, ``-word``
    excludes, ``ext: type: tag: folder: star:`` filter and ``size:`` is ignored. Quotes are
    read first, so a minus before a phrase is a word of its own and the phrase is required.
    A minus before a field filter is ignored.
    """
    q = ParsedQuery(raw=(text or "").strip())

    def phrase(m: re.Match) -> str:
        inner = m[1].strip()
        if inner:
            q.surfaces.append(inner)
            q.literals.append(fold(inner))
            q.terms.extend(query_terms(inner))
        return " "

    for word in re.sub(r'"([^"]+)"', phrase, q.raw).split():
        negative = len(word) > 1 and word.startswith("-")
        word = word[1:] if negative else word
        if m := _FIELD.fullmatch(word):
            _take_field(q.filters, m[1].lower(), m[2])
            continue
        han = _HAN_WORD.fullmatch(word) is not None
        terms, literals, surfaces = (q.neg_terms, q.neg_literals, q.neg_surfaces) if negative else (q.terms, q.literals, q.surfaces)
        terms.extend(query_terms(word))
        if han:
            literals.append(word)
        if han or not negative:
            surfaces.append(word)
    for name in ("terms", "literals", "surfaces", "neg_terms", "neg_literals", "neg_surfaces"):
        setattr(q, name, list(dict.fromkeys(getattr(q, name))))
    return q
