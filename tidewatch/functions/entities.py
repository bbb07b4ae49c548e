"""Entity extraction (D9, D10, D11), re-aimed as dictionary matching.

The original ran a statistical tagger. Offline we match a fixed dictionary of surface forms
(gazetteer places and a few organisations / events) with one regular expression per row:
order of appearance and repeats are kept, as the tagger output was.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import STR_ARRAY, _c, alternatives, is_blank, tokens


def dictionary_pattern() -> str:
    """Alternation of surface forms, longest first, on word boundaries."""
    return r"\b(" + alternatives(s for s, _ in dims.ENTITY_DICTIONARY) + r")\b"


def entity_mentions(text) -> Column:
    """Surface forms found in the whole text, in order, repeats kept."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(dictionary_pattern()), 1)


def entities_map(text, found=None) -> Column:
    """Label -> mentions (labels in order of first appearance); blank -> {}.

    ``found`` may be a materialised ``entity_mentions(text)`` column, so that the regex runs
    once per row rather than once per use inside the label lambdas."""
    lab = dims.entity_label_map_col()
    found = entity_mentions(text) if found is None else _c(found)
    labels = F.array_distinct(F.transform(found, lambda f: F.element_at(lab, f)))
    m = F.map_from_arrays(labels, F.transform(labels, lambda lb: F.filter(found, lambda f: F.element_at(lab, f) == lb)))
    empty = F.create_map().cast("map<string,array<string>>")
    return F.when(is_blank(text), empty).otherwise(m)


def _labels(m, names) -> Column:
    return F.concat(*[F.coalesce(F.try_element_at(_c(m), F.lit(n)), F.array().cast(STR_ARRAY)) for n in names])


def _clean(a) -> Column:
    return F.array_sort(F.array_distinct(F.transform(a, lambda x: F.trim(x))))


def entities_struct(m) -> Column:
    """locations/countries <- GPE+LOC, people <- PERSON, orgs <- ORG; trimmed,
    de-duplicated, sorted (the original order was undefined)."""
    loc = _clean(_labels(m, ["GPE", "LOC"]))
    return F.struct(loc.alias("locations"), _clean(_labels(m, ["PERSON"])).alias("people"),
                    _clean(_labels(m, ["ORG"])).alias("orgs"), loc.alias("countries"))


def keywords_distinct(text) -> Column:
    """D11 (re-aimed): distinct sorted tokens of the whole text; blank -> []."""
    return F.when(is_blank(text), F.array().cast(STR_ARRAY)).otherwise(
        F.array_sort(F.array_distinct(tokens(text))))
