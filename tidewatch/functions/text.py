"""Text column functions.

All are ``Column -> Column`` built from JVM expressions and higher-order functions, so they
run inside whole-stage code generation, per row, with no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

STR_ARRAY = "array<string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def opt_col(df: DataFrame, name: str) -> Column:
    """Column if the frame has it, else a typed NULL (feeds differ in shape)."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def raw_text(title, body) -> Column:
    """Title + ' ' + comment/description (missing part -> '')."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(body), F.lit("")))


def enrich_text(*parts) -> Column:
    """Non-empty parts joined by one space. ``concat_ws`` skips NULL but keeps '' ->
    nullif."""
    return F.concat_ws(" ", *[F.nullif(_c(p), F.lit("")) for p in parts])


def enrich_text_of(df: DataFrame) -> Column:
    return enrich_text(*[opt_col(df, c) for c in ("title", "description", "content", "comment")])


def tokens(text) -> Column:
    """Lower, runs of [a-z0-9], keep length > 2 and not a stopword; NULL/'' -> [].

    One regular expression: a match starts at the beginning of a run (look-behind), is
    not a whole stopword (look-ahead), and greedily takes the whole run of 3+ characters.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(token_pattern()), 0)


def alternatives(words) -> str:
    """Pattern of any of the words, longest first, grouped by first letter so that a position is given up after one
    comparison a letter."""
    groups: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(groups.items()))


def token_pattern() -> str:
    stops = alternatives(w for w in dims.STOPWORDS if len(w) > 2)
    return r"(?<![a-z0-9])(?!(?:" + stops + r")(?![a-z0-9]))[a-z0-9]{3,}"


def word_count(toks) -> Column:
    """D2."""
    return F.size(_c(toks)).cast("long")


def token_counts(toks) -> Column:
    """Distinct tokens of a row as (neg_n, pos, w), sorted: count desc, then first appearance. Sorting
    (token, place) pairs brings equal tokens together; a run starts where its predecessor differs, so
    the cost is that of the sort and nothing leaves the row."""
    pairs = F.array_sort(F.transform(_c(toks), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    # a one-item transform binds the sorted pairs, and then the run starts, once
    return F.array_sort(F.flatten(F.transform(F.array(pairs), lambda s: F.flatten(F.transform(
        F.array(F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1)["w"] != x["w"]), j)),
                         lambda j: j.isNotNull())),
        lambda starts: F.transform(starts, lambda j, k: F.struct(
            (j - F.coalesce(F.get(starts, k + 1), F.size(s))).alias("neg_n"), F.get(s, j)["i"].alias("pos"),
            F.get(s, j)["w"].alias("w"))))))))


def keywords_long(df: DataFrame, id_col: str | list[str], toks_col: str, top_n: int = dims.KEYWORDS_TOP_N,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """D3 in long form: (ids, *carry, rank, keyword, n). Count desc, ties by first appearance. Counted
    and ranked inside the row: no exchange, and only ``top_n`` rows a document leave it."""
    keys = [*([id_col] if isinstance(id_col, str) else id_col), *carry]
    best = F.slice(token_counts(toks_col), 1, top_n)
    return (df.select(*keys, F.posexplode_outer(best).alias("at", "k")).where(F.col("k").isNotNull())
            .select(*keys, (F.col("at") + 1).cast("long").alias("rank"), F.col("k.w").alias("keyword"),
                    (-F.col("k.neg_n")).cast("long").alias("n")))


def keywords_array(df: DataFrame, id_col: str, toks_col: str, top_n: int = dims.KEYWORDS_TOP_N) -> DataFrame:
    """D3 as (id, keywords array in rank order)."""
    lg = keywords_long(df, id_col, toks_col, top_n)
    return (lg.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("kw"))
            .select(id_col, F.transform("kw", lambda s: s["keyword"]).alias("keywords")))


def keywords_inline(toks, top_n: int = dims.KEYWORDS_TOP_N) -> Column:
    """D3 inside one row, as an array."""
    return F.slice(F.transform(token_counts(toks), lambda s: s["w"]), 1, top_n)


def cluster_pattern() -> str:
    """A look-ahead whose group is the longest cluster keyword that starts at a position; tried at every one."""
    return "(?=(" + alternatives([k for _, k, _ in dims.cluster_keywords()]) + "))"


def _cluster_hits_col() -> Column:
    """Literal map keyword -> array<struct<pos, cluster>> of the keyword and all others that it starts with: where it
    stands, they stand too (built once per SparkContext)."""
    def build():
        kws = dims.cluster_keywords()
        return F.map_from_arrays(dims.lit_str_array([k for _, k, _ in kws]), F.array(*[
            F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(c).alias("cluster")) for p, q, c in kws if k.startswith(q)])
            for _, k, _ in kws]))
    return dims._cached("cluster_hits", build)


def classify_lowered(lt) -> Column:
    """D4 on lower-cased text: topic cluster by keyword *substring* containment.

    +1 per distinct matching keyword; best score wins; ties go to the cluster whose first
    matching keyword comes first in keyword order; no match (or NULL/'') -> 'general'.

    One regular expression a row finds the keywords at every position, overlapping ones too; what
    follows works on the keywords found, not on the whole list. The expression is compact, so a filter
    pushed through it stays cheap to plan and to evaluate.
    """
    hits = _cluster_hits_col()
    found = F.array_distinct(F.regexp_extract_all(_c(lt), F.lit(cluster_pattern()), 1))
    keywords = F.array_distinct(F.flatten(F.transform(found, lambda w: F.element_at(hits, w))))

    def best(ks):
        # (count, -position, cluster) of every keyword: the largest is that of the best cluster's first keyword
        return F.array_max(F.transform(ks, lambda k: F.struct(
            F.size(F.filter(ks, lambda o: o["cluster"] == k["cluster"])).alias("n"), (-k["pos"]).alias("neg_pos"),
            k["cluster"].alias("cluster"))))["cluster"]
    # a one-item transform binds the keywords once
    return F.coalesce(F.element_at(F.transform(F.array(keywords), best), 1), F.lit(dims.DEFAULT_CLUSTER))


def classify(text) -> Column:
    """D4 on raw text (see ``classify_lowered``)."""
    return classify_lowered(F.lower(_c(text)))


def with_cluster(df: DataFrame, text, out: str = "event_cluster") -> DataFrame:
    """D4 as a frame transform."""
    return df.withColumn(out, classify(text))


def is_blank(text) -> Column:
    """NULL or only (Unicode) whitespace."""
    return _c(text).isNull() | _c(text).rlike(r"(?U)\A\s*\z")


def truncate(text, n: int) -> Column:
    """First n characters (code points)."""
    return F.substring(_c(text), 1, n)


def capitalize_first(c) -> Column:
    """Upper-case the first letter only (unlike initcap, the rest is kept)."""
    return F.concat(F.upper(F.substring(_c(c), 1, 1)), F.substring(_c(c), 2, 1 << 30))


def decode_entities(js) -> Column:
    """JSON label -> list; malformed -> NULL."""
    return F.from_json(_c(js), "map<string,array<string>>")


def encode_json(c) -> Column:
    """D15."""
    return F.to_json(_c(c))


def flat_entities(m) -> Column:
    """All entity strings of a label map in label order (NULL lists skipped)."""
    return F.flatten(F.transform(F.map_values(_c(m)), lambda v: F.coalesce(v, F.array().cast(STR_ARRAY))))


def entities_of(m, labels: list[str]) -> Column:
    """Concatenated lists of the given labels (missing -> [])."""
    return F.concat(*[F.coalesce(F.try_element_at(_c(m), F.lit(lab)), F.array().cast(STR_ARRAY)) for lab in labels])
