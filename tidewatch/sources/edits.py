"""Edit-stream (server-sent events) source: decode (A3), filter (B2), projection (B1).

``sse_lines`` derives an event-stream text from the provided ``events`` table (the tables
hold no edit records): per event an ``event:`` line, an ``id:`` line, a ``data:`` line with
the edit JSON, and a blank separator; every 13th event also gets a malformed ``data:``
line. Titles, wikis and bot flags vary by rule so that every filter branch is exercised.
In production the same decode runs on ``spark.read.text`` / ``readStream.text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.text import raw_text

EDIT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("user", T.StringType()),
    T.StructField("wiki", T.StringType()), T.StructField("server_name", T.StringType()),
    T.StructField("comment", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("bot", T.BooleanType()), T.StructField("namespace", T.IntegerType()),
    T.StructField("meta", T.StructType([T.StructField("dt", T.StringType())])),
    T.StructField("length", T.StructType([T.StructField("old", T.LongType()),
                                          T.StructField("new", T.LongType())])),
    T.StructField("_corrupt_record", T.StringType()),
])


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def sse_lines(events: DataFrame) -> DataFrame:
    """events -> (line_no, value) text lines of an event stream."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    eid = F.col("event_id")
    r = eid % 8
    title = (F.when(r == 0, F.concat(F.lit("Talk:Page "), k.cast("string")))
             .when(r == 1, F.concat(F.lit("talk:page "), k.cast("string")))
             .when(r == 2, F.lit("   "))
             .when(r == 3, F.concat(F.lit("User:Someone"), F.col("user_id").cast("string")))
             .otherwise(F.concat(F.lit("Article "), k.cast("string"))))
    wiki = F.when(eid % 7 == 3, F.lit("dewiki")).otherwise(F.lit("enwiki"))
    bot = (F.when(F.col("event_type") == "error", F.lit(', "bot": true'))
           .when(F.col("event_type") == "signup", F.lit(""))
           .otherwise(F.lit(', "bot": false')))
    comment = F.when(F.col("event_type") == "view", F.lit("")).otherwise(
        F.concat(F.lit(', "comment": "Edit '), eid.cast("string"), F.lit('"')))
    base = F.floor(F.col("value")).cast("long")
    data = F.concat(
        F.lit('data: {"title": '), _q(title), F.lit(', "wiki": '), _q(wiki), bot, comment,
        F.lit(', "user": "User'), F.col("user_id").cast("string"), F.lit('"'),
        F.lit(', "server_name": "en.wikipedia.org", "type": "edit", "namespace": '), (k % 4).cast("string"),
        F.lit(', "meta": {"dt": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'),
        F.lit(', "length": {"old": '), base.cast("string"), F.lit(', "new": '), (base + k).cast("string"),
        F.lit("}}"))
    lines = F.array(F.lit("event: message"), F.concat(F.lit("id: "), eid.cast("string")), data, F.lit(""))
    lines = F.when(eid % 13 == 0, F.concat(lines, F.array(F.lit("data: {not json")))).otherwise(lines)
    return (events.select(eid, F.posexplode_outer(lines).alias("pos", "value")).where(F.col("pos").isNotNull())
            .select((eid * 8 + F.col("pos")).alias("line_no"), "value"))


def decode_sse(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """A3: keep ``data:`` lines, parse the rest as JSON, drop blanks and bad JSON."""
    v = F.col(value_col)
    payload = F.regexp_replace(F.substring(v, 6, 1 << 30), r"(?U)^\s+|\s+$", "")
    parsed = F.from_json(payload, EDIT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    keep = [c for c in lines.columns if c != value_col]
    return (lines.where((v != "") & v.startswith("data:"))
            .select(*keep, parsed.alias("e"))
            .where(F.col("e").isNotNull() & F.col("e._corrupt_record").isNull())
            .select(*keep, "e.*").drop("_corrupt_record"))


def edit_filter(edits: DataFrame) -> DataFrame:
    """B2: English wiki, not a bot (NULL passes), title not blank, no blocked prefix."""
    t = F.col("title")
    blocked = None
    for p in dims.BLOCKED_PREFIXES:
        b = t.startswith(p)
        blocked = b if blocked is None else (blocked | b)
    return edits.where((F.col("wiki") == "enwiki") & ~F.coalesce(F.col("bot"), F.lit(False))
                       & t.isNotNull() & ~t.rlike(r"(?U)\A\s*\z") & ~blocked)


def edit_projection(edits: DataFrame) -> DataFrame:
    """B1 + B3: flat edit message; comment defaults to ''."""
    comment = F.coalesce(F.col("comment"), F.lit(""))
    keep = [c for c in ("line_no",) if c in edits.columns]
    return edits.select(
        *keep, "title", "user", "wiki", "server_name", comment.alias("comment"),
        F.col("meta.dt").alias("timestamp"), F.col("length.old").alias("length_old"),
        F.col("length.new").alias("length_new"), "type", "namespace",
        F.lit("wikipedia").alias("source_type"),
        raw_text(F.col("title"), comment).alias("_raw_text"))
