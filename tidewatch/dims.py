"""Dimension tables: fixed values plus small DataFrame / literal-column builders.

All tables here are fixed and small (the largest has 127 rows), so broadcasting them or
inlining them as literal arrays has a proven size bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# FIXED VALUES — these must equal the behaviour being reproduced; do not edit.
# ---------------------------------------------------------------------------------------

# Gazetteer: place -> (lat, lng), in the order the lookup table lists them.
GAZETTEER = [
    ("New York", 40.7128, -74.0060), ("US", 37.0902, -95.7129), ("USA", 37.0902, -95.7129),
    ("London", 51.5074, -0.1278), ("UK", 55.3781, -3.4360),
    ("Tokyo", 35.6762, 139.6503), ("Japan", 36.2048, 138.2529),
    ("Paris", 48.8566, 2.3522), ("France", 46.2276, 2.2137),
    ("Sydney", -33.8688, 151.2093), ("Australia", -25.2744, 133.7751),
    ("Dubai", 25.2048, 55.2708), ("UAE", 23.4241, 53.8478),
    ("Singapore", 1.3521, 103.8198),
    ("Mumbai", 19.0760, 72.8777), ("India", 20.5937, 78.9629),
    ("São Paulo", -23.5505, -46.6333), ("Brazil", -14.2350, -51.9253),
    ("Moscow", 55.7558, 37.6173), ("Russia", 61.5240, 105.3188),
    ("China", 35.8617, 104.1954), ("Beijing", 39.9042, 116.4074),
    ("Germany", 51.1657, 10.4515), ("Berlin", 52.5200, 13.4050),
]

# Stopwords removed by the tokenizer (tokens of length <= 2 are dropped anyway).
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s",
    "t", "can", "will", "just", "don", "should", "now",
]

# Topic clusters and their keywords, in declaration order. A keyword listed under two
# clusters keeps its first position but maps to the later cluster.
EVENT_CLUSTERS = [
    ("earthquake", ["earthquake", "quake", "tremor", "seismic", "magnitude", "richter", "aftershock"]),
    ("hurricane", ["hurricane", "typhoon", "cyclone", "storm", "tropical", "windstorm"]),
    ("flood", ["flood", "flooding", "inundation", "deluge", "overflow", "submerged"]),
    ("fire", ["fire", "wildfire", "blaze", "inferno", "arson", "burned", "flames"]),
    ("election", ["election", "vote", "ballot", "primary", "candidate", "campaign", "polling"]),
    ("war", ["war", "conflict", "military", "attack", "invasion", "troops", "airstrike", "ceasefire"]),
    ("pandemic", ["pandemic", "outbreak", "virus", "epidemic", "infection", "quarantine", "vaccine"]),
    ("economy", ["economy", "inflation", "recession", "gdp", "market", "stocks", "interest rate", "fed"]),
    ("ai", ["ai", "artificial intelligence", "machine learning", "llm", "chatgpt", "openai", "neural"]),
    ("protest", ["protest", "demonstration", "rally", "riot", "uprising", "march", "strike"]),
    ("terrorism", ["terrorism", "terrorist", "bombing", "attack", "explosion", "shooter", "hostage"]),
    ("climate", ["climate", "global warming", "carbon", "emissions", "drought", "temperature", "glacier"]),
    ("space", ["space", "nasa", "rocket", "satellite", "astronaut", "orbit", "launch", "mars"]),
    ("technology", ["technology", "tech", "software", "hardware", "apple", "google", "microsoft", "chip"]),
    ("health", ["health", "hospital", "drug", "cancer", "surgery", "treatment", "fda", "clinical"]),
    ("finance", ["finance", "market", "nasdaq", "s&p", "stock", "shares", "dividend", "earnings"]),
]

# Edit-stream title prefixes that are filtered out (case-sensitive).
BLOCKED_PREFIXES = [
    "Category:", "File:", "Template:", "User:", "User talk:",
    "Talk:", "Wikipedia:", "Wikipedia talk:", "Module:",
    "Draft:", "Portal:", "Special:", "Help:", "MediaWiki:",
]

# Entity labels the consumer keeps, and the four feeds' source names.
ENTITY_LABELS = ["PERSON", "ORG", "GPE", "EVENT", "LOC"]
FEED_SOURCES = ["news", "gdacs", "financial", "wikipedia"]
SENTIMENT_LABELS = ["positive", "neutral", "negative"]

BURST_THRESHOLD = 10          # alert when the running count is > this
CONFIDENCE_SCORE = 0.85       # constant confidence of the backend enrichment
SENTIMENT_CUTOFF = 0.05       # compound >= +cut positive, <= -cut negative
OLD_BUCKET_CUTOFF = 0.2       # older UI: > +cut positive, < -cut negative (strict)
MODEL_TEXT_CHARS = 512        # sentiment model input truncation
NER_TEXT_CHARS = 1000         # entity / noun model input truncation
KEYWORDS_TOP_N = 5
FLUSH_SECONDS = 5             # a batch is flushed at most this long after an event
MOOD_CLAMP = 10               # mood line is clamped to [-10, 10] after every event
ALERT_SOURCE = "system_alert"
ALERT_CLUSTER = "META_ALERT"
DEFAULT_CLUSTER = "general"

# ---------------------------------------------------------------------------------------
# Our own re-aimed dictionaries (the original used model libraries not available here).
# ---------------------------------------------------------------------------------------

# Surface form -> label for dictionary entity extraction. Gazetteer places are GPE.
ENTITY_DICTIONARY = [(p, "GPE") for p, _, _ in GAZETTEER] + [
    ("Europe", "LOC"), ("Asia", "LOC"), ("Africa", "LOC"), ("Pacific", "LOC"), ("Atlantic", "LOC"),
    ("Apple", "ORG"), ("Google", "ORG"), ("Microsoft", "ORG"), ("Amazon", "ORG"), ("Tesla", "ORG"),
    ("NASA", "ORG"), ("FDA", "ORG"), ("United Nations", "ORG"), ("OpenAI", "ORG"),
    ("Olympics", "EVENT"), ("World Cup", "EVENT"),
]

# Small valence lexicon (scale -4..+4) used by the built-in scorer. FIXED VALUES: words that the VADER lexicon
# (Hutto and Gilbert 2014, MIT licence) holds have its mean valence or one near it; the others are our own.
SENTIMENT_LEXICON = [
    ("good", 1.9), ("great", 3.1), ("excellent", 2.7), ("positive", 2.6), ("happy", 2.7),
    ("win", 2.8), ("wins", 2.7), ("success", 2.7), ("breakthrough", 2.0), ("growth", 1.6),
    ("gain", 2.0), ("gains", 1.8), ("safe", 1.9), ("peace", 2.5), ("hope", 1.9),
    ("love", 3.2), ("best", 3.2), ("improve", 1.9), ("rescue", 1.8), ("recovery", 1.6),
    ("bad", -2.5), ("worst", -3.1), ("negative", -2.7), ("sad", -2.1), ("fear", -2.2),
    ("crisis", -3.1), ("disaster", -3.1), ("death", -2.9), ("dead", -3.3), ("killed", -3.5),
    ("attack", -2.1), ("war", -2.9), ("loss", -1.3), ("losses", -1.7), ("fall", -0.6),
    ("crash", -1.7), ("threat", -2.4), ("danger", -2.4), ("damage", -2.2), ("fail", -2.5),
    ("failure", -2.3), ("hate", -2.7), ("terrible", -2.5), ("violence", -3.1), ("panic", -2.9),
    ("warning", -1.4), ("flood", -1.0), ("earthquake", -1.6), ("riot", -2.6), ("outbreak", -1.9),
]
VADER_ALPHA = 15.0            # compound = s / sqrt(s^2 + alpha), published normalisation


# ---------------------------------------------------------------------------------------
# Builders
# ---------------------------------------------------------------------------------------

_LIT_CACHE: dict[tuple, Column] = {}


def _cached(name: str, build):
    """Literal columns are built once per SparkContext (each literal is a JVM round trip)."""
    from pyspark import SparkContext
    key = (id(SparkContext._active_spark_context), name)
    c = _LIT_CACHE.get(key)
    if c is None:
        c = build()
        _LIT_CACHE[key] = c
    return c


def cluster_keywords() -> list[tuple[int, str, str]]:
    """(pos, keyword, cluster): unique keywords in first-listed order, last cluster wins."""
    order: dict[str, int] = {}
    owner: dict[str, str] = {}
    for cluster, kws in EVENT_CLUSTERS:
        for kw in kws:
            order.setdefault(kw, len(order))
            owner[kw] = cluster
    return [(order[k], k, owner[k]) for k in sorted(order, key=order.get)]


def lit_str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(T.StringType()))


def gazetteer_map_col() -> Column:
    """Literal map place -> struct(lat, lng)."""
    return _cached("gaz_map", lambda: F.map_from_arrays(
        lit_str_array([p for p, _, _ in GAZETTEER]),
        F.array(*[F.struct(F.lit(la).cast("double").alias("lat"), F.lit(lo).cast("double").alias("lng"))
                  for _, la, lo in GAZETTEER])))


def lexicon_map_col() -> Column:
    return _cached("lex_map", lambda: F.map_from_arrays(
        lit_str_array([w for w, _ in SENTIMENT_LEXICON]),
        F.array(*[F.lit(float(v)) for _, v in SENTIMENT_LEXICON])))


def entity_label_map_col() -> Column:
    return _cached("ent_map", lambda: F.map_from_arrays(
        lit_str_array([s for s, _ in ENTITY_DICTIONARY]), lit_str_array([lab for _, lab in ENTITY_DICTIONARY])))


def cluster_names_col() -> Column:
    return _cached("cluster_names", lambda: lit_str_array([c for c, _ in EVENT_CLUSTERS]))
