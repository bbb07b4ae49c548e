"""Fixed parameters of the registered queries (shared by the Spark side and the oracle SQL)."""

PARAMS = {
    "feed_source": "news",
    "search_term": "london",
    "slot_seconds": 3600,
    "n_slots": 60,
    # seconds that a stream of slots waits for late events: files of the stream queries span up to some days
    "slot_delay": 5 * 86400,
    "cluster": "war",
    "sentiment": "NEGATIVE",
    "source": "gdacs",
    "range_lo": "2024-01-10 00:00:00",
    "range_hi": "2024-01-12 00:00:00",
    "retention": "7 DAYS",
    "cleared_at": "2024-01-15 00:00:00",
    "poll_back": 100,
    # the screen's 120 s, stretched like the slots: the test data has an event every few minutes
    "marker_seconds": 43200,
    "lookup_ids": [3, 17, 256, 777, 999, 5000, 99998, 10000000],
    "common_terms": ["tion", "ing"],
    "hotspot_places": 60,
    "hotspot_span": "3 DAYS",
    "token_terms": ["thtion", "eriner", "bertz"],
}
