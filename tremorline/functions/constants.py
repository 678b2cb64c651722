"""Fixed values.

Everything in this module is a constant that has to have exactly this value for
results to come out right: vocabularies, look-up tables, thresholds and formats.
Every operator takes these as defaults and accepts replacements.
"""

from __future__ import annotations


# --- fixed values: phrase vocabulary (phrase, event type, base score), order matters ---
PHRASES = [
    ("political violence", "political_violence", 0.85),
    ("assassination attempt", "political_violence", 0.90),
    ("shooting at protest", "political_violence", 0.90),
    ("attacked at rally", "political_violence", 0.85),
    ("bombing", "political_violence", 0.75),
    ("pipe bomb", "political_violence", 0.85),
    ("molotov", "political_violence", 0.80),
    ("police clash", "police_clash", 0.85),
    ("clashed with police", "police_clash", 0.85),
    ("tear gas", "police_clash", 0.80),
    ("pepper spray", "police_clash", 0.75),
    ("rubber bullet", "police_clash", 0.80),
    ("police brutality", "police_clash", 0.80),
    ("officer injured", "police_clash", 0.75),
    ("officers injured", "police_clash", 0.75),
    ("highway blocked", "protest_related_road_shutdown", 0.80),
    ("freeway blocked", "protest_related_road_shutdown", 0.80),
    ("bridge shutdown", "protest_related_road_shutdown", 0.75),
    ("road blockade", "protest_related_road_shutdown", 0.75),
    ("interstate blocked", "protest_related_road_shutdown", 0.80),
    ("property damage", "vandalism_tied_to_unrest", 0.60),
    ("storefronts smashed", "vandalism_tied_to_unrest", 0.80),
    ("windows smashed", "vandalism_tied_to_unrest", 0.75),
    ("looting", "riot", 0.85),
    ("rioters", "riot", 0.85),
    ("rioting", "riot", 0.85),
    ("riot broke out", "riot", 0.90),
    ("crowd dispersed", "crowd_disruption", 0.65),
    ("crowd dispersal", "crowd_disruption", 0.70),
    ("mob", "crowd_disruption", 0.65),
    ("rally against", "protest", 0.70),
    ("march against", "protest", 0.70),
]

# --- fixed values: token vocabulary (token, event type, base score), order matters ---
TOKENS = [
    ("protest", "protest", 0.65),
    ("protesters", "protest", 0.65),
    ("protester", "protest", 0.65),
    ("demonstration", "protest", 0.65),
    ("demonstrators", "protest", 0.65),
    ("picket", "protest", 0.60),
    ("picketing", "protest", 0.60),
    ("marchers", "protest", 0.60),
    ("rally", "protest", 0.55),
    ("rallying", "protest", 0.55),
    ("riot", "riot", 0.70),
    ("vandalism", "vandalism_tied_to_unrest", 0.65),
    ("vandalized", "vandalism_tied_to_unrest", 0.65),
    ("graffiti", "vandalism_tied_to_unrest", 0.55),
    ("arson", "vandalism_tied_to_unrest", 0.70),
    ("stampede", "crowd_disruption", 0.70),
    ("baton", "police_clash", 0.65),
    ("unrest", "unrest", 0.55),
]

# --- fixed values: vocabularies of the classifier ---
CATEGORY_FRAGMENTS = [
    "conflict", "protest", "violence", "civil_unrest", "riot", "demonstration", "human_rights", "political",
    "social_action", "activism",
]
CONCEPT_FRAGMENTS = [
    "protest", "riot", "civil_unrest", "demonstration", "political_violence", "police_brutality", "social_movement",
    "activism",
]
OPINION_OPENERS = [
    "opinion", "analysis", "editorial", "column", "commentary", "perspective", "explainer", "review",
    r"fact[\s-]check", "op-ed", "letter to",
]
OPINION_DELIMITERS = r"[\s:,–—]"
WEATHER_TOKENS = ["hurricane", "tornado", "earthquake", "flood", "flooding", "wildfire", "blizzard", "drought", "tsunami"]
WEATHER_EXEMPT_TOKENS = ["protest", "riot", "unrest", "violence", "clash", "demonstrat"]
ACCIDENT_PHRASES = ["car crash", "traffic accident", "vehicle accident", "auto accident"]
ACCIDENT_EXEMPT_SUBSTRINGS = ["protest", "rally"]
EXCLUDED_DOMAINS = [
    "sports", "entertainment", "business", "technology", "finance", "lifestyle", "fashion", "travel", "food",
    "health", "science",
]
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "is",
    "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "as", "that", "this", "it", "its", "after", "during", "over", "into", "about", "than", "more",
    "not", "no", "new", "says", "said", "amid", "following",
]

# --- fixed values: classifier weights ---
MIN_SCORE = 0.6
BODY_PHRASE_WEIGHT = 0.7
BODY_TOKEN_WEIGHT = 0.55
CATEGORY_BOOST = 0.2
CONCEPT_BOOST = 0.1
CONCEPT_BOOST_CAP = 0.3
NEEDS_SUPPORT_TYPES = ["vandalism_tied_to_unrest", "crowd_disruption"]
UNSUPPORTED_TYPE = "unrest"
UNSUPPORTED_SCORE_CAP = 0.6

# --- fixed values: type compatibility (type: types it may be matched with), directional ---
COMPATIBLE_TYPES = {
    "protest": ["protest", "police_clash", "crowd_disruption", "protest_related_road_shutdown", "unrest"],
    "police_clash": ["police_clash", "protest", "riot", "unrest"],
    "riot": ["riot", "vandalism_tied_to_unrest", "police_clash", "crowd_disruption", "unrest"],
    "vandalism_tied_to_unrest": ["vandalism_tied_to_unrest", "riot", "unrest"],
    "crowd_disruption": ["crowd_disruption", "protest", "riot", "unrest"],
    "protest_related_road_shutdown": ["protest_related_road_shutdown", "protest", "unrest"],
    "political_violence": ["political_violence", "violence"],
    "unrest": ["unrest", "protest", "riot", "crowd_disruption", "vandalism_tied_to_unrest", "police_clash"],
    "violence": ["violence", "political_violence", "riot"],
    "disruption": ["disruption", "crowd_disruption", "unrest"],
    "other": ["other"],
}

# --- fixed values: matching gates ---
MATCH_HOURS = 48
MATCH_MILES = 50.0
MATCH_SIMILARITY = 0.4
INCOMPATIBLE_EXTRA = 0.2
SIMILARITY_WEIGHT, RECENCY_WEIGHT, PROXIMITY_WEIGHT = 0.5, 0.3, 0.2

# --- fixed values: wire services (family: substrings of the outlet name), first family wins ---
WIRE_FAMILIES = {
    "ap": ["associated press", "ap news", "apnews", "ap ", "the ap", "/ap/"],
    "reuters": ["reuters"],
    "upi": ["upi", "united press international"],
    "afp": ["agence france", "afp"],
    "cnn wire": ["cnn wire", "cnn.com wire"],
    "nbc news wire": ["nbc news wire"],
}
WIRE_DOMAINS = ["apnews.com", "reuters.com", "upi.com"]
COPY_SIMILARITY = 0.85
REWRITE_SIMILARITY = 0.70
REWRITE_MINUTES = 30

# --- fixed values: severity by event type, and the default ---
TYPE_SEVERITY = {
    "political_violence": 0.85,
    "riot": 0.75,
    "police_clash": 0.70,
    "vandalism_tied_to_unrest": 0.55,
    "crowd_disruption": 0.50,
    "protest_related_road_shutdown": 0.45,
    "protest": 0.40,
    "unrest": 0.50,
}
DEFAULT_SEVERITY = 0.50

# --- fixed values: location precision, most precise first; bonuses and caps ---
PRECISIONS = ["venue", "city", "state", "country"]
PRECISION_BONUS = {"venue": 0.12, "city": 0.08, "state": 0.0}
PRECISION_CAP = {"venue": 0.62, "city": 0.58, "state": 0.45}
DEFAULT_PRECISION_CAP = 0.45
UNCORROBORATED_CAP = 0.58
CORROBORATION_UPLIFT = 0.08
MAX_NEW_EVENTS = 10

# --- fixed values: US states (abbreviation, name, centroid latitude, centroid longitude) ---
STATES = [
    ("AL", "Alabama", 32.8, -86.8),
    ("AK", "Alaska", 64.2, -153.4),
    ("AZ", "Arizona", 34.3, -111.9),
    ("AR", "Arkansas", 34.9, -92.4),
    ("CA", "California", 36.8, -119.4),
    ("CO", "Colorado", 39.0, -105.5),
    ("CT", "Connecticut", 41.6, -72.7),
    ("DE", "Delaware", 38.9, -75.5),
    ("FL", "Florida", 28.6, -82.5),
    ("GA", "Georgia", 32.7, -83.4),
    ("HI", "Hawaii", 20.3, -156.3),
    ("ID", "Idaho", 44.4, -114.6),
    ("IL", "Illinois", 40.0, -89.2),
    ("IN", "Indiana", 40.3, -86.1),
    ("IA", "Iowa", 42.0, -93.5),
    ("KS", "Kansas", 38.5, -98.4),
    ("KY", "Kentucky", 37.5, -85.3),
    ("LA", "Louisiana", 31.1, -91.8),
    ("ME", "Maine", 45.4, -69.0),
    ("MD", "Maryland", 39.0, -76.8),
    ("MA", "Massachusetts", 42.3, -71.8),
    ("MI", "Michigan", 44.3, -85.6),
    ("MN", "Minnesota", 46.4, -93.1),
    ("MS", "Mississippi", 32.7, -89.7),
    ("MO", "Missouri", 38.5, -92.5),
    ("MT", "Montana", 47.0, -109.6),
    ("NE", "Nebraska", 41.5, -99.9),
    ("NV", "Nevada", 39.3, -116.6),
    ("NH", "New Hampshire", 43.7, -71.6),
    ("NJ", "New Jersey", 40.1, -74.5),
    ("NM", "New Mexico", 34.5, -106.1),
    ("NY", "New York", 43.0, -75.5),
    ("NC", "North Carolina", 35.5, -79.8),
    ("ND", "North Dakota", 47.5, -100.5),
    ("OH", "Ohio", 40.4, -82.7),
    ("OK", "Oklahoma", 35.6, -97.5),
    ("OR", "Oregon", 44.1, -120.5),
    ("PA", "Pennsylvania", 40.9, -77.8),
    ("RI", "Rhode Island", 41.7, -71.5),
    ("SC", "South Carolina", 33.8, -80.9),
    ("SD", "South Dakota", 44.4, -100.2),
    ("TN", "Tennessee", 35.9, -86.7),
    ("TX", "Texas", 31.1, -97.6),
    ("UT", "Utah", 39.3, -111.1),
    ("VT", "Vermont", 44.0, -72.7),
    ("VA", "Virginia", 37.8, -78.2),
    ("WA", "Washington", 47.4, -120.5),
    ("WV", "West Virginia", 38.9, -80.5),
    ("WI", "Wisconsin", 44.3, -89.8),
    ("WY", "Wyoming", 43.0, -107.6),
    ("DC", "District of Columbia", 38.9, -77.0),
]
DC_DISPLAY_NAME = "Washington, D.C."
COUNTRY_LABELS = ["United States", "United States of America"]

# --- fixed values: clustering and scoring ---
EARTH_RADIUS_MILES = 3958.8
CLUSTER_MILES = 75.0
CLUSTER_HOURS = 72
MIN_MEMBERS = 3
MAX_HOTSPOTS = 15

# --- fixed values: feeds ---
CODED_FEED = "gdelt"
ARTICLE_FEED = "eventregistry"
SAMPLE_FEED = "mock"
ARTICLE_ID_PREFIX = "er-"
EXPORT_WIDTH = 61
EXPORT_COLUMNS = {  # column name -> 0-based position in the export
    "global_event_id": 0, "day": 1, "actor1_name": 6, "event_code": 26, "root_code": 28, "goldstein": 30,
    "num_sources": 32, "geo_type": 51, "geo_name": 52, "geo_country": 53, "geo_adm1": 54, "geo_lat": 56,
    "geo_long": 57, "source_url": 60,
}
ROOT_CODES = {  # root code -> (event type, title label)
    "14": ("protest", "Protest"),
    "17": ("unrest", "Civil unrest"),
    "18": ("violence", "Violence"),
}
GEO_TYPE_PRECISION = {"1": "country", "2": "state", "3": "city", "4": "venue"}
LOCATION_TYPE_PRECISION = {"place": "venue", "city": "city", "admin": "state", "admin1": "state", "admin2": "state"}
EXPORT_FILE_FORMAT = "yyyyMMddHHmmss"
EXPORT_FILE_SUFFIX = ".export.CSV.zip"
MAX_WINDOWS = 96
POLL_SECONDS = 1800
SUMMARY_CHARS = 500
CATEGORY_LABELS = 5
ERROR_CHARS = 1000

# --- derived from the tables above ---
STATE_ABBREVIATION = {name: ab for ab, name, _, _ in STATES}
STATE_CENTROID = {ab: (lat, lon) for ab, _, lat, lon in STATES}
STATE_DISPLAY_NAME = {ab: (DC_DISPLAY_NAME if ab == "DC" else name) for ab, name, _, _ in STATES}
STATE_NAMES = [name for ab, name, _, _ in STATES if ab != "DC"]

# --- fixed values: wording of the hotspot summary ---
TREND_WORDS = {"escalating": "Escalating", "declining": "Declining"}
TREND_WORD_OTHERWISE = "Ongoing"
SEVERITY_WORDS = [(0.8, "high-severity"), (0.5, "moderate-severity")]
SEVERITY_WORD_OTHERWISE = "low-severity"
SUMMARY_CLUSTER = " cluster · "
SUMMARY_PRIORITY = " · priority "
SUMMARY_TYPE = " Predominant type: "
SUMMARY_ALL_IMPRECISE = " Regional aggregate — all signals are state-level. Location is approximate."
SUMMARY_SOME_IMPRECISE = " with imprecise location — cluster label may be approximate."
