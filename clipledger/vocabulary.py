"""Fixed values shared by the operators.

These are published constants of the data model (label names, padding lengths,
anomaly codes, aliases). Results only match when they are spelled exactly so.
"""

# Event labels in class-id order.
LABELS = [
    "blank",
    "Missed Shot",
    "Made Shot",
    "Free Throw",
    "Foul",
    "Turnover",
    "Jump Ball",
    "Rebound",
    "steal",
    "block",
    "ast",
]
EVENT_LABELS = LABELS[1:]

# Extra spellings of a label.
LABEL_ALIASES = {"assist": "ast", "background": "blank"}
REPORT_ALIASES = {"assist": "ast", "assisted": "ast", "ast": "ast"}

# Seconds added before and after the evidence of each label.
PADDING_SECONDS = {
    "Missed Shot": (5.0, 2.0),
    "Made Shot": (5.0, 2.0),
    "Free Throw": (4.0, 3.0),
    "Foul": (3.0, 4.0),
    "Turnover": (4.0, 3.0),
    "Jump Ball": (4.0, 3.0),
    "Rebound": (4.0, 2.0),
    "steal": (4.0, 3.0),
    "block": (4.0, 3.0),
    "ast": (7.0, 2.0),
}
DEFAULT_PADDING = (3.0, 2.0)
BOUNDARY_METHOD = "event_evidence_with_type_padding"

# Action names that map straight to a label.
DIRECT_ACTIONS = {
    "free throw": "Free Throw",
    "foul": "Foul",
    "turnover": "Turnover",
    "jump ball": "Jump Ball",
    "rebound": "Rebound",
    "steal": "steal",
    "block": "block",
}
SHOT_ACTIONS = ["2pt shot", "3pt shot"]

# Team codes that differ between folder names and rosters.
TEAM_ALIASES = {"bkn": "BRK", "cha": "CHO"}

# Words a model may use for its confidence.
CONFIDENCE_WORDS = {"low": 0.3, "medium": 0.6, "high": 0.9}

# Accepted media suffixes and dataset split names.
VIDEO_SUFFIXES = ["avi", "mkv", "mov", "mp4", "webm"]
SPLITS = ["train", "valid", "test"]

# Fixed value: the game used while tuning rules, left out of evaluation bundles.
DEVELOPMENT_GAME = "bkn-vs-det-0022400861"

SCHEMA_VERSION = 2
