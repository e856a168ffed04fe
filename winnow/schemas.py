"""Explicit schemas; nothing is inferred on read."""

SFT = (
    "record_id string, root_id string, task string, domain string, source string, split string, "
    "input_ids array<int>, labels array<int>, recipe_id string, user_id string, label_origin string"
)
FEEDBACK = (
    "record_id string, user_id string, history array<string>, history_times array<double>, timestamp double, "
    "item_id string, scene string, labels array<double>, split string, prompt string, propensity double, source string"
)
REVIEW = "user_id string, parent_asin string, timestamp bigint, rating double"
FEEDBACK_LOG = "user_id string, video_id string, time_ms string, tab string, is_click string, is_like string"

# The split vocabulary of each record family.
SFT_SPLITS = ("train", "select", "tune", "audit", "test")
FEEDBACK_SPLITS = ("train", "selection", "test")
SID_SPLITS = ("train", "selection", "calibration", "test")
# Fixed value: the label of an unsupervised token.
MASKED = -100
