"""Fixed values that define query semantics.

These must equal the behaviour being reproduced, so they are stated plainly.
"""

# Fuzzy threshold (absolute Damerau-Levenshtein edits) and
# default ranks for the anniversary and peak queries.
FUZZY_DISTANCE_THRESHOLD = 2
DEFAULT_ANNIVERSARY_RANK = 1
DEFAULT_PEAK_RANK = 10
