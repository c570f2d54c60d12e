"""Parameters of the trout analysis.

Every operator takes these as arguments; the defaults live here so that one
import shows them all.
"""

# They decide the results and must stay exactly as given.
MAIN_RIVER = "West Br Delaware River"
SIZE_CUTOFFS = (230, 380)
SPECIES_CODES = {326: "rainbow trout", 328: "brown trout", 329: "brook trout"}
UNTAGGED_MARKS = ("", "ad")
EXCLUDED_TAGS = ("ad719472",)
MODEL_SPECIES = "brown trout"
DAYS_PER_MONTH = 30.5
DIRICHLET_SAME = 0.8
DIRICHLET_OTHER = 0.1
SIX_STATE_WEIGHTS = {
    "same": 0.75,
    "shrink": 0.01,
    "grow1": 0.025,
    "grow2": 0.001,
    "move": 0.025,
}
PRIOR_PRECISION = 0.1
HISTOGRAM_BINS = 30
MAX_GROWTH_GAP_DAYS = 300
GROWTH_RANGE = (0, 3)
RUN_3_STATE = {"n_iter": 5000, "n_burnin": 2000, "n_chains": 2, "thin": 5}
RUN_2_STATE = {"n_iter": 2500, "n_burnin": 1000, "n_chains": 2, "thin": 5}
RUN_6_STATE = {"n_iter": 1000, "n_burnin": 500, "n_chains": 2, "thin": 5}

# Scale settings of this library.
HOT_KEYS = 10_000  # the most frequent keys, handled by broadcast (see operators/skew.py)
HOT_MIN_ROWS = 10_000  # keys with fewer rows are never treated as frequent
HOT_KEY_SALTS = 1 << 30  # a frequent key is spread over all reducers, however many
BROADCAST_LEVELS = 100_000  # most levels of a dimension that is ever broadcast
LEVEL_BLOCK = 1_024  # levels of each side whose cells one task of a contingency table fills
