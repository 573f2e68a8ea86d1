"""Parameters the registered queries and their SQL counterparts share."""

from coursebeacon.operators.blending import BLEND_WEIGHTS  # noqa: F401  (re-exported)
from coursebeacon.operators.whatif import Sliders
from coursebeacon.schemas import MAX_WEEKS

WEEKS = MAX_WEEKS
CLASS_SLIDERS = Sliders(total_clicks=10, n_submitted=-20, mean_score=5, completion=15, active_weeks=-10)
CORRELATION = ("mean_score", "learning_index")
FLOOR = 0.75
LOG_FP_COST = 2.5
