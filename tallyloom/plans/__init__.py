from .allocation import allocate_units  # noqa: F401
from .panel import feature_panel, run  # noqa: F401
from .production import classify_year, collect_units, produce  # noqa: F401
