"""Column-expression helpers (all JVM-side, codegen-friendly)."""

from riskloom.functions.bands import (  # noqa: F401
    risk_band, risk_tier, sentiment_band, severity_rank, tier_color,
)
from riskloom.functions.jurisdiction import (  # noqa: F401
    DEFAULT_LISTS, JurisdictionList, jurisdiction_risk,
)
from riskloom.functions.text import (  # noqa: F401
    join_nonempty, norm_id, norm_name, python_title, yes_no,
)
