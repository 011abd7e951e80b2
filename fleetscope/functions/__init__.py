from .scalar import (  # noqa: F401
    ampm_hour,
    band,
    datediff_boundary,
    decode,
    drive_of,
    format_bytes,
    ms_to_dhms,
    split_list,
    statement_text,
    try_ratio,
)
from .vector import cosine_distance, distance, dot, euclidean, norm, normalize  # noqa: F401
