"""JSON that strict parsers take: sorted keys, null for numbers that are not finite."""

from __future__ import annotations

import json
import math
import os
from typing import Any


def plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(body: Any, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(plain(body), indent=2, sort_keys=True, allow_nan=False) + "\n")
    return path
