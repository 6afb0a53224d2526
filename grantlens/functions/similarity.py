"""Name similarities as pandas UDFs: 100 x 2 x longest common subsequence / total length, on strings, sorted tokens and token sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def ratio_of(a: str, b: str) -> int:
    if not a and not b:
        return 100
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return round(200 * (len(a) - open_.bit_count()) / (len(a) + len(b)))


def token_sort_of(a: str, b: str) -> int:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> int:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100
    with_a, with_b = (f"{both} {o}".strip() for o in (only_a, only_b))
    return max(ratio_of(with_a, with_b), *((ratio_of(both, with_a), ratio_of(both, with_b)) if both else (0, 0)))


def _udf(f):
    @F.pandas_udf(IntegerType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b)])

    return run


ratio, token_sort, token_set = _udf(ratio_of), _udf(token_sort_of), _udf(token_set_of)
