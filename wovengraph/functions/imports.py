"""Use-declaration expansion."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def expand_use(path: str) -> list[str]:
    """The paths that a braced use path stands for: `a::{b, c::{d, e}}` is a::b, a::c::d and
    a::c::e.  A trailing ` as name` falls away.  Unbalanced braces are left as they are."""
    done: list[str] = []

    def at_top(text: str) -> list[str]:
        depth, parts, begin = 0, [], 0
        for k, c in enumerate(text):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                parts.append(text[begin:k])
                begin = k + 1
        return [p.strip() for p in [*parts, text[begin:]] if p.strip()]

    def glue(a: str, b: str) -> str:
        return a + b if not b or a.endswith("::") or b.startswith("::") else f"{a}::{b}"

    todo = [path.strip()]
    while todo:
        now = todo.pop()
        begin = now.find("{")
        depth, end = 0, -1
        for k in range(max(begin, 0), len(now)) if begin >= 0 else ():
            depth += (now[k] == "{") - (now[k] == "}")
            if depth == 0:
                end = k
                break
        if begin >= 0 and end >= 0:
            inner = at_top(now[begin + 1 : end])
            todo += [glue(glue(now[:begin], p), now[end + 1 :]) for p in reversed(inner)]
        elif begin >= 0:
            done.append(now)
        else:
            done.append(re.split(" as ", now, maxsplit=1)[0].strip())
    return done


@F.pandas_udf(T.ArrayType(T.StringType()))
def expand_use_paths(path: pd.Series) -> pd.Series:
    """`expand_use` over a column (Arrow batches); null stays null."""
    return path.map(lambda p: None if p is None else expand_use(p))
