"""JSON texts as trees: their string leaves rewritten, all else left as it is written."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

STRING, COLON = re.compile(r'"(?:[^"\\]|\\.)*"'), re.compile(r"[ \t\r\n]*:")


def rewritten(text: str, change: Callable[[str], str]) -> str:
    """The JSON text with change() of each string that isn't a key; keys, order, numbers, blanks and repeated keys stay.

    A leaf that change() leaves as it is keeps its spelling; another is written without escaping letters. ValueError if the
    text isn't JSON.
    """
    json.loads(text)
    out, at = [], 0
    for m in STRING.finditer(text):
        if COLON.match(text, m.end()):
            continue
        leaf = json.loads(m[0])
        new = change(leaf)
        if new != leaf:
            out += [text[at : m.start()], json.dumps(new, ensure_ascii=False)]
            at = m.end()
    return "".join([*out, text[at:]])


def with_leaves(c: Column, change: Callable[[str], str]) -> Column:
    """rewritten() of a column of JSON; what is null or not JSON stays (see is_json)."""

    def one(text: str | None) -> str | None:
        try:
            return rewritten(text, change) if text else text
        except ValueError:
            return text

    return F.pandas_udf(lambda s: s.map(one), StringType())(c)


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()
