"""Column functions on text: slugs, splitting, chunking, snippets, formatting."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from casebench.functions.lexicon import folded

TARGET, OVERLAP = 800, 100
WINDOW = 2000
PAGE_HEAD = r"(?m)^## Page (\d+)\s*$"
SENTENCE = r"(?<=[.!?])\s+(?=[A-ZÀ-Ý])"


def stripped(c: Column) -> Column:
    """Without white space at the ends; trim() takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column, blank: str = r"(?U)\s") -> Column:
    return F.trim(F.regexp_replace(c, f"{blank}+", " "))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x else x)


def strip_tags(c: Column, blank: str = r"(?U)\s") -> Column:
    """Tags become blanks, runs of blanks one; entities are left (see unescape, named)."""
    return F.coalesce(squeeze(F.regexp_replace(c, r"<[^>]+>", " "), blank), F.lit(""))


def named(c: Column, entities: dict[str, str]) -> Column:
    """Only these entities decoded, one after the other, and only with their semicolon."""
    return reduce(lambda s, e: F.replace(s, F.lit(f"&{e[0]};"), F.lit(e[1])), entities.items(), c)


def html_text(c: Column) -> Column:
    """Text without tags; entities as HTML has them, an unfinished '&amp' too."""
    return strip_tags(unescape(c))


def article_slug(num: Column) -> Column:
    return F.lower(F.regexp_replace(num, r"[\s.]", ""))


def slug(c: Column, joiner: str = "_", fallback: str = "") -> Column:
    """A folded column's words, joined."""
    s = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def first_filled(*columns: Column) -> Column:
    """The first that isn't blank, trimmed; else ''."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def breadcrumb(precomputed: Column, titles: Column) -> Column:
    """The precomputed path, else the titles that aren't blank joined by ' > '."""
    return first_filled(precomputed, F.array_join(F.filter(titles, lambda t: F.trim(t) != ""), " > "))


def chunk_id(prefix: Column, num: Column, article_id: Column) -> Column:
    s = article_slug(num)
    return F.concat(prefix, F.when(F.coalesce(s, F.lit("")) == "", F.right(article_id, F.lit(10))).otherwise(s))


def pages(text: Column) -> Column:
    """array<struct<page, body>> of text cut at '## Page N'; one page 1 without heads; blank pages are dropped."""
    heads = F.regexp_extract_all(text, F.lit(PAGE_HEAD), F.lit(1))
    bodies = F.slice(F.split(text, PAGE_HEAD, -1), 2, F.greatest(F.size(heads), F.lit(1)))
    paged = F.zip_with(heads, bodies, lambda n, b: F.struct(n.cast("int").alias("page"), stripped(b).alias("body")))
    whole = F.array(F.struct(F.lit(1).alias("page"), stripped(text).alias("body")))
    return F.filter(F.when(F.size(heads) > 0, paged).otherwise(whole), lambda p: F.regexp_replace(p["body"], r"\s", "") != "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE)


def words_of(text: str, size: int) -> list[str]:
    """Pieces below `size` characters that end at a blank; the last may have `size`; a longer word is a piece of its own."""
    piece = rf"(?s).{{1,{size}}}\Z|.{{1,{size - 1}}}(?= )|.{{{size},}}?(?= |\Z)"
    return [p for p in map(str.strip, re.findall(piece, text)) if p]


def sentences_of(text: str, size: int) -> list[str]:
    return re.split(SENTENCE, text)


def paragraphs_of(text: str, size: int) -> list[str]:
    return [p for p in map(str.strip, re.split(r"\n\s*\n", text)) if p]


def units_of(text: str, size: int, splitters=(paragraphs_of, sentences_of, words_of)) -> Iterator[str]:
    """The text's parts by the first splitter; a part that is still too long by the next ones."""
    split, *finer = splitters
    for part in split(text, size):
        yield from units_of(part, size, finer) if finer and len(part) > size else [part]


def chunks_of(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """A page in chunks: whole if it fits; else paragraphs, sentences of what is too long, words of what still is, packed greedily.

    Each chunk after the first begins with the last `overlap` characters of the one before, from their first blank on.
    """
    text = text.strip()
    if len(text) <= target:
        return [text] if text else []

    def added(chunks: list[str], unit: str) -> list[str]:
        *closed, now = chunks
        if len(now) + len(unit) + 2 <= target:
            return [*closed, f"{now}\n\n{unit}"]
        repeated = now[-overlap:].partition(" ")[2]
        return [*chunks, f"{repeated}\n\n{unit}" if repeated else unit]

    first, *rest = units_of(text, target)
    return reduce(added, rest, [first])


@F.pandas_udf(ArrayType(StringType()))
def chunks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: chunks_of(x) if x else [])


@F.udtf(returnType=StructType([StructField("position", IntegerType()), StructField("chunk", StringType())]))
class ChunkText:
    """SELECT ... FROM t, LATERAL chunk_text(t.texte)"""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks_of(text or ""), 1)


def around(text: Column, quote: Column, window: int = WINDOW) -> Column:
    """Half a window either side of the quote: found as it stands, else by its first 40 characters with any blanks; else the head."""
    body, half = F.coalesce(text, F.lit("")), window // 2
    asked = F.coalesce(quote, F.lit(""))
    words = F.filter(F.split(F.left(asked, F.lit(40)), r"(?U)\s+"), lambda w: w != "")
    literal = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?U)"), F.array_join(literal, "\\s+"))
    exact, loose = F.position(asked, body), F.regexp_substr(body, pattern)
    at = F.when(asked == "", 0).when(exact > 0, exact).when(F.size(words) > 0, F.coalesce(F.position(loose, body), F.lit(0))).otherwise(0)
    size = F.when(exact > 0, F.length(asked)).otherwise(F.length(loose))
    start = F.greatest(at - 1 - half, F.lit(0))
    return F.when(at > 0, F.substring(body, start + 1, at - 1 + size + half - start)).otherwise(F.left(body, F.lit(window)))


def near_keywords(lines: Column, keywords: list[str], radius: int = 6, windows: int = 2, head: int = 20) -> Column:
    """The lines around the first ones that hold a keyword (lower case), `radius` either way, at most `windows` stretches that
    don't overlap, with '...' between; the first `head` lines if none holds one."""
    size = F.size(lines)
    hit = lambda x: F.greatest(*[F.contains(F.lower(x), F.lit(k)) for k in keywords], F.lit(False))
    at = F.filter(F.transform(lines, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())
    # greedy: a hit whose window would overlap the last one taken is passed over
    taken = F.aggregate(at, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) < windows) & ((F.size(acc) == 0) | (i - radius > F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + radius)), F.concat(acc, F.array(i))).otherwise(acc))
    cut = F.transform(taken, lambda i, k: F.concat(F.when(k > 0, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")), F.slice(lines, F.greatest(i - radius, F.lit(0)) + 1, F.least(i + radius + 1, size) - F.greatest(i - radius, F.lit(0)))))
    return F.when(F.size(at) > 0, F.flatten(cut)).otherwise(F.slice(lines, 1, head))


def doc_ids_in(prose: Column) -> Column:
    """Distinct document ids (slugs joined by a double underscore) in folded prose, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(prose, F.lit(r"[a-z0-9][a-z0-9_]*__[a-z0-9_]+"), F.lit(0))))


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression."""
    return "^" + "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c)) for c in glob) + "$"


def glob_column(glob: Column) -> Column:
    literal = F.regexp_replace(glob, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(literal, r"\*", "(?s:.*)"), r"\?(?!s:)", "(?s:.)"), F.lit("$"))


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…"))).otherwise(c)


def euros(c: Column) -> Column:
    return F.concat(F.replace(F.format_number(c, 2), F.lit(","), F.lit(" ")), F.lit(" €"))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def template(text: Column, **values: Column) -> Column:
    """The text with each {name} replaced; other braces stay."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def whole_words(mapping: dict[str, str]) -> F.Column:
    """A column function that replaces folded whole words and phrases, longest first, and leaves the rest as written."""
    keys = sorted({folded(k): v for k, v in mapping.items() if folded(k)}.items(), key=lambda x: (-len(x[0]), x[0]))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(k) for k, _ in keys) + r")(?!\w)") if keys else None
    values = dict(keys)
    seen: dict[str, str] = {}  # folded characters; text has few different ones

    def one(s: str | None) -> str | None:
        if not s or pattern is None:
            return s
        plain, origin = [], []
        for i, c in enumerate(s):
            f = seen.get(c)
            if f is None:
                f = seen[c] = folded(c) or (" " if c.isspace() else "")
            if f == " " and plain[-1:] == [" "]:
                continue
            for x in f:
                plain.append(x)
                origin.append(i)
        out, at = [], 0
        for m in pattern.finditer("".join(plain)):
            start, stop = origin[m.start()], origin[m.end() - 1] + 1
            if start >= at:
                out += [s[at:start], values[m[0]]]
                at = stop
        return "".join([*out, s[at:]])

    return F.pandas_udf(lambda s: s.map(one), StringType())
