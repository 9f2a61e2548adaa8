"""Searching texts for many phrases at once, and replacing them: a trie of tokens, or a join on each phrase's rarest word.

Phrases and texts are folded (accents and case dropped) and cut into tokens: runs of letters a-z and digits, runs of white
space, and each other character by itself. A phrase occurs where its tokens stand in a row and no letter or digit touches its
ends; any white space stands for any.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

TOKEN = re.compile(r"[a-z0-9]+|\s+|[^a-z0-9]")
#: Characters of all phrases together up to which each task gets them all; beyond, texts and phrases are joined.
MOST_CHARS = 4_000_000


class _Folds(dict):
    """Folded characters by code point; `odd`: those that don't fold to exactly one."""

    odd = False

    def __missing__(self, code: int) -> str:
        out = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn").lower()
        self.odd = self.odd or len(out) != 1
        self[code] = out
        return out


_FOLDS = _Folds()


def fold_marks(s: str | None) -> str:
    """Without accents, lower case; blanks and apostrophes as they are. '' for null."""
    return (s or "").translate(_FOLDS)


def fold_with_places(s: str) -> tuple[str, list[int] | None]:
    """The folded text and each of its characters' place in s; None if they are the same."""
    out = s.translate(_FOLDS)
    if not _FOLDS.odd or s.isascii():
        return out, None
    places = [i for i, c in enumerate(s) for _ in _FOLDS[ord(c)]]
    return out, places if len(places) != len(s) or places != list(range(len(s))) else None


def evened(s: str | None) -> str:
    """A phrase as it is looked for: folded, each white space one blank, none at the ends."""
    return " ".join(fold_marks(s).split())


class Trie:
    """Phrases (evened) by their tokens."""

    def __init__(self, phrases: list[str]):
        self.root: dict = {}
        for p in phrases:
            node = self.root
            for t in TOKEN.findall(p):
                node = node.setdefault(t, {})
            if p:
                node[None] = p

    def places(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, phrase) of every occurrence in a folded text, by start."""
        root, last = self.root, ""
        for m in TOKEN.finditer(text):
            token, start = m[0], m.start()
            node = root.get(token)
            before, last = last, token
            if node is None or (before.isalnum() and before.isascii() and not (token.isalnum() and token.isascii())):
                continue  # a phrase that begins with a mark may not follow a letter
            at = m.end()
            while True:
                found = node.get(None)
                if found is not None:
                    if not (text[at : at + 1].isalnum() and text[at : at + 1].isascii()):
                        yield start, at, found
                ahead = TOKEN.match(text, at)
                node = node.get(" " if ahead[0].isspace() else ahead[0]) if ahead else None
                if node is None:
                    break
                at = ahead.end()

    def found(self, text: str) -> list[str]:
        return sorted({p for _, _, p in self.places(fold_marks(text))})

    def replaced(self, text: str, values: dict[str, str]) -> str:
        """The text with each phrase's value for it: longer phrases first wherever they stand, then from the left."""
        plain, origin = fold_with_places(text)
        taken = bytearray(len(plain))
        spans = []
        for start, end, phrase in sorted(self.places(plain), key=lambda x: (-len(x[2]), x[2], x[0])):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                spans.append((start, end, phrase))
        out, at = [], 0
        for start, end, phrase in sorted(spans):
            a, b = (start, end) if origin is None else (origin[start], origin[end - 1] + 1)
            while origin is not None and b < len(text) and not _FOLDS[ord(text[b])]:
                b += 1  # marks of the last letter go with it
            if a >= at:
                out += [text[at:a], values[phrase]]
                at = b
        return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def evened_phrase(s: pd.Series) -> pd.Series:
    return s.map(evened)


@F.pandas_udf(ArrayType(StringType()))
def words_of(s: pd.Series) -> pd.Series:
    """A text's different words, folded."""
    return s.map(lambda x: list(set(re.findall("[a-z0-9]+", fold_marks(x)))))


def checked(phrases: DataFrame, key: str) -> DataFrame:
    """Different folded phrases with a letter or digit; others name nothing."""
    return phrases.select(evened_phrase(F.col(key)).alias("phrase")).filter(F.col("phrase").rlike("[a-z0-9]")).distinct()


def small(phrases: DataFrame) -> list[str] | None:
    """The phrases, if together they are short enough for every task to hold; their size is measured first."""
    size = phrases.agg(F.coalesce(F.sum(F.length("phrase") + 8), F.lit(0)).alias("n")).first()["n"]
    return [r.phrase for r in phrases.collect()] if size <= MOST_CHARS else None


def candidates(docs: DataFrame, phrases: DataFrame, doc: str, body: str) -> DataFrame:
    """(doc, phrase) where the text has the phrase's rarest word.

    Rarest by the number of texts; only words of phrases are counted, and a phrase whose rarest word no text has goes at once.
    """
    own = phrases.select("phrase", F.explode(F.array_distinct(F.regexp_extract_all("phrase", F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    held = docs.select(doc, F.explode(words_of(F.col(body))).alias("word"))
    counts = held.join(own.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(counts, "word", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"))
    return held.join(rarest.filter("r.n > 0").select(F.col("r.word").alias("word"), "phrase"), "word").select(doc, "phrase").distinct()


def occurring(docs: DataFrame, phrases: DataFrame, doc: str = "doc_id", body: str = "body", key: str = "needle") -> DataFrame:
    """(doc, key) for each row and different phrase that stands in its text. A null text has none.

    Up to MOST_CHARS of phrases go to every task as a trie and the texts are read in place. More are joined to the texts by
    their rarest word, and what meets is looked for in the text.
    """
    wanted = checked(phrases, key)
    few = small(wanted)
    if few is not None:
        sent = docs.sparkSession.sparkContext.broadcast(few)
        made: dict[int, Trie] = {}

        def scan(s: pd.Series) -> pd.Series:
            trie = made.get(0) or made.setdefault(0, Trie(sent.value))
            return s.map(lambda x: trie.found(x) if x else [])

        return docs.select(doc, F.explode(F.pandas_udf(scan, ArrayType(StringType()))(F.col(body))).alias(key))
    asked = candidates(docs, wanted, doc, body).groupBy(doc).agg(F.collect_list("phrase").alias("__phrases"))
    check = F.pandas_udf(lambda s, p: pd.Series([Trie(list(y)).found(x) for x, y in zip(s, p, strict=True)]), ArrayType(StringType()))
    return docs.select(doc, body).join(asked, doc).select(doc, F.explode(check(F.col(body), F.col("__phrases"))).alias(key))


def replaced(docs: DataFrame, mapping: DataFrame, doc: str = "doc_id", body: str = "body") -> DataFrame:
    """docs with each phrase of the mapping (key, value) in the body replaced; of several values of a folded key the least.

    The mapping isn't collected unless it is short (MOST_CHARS); else each text gets the entries whose rarest word it has.
    """
    folded = mapping.select(evened_phrase(F.col("key")).alias("phrase"), F.coalesce("value", F.lit("")).alias("value")).filter(F.col("phrase").rlike("[a-z0-9]"))
    entries = folded.groupBy("phrase").agg(F.min("value").alias("value"))
    size = entries.agg(F.coalesce(F.sum(F.length("phrase") + F.length("value") + 8), F.lit(0)).alias("n")).first()["n"]
    if size <= MOST_CHARS:
        sent = docs.sparkSession.sparkContext.broadcast({r.phrase: r.value for r in entries.collect()})
        made: dict[int, Trie] = {}

        def swap(s: pd.Series) -> pd.Series:
            trie = made.get(0) or made.setdefault(0, Trie(list(sent.value)))
            return s.map(lambda x: trie.replaced(x, sent.value) if x else x)

        return docs.withColumn(body, F.pandas_udf(swap, StringType())(F.col(body)))
    own = candidates(docs, entries.select("phrase"), doc, body).join(entries, "phrase").groupBy(F.col(doc).alias("__doc")).agg(F.collect_list("phrase").alias("__p"), F.collect_list(F.struct("phrase", "value")).alias("__e"))

    def swap_own(s: pd.Series, entries: pd.Series) -> pd.Series:
        maps = [{e["phrase"]: e["value"] for e in x} if x is not None else {} for x in entries]
        return pd.Series([Trie(list(m)).replaced(x, m) if x and m else x for x, m in zip(s, maps, strict=True)], dtype=object)

    both = docs.join(own.drop("__p"), F.col(doc) == F.col("__doc"), "left")
    return both.withColumn(body, F.pandas_udf(swap_own, StringType())(F.col(body), F.col("__e"))).select(*docs.columns)
