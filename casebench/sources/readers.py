"""Scans: CSV, JSON, JSON lines, pages, chunk files, documents by content hash, catalogues."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, StringType

from casebench.functions import scalars, text
from casebench.schemas import CHUNK_FIELDS
from casebench.session import shared_dir

#: Articles in force.
IN_FORCE = ("VIGUEUR", "VIGUEUR_DIFF")
# Keys below which a body holds what belongs to other texts, and the forms of ids.
REFERENCE_KEYS = ("articleVersions", "lienCitations", "lienModifications", "lienConcordes", "lienAutres", "versionPrecedente", "textTitles", "context", "titreTxt")
ARTICLE_ID, SECTION_ID = r"^LEGIARTI\d{12}$", r"^LEGISCTA\d{12}$"
#: Levels of a tree that one pass over a table goes down.
LEVELS = 64


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings; the empty string, quoted or not, is what a missing value is."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE").na.fill("")


def read_chunk_files(spark: SparkSession, paths: list[str], columns: list[str] = CHUNK_FIELDS) -> DataFrame:
    """The union of per-case files on `columns`, '' where a file lacks one; files without a header line are skipped."""
    empty = spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
    read = [df for p in paths if (df := spark.read.csv(p, header=True, multiLine=True, escape='"')).columns]
    parts = [df.select([c for c in columns if c in df.columns]) for df in read]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty).na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines). strict raises on the first malformed line when it is read."""
    if strict:
        rows = spark.read.schema(schema).json(path, mode="FAILFAST")
        return rows, spark.createDataFrame([], "line string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    wide = StructType([*schema.fields, StructField("__bad", StringType())])
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull()
    return parsed.filter(~bad).select(*[F.col(f"r.{f.name}") for f in schema.fields]), parsed.filter(bad).select(F.col("value").alias("line"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Raw article files, one JSON object each: source key (the folder), file name, VARIANT body; malformed files have a null body."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("path"))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("source_key"), F.element_at(parts, -1).alias("file"), F.try_parse_json("value").alias("body"))


def _field(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, f"$.{path}", kind)


def article_rows(raw: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Article rows of raw (source_key, file, body) with `dropped`: null, malformed, non_vigueur or empty.

    A court decision (text.id begins JURITEXT) becomes a row with its first case number and formation. A row not in force
    counts as non_vigueur, whatever its text; so does one with no text and a state other than VIGUEUR.
    """
    b = F.col("body")
    label = F.create_map(*[F.lit(x) for kv in (labels or {"": ""}).items() for x in kv])[F.col("source_key")]
    decision = F.coalesce(_field(b, "text.id"), F.lit("")).startswith("JURITEXT")
    get = lambda name, other: F.coalesce(F.when(decision, _field(b, other)).otherwise(_field(b, name)), F.lit(""))
    titles = F.from_json(F.coalesce(_field(b, "context.titresTM"), F.lit("[]")), "array<struct<titre:string>>")
    state = F.when(decision, F.lit("VIGUEUR")).otherwise(F.coalesce(_field(b, "etat"), F.lit("")))
    body = text.html_text(get("texte", "text.texte"))
    num, ident = get("num", "text.numeroAffaire[0]"), get("id", "text.id")
    out = raw.select(
        text.chunk_id(F.concat(F.col("source_key"), F.lit("-")), num, ident).alias("chunk_id"), F.col("source_key").alias("source"), F.coalesce(label, "source_key").alias("source_label"), num.alias("num"),
        F.when(decision, F.coalesce(_field(b, "text.formation"), F.lit(""))).otherwise(text.breadcrumb(text.unescape(F.coalesce(_field(b, "fullSectionsTitre"), F.lit(""))), F.transform(titles, lambda t: t["titre"]))).alias("section_path"),
        get("titre", "text.titre").alias("titre"), body.alias("texte"), state.alias("etat"),
        scalars.epoch_ms_date(F.when(decision, _field(b, "text.dateTexte", "long")).otherwise(_field(b, "dateDebut", "long"))).alias("date_debut"),
        scalars.epoch_ms_date(_field(b, "dateFin", "long")).alias("date_fin"), ident.alias("legiarti_id"), F.lit("").alias("url"), F.col("body").isNull().alias("__bad"))
    kept = F.col("etat").isin("", *IN_FORCE)
    dropped = F.when(F.col("__bad"), "malformed").when(~kept, "non_vigueur").when((F.col("texte") == "") & ~F.col("etat").isin("", "VIGUEUR"), "non_vigueur").when(F.col("texte") == "", "empty")
    return out.withColumn("dropped", dropped).drop("__bad")


def section_articles(sections: DataFrame, root: str, depth: int = 8) -> DataFrame:
    """(article_id, position) under a section, in order of visit, each once; sections: parent, child, kind, position.

    A walk level by level: `depth` joins at most, ended early when a level is empty.
    """
    spark = sections.sparkSession
    level = spark.createDataFrame([(root, "")], "node string, path string")
    seen, found = level.select("node"), None
    for _ in range(depth):
        below = sections.join(level, sections.parent == level.node).select("child", "kind", F.concat("path", F.lpad(F.col("position").cast("string"), 8, "0")).alias("path"))
        articles = below.filter("kind = 'article'").select(F.col("child").alias("article_id"), "path")
        found = articles if found is None else found.unionByName(articles)
        level = below.filter("kind = 'section'").select(F.col("child").alias("node"), "path").join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("node"))
    return found.groupBy("article_id").agg(F.min("path").alias("position"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, body) of markdown files, the doc_id being the file's stem."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("doc_id"), "value")
    return files.select("doc_id", F.explode(text.pages(F.col("value"))).alias("p")).select("doc_id", "p.page", "p.body")


def changed_documents(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(doc_id, path, sha256, content) of files whose content hash isn't in known (doc_id, sha256); a doc_id twice raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(doc_id(F.col("path")).alias("doc_id"), "path", F.sha2("content", 256).alias("sha256"), "content")
    twice = [r.doc_id for r in named.groupBy("doc_id").count().filter("count > 1").limit(20).collect()]
    if twice:
        raise ValueError(f"several files give doc_id {sorted(twice)}")
    return named.join(known.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")


def doc_id(path: Column) -> Column:
    """The slugs of the path below its last folder `raw`, joined by '__'."""
    below = F.regexp_replace(F.regexp_replace(path, "^.*/raw/", ""), r"\.[^./]+$", "")
    return F.array_join(F.transform(F.split(below, "/"), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")), "__")


def text_layer(pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, has_text): whether every page (doc_id, page, body) has more than `least` characters; else it is for vision."""
    return pages.groupBy("doc_id").agg(F.bool_and(F.length(F.trim("body")) > least).alias("has_text"))


def read_sources(spark: SparkSession, path: str, skip: tuple[str, ...] = ("/.git/", "/__pycache__/", "/.venv/")) -> DataFrame:
    """(file, source) of Python files, by path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("source"))
    for part in skip:
        files = files.filter(~F.contains("file", F.lit(part)))
    return files.orderBy("file")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source_key, label, fetch_strategy) from a YAML map; a few rows, read on the driver."""
    import yaml

    entries = yaml.safe_load(Path(path).read_text())
    return spark.createDataFrame([(k, v.get("label", k), v.get("fetch_strategy", "section")) for k, v in (entries.get("sources") or entries).items()], "source_key string, label string, fetch_strategy string")


def _falls(node: Column, skip: tuple[str, ...]) -> Column:
    """The values that a VARIANT node holds, but not those of skipped keys; none of a leaf."""
    fields = F.map_values(F.map_filter(F.try_variant_get(node, "$", "map<string,variant>"), lambda k, _: ~k.isin(*skip)))
    return F.coalesce(fields, F.try_variant_get(node, "$", "array<variant>"), F.array().cast("array<variant>"))


def objects(trees: DataFrame, read: Callable[[Column], Column], skip: tuple[str, ...] = REFERENCE_KEYS) -> DataFrame:
    """trees (tree VARIANT, more) with `found`: read(object) of every JSON object at any depth, but for those below skipped keys.

    A level at a time, inside the JVM and without a shuffle; what is found is written to the shared folder. Trees deeper than
    LEVELS go on in another pass over them alone. A null or malformed tree has none. An object's order isn't kept.
    """
    spark, root = trees.sparkSession, f"{shared_dir(trees.sparkSession)}/objects-{uuid.uuid4().hex}"
    carried = [c for c in trees.columns if c != "tree"]
    array = lambda x: F.filter(x, lambda v: v.isNotNull())
    start = F.when(F.col("tree").isNotNull(), F.array("tree")).otherwise(F.array().cast("array<variant>"))
    rows, done = trees.select(*carried, start.alias("__front")), None

    def of(front: Column) -> Column:
        return F.transform(F.filter(front, lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()), read)

    for turn in itertools.count():
        none = F.filter(of(F.col("__front")), lambda _: F.lit(False))
        down = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.struct(array(F.col("__front")).alias("front"), none.alias("found")), lambda acc, _: F.struct(array(F.flatten(F.transform(acc["front"], lambda v: _falls(v, skip)))).alias("front"), F.concat(acc["found"], of(acc["front"])).alias("found")))
        rows.select(*carried, down.alias("__d")).select(*carried, "__d.found", F.col("__d.front").alias("__front")).write.parquet(f"{root}/{turn}")
        level = spark.read.parquet(f"{root}/{turn}")
        found = level.select(*carried, "found")
        done = found if done is None else done.unionByName(found)
        rows = level.filter(F.size("__front") > 0).drop("found")
        if rows.isEmpty():
            return done


def _said(node: Column, field: str) -> Column:
    """A field's text, null where Python would call it false."""
    said = F.try_variant_get(node, f"$.{field}", "string")
    return F.when(~said.isin("", "0", "false", "[]", "{}"), said)


def collected_ids(bodies: DataFrame, *carried: str) -> DataFrame:
    """(carried, kind, id), each once, of the objects in JSON bodies (column body, a string) that are articles in force or sections.

    An object's id is its field id, else cid; its state is etat, and one without that field is in force. Below keys that hold
    references nothing counts. Malformed bodies have none.
    """
    def read(node: Column) -> Column:
        etat = F.try_variant_get(node, "$.etat", "variant")
        return F.struct(F.coalesce(_said(node, "id"), _said(node, "cid")).alias("id"), (etat.isNull() | F.coalesce(F.try_variant_get(node, "$.etat", "string").isin("", *IN_FORCE), F.lit(False))).alias("in_force"))

    found = objects(bodies.select(*carried, F.try_parse_json("body").alias("tree")), read)
    each = found.select(*carried, F.explode("found").alias("o"))
    kind = F.when(F.col("o.id").rlike(ARTICLE_ID) & F.col("o.in_force"), "article").when(F.col("o.id").rlike(SECTION_ID), "section")
    return each.select(*carried, kind.alias("kind"), F.col("o.id").alias("id")).filter(F.col("kind").isNotNull()).distinct()
