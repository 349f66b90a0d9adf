"""File registry: revisions, fingerprints, heads, keyword search, folders, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The known formats in their order (the first wins ties), their domains and marker words.
FORMATS = (
    ("skin_stringer_fem", "structural.skin_stringer", ("ms_summary", "stringerfemloads", "skin_flows", "aux_skin_input", "aux_stringer_input", "stringer", "skin", "buckling", "crippling")),
    ("stringer_fem_loads", "structural.stringer", ("bay id", "fem load case", "nx", "nxy", "msstr_buck")),
    ("rivet_joint", "fastener.rivet", ("rivet", "bacr15fv", "shear", "pitch", "rivet diameter")),
    ("bolt_joint", "fastener.bolt", ("bolt", "torque", "preload", "bolt diameter", "shank")),
    ("frame_section", "structural.frame", ("frame", "station", "moment of inertia", "bending")),
    ("panel_buckling", "structural.panel", ("panel", "buckling", "sigma_cr", "kc")),
)


def markers(spark, schemas=tuple((name, ",".join(words)) for name, _, words in FORMATS)) -> DataFrame:
    """The marker table (ord, format_type, marker); users may bring their own."""
    rows = [(i, name, word) for i, (name, words) in enumerate(schemas) for word in words.split(",")]
    return spark.createDataFrame(rows, "ord int, format_type string, marker string")


def domain(format_type: Column) -> Column:
    """Domain of a known format, else null."""
    out = F.lit(None).cast("string")
    for name, of, _ in reversed(FORMATS):
        out = F.when(format_type == name, of).otherwise(out)
    return out


def classify(texts: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """(key, format_type, hits): the format whose markers occur most often in each text.

    The marker table is a dimension of a few dozen rows; it is read once and its
    formats become columns, so that texts are neither multiplied nor shuffled.
    """
    formats = [(r.ord, r.format_type, r.words) for r in table.groupBy("ord", "format_type").agg(F.sort_array(F.collect_list("marker")).alias("words")).orderBy("ord").collect()]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = [sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) for _, _, words in formats]
    counted = texts.select(key, *(h.alias(f"h{i}") for i, h in enumerate(hits)))
    best = F.greatest(*(F.col(f"h{i}") for i in range(len(hits)))) if len(hits) > 1 else F.col("h0")
    name = F.lit("unknown")
    for i, (_, format_type, _) in reversed(list(enumerate(formats))):
        name = F.when((F.col(f"h{i}") == best) & (best > 0), format_type).otherwise(name)
    return counted.select(key, name.alias("format_type"), best.alias("hits"))


def revision_rank(name: Column) -> Column:
    """Rank of the last revision token in a file name: rev_c, revG1, v2, R3; null if there is none.

    Letters count in base 26 and digits after letters in thousandths, so that
    RevG < RevG1 < RevH.
    """
    tokens = F.split(F.lower(F.regexp_replace(name, r"\.[^./]*$", "")), r"[_\-. ()]+")
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    numbers = F.regexp_extract_all(joined, F.lit(r"(?<= )(?:rev ?[a-z]{1,2}\d*|rev ?\d+|[vr]\d+)(?= )"), F.lit(0))
    last = F.element_at(numbers, -1)
    body = F.regexp_replace(last, r"^(rev ?|[vr](?=\d))", "")
    letters = F.regexp_extract(body, r"^([a-z]*)", 1)
    digits = F.regexp_extract(body, r"(\d*)$", 1)
    value = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a * 26 + (F.ascii(c) - 96))
    number = F.when(digits == "", F.lit(0.0)).otherwise(digits.cast("double"))
    return F.when(F.size(numbers) > 0, F.when(letters == "", number).otherwise(value + number / 1000))


def config_key(name: Column) -> Column:
    """File name without its extension and revision tokens."""
    stem = F.lower(F.regexp_replace(name, r"\.[^./]*$", ""))
    return F.regexp_replace(F.regexp_replace(stem, r"(?<=^|[_\-. ()])(rev[_\-. ]?[a-z]{1,2}\d*|rev[_\-. ]?\d+|[vr]\d+)(?=$|[_\-. ()])", ""), r"[_\-. ()]+$", "")


def heads(files: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Add version_index (0 is newest), is_head and version_group. ``order`` must break all ties."""
    index = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return files.withColumn("version_index", index).withColumn("is_head", F.col("version_index") == 0).withColumn("version_group", F.concat(F.lit("vg_"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12)))


def search(files: DataFrame, query: str, fields: list[str], title: str, bonus: Column, newest: list[Column], limit: int = 10) -> DataFrame:
    """Rows that hold every word of the query in any field, best first.

    A word in the title scores 3 and elsewhere 1; ``bonus`` is added. Only the
    best ``limit`` rows of each task are sorted and shuffled.
    """
    import re

    words = [w for w in re.split(r"[ _\-.,]+", query.lower()) if w]
    if not words:
        return files.limit(0).withColumn("score", F.lit(0).cast("double"))
    whole = F.lower(F.concat_ws(" ", *fields))
    name = F.lower(F.coalesce(F.col(title), F.lit("")))
    hit = F.lit(True)
    points = F.lit(0)
    for w in words:
        hit &= F.contains(whole, F.lit(w))
        points = points + F.when(F.contains(name, F.lit(w)), 3).otherwise(1)
    return files.where(hit).withColumn("score", (points + bonus).cast("double")).orderBy(F.desc("score"), *newest).limit(limit)


def folders(paths: DataFrame, path: str) -> DataFrame:
    """(rel, parent, name, depth, n_files) of every folder above the paths, root as empty string."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    seen = paths.where(F.col(path).isNotNull()).select(F.explode(above).alias("rel"))
    counted = seen.groupBy("rel").agg(F.count("*").alias("n_files"))
    last = F.element_at(F.split("rel", "/"), -1)
    depth = F.when(F.col("rel") == "", 0).otherwise(F.size(F.split("rel", "/")))
    parent = F.when(F.col("rel") == "", F.lit(None)).otherwise(F.array_join(F.slice(F.split("rel", "/"), F.lit(1), depth - 1), "/"))
    return counted.select("rel", parent.alias("parent"), last.alias("name"), depth.alias("depth"), "n_files")


def tokens_of(text: Column) -> Column:
    """Printable runs of two characters or more, without markup."""
    plain = F.regexp_replace(F.regexp_replace(text, "\x00", ""), r"<[^>]*>", " ")
    return F.regexp_extract_all(plain, F.lit(r"[\x21-\x7E]{2,}"), F.lit(0))


def structural_signature(tokens: Column) -> Column:
    """Hash of the number and the sorted set of different tokens."""
    unique = F.array_sort(F.array_distinct(tokens))
    return F.sha2(F.concat(F.lit("n:"), F.size(unique).cast("string"), F.lit("|"), F.array_join(unique, ",")), 256)


def content_id(prefix: str, content: Column, digits: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(content, 256), 1, digits))


def ingest(batch: DataFrame, known: DataFrame, content: str, key: str) -> DataFrame:
    """New rows of a content-addressed table: unseen contents, with the key's next versions."""
    named = batch.withColumn("id", content_id("art_", F.col(content))).dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
    highest = known.groupBy(key).agg(F.max("version").alias("_highest"))
    step = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return named.join(highest, key, "left").withColumn("version", F.coalesce("_highest", F.lit(0)) + step).drop("_highest")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Last write wins: one row for each key."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def unseen(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are new or changed since the last snapshot."""
    return now.join(before.select(*keys), keys, "left_anti")


def by_format(files: DataFrame, format_type: str, covered: str) -> DataFrame:
    """(format, files, coverage_pct): files of each format, and how many of them in a hundred are covered."""
    return files.groupBy(format_type).agg(F.count("*").alias("files"), (100.0 * F.count_if(covered) / F.count("*")).alias("coverage_pct"))


def overridden(given: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """Given bounds of parameters, replaced as a whole where measured ones are there."""
    own = measured.select(*keys, F.struct("lo", "hi").alias("_m"))
    both = given.join(own, keys, "left")
    pick = lambda c: F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, pick("lo"), pick("hi"), F.col("_m").isNotNull().alias("measured"))
