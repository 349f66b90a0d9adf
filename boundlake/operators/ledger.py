"""Documents and logs of the registry: lookups, lists, status changes, views and exports.

Collections are tables with one row for each version of a document; the newest
row by ``seq`` stands. Nothing here rewrites a table: a change of status gives
the rows to append.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stores import checkpointed
from . import registry
from . import verdict as v

#: Roles that may approve a fix.
APPROVERS = ("reviewer", "admin")


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The document with an id: one row, or none if it is absent."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def of_folder(files: DataFrame, folder: int, key: str = "folder_id") -> DataFrame:
    """Files of a folder; -1 stands for all."""
    return files if folder == -1 else files.where(F.col(key) == folder)


def about(log: DataFrame, subject, key: str = "subject") -> DataFrame:
    """Entries of a log that concern a subject: audit entries, certificates of a type, signatures."""
    return log.where(F.col(key) == F.lit(subject))


def listed(rows: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """(position, json): the documents as JSON with fields by name and nulls written out, in order of ``order``."""
    return rows.select(F.col(order).alias("position"), F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("json")).orderBy("position")


def section_map(folders: DataFrame) -> DataFrame:
    """One section for each folder but the root, named by its path."""
    return folders.where(F.col("rel") != "").select(F.col("rel").alias("section_name"), registry.content_id("sec_", F.col("rel")).alias("folder_id"))


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of a dependency graph with ids as ``Sheet!A1``; rows and columns count from 0."""
    return nodes.select(cell_name(F.col("sheet"), F.col("row"), F.col("col")).alias("id"), "label", F.col("is_input").alias("input"))


def cell_name(sheet: Column, row: Column, col: Column) -> Column:
    """``Sheet!B7`` of a place; columns beyond Z take two or three letters."""
    letter = lambda n: F.chr((65 + n).cast("long"))
    two, three = col - 26, col - 702
    letters = (
        F.when(col < 26, letter(col))
        .when(col < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )
    return F.concat(sheet, F.lit("!"), letters, (row + 1).cast("string"))


def resolved(orders: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows to append for work orders that an engineer's fix resolves: (order_id, fix_id, status, seq).

    A patch without a fix id is named after its order; orders that are resolved
    already, or that do not exist, give no row.
    """
    open_ = orders.where(F.col("status") != "resolved").select("order_id", "seq")
    fix = F.coalesce("fix_id", F.concat(F.lit("fix_"), F.col("order_id").cast("string")))
    return open_.join(patches, "order_id").select("order_id", fix.alias("fix_id"), F.lit("resolved").alias("status"), (F.col("seq") + 1).alias("seq"))


def approvals(requests: DataFrame, users: DataFrame, fixes: DataFrame) -> DataFrame:
    """(fix_id, user_id, ok, error, status) of every request to approve a fix.

    The role is checked before the fix is looked up.
    """
    allowed = users.where(F.col("role").isin(*APPROVERS)).select("user_id").distinct().withColumn("_may", F.lit(True))
    known = fixes.select("fix_id").distinct().withColumn("_known", F.lit(True))
    both = requests.join(allowed, "user_id", "left").join(known, "fix_id", "left")
    error = F.when(F.col("_may").isNull(), "requires_reviewer_role").when(F.col("_known").isNull(), "fix_not_found")
    return both.select("fix_id", "user_id", error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), "approved").alias("status"))


def dependency_id(src: Column, dst: Column, symbol: Column) -> Column:
    """Key of an artifact dependency; adding the same one again changes nothing."""
    return F.substring(F.sha2(F.concat_ws("|", src, dst, symbol), 256), 1, 24)


def add_dependencies(known: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: dependencies whose key is new, each once."""
    keyed = new.withColumn("dep_id", dependency_id(F.col("src"), F.col("dst"), F.col("symbol")))
    return keyed.dropDuplicates(["dep_id"]).join(known.select("dep_id"), "dep_id", "left_anti")


def summary(cells: DataFrame, edges: DataFrame, conflicts: DataFrame, workbook: str) -> DataFrame:
    """Analysis of each workbook: cells, formulas, inputs, edges and gluing conflicts; a part without rows counts 0."""
    counted = cells.groupBy(workbook).agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"), F.count_if(F.col("formula").isNull()).alias("inputs"))
    out = counted.join(edges.groupBy(workbook).agg(F.count("*").alias("dep_edges")), workbook, "left").join(conflicts.groupBy(workbook).agg(F.count("*").alias("conflicts")), workbook, "left")
    return out.fillna(0, ["dep_edges", "conflicts"]).withColumn("glue_consistent", F.col("conflicts") == 0)


def section_files(files: DataFrame, events: DataFrame, folder: Column) -> DataFrame:
    """(section, n_files, domain, newest, priority): files by their folder, with the highest priority of its events.

    The domain is that of the file with the least name; no event gives -1.
    """
    by = files.withColumn("section", folder).groupBy("section").agg(F.count("*").alias("n_files"), F.min_by("domain", "name").alias("domain"), F.max("mtime").alias("newest"))
    worst = events.groupBy("section").agg(F.max("priority").alias("priority"))
    return by.join(worst, "section", "left").withColumn("priority", F.coalesce("priority", F.lit(-1)))


def by_change(deltas: DataFrame) -> DataFrame:
    """Differences of two runs, largest change of the score first; ties by cell."""
    return deltas.orderBy(F.desc(F.abs("delta_cs")), "cell")


def try_transfer(matches: DataFrame, evaluate, subject: Column) -> DataFrame:
    """Past fixes that make their case safe: boxes patched, evaluated again and certified.

    ``matches`` has the case's bounds as ``<sym>_lo`` and ``<sym>_hi`` and the fix's
    as ``fix_<sym>_lo`` and ``fix_<sym>_hi`` (null: not patched); ``evaluate``
    gives ``ms_lo``, ``ms_hi`` and ``residual``. Only valid certificates with
    the verdict SAFE stay. Certificates are checkpointed first: a filter pushed
    through them would repeat the program's text many times.
    """
    patched = {c.removeprefix("fix_"): F.coalesce(F.col(c), F.col(c.removeprefix("fix_"))) for c in matches.columns if c.startswith("fix_") and c.removeprefix("fix_") in matches.columns}
    certified = checkpointed(v.certify(evaluate(matches.withColumns(patched)), "case_transfer", subject))
    return certified.where(v.valid(subject) & (F.col("verdict") == "SAFE"))


def canonical_config(alpha: float, schema_version: str, thresholds: dict[str, float]) -> str:
    """Configuration as JSON with sorted thresholds and nine significant digits."""
    inner = ",".join(f'"{k}":{value:.9g}' for k, value in sorted(thresholds.items()))
    return f'{{"alpha":{alpha:.9g},"schema":"{schema_version}","thresholds":{{{inner}}}}}'


def config_hash(alpha: float, schema_version: str, thresholds: dict[str, float]) -> str:
    return hashlib.sha256(canonical_config(alpha, schema_version, thresholds).encode()).hexdigest()


def pending(available: DataFrame, applied: DataFrame, name: str = "name") -> DataFrame:
    """Migrations that have not been applied, by name."""
    return available.join(applied.select(name), name, "left_anti").orderBy(name)


def upserts(rows: DataFrame, table: str, key: str) -> DataFrame:
    """SQL text of every row: an insert that updates on conflict.

    Quotes in texts are doubled, nulls stay null, binaries are hexadecimal, NaN and
    infinities are quoted, arrays and structs are JSON texts; names are quoted where SQL asks for it.
    """
    plain = re.compile(r"[a-z_][a-z0-9_]*")
    named = lambda n: n if plain.fullmatch(n) else '"' + n.replace('"', '""') + '"'
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    names = rows.columns

    def literal(name: str, kind: str) -> Column:
        value = F.col("`" + name.replace("`", "``") + "`")
        text = value.cast("string")
        if kind == "binary":
            text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
        elif kind in ("double", "float"):
            text = F.when(F.isnan(value) | (F.abs(value) == float("inf")), quoted(text)).otherwise(text)
        elif kind.startswith(("array", "map", "struct")):
            text = quoted(F.to_json(value, {"ignoreNullFields": "false"}))
        elif not kind.startswith(("tinyint", "smallint", "int", "bigint", "decimal", "boolean")):
            text = quoted(text)
        return F.coalesce(text, F.lit("NULL"))

    values = F.concat_ws(", ", *(literal(*x) for x in rows.dtypes))
    updates = ", ".join(f"{named(n)} = EXCLUDED.{named(n)}" for n in names if n != key)
    conflict = f"DO UPDATE SET {updates}" if updates else "DO NOTHING"
    head, tail = f"INSERT INTO {table} ({', '.join(map(named, names))}) VALUES (", f") ON CONFLICT ({named(key)}) {conflict};"
    return rows.select(F.col("`" + key.replace("`", "``") + "`"), F.concat(F.lit(head), values, F.lit(tail)).alias("statement"))


def reports(targets: DataFrame, run: str) -> DataFrame:
    """(run, report): JSON of each run's number of targets and counts of verdicts."""
    is_ = lambda x: F.count_if(F.col("verdict") == x)
    counted = targets.groupBy(run).agg(F.count("*").alias("targets"), is_("SAFE").alias("safe"), is_("FAIL").alias("fail"), is_("ABSTAIN").alias("abstain"))
    return counted.select(run, F.to_json(F.struct("abstain", "fail", "safe", "targets")).alias("report"))


def target_reports(targets: DataFrame, run: list[str], trace: DataFrame | list[Column] | None = None) -> DataFrame:
    """(run, report): JSON of each certified target: verdict, bounds, residual, certificate, its leaf in the audit tree, regime and derivation.

    ``targets`` comes from :func:`verdict.certify`; ``trace`` (run, pos, node, op,
    lo, hi, holed) has one row for each node of a target's program. Where all
    targets have one program it may be a list instead, one struct (node, op, lo,
    hi, holed) of the target's columns for each node in order, which needs no
    join. Numbers that are not finite are texts, as JSON has none.
    """
    number = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
    escaped = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    text = lambda c: F.when(c.cast("string").rlike(r'[\x00-\x1f"\\]'), escaped(c.cast("string"))).otherwise(F.concat(F.lit('"'), c.cast("string"), F.lit('"')))
    sha = lambda c: F.concat(F.lit('"sha256:'), c, F.lit('"'))
    leaf = F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex("cert_hash")), 256)
    item = lambda of: F.concat(F.lit('{"encl":['), number(of("lo")), F.lit(","), number(of("hi")), F.lit('],"holed":'), F.coalesce(of("holed"), F.lit(False)).cast("string"), F.lit(',"node":'), text(of("node")), F.lit(',"op":'), text(of("op")), F.lit(',"width":'), number(of("hi") - of("lo")), F.lit("}"))
    steps = F.lit("[]")
    if trace is not None:
        if isinstance(trace, DataFrame):
            made = trace.withColumn("_item", item(F.col)).groupBy(*run).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_item"))), lambda x: x["_item"]).alias("_steps"))
            targets, items = targets.join(made, run, "left"), F.col("_steps")
        else:
            items = F.array(*(item(node.getField) for node in trace))
        steps = F.concat(F.lit("["), F.array_join(F.coalesce(items, F.array().cast("array<string>")), ","), F.lit("]"))
    report = F.concat(
        F.lit('{"audit_leaf":'), sha(leaf), F.lit(',"certificate_ref":'), sha(F.col("cert_hash")), F.lit(',"derivation":'), steps, F.lit(',"ms_enclosure":{"lower":'), number(F.col("ms_lo")), F.lit(',"upper":'), number(F.col("ms_hi")),
        F.lit('},"regime":'), text(F.col("regime")), F.lit(',"residual":'), number(F.col("residual")), F.lit(',"verdict":'), text(F.col("verdict")), F.lit("}"),
    )
    return targets.select(*run, report.alias("report"))


def diff_documents(deltas: DataFrame, holes: DataFrame | None = None, key: str = "cell") -> tuple[DataFrame, DataFrame]:
    """(head, lines) of a difference of two runs as JSON: one row of counts, and one row for each target and for each hole that opened or closed.

    ``holes`` has (id, change) with change ``new`` or ``closed``.
    """
    head = deltas.agg(F.count("*").alias("targets"), F.count_if(F.col("trend") == "improved").alias("improved"), F.count_if(F.col("trend") == "regressed").alias("regressed"))
    head = head.select(F.to_json(F.struct("improved", "regressed", (F.col("regressed") == 0).alias("safe"), "targets")).alias("document"))
    fields = sorted({key, "old_verdict", "new_verdict", "transition", "delta_cs", "old_cs", "new_cs"} & set(deltas.columns))
    lines = deltas.select(F.lit("target").alias("kind"), F.col(key).alias("id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))
    if holes is not None:
        lines = lines.unionByName(holes.select(F.concat("change", F.lit("_hole")).alias("kind"), "id", F.to_json(F.struct("id")).alias("document")))
    return head, lines


def proposals(fixes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows to append for fixes that are proposed (fix_id, description, patch): status ``proposed``, each id once; known ones keep their status."""
    return fixes.dropDuplicates(["fix_id"]).join(known.select("fix_id"), "fix_id", "left_anti").withColumn("status", F.lit("proposed"))
