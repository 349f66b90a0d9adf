"""Secret scan with DataFrame functions only: fixed patterns plus Markov models.

Two character Markov chains, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a long token is reported where
the mean log-likelihood ratio of its transitions exceeds a threshold.

Null text counts as empty (no spans). Empty table: no rows. Texts are scanned
whole; positions are code points, ends exclusive. Repeated rows are each
scanned. Other columns of the input never clash, as only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns and least lengths, as the contract gives them.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Tokens that the models judge: characters of keys, ids and encodings.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: Codes below 128; a table of transitions has one entry for each pair.
CODES = 128
#: Mean log-likelihood ratio per character above which a token is a secret.
THRESHOLD = 0.45

# Parts of ordinary identifiers, in four languages.
PARTS = (
    "account action address after agent amount answer array article author balance batch before border branch browser buffer "
    "button cache calendar call category channel character check child class client column command comment common company config "
    "connection container content context control copy count country create current customer data database date default delete "
    "description detail device dialog direction directory display document domain download element email enable entry error event "
    "example export factory field file filter first folder format frame function global group handler header height history image "
    "import index information input instance interface item label language layout length level library limit line list loader local "
    "location manager margin message method minimum model module name network number object option order output package page "
    "parameter parent parser password path pattern payment player position price print process product profile project property "
    "provider query queue reader record reference region register remote report request resource response result return rule sample "
    "schedule schema scope screen script search section select sequence server service session setting shape simple size source stack "
    "start state status step stream string style submit summary support switch symbol system table target template test text thread "
    "time title token total transaction transform translation type update upload user value variable vector version view visible "
    "weather widget width window worker write zone "
    "anfrage anwendung arbeit aufgabe benutzer bericht datei eigenschaft einstellung entwicklung ergebnis fenster gesellschaft "
    "geschichte haupt inhalt kunden leistung meldung nachricht rechnung schule sicherheit sprache stadt strasse verbindung verein "
    "versicherung verwaltung wissenschaft zeitung "
    "adresse bonjour chemin compte demande donnees ensemble fichier gestion journal livre maison nombre ouverture paiement personne "
    "produit question recherche reponse reseau securite semaine societe utilisateur valeur "
    "archivo ayuntamiento busqueda cantidad ciudad contrato cuenta direccion empresa fecha formulario gobierno historia idioma "
    "informacion mensaje nombre numero pagina persona pregunta proyecto respuesta sociedad trabajo usuario valor"
).split()


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(text, label) made by rule: 1 for random strings, 0 for ordinary identifiers."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 512)
    raw = F.base64(F.unhex(digest))
    length = (F.lit(24) + F.pmod(F.xxhash64("id"), F.lit(40))).cast("int")
    random = F.substring(
        F.when(i % 8 < 3, F.translate(raw, "+/=", "xYz"))
        .when(i % 8 == 3, raw)
        .when(i % 8 == 4, F.translate(raw, "+/=", "-_"))
        .when(i % 8 == 5, F.upper(F.translate(raw, "+/=", "xYz")))
        .when(i % 8 == 6, F.upper(digest))
        .otherwise(F.lower(F.translate(raw, "+/=", "xyz"))),
        F.lit(1),
        length,
    )
    words = F.array(*map(F.lit, PARTS))
    pick = lambda k: F.get(words, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(PARTS))).cast("int"))
    four = [pick(k) for k in range(4)]
    year = (F.lit(1950) + F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(90))).cast("string")
    small = F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(30)).cast("string")
    ordinary = (
        F.when(i % 9 == 0, F.concat_ws("_", *four))
        .when(i % 9 == 1, F.concat(four[0], *map(F.initcap, four[1:])))
        .when(i % 9 == 2, F.concat_ws("-", *four, year))
        .when(i % 9 == 3, F.upper(F.concat_ws("_", *four, small)))
        .when(i % 9 == 4, F.concat_ws("/", F.lit(""), *four))
        .when(i % 9 == 5, F.concat(*four))
        .when(i % 9 == 6, F.repeat(F.substring(F.lit("-=_/+0123456789xX"), 1 + F.pmod(i, F.lit(17)).cast("int"), F.lit(1)), 30))
        .when(i % 9 == 7, F.upper(F.concat(*four)))
        .otherwise(F.concat(F.initcap(four[0]), F.initcap(four[1]), year, F.lit("-"), small, F.lit("-"), small, F.lit("_"), four[2], small))
    )
    base = spark.range(n)
    return base.select(random.alias("text"), F.lit(1).alias("label")).unionByName(base.select(ordinary.alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, smoothing: float = 0.5, alphabet: int = 68) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each transition.

    Entry ``128 * previous + next``; previous 0 is the start. Only counts of
    transitions reach the driver, at most two for each entry of the table.
    Unseen transitions are smoothed; empty samples give a table of zeros.
    """
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    codes = F.filter(codes, lambda c: (c > 0) & (c < CODES))
    pairs = F.zip_with(F.slice(F.concat(F.array(F.lit(0)), codes), F.lit(1), F.size(codes)), codes, lambda a, b: a * CODES + b)
    seen = samples.where("text is not null").select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()
    counts = {0: {}, 1: {}}
    rows: dict[int, dict[int, float]] = {0: {}, 1: {}}
    for label, pair, n in seen:
        counts[label][pair] = n
        rows[label][pair // CODES] = rows[label].get(pair // CODES, 0) + n
    table = [0.0] * (CODES * CODES)
    if not seen:
        return table
    used = {0, *(p for label in (0, 1) for p in rows[label])} | {p % CODES for label in (0, 1) for p in counts[label]}
    for previous in used:
        for following in used - {0}:
            pair = previous * CODES + following
            logs = [math.log((counts[k].get(pair, 0) + smoothing) / (rows[k].get(previous, 0) + smoothing * alphabet)) for k in (0, 1)]
            table[pair] = logs[1] - logs[0]
    return table


_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _spans(text: Column, pattern: str, order: int, keep, least: str | None = None) -> Column:
    """Spans of a pattern's matches, leftmost and not overlapping.

    The lengths of the pieces between matches and of the matches add up to the
    positions. ``keep(match, extra)`` drops failing matches afterwards;
    ``extra`` is group ``least`` where one is named.
    """
    regex = F.lit(pattern)
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, regex, F.lit(0)))).alias("gap"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, regex, F.lit(int(least or 0))).alias("extra"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(KINDS[order]).alias("kind"))
        return F.struct(end.alias("at"), F.when(keep(x["hit"], x["extra"]), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


_TEXT, _BASE, _ALL = "__secret_text", "__secret_base", "__secret_spans"


def marked(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the text (empty for null), base and all spans under reserved names."""
    none = F.array().cast(_SPAN)
    ratios = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")

    def score(token: Column) -> Column:
        start = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("s"))
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
        total = F.aggregate(codes, start, lambda a, k: F.struct(k.alias("p"), (a["s"] + F.get(ratios, a["p"] * CODES + k)).alias("s")), lambda a: a["s"])
        return total / F.length(token)

    def where(pattern: str, spans: Column) -> Column:
        return F.when(F.col(_TEXT).rlike(pattern), spans).otherwise(none)

    text, long_value = F.col(_TEXT), ASSIGN.replace("+)", "{%d,})" % ASSIGN_VALUE)
    found = docs.withColumn(_TEXT, F.coalesce(F.col(text_col), F.lit(""))).withColumns(
        {
            "__secret_assign": where(long_value, _spans(text, ASSIGN, 0, lambda hit, value: F.length(value) >= ASSIGN_VALUE, "2")),
            "__secret_access": where(ACCESS, _spans(text, ACCESS, 1, lambda hit, _: F.lit(True))),
            "__secret_hex": where(HEX, _spans(text, HEX, 2, lambda hit, _: F.lit(True))),
            "__secret_random": where(TOKEN, _spans(text, TOKEN, 3, lambda hit, _: score(hit) > threshold)),
        }
    )
    random = F.col("__secret_random")
    fresh = F.filter(random, lambda r: ~F.exists(_BASE, lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    based = found.withColumn(_BASE, F.sort_array(F.concat("__secret_assign", "__secret_access", "__secret_hex")))
    return based.withColumn(_ALL, F.when(F.size(random) == 0, F.col(_BASE)).otherwise(F.sort_array(F.concat(_BASE, fresh)))).select(*(F.col(f"`{c}`") for c in docs.columns), _TEXT, _BASE, _ALL)


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, spans) of every row.

    ``base`` holds the spans of the fixed patterns by start and kind; ``spans``
    adds those of tokens that the models call random and that no base span
    covers already.
    """
    found = marked(docs.select(id_col, text_col), table, threshold, text_col)
    return found.select(F.col(id_col), F.col(_TEXT).alias("text"), F.col(_BASE).alias("base"), F.col(_ALL).alias("spans"))


def redact(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with every secret masked in the text.

    Texts without a secret, null ones included, stay as they are; ``size_col``,
    where it is a column, is set anew for changed texts.
    """
    changed = F.size(_ALL) > 0
    masked = marked(docs, table, threshold, text_col).withColumn(text_col, F.when(changed, redacted(F.col(_TEXT), F.col(_ALL))).otherwise(F.col(text_col)))
    if size_col in docs.columns:
        kind = dict(docs.dtypes)[size_col]
        masked = masked.withColumn(size_col, F.when(changed, F.length(text_col).cast(kind)).otherwise(F.col(size_col)))
    return masked.select(*(F.col(f"`{c}`") for c in docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        apart = (x["start"] > acc["at"]) | (F.size(acc["out"]) == 0)
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        )

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))
