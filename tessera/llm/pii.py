"""PII and what gives it away, with DataFrame functions only.

Base kinds (e-mail, IP, card, phone) are found by patterns. The method then asks
which other terms disclose such an entity: over the corpus, a term discloses an
entity by the pointwise mutual information of the two, as a share of the
entity's information content, log(N / n_e). An entity is a value, or a kind: what
tells that a text holds any phone number is a term of the kind's. Terms are the words of the texts that
hold the entity, however far from it, without those inside base spans; all
numbers count distinct texts, so copies change nothing. Terms with at least
``support`` distinct contexts of the entity (the ``WINDOW`` code points on both
sides of it, by which near copies are one) and a share of at least ``generalise``
are spans of kind ``term`` wherever they stand in a text that holds the entity
(``sanitised`` puts a general word for them, or nothing from ``remove`` on).

Patterns are written so that no long text makes them slow or deep: quantifiers
are possessive, and a match may begin only where a run begins or the match
before it ends, which leaves the leftmost non-overlapping matches unchanged.

Nulls: a null text has no spans; a null id is kept. Ties: spans go by kind, then
start. Repeated rows have the same spans. An empty table gives an empty result.
Columns other than the id and the text are not read; ``sanitised`` keeps all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
_TERM = r"\p{L}[\p{L}\p{M}]*+"
WINDOW = 48
SUPPORT = 3
GENERALISE = 0.6
REMOVE = 0.8
_BLOCK = 128
#: Texts with copies that are told to all tasks, 8 bytes each; more are joined by sorting.
FEW_COPIED = 500_000
_SPAN = "array<struct<start:int,end:int,value:string>>"


def prefix_sums(steps: Column) -> Column:
    """The sum of the steps before each; in blocks, so that long arrays aren't copied for every element."""

    def running(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    starts = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(starts, 1, F.size(blocks)).alias("s")), lambda z: F.transform(F.slice(running(z["b"]), 1, F.size(z["b"])), lambda x: x + z["s"])))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], hints: dict[str, str] | None = None) -> DataFrame:
    """Adds, for each name, the array of its pattern's matches with their code points."""
    hints = hints or {}
    cols = df.columns
    none = F.array().cast("array<string>")
    found = {f"_m_{k}": F.when(F.col(text).rlike(hints[k]) if k in hints else F.col(text).isNotNull(), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()}
    df = df.select(*cols, *(c.alias(n) for n, c in found.items()))
    # The lengths of gaps and matches give the places.
    gaps = {f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.transform(F.split(text, p, -1), F.length)) for k, p in patterns.items()}
    df = df.select("*", *(c.alias(n) for n, c in gaps.items()))
    steps = {f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, prefix_sums(F.zip_with(F.slice(f"_g_{k}", 1, F.size(f"_m_{k}")), f"_m_{k}", lambda g, m: g + F.length(m)))) for k in patterns}
    df = df.select("*", *(c.alias(n) for n, c in steps.items()))

    def spans(k: str) -> Column:
        z = F.arrays_zip(F.col(f"_m_{k}").alias("m"), F.slice(f"_g_{k}", 1, F.size(f"_m_{k}")).alias("g"), F.col(f"_s_{k}").alias("s"))
        made = F.transform(z, lambda x: F.struct((x["s"] + x["g"]).alias("start"), (x["s"] + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))
        return F.when(F.size(f"_m_{k}") > 0, made).otherwise(F.array().cast(_SPAN)).cast(_SPAN)

    return df.select(*cols, *(spans(k).alias(k) for k in patterns))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda s: s["value"].rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return lambda s: F.length(_digits(s["value"])).between(13, 19) & F.when(F.length(_digits(s["value"])).between(13, 19), _luhn(s["value"])).otherwise(False)
    if kind == "phone":
        return lambda s: F.length(_digits(s["value"])).between(9, 15)
    return lambda s: F.lit(True)


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the arrays email, ip, card and phone of valid matches; columns of these names are replaced."""
    kept = [c for c in df.columns if c not in PATTERNS]
    found = with_matches(df.select(*kept), text, PATTERNS, _HINTS)
    return found.select(*kept, *(F.filter(k, _valid(k)).alias(k) for k in PATTERNS))


def _contexts(text: str) -> Column:
    """Two structs per span, for its value and for its kind: entity, and a digest of the text on both sides."""

    def of(kind: str) -> Column:
        def pair(s: Column) -> Column:
            before = F.substring(F.col(text), F.greatest(F.lit(0), s["start"] - WINDOW) + 1, F.least(F.lit(WINDOW), s["start"]))
            sides = F.md5(F.concat(F.lower(before), F.lit("|"), F.lower(F.substring(F.col(text), s["end"] + 1, F.lit(WINDOW)))).cast("binary"))
            names = (F.concat(F.lit(f"{kind}:"), F.lower(s["value"])), F.lit(kind))
            return F.array(*(F.struct(n.alias("entity"), sides.alias("context")) for n in names))

        return F.flatten(F.transform(kind, pair))

    return F.concat(*map(of, PATTERNS))


def scanned(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A written table: doc_id, tkey (hash of the text), the base spans and their contexts, and the texts that have any."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("tkey", F.xxhash64("_text"))
    found = base_spans(rows, "_text").withColumn("contexts", _contexts("_text"))
    return materialize(found.withColumn("_text", F.when(F.size("contexts") > 0, F.col("_text"))), "pii")


def entities(scans: DataFrame, support: int = SUPPORT) -> DataFrame:
    """A written table: tkey and entity of each text with an entity of enough contexts, one context for the text, and n_e."""
    own = scans.filter("size(contexts) > 0").select("tkey", F.explode("contexts").alias("c")).groupBy("tkey", "c.entity").agg(F.min("c.context").alias("context"))
    own = materialize(own, "entities")
    seen = own.groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("n")).filter(F.col("n") >= support)
    return materialize(own.join(seen.drop("n"), "entity"), "supported")


def texts_of_entities(scans: DataFrame, found: DataFrame) -> DataFrame:
    """A written table: tkey, _text, base (the places of base spans) and entities of each text with an entity of ``found``."""
    own = found.groupBy("tkey").agg(F.collect_list(F.struct("entity", F.xxhash64("context").alias("context"), "n_e")).alias("entities"))
    base = F.array_sort(F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in PATTERNS)))
    texts = scans.filter("size(contexts) > 0").select("tkey", "_text", base.alias("base")).dropDuplicates(["tkey"])
    return materialize(texts.join(own, "tkey"), "entity-texts")


def spread(texts: DataFrame) -> DataFrame:
    """Few bytes, but each takes long: dealt to as many tasks as there are for a shuffle, which otherwise would be run together."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("tkey"))


def words_apart(texts: DataFrame) -> DataFrame:
    """Adds the array ``word`` of a text's words outside base spans."""
    each = with_matches(texts, "_text", {"word": _TERM})
    return each.withColumn("word", F.filter("word", lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))))


def distinct_texts(df: DataFrame, scans: DataFrame, text: str) -> tuple[DataFrame, int]:
    """_text of each distinct text once, and their number. Only texts that have copies are moved."""
    copies = materialize(scans.groupBy("tkey").agg(F.count("*").alias("c")), "copies")
    again = materialize(copies.filter("c > 1").select("tkey"), "copied")
    # The size of the written table is checked; beyond it Spark joins by sorting.
    held = F.broadcast(again) if again.count() <= FEW_COPIED else again
    each = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("tkey", F.xxhash64("_text"))
    once = each.join(held, "tkey", "left_semi").dropDuplicates(["tkey"])
    return each.join(held, "tkey", "left_anti").unionByName(once).select("_text"), copies.count()


def disclosures(df: DataFrame, scans: DataFrame, terms: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """A written table: entity, term and share, how much of the entity's information the term gives, where that is at least ``generalise``.

    terms: entities and terms of each text with any.
    """
    rows = terms.select("entities", F.explode("terms").alias("term")).select("term", F.explode("entities").alias("e")).select("term", "e.*")
    pairs = rows.groupBy("entity", "term", "context", "n_e").agg(F.count("*").alias("n")).groupBy("entity", "term", "n_e").agg(F.sum("n").alias("n_te"), F.count("*").alias("n_c"))
    pairs = materialize(pairs.filter(F.col("n_c") >= support), "pairs")
    each, n = distinct_texts(df, scans, text)
    total = F.lit(max(2, n)).cast("double")
    held = each.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(_TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = F.greatest("n_t", "n_te")
    pmi = F.log(F.col("n_te") * total / (F.col("n_e") * n_t))
    content = F.log(F.greatest(total / F.col("n_e"), F.lit(1.0001)))
    return materialize(pairs.join(held, "term").withColumn("share", pmi / content).filter(F.col("share") >= generalise).select("entity", "term", "share"), "disclosures")


def disclosing_spans(df: DataFrame, scans: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """A written table: tkey and the array of its disclosing terms' spans with their shares, all places of the term in texts that hold the entity."""
    found = entities(scans, support)
    texts = texts_of_entities(scans, found)
    spoken = words_apart(spread(texts)).select("tkey", "entities", F.array_distinct(F.transform("word", lambda w: F.lower(w["value"]))).alias("terms"))
    spoken = materialize(spoken, "terms")
    given = disclosures(df, scans, spoken, text, support, generalise)
    here = spoken.select("tkey", "entities.entity", F.explode("terms").alias("term")).select("tkey", "term", F.explode("entity").alias("entity"))
    told = here.join(given, ["entity", "term"]).groupBy("tkey", "term").agg(F.max("share").alias("share")).groupBy("tkey").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))
    marked = words_apart(spread(texts.select("tkey", "_text", "base").join(told, "tkey")))
    spans = F.transform(F.filter("word", lambda w: F.map_contains_key("told", F.lower(w["value"]))), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at("told", F.lower(w["value"])).alias("share")))
    out = materialize(marked.select("tkey", F.array_sort(spans).alias("term")), "disclosing-spans")
    discard(found, texts, spoken, given)
    return out


def _joined(kinds: tuple[str, ...]) -> Column:

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.concat_ws(",", F.concat(*map(of, kinds)))


def pii_digest(df: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans, and their number, of each text."""
    scans = scanned(df)
    terms = disclosing_spans(df, scans)
    out = scans.join(terms, "tkey", "left").withColumn("term", F.coalesce("term", F.array().cast("array<struct<start:int,end:int,share:double>>")))
    kinds = tuple(PATTERNS)
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(_joined(kinds), 256).alias("base_sha256"), _joined(KINDS).alias("spans"), sum((F.size(k) for k in KINDS[1:]), F.size(KINDS[0])).cast("long").alias("n_all"))


def sanitised(df: DataFrame, text: str = "text", key: str = "doc_id", remove: float = REMOVE, **limits: float) -> DataFrame:
    """The text with entities replaced by their kind, disclosing terms by [TERM] or, from ``remove`` on, by nothing."""
    scans = scanned(df, text, key)
    terms = disclosing_spans(df, scans, text, **limits)

    def mark(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    of_terms = F.transform(F.coalesce("term", F.array().cast("array<struct<start:int,end:int,share:double>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= remove, "").otherwise("[TERM]").alias("mark")))
    spans = scans.join(terms, "tkey", "left").select(F.struct("doc_id", "tkey").alias("_key"), F.array_sort(F.concat(*map(mark, PATTERNS), of_terms)).alias("_spans")).filter("size(_spans) > 0").dropDuplicates(["_key"])
    whole = df.select(F.struct("*").alias("_doc"), F.struct(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tkey")).alias("_key"))
    joined = whole.join(spans.withColumnRenamed("_key", "_own"), F.col("_key").eqNullSafe(F.col("_own")), "left")
    old = F.col("_doc")[text]
    folded = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(old, acc["at"] + 1, s["start"] - acc["at"]), s["mark"]).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(old, acc["at"] + 1, F.length(old))),
    )
    new = F.when(F.col("_spans").isNull(), old).otherwise(folded)
    return joined.select(*(new.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in df.columns))


# -- SQL ---------------------------------------------------------------------

_PART = "(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SQL_TERM = r"\p{L}[\p{L}\p{M}]*"
#: The patterns as RE2 has them, and what makes a match valid.
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(v, '0*{_PART}(?:\.0*{_PART}){{3}}')"),
    "card": (r"[0-9](?:[ -]?[0-9])+", "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INT)"
             " WHEN CAST(d[length(d) - i] AS INT) > 4 THEN 2 * CAST(d[length(d) - i] AS INT) - 9 ELSE 2 * CAST(d[length(d) - i] AS INT) END)) % 10 = 0"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
}


def _placed(name: str, of: str, text: str, pattern: str) -> str:
    """name(text, v, s, e): the matches of a pattern with their places; gaps and matches before a match give its start."""
    return f"""{name}_l AS (SELECT {text} AS text, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {of}),
{name}_n AS (SELECT text, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM {name}_l WHERE len(ms) > 0),
{name} AS (SELECT text, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY text ORDER BY i) AS BIGINT) - length(v) AS s, CAST(sum(length(g) + length(v)) OVER (PARTITION BY text ORDER BY i) AS BIGINT) AS e FROM {name}_n)"""


def oracle_sql() -> str:
    """The same in DuckDB SQL: base spans, contexts, counts of distinct texts, and the terms' spans."""
    kinds = list(PATTERNS)
    each = ",\n".join(_placed(f"m_{k}", "texts", "text", _SQL_KINDS[k][0]) + f",\nb_{k} AS (SELECT text, '{k}' AS kind, {n} AS ord, v, s, e FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM m_{k}) t WHERE {_SQL_KINDS[k][1]})" for n, k in enumerate(kinds))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT DISTINCT text FROM docs),
{each},
base AS ({" UNION ALL ".join(f"SELECT * FROM b_{k}" for k in kinds)}),
ctx AS (
  SELECT text, unnest([kind || ':' || lower(v), kind]) AS entity, md5(lower(substr(text, CAST(greatest(0, s - {WINDOW}) AS BIGINT) + 1, CAST(least({WINDOW}, s) AS BIGINT))) || '|' || lower(substr(text, e + 1, {WINDOW}))) AS context FROM base
),
own AS (SELECT text, entity, min(context) AS context FROM ctx GROUP BY ALL),
found AS (SELECT o.*, n_e FROM own o JOIN (SELECT entity, count(*) AS n_e FROM own GROUP BY entity HAVING count(DISTINCT context) >= {SUPPORT}) t USING (entity)),
{_placed("w", "(SELECT DISTINCT text FROM found) f", "text", _SQL_TERM)},
words AS (SELECT text, lower(v) AS term, s, e FROM w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.text = w.text AND b.s < w.e AND w.s < b.e)),
pairs AS (
  SELECT entity, term, n_e, count(*) AS n_te FROM (SELECT DISTINCT text, term FROM words) x JOIN found USING (text) GROUP BY entity, term, n_e HAVING count(DISTINCT context) >= {SUPPORT}
),
held AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT text, unnest(regexp_extract_all(lower(text), '{_SQL_TERM}')) AS term FROM texts) x GROUP BY term),
total AS (SELECT greatest(2, count(*)) AS n FROM texts),
told AS (
  SELECT entity, term FROM pairs JOIN held USING (term), total
  WHERE ln(CAST(n_te AS DOUBLE) * n / (CAST(n_e AS DOUBLE) * greatest(n_t, n_te))) / ln(greatest(CAST(n AS DOUBLE) / n_e, 1.0001)) >= {GENERALISE}
),
terms AS (SELECT DISTINCT w.text, 'term' AS kind, {len(kinds)} AS ord, w.s, w.e FROM words w JOIN found USING (text) JOIN told USING (entity, term)),
spans AS (SELECT text, kind, ord, s, e, kind || ':' || s || ':' || e AS told FROM (SELECT text, kind, ord, s, e FROM base UNION ALL SELECT * FROM terms) x),
lists AS (
  SELECT text, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)},
    coalesce(string_agg(told, ',' ORDER BY ord, s) FILTER (kind <> 'term'), '') AS base, string_agg(told, ',' ORDER BY ord, s) AS spans, count(*) AS n_all FROM spans GROUP BY text
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_all, 0) AS n_all FROM docs LEFT JOIN lists USING (text)
"""
