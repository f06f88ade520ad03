"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The leaves are the combinations of the level columns (domain, language, source).
A node's capacity is its tokens times ``epochs``. From the root down, a node's
budget is shared among its children by weight; a child whose share exceeds its
capacity gets that, and what it leaves goes to its siblings by weight. As a
node never gets more than its subtree holds, a shortage only passes to the
ancestors' other children once all siblings are full. Budgets are whole tokens,
rounded down, so a node may leave less than one token a child.

A leaf's budget is spent on epochs over its documents in seeded orders: whole
epochs first, then the longest prefix of the next that fits. Documents stay
whole.

Scale: an order is the MD5 of seed, epoch and id. Leaves are cut into buckets by
its first digits and only the bucket where the budget ends is cut again, until
it holds FEW rows, which are ordered; so a hot leaf isn't one task. What is left
of a leaf is the last order taken: texts meet one row a leaf and aren't shuffled.

Nulls: a null level value is the name "" and gets that name's weight, or the
default; a null text has no tokens; a null id is ordered as the word "null".
Ties: documents of a leaf with equal ids are taken together or not at all. A
document without tokens is taken whenever its place in the prefix is. Of a text
only its words are counted, however long it is. An empty table gives an empty
result. Columns named like the result's are replaced in it; ``mix`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

LEVELS = ("domain", "lang", "source")
#: Fixed weights of the query: by level and name; names not listed weigh 10.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"dom0": 40, "dom1": 30, "dom2": 20, "dom3": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {"src0": 5}}
DEFAULT_WEIGHT = 10
SHARE = (4, 5)
EPOCHS = 2
SEED = 17
#: Hexadecimal digits that a bucket has more than the one it is part of, and rows of a border that are ordered in one task.
DIGITS = 2
FEW = 10_000


def word_count(text: Column) -> Column:
    """Tokens are words, as the mix is drawn before any encoding."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("dom"), F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(12,0)")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, levels: tuple[str, ...] = LEVELS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds the budget to a table of leaves with their tokens: the root has share of all tokens."""
    whole = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)).cast("decimal(28,0)") * share[0] / share[1]).cast("decimal(20,0)").alias("budget"))
    parents: list[str] = []
    above = whole
    for level in levels:
        nodes = leaves.groupBy(*parents, level).agg((F.sum("tokens") * epochs).cast("decimal(20,0)").alias("cap")).withColumn("w", _weight(level, weights)).filter("w > 0")
        # One row crosses with the top level's few nodes; below, parents are matched.
        at = nodes.join(above, parents) if parents else nodes.join(F.broadcast(above))
        # In order of capacity by weight the full children come first; after them all get the same share by weight.
        order = Window.partitionBy(*parents).orderBy((F.col("cap").cast("double") / F.col("w").cast("double")).asc(), level)
        before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        at = at.withColumn("left", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("decimal(20,0)")).withColumn("of", F.sum("w").over(rest).cast("decimal(16,0)"))
        full = F.col("cap") * F.col("of") <= F.col("left") * F.col("w")
        at = at.withColumn("full", full)
        every = Window.partitionBy(*parents)
        # The first child that isn't full has what is left and the weight that shares it.
        first = F.min(F.when(~F.col("full"), F.struct((F.col("cap").cast("double") / F.col("w").cast("double")).alias("r"), F.col(level).alias("name"), F.col("left").alias("l"), F.col("of").alias("o")))).over(every)
        at = at.withColumn("first", first)
        given = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr("cast(first.l * w div first.o as decimal(20,0))")))
        parents = [*parents, level]
        above = at.select(*parents, F.when(F.col("full"), F.col("cap")).otherwise(given).alias("budget"))
    return leaves.join(above, list(levels)).withColumn("budget", F.col("budget").cast("long"))


def order_of(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def cuts(rows: DataFrame, key: str = "doc_id", weights: dict[str, dict[str, int]] = WEIGHTS, levels: tuple[str, ...] = LEVELS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED, few: int = FEW) -> DataFrame:
    """A written table, one row a leaf that gets anything: ``_whole`` epochs, and ``_cut``, the last order that the next one takes."""
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    plan = budgets(leaves, weights, levels, share, epochs).filter("tokens > 0 and budget > 0")
    # The border is the bucket, of all orders that begin alike, where the budget ends; ``_ahead`` is what stands before it.
    border = materialize(plan.select(*levels, F.expr("budget div tokens").cast("int").alias("_whole"), (F.col("budget") % F.col("tokens")).alias("_rest"), F.lit(0).cast("long").alias("_ahead"), F.lit("").alias("_border")), "mix-plan")
    own = rows.select(*levels, key, "tokens")
    for digits in range(DIGITS, 32 + DIGITS, DIGITS):
        inside = own.join(border, list(levels)).withColumn("_order", order_of(seed, F.col("_whole"), F.col(key))).filter(F.col("_order").startswith(F.col("_border")))
        buckets = inside.groupBy(*levels, "_whole", "_rest", "_ahead", F.substring("_order", 1, digits).alias("_bucket")).agg(F.sum("tokens").alias("_n"), F.count("*").alias("_rows"))
        running = Window.partitionBy(*levels).orderBy("_bucket")
        placed = buckets.withColumn("_upto", F.col("_ahead") + F.sum("_n").over(running)).filter("_upto > _rest and _upto - _n <= _rest")
        border = materialize(placed.select(*levels, "_whole", "_rest", (F.col("_upto") - F.col("_n")).alias("_ahead"), F.col("_bucket").alias("_border"), "_rows"), "mix-border")
        if (border.agg(F.max("_rows")).first()[0] or 0) <= few:
            break
        border = border.drop("_rows")
    # RANGE frames take equal orders together; a border of all 32 digits is one order, which doesn't fit.
    inside = own.join(border, list(levels)).withColumn("_order", order_of(seed, F.col("_whole"), F.col(key))).filter(F.col("_order").startswith(F.col("_border")) & (F.length("_border") < 32))
    fits = inside.withColumn("_upto", F.col("_ahead") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("_order"))).filter("_upto <= _rest")
    last = fits.groupBy(*levels).agg(F.max("_order").alias("_cut"))
    # Orders are longer than the border, so without any that fits the border's own name cuts before it.
    return materialize(border.join(last, list(levels), "left").select(*levels, "_whole", F.coalesce("_cut", "_border").alias("_cut"), (F.length("_border") < 32).alias("_with")), "mix-cuts")


def taken(rows: DataFrame, cut: DataFrame, key: str, levels: tuple[str, ...], seed: int) -> DataFrame:
    """Rows with levels, as often as the cuts say, with ``epoch``."""
    order = order_of(seed, F.col("_whole"), F.col(key))
    fits = (order < F.col("_cut")) | (order == F.col("_cut")) & F.col("_with")
    copies = rows.join(cut, list(levels)).withColumn("_copies", F.col("_whole") + fits.cast("int")).filter("_copies > 0")
    return copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_whole", "_cut", "_with", "_copies")


def chosen(rows: DataFrame, key: str = "doc_id", levels: tuple[str, ...] = LEVELS, seed: int = SEED, **options) -> DataFrame:
    """One row per document and epoch in which it is taken, with all columns of rows (which has levels and tokens) and ``epoch``."""
    return taken(rows, cuts(rows, key, levels=levels, seed=seed, **options), key, levels, seed)


def with_levels(df: DataFrame, text: str = "text") -> DataFrame:
    """The levels and tokens of documents: domain from the source, nulls as empty names."""
    return df.withColumns({
        "domain": domain_of(F.col("source")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")), "tokens": word_count(F.col(text)),
    })


def mix_documents(df: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, tokens and epoch of the mix drawn from documents."""
    rows = with_levels(df.select("doc_id", "lang", "source", "text")).select("doc_id", *LEVELS, "tokens")
    # Words are counted once: leaves, buckets and documents all read the written table.
    return chosen(materialize(rows, "mix-rows")).select("doc_id", *LEVELS, "tokens", "epoch")


def mix(df: DataFrame, levels: tuple[str, ...] = LEVELS, seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix with the columns of df; a document taken in several epochs comes as often.

    Texts only meet the table of cuts, one row a leaf, which Spark broadcasts where its size allows.
    """
    light = with_levels(df.select("doc_id", "lang", "source", "text")).select("doc_id", *LEVELS, "tokens")
    cut = cuts(materialize(light, "mix-rows"), "doc_id", levels=levels, seed=seed, **options)
    whole = df.select(F.struct("*").alias("_doc"), "doc_id", "lang", "source")
    rows = whole.withColumns({"domain": domain_of(F.col("source")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    return taken(rows, cut, "doc_id", levels, seed).select(*(F.col("_doc")[c].alias(c) for c in df.columns))


SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {domain} AS domain,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents
),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens FROM docs GROUP BY ALL),
root AS (SELECT CAST(coalesce(sum(tokens), 0) AS HUGEINT) * {num} // {den} AS budget FROM leaf),
{levels}
plan AS (
  SELECT leaf.*, n3.budget AS budget, n3.budget // leaf.tokens AS whole, n3.budget % leaf.tokens AS rest
  FROM leaf JOIN n3 USING (domain, lang, source) WHERE leaf.tokens > 0 AND n3.budget > 0
),
ordered AS (
  SELECT d.*, p.whole, p.rest, md5('{seed}:' || CAST(p.whole AS VARCHAR) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')) AS h
  FROM docs d JOIN plan p USING (domain, lang, source)
),
cum AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered
),
copies AS (SELECT *, CAST(whole AS INTEGER) + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM cum)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch AS INTEGER) AS epoch
FROM copies, range(0, 64) AS e(epoch) WHERE epoch < n
"""


def oracle_sql(domains: dict[str, str] | None = None) -> str:
    """The same mix in DuckDB SQL; domains: the domain of each source, as DuckDB has no CRC-32."""
    from zlib import crc32

    domains = domains or {name: f"dom{crc32(name.encode()) % 4}" for name in ["", *(f"src{k}" for k in range(20))]}
    domain = "CASE coalesce(source, '') " + " ".join(f"WHEN '{s}' THEN '{d}'" for s, d in domains.items()) + " END"
    parts, parents, above = [], [], "root"
    for depth, level in enumerate(LEVELS, 1):
        names = [*parents, level]
        weight = "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS.get(level, {}).items()) + f" ELSE {DEFAULT_WEIGHT} END"
        by = f"PARTITION BY {', '.join(parents)} " if parents else ""
        order = f"{by}ORDER BY CAST(cap AS DOUBLE) / w, {level}"
        match = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
        parts.append(f"""
c{depth} AS (SELECT {', '.join(names)}, sum(tokens) * {EPOCHS} AS cap, CAST({weight} AS HUGEINT) AS w FROM leaf GROUP BY {', '.join(names)}),
l{depth} AS (
  SELECT *, budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_budget,
         sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w, row_number() OVER ({order}) AS place
  FROM c{depth} {match} WHERE w > 0
),
f{depth} AS (SELECT *, cap * rest_w <= rest_budget * w AS filled FROM l{depth}),
s{depth} AS (
  SELECT *, min(CASE WHEN NOT filled THEN place END) OVER ({by}) AS at FROM f{depth}
),
n{depth} AS (
  SELECT {', '.join(f's.{n}' for n in names)}, CASE WHEN s.filled OR s.at IS NULL THEN s.cap
         ELSE least(s.cap, t.rest_budget * s.w // t.rest_w) END AS budget
  FROM s{depth} s LEFT JOIN s{depth} t ON t.place = s.at {' '.join(f'AND t.{p} = s.{p}' for p in parents)}
),""")
        parents, above = names, f"n{depth}"
    return SQL.format(domain=domain, num=SHARE[0], den=SHARE[1], seed=SEED, levels="".join(parts))
