"""Mixing sources to target weights (operator 10): hierarchical budgets and seeded prefixes.

Leaves are (domain, lang, source). A leaf can give its tokens MAX_EPOCHS times. The
budget goes down the tree: at each node the children share it by weight, a child takes
no more than its subtree can give, and what it leaves goes to its siblings by weight;
only what a whole subtree can't place reaches the level above. Each leaf then gives
its whole epochs and, of the next one, the longest prefix, in the order of
md5(seed:epoch:doc_id), whose tokens fit what is left.

All of it is DataFrame code. The prefix of a leaf is cut by one (hash, doc_id) value: sums
by leaf and hash bucket find the bucket in which the cut lies, and only that bucket's
rows are ordered, so no leaf is sorted in one task, however many rows it holds. Texts are
never shuffled: the table of leaves is joined to them (broadcast up to MAX_BROADCAST leaves).

Defined cases: null domain, lang or source is the leaf name ''; a null text has no tokens
and is taken with its leaf's whole epochs, or by its place in the prefix; repeated rows
stand side by side in the order and are cut together; a null doc_id hashes as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Workspace

SEED = 17
MAX_EPOCHS = 2
SHARE = 0.9  # budget as a share of the tokens at hand
MAX_BROADCAST = 50_000
DOMAINS = 3
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
LEVELS = ("domain", "lang", "source")


def estimated_tokens(text: str = "text") -> Column:
    """A quarter of the UTF-8 bytes, rounded up; nulls have none."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def leaf_columns(docs: DataFrame) -> dict[str, Column]:
    """Domain (its column, or else one of DOMAINS by crc32 of the source), lang and source."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.coalesce(F.col("domain").cast("string"), F.lit("")) if "domain" in docs.columns else F.concat(F.lit("d"), (F.crc32(source) % DOMAINS).cast("string"))
    return {"domain": domain, "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def lang_weight() -> Column:
    out = F.lit(1)
    for k, v in LANG_WEIGHTS.items():
        out = F.when(F.col("lang") == k, v).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling: children have cap, weight and their parent's budget; adds column give.

    In the order of cap / weight a child is full as long as its cap is no more than its
    share of what the fuller ones leave; from the first that isn't, all get weight shares.
    """
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name) if parent else W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), name)
    past = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    t = children.withColumns({"left": F.col("budget") - F.coalesce(F.sum("cap").over(past), F.lit(0)), "heavy": F.sum("weight").over(rest)})
    t = t.withColumn("part", F.col("left").cast("double") / F.col("heavy"))
    t = t.withColumn("open", F.col("cap") > F.col("part") * F.col("weight"))
    t = t.withColumn("rate", F.min(F.when(F.col("open"), F.struct(F.row_number().over(order).alias("n"), F.col("part").alias("part")))).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    give = F.when(F.col("rate").isNull() | (F.row_number().over(order) < F.col("rate.n")), F.col("cap")).otherwise(F.floor(F.col("rate.part") * F.col("weight")))
    return t.withColumn("give", F.greatest(give, F.lit(0)).cast("long")).drop("left", "heavy", "part", "open", "rate")


def allocate(leaves: DataFrame, budget: DataFrame, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens; budget: one row with column budget. Adds cap and give."""
    base = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    lang = base.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", lang_weight())
    dom = base.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", F.lit(1).cast("long")).crossJoin(F.broadcast(budget))  # one row
    dom = share_out(dom, [], "domain").select("domain", F.col("give").alias("budget"))
    lang = share_out(lang.join(dom, "domain"), ["domain"], "lang").select("domain", "lang", F.col("give").alias("budget"))
    return share_out(base.withColumn("weight", F.lit(1).cast("long")).join(lang, ["domain", "lang"]), ["domain", "lang"], "source")


def order_hash(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_cuts(docs: DataFrame, ws: Workspace, seed: int = SEED, max_epochs: int = MAX_EPOCHS, share: float = SHARE) -> DataFrame:
    """One row a leaf: domain, lang, source, tokens, give, whole (epochs), cut_hash."""
    slim = docs.select("doc_id", *[c.alias(k) for k, c in leaf_columns(docs).items()], estimated_tokens().alias("n"))
    leaves = ws.write(slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "leaves")
    budget = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).alias("budget"))
    given = allocate(leaves, budget, max_epochs).select(*LEVELS, "tokens", "give")
    given = given.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("give") / F.col("tokens"))).otherwise(F.lit(max_epochs)).cast("long"))
    given = ws.write(given.withColumn("rest", F.col("give") - F.col("whole") * F.col("tokens")), "given")
    rows = slim.join(_small(given), list(LEVELS)).where("rest > 0").withColumn("h", order_hash(F.col("whole"), seed)).withColumn("bucket", F.substring("h", 1, 3))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("in_bucket"), F.first("rest").alias("rest"))
    run = W.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("in_bucket").over(run.rowsBetween(W.unboundedPreceding, 0)))
    edge = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("in_bucket") <= F.col("rest")))
    edge = edge.groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("before")), "bucket").alias("e")).select(*LEVELS, "e.bucket", "e.before")
    edge = ws.write(edge, "edge")
    inside = rows.join(_small(edge), [*LEVELS, "bucket"])
    near = W.partitionBy(*LEVELS).orderBy("h", F.col("doc_id").asc_nulls_first())
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(near))
    cut = inside.where(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min("h").alias("cut_hash"))
    return given.join(cut, list(LEVELS), "left")


def _small(leaves: DataFrame) -> DataFrame:
    """A hint for tables of one row a leaf, taken only where their number is checked."""
    return F.broadcast(leaves) if leaves.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else leaves


def mix(docs: DataFrame, ws: Workspace | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS, share: float = SHARE) -> DataFrame:
    """`docs` with columns __domain, __lang, __source, __copies, replaced if there are such: how often each row is taken."""
    ws = ws or Workspace(docs.sparkSession, "mixing")
    cuts = ws.write(leaf_cuts(docs, ws, seed, max_epochs, share), "leaf-cuts")
    added = {f"__{k}": c for k, c in leaf_columns(docs).items()}
    names = [c for c in docs.columns if c not in (*added, "__copies")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id"), *[c.alias(k) for k, c in leaf_columns(docs).items()])
    cuts = cuts.select(*LEVELS, "whole", "rest", "cut_hash")
    part = (F.col("rest") > 0) & (F.col("cut_hash").isNull() | (order_hash(F.col("whole"), seed) < F.col("cut_hash")))
    out = own.join(_small(cuts), list(LEVELS)).withColumn("copies", (F.col("whole") + F.when(part, 1).otherwise(0)).cast("long"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[F.col(k).alias(f"__{k}") for k in LEVELS], F.col("copies").alias("__copies"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mix(docs, Workspace(spark, "mixing"))
    return got.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", estimated_tokens().alias("n_tokens"), F.col("__copies").alias("copies"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its leaf takes it; the columns of documents are returned."""
    got = mix(docs, Workspace(spark, "pipeline-mixing")).where("__copies > 0")
    return got.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def _level(name: str, parent: str, source: str, weight: str) -> str:
    over = f"PARTITION BY {parent} ORDER BY cap / weight, {name}" if parent else f"ORDER BY cap / weight, {name}"
    whole = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {name}" if parent else name
    return f"""(SELECT {keys}, cap, CAST(greatest(CASE WHEN rate IS NULL OR n < rate_n THEN cap ELSE floor(rate * weight) END, 0) AS BIGINT) AS give FROM (
      SELECT *, min(CASE WHEN cap > part * weight THEN n END) OVER ({whole}) AS rate_n,
             arg_min(part, CASE WHEN cap > part * weight THEN n END) FILTER (WHERE cap > part * weight) OVER ({whole}) AS rate FROM (
        SELECT *, CAST(budget - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                  / CAST(sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS part,
               row_number() OVER ({over}) AS n
        FROM (SELECT *, {weight} AS weight FROM {source}))))"""


def _sql(crc: str) -> str:
    lang_w = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + " ELSE 1 END"
    return f"""
WITH d AS (SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {crc} AS domain,
                  CAST(coalesce(ceil(strlen(text) / 4.0), 0) AS BIGINT) AS n FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {MAX_EPOCHS} AS BIGINT) AS cap FROM d GROUP BY ALL),
b0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(floor(sum(tokens) * CAST({SHARE} AS DOUBLE)) AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain),
g0 AS {_level("domain", "", "b0", "1")},
b1 AS (SELECT l.domain, l.lang, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(g0.give) AS budget FROM leaf l JOIN g0 USING (domain) GROUP BY l.domain, l.lang),
g1 AS {_level("lang", "domain", "b1", lang_w)},
b2 AS (SELECT l.domain, l.lang, l.source, l.cap, g1.give AS budget FROM leaf l JOIN g1 USING (domain, lang)),
g2 AS {_level("source", "domain, lang", "b2", "1")},
a AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN give // tokens ELSE {MAX_EPOCHS} END AS whole, give - (CASE WHEN tokens > 0 THEN give // tokens ELSE {MAX_EPOCHS} END) * tokens AS rest
      FROM g2 JOIN leaf USING (domain, lang, source)),
o AS (SELECT d.*, whole, rest, md5(concat('{SEED}:', CAST(whole AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM d JOIN a USING (domain, lang, source)),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o),
k AS (SELECT *, min(CASE WHEN upto > rest THEN h END) OVER (PARTITION BY domain, lang, source) AS cut FROM c)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n AS n_tokens, CAST(whole + CASE WHEN rest > 0 AND (cut IS NULL OR h < cut) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM k
"""


def oracle() -> str | None:
    """DuckDB has no crc32, so the domain is a table of the sources' names in the form src<n>."""
    import zlib

    cases = " ".join(f"WHEN 'src{i}' THEN 'd{zlib.crc32(f'src{i}'.encode()) % DOMAINS}'" for i in range(100))
    return _sql(f"CASE coalesce(source, '') {cases} WHEN '' THEN 'd{zlib.crc32(b'') % DOMAINS}' END")
