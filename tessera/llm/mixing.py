"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are first summed to cells (source, language, topic), so the fitting
works on as many rows as there are cells that hold tokens. Each sweep scales the
cells' token weights to the target share of each margin in turn, until no weight
moves by more than ``CLOSE`` or ``sweeps`` are done. A document's inclusion
probability is min(1, c r), with r its cell's weight per token and c such that the
expected tokens are the share ``keep`` of all (of those with r > 0, if fewer). So
the size of the sample is stated and does not hang on the rarest cell; cells that
would have to be repeated (c r > 1) are kept whole and fall short of their target,
and what they lack is spread over the others by r. A document is drawn if a number
made of the md5 of its doc_id and the seed is below its probability: the same
sample in every run.

Target shares are given, or the observed token shares to a power below 1, which
lifts small groups. Null values are the value '(none)'; without a given target a
value has share 0 and is not drawn. Documents of cells without tokens (null and
empty texts alone) have weight 0 and probability ``keep``: there is nothing in them
to balance. Repeated rows are drawn together. A very long text counts as what it
is. Other columns are left alone, whatever their names. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

DIMS = ("source", "lang", "topic")
NONE = "(none)"
#: Cells or margin values that are broadcast; more are joined by shuffle.
SMALL = 50_000
CELLS_A_TASK = 200_000
SWEEPS, POWER, SEED = 12, 0.7, 17
#: The share of all tokens that a sample is to have.
KEEP = 0.7
#: Relative change of a weight at which the sweeps stop.
CLOSE = 1e-10
#: The topic of a text: the first of these that holds. Fixed values.
TOPICS = (("legal", "license"), ("contact", "@"), ("table", " | "), ("marked", "***"))


def topic(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(text.isNull(), F.lit(NONE))
    for name, mark in TOPICS:
        out = out.when(F.contains(low, F.lit(mark)), F.lit(name))
    return out.otherwise(F.lit("prose"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("bigint")


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the margins and tokens of each document."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", *[F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in DIMS[:2]], topic(text).alias("topic"), n_tokens(text).alias("n_tokens"))


def fit(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, sweeps: int = SWEEPS) -> DataFrame:
    """The cells of ``docs`` (as ``described``) that hold tokens: tokens, weight (share of the fitted mix) and ratio (weight per token share)."""
    spark = docs.sparkSession
    cells = workspace.materialize(docs.filter("n_tokens > 0").groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total, n = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    files = 1 + n // CELLS_A_TASK
    cells = cells.withColumn("w", F.col("tokens").cast("double") / max(1, total))
    for d in DIMS:
        if targets and d in targets:
            aim = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, aim double")
            aim = cells.select(d).distinct().join(aim, d, "left").select(d, F.coalesce("aim", F.lit(0.0)).alias("aim"))
        else:
            aim = cells.groupBy(d).agg(F.pow(F.sum("w"), F.lit(power)).alias("aim"))
        aim = workspace.materialize(aim.coalesce(1), "aims")
        whole = aim.agg(F.sum("aim")).first()[0] or 1.0
        cells = cells.join(aim.select(d, (F.col("aim") / whole).alias(f"aim_{d}")), d)
    cells = workspace.materialize(cells.coalesce(files), "sweep")
    for _ in range(sweeps):
        new = cells.withColumn("was", F.col("w"))
        for d in DIMS:
            now = F.sum("w").over(Window.partitionBy(d))
            new = new.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"aim_{d}") / now).otherwise(0.0))
        new = workspace.materialize(new.coalesce(files), "sweep")
        moved = new.agg(F.max(F.abs(F.col("w") - F.col("was")) / F.greatest("w", "was", F.lit(1e-300)))).first()[0]
        cells = new.drop("was")
        if moved is None or moved < CLOSE:
            break
    return cells.select(*DIMS, "tokens", "w", (F.col("w") / F.col("tokens") * max(1, total)).alias("ratio"))


def rate(cells: DataFrame, keep: float) -> float:
    """The c for which min(1, c ratio) keeps the share ``keep`` of the tokens: cells that reach 1 are set aside until none does anew."""
    use = cells.filter("ratio > 0")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * keep
    c = 0.0
    while True:  # c rises, and with it the number of cells set aside
        full = F.col("ratio") * c >= 1
        kept, spread = use.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("ratio"))), F.lit(0.0))).first()
        new = (total - kept) / spread if spread > 0 else float("inf")
        if new <= c * (1 + 1e-12) or new == float("inf"):
            return max(c, new)
        c = new


def draw(docs: DataFrame, cells: DataFrame, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """``docs`` (with the columns of DIMS) joined with weight, probability and selected."""
    c = min(rate(cells, keep), 1e300)
    odds = cells.select(*DIMS, F.col("ratio").alias("weight"), F.when(F.col("ratio") > 0, F.least(F.lit(1.0), F.col("ratio") * c)).otherwise(0.0).alias("probability"))
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}"))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    out = docs.join(workspace.broadcast_if_small(odds, SMALL), list(DIMS), "left")
    return out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("probability", F.coalesce("probability", F.lit(float(keep)))).withColumn("selected", u < F.col("probability"))


def mix(docs: DataFrame, keep: float = KEEP, seed: int = SEED, **how) -> DataFrame:
    """A row per document: doc_id, margins, n_tokens, weight, probability, selected."""
    base = workspace.materialize(described(docs), "described")
    return draw(base, fit(base, **how), keep, seed)


def sample(docs: DataFrame, keep: float = KEEP, seed: int = SEED, **how) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns."""
    base = workspace.materialize(described(docs).groupBy(*DIMS).agg(F.sum("n_tokens").alias("n_tokens")), "described")
    margins = [F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in DIMS[:2]]
    marked = docs.select(F.struct(*workspace.own(docs)).alias("_row"), F.col("doc_id").alias("doc_id"), *margins, topic(F.col("text").cast("string")).alias("topic"))
    out = draw(marked, fit(base, **how), keep, seed).filter("selected")
    return out.select(*workspace.unpacked(out, "_row"))


def sql(power: float = POWER, sweeps: int = SWEEPS, keep: float = KEEP, seed: int = SEED) -> str:
    """The same for ``documents`` in DuckDB's SQL: each sweep of each margin is one common table, and c is found on the cells in descending ratio."""
    case = " ".join(f"when contains(lower(text), '{mark}') then '{name}'" for name, mark in TOPICS)
    parts = [
        f"d as (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, case when text is null then '{NONE}' {case} else 'prose' end as topic, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) as bigint) as n_tokens from documents)",
        "c as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from d where n_tokens > 0 group by all)",
        "w0 as materialized (select *, tokens / sum(tokens) over () as w from c)",
    ]
    for k in DIMS:
        parts.append(f"t_{k} as materialized (select {k}, pow(sum(w), {power}) / sum(pow(sum(w), {power})) over () as aim from w0 group by {k})")
    n = 0
    for _ in range(sweeps):
        for k in DIMS:
            parts.append(f"w{n + 1} as materialized (select source, lang, topic, tokens, w * aim / sum(w) over (partition by {k}) as w from w{n} join t_{k} using ({k}))")
            n += 1
    parts += [
        f"r as materialized (select *, w / tokens * sum(tokens) over () as ratio from w{n})",
        f"f as (select ratio, {keep} * sum(tokens) over () as goal, sum(tokens) over (order by ratio desc) - sum(tokens) over (partition by ratio) as kept, coalesce(sum(tokens * ratio) over (order by ratio), 0) as spread from r)",
        "k as (select max((goal - kept) / spread) as c from f where kept <= goal and (goal - kept) / spread * ratio <= 1 + 1e-12)",
        f"p as (select source, lang, topic, ratio as weight, least(1.0, ratio * coalesce((select c from k), 1e300)) as probability from r)",
    ]
    return "with " + ",\n".join(parts) + f"""
select doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 0), 6) as weight, round(coalesce(probability, {keep}), 6) as probability,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '#{seed}'), 1, 13) as bigint) / {1 << 52}.0::double < coalesce(probability, {keep}) as selected
from d left join p using (source, lang, topic)"""
