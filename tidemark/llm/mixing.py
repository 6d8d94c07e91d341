"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Documents are the leaves' content of a tree domain > language > source. A token budget goes down from the root: the children of a node
share its budget by weight, but none gets more than it can fill (its tokens times max_epochs). What a child can't fill goes to its
siblings by weight; since a node's own capacity is the sum of what its leaves may take (a leaf under a weight of 0 may take nothing), a shortage leaves a
family only if the whole family is short, and then its ancestors' other children share it. All budgets are whole tokens, rounded down.

A leaf takes as many full epochs as its budget holds, and of the next epoch the documents in the order of md5(seed:epoch:id) as long as
their running token count stays within the rest. The running count is taken over 4096 ranges of that order first, so that only the range
in which the budget ends is counted row by row; a leaf with a third of all rows is no single task's work.

Defined cases: a null language, source or text counts as ''; empty texts have no tokens and go with the documents before them in the order;
a leaf without any token is wholly within its rest, so its rows are taken once;
weights not given are 1; a weight of 0 or less takes nothing; repeated rows (equal ids) share one place in the order and go together;
an empty table gives no rows. Token counts times the sum of a node's children's weights must stay under 2 ** 63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

LEAF = ["_domain", "_lang", "_source"]
#: Leaves up to which the table of leaves is broadcast; beyond, joins are by sort and merge.
BROADCAST_LEAVES = 20_000


def domain_of(source: Column) -> Column:
    """The domain in the queries, as the tables have none: the number at the end of the name of a source, modulo 3."""
    number = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "([0-9]+)$", 1).try_cast("bigint")
    return F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % 3).cast("string"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weight_of(path: list[str], weights: dict[str, int]) -> Column:
    """The weight of a node: that of its path `domain/lang/source`, else of `*/.../name`, else 1."""
    known = F.create_map(*[F.lit(x) for kv in ({"": 1} | weights).items() for x in kv])
    name = path[-1]
    exact = F.concat_ws("/", *path)
    general = F.concat(F.lit("*/" * (len(path) - 1)), F.col(name))
    return F.greatest(F.coalesce(F.try_element_at(known, exact), F.try_element_at(known, general), F.lit(1)), F.lit(0)).cast("bigint")


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, weight, capacity, of the parent: budget) -> adds allotted. Children are filled in the order of capacity over weight; from the
    first that is not full on, what is left is shared by weight."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    family = Window.partitionBy(*parents)
    order = family.orderBy(ratio.asc_nulls_last(), name)
    out = nodes.withColumn("place", F.row_number().over(order))
    out = out.withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("shares", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = (F.col("weight") > 0) & (F.col("capacity") * F.col("shares") <= F.col("left") * F.col("weight"))
    out = out.withColumn("first", F.min(F.when(~full, F.col("place"))).over(family))
    for c in ("left", "shares"):
        out = out.withColumn(c, F.max(F.when(F.col("place") == F.col("first"), F.col(c))).over(family))
    even = F.coalesce(F.expr("CASE WHEN shares > 0 THEN (left * weight) div shares END"), F.lit(0))
    allotted = F.when(F.col("first").isNull() | (F.col("place") < F.col("first")), F.col("capacity")).otherwise(F.least(even, "capacity"))
    return out.withColumn("allotted", allotted).drop("place", "left", "shares", "first")


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, int]) -> DataFrame:
    """leaves (LEAF, tokens) -> adds budget."""
    per_mille = round(budget_share * 1000)
    spendable = F.lit(True)
    for depth in range(3):
        spendable &= weight_of(LEAF[: depth + 1], weights) > 0
    leaves = leaves.withColumn("capacity", F.when(spendable, F.col("tokens") * max_epochs).otherwise(0))
    above = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("c")).select(F.least(F.expr(f"(t * {per_mille}) div 1000"), "c").alias("budget"))
    for depth in range(3):
        parents, own = LEAF[:depth], LEAF[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(own, weights))
        nodes = nodes.join(above.hint("merge"), parents) if parents else nodes.crossJoin(F.broadcast(above))  # the budget of the root is one row
        above = share_out(nodes, parents, own[-1]).select(*own, F.col("allotted").alias("budget"))
    return leaves.join(above.hint("merge"), LEAF)


def with_leaf(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column, tokens: Column | None) -> DataFrame:
    out = docs.withColumn("_source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("_lang", F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
    return out.withColumn("_domain", domain).withColumn("_tokens", tokens if tokens is not None else word_count(F.col(text_col))).withColumn("_key_id", F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def order_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.col("_key_id")))


def copies() -> Column:
    """How often a row with the columns of its leaf's plan is taken."""
    within = F.coalesce((F.col("_range") < F.col("_end_range")) | ((F.col("_range") == F.col("_end_range")) & (F.col("_key") <= F.col("_last"))), F.lit(False))
    return F.col("_epochs") + (F.col("_end_range").isNull() | within).cast("bigint")  # only a leaf without tokens has no end range


def plan(base: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, int], seed: int) -> DataFrame:
    """Per leaf (LEAF, tokens, budget): _epochs taken in full, and up to which range and key the next one goes. base: (LEAF, _tokens, _key_id)."""
    leaves = base.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens"))
    leaves = budgets(leaves, budget_share, max_epochs, weights).withColumn("_epochs", F.coalesce(F.expr("CASE WHEN tokens > 0 THEN budget div tokens END"), F.lit(0)))
    leaves = materialise(leaves.withColumn("_rest", F.col("budget") - F.col("_epochs") * F.col("tokens")), "leaves")
    rows = joined(base, leaves).withColumn("_key", order_key(seed)).withColumn("_range", F.substring("_key", 1, 3))
    ranges = rows.groupBy(*LEAF, "_range", "_rest").agg(F.sum("_tokens").alias("t"))
    running = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    ends = ranges.withColumn("_upto", running).where("_upto > _rest").groupBy(*LEAF).agg(F.min(F.struct("_range", (F.col("_upto") - F.col("t")).alias("before"))).alias("e"))
    ends = materialise(ends.select(*LEAF, F.col("e._range").alias("_end_range"), F.col("e.before").alias("_before")), "ends")
    last = joined(rows, ends).where("_range = _end_range")
    taken = F.col("_before") + F.sum("_tokens").over(Window.partitionBy(*LEAF).orderBy("_key"))  # rows of equal keys together
    last = last.withColumn("_sum", taken).where("_sum <= _rest").groupBy(*LEAF).agg(F.max("_key").alias("_last"))
    return materialise(leaves.join(ends.hint("merge"), LEAF, "left").join(last.hint("merge"), LEAF, "left").drop("_rest", "_before", "capacity"), "plan")


def joined(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with their leaf's columns; a written table of leaves is broadcast only if its counted size allows it."""
    return rows.join(leaves.hint("broadcast" if leaves.count() <= BROADCAST_LEAVES else "merge"), LEAF)


def mix(docs: DataFrame, domain: Column, budget_share: float = 0.5, max_epochs: int = 2, weights: dict[str, int] | None = None, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """Per row: id, domain, lang, source, n_tokens, copies (how often the mixture takes it). domain: a column of docs that is never null."""
    leafed = with_leaf(docs, id_col, text_col, lang_col, source_col, domain, tokens)
    base = materialise(leafed.select(F.col(id_col).alias("_id"), *LEAF, "_tokens", "_key_id"), "tokens")
    leaves = plan(base, budget_share, max_epochs, weights or {}, seed)
    out = joined(base, leaves).withColumn("_key", order_key(seed)).withColumn("_range", F.substring("_key", 1, 3))
    return out.select(F.col("_id").alias(id_col), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), copies().alias("copies"))


def keep_mixed(docs: DataFrame, domain: Column, budget_share: float, weights: dict[str, int] | None = None, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that a mixture of one epoch takes, with all their columns. Leaves' plans come to the rows, so no text is shuffled."""
    names = [c for c in docs.columns]
    own = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), domain.alias("_d"), *[F.col(c).alias(a) for c, a in ((id_col, "_i"), (text_col, "_t"), (lang_col, "_l"), (source_col, "_s"))])
    leafed = with_leaf(own, "_i", "_t", "_l", "_s", F.col("_d"), None)
    base = materialise(leafed.select(*LEAF, "_tokens", "_key_id"), "tokens")
    leaves = plan(base, budget_share, 1, weights or {}, seed)
    out = joined(leafed.drop("_tokens"), leaves).withColumn("_key", order_key(seed)).withColumn("_range", F.substring("_key", 1, 3))
    return out.where(copies() > 0).select("_row.*")


#: The query's targets: domains 5 to 3 to 2, English double within each, one source half.
WEIGHTS = {"d0": 5, "d1": 3, "d2": 2, "*/en": 2, "*/*/src0": 1, "*/*/src1": 2, "*/*/src2": 2}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_of(F.col("source")), weights=WEIGHTS)


def _level_sql(name: str, parents: list[str], own: list[str], above: str, weight: str) -> str:
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    on = f"JOIN {above} a USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above} a"
    cols = ", ".join(own)
    return f"""
{name}_n AS (SELECT n.*, a.budget FROM (SELECT {cols}, sum(capacity)::BIGINT AS capacity, {weight} AS weight FROM leaves GROUP BY {cols}) n {on}),
{name}_o AS (SELECT *, row_number() OVER w AS place,
    budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM {name}_n WINDOW w AS ({part} ORDER BY capacity / weight::DOUBLE, {own[-1]})),
{name}_f AS (SELECT *, min(CASE WHEN NOT capacity * shares <= lft * weight THEN place END) OVER ({part}) AS fst FROM {name}_o),
{name}_g AS (SELECT *, max(CASE WHEN place = fst THEN lft END) OVER ({part}) AS l2, max(CASE WHEN place = fst THEN shares END) OVER ({part}) AS s2 FROM {name}_f),
{name} AS (SELECT {cols}, (CASE WHEN fst IS NULL OR place < fst THEN capacity ELSE least((l2 * weight) // s2, capacity) END)::BIGINT AS budget FROM {name}_g)"""


MIXING_SQL = (
    r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 3)::VARCHAR AS domain,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (2 * sum(n_tokens))::BIGINT AS capacity FROM base GROUP BY ALL),
root AS (SELECT least((sum(tokens) * 500) // 1000, sum(capacity))::BIGINT AS budget FROM leaves),"""
    + _level_sql("by_domain", [], ["domain"], "root", "CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 ELSE 2 END")
    + ","
    + _level_sql("by_lang", ["domain"], ["domain", "lang"], "by_domain", "CASE lang WHEN 'en' THEN 2 ELSE 1 END")
    + ","
    + _level_sql("by_source", ["domain", "lang"], ["domain", "lang", "source"], "by_lang", "CASE WHEN source IN ('src1', 'src2') THEN 2 ELSE 1 END")
    + """,
planned AS (SELECT l.*, s.budget, CASE WHEN tokens > 0 THEN s.budget // tokens ELSE 0 END AS epochs FROM leaves l JOIN by_source s USING (domain, lang, source)),
keyed AS (SELECT b.*, p.epochs, p.budget - p.epochs * p.tokens AS rest, md5('13:' || p.epochs::VARCHAR || ':' || b.doc_id::VARCHAR) AS k FROM base b JOIN planned p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
  (epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM keyed"""
)
