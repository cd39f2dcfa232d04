"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source. A node can supply `max_epochs` times its tokens, and a parent what its children can. Target weights may be
given for nodes of any level, as shares among siblings; siblings without one share what is left of one by their tokens to a power. Budgets go
down: each parent divides its own among its children in proportion to their weights; what a child cannot supply goes to its siblings, and only
what all of them cannot supply goes up. A leaf reads whole seeded epochs and, of the last, the prefix whose tokens first reach its budget.

Leaves are aggregated with map-side sums. Prefix sums go by buckets of the seeded order, so that no leaf, however hot, is sorted in one
task: buckets below the budget's end are taken whole, and only the bucket at the end is ordered. Siblings are divided in one task per parent:
a row for each domain, language and source, not for documents.

Defined results: null text has no tokens and is in every whole epoch, but in a prefix only before the budget is reached; null domains,
languages and sources are nodes like any other; rows of one id and epoch are in the order of a hash of their texts, and repeated rows are separate
rows of equal order; very long texts are one step of a prefix; the input row travels as one column, so that no name clashes; an empty table
gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.tables import cut
from skein.llm.text import WORD

LEVELS = ("domain", "lang", "source")
ANY = "*"
#: Leaves up to this many are broadcast; beyond, they are joined by key.
BROADCAST_LEAVES = 100_000
LEAST = 1e-9


@dataclass(frozen=True)
class Mix:
    budget_share: float = 0.8  # of all tokens
    max_epochs: int = 3
    temperature: float = 0.5  # of a node without a target
    targets: dict[tuple[str, ...], float] = field(default_factory=dict)  # by the names from the top; ANY in front: under every parent
    seed: int = 7


#: What the query and the pipeline mix to: shares of domains, of languages in every domain, and of two sources among their siblings.
TARGETS = {
    ("domain0",): 0.4,
    ("domain1",): 0.3,
    ("domain2",): 0.2,
    (ANY, "en"): 0.5,
    (ANY, "de"): 0.2,
    ("domain0", "fr"): 0.2,
    (ANY, ANY, "src0"): 0.3,
    ("domain1", "en", "src5"): 0.4,
}


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The synthetic tables have no domain: sources that end in a number are dealt to four by it, others are a domain of their own."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", source).otherwise(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")))


def _targets(nodes: DataFrame, keys: list[str], plan: Mix) -> DataFrame:
    """nodes with `target`, null where none is given; a target with fewer ANYs goes first."""
    of = {path: w for path, w in plan.targets.items() if len(path) == len(keys)}
    out, found = nodes, [F.lit(None).cast("double")]
    for k, mask in enumerate(sorted({tuple(x == ANY for x in path) for path in of}, key=sum)):
        named = [key for key, star in zip(keys, mask) if not star]
        rows = [(*(x for x in path if x != ANY), float(w)) for path, w in of.items() if tuple(x == ANY for x in path) == mask]
        table = nodes.sparkSession.createDataFrame(rows, ", ".join([f"{n}_t string" for n in named] + [f"t{k} double"]))
        out = out.join(F.broadcast(table), [F.col(n) == F.col(f"{n}_t") for n in named], "left").drop(*[f"{n}_t" for n in named])
        found.insert(k, F.col(f"t{k}"))
    return out.withColumn("target", F.coalesce(*found)).drop(*[f"t{k}" for k in range(len(found) - 1)])


def _divide(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes has weight, supply and given (the parent's budget); adds `budget`.

    Ordered by supply per weight, a prefix of the children is exhausted; the first child that is not fixes the level for the rest.
    """
    by = W.partitionBy(*parent).orderBy("ratio", *LEVELS)
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = nodes.withColumn("ratio", F.col("supply") / F.col("weight"))
    taken = F.sum("supply").over(by.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("level", (F.col("given") - F.coalesce(taken, F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    level = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    return out.withColumn("budget", F.least("supply", F.coalesce(level * F.col("weight"), F.col("supply")))).drop("ratio", "level")


def budgets(leaves: DataFrame, plan: Mix) -> DataFrame:
    """leaves (three levels, n_tokens, n_rows) with each leaf's budget."""
    leaves = leaves.withColumn("supply", F.col("n_tokens") * float(plan.max_epochs))
    own = F.greatest(F.pow(F.col("n_tokens").cast("double"), F.lit(plan.temperature)), F.lit(LEAST))
    total = leaves.agg(F.sum("n_tokens")).first()[0] or 0
    given = table = leaves
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("supply").alias("supply"))
        if depth == 1:
            nodes = nodes.withColumn("given", F.lit(total * plan.budget_share))
        else:
            up = given.select(*[F.col(k).alias(f"{k}_up") for k in keys[:-1]], "given")
            same = [F.col(k).eqNullSafe(F.col(f"{k}_up")) for k in keys[:-1]]
            nodes = nodes.join(up, same, "inner").drop(*[f"{k}_up" for k in keys[:-1]])
        parent = W.partitionBy(*(keys[:-1] or [F.lit(0)]))
        nodes = _targets(nodes, keys, plan).withColumn("own", own)
        left = F.greatest(1 - F.coalesce(F.sum("target").over(parent), F.lit(0.0)), F.lit(0.0))
        free = F.sum(F.when(F.col("target").isNull(), F.col("own"))).over(parent)
        nodes = nodes.withColumn("weight", F.greatest(F.coalesce("target", left * F.col("own") / free), F.lit(LEAST))).drop("own", "target")
        for k in LEVELS[depth:]:
            nodes = nodes.withColumn(k, F.lit(None).cast("string"))
        table = _divide(nodes, keys[:-1] or [F.lit(0)])
        given = table.select(*keys, F.col("budget").alias("given"))
    named = table.select(*[F.col(k).alias(f"{k}_b") for k in LEVELS], "budget")
    return leaves.join(named, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in LEVELS]).select(*LEVELS, "n_tokens", "n_rows", "budget")


def mix(docs: DataFrame, plan: Mix = Mix(), domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(row, domain, n_tokens, epoch): the input's rows, as structs, once for each epoch (from 0) that holds them."""
    domain = domain_of(F.col(source_col)) if domain is None else domain
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("tie"),
        domain.cast("string").alias("domain"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        tokens(F.col(text_col)).alias("tokens"),
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    leaves = budgets(cut(leaves), plan).withColumn("whole", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens"))).otherwise(1).cast("int"))
    leaves = leaves.withColumn("rest", F.col("budget") - F.col("whole") * F.col("n_tokens"))
    leaves = cut(leaves.withColumn("buckets", F.ceil(F.sqrt("n_rows") / 8)).select(*[F.col(k).alias(f"{k}_l") for k in LEVELS], "whole", "rest", "buckets"))
    few = leaves.count() <= BROADCAST_LEAVES
    same = [F.col(k).eqNullSafe(F.col(f"{k}_l")) for k in LEVELS]
    with_leaf = lambda df, right: df.join(F.broadcast(right) if few else right, same, "inner").drop(*[f"{k}_l" for k in LEVELS])

    # the seeded order of the last epoch: 52 bits of a digest, as a share of one
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.col("id").cast("string"))), 1, 13)
    placed = with_leaf(rows, leaves).withColumn("spot", F.conv(digits, 16, 10).cast("long"))
    placed = placed.withColumn("bucket", F.floor(F.col("spot") / F.lit(float(2**52)) * F.col("buckets")).cast("long"))

    sums = placed.where("rest > 0").groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest")))
    ends = ends.groupBy(*[F.col(k).alias(f"{k}_l") for k in LEVELS]).agg(F.min("bucket").alias("end"), F.min_by("before", "bucket").alias("before"))
    marked = with_leaf(placed, cut(leaves.select(*[F.col(f"{k}_l").alias(k) for k in LEVELS]).join(ends, same, "left").select(*[F.col(k).alias(f"{k}_l") for k in LEVELS], "end", "before")))

    epochs = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("epoch")
    kept = ["row", "domain", F.col("tokens").alias("n_tokens")]
    below = (F.col("rest") > 0) & (F.col("end").isNull() | (F.col("bucket") < F.col("end")))
    plain = marked.select(*kept, epochs(F.col("whole") + below.cast("int")))
    at_end = marked.where((F.col("rest") > 0) & (F.col("bucket") == F.col("end")))
    order = W.partitionBy(*LEVELS).orderBy("spot", "id", "tie").rowsBetween(W.unboundedPreceding, -1)
    last = at_end.withColumn("sum", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("sum < rest").select(*kept, F.col("whole").alias("epoch"))
    return plain.unionByName(last)


def mixed(docs: DataFrame, plan: Mix = Mix(), **args) -> DataFrame:
    """docs' columns of the rows that mix() takes."""
    return mix(docs, plan, **args).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs, Mix(targets=TARGETS)).select("row.doc_id", "domain", "row.lang", "row.source", "n_tokens", "epoch")
