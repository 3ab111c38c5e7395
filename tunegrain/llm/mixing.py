"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

The tree is domain > language > source. Weights are propagated from the root: a node's budget is dealt to its
children in proportion to their weights, none getting more than all its leaves can give (their tokens
times ``epochs``). What a child can't take goes to its siblings first, as they share one budget; only
what a whole node can't take goes to the node's own siblings, one level up.

A leaf then takes its documents in a seeded order, epoch after epoch: all of them as often as its budget
allows, and in the last epoch the prefix of the order whose tokens still fit. The cut-off is found from
sums per bucket of the order, so no leaf is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.llm.shared import columns_of, materialize, unused

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Plan:
    """``percent``: token budget in hundredths of all tokens. ``epochs``: how often a document may be taken.

    ``domains`` maps a domain to a pattern its sources match (the first that fits; others are ``other``).
    Weights are whole numbers; names without one weigh 1. ``seed`` picks the order within a leaf.
    """

    percent: int = 60
    epochs: int = 2
    seed: str = "mix-1"
    domains: dict[str, str] = field(default_factory=lambda: {"crawl": "^src0$", "forum": "^src[1-9]$", "library": "^src1[0-9]$"})
    domain_weights: dict[str, int] = field(default_factory=lambda: {"crawl": 2, "forum": 3, "library": 4})
    language_weights: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    source_weights: dict[str, int] = field(default_factory=dict)


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, weight in weights.items():
        out = F.when(name == key, weight).otherwise(out)
    return out.cast("bigint")


def domain_of(source: Column, domains: dict[str, str]) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(domains.items()):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Deal each parent's ``budget`` to its children by ``weight``, at most ``most`` each; adds ``share``.

    Children that are full first (least ``most / weight``) come first; a child is full if, when the budget left
    by those before is dealt over it and all after it, its part reaches what it can take.
    """
    first = Window.partitionBy(*parent).orderBy(F.col("most") / F.col("weight"), name)
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    onward = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))
    dealt = children.withColumn("rest", left).withColumn("weights", F.sum("weight").over(onward))
    full = (F.col("most") * F.col("weights") <= F.col("rest") * F.col("weight")).cast("int")
    dealt = dealt.withColumn("full", full)
    # From the first child that isn't full on, all deal what the full ones left.
    every = Window.partitionBy(*parent)
    base = F.min(F.when(F.col("full") == 0, F.struct(F.col("most") / F.col("weight"), F.col(name), "rest", "weights"))).over(every)
    dealt = dealt.withColumn("base", base)
    share = F.when(F.col("full") == 1, F.col("most")).otherwise(F.expr("rest * weight div weights"))
    dealt = dealt.withColumn("rest", F.coalesce("base.rest", "rest")).withColumn("weights", F.coalesce("base.weights", "weights"))
    return dealt.withColumn("share", share).drop("rest", "weights", "full", "base")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``budget``: the tokens each shall give."""
    most = leaves.select("domain", "lang", "source", "tokens", (F.col("tokens") * plan.epochs).alias("most"))
    languages = most.groupBy("domain", "lang").agg(F.sum("most").alias("most"))
    domains = languages.groupBy("domain").agg(F.sum("most").alias("most"))
    total = leaves.agg(F.expr(f"sum(tokens) * {int(plan.percent)} div 100").alias("budget"))
    top = domains.withColumn("root", F.lit(0)).join(total.withColumn("root", F.lit(0)), "root").withColumn("weight", _weight(F.col("domain"), plan.domain_weights))
    top = _deal(top, ["root"], "domain").select("domain", F.col("share").alias("budget"))
    middle = languages.join(top, "domain").withColumn("weight", _weight(F.col("lang"), plan.language_weights))
    middle = _deal(middle, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = most.join(middle, ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), plan.source_weights))
    return _deal(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", F.col("share").alias("budget"))


def _cutoffs(rows: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf ``whole`` epochs and the last place in the seeded order (``cut``) that one more epoch takes, or null."""
    leaf = ["domain", "lang", "source"]
    parts = materialize(rows.groupBy(*leaf, F.substring("place", 1, 3).alias("part")).agg(F.sum("tokens").alias("tokens")), "mix-parts")
    leaves = parts.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    budget = materialize(budgets(leaves, plan), "mix-budgets")
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    budget = budget.select(*leaf, whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("spare"))
    before = Window.partitionBy(*leaf).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(budget, leaf)
    # The last part that begins within the spare tokens holds the cut; parts before it are taken whole.
    edge = parts.where("before <= spare").groupBy(*leaf).agg(F.max(F.struct("part", "before", "spare")).alias("e"))
    edge = materialize(edge.select(*leaf, "e.part", "e.before", "e.spare"), "mix-edges")
    inside = rows.withColumn("part", F.substring("place", 1, 3)).join(edge, [*leaf, "part"])
    running = F.sum("tokens").over(Window.partitionBy(*leaf, "part").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    fits = inside.withColumn("upto", F.col("before") + running).where("upto <= spare").groupBy(*leaf).agg(F.max("place").alias("cut"))
    # If nothing of the edge part fits, the cut lies just before that part.
    cuts = budget.join(edge.select(*leaf, "part"), leaf, "left").join(fits, leaf, "left")
    return materialize(cuts.select(*leaf, "whole", F.coalesce("cut", "part").alias("cut")), "mix-cuts")


def _placed(documents: DataFrame, plan: Plan) -> DataFrame:
    place = F.md5(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return documents.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"),
        domain_of(source, plan.domains).alias("domain"), token_count(F.col("text").cast("string")).alias("tokens"), place.alias("place"),
    )


def select(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Per document that is taken: ``doc_id``, ``domain``, ``lang``, ``source``, ``tokens``, ``times`` (1 to ``epochs``).

    A null language or source is the leaf with an empty name; a null id has the first name's place. Rows that repeat an
    id stand at one place of the order and are taken together or not at all. Documents without words cost
    nothing and are taken up to the cut like others. An empty table gives an empty result. Other columns are ignored.
    """
    rows = materialize(_placed(documents, plan), "mix-rows")
    cuts = _cutoffs(rows, plan)
    times = (F.col("whole") + F.coalesce(F.col("place") <= F.col("cut"), F.lit(False)).cast("bigint")).alias("times")
    taken = rows.join(cuts, ["domain", "lang", "source"])
    return taken.select("doc_id", "domain", "lang", "source", "tokens", F.least(times, F.lit(plan.epochs)).cast("bigint").alias("times")).where("times > 0")


def take(documents: DataFrame, plan: Plan) -> DataFrame:
    """The documents themselves, each as often as it is taken; the text isn't shuffled if the table of leaves is small."""
    rows = materialize(_placed(documents, plan), "mix-rows")
    cuts = _cutoffs(rows, plan)
    names = {c: unused(documents, f"leaf_{c}") for c in ("domain", "lang", "source", "whole", "cut", "place")}
    cuts = cuts.select([F.col(c).alias(names[c]) for c in ("domain", "lang", "source", "whole", "cut")])
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    own = documents.withColumn(names["place"], F.md5(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    same = (
        (domain_of(source, plan.domains) == F.col(names["domain"]))
        & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col(names["lang"]))
        & (source == F.col(names["source"]))
    )
    times = F.least(F.col(names["whole"]) + F.coalesce(F.col(names["place"]) <= F.col(names["cut"]), F.lit(False)).cast("bigint"), F.lit(plan.epochs))
    taken = own.join(cuts, same).where(times > 0)
    if plan.epochs > 1:
        taken = taken.withColumn(names["whole"], F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return taken.select(*columns_of(documents))
