"""Metrics of base/relevant/irrelevant triplets. Every metric is one grouped aggregate over the pivoted triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import first_filled, preference
from ..schemas import STATES, VARIANTS

LETTER = {"base": "b", "relevant": "r", "irrelevant": "i"}


def gold_pivot(rows: DataFrame, seq: Column, value: str = "expected_preference") -> DataFrame:
    """triplet_id with base, relevant, irrelevant and factor: later rows overwrite gold, the first one names the factor."""
    wanted = [F.max_by(value, F.when(F.col("variant") == v, seq)).alias(v) for v in VARIANTS]
    return rows.groupBy("triplet_id").agg(*wanted, F.min_by("factor", seq).alias("factor"))


def pivoted(judgments: DataFrame, seq: Column, parsed_first: bool = False) -> DataFrame:
    """(model_id, triplet_id) with y_b, y_r, y_i: the last row of each variant with status ok.

    parsed_first drops rows without a preference before the last one is taken, so a later unparsed row can't hide a good one.
    One shuffle; the pivot is conditional aggregation.
    """
    rows = judgments.where("status = 'ok'").withColumn("_p", preference("parsed_preference"))
    if parsed_first:
        rows = rows.where("_p is not null")
    last = [F.max_by(F.struct("_p"), F.when(F.col("variant") == v, seq)).alias(f"_{v}") for v in VARIANTS]
    return rows.groupBy("model_id", "triplet_id").agg(*last).select("model_id", "triplet_id", *[F.col(f"_{v}._p").alias(f"y_{LETTER[v]}") for v in VARIANTS])


def complete(triplets: DataFrame, gold: DataFrame) -> DataFrame:
    """Triplets with all three preferences and gold, with gold g_* and correctness c_* as 0 or 1."""
    gold = gold.select("triplet_id", "factor", *[F.col(v).alias(f"g_{LETTER[v]}") for v in VARIANTS])
    both = triplets.where("y_b is not null and y_r is not null and y_i is not null").join(gold, "triplet_id")
    return both.withColumns({f"c_{x}": (F.col(f"y_{x}") == F.col(f"g_{x}")).cast("int") for x in LETTER.values()})


def audit_metrics(done: DataFrame) -> DataFrame:
    """n, n_cond, base_acc, joint and conditional rates by model and factor; a rate over nothing is null."""
    given = lambda c: F.avg(F.when(F.col("c_b") == 1, F.col(c)))
    return done.groupBy("model_id", "factor").agg(
        F.count("*").alias("n"),
        F.sum("c_b").alias("n_cond"),
        F.avg("c_b").alias("base_acc"),
        F.avg(F.col("c_b") * F.col("c_r")).alias("PFC"),
        F.avg(F.col("c_b") * F.col("c_i")).alias("PSC"),
        given("c_r").alias("PFC_cond"),
        given("c_i").alias("PSC_cond"),
    )


def static_accuracy(rows: DataFrame) -> DataFrame:
    """A and n by model and factor over parsed rows with usable gold; gold has two names."""
    gold = preference(first_filled("expected_preference", "gold_preference"))
    rows = rows.where("status = 'ok'").select("model_id", "factor", preference("parsed_preference").alias("p"), gold.alias("g")).where("p is not null and g is not null")
    return rows.groupBy("model_id", "factor").agg(F.avg((F.col("p") == F.col("g")).cast("int")).alias("A"), F.count("*").alias("n"))


def utility(selections: DataFrame) -> DataFrame:
    """U, n_pools and the abstention rate by model, factor and N in 2, 4, 8."""
    rows = selections.where("status = 'ok' and n in (2, 4, 8)").withColumn("_s", F.coalesce("utility_success", "success")).where("_s is not null")
    abstained = F.sum(F.coalesce("semantic_abstentions", F.lit(0))) / F.nullif(F.sum(F.coalesce("n_pairs", F.lit(0))), F.lit(0))
    return rows.groupBy("model_id", "factor", F.col("n").alias("N")).agg(F.avg(F.col("_s").cast("int")).alias("U"), F.count("*").alias("n_pools"), abstained.alias("semantic_abstention_rate"))


def weighted_mean(value: str, weight: str) -> Column:
    """Micro average: sum of value * weight over the weights of rows that have a value."""
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0))


def state(prefix: str = "c_") -> Column:
    return F.concat(*[F.col(f"{prefix}{x}").cast("string") for x in ("b", "r", "i")])


def eight_states(done: DataFrame, keys: tuple[str, ...] = ("model_id", "factor")) -> DataFrame:
    """Counts and shares of the eight correctness states, and the rates they imply."""
    out = done.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(state() == s).alias(f"n_{s}") for s in STATES])
    base = F.col("n_100") + F.col("n_101") + F.col("n_110") + F.col("n_111")
    relevant, irrelevant = F.col("n_110") + F.col("n_111"), F.col("n_101") + F.col("n_111")
    none = F.lit(0)
    out = out.withColumn("n_B1", base).withColumns({
        "base_accuracy": F.col("n_B1") / F.nullif(F.col("n"), none), "RA": relevant / F.nullif(F.col("n_B1"), none), "II": irrelevant / F.nullif(F.col("n_B1"), none),
        "PFC": relevant / F.nullif(F.col("n"), none), "PSC": irrelevant / F.nullif(F.col("n"), none),
    })
    return out.withColumns({f"pi_{s}": F.col(f"n_{s}") / F.nullif(F.col("n"), none) for s in STATES})


def eight_states_long(done: DataFrame) -> DataFrame:
    """A row for each model, factor and state, states without triplets too."""
    wide = eight_states(done)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"n_{s}").alias("count"), F.col(f"pi_{s}").alias("share")) for s in STATES]))
    return wide.select("model_id", "factor", each.alias("e")).select("model_id", "factor", "e.*")


def flip_rates(done: DataFrame) -> DataFrame:
    flip = lambda x: F.avg((F.col(f"y_{x}") != F.col("y_b")).cast("int"))
    return done.groupBy("model_id", "factor").agg(F.count("*").alias("n"), flip("r").alias("F_R"), flip("i").alias("F_I"))


def transition_matrix(done: DataFrame) -> DataFrame:
    """Counts and shares of (base, arm) predictions for both arms, zero cells too."""
    cells = [(arm, b, y) for arm in ("r", "i") for b in "AB" for y in "AB"]
    counts = done.groupBy("model_id", "factor").agg(F.count("*").alias("_n"), *[F.count_if((F.col("y_b") == b) & (F.col(f"y_{arm}") == y)).alias(f"_{arm}{b}{y}") for arm, b, y in cells])
    names = {"r": "relevant", "i": "irrelevant"}
    each = F.explode(F.array(*[F.struct(F.lit(names[arm]).alias("arm"), F.lit(b).alias("Y_B"), F.lit(y).alias("Y_arm"), F.col(f"_{arm}{b}{y}").alias("n")) for arm, b, y in cells]))
    return counts.select("model_id", "factor", "_n", each.alias("e")).select("model_id", "factor", "e.*", (F.col("e.n") / F.nullif(F.col("_n"), F.lit(0))).alias("proportion"))


def flip_decomposition(done: DataFrame) -> DataFrame:
    """For each arm: counts of base right or wrong, arm right or wrong, prediction flipped or not."""
    parts = []
    for arm, name in (("r", "relevant"), ("i", "irrelevant")):
        cell = lambda b, a, f, arm=arm: F.count_if((F.col("c_b") == b) & (F.col(f"c_{arm}") == a) & ((F.col(f"y_{arm}") != F.col("y_b")) == F.lit(bool(f))))
        cells = [cell(b, a, f).alias(f"base{b}_arm{a}_flip{f}") for b in (0, 1) for a in (0, 1) for f in (0, 1)]
        parts.append(done.groupBy("model_id", "factor").agg(F.lit(name).alias("arm"), F.count("*").alias("n"), *cells))
    return parts[0].unionByName(parts[1])


def change_rates(decomposed: DataFrame) -> DataFrame:
    """P(prediction changes) and P(correctness changes) from the decomposition's columns."""
    flips = [F.col(f"base{b}_arm{a}_flip1") for b in (0, 1) for a in (0, 1)]
    crossed = [F.col(f"base{b}_arm{1 - b}_flip{f}") for b in (0, 1) for f in (0, 1)]
    return decomposed.select("model_id", "factor", "arm", (sum(flips[1:], flips[0]) / F.col("n")).alias("p_dY"), (sum(crossed[1:], crossed[0]) / F.col("n")).alias("p_dC"))


def irrelevant_transitions(done: DataFrame) -> DataFrame:
    """Rates of the four correctness transitions of the irrelevant arm, and of gold changes in both arms."""
    rate = lambda b, i: F.avg(((F.col("c_b") == b) & (F.col("c_i") == i)).cast("int"))
    changed = lambda x: F.avg((F.col(f"g_{x}") != F.col("g_b")).cast("int"))
    return done.groupBy("model_id", "factor").agg(*[rate(b, i).alias(f"p_{b}{i}") for b in (0, 1) for i in (0, 1)], changed("r").alias("gold_change_relevant"), changed("i").alias("gold_change_irrelevant"))


def bookkeeping(judgments: DataFrame, gold: DataFrame, seq: Column) -> DataFrame:
    """By model: rows by status, ok rows without a preference, triplets, incomplete ones and those without gold."""
    rows = judgments.groupBy("model_id").agg(F.count("*").alias("rows"), F.count_if(F.expr("status = 'ok'")).alias("ok"), F.count_if(F.expr("status <> 'ok'")).alias("not_ok"), F.count_if(F.expr("status = 'ok'") & preference("parsed_preference").isNull()).alias("ok_unparsed"))
    triplets = pivoted(judgments, seq).join(gold.select("triplet_id", F.lit(True).alias("_gold")), "triplet_id", "left")
    whole = F.expr("y_b is not null and y_r is not null and y_i is not null")
    counts = triplets.groupBy("model_id").agg(F.count("*").alias("triplets"), F.count_if(~whole).alias("incomplete"), F.count_if(F.col("_gold").isNull()).alias("without_gold"))
    return rows.join(counts, "model_id", "left")


def parse_gate(judgments: DataFrame, least_parsed: float = 0.5, ceiling: float = 0.98, floor: float = 0.02) -> DataFrame:
    """Parse rate and share of A by model, and whether the model passes both gates."""
    p = preference("parsed_preference")
    out = judgments.groupBy("model_id").agg(F.count("*").alias("n"), F.avg(p.isNotNull().cast("int")).alias("parse_rate"), F.avg((p == "A").cast("int")).alias("a_rate"))
    return out.withColumn("passes", (F.col("parse_rate") >= least_parsed) & F.col("a_rate").between(floor, ceiling))


def selection_stability(selections: DataFrame) -> DataFrame:
    """How often two pool sizes select the same candidate, over pools that have both."""
    wide = selections.groupBy("model_id", "pool_id").agg(*[F.max(F.when(F.col("n") == k, F.col("selected_uid"))).alias(f"_{k}") for k in (2, 4, 8)])
    same = lambda a, b: F.avg((F.col(f"_{a}") == F.col(f"_{b}")).cast("int")).alias(f"n{a}_eq_n{b}")
    return wide.groupBy("model_id").agg(F.count("*").alias("pools"), same(2, 8), same(4, 8), same(2, 4))
