"""Best-of-N: candidate pools, nested subsets, preference graphs, Copeland winners and tournament statistics.

A pool has eight candidates, so its pairs and triples are built from one bounded array with higher-order functions: a single
shuffle on the pool, and no self-join. Salts are parameters; a published protocol's salts give its selections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import candidate_uid, first_filled, normal, oriented, pair_outcome, preference, score_outcome, sha
from .merging import growing

SIZES = (2, 4, 8)


def candidates(pools: DataFrame) -> DataFrame:
    """A row for each candidate: pool_id, uid, index, text, is_gold, and what is wrong with its pool (null: nothing)."""
    gold = normal(first_filled("gold_answer", "gold"))
    pool = first_filled(*[c for c in ("pool_id", "item_id", "question_id") if c in pools.columns])
    texts = F.transform("candidates", lambda c: normal(c["text"]))
    uids = F.transform("candidates", lambda c, i: candidate_uid(i, c["text"], c["candidate_uid"]))
    hits = F.size(F.filter(texts, lambda t: t == gold))
    wrong = (
        F.when(pool.isNull(), "no pool id")
        .when(F.coalesce(F.size("candidates"), F.lit(-1)) != 8, "not exactly 8 candidates")
        .when(F.coalesce(F.nullif(F.col("n_pool"), F.lit(0)), F.lit(8)) != 8, "n_pool is not 8")
        .when(F.coalesce(gold, F.lit("")) == "", "no gold answer")
        .when(F.exists(texts, lambda t: F.coalesce(t, F.lit("")) == ""), "a candidate has no text")
        .when(F.size(F.array_distinct(texts)) != 8, "a candidate text is repeated")
        .when(F.size(F.array_distinct(uids)) != 8, "a candidate uid is repeated")
        .when(hits != 1, "not exactly one gold candidate")
        .when(F.col("gold_index").isNotNull() & (F.col("gold_index") != F.array_position(texts, gold) - 1), "gold_index is not the gold candidate")
    )
    rows = pools.select("*", pool.alias("_pool"), wrong.alias("problem"), gold.alias("_gold"), F.posexplode_outer("candidates").alias("index", "_c"))
    uid = candidate_uid("index", F.col("_c.text"), F.col("_c.candidate_uid"))
    return rows.select(F.col("_pool").alias("pool_id"), uid.alias("uid"), F.col("index").cast("int").alias("index"), F.col("_c.text").alias("text"), (normal(F.col("_c.text")) == F.col("_gold")).alias("is_gold"), "problem")


def checked(cands: DataFrame) -> DataFrame:
    """The same rows, but a pool with a problem raises."""
    message = F.concat(F.lit("pool "), F.coalesce("pool_id", F.lit("?")), F.lit(": "), F.col("problem"))
    return cands.withColumn("uid", F.when(F.col("problem").isNull(), F.col("uid")).otherwise(F.raise_error(message).cast("string"))).drop("problem")


def with_levels(cands: DataFrame, salt: str = "subset", keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """level: the smallest nested subset that holds the candidate. Gold is in all; the others come in hash order."""
    order = Window.partitionBy(*keys, "is_gold").orderBy(sha(F.lit(salt), "pool_id", "uid"))
    rank = F.when(F.col("is_gold"), 0).otherwise(F.row_number().over(order))
    return cands.withColumn("level", F.when(rank <= 1, 2).when(rank <= 3, 4).otherwise(8))


def subsets(levels: DataFrame) -> DataFrame:
    """(pool_id, n, uid) for the nested subsets of 2, 4 and 8."""
    return levels.withColumn("n", F.explode(F.array(*[F.lit(n) for n in SIZES]))).where("n >= level")


def spread(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """df dealt by keys into as many partitions as shuffles have. Pools are small rows of which much is made, so partitions that
    adaptive execution would join by size are to stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pool_pairs(cands: DataFrame, extra: tuple[str, ...] = (), salt: str = "orientation", keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """Every unordered pair of a pool, oriented by a salted digest: left_uid, right_uid, and extra columns of both sides.

    The digest is taken before the pairs become rows: after that, each column that asks which end is left would take it anew.
    """
    fields = ("uid", *extra)
    pools = spread(cands, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_c"))
    later = lambda a, i: F.transform(F.slice("_c", i + 2, F.size("_c")), lambda b: F.struct(a.alias("a"), b.alias("b"), oriented("pool_id", a["uid"], b["uid"], salt)[0].alias("left")))
    rows = pools.select(*keys, F.explode(F.flatten(F.transform("_c", later))).alias("p"))
    first = F.col("p.left") == F.col("p.a.uid")
    rows = rows.withColumns({"left_uid": F.col("p.left"), "right_uid": F.coalesce(F.when(first, F.col("p.b.uid")).otherwise(F.col("p.a.uid")), F.col("p.left"))})
    pick = lambda f, side: F.when(first == F.lit(side == "left"), F.col(f"p.a.{f}")).otherwise(F.col(f"p.b.{f}")).alias(f"{side}_{f}")
    return rows.select(*keys, "left_uid", "right_uid", *[pick(f, side) for f in extra for side in ("left", "right")])


def scalar_graph(cands: DataFrame, score: str = "score", salt: str = "orientation", keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """The complete graph that native scores imply; equal scores tie. level is the smallest subset that holds both ends."""
    edges = pool_pairs(cands, (score, "level", "is_gold"), salt, keys)
    outcome = score_outcome(F.col(f"left_{score}"), F.col(f"right_{score}"))
    return edges.withColumns({"outcome": outcome, "level": F.greatest("left_level", "right_level"), "status": F.lit("ok")})


def induced_edges(edges: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """Edges of each nested subset: both ends must be members. A subset is one row, so the edges are dealt out once, by pool."""
    ends = members.groupBy(*keys, "n").agg(F.collect_set("uid").alias("_in"))
    both = F.array_contains("_in", F.col("left_uid")) & F.array_contains("_in", F.col("right_uid"))
    return edges.join(growing(ends), list(keys)).where(both).drop("_in")


def points(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Copeland points: 1 for a win, a half each for a tie or an abstention; another outcome raises."""
    known = F.when(F.col("outcome").isin("left", "right", "tie", "abstain"), F.col("outcome")).otherwise(F.raise_error(F.lit("unknown outcome")).cast("string"))
    half = F.when(known.isin("tie", "abstain"), 0.5)
    sides = F.array(
        F.struct(F.col("left_uid").alias("uid"), F.coalesce(half, F.when(known == "left", 1.0).otherwise(0.0)).alias("p")),
        F.struct(F.col("right_uid").alias("uid"), F.coalesce(half, F.when(known == "right", 1.0).otherwise(0.0)).alias("p")),
    )
    return edges.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, F.col("s.uid").alias("uid")).agg(F.sum("s.p").alias("points"))


def copeland(edges: DataFrame, keys: tuple[str, ...] = ("pool_id", "n"), salt: str = "tie") -> DataFrame:
    """The winner of each graph: most points, then the smallest salted digest. An incomplete graph raises.

    A graph is complete if every node has met every other one once; edges, ties and abstentions are half the nodes' sums.
    """
    half = F.col("outcome").isin("tie", "abstain")
    known = F.when(F.col("outcome").isin("left", "right", "tie", "abstain"), F.col("outcome")).otherwise(F.raise_error(F.lit("unknown outcome")).cast("string"))
    side = lambda own, other, name: F.struct(F.col(own).alias("uid"), F.col(other).alias("met"), F.when(half, 0.5).when(known == name, 1.0).otherwise(0.0).alias("p"))
    ends = edges.select(*keys, half.cast("int").alias("_t"), (F.col("outcome") == "abstain").cast("int").alias("_a"), F.explode(F.array(side("left_uid", "right_uid", "left"), side("right_uid", "left_uid", "right"))).alias("s"))
    nodes = ends.groupBy(*keys, F.col("s.uid").alias("uid")).agg(F.sum("s.p").alias("points"), F.count("*").alias("_edges"), F.size(F.collect_set("s.met")).alias("_met"), F.sum("_t").alias("_t"), F.sum("_a").alias("_a"), F.count_if(F.col("s.met") == F.col("s.uid")).alias("_self"))
    order = F.struct((-F.col("points")).alias("p"), sha(F.lit(salt), "pool_id", "uid").alias("h"))
    out = nodes.groupBy(*keys).agg(
        F.min_by("uid", order).alias("selected_uid"),
        F.max("points").alias("top"),
        F.count("*").alias("_nodes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("uid", "points")))).alias("scores"),
        *[(F.sum(c) / 2).cast("long").alias(name) for c, name in (("_edges", "n_pairs"), ("_t", "ties"), ("_a", "semantic_abstentions"))],
        F.min("_met").alias("_least"),
        F.max("_edges").alias("_most"),
        F.sum("_self").alias("_self"),
    )
    tied = F.size(F.filter(F.map_values("scores"), lambda v: v == F.col("top"))) > 1
    whole = (F.col("_least") == F.col("_nodes") - 1) & (F.col("_most") == F.col("_nodes") - 1) & (F.col("_self") == 0)
    selected = F.when(whole, F.col("selected_uid")).otherwise(F.raise_error(F.concat(F.lit("incomplete pair graph in pool "), F.col("pool_id"))).cast("string"))
    return out.select(*keys, selected.alias("selected_uid"), "scores", "n_pairs", "ties", "semantic_abstentions", tied.alias("tie_break_applied"))


def selections(cands: DataFrame, graph: DataFrame, keys: tuple[str, ...] = ("pool_id",), salt: str = "tie") -> DataFrame:
    """Winners of the 2-, 4- and 8-subsets from one graph; success means that the winner is gold.

    Edges carry their level, so a subset's edges are a filter and the graph is built once for all sizes.
    """
    edges = graph.withColumn("n", F.explode(F.array(*[F.lit(n) for n in SIZES]))).where("n >= level")
    gold = cands.where("is_gold").select(*keys, F.col("uid").alias("gold_uid"))
    return copeland(edges, (*keys, "n"), salt).join(growing(gold), list(keys)).withColumn("success", F.col("selected_uid") == F.col("gold_uid"))


def winners(pairs: DataFrame) -> DataFrame:
    """winner and loser of each row, by outcome, else by preference; null where neither decides."""
    ok = F.col("status") == "ok"
    side = F.when(ok & F.col("outcome").isin("left", "right"), F.col("outcome")).when(ok & preference("parsed_preference").isNotNull(), pair_outcome("parsed_preference"))
    return pairs.withColumns({"winner": F.when(side == "left", F.col("left_uid")).when(side == "right", F.col("right_uid")), "loser": F.when(side == "left", F.col("right_uid")).when(side == "right", F.col("left_uid"))})


def tournament(decided: DataFrame, keys: tuple[str, ...] = ("pool_id",), strict: bool = False) -> DataFrame:
    """Cycle triples, transitivity violations, Condorcet winners and the Copeland margin of each pool.

    Nodes are the ends of decided edges, 63 at most, numbered in order; whom a node beats, and who beats it, are the bits of an
    integer each, or-ed from edge rows. Pairs i < j of a pool are rows too, and bit arithmetic counts the triples with a third node
    beyond them: all of it is compiled and stays in the partition of its pool. Of each sorted triple only the chains a > b > c and
    c > b > a are tested for transitivity. strict counts a cycle only if no edge of it has its reverse.
    """
    pools = spread(decided.where("winner is not null"), keys).groupBy(*keys).agg(F.count("*").alias("n_edges"), F.collect_set(F.struct("winner", "loser")).alias("_beats"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("winner", "loser"))))).alias("_nodes"))
    few = F.when(F.size("_nodes") <= 63, F.col("_nodes")).otherwise(F.raise_error(F.lit("a pool has more than 63 candidates")).cast("array<string>"))
    edges = pools.select(*keys, "n_edges", few.alias("_nodes"), F.inline_outer("_beats"))
    edges = edges.select(*keys, "n_edges", *[(F.array_position("_nodes", F.col(c)) - 1).cast("int").alias(c) for c in ("winner", "loser")])
    bit = lambda i: F.expr(f"shiftleft(1L, {i})")
    none = F.lit(0).cast("long")
    ends = edges.select(*keys, "n_edges", F.inline(F.array(F.struct(F.col("winner").alias("at"), bit("loser").alias("out"), none.alias("into")), F.struct(F.col("loser").alias("at"), none.alias("out"), bit("winner").alias("into")))))
    nodes = ends.groupBy(*keys, "n_edges", "at").agg(F.bit_or("out").alias("out"), F.bit_or("into").alias("into"))
    graphs = nodes.groupBy(*keys, "n_edges").agg(F.sort_array(F.collect_list(F.struct("at", "out", "into"))).alias("g"))
    n, wins = F.size("g"), F.reverse(F.array_sort(F.transform("g", lambda x: F.bit_count(x["out"]))))
    graphs = graphs.select(*keys, "n_edges", n.alias("n_nodes"), wins.alias("wins"), "g")
    pairs = graphs.select("*", F.explode(F.sequence(F.lit(0), n * n - 1)).alias("p")).select("*", F.expr("p div n_nodes").cast("int").alias("i"), F.expr("p % n_nodes").alias("j")).where("i < j OR p = 0")
    pairs = pairs.select(*keys, "n_edges", "n_nodes", "wins", "i", "j", *[F.get("g", F.col(k))[c].alias(f"{c}_{k}") for k in "ij" for c in ("out", "into")])
    own, met = (lambda k: f"(out_{k} & ~into_{k})", lambda k: f"(into_{k} & ~out_{k})") if strict else (lambda k: f"out_{k}", lambda k: f"into_{k}")
    has = lambda x, k: f"((shiftrightunsigned({x}, {k}) & 1L) = 1L)"
    beyond, before = "~(shiftleft(1L, j + 1) - 1L)", "(shiftleft(1L, i) - 1L)"
    cycle = f"CASE WHEN i < j THEN bit_count(((CASE WHEN {has(own('i'), 'j')} THEN {own('j')} & {met('i')} ELSE 0L END) | (CASE WHEN {has(own('j'), 'i')} THEN {met('j')} & {own('i')} ELSE 0L END)) & {beyond}) ELSE 0 END"
    down = f"CASE WHEN i < j AND {has('out_i', 'j')} THEN bit_count(out_j & ~out_i & {beyond}) ELSE 0 END"
    up = f"CASE WHEN i < j AND {has('out_j', 'i')} THEN bit_count(out_i & ~out_j & {before}) ELSE 0 END"
    rows = pairs.groupBy(*keys, "n_edges", "n_nodes", "wins").agg(F.sum(F.expr(cycle)).alias("cycles"), F.sum(F.expr(f"{down} + {up}")).alias("broken"))
    condorcet = F.size(F.filter("wins", lambda w: w == F.col("n_nodes") - 1))
    n = F.col("n_nodes")
    return rows.select(
        *keys,
        "n_nodes",
        "n_edges",
        (n * (n - 1) * (n - 2) / 6).cast("int").alias("n_triples"),
        F.col("cycles").alias("n_cycle_triples"),
        F.col("broken").alias("n_transitivity_violations"),
        (condorcet == 1).alias("has_condorcet"),
        condorcet.alias("n_condorcet"),
        (F.get("wins", F.lit(0)) - F.get("wins", F.lit(1))).alias("copeland_margin"),
    )


def reciprocal_consistency(decided: DataFrame, keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """Pairs asked in both orders and how many of them name the same winner both times, by key."""
    low = F.least("left_uid", "right_uid")
    pairs = decided.where("winner is not null").groupBy(*keys, low.alias("_a"), F.greatest("left_uid", "right_uid").alias("_b")).agg(F.count_distinct("left_uid").alias("_orders"), F.max_by("winner", F.when(F.col("left_uid") == low, 1)).alias("_w1"), F.max_by("winner", F.when(F.col("left_uid") != low, 1)).alias("_w2"))
    both = F.col("_orders") == 2
    return pairs.groupBy(*keys).agg(F.count_if(both).alias("both_orders"), F.count_if(both & (F.col("_w1") == F.col("_w2"))).alias("consistent"))


def graph_problems(edges: DataFrame, n: int = 8, keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """Pools whose graph isn't one oriented edge for each unordered pair of n candidates."""
    per = edges.groupBy(*keys).agg(F.count("*").alias("edges"), F.count_distinct(F.least("left_uid", "right_uid"), F.greatest("left_uid", "right_uid")).alias("pairs"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array("left_uid", "right_uid"))))).alias("nodes"))
    want = n * (n - 1) // 2
    return per.where((F.col("edges") != want) | (F.col("pairs") != want) | (F.col("nodes") != n))
