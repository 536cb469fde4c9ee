"""Quality rules on rendered triplets, repairs, and generation of triplet specifications.

A scene table has one row per triplet with base, relevant and irrelevant structs: preferred, contract and objects. Each rule
is an array of flags; the status is the worst flag's prefix. Pictures are compared with NumPy in batches.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import compact, projected_radius, relation_holds, sha, status_of
from ..schemas import VARIANTS
from ..sources.writers import shared_folder

# Pixels from the edge, least projected radius, and distance over the smaller radius.
EDGE, LEAST_RADIUS, OVERLAP = 8.0, 6.0, 0.55
OBJECT = "struct<object_id: string, shape: string, color: string, size: string, x: double, y: double, pixel_coords: array<double>, coords: array<double>>"
CONTRACT = "struct<cycles_seed: long, camera_location: array<double>, lamp_key_location: array<double>, lamp_fill_location: array<double>, lamp_back_location: array<double>, camera_jitter: double>"
SCENE = f"struct<preferred: string, target_count: int, contract: {CONTRACT}, objects: array<{OBJECT}>>"
TRIPLETS = f"triplet_id string, factor string, candidate_a string, candidate_b string, target_shape string, target_color string, color_to string, left_vector array<double>, right_vector array<double>, base {SCENE}, relevant {SCENE}, irrelevant {SCENE}"


def label_flags() -> Column:
    """The relevant edit flips the preferred letter, the irrelevant one keeps it."""
    letter = lambda v: F.col(f"{v}.preferred")
    return compact(
        F.when(F.col("candidate_a") == F.col("candidate_b"), "FAIL: duplicate candidates"),
        *[F.when(~F.coalesce(letter(v).isin("A", "B"), F.lit(False)), f"FAIL: {v} preferred not A/B") for v in VARIANTS],
        F.when(letter("relevant").eqNullSafe(letter("base")), "FAIL: relevant preference did not flip"),
        F.when(~letter("irrelevant").eqNullSafe(letter("base")), "FAIL: irrelevant preference changed"),
    )


def same_place(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.coalesce(F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < tolerance), lambda ok: ok), F.lit(False))


def contract_flags() -> Column:
    """All three scenes share seed, camera and lights, and the camera doesn't move."""
    field = lambda v, f: F.col(f"{v}.contract.{f}")
    moved = lambda f: ~(same_place(field("base", f), field("relevant", f)) & same_place(field("base", f), field("irrelevant", f)))
    return compact(
        F.when(F.size(F.array_distinct(F.array(*[field(v, "cycles_seed") for v in VARIANTS]))) != 1, "FAIL: cycles seed mismatch"),
        F.when(moved("camera_location"), "FAIL: camera mismatch"),
        *[F.when(moved(f"lamp_{k}_location"), f"FAIL: light mismatch lamp_{k}_location") for k in ("key", "fill", "back")],
        F.when(F.exists(F.array(*[F.coalesce(field(v, "camera_jitter"), F.lit(0.0)) for v in VARIANTS]), lambda j: j != 0), "FAIL: camera jitter"),
    )


def visibility_flags(variant: str, width: int = 320, height: int = 240) -> Column:
    """Objects outside the frame, near its edge, too small, or hiding each other."""
    objects = F.coalesce(F.col(f"{variant}.objects"), F.array().cast(f"array<{OBJECT}>"))
    at = lambda o, k: F.get(o["pixel_coords"], F.lit(k))
    radius = lambda o: projected_radius(o["size"], at(o, 2))

    def alone(o: Column) -> Column:
        x, y = at(o, 0), at(o, 1)
        missing = x.isNull() | y.isNull()
        outside = (x < 0) | (y < 0) | (x >= width) | (y >= height)
        edge = (x < EDGE) | (y < EDGE) | (x > width - EDGE) | (y > height - EDGE)
        place = F.when(missing, F.lit(f"FAIL: {variant} missing pixel_coords")).when(outside, F.concat(F.lit(f"FAIL: {variant} "), o["object_id"], F.lit(" out_of_frame"))).when(edge, F.concat(F.lit(f"BORDERLINE: {variant} "), o["object_id"], F.lit(" near_edge")))
        tiny = F.when(~missing & (radius(o) < LEAST_RADIUS), F.concat(F.lit(f"BORDERLINE: {variant} "), o["object_id"], F.lit(" tiny_projected_size")))
        return compact(place, tiny)

    def hidden(a: Column, i: Column) -> Column:
        far = lambda b: F.sqrt(F.pow(at(a, 0) - at(b, 0), 2.0) + F.pow(at(a, 1) - at(b, 1), 2.0))
        near = F.filter(F.slice(objects, i + 2, F.size(objects)), lambda b: far(b) < OVERLAP * F.least(radius(a), radius(b)))
        return F.transform(near, lambda b: F.concat(F.lit(f"BORDERLINE: {variant} possible_occlusion "), a["object_id"], F.lit("/"), b["object_id"]))

    return F.concat(F.flatten(F.transform(objects, alone)), F.flatten(F.transform(objects, hidden)))


def by_id(variant: str, name: str) -> Column:
    return F.get(F.filter(F.col(f"{variant}.objects"), lambda o: o["object_id"] == name), F.lit(0))


def count_of(variant: str, shape: Column | None = None, color: Column | None = None) -> Column:
    def fits(o: Column) -> Column:
        out = F.lit(True)
        if shape is not None:
            out = out & (o["shape"] == shape)
        if color is not None:
            out = out & (o["color"] == color)
        return out

    return F.size(F.filter(F.col(f"{variant}.objects"), fits))


def count_flags() -> Column:
    n = {v: count_of(v, color=F.col("target_color")) for v in VARIANTS}
    size = {v: F.size(F.col(f"{v}.objects")) for v in VARIANTS}
    text = lambda head, a, b: F.format_string(head, a, b)
    rules = compact(
        F.when(n["base"] != F.coalesce(F.col("base.target_count"), n["base"]), text("FAIL: base target count %d != %d", n["base"], F.col("base.target_count"))),
        F.when(n["relevant"] != n["base"] + 1, text("FAIL: relevant did not add one target (%d -> %d)", n["base"], n["relevant"])),
        F.when(n["irrelevant"] != n["base"], text("FAIL: irrelevant changed target count (%d -> %d)", n["base"], n["irrelevant"])),
        *[F.when(size[v] != size["base"] + 1, f"FAIL: {v} object cardinality") for v in VARIANTS[1:]],
    )
    return F.when(F.coalesce(F.col("target_color"), F.lit("")) == "", F.array(F.lit("FAIL: missing target_color"))).otherwise(rules)


def attribute_flags() -> Column:
    old, new = F.col("target_color"), F.col("color_to")
    target = lambda v: F.get(F.filter(F.col(f"{v}.objects"), lambda o: o["shape"] == F.col("target_shape")), F.lit(0))
    wrong = lambda v: F.when(~target(v)["color"].eqNullSafe(new if v == "relevant" else old) & target(v).isNotNull(), f"FAIL: {v} target color")
    edits = [("relevant", "target", new, "relevant did not flip target attribute"), ("relevant", "matched", old, "relevant changed irrelevant target"), ("irrelevant", "matched", new, "irrelevant did not apply matched flip"), ("irrelevant", "target", old, "irrelevant changed queried target")]
    known = by_id("base", "target").isNotNull() & by_id("base", "matched").isNotNull()
    return compact(
        *[f for v in VARIANTS for f in (F.when(count_of(v, shape=F.col("target_shape")) != 1, f"FAIL: {v} target shape not unique"), wrong(v))],
        F.when(~known, "FAIL: missing target/matched ids"),
        *[F.when(known & ~by_id(v, name)["color"].eqNullSafe(want), f"FAIL: {message}") for v, name, want, message in edits],
    )


def presence_flags() -> Column:
    n = {v: count_of(v, F.col("target_shape"), F.col("target_color")) for v in VARIANTS}
    have = lambda v, name: by_id(v, name).isNotNull()
    return compact(
        F.when(n["base"] != 1, "FAIL: base missing unique target"),
        F.when(n["relevant"] != 0, "FAIL: relevant did not remove target"),
        F.when(n["irrelevant"] != 1, "FAIL: irrelevant removed queried target"),
        F.when(have("relevant", "target"), "FAIL: relevant still has target id"),
        F.when(have("base", "matched") & have("irrelevant", "matched"), "FAIL: irrelevant did not remove matched"),
        F.when(~have("irrelevant", "target"), "FAIL: irrelevant dropped target"),
    )


def spatial_flags() -> Column:
    roles = [by_id(v, r) for v, r in (("base", "referent"), ("base", "anchor"), ("relevant", "referent"), ("relevant", "anchor"), ("irrelevant", "referent"), ("irrelevant", "anchor"), ("base", "distractor"), ("irrelevant", "distractor"))]
    whole = reduce(lambda a, b: a & b, [r.isNotNull() for r in roles])
    holds = lambda v, d: relation_holds(by_id(v, "referent")["coords"], by_id(v, "anchor")["coords"], F.col(f"{d}_vector"))
    shift = lambda name, v, axis: by_id(v, name)[axis] - by_id("base", name)[axis]
    matched = reduce(lambda a, b: a & b, [F.abs(shift("referent", "relevant", x) - shift("distractor", "irrelevant", x)) < 1e-3 for x in "xy"])
    rules = compact(
        F.when(~holds("base", "left"), "FAIL: base relation is not left-of"),
        F.when(~holds("relevant", "right"), "FAIL: relevant did not flip to right-of"),
        F.when(holds("relevant", "left"), "FAIL: relevant still left-of"),
        F.when(~holds("irrelevant", "left"), "FAIL: irrelevant changed queried relation"),
        F.when(~matched, "FAIL: displacement matching broken"),
    )
    return F.when(whole, rules).otherwise(F.array(F.lit("FAIL: missing spatial role ids")))


def checked_triplets(triplets: DataFrame) -> DataFrame:
    """triplet_id, factor, flags and status: labels, contracts, visibility, and the rules of the factor."""
    rules = {"count": count_flags(), "attribute": attribute_flags(), "presence": presence_flags(), "spatial": spatial_flags()}
    own = reduce(lambda acc, k: acc.when(F.col("factor") == k, rules[k]), rules, F)
    own = own.otherwise(F.array(F.concat(F.lit("FAIL: unknown factor "), F.coalesce("factor", F.lit("?")))))
    flags = F.concat(label_flags(), contract_flags(), *[visibility_flags(v) for v in VARIANTS], own)
    return triplets.select("triplet_id", "factor", flags.alias("flags")).withColumn("status", status_of(F.col("flags")))


def incremental(triplets: DataFrame, cached: DataFrame) -> DataFrame:
    """Statuses for all triplets: the cached ones as they are, the rest newly checked."""
    new = checked_triplets(triplets.join(cached.select("triplet_id"), "triplet_id", "left_anti"))
    return cached.select("triplet_id", "factor", "flags", "status").unionByName(new)


def tallies(report: DataFrame, by: str = "factor") -> DataFrame:
    """Rows by status for each group, UNSCORED where the status is null or unknown."""
    known = ("PASS", "BORDERLINE", "FAIL")
    return report.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in known], F.count_if(~F.coalesce(F.col("status").isin(*known), F.lit(False))).alias("UNSCORED"))


def frozen(report: DataFrame, n: int) -> DataFrame:
    """The first n passing triplets of each factor by id, only of factors that have n."""
    passed = report.where("status = 'PASS'")
    size = F.count("*").over(Window.partitionBy("factor"))
    rank = F.row_number().over(Window.partitionBy("factor").orderBy("triplet_id"))
    return passed.withColumns({"_size": size, "_rank": rank}).where((F.col("_size") >= n) & (F.col("_rank") <= n)).drop("_size", "_rank")


def united_freezes(freezes: DataFrame, factors: tuple[str, ...], n: int, version: str) -> tuple[DataFrame, dict[str, tuple[Column, object]]]:
    """(items, gates) of a union of frozen factors: n triplets and a row for each variant of each in every factor, no item twice,
    all passed, every one with an image. Gates are aggregates over the items with the value they have to have."""
    items = freezes.withColumn("audit_dataset_version", F.lit(version))
    items = items.withColumn("_copies", F.count("*").over(Window.partitionBy("item_id")))
    items = items.withColumn("_first", F.row_number().over(Window.partitionBy("factor", "triplet_id").orderBy("item_id")) == 1)
    gates = {"other factors": (F.count_if(~F.coalesce(F.col("factor").isin(*factors), F.lit(False))), 0)}
    for f in factors:
        gates[f"triplets of {f}"] = (F.count_if((F.col("factor") == f) & F.col("_first")), n)
        gates[f"items of {f}"] = (F.count_if(F.col("factor") == f), n * len(VARIANTS))
    gates["items twice"] = (F.count_if(F.col("_copies") > 1), 0)
    gates["not passed"] = (F.count_if(~F.col("qc_status").eqNullSafe("PASS")), 0)
    gates["without an image"] = (F.count_if(F.coalesce(F.col("image_path"), F.lit("")) == ""), 0)
    return items, gates


def variant_rows(triplets: DataFrame) -> DataFrame:
    """A row for each variant of each triplet: item_id, expected preference and the scene's objects."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"{v}.preferred").alias("expected_preference"), F.col(f"{v}.objects").alias("objects")) for v in VARIANTS]))
    rows = triplets.select("triplet_id", "factor", "candidate_a", "candidate_b", each.alias("v"))
    return rows.select(F.concat_ws(":", "triplet_id", "v.variant").alias("item_id"), "triplet_id", "factor", "candidate_a", "candidate_b", "v.*")


def recolored(objects: Column, name: str, color: Column | str) -> Column:
    color = F.lit(color) if isinstance(color, str) else color
    return F.transform(objects, lambda o: F.when(o["object_id"] == name, o.withField("color", color)).otherwise(o))


def removed(objects: Column, name: str) -> Column:
    return F.filter(objects, lambda o: o["object_id"] != name)


def moved(objects: Column, name: str, dx: float, dy: float) -> Column:
    return F.transform(objects, lambda o: F.when(o["object_id"] == name, o.withField("x", o["x"] + dx).withField("y", o["y"] + dy)).otherwise(o))


def image_differences(pairs: DataFrame, threshold: float = 1.0) -> DataFrame:
    """mean_abs and changed share of two RGB pictures given as flat arrays of the same size (columns id, a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [np.abs(np.asarray(a, np.float64) - np.asarray(b, np.float64)).reshape(-1, 3) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "mean_abs": [float(x.mean()) for x in d], "changed": [float((x.max(1) > threshold).mean()) for x in d]})

    return pairs.select(F.col("id").cast("string").alias("id"), "a", "b").mapInPandas(run, "id string, mean_abs double, changed double")


def magnitude_flags(relevant: Column, irrelevant: Column) -> Column:
    """Mean differences of the two edits must both exist and lie within a factor of four."""
    ratio = relevant / F.nullif(irrelevant, F.lit(0.0))
    return compact(F.when(irrelevant == 0, "FAIL: irrelevant image identical to base"), F.when(relevant == 0, "FAIL: relevant image identical to base"), F.when((ratio < 0.25) | (ratio > 4.0), F.format_string("BORDERLINE: relevant/irrelevant RGB magnitude ratio %.3f", ratio)))


def eligible_replacements(pool: DataFrame, image: str, *taken: DataFrame) -> DataFrame:
    """Candidates whose image is in none of the taken sets."""
    return reduce(lambda df, t: df.join(t.select(image), image, "left_anti"), taken, pool)


def greedy_repair(downstream: DataFrame, static: DataFrame, audit: DataFrame, pool: DataFrame, salt: str = "repair") -> DataFrame:
    """Rows whose image the static set has, each with its replacement: of its factor and carrier, the smallest salted digest
    whose image nobody uses, over all groups in order of item_id. No candidate left raises.

    The choice runs in rounds of joins. The k-th conflict of a factor and carrier starts at their k-th candidate, as those before
    it take k - 1 of them. An image that several groups want goes to the smallest item_id; losers, and those behind them in their
    group, move on by one. When nobody loses, this is what a choice one by one gives. Ranks are windows over factor and carrier.
    """
    group = ("factor", "carrier")
    shared_folder(downstream.sparkSession)
    conflicts = downstream.join(static.select("image").distinct(), "image", "left_semi")
    kept = downstream.join(static.select("image"), "image", "left_anti")
    free = eligible_replacements(pool, "image", static, audit, kept).withColumn("_key", sha(F.lit(salt), "item_id", "image"))
    free = free.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "image").orderBy("_key"))).where("_n = 1")
    free = free.select(*group, F.col("item_id").alias("replacement_id"), F.col("image").alias("_image"), F.row_number().over(Window.partitionBy(*group).orderBy("_key")).alias("_rank")).checkpoint()
    order = ("item_id", "image", *group)
    state = conflicts.select(*order, F.row_number().over(Window.partitionBy(*group).orderBy("item_id", "image")).alias("_k")).withColumn("_rank", F.col("_k"))
    while True:
        placed = state.join(free, [*group, "_rank"], "left")
        before = F.row_number().over(Window.partitionBy("_image").orderBy(*order, "_k"))
        placed = placed.withColumn("_lost", (F.col("_image").isNotNull() & (before > 1)).cast("int")).checkpoint()
        for row in placed.where("_image is null").select(*group).limit(1).collect():
            raise ValueError(f"no replacement left for {row['factor']}/{row['carrier']}")
        if placed.where("_lost = 1").isEmpty():
            return placed.select("item_id", "replacement_id", *group, F.col("_image").alias("image")).orderBy("item_id")
        ahead = Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        state = placed.select(*order, "_k", (F.col("_k") + F.max(F.col("_rank") + F.col("_lost") - F.col("_k")).over(ahead)).alias("_rank"))


def generated_specs(spark: SparkSession, factor: str, ids: int | DataFrame, seed: int = 20260912) -> DataFrame:
    """A triplet specification of a factor for each id, a number from 0 or the rows' column id, from a seeded generator: those of
    even ids prefer A at the base.

    Count adds a target or another object, attribute recolours the target or its match, presence removes one of them, and
    spatial moves the referent or a distractor by the same distance.
    """
    shapes, colors = ("cube", "sphere", "cylinder"), ("red", "green", "blue", "yellow")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = random.Random(f"{seed}:{factor}:{i}")
                shape, color, other = rng.choice(shapes), *rng.sample(colors, 2)
                thing = lambda name, x, s, c, row=120.0: {"object_id": name, "shape": s, "color": c, "size": "large", "x": x, "y": 0.0, "pixel_coords": [160.0 + 40 * x, row, 9.0], "coords": [x, 0.0, 0.0]}
                match = shapes[(shapes.index(shape) + 1) % 3]
                base = [thing("target", -2.0, shape, color), thing("matched", 2.0, match, color)]
                if factor == "count":
                    edits = [*base, thing("added", 0.0, shape, color)], [*base, thing("added", 0.0, shape, other)]
                elif factor == "attribute":
                    edits = [base[0] | {"color": other}, base[1]], [base[0], base[1] | {"color": other}]
                elif factor == "presence":
                    edits = [base[1]], [base[0]]
                else:
                    base = [thing("referent", -1.0, shape, color), thing("anchor", 0.0, match, other), thing("distractor", -3.0, match, color, 60.0)]
                    shift = lambda o: o | {"x": o["x"] + 2.0, "coords": [o["x"] + 2.0, 0.0, 0.0], "pixel_coords": [160.0 + 40 * (o["x"] + 2.0), o["pixel_coords"][1], 9.0]}
                    edits = [shift(base[0]), *base[1:]], [*base[:2], shift(base[2])]
                letter, flipped = ("A", "B") if i % 2 == 0 else ("B", "A")
                contract = {"cycles_seed": int(i), "camera_location": [0.0, -9.0, 6.0], "lamp_key_location": [4.0, 4.0, 6.0], "lamp_fill_location": [-4.0, -3.0, 5.0], "lamp_back_location": [-1.0, 5.0, 4.0], "camera_jitter": 0.0}
                scene = lambda p, objects: {"preferred": p, "target_count": None, "contract": contract, "objects": objects}
                rows.append({"triplet_id": f"{factor}-{i:06d}", "factor": factor, "candidate_a": "yes", "candidate_b": "no", "target_shape": shape, "target_color": color, "color_to": other, "left_vector": [-1.0, 0.0, 0.0], "right_vector": [1.0, 0.0, 0.0], "base": scene(letter, base), "relevant": scene(flipped, edits[0]), "irrelevant": scene(letter, edits[1])})
            yield pd.DataFrame(rows)

    rows = spark.range(ids) if isinstance(ids, int) else ids.select(F.col("id").cast("long").alias("id"))
    return rows.mapInPandas(make, TRIPLETS)


def validation(report: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each named rule: rows checked, rows that fail, and whether all pass."""
    counts = report.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("failures")) for k in rules]))
    return counts.select("n", each.alias("e")).select("e.rule", "n", "e.failures", (F.col("e.failures") == 0).alias("ok"))
