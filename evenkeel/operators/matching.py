"""Bipartite matching of entities, and null assignments to judge it by.

A matching is found graph by graph, and a graph is one row of edges: graphs are small (candidates of one entity's
neighbourhood), their number and the number of trials are what grows. Assignments of all entities to all are never held
in one place: a trial puts both sides into hashed orders by ranges and pairs equal places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .ranking import ordinal_positions

#: Graphs of up to so many lefts, rights and edges are enumerated.
SMALL_SIDE, SMALL_EDGES = 8, 32
#: Rows that a task hands on at once.
ROWS_AT_ONCE = 2000
Pairs = list[tuple[int, int]]


def maximum_matching(edges: Pairs, lefts: list[int] | None = None, near: dict[int, list[int]] | None = None) -> dict[int, int]:
    """left -> right of a largest matching, by augmenting paths found breadth first; smaller ids are tried first unless
    an order of the lefts and of each left's neighbours is given."""
    if near is None:
        near = {}
        for left, right in sorted(set(edges)):
            near.setdefault(left, []).append(right)
    owner: dict[int, int] = {}
    mate: dict[int, int] = {}
    for start in sorted(near) if lefts is None else lefts:
        came: dict[int, int] = {}
        queue, free = [start], None
        for left in queue:
            for right in near[left]:
                if right in came:
                    continue
                came[right] = left
                if right not in owner:
                    free = right
                    break
                queue.append(owner[right])
            if free is not None:
                break
        while free is not None:
            left = came[free]
            owner[free] = left
            mate[left], free = free, mate.get(left)
    return mate


def all_maximum_matchings(edges: Pairs) -> list[Pairs]:
    """Every largest matching of a small graph, each as its sorted pairs; lefts may stay single."""
    near: dict[int, list[int]] = {}
    for left, right in sorted(set(edges)):
        near.setdefault(left, []).append(right)
    lefts, size = sorted(near), len(maximum_matching(edges))
    found: list[Pairs] = []
    stack: list[tuple[int, Pairs]] = [(0, [])]
    while stack:
        k, pairs = stack.pop()
        if len(pairs) == size:
            found.append(pairs)
        elif len(pairs) + len(lefts) - k >= size:
            taken = {r for _, r in pairs}
            stack.append((k + 1, pairs))
            stack += [(k + 1, [*pairs, (lefts[k], r)]) for r in near[lefts[k]] if r not in taken]
    return sorted(found)


def assignment_id(pairs: Pairs) -> str:
    return hashlib.sha256(repr(sorted(pairs)).encode()).hexdigest()[:16]


def _match(part: pd.DataFrame) -> pd.DataFrame:
    pairs = maximum_matching(list(zip(part["left"], part["right"], strict=True)))
    return pd.DataFrame({"left": list(pairs), "right": list(pairs.values())})


def match_components(pairs: DataFrame, component: str) -> DataFrame:
    """left, right of a largest matching within each component; a component is one connected set of candidates."""
    rows = pairs.select(component, F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))
    return rows.groupBy(component).applyInPandas(lambda part: _match(part), "left bigint, right bigint")


def _hashed(values: list[int], namespace: str, counter: int) -> list[int]:
    return sorted(values, key=lambda v: (hashlib.sha256(f"{namespace}|{counter}|{v}".encode()).hexdigest(), v))


def in_parts(made: Iterator[list[tuple]], columns: list[str], most: int = ROWS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The rows of one graph after the other as frames of ``most`` rows at most, so that what a task holds doesn't grow with its graphs."""
    held: list[tuple] = []
    for rows in made:
        held += rows
        while len(held) >= most:
            yield pd.DataFrame(held[:most], columns=columns)
            held = held[most:]
    if held:
        yield pd.DataFrame(held, columns=columns)


def null_graphs(allowed: DataFrame, group: str, forbidden: DataFrame | None = None, derangement: bool = False) -> DataFrame:
    """group, lefts and rights (of the allowed pairs), eligible_lefts, eligible_rights and edges (those that are left).

    allowed: group, left, right. ``forbidden`` pairs are taken out, and with ``derangement`` pairs of a left and a right of the same name. Matchings
    are judged on what is left, so their size is the largest that obeys these rules; entities without any pair left count as of degree zero.
    """
    pairs = allowed.select(group, F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right")).distinct()
    if forbidden is not None:
        pairs = pairs.join(forbidden.select(group, "left", "right", F.lit(True).alias("_out")).distinct(), [group, "left", "right"], "left")
    else:
        pairs = pairs.withColumn("_out", F.lit(None).cast("boolean"))
    out = F.coalesce(F.col("_out"), F.lit(False)) | ((F.col("left") == F.col("right")) if derangement else F.lit(False))
    kept = lambda c: F.when(~out, F.col(c))
    return pairs.groupBy(group).agg(
        F.countDistinct("left").alias("lefts"),
        F.countDistinct("right").alias("rights"),
        F.countDistinct(kept("left")).alias("eligible_lefts"),
        F.countDistinct(kept("right")).alias("eligible_rights"),
        F.array_sort(F.collect_list(F.when(~out, F.struct("left", "right")))).alias("edges"),
    )


def null_matchings(graphs: DataFrame, group: str, requested: int, namespace: str, forbidden: DataFrame | None = None, per_round: int = 64, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct largest matchings of each graph other than its canonical one: (assignments, summary).

    assignments: group, id, pairs and nth from 1, ``requested`` at most. Graphs of up to SMALL_SIDE entities a side and SMALL_EDGES edges are enumerated, and
    theirs come in the order of the hash of namespace and id. Of larger ones each trial augments in hashed orders; trials are rows of their own, spread over all tasks, in rounds
    of ``per_round`` a graph until enough are found or ``most`` (50 for each requested, 256 at least) were tried. ``forbidden`` (group, id) are never taken.
    summary: group, cardinality, finite_space (null where not enumerated), generated and exhausted.
    """
    small = (F.col("eligible_lefts") <= SMALL_SIDE) & (F.col("eligible_rights") <= SMALL_SIDE) & (F.size("edges") <= SMALL_EDGES)
    made = "pairs array<struct<left:bigint,right:bigint>>, id string, cardinality int"
    kind = graphs.schema[group].dataType.simpleString()

    def pairs_of(edges) -> Pairs:
        return [(e["left"], e["right"]) for e in edges]

    def rows(key, counter: int, found: list[Pairs], canonical: str) -> list[tuple]:
        named = [(assignment_id(f), f) for f in found]
        return [(key, counter, i == canonical, [{"left": a, "right": b} for a, b in f], i, len(f)) for i, f in named]

    columns = [group, "counter", "canonical", "pairs", "id", "cardinality"]

    def enumerate_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[list[tuple]]:
            for batch in batches:
                for key, edges in zip(batch[group], batch["edges"]):
                    edges = pairs_of(edges)
                    canonical = assignment_id(list(maximum_matching(edges).items()))
                    yield rows(key, 0, all_maximum_matchings(edges), canonical)

        yield from in_parts(each(), columns)

    def try_orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[list[tuple]]:
            for batch in batches:
                for key, edges, counter in zip(batch[group], batch["edges"], batch["counter"]):
                    near: dict[int, list[int]] = {}
                    for left, right in pairs_of(edges):
                        near.setdefault(left, []).append(right)
                    canonical = list(maximum_matching([(a, b) for a in near for b in near[a]]).items())
                    near = {a: _hashed(b, f"{namespace}/edge/{a}", counter) for a, b in near.items()}
                    trial = maximum_matching([], _hashed(list(near), f"{namespace}/left", counter), near)
                    yield rows(key, int(counter), [sorted(trial.items())], assignment_id(canonical))

        yield from in_parts(each(), columns)

    schema = f"{group} {kind}, counter int, canonical boolean, {made}"
    whole = staged(graphs.where(small).select(group, "edges").mapInPandas(enumerate_all, schema), "matchings")
    spaces = whole.groupBy(group).agg(F.max("cardinality").alias("cardinality"), F.count("*").alias("finite_space"), F.count_if(~F.col("canonical")).alias("others"))
    order = F.sha2(F.concat_ws("|", F.lit(namespace), "id"), 256)

    def free(found: DataFrame) -> DataFrame:
        found = found.where(~F.col("canonical"))
        return found if forbidden is None else found.join(forbidden.select(group, "id"), [group, "id"], "left_anti")

    place = Window.partitionBy(group).orderBy(order, "id")
    taken = free(whole).select(group, "id", "pairs", F.row_number().over(place).alias("nth")).where(F.col("nth") <= requested)
    large = staged(graphs.where(~small).select(group, "edges"), "graphs")
    tried, size = None, large.count()
    limit = most or max(256, 50 * requested)
    done = 0
    while size and done < limit:
        ahead = large if tried is None else large.join(tried.groupBy(group).agg(F.countDistinct(F.when(F.col("_free"), F.col("id"))).alias("_n")).where(F.col("_n") >= requested), group, "left_anti")
        trials = ahead.withColumn("counter", F.explode(F.sequence(F.lit(done), F.lit(min(done + per_round, limit) - 1)))).repartition(group, "counter")
        found = trials.mapInPandas(try_orders, schema)
        kept = free(found).select(group, "id", F.lit(True).alias("_free")).distinct()
        found = staged(found.join(kept, [group, "id"], "left").withColumn("_free", F.coalesce("_free", F.lit(False))), "trials")
        tried = found if tried is None else tried.unionByName(found)
        done += per_round
        if not large.join(tried.groupBy(group).agg(F.countDistinct(F.when(F.col("_free"), F.col("id"))).alias("_n")).where(F.col("_n") >= requested), group, "left_anti").take(1):
            break
    if tried is not None:
        firsts = tried.where("_free").groupBy(group, "id").agg(F.min("counter").alias("counter"), F.first("pairs").alias("pairs"))
        nth = F.row_number().over(Window.partitionBy(group).orderBy("counter", "id"))
        taken = taken.unionByName(firsts.select(group, "id", "pairs", nth.alias("nth")).where(F.col("nth") <= requested))
        spaces = spaces.unionByName(tried.groupBy(group).agg(F.max("cardinality").alias("cardinality"), F.lit(None).cast("long").alias("finite_space"), F.lit(None).cast("long").alias("others")))
    got = taken.groupBy(group).agg(F.count("*").alias("generated"))
    summary = spaces.join(got, group, "left").select(
        group, "cardinality", "finite_space", F.coalesce("generated", F.lit(0)).cast("long").alias("generated"), F.coalesce(F.col("others") <= F.coalesce("generated", F.lit(0)), F.lit(False)).alias("exhausted")
    )
    return taken, summary


def null_assignments(entities: DataFrame, key: str, trials: int, namespace: str) -> DataFrame:
    """trial, key, other: in each trial a cyclic shift of a hashed order, which maps no entity to itself.

    Calibration and evaluation take different namespaces. Orders are made by ranges, so no trial passes through one task.
    """
    each = entities.select(key, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    hashed = F.sha2(F.concat_ws("|", F.lit(namespace), F.col("trial").cast("string"), F.col(key).cast("string")), 256)
    placed = ordinal_positions(each.withColumn("_h", hashed), ["trial"], [F.col("_h"), F.col(key)], "_at", "_of")
    after = placed.select("trial", F.pmod(F.col("_at") - 1, F.col("_of")).alias("_at"), F.col(key).alias("other"))
    return placed.join(after, ["trial", "_at"]).select("trial", key, "other")


def null_permutations(lefts: DataFrame, rights: DataFrame, key: str, trials: int, namespace: str, derangement: bool = False, forbidden: DataFrame | None = None) -> DataFrame:
    """trial, left, right: in each trial the lefts and rights of equal places of two hashed orders, as many as the shorter side has.

    Trials with a left of the same name as its right (with ``derangement``), with a ``forbidden`` pair (left, right), equal to an earlier one, or that pair both sides in
    the order of their names, are left out. Calibration and evaluation take different namespaces. Orders are made by ranges of (trial, hash), so that no
    trial passes through one task.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")

    def placed(side: DataFrame, name: str) -> DataFrame:
        ids = side.select(F.col(key).alias(name)).distinct()
        hashed = F.sha2(F.concat_ws("|", F.lit(f"{namespace}/{name}"), F.col("trial").cast("string"), F.col(name).cast("string")), 256)
        orders = ids.select(name, each).withColumn("_h", hashed)
        own = ordinal_positions(orders, ["trial"], [F.col("_h"), F.col(name)], "_at").select("trial", name, "_at")
        named = ordinal_positions(ids.withColumn("_all", F.lit(0)), ["_all"], [F.col(name)], f"_{name}_named").select(name, f"_{name}_named")
        return own.join(named, name)

    pairs = placed(lefts, "left").join(placed(rights, "right"), ["trial", "_at"]).drop("_at")
    bad = (F.col("left") == F.col("right")) if derangement else F.lit(False)
    if forbidden is not None:
        pairs = pairs.join(forbidden.select("left", "right", F.lit(True).alias("_f")).distinct(), ["left", "right"], "left")
        bad = bad | F.coalesce("_f", F.lit(False))
    pairs = staged(pairs.withColumn("_bad", bad), "permutations")
    digest = F.concat_ws("|", *[F.bit_xor(F.xxhash64(F.lit(s), "left", "right")).cast("string") for s in (1, 2)])
    told = pairs.groupBy("trial").agg(digest.alias("_d"), F.bool_or("_bad").alias("_bad"), F.bool_and(F.col("_left_named") == F.col("_right_named")).alias("_plain"))
    first = told.where(~F.col("_bad") & ~F.col("_plain")).groupBy("_d").agg(F.min("trial").alias("trial"))
    return pairs.join(first, "trial", "left_semi").select("trial", "left", "right")
