"""Context features, null matchings, prefixes, resamples and calibrations against plain versions."""

import itertools
import math
import random
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import calibration, history, matching, nearest_pairs, ranking, sampling, sequences
from evenkeel.operators.context_features import Feature, context_features, past_statistics

FAMILIES = ["fastball", "breaking", "offspeed"]
LEVELS = {"L0": ["balls", "strikes", "outs"], "L1": ["balls", "strikes"], "global": []}


def test_past_quantiles_are_those_of_the_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(2019, 2023), rng.choice([None, *range(12)]), 1) for _ in range(400)]
    df = spark.createDataFrame([(k, s, None if v is None else float(v), w) for k, s, v, w in rows], "k string, season int, v double, w int")
    got = {(r["k"], r["cutoff"]): (r["n"], r["q"]) for r in history.past_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], 2019, 2024).collect()}
    want = {}
    for k, cutoff in itertools.product("ab", range(2019, 2025)):
        past = [float(v) for kk, s, v, _ in rows if kk == k and s < cutoff and v is not None]
        if past:
            want[k, cutoff] = (len(past), np.quantile(past, [0, 0.25, 0.5, 0.9, 1]).tolist())
    assert set(got) == set(want)
    for at, (n, q) in want.items():
        assert got[at][0] == n and got[at][1] == pytest.approx(q)


def test_running_totals_by_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(300)]
    made = ranking.running_totals(spark.createDataFrame(rows, "k string, i int, n bigint").repartition(5), ["k"], ["i"], ["n"])
    for r in made.collect():
        own = [n for k, i, n in rows if k == r["k"] and i <= r["i"]]
        assert r["upto_n"] == sum(own) and r["total_n"] == sum(n for k, _, n in rows if k == r["k"])


@pytest.fixture(scope="module")
def pitches(spark):
    """Three families of 120 rows in one season and state, and rows of another family that must not count."""
    rows = []
    for f, name in enumerate(FAMILIES):
        for i in range(120):
            rows.append((2019, name, 0, 0, 0, 130.0 + 10 * f + i / 100, 1900.0 + 200 * f + i))
    rows += [(2019, "other", 0, 0, 0, 9999.0, 9999.0)] * 120
    return rows


SCHEMA = "season int, family string, balls int, strikes int, outs int, speed double, spin double"
FEATURES = [
    Feature("mean", "mean", "speed"), Feature("sd", "sd", "speed"), Feature("z", "z", "speed"), Feature("apart", "apart", "speed", "fastball", "offspeed"),
    Feature("spin_z", "z", "spin", "breaking"), Feature("shift", "median_shift", "speed"), Feature("spread", "iqr_ratio", "speed"),
]


def looked_up(spark, rows, states):
    df = spark.createDataFrame(rows, SCHEMA)
    at = spark.createDataFrame(states, "cutoff int, balls int, strikes int, outs int")
    known = past_statistics(df, FEATURES, LEVELS, FAMILIES, 2019, 2021)
    return {(r["cutoff"], r["balls"], r["strikes"], r["outs"]): r for r in context_features(at, known, FEATURES, LEVELS, 100).collect()}


def test_context_features_of_a_supported_state(spark, pitches):
    got = looked_up(spark, pitches, [(2019, 0, 0, 0), (2020, 0, 0, 0), (2020, 3, 2, 2)])
    speeds = {f: np.array([r[5] for r in pitches if r[1] == f]) for f in FAMILIES}
    every = np.concatenate(list(speeds.values()))
    assert all(got[2019, 0, 0, 0][f.name] is None and got[2019, 0, 0, 0][f"{f.name}_level"] == "NO_HISTORY" for f in FEATURES)
    r = got[2020, 0, 0, 0]
    assert (r["mean"], r["sd"]) == (pytest.approx(every.mean()), pytest.approx(every.std())) and r["z"] == pytest.approx(0, abs=1e-9)
    pooled = math.sqrt((speeds["fastball"].var() + speeds["offspeed"].var()) / 2)
    assert r["apart"] == pytest.approx((speeds["fastball"].mean() - speeds["offspeed"].mean()) / pooled)
    assert (r["shift"], r["spread"]) == (pytest.approx(0), pytest.approx(0)) and {r[f"{f.name}_level"] for f in FEATURES} == {"L0"}
    other = got[2020, 3, 2, 2]
    assert other["mean"] == r["mean"] and {other[f"{f.name}_level"] for f in FEATURES} == {"global"}


def test_two_families_need_support_at_the_same_level(spark, pitches):
    # offspeed is too thin in state 0-0-1, so both families fall back to 0-0 together
    more = [(2019, "fastball", 0, 0, 1, 150.0, 1.0)] * 150 + [(2019, "offspeed", 0, 0, 1, 100.0, 1.0)] * 10
    r = looked_up(spark, pitches + more, [(2020, 0, 0, 1)])[2020, 0, 0, 1]
    assert (r["mean_level"], r["apart_level"]) == ("L0", "L1")
    fast = np.array([x[5] for x in pitches + more if x[1] == "fastball"])
    off = np.array([x[5] for x in pitches + more if x[1] == "offspeed"])
    assert r["apart"] == pytest.approx((fast.mean() - off.mean()) / math.sqrt((fast.var() + off.var()) / 2))
    thin = [x for k, x in enumerate(pitches) if x[1] != "offspeed" or k % 3 == 0]
    r = looked_up(spark, thin, [(2020, 0, 0, 0)])[2020, 0, 0, 0]
    assert (r["apart"], r["apart_level"]) == (None, "NO_HISTORY") and r["mean_level"] == "L0"


def test_all_maximum_matchings_are_found():
    rng = random.Random(4)
    for _ in range(40):
        edges = sorted({(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(rng.randint(1, 9))})
        subsets = [s for k in range(len(edges) + 1) for s in itertools.combinations(edges, k)]
        free = [list(s) for s in subsets if len({a for a, _ in s}) == len({b for _, b in s}) == len(s)]
        most = max(map(len, free))
        assert matching.all_maximum_matchings(edges) == sorted(s for s in free if len(s) == most)
        assert len(matching.maximum_matching(edges)) == most


def test_null_matchings(spark):
    rng = random.Random(6)
    small = [("s", a, b) for a in range(4) for b in range(4)]
    large = [("l", a, b) for a in range(12) for b in range(12) if a == b or rng.random() < 0.4]
    single = [("one", 1, 5)]
    allowed = spark.createDataFrame(small + large + single, "g string, left bigint, right bigint")
    graphs = matching.null_graphs(allowed, "g", forbidden=spark.createDataFrame([("s", 0, 1)], "g string, left bigint, right bigint"), derangement=True)
    assert {r["g"]: len(r["edges"]) for r in graphs.collect()}["s"] == 11
    taken, summary = matching.null_matchings(graphs, "g", 6, "calibration", per_round=8)
    told = {r["g"]: r for r in summary.collect()}
    # of the 9 derangements of four, those that send 0 to 1 are forbidden
    assert (told["s"]["cardinality"], told["s"]["finite_space"], told["s"]["generated"], told["s"]["exhausted"]) == (4, 6, 5, True)
    assert (told["one"]["finite_space"], told["one"]["generated"], told["one"]["exhausted"]) == (1, 0, True)
    assert (told["l"]["cardinality"], told["l"]["finite_space"], told["l"]["generated"]) == (12, None, 6)
    found = defaultdict(list)
    for r in taken.collect():
        pairs = [(p["left"], p["right"]) for p in r["pairs"]]
        assert r["id"] == matching.assignment_id(pairs) and len(dict(pairs)) == len({b for _, b in pairs}) == len(pairs)
        assert all(a != b for a, b in pairs) and set(pairs) <= {(p["left"], p["right"]) for p in next(g for g in graphs.collect() if g["g"] == r["g"])["edges"]}
        found[r["g"]].append(r["id"])
    assert all(len(set(v)) == len(v) for v in found.values())
    first = found["l"][0]
    again, _ = matching.null_matchings(graphs, "g", 6, "calibration", forbidden=spark.createDataFrame([("l", first)], "g string, id string"), per_round=8)
    assert first not in {r["id"] for r in again.collect()}


def test_null_permutations(spark):
    ids = spark.range(6).withColumnRenamed("id", "e")
    forbidden = spark.createDataFrame([(0, 1)], "left bigint, right bigint")
    got = defaultdict(dict)
    for r in matching.null_permutations(ids, ids, "e", 60, "a", derangement=True, forbidden=forbidden).collect():
        got[r["trial"]][r["left"]] = r["right"]
    assert 5 < len(got) < 60 and all(sorted(m) == sorted(m.values()) == list(range(6)) for m in got.values())
    assert all(a != b and (a, b) != (0, 1) for m in got.values() for a, b in m.items())
    assert len({tuple(sorted(m.items())) for m in got.values()}) == len(got)
    plain = [tuple(sorted((r["left"], r["right"]) for r in rows)) for rows in ([x for x in matching.null_permutations(spark.range(2).toDF("e"), spark.range(2).toDF("e"), "e", 30, "b").collect()],)]
    assert plain == [((0, 1), (1, 0))]


def test_longest_prefix_of_walks(spark):
    rng = random.Random(7)
    rows = [(e, e % 2, e % 3, k, rng.randint(0, 1)) for e in range(60) for k in range(rng.randint(1, 7))]
    placed = sequences.prefix_rows(spark.createDataFrame(rows, "e int, side int, g int, k int, code int"), ["e"], ["k"], "code")
    got = {r["e"]: (r["steps"], r["lcp"], r["exact"]) for r in sequences.longest_prefix(placed.where("side = 0"), placed.where("side = 1"), ["e"], ["g"]).collect()}
    walk, group = defaultdict(list), {}
    for e, _, g, _, c in rows:
        walk[e].append(c)
        group[e] = g
    for e in [e for e in walk if e % 2 == 0]:
        others = [walk[o] for o in walk if o % 2 and group[o] == group[e]]
        lcp = max((sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(walk[e], o))) for o in others), default=0)
        assert got[e] == (len(walk[e]), lcp, sum(o == walk[e] for o in others))


def test_resamples_have_the_moments_of_poisson_counts(spark):
    cells = spark.createDataFrame([("small", 3, 1.0), ("large", 500, 2.0), ("one", 1, 4.0)], "k string, n bigint, v double")
    draws = sampling.resampled(cells, ["k"], F.col("k"), "n", {"v": F.col("v")}, 0, 4000).groupBy("k").agg(F.count("*").alias("b"), F.avg("size").alias("m"), F.var_pop("size").alias("s"))
    got = {r["k"]: r for r in draws.collect()}
    for k, n, v in (("small", 3, 1.0), ("large", 500, 2.0), ("one", 1, 4.0)):
        assert got[k]["b"] == 4000 and got[k]["m"] == pytest.approx(n, rel=0.06) and got[k]["s"] == pytest.approx(n, rel=0.12)
    whole = sampling.resampled(cells, [], F.col("k"), "n", {"v": F.col("v")}, 8, 13).collect()
    assert sorted(r["b"] for r in whole) == [8, 9, 10, 11, 12]
    few = {r["b"]: r["size"] for r in sampling.resampled(cells, [], F.col("k"), "n", {"v": F.col("v")}, 0, 100).collect()}
    assert all(few[r["b"]] == r["size"] for r in whole)


def test_single_class_resamples_are_drawn_anew(spark):
    from evenkeel.plans.sampling import lower_bound

    rows = spark.createDataFrame([(1, 0.6, 0.7), (0, 0.5, 0.4), (0, 0.5, 0.3)], "y int, p0 double, p1 double")
    assert lower_bound(rows, 200).first()["replicates"] == 200
    assert lower_bound(rows.where("y = 0"), 20).first()["replicates"] == 0
    flat = spark.createDataFrame([(k % 2, 0.5 + 0.1 * (k % 2), 0.5 + 0.1 * (k % 2)) for k in range(40)], "y int, p0 double, p1 double")
    assert lower_bound(flat, 50).first()["lb5"] == 0.0


def scored(n=3000, seed=9):
    rng = np.random.default_rng(seed)
    p = (rng.integers(5, 95, n) / 100).round(2)
    return p, (rng.random(n) < 0.2 + 0.5 * p).astype(int)


def test_newton_reaches_the_penalised_optimum(spark):
    p, y = scored()
    df = spark.createDataFrame([(float(a), int(b), i % 2) for i, (a, b) in enumerate(zip(p, y))], "p double, y int, g int")
    for features, l2 in ((calibration.platt_features, 0.0), (calibration.beta_features, 1.0)):
        both = [df.withColumn("h", F.lit(0)), df.where("g = 1").withColumn("h", F.lit(1))]
        made = calibration.logistic(both[0].unionByName(both[1]), df.withColumn("h", F.col("g")), "p", "y", features, by=["h"], l2=l2).collect()
        x = np.stack([np.log(p), -np.log1p(-p)], 1) if l2 else np.log(p / (1 - p))[:, None]
        for h in (0, 1):
            own = np.ones(len(p), bool) if h == 0 else np.arange(len(p)) % 2 == 1
            q = {r["p"]: r["calibrated"] for r in made if r["h"] == h}
            fitted = np.array([q.get(v, np.nan) for v in p[own]])
            known = ~np.isnan(fitted)
            z = np.log(fitted[known] / (1 - fitted[known]))
            a = np.linalg.lstsq(np.c_[np.ones(known.sum()), x[own][known]], z, rcond=None)[0]
            r = y[own] - 1 / (1 + np.exp(-(a[0] + x[own] @ a[1:])))
            assert abs(r.sum()) < 1e-4 and np.abs(x[own].T @ r - l2 * a[1:]).max() < 1e-4


def test_isotonic_is_the_pooled_fit_and_straight_between(spark):
    p, y = scored(400)
    p = np.where((p > 0.4) & (p < 0.5), 0.4, p)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    asked = sorted({*p.tolist(), 0.01, 0.45, 0.4321, 0.99})
    got = {r["p"]: r["calibrated"] for r in calibration.isotonic(df, spark.createDataFrame([(v,) for v in asked], "p double"), "p", "y", low=0.0).collect()}
    xs = sorted(set(p.tolist()))
    n = [int((p == v).sum()) for v in xs]
    s = [int(y[p == v].sum()) for v in xs]
    mean = lambda j, k: sum(s[j : k + 1]) / sum(n[j : k + 1])
    fit = [max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]
    for v in asked:
        assert got[v] == pytest.approx(np.interp(v, xs, fit), abs=1e-12)


def test_intercepts_reach_the_constrained_optimum(spark):
    p, y = scored()
    g = np.arange(len(p)) % 4 + (p > 0.8)
    z = np.log(p / (1 - p))
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, z, y)], "g int, z double, y int")
    lam = 0.002
    beta = {r["g"]: r for r in calibration.subgroup_intercepts(df, "g", "z", "y", lam, 100.0, 0.05).collect()}
    raw = np.array([beta[k]["raw"] for k in range(5)])
    n = np.bincount(g)
    assert abs((n * raw).sum()) < 1e-8
    gradient = np.bincount(g, weights=y - 1 / (1 + np.exp(-(z + raw[g])))) / len(p) - 2 * lam * raw
    # what is left of the gradient points along the constraint
    assert np.ptp(gradient / n) < 1e-10
    assert all(beta[k]["beta"] == pytest.approx(np.clip(raw[k] * n[k] / (n[k] + 100), -0.05, 0.05)) for k in range(5))
    lone = calibration.subgroup_intercepts(df.withColumn("g", F.lit(1)), "g", "z", "y").first()
    assert lone["raw"] == pytest.approx(0, abs=1e-12)


def test_pairs_are_judged_block_by_block(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i % 3), [float(v) for v in rng.integers(0, 6, 2) / 4] if i % 11 else [None, 1.0]) for i in rng.permutation(300)]
    df = spark.createDataFrame(rows, "id bigint, g int, v array<double>")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")

    def distance(x, y):
        d = np.abs(x[:, None] - y[None]).sum(axis=2)
        return (np.where(np.isnan(d), np.inf, d),)

    judge = nearest_pairs.nearest(distance, 2, 9, both=True)
    made = nearest_pairs.compared(left, right, "g", judge, "l bigint, r bigint, d double", block=7)
    # no pair goes through a shuffle: what is dealt to tasks are blocks
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    got = {(r["l"], r["r"]): r["d"] for r in made.collect()}
    known = {i: (g, v) for i, g, v in rows if v[0] is not None}
    plain = {(a, b): sum(abs(p - q) for p, q in zip(known[a][1], known[b][1])) for a in known for b in known if a % 2 == 0 and b % 2 and known[a][0] == known[b][0]}
    assert all(plain[k] == pytest.approx(d) for k, d in got.items()) and len(got) < len(plain)
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in plain.items()], "l bigint, r bigint, d double")
    every = nearest_pairs.compared(left, right, "g", nearest_pairs.within(distance), "l bigint, r bigint, d double", block=50)
    assert sorted(map(tuple, every.collect())) == sorted((a, b, d) for (a, b), d in plain.items())
    assert sorted(sequences.mutual_best(made.distinct(), "l", "r", "d").collect()) == sorted(sequences.mutual_best(pairs, "l", "r", "d").collect())
    assert not nearest_pairs.compared(left.where("id < 0"), right, "g", judge, "l bigint, r bigint, d double").collect()


def test_vectors_move_to_a_bounded_number_of_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, 0, [float(i)]) for i in range(400)], "id bigint, g int, v array<double>")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")

    def judge(a, x, b, y):
        yield [[len(a)], [len(b)]]

    met = lambda block: nearest_pairs.compared(left, right, "g", judge, "l bigint, r bigint", block=block).collect()
    found = met(2)
    assert len(found) <= nearest_pairs.SIDE**2 and sum(r["l"] * r["r"] for r in found) == 200 * 200
    # but no block grows without a bound
    monkeypatch.setattr(nearest_pairs, "MOST", 5)
    found = met(2)
    assert len(found) > 30**2 and sum(r["l"] * r["r"] for r in found) == 200 * 200


@pytest.mark.parametrize("name", ["profile_distance", "mutual_best", "self_identify"])
def test_pair_queries_shuffle_no_pairs(spark, name):
    from evenkeel.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def plan_of(spark, name):
    from evenkeel.plans.registry import QUERIES

    # as where size alone gives no broadcast
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", ["impute_regime", "feat_trend", "cell_bss", "season_residual", "context_prior", "feat_interaction", "decile_transfer"])
def test_rows_are_not_dealt_by_few_keys(spark, name):
    plan = plan_of(spark, name)
    assert "SortMergeJoin" not in plan.replace("SortMergeJoin [_part", "") and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["quartile_spread", "decile_transfer"])
def test_cuts_of_prices_hold_no_map_of_values(spark, name):
    assert "percentile(" not in plan_of(spark, name)


def test_frequent_values_are_one_row_of_a_quantile(spark, monkeypatch):
    sizes = []
    staged = ranking.staged
    monkeypatch.setattr(ranking, "staged", lambda df, name: sizes.append(df.count()) or staged(df, name))
    rows = spark.range(3000).select(F.lit(0).alias("k"), (F.col("id") % 3 / 1.0).alias("x"))
    assert ranking.exact_quantiles(rows, ["k"], "x", [0.0, 0.5, 1.0]).first()["q"] == [0.0, 1.0, 2.0]
    assert sizes and max(sizes) == 3


def test_a_difference_of_exactly_the_bound_is_not_close(spark):
    from evenkeel.plans.sequences import _close

    # 0.05 apart, from sums in two orders, and truly nearer
    rows = [(1.0, 0.95 + 2.5e-14, False), (1.0, 0.95 - 2.5e-14, False), (0.3, 0.25, False), (1.0, 0.950002, True), (0.95, 1.0, False)]
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x double, y double, want boolean").select("i", "want", _close(F.col("x"), F.col("y")).alias("got"))
    assert all(r["got"] == r["want"] for r in made.collect())


def test_matchings_leave_a_task_in_bounded_parts():
    made = ([(g, k) for k in range(90)] for g in range(100))
    parts = list(matching.in_parts(made, ["g", "k"], most=50))
    assert max(map(len, parts)) == 50 and [tuple(r) for p in parts for r in p.itertuples(index=False)] == [(g, k) for g in range(100) for k in range(90)]
    assert not list(matching.in_parts(iter([[], []]), ["g", "k"]))


@pytest.mark.parametrize("name", ["null_permutations", "false_accepts"])
def test_means_as_far_apart_as_the_bound_are_judged_as_their_sql_does(spark, tmp_path, name):
    import duckdb

    from evenkeel.plans.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i % 30 AS user_id, 'view' AS event_type, (hash(i) % 40)::DOUBLE / 100 AS value, '{}' AS props FROM range(150) r(i)")
    con.execute(f"COPY (SELECT * FROM events ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    rows = QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())


def test_doubtful_means_do_not_depend_on_how_rows_are_dealt(spark):
    from evenkeel.plans.sequences import _accepts

    values = {1: [30.13, 0.1, 0.2, 0.3, 12.29, 0.07], 2: [30.13, 0.1, 0.2, 0.3, 12.29, 0.37]}
    rows = [(u, 10 * k + u, v) for u, x in values.items() for k, v in enumerate(x)] + [(3, 1, 7.0), (3, 2, None), (4, 4, None)]
    pairs = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 3), (1, 3, 4)], "trial int, left bigint, right bigint")
    want = None
    for dealt in (1, 3, 7):
        history = spark.createDataFrame(rows[::-1], "uid bigint, event_id bigint, value double").repartition(dealt)
        got = sorted(map(tuple, _accepts(history, pairs).collect()))
        want = want or got
        assert got == want and got[0][0:2] == (0, 3) and got[1] == (1, 1, 0)
    # sum() itself would add with a correction
    x, y = (reduce(lambda a, b: a + b, v) / len(v) for v in values.values())
    assert got[0][2] == 1 + 2 * (abs(x - y) < 0.05)


def test_context_prior_gives_the_whole_record_of_every_row(spark, tmp_path):
    import duckdb

    from evenkeel.plans.registry import ORACLE_SQL, QUERIES
    from evenkeel.sources.tables import Tables

    con = duckdb.connect()
    # some history outside the legal contexts, and rows without a context or a cutoff
    odd = {"events": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -user_id ELSE user_id END AS user_id", "lineitem": "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate"}
    for name, columns in odd.items():
        again = 6 if name == "events" else 1
        con.execute(f"COPY (SELECT e.* REPLACE ({columns}) FROM '/root/testdata/sf0.001/{name}.parquet' e, range({again}) r(k)) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    t = Tables(spark, str(tmp_path))
    families, ranges = ["fastball", "breaking", "offspeed", "other"], [range(4), range(3), range(3)]
    legal = lambda context: all(v in r for v, r in zip(context, ranges))
    history = [(r["season"], (r["balls"], r["strikes"], r["outs"]), r["family"]) for r in t.history.collect()]
    assert not all(legal(c) for _, c, _ in history)

    def record(season, context):
        past = [(c, f) for s, c, f in history if season is not None and season in range(2019, 2026) and s < season and legal(c)]
        if not past:
            return ("NO_HISTORY", 0, *[None] * 6)
        share = lambda rows: [sum(f == x for _, f in rows) / len(rows) for x in families]
        fine, wide = ([r for r in past if r[0][:n] == context[:n]] for n in (3, 2))
        level, rows = ("L0", fine) if len(fine) >= 100 else ("L1", wide) if len(wide) >= 100 else ("global", past)
        p = share(rows)
        return (level, len(rows), *p, -sum(x * math.log(x) for x in p if x) / math.log(4), sum(abs(a - b) for a, b in zip(p, share(past))) / 2)

    made = QUERIES["context_prior"](spark, str(tmp_path))
    names = ["backoff_level", "support", *[f"p_{f}" for f in families], "entropy", "tv"]
    rows, want = made.collect(), {}
    contexts = t.main.select("rk", "season", "balls", "strikes", "outs").collect()
    for r in contexts:
        key = (r["season"], (r["balls"], r["strikes"], r["outs"]))
        if key not in want:
            want[key] = (*[round(v, 6) + 0.0 if isinstance(v, float) else v for v in record(*key)], int(legal(key[1]) and key[0] is not None and key[0] >= 2019))
    assert len(rows) == len(contexts) and len({v[0] for v in want.values()}) >= 3 and {v[-1] for v in want.values()} == {0, 1}
    shown = lambda values: repr([round(v, 5) + 0.0 if isinstance(v, float) else v for v in values])
    got = sorted(shown([r["rk"], *[r[n] for n in names], r["legal"]]) for r in rows)
    assert got == sorted(shown([r["rk"], *want[r["season"], (r["balls"], r["strikes"], r["outs"])]]) for r in contexts)
    found = con.execute(ORACLE_SQL["context_prior"])
    order = [d[0] for d in found.description]
    assert sorted(shown([r[c] for c in order]) for r in rows) == sorted(map(shown, found.fetchall()))
