import math

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import exprs
from evenkeel.operators import calibration, drift, encode, folds, governance, grouped, history, matching, ranking, sampling, scoring, sequences
from evenkeel.sources import readers, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hand_computed_statistics(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert rows.agg(F.var_pop("x")).first()[0] == 1.25
    zero = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "x double")
    q = zero.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    assert q[1] == 1.5 and q[2] - q[0] == 1.5


def test_ratios_and_dates(spark):
    r = one(spark, exprs.safe_ratio(F.lit(1.0), F.lit(0.0)), exprs.safe_ratio(F.lit(1.0), F.lit(float("nan"))), exprs.safe_ratio(F.lit(1.0), F.lit(4.0)))
    assert list(r) == [None, None, 0.25]
    texts = ["2024-02-29", "2/29/2024", "2/30/2024", "2023-02-29", "", "  ", None, "13/1/2024", "2024/01/01", "12/31/2019"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", exprs.parse_date(F.col("t")).cast("string").alias("d")).orderBy("i").collect()
    assert [r["d"] for r in rows] == ["2024-02-29", "2024-02-29", None, None, None, None, None, None, None, "2019-12-31"]


def test_buckets_and_sigmoids(spark):
    n = [None, 0, 1, 2, 10, 11, 50, 51, 100, 101]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(n)], "i int, n int").select("i", exprs.right_closed(F.col("n"), [0, 1, 10, 50, 100]).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in rows] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4]
    a, b, c = one(spark, exprs.sigmoid(F.lit(-800.0)), exprs.sigmoid(F.lit(800.0)), exprs.deployed(F.lit(10.0), -0.04))
    assert (a, b, c) == (0.0, 1.0, 0.7)
    assert one(spark, exprs.smoothed_rate(F.lit(None).cast("int"), F.lit(0.1), F.lit(0.4), 50))[0] == 0.4
    assert one(spark, exprs.smoothed_rate(F.lit(0), F.lit(None).cast("double"), F.lit(0.4), 50))[0] is None


def test_values_and_lexemes(spark):
    texts = ["3", " 3", "3.0", "3.5", "x", "", None, "NaN", "9", "-1", "1e0"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    kinds = [r[0] for r in rows.select(exprs.classify_value(F.col("t"), 0, 3)).collect()]
    assert kinds == ["legal", "legal", "legal", "non_integer", "unparseable", "missing", "missing", "nonfinite", "out_of_domain", "out_of_domain", "legal"]
    lex = [r[0] for r in rows.select(exprs.lexical_kind(F.col("t"))).collect()]
    assert lex[:4] == ["integer_lexeme", "whitespace_variant", "decimal_lexeme", "decimal_lexeme"] and lex[5] == lex[6] == "empty" and lex[10] == "exponent_lexeme"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(s, k % 4, k % 3, f, float(s - 2000 + k)) for s in range(2019, 2023) for k in range(40) for f in ("a", "b")]
    return spark.createDataFrame(rows, "season int, balls int, strikes int, family string, value double")


def test_strict_past_ignores_the_same_and_later_seasons(spark, log):
    sums = {"n": F.lit(1).cast("long"), "s": F.col("value")}
    clean = history.past_sums(log, ["balls"], sums, 2019, 2022)
    poison = log.union(spark.createDataFrame([(2022, 0, 0, "a", 1e9), (2030, 0, 0, "a", 1e9)], log.schema))
    assert governance.same_rows(clean, history.past_sums(poison, ["balls"], sums, 2019, 2022))
    assert clean.where("cutoff = 2019").count() == 0
    want = {(2020, 0): 20, (2021, 0): 40, (2022, 0): 60}
    assert {(r["cutoff"], r["balls"]): r["n"] for r in clean.where("balls = 0").collect()} == want
    shuffled = log.orderBy(F.desc("value")).repartition(7)
    assert governance.same_rows(clean, history.past_sums(shuffled, ["balls"], sums, 2019, 2022))
    middle = lambda rows: {(r["balls"], r["cutoff"]): (r["n"], r["q"][0]) for r in history.past_quantiles(rows, ["balls"], "value", [0.5], 2019, 2022).collect()}
    assert middle(log) == middle(poison) and min(c for _, c in middle(log)) == 2020


def test_backoff_takes_the_first_level_with_support(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 3)], "id int, a int, b int")
    fine = spark.createDataFrame([(1, 1, 100, 0.1), (1, 2, 99, 0.2)], "a int, b int, n int, v double")
    wide = spark.createDataFrame([(1, 150, 0.3), (2, 99, 0.4)], "a int, n int, v double")
    got = history.backoff(rows, [("L0", fine, ["a", "b"], "v"), ("L1", wide, ["a"], "v")], 100).orderBy("id").collect()
    assert [(r["level"], r["value"]) for r in got] == [("L0", 0.1), ("L1", 0.3), ("NO_HISTORY", None), ("NO_HISTORY", None)]


def test_folds_never_train_on_their_own_season(spark, log):
    table = folds.fold_table(spark, [("x", 2021, None), ("y", 2022, "R")])
    made = folds.in_folds(log.withColumn("game_type", F.when(F.col("balls") > 1, "R").otherwise("F")), table)
    assert made.where("role = 'train' AND season >= valid_season").count() == 0
    assert made.where("fold = 'y' AND game_type <> 'R'").count() == 0
    assert folds.overlap(made.where("fold = 'x' AND role = 'train'"), made.where("fold = 'x' AND role = 'valid'"), "season").first()["n"] == 0


def test_distances(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "c string, share double")
    b = spark.createDataFrame([("y", 0.25), ("z", 0.75)], "c string, share double")
    assert grouped.total_variation(a, b, "c").first()["tv"] == 0.75
    c = F.lit
    r = one(spark, drift.smd_pooled_sample(c(1.0), c(0.0), c(5), c(2.0), c(0.0), c(5)), drift.smd_pooled_population(c(1.0), c(1.0), c(2.0), c(1.0)), drift.boundary_exceeds(c(1.0), c(0.5), c(1)))
    assert list(r) == [None, 1.0, None]


def test_average_ranks(spark):
    rows = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 30.0)], "g int, x double")
    assert sorted(r["r"] for r in ranking.average_ranks(rows, "x", "r", ["g"]).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_quotas_and_systematic_places(spark):
    strata = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, n long")
    got = {r["s"]: r["quota"] for r in sampling.quotas(strata, ["s"], 7).collect()}
    assert sum(got.values()) == 7 and got == {"a": 4, "b": 2, "c": 1}
    assert {r["s"]: r["quota"] for r in sampling.quotas(strata, ["s"], 99).collect()} == {"a": 5, "b": 3, "c": 2}
    rows = spark.createDataFrame([("a", i) for i in range(10)], "s string, i int")
    quota = spark.createDataFrame([("a", 10, 3)], "s string, n long, quota long")
    assert sorted(r["i"] for r in sampling.systematic(rows, ["s"], ["i"], quota).collect()) == [math.floor((2 * j + 1) * 10 / 6) for j in range(3)]


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(20_000).select(sampling.poisson_weight(sampling.unit_hash(F.col("id").cast("string"))).alias("w"))
    r = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.06


def test_scores(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int")
    assert rows.agg(scoring.skill(F.col("p"), F.col("y"))).first()[0] == 0.0
    assert rows.where("y = 1").agg(scoring.skill(F.col("p"), F.col("y"))).first()[0] is None
    assert len(scoring.simplex(3, 20)) == 231 and all(sum(w) == 20 for w in scoring.simplex(3, 20))


def test_runs_and_prefixes(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(["a", "a", None, None, "b", "a"])], "e int, i int, k string")
    assert [r["run"] for r in sequences.run_ids(rows, "e", ["i"], F.col("k")).orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
    pairs = [([1, 2, 3], [1, 2, 4], 2), ([1], [1, 2], 1), ([], [1], 0), ([2], [1], 0)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a array<int>, b array<int>")
    assert [r[0] for r in got.orderBy("i").select(sequences.common_prefix(F.col("a"), F.col("b"))).collect()] == [n for *_, n in pairs]


def test_majority_and_mutual_best(spark):
    pairs = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, 9), (2, 3)], "l int, r int")
    got = {r["l"]: (r["r"], round(r["confidence"], 3)) for r in sequences.majority(pairs, "l", "r").collect()}
    assert got == {1: (5, 0.667), 2: (3, 0.5)}
    d = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.5), (2, 1, 0.05), (2, 2, 0.05), (3, 3, 0.2)], "l int, r int, d double")
    best = {(r["l"], r["r"]): r["status"] for r in sequences.mutual_best(d, "l", "r", "d").collect()}
    assert best == {(2, 1): "ambiguous", (3, 3): "accepted"}


def test_matching(spark):
    assert len(matching.maximum_matching([(1, 1), (1, 2), (2, 1), (3, 2), (3, 3)])) == 3
    assert len(matching.maximum_matching([(1, 1), (2, 1), (3, 1)])) == 1
    pairs = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("b", 7, 7)], "c string, left long, right long")
    assert {tuple(r) for r in matching.match_components(pairs, "c").collect()} == {(1, 2), (2, 1), (7, 7)}
    ids = spark.range(7).withColumnRenamed("id", "e")
    nulls = matching.null_assignments(ids, "e", 5, "calibration").collect()
    assert len(nulls) == 35 and all(r["e"] != r["other"] for r in nulls)
    assert all(len({r["other"] for r in nulls if r["trial"] == t}) == 7 for t in range(5))


def test_calibration(spark):
    rows = spark.range(4000).select((F.col("id") % 2).cast("int").alias("g"), (0.2 + (F.col("id") % 7) / 10).alias("p"), (F.pmod(F.hash("id"), F.lit(100)) / 100).alias("u"))
    rows = rows.select("g", "p", F.when(F.col("u") < F.col("p") * 0.5 + 0.2, 1).otherwise(0).alias("y"), exprs.logit(F.col("p")).alias("z"))
    for features in (calibration.platt_features, calibration.beta_features):
        made = calibration.logistic(rows, rows, "p", "y", features)
        assert abs(made.agg(F.avg("calibrated") - F.avg("y")).first()[0]) < 1e-3
    iso = calibration.isotonic(rows, rows, "p", "y")
    means = [r[0] for r in iso.groupBy("p").agg(F.avg("calibrated").alias("c")).orderBy("p").select("c").collect()]
    assert means == sorted(means)
    beta = calibration.subgroup_intercepts(rows, "g", "z", "y").collect()
    assert abs(sum(r["n"] * r["raw"] for r in beta)) < 1e-6 and all(abs(r["beta"]) <= 0.05 for r in beta)


def test_firewall_and_seals(spark, log):
    wall = governance.LabelFirewall({2019, 2020}, 2022)
    assert wall.labels(log, 2019).count() == 80
    for season in (2021, 2022):
        with pytest.raises(governance.FirewallError):
            wall.labels(log, season)
    wall.freeze("c1")
    assert wall.labels(log, 2022).count() == 80
    with pytest.raises(governance.FirewallError):
        wall.labels(log, 2022)
    p = spark.range(50).select("id", (F.col("id") / 100).alias("p"))
    digest = governance.seal(p, "id", "p")
    governance.check_seal(p.orderBy(F.desc("id")).repartition(5), "id", "p", digest)
    with pytest.raises(governance.FirewallError):
        governance.check_seal(p.withColumn("p", F.col("p") + 0.01), "id", "p", digest)
    assert governance.one_hot(spark.createDataFrame([("b",), (None,), ("z",)], "c string"), "c", ["b", "a"]).columns == ["c", "c=a", "c=b"]


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("id,season,v\n1,2019,0.5\n2,2020,\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("season", T.IntegerType()), T.StructField("v", T.DoubleType())])
    rows = readers.scan_csv(spark, path, schema)
    assert [tuple(r) for r in rows.collect()] == [(1, 2019, 0.5), (2, 2020, None)]
    with pytest.raises(readers.ContractError):
        readers.validate_header(spark, path, ["id", "v", "season"])
    with pytest.raises(readers.ContractError):
        readers.project(rows, ["id", "v"], forbidden=("v",))
    with pytest.raises(readers.ContractError):
        readers.scoped(rows, [2020], {2019})
    assert readers.at_positions(rows, rows.where("id = 2"), "id").count() == 1
    with pytest.raises(readers.ContractError):
        readers.attach_targets(rows, rows.where("id = 1").select("id"), "id")
    clean = readers.missing_to_null(spark.createDataFrame([("", float("nan")), ("a", 1.0)], "s string, d double")).collect()
    assert [tuple(r) for r in clean] == [(None, None), ("a", 1.0)]
    sinks.golden_csv(rows, str(tmp_path / "gold"), ["id"])
    a = sinks.report(rows.select("id", "season"), str(tmp_path / "r1"))
    assert a == sinks.report(rows.orderBy(F.desc("id")).select("season", "id"), str(tmp_path / "r2"))
    assert sinks.cache_key({"a": 1, "b": 2}) == sinks.cache_key({"b": 2, "a": 1})
    calls = []
    for _ in range(2):
        assert sinks.cached(lambda: calls.append(1) or rows, {"k": 1}, spark, str(tmp_path / "cache")).count() == 2
    assert len(calls) == 1
    template = spark.createDataFrame([(2, 0), (1, 1), (3, 2)], "id long, pos int")
    made = sinks.in_template_order(template, rows, "id", "pos", "v", placeholder=0.25).collect()
    assert [tuple(r) for r in made] == [(2, 0.25), (1, 0.5), (3, 0.25)]


def test_chunks_accumulate_to_the_batch_counts(spark, tmp_path):
    from evenkeel.streaming import increments

    rows = spark.createDataFrame([(str(i), " x" if i % 3 else "") for i in range(60)], "a string, b string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    batch = increments.lexical_counts(spark.read.parquet(str(tmp_path / "in")), ["a", "b"])
    stream = increments.lexical_counts(increments.chunks(spark, str(tmp_path / "in"), rows.schema), ["a", "b"])
    assert governance.same_rows(batch, increments.run_to_end(stream, "lexical", str(tmp_path / "cp")))


def test_golden_delta_equals_difference_of_rates(spark):
    from evenkeel.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    from evenkeel.sources.tables import Tables

    rates = {(r["season"], r["balls"], r["strikes"]): r["rate"] for r in grouped.rate_table(Tables(spark, sf).main, ["season", "balls", "strikes"]).collect()}
    for r in QUERIES["yoy_delta"](spark, sf).where("delta IS NOT NULL").collect():
        assert r["delta"] == pytest.approx(rates[2024, r["balls"], r["strikes"]] - rates[2023, r["balls"], r["strikes"]], abs=1e-6)


def test_positions_within_groups(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.hash("id").alias("x"), F.when(F.col("id") % 3 == 0, None).otherwise("k").alias("h"))
    got = ranking.ordinal_positions(rows, ["g", "h"], [F.col("x")]).collect()
    for g in range(3):
        mine = sorted((r["position"], r["x"], r["total"]) for r in got if r["g"] == g)
        assert [p for p, *_ in mine] == list(range(len(mine))) and [x for _, x, _ in mine] == sorted(x for _, x, _ in mine)
        assert {t for *_, t in mine} == {len(mine)}


def test_contracts_and_decisions(spark):
    governance.check_contract({"a": 1}, {"a": 1})
    with pytest.raises(governance.FirewallError):
        governance.check_contract({"a": 1}, {"a": 1, "b": 2})
    m = spark.createDataFrame([("x", 10), ("y", 3)], "g string, n int")
    governance.check_aggregate_only(m, "n", 3)
    for least, identifiers in ((4, ()), (1, ("g",))):
        with pytest.raises(governance.FirewallError):
            governance.check_aggregate_only(m, "n", least, identifiers)
    e = spark.createDataFrame([("b", 2.0), ("b", 4.0), ("a", 3.0), ("a", 3.0), ("c", 9.0), ("c", None), ("d", 9.0), ("d", 0.5)], "candidate string, gain double")
    assert governance.freeze_decision(e, "gain", 1.0, 2) == "a"
    assert governance.freeze_decision(e, "gain", 5.0, 2) is None


def test_repeated_columns_go(spark):
    rows = spark.createDataFrame([(1, 1, None, 2), (2, 2, None, 2)], "a int, b int, c int, d int")
    assert encode.without_repeated_columns(rows).columns == ["a", "c", "d"]


def test_vocabulary_and_scaler(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 1.0)], "c string, x double")
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("z", 9.0), (None, 1.0)], "c string, x double")
    codes = {r["c"]: r["k"] for r in encode.vocabulary_codes(rows, train, "c", "k").collect()}
    assert codes == {"a": 1, "b": 2, "z": 0, None: 0}
    assert sorted(r["x_z"] for r in encode.scaled(rows, encode.fit_scaler(train, ["x"]), ["x"]).collect()) == [0.0, 0.0, 0.0, 5.0]


def test_exact_quantiles(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (0, 1, 2, 3)] + [("b", 5.0), ("b", None), ("b", 5.0)], "k string, x double")
    got = {r["k"]: r["q"] for r in ranking.exact_quantiles(rows, ["k"], "x", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {"a": [0.0, 0.75, 1.5, 3.0], "b": [5.0] * 4}


def test_bootstraps_take_as_many_replicates_as_the_reference(spark):
    from evenkeel.plans import sampling as plans
    from evenkeel.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert plans.bootstrap_rows(t, replicates=1000).first()["replicates"] == 1000
    few, many = plans.bootstrap_cluster(t, replicates=1000).first(), plans.bootstrap_cluster(t).first()
    assert (few["replicates"], many["replicates"]) == (1000, 10_000)
    assert few["lb5"] != many["lb5"] < many["med"]
    pooled = plans.bootstrap_pooled(t, replicates=1000).first()
    assert pooled["p5"] < pooled["p50"] < pooled["p95"]


def test_searches_are_refined_off_the_coarse_grid(spark):
    z = F.col("id") / 1000.0 - 2
    rows = spark.range(4001).select(z.alias("z"), F.sin(F.col("id")).alias("z1"), F.lit(0.0).alias("z2"))
    made = rows.withColumn("y", 1 / (1 + F.exp(-(0.913 * F.col("z") - 0.04))))
    slope, score = scoring.slope_search(made, "z", "y", -0.04)
    assert slope == pytest.approx(0.913, abs=1e-9) and score == pytest.approx(0, abs=1e-12)
    edge = scoring.slope_search(rows.withColumn("y", 1 / (1 + F.exp(-3 * F.col("z")))), "z", "y")
    assert edge[0] == pytest.approx(1.4)
    mixed = rows.withColumn("y", 1 / (1 + F.exp(-(0.37 * F.col("z") + 0.45 * F.col("z1")))))
    weights, score = scoring.weight_search(mixed, ["z", "z1", "z2"])
    assert weights == pytest.approx((0.37, 0.45, 0.18)) and score == pytest.approx(0, abs=1e-12)


def test_cross_fit_never_sees_its_own_fold(spark):
    from evenkeel.operators.calibration import cross_fit

    rows = spark.createDataFrame([(i, i % 3, float(i % 7) / 7) for i in range(30)], "id int, fold int, p double")
    fits = []

    def shift(train, part):
        fits.append({r["fold"] for r in train.select("fold").distinct().collect()} & {r["fold"] for r in part.select("fold").distinct().collect()})
        return part.withColumn("calibrated", F.col("p") + F.lit(train.count()))

    got = cross_fit(rows, "fold", 3, shift).collect()
    assert fits == [set()] * 3 and sorted(r["id"] for r in got) == list(range(30))
    assert all(r["calibrated"] == pytest.approx(r["p"] + 20) for r in got)


def test_screen_gate_fails_closed(spark):
    from evenkeel.operators.scoring import screen_gate

    c = lambda v: F.lit(v).cast("double")
    r = one(spark, screen_gate(c(1.5), c(0.2), c(0.21), c(-0.004)), screen_gate(c(1.5), c(0.2), c(0.21), c(0.006)), screen_gate(c(None), c(0.2), c(0.21), c(0.0)), screen_gate(c(1.5), c(0.2), c(0.21), c(0.0), c(-0.1)), screen_gate(c(1.5), c(0.22), c(0.21), c(0.0)))
    assert list(r) == [True, False, False, False, False]


def test_stratified_folds_deal_sorted_classes_round(spark):
    from evenkeel.operators.encode import stratified_folds

    ys = [1, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1, 0]
    rows = spark.createDataFrame(list(enumerate(ys)), "id int, y int")
    got = {r["id"]: r["fold"] for r in stratified_folds(rows, "id", "y", 3).collect()}
    order = sorted(ys)
    want, left = {}, {c: [order[i::3].count(c) for i in range(3)] for c in (0, 1)}
    for i, y in enumerate(ys):
        k = next(f for f in range(3) if left[y][f])
        left[y][k] -= 1
        want[i] = k
    assert got == want


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from evenkeel.sources import stage

    class Context:
        master = "spark://somewhere"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False), "isEmpty": staticmethod(lambda: True)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_dir(session)


def test_running_sums_over_ranges(spark):
    values = [(None, 0), *[(v, v % 4) for v in range(-50, 250, 3)]]
    rows = spark.createDataFrame(values, "v int, k bigint").repartition(5)
    got = {r["v"]: r["b"] for r in ranking.running_before(rows, [F.col("v")], "k", "b").collect()}
    assert got == {v: sum(k for w, k in values if w is not None and v is not None and w < v) for v, _ in values}
    assert ranking.running_before(rows.limit(0), [F.col("v")], "k", "b").count() == 0
