"""Contract comparison, lineage, cost policy, assets and scrubbing."""

import random
import time
from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from ledgerline.functions import scrub
from ledgerline.operators import assets, contract_diff, cost, lineage
from ledgerline.session import stored
from ledgerline.sources import derived
from ledgerline.sources.tables import lag_report, result_report

COLUMNS = "model string, column string, data_type string, required boolean, description string"
MODELS = (
    "model string, grain string, contract_enforced boolean, materialized string, "
    "unique_key string, owner string, sla string, tests array<string>"
)


def column(name, kind="bigint", required=False, description="", model="m"):
    return (model, name, kind, required, description)


def model(name="m", grain="Grain: one row. More", enforced=True, materialized="table", key="id",
          owner="a", sla="45", tests=("unique:id", "not_null:id")):
    return (name, grain, enforced, materialized, key, owner, sla, list(tests))


def findings(spark, old_columns, new_columns, old_models=None, new_models=None):
    result = contract_diff.compare_contracts(
        spark.createDataFrame(old_models or [model()], MODELS),
        spark.createDataFrame(new_models or [model()], MODELS),
        spark.createDataFrame(old_columns, COLUMNS),
        spark.createDataFrame(new_columns, COLUMNS),
    )
    return values(result, "column", "change_type", "severity")


ID = column("id", required=True)


@pytest.mark.parametrize("old, new, expected", [
    ([ID, column("a")], [ID], [("a", "published_column_removed", "blocking")]),
    ([ID], [ID, column("a")], [("a", "nullable_column_added", "info")]),
    ([ID], [ID, column("a", required=True)], [("a", "required_column_added", "manual_review")]),
    ([ID, column("a", "BIGINT")], [ID, column("b", "bigint")],
     [("a -> b", "published_column_rename", "blocking")]),
    ([ID, column("a", "text")], [ID, column("b")],
     [("a", "published_column_removed", "blocking"), ("b", "nullable_column_added", "info")]),
    ([ID, column("a", "")], [ID, column("b", "")],
     [("a", "published_column_removed", "blocking"), ("b", "nullable_column_added", "info")]),
    ([ID, column("a")], [ID, column("a", "text")],
     [("a", "incompatible_data_type_change", "blocking")]),
    ([ID, column("a")], [ID, column("a", required=True)], [("a", "nullable_to_required", "blocking")]),
    ([ID, column("x_count", description="a")], [ID, column("x_count", description="b")],
     [("x_count", "metric_description_changed", "manual_review")]),
    ([ID, column("x", description="a")], [ID, column("x", description="b")], []),
    ([ID], [ID], []),
])
def test_column_changes(spark, old, new, expected):
    assert findings(spark, old, new) == expected


@pytest.mark.parametrize("changed, expected", [
    (dict(enforced=False), [(None, "contract_removed", "blocking")]),
    (dict(grain="Grain: other. More"), [(None, "grain_changed", "blocking")]),
    (dict(grain="Grain: one row. Less"), []),
    (dict(tests=("unique:other", "not_null:id", "unique:id")), [(None, "business_key_changed", "blocking")]),
    (dict(tests=("unique:id",)), [(None, "required_test_removed", "blocking")]),
    (dict(materialized="view"), [(None, "materialization_changed", "manual_review")]),
    (dict(key=None), [(None, "incremental_key_changed", "manual_review")]),
    (dict(owner="b"), [(None, "owner_changed", "manual_review")]),
    (dict(sla=None), [(None, "slo_changed", "manual_review")]),
])
def test_model_changes(spark, changed, expected):
    assert findings(spark, [ID], [ID], new_models=[model(**changed)]) == expected


def test_removed_and_new_models(spark):
    old = [model(), model("gone")]
    new = [model(), model("fresh")]
    columns = [ID, column("a", model="gone")]
    found = findings(spark, columns, [ID, column("b", model="fresh")], old, new)
    assert found == [(None, "published_model_removed", "blocking")]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "upstream string, downstream string")


GRAPH = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a")]


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def test_reach_of_many_starts(spark):
    graph = edges(spark, *GRAPH)
    full = lineage.reach(graph, starts(spark, "a", "d"))
    assert values(full) == [
        ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3),
        ("d", "a", 2), ("d", "b", 3), ("d", "c", 3), ("d", "e", 1),
    ]
    assert lineage.walked_edges(graph, starts(spark, "a", "d"), full).count() == 6
    assert values(lineage.reach(graph, starts(spark, "a"), max_depth=1), "node") == [("b",), ("c",)]
    up = lineage.reach(graph, starts(spark, "d"), downstream=False, max_depth=2)
    assert values(up, "node", "depth") == [("a", 2), ("b", 1), ("c", 1)]


def test_reach_of_a_hub_and_of_a_long_chain_is_whole(spark):
    hub = spark.range(5000).select(F.lit("hub").alias("upstream"),
                                   F.format_string("n%05d", "id").alias("downstream"))
    assert lineage.reach(hub, starts(spark, "hub")).count() == 5000
    chain = edges(spark, *[(f"c{n:02d}", f"c{n + 1:02d}") for n in range(12)])
    deepest = lineage.reach(chain, starts(spark, "c00")).agg(F.max("depth")).first()[0]
    assert deepest == 12
    assert lineage.impact_paths(chain, starts(spark, "c00")).count() == 12


def test_edges_impact_and_endpoints(spark):
    catalog = spark.createDataFrame([("a", "source"), ("b", "staging"), ("d", "marts")],
                                    "asset_id string, layer string")
    declared = spark.createDataFrame([("b", ["a", "zz"]), ("d", ["b", "b"])],
                                     "asset_id string, upstream array<string>")
    built = lineage.build_edges(declared, catalog)
    assert values(built, "upstream", "downstream") == [("a", "b"), ("b", "d")]
    assert lineage.unknown_endpoints(built, catalog).count() == 0
    assert values(lineage.unknown_endpoints(edges(spark, ("a", "q")), catalog)) == [("q",)]
    assert values(lineage.impact(built, catalog, starts(spark, "a")), "asset_id", "is_published") == [
        ("b", False), ("d", True)
    ]


def test_impact_paths(spark):
    begin = starts(spark, "a", "e")
    found = values(lineage.impact_paths(edges(spark, *GRAPH), begin).filter("start = 'a'"), "path")
    assert sorted(p for (p,) in found) == [
        ["a", "b"], ["a", "b", "d"], ["a", "b", "d", "e"], ["a", "b", "d", "e", "a"],
        ["a", "c"], ["a", "c", "d"],
    ]
    short = lineage.impact_paths(edges(spark, *GRAPH), begin, max_depth=1)
    assert values(short, "path") == [(["a", "b"],), (["a", "c"],), (["e", "a"],)]


ESTIMATE = (
    "query_id bigint, model string, valid boolean, total_bytes_processed bigint, "
    "partition_filter_present boolean, requested_scan_window_days int, "
    "maximum_scan_window_days int, has_waiver boolean, waiver_owner string, waiver_reason string, "
    "waiver_expires_at string, waiver_approved_bytes bigint"
)
WAIVER = dict(has_waiver=True, waiver_owner="o", waiver_reason="r",
              waiver_expires_at="2027-01-01T00:00:00Z", waiver_approved_bytes=900_000_000)
M = 268435456


@pytest.mark.parametrize("changes, decision", [
    ({}, "pass"),
    (dict(total_bytes_processed=M - 1), "pass"),
    (dict(total_bytes_processed=M), "warn"),
    (dict(total_bytes_processed=2 * M), "block"),
    (dict(total_bytes_processed=2 * M, **WAIVER), "pass"),
    (dict(total_bytes_processed=2 * M, **{**WAIVER, "waiver_owner": " "}), "block"),
    (dict(total_bytes_processed=2 * M, **{**WAIVER, "waiver_expires_at": "2026-01-01T00:00:00Z"}), "block"),
    (dict(total_bytes_processed=2 * M, **{**WAIVER, "waiver_expires_at": "2027-01-01T00:00:00"}), "block"),
    (dict(total_bytes_processed=2 * M, **{**WAIVER, "waiver_approved_bytes": 2 * M - 1}), "block"),
    (dict(total_bytes_processed=None), "invalid"),
    (dict(valid=False), "invalid"),
    (dict(partition_filter_present=False), "block"),
    (dict(model="fct_orders", partition_filter_present=False), "pass"),
    (dict(requested_scan_window_days=32), "block"),
    (dict(requested_scan_window_days=0), "block"),
    (dict(maximum_scan_window_days=None), "block"),
    (dict(model="anything", total_bytes_processed=2 * M), "warn"),
])
def test_cost_decisions(rows, spark, changes, decision):
    base = dict(query_id=1, model="mart_daily_sales", valid=True, total_bytes_processed=1,
                partition_filter_present=True, requested_scan_window_days=7,
                maximum_scan_window_days=31, has_waiver=False)
    frame = rows([{**base, **changes}], ESTIMATE)
    result = cost.evaluate_costs(frame, cost.default_policy(spark), datetime(2026, 8, 6)).first()
    assert result.decision == decision


def test_policy_rows(rows, spark):
    assert cost.invalid_policies(cost.default_policy(spark)).count() == 0
    bad = rows([dict(model="a", warning_threshold_bytes=2, blocking_threshold_bytes=2, cost_class="x"),
                dict(model="b", warning_threshold_bytes=1, blocking_threshold_bytes=2, cost_class=" ")],
               cost.POLICY_COLUMNS)
    assert cost.invalid_policies(bad).count() == 2


def test_scrubbing(rows):
    frame = rows([dict(t="see HTTPS://u:p@h/x?y 'ok' Bearer aB.c-1 end, postgresql://h/db\"")], "t string")
    assert frame.select(scrub.scrub_text("t")).first()[0] == (
        "see [REDACTED] 'ok' [REDACTED] end, [REDACTED]\""
    )
    fields = frame.select(F.create_map(F.lit("Private-Key"), F.lit("x"), F.lit("n"), F.lit("http://a b"),
                                       F.lit("apiToken2"), F.lit("y")).alias("m"))
    assert fields.select(scrub.scrub_map("m")).first()[0] == {
        "Private-Key": "[REDACTED]", "n": "[REDACTED] b", "apiToken2": "[REDACTED]"
    }
    assert frame.select(scrub.scrub_array(F.array(F.lit("bearer x")))).first()[0] == ["[REDACTED]"]


def test_assets(rows):
    nodes = rows(
        [dict(asset_id="p.a", name="a", resource_type="model", layer="marts",
              description="Grain: one row per a. More", contract_enforced=True),
         dict(asset_id="p.s", resource_type="source", layer="x", description="Plain.")],
        "asset_id string, name string, resource_type string, layer string, description string, "
        "contract_enforced boolean",
    )
    fresh = rows([dict(asset_id="p.s", status="warn")], "asset_id string, status string")
    results = rows([dict(unique_id="t", status="pass")], "unique_id string, status string")
    parents = rows([dict(unique_id="t", asset_id="p.a")], "unique_id string, asset_id string")
    found = values(assets.assemble_assets(nodes, fresh, results, parents), "asset_id", "name", "layer",
                   "grain", "contract_status", "freshness_status", "quality_status")
    assert found == [
        ("p.a", "a", "marts", "Grain: one row per a", "enforced", None, "pass"),
        ("p.s", "s", "source", None, "not_enforced", "warn", "unknown"),
    ]


def test_json_evidence(spark, tmp_path):
    (tmp_path / "lag.json").write_text(
        '{"observed_at": "2026-08-06T00:00:00Z", "groups": [{"consumer_group": "g", "topic": "t",'
        ' "status": "partial", "rows": [{"consumer_group": "g", "topic": "t", "partition": 0,'
        ' "current_offset": 3, "log_end_offset": 5, "lag": 2, "status": "measured"},'
        ' {"consumer_group": "g", "topic": "t", "partition": 1, "current_offset": null,'
        ' "log_end_offset": 5, "lag": null, "status": "offset_not_available"}]}]}'
    )
    found = values(lag_report(spark, f"{tmp_path}/lag.json"), "partition", "committed_offset", "lag")
    assert found == [(0, 3, 2), (1, None, None)]
    (tmp_path / "results.json").write_text(
        '{"results": [{"unique_id": "t1", "status": "pass"},\n {"unique_id": "t2"}]}'
    )
    assert values(result_report(spark, f"{tmp_path}/results.json")) == [("t1", "pass"), ("t2", "unknown")]


def test_scrubbing_reaches_every_level(spark):
    frame = spark.createDataFrame(
        [(1, ("pw", "see https://u:p@h/x"), [("k", {"api_token": "t", "note": "Bearer abc.d"})], 7)],
        "id int, login struct<password:string,hint:string>, "
        "calls array<struct<name:string,fields:map<string,string>>>, secret_number int",
    )
    row = scrub.scrub_frame(frame).first()
    assert row.id == 1 and row.secret_number is None
    assert tuple(row.login) == ("[REDACTED]", "see [REDACTED]")
    assert row.calls[0].fields == {"api_token": "[REDACTED]", "note": "[REDACTED]"}
    assert scrub.scrub_frame(frame).columns == frame.columns


def test_scrubbing_of_json_text(rows):
    body = '{"user": "a", "password": "p\\"q", "n": {"auth_token" : 12}, "text": "bearer xyz"}'
    frame = rows([dict(t=body)], "t string")
    found = frame.select(scrub.scrub_json_text("t").alias("t")).first().t
    assert found == (
        '{"user": "a", "password": "[REDACTED]", "n": {"auth_token" : "[REDACTED]"}, "text": "[REDACTED]"}'
    )


def brute_paths(graph, start):
    """Paths by a plain walk: nodes are expanded once, at their least depth, from the least node."""
    below = {}
    for a, b in set(graph):
        below.setdefault(a, []).append(b)
    tree, frontier, found = {start: [start]}, [start], []
    while frontier:
        fresh = {}
        for via in sorted(frontier):
            for node in below.get(via, []):
                found.append(tree[via] + [node])
                if node not in tree:
                    fresh.setdefault(node, tree[via] + [node])
        tree.update(fresh)
        frontier = list(fresh)
    return found


def brute_depths(graph, start):
    """Least depth of every node below a start."""
    depths, frontier, depth = {start: 0}, {start}, 0
    while frontier:
        depth += 1
        frontier = {b for a, b in graph if a in frontier} - set(depths)
        depths |= dict.fromkeys(frontier, depth)
    return {node: found for node, found in depths.items() if found}


@pytest.mark.parametrize("limit", [1, 10_000])
def test_walks_with_dealt_lists_and_starts_equal_a_plain_walk(spark, monkeypatch, limit):
    monkeypatch.setattr(lineage, "LIST", limit)
    monkeypatch.setattr(lineage, "SHARE", limit)
    rng = random.Random(9)
    nodes = [f"n{k:02d}" for k in range(12)]
    graph = [(rng.choice(nodes), rng.choice(nodes + ["x", "y", "z"])) for _ in range(40)]
    for walked, downstream in ((graph, True), ([(b, a) for a, b in graph], False)):
        found = values(lineage.reach(edges(spark, *walked), starts(spark, *nodes), downstream=downstream))
        assert found == sorted((s, n, d) for s in nodes for n, d in brute_depths(graph, s).items())
    steps = lineage.impact_steps(edges(spark, *graph), starts(spark, *nodes))
    trees = {(s, p[-1]): p for s in nodes for p in brute_paths(graph, s)[::-1] if p[-1] != s}
    assert steps.filter("is_tree").count() == len(trees)
    found = values(lineage.paths_of(steps, steps.filter("node = 'x'").select("node")))
    assert found == sorted((s, p) for s in nodes for p in brute_paths(graph, s) if p[-1] == "x")


def test_walks_write_lists_and_inner_pairs_only(spark, monkeypatch):
    written = []

    def noted(frame):
        written.append(stored(frame))
        return written[-1]

    monkeypatch.setattr(lineage, "stored", noted)
    # 40 starts by 3 inner nodes by 50 leaves: 120 pairs are walked, 6,000 paths come out
    graph = [(f"s{k}", f"m{m}") for k in range(40) for m in range(3)]
    graph += [(f"m{m}", f"leaf{n}") for m in range(3) for n in range(50)]
    begin = starts(spark, *[f"s{k}" for k in range(40)])
    assert lineage.impact_paths(edges(spark, *graph), begin).count() == 120 + 6000
    assert lineage.reach(edges(spark, *graph), begin).count() == 40 * 53
    assert sum(frame.count() for frame in written) < 1000


def test_impact_paths_of_all_starts_equal_a_plain_walk(spark):
    rng = random.Random(8)
    nodes = [f"n{k:02d}" for k in range(30)]
    graph = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)] + [("n01", "n01"), ("n02", "n03")] * 2
    found = values(lineage.impact_paths(edges(spark, *graph), starts(spark, *nodes)))
    expected = [(s, p) for s in nodes for p in brute_paths(graph, s)]
    assert sorted(found) == sorted(expected)
    steps = lineage.impact_steps(edges(spark, *graph), starts(spark, *nodes))
    assert steps.columns == ["start", "via", "node", "depth", "is_tree"]
    asked = spark.createDataFrame([("n00", p[-1]) for p in brute_paths(graph, "n00")][:3], "start string, node string")
    some = values(lineage.impact_paths(edges(spark, *graph), starts(spark, "n00"), asked=asked), "path")
    wanted = {row.node for row in asked.collect()}
    assert sorted(p for (p,) in some) == sorted(p for p in brute_paths(graph, "n00") if p[-1] in wanted)


def shown(number):
    """Texts of numbered nodes, whose order is not that of the numbers."""
    return F.concat(F.lit("n"), number.cast("string"))


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_numbered_walks_equal_a_plain_walk_of_their_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(lineage, "ROWS", 50 * limit)
    for name in ("LIST", "SHARE"):
        monkeypatch.setattr(lineage, name, limit)
    rng = random.Random(11)
    nodes = [-(1 << 63), -3, 0, 2, 9, 10, 11, 65535, 65536, 1 << 20, 3 << 60, (1 << 63) - 1]
    pairs = [(rng.choice(nodes), rng.choice([*nodes, 7, 70, 700])) for _ in range(45)]
    graph = spark.createDataFrame(pairs, "upstream bigint, downstream bigint")
    begin = spark.createDataFrame([(n,) for n in nodes], "start bigint")
    texts = [(f"n{a}", f"n{b}") for a, b in pairs]
    found = lineage.reach(graph, begin).select(shown(F.col("start")).alias("start"), shown(F.col("node")).alias("node"), "depth")
    assert values(found) == sorted((f"n{s}", n, d) for s in nodes for n, d in brute_depths(texts, f"n{s}").items())
    expected = [(s, p) for s in nodes for p in brute_paths(texts, f"n{s}")]
    assert sorted(values(lineage.impact_paths(graph, begin, text=shown))) == sorted(expected)
    asked = spark.createDataFrame([(700,)], "node bigint")
    for marked in (False, True):
        steps = lineage.impact_steps(graph, begin, text=shown, mark_inner=marked)
        found = values(lineage.paths_of(steps, asked, text=shown))
        assert sorted(found) == sorted((s, p) for s, p in expected if p[-1] == "n700")
        trees = {(s, p[-1]): p[-2] for s, p in expected[::-1] if p[-1] != f"n{s}"}
        tree = steps.filter("is_tree").select("start", shown(F.col("node")), shown(F.col("via")))
        assert {(s, n): via for s, n, via in values(tree)} == trees


def test_walks_expand_no_node_that_has_leaves_only(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lineage, "stored", lambda frame: written.append(stored(frame)) or written[-1])
    graph = [(f"s{k}", f"m{m}") for k in range(4) for m in range(3)]
    graph += [(f"m{m}", f"leaf{n}") for m in range(3) for n in range(5)]
    assert lineage.reach(edges(spark, *graph), starts(spark, *[f"s{k}" for k in range(4)])).count() == 4 * 8
    assert all(frame.count() for frame in written)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = disk.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    assert len(stored(spark.range(1000).groupBy(F.col("id") % 7).count()).collect()) == 7
    deadline = time.time() + 20
    while (left := {name for name in files() - before if name.endswith(".data")}) and time.time() < deadline:
        time.sleep(0.2)
    assert not left


def test_partitions_at_the_starts_follow_from_the_listed_nodes(spark, monkeypatch):
    """Lists are small to shuffle however many rows they spread to."""
    monkeypatch.setattr(lineage, "ROWS", 100)
    graph = spark.range(6000).selectExpr("id DIV 100 AS upstream", "1000 + id AS downstream")
    found = lineage.reach(graph, spark.range(60).withColumnRenamed("id", "start"))
    assert found.count() == 6000
    assert "hashpartitioning(start" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert "_share" in plan and ", 60), REPARTITION_BY_NUM" in plan


def test_node_numbers_stand_for_their_texts(spark):
    keys = [0, 7, -1, -derived._KEY_LIMIT, derived._KEY_LIMIT - 1, None]
    rows = spark.createDataFrame([(k,) for k in keys], "key bigint")
    for kind in derived.NODE_KINDS:
        found = rows.select("key", derived.node_text(derived.node_number(kind, "key"))).collect()
        assert all(text == (None if key is None else f"{kind}.{key}") for key, text in found)
    beyond = spark.createDataFrame([(derived._KEY_LIMIT,)], "key bigint")
    with pytest.raises(Exception, match="beyond 59 bits"):
        beyond.select(derived.node_number("part", "key")).collect()


def shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_comparison_shuffles_once_and_reads_each_input_once(spark, tmp_path):
    names = ("old_models", "new_models", "old_columns", "new_columns")
    records = ([model()], [model(owner="b")], [ID, column("a")], [ID, column("b")])
    stored = []
    for name, rows_, schema in zip(names, records, (MODELS, MODELS, COLUMNS, COLUMNS)):
        spark.createDataFrame(rows_, schema).write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    result = contract_diff.compare_contracts(*stored)
    assert shuffles(result) == 1
    assert result._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 4
    assert values(result, "column", "change_type") == [("a -> b", "published_column_rename"),
                                                       (None, "owner_changed")]


def test_comparison_of_a_wide_model_and_repeated_rows(spark):
    old = [column(f"c{n:05d}") for n in range(5000)]
    new = [column(f"c{n:05d}", required=n == 7) for n in range(1, 5001)]
    found = findings(spark, old + old, new + new, [model()] * 2, [model(), model("other")])
    assert found == [("c00000 -> c05000", "published_column_rename", "blocking"),
                     ("c00007", "nullable_to_required", "blocking")]


def test_columns_of_removed_models_and_null_names(spark):
    models = [model(), (None, *model()[1:])]
    old = [ID, column("a"), column("x", model=None), column(None)]
    found = findings(spark, old, [column("x", "text", model=None)], models, models[1:])
    assert found == [("x", "incompatible_data_type_change", "blocking"),
                     (None, "published_model_removed", "blocking")]


def test_no_previous_snapshot(spark):
    found = contract_diff.compare_contracts(
        None, spark.createDataFrame([model()], MODELS), None, spark.createDataFrame([ID], COLUMNS)
    )
    status = contract_diff.diff_status(found, has_previous=False)
    assert values(status) == [(0, 0, 0, "previous_state_unavailable")]
