"""Small inline graphs, texts and files with exact answers."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparklore import catalog
from sparklore.functions import paths as P1
from sparklore.functions import text as T
from sparklore.operators import graph as G
from sparklore.operators import memory as N
from sparklore.operators import records as M
from sparklore.operators import retrieval as R
from sparklore.operators import symbols as S1
from sparklore.plans.fixtures import Tables
from sparklore.sources import code as C
from sparklore.sources import ingest as I
from sparklore.streaming import maintenance as S


def test_pagerank_diamond(spark):
    edges = spark.createDataFrame([("main", "a"), ("main", "b"), ("a", "util"), ("b", "util")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in ("main", "a", "b", "util")], "node string")
    ranks = {r.node: r["rank"] for r in G.pagerank(edges, nodes, 25).collect()}
    assert max(ranks, key=ranks.get) == "util" and abs(sum(ranks.values()) - 1) < 1e-9


def test_registered_ranks_are_converged(spark):
    """Brute-force PageRank in numpy, iterated far beyond the operator's stop."""
    t = Tables(spark, "/root/testdata/sf0.001")
    ids = sorted(r.id for r in t["v_functions"].select("id").collect())
    at, n = {x: k for k, x in enumerate(ids)}, len(ids)
    calls = [(at[r.src_id], at[r.dst_id]) for r in t["v_calls"].filter("src_id <> dst_id").collect()]

    def ranks(pairs):
        weight = np.zeros((n, n))
        for a, b in pairs:
            weight[a, b] += 1
        total = weight.sum(axis=1)
        rank = np.full(n, 1 / n)
        for _ in range(300):
            rank = 0.15 / n + 0.85 * ((rank / np.maximum(total, 1)) @ weight + rank[total == 0].sum() / n)
        return rank

    authority, hub = ranks(calls), ranks([(b, a) for a, b in calls])
    blend = np.sqrt(authority * hub)
    for name, wanted, within in (("pagerank_authority", authority, 1e-5), ("pagerank_hub", hub, 1e-5), ("symbol_rank", blend / blend.max(), 1e-3)):
        got = {r.node: r["rank"] for r in catalog.QUERIES[name](spark, t.folder).collect()}
        assert got.keys() == at.keys() and sum(abs(got[x] - wanted[k]) for x, k in at.items()) < within


def test_two_cliques_are_two_communities():
    rows = [(a, b, 3.0) for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"))] + [("c", "x", 0.2)]
    found = G.louvain(pd.DataFrame(rows, columns=["a", "b", "w"]))
    assert [found[k] for k in "abcxyz"] == [0, 0, 0, 1, 1, 1]


def test_path_follows_edges_and_may_be_missing(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 5), (5, 3)], "src long, dst long")
    assert [r.node for r in G.shortest_path(edges, 1, 3, 5).collect()] == [1, 2, 3]
    assert G.shortest_path(edges, 3, 1, 5).count() == 0


def test_walk_goes_to_the_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(14)] + [(14, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert sorted((r.node, r.depth) for r in G.walk(edges, seeds).collect()) == [(k, k) for k in range(15)]


def test_registered_walks_equal_brute_force(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    forth, back = {}, {}
    for r in t["v_calls"].filter("src_id <> dst_id").select("src_id", "dst_id").distinct().collect():
        forth.setdefault(r.src_id, []).append(r.dst_id)
        back.setdefault(r.dst_id, []).append(r.src_id)

    def reach(edges, seeds):
        depth, queue = dict.fromkeys(seeds, 0), list(seeds)
        for node in queue:
            for x in edges.get(node, []):
                if x not in depth:
                    depth[x] = depth[node] + 1
                    queue.append(x)
        return depth

    run = lambda name: catalog.QUERIES[name](spark, t.folder).collect()
    ahead = reach(forth, [0])
    assert max(ahead.values()) > 6
    assert {r.node: r.depth for r in run("bfs_distances")} == ahead
    goal = max(k for k in back if k < 150)
    assert [r.hops for r in run("call_chain")] == [ahead[goal] if ahead.get(goal, 99) <= 12 else None]


def test_tests_and_reachability_follow_the_rules(spark):
    """A small program: a walk ends at a test, method calls do not reach free functions, dispatch and routes keep code alive."""
    names = [("deep", "deep", True), ("direct", "direct", True), ("one", "one", False), ("two", "two", False), ("target", "target", False), ("run", "Svc::run", False), ("fmt", "Svc::fmt", False), ("handler", "handler", False), ("helper", "helper", False), ("main", "main", False), ("lonely", "lonely", False), ("named", "named", False)]
    functions = spark.createDataFrame([(k, n, q, "a.rs", "", "rust", 10 * k + 5, 10 * k + 8, t) for k, (n, q, t) in enumerate(names)], "id long, name string, qualified_name string, path string, module string, language string, line_start long, line_end long, is_test boolean")
    classes = spark.createDataFrame([(0, "Svc", "Svc", "a.rs", "", "rust", 50, 59, "[]", "struct Svc")], "id long, name string, qualified_name string, path string, module string, language string, line_start long, line_end long, bases string, body string")
    rows = [("deep", "one", False), ("one", "two", False), ("two", "target", False), ("direct", "target", False), ("Svc::run", "target", True), ("helper", "direct", False), ("handler", "run", True), ("main", "one", False)]
    calls = spark.createDataFrame([(a, b, None, m, "a.rs", k) for k, (a, b, m) in enumerate(rows)], "caller string, callee string, guess string, is_method boolean, path string, line int")
    graded = G.grade_calls(calls, functions)
    seeds = spark.createDataFrame([("target",)], "node string")
    assert {(r.qualified_name, r.depth) for r in S1.tests_reaching(graded, functions, seeds).collect()} == {("direct", 1), ("deep", 3)}
    assert S1.tests_reaching(graded, functions, spark.createDataFrame([("lonely",)], "node string")).count() == 0
    assert {(r.qualified_name, r.depth) for r in S1.tests_covering_file(graded, functions, "a.rs").collect()} == {("deep", 0), ("direct", 0)}
    routes = spark.createDataFrame([("handler",)], "handler_method string")
    bodies = spark.createDataFrame([("main", "one(); let f = named;"), ("named", "named")], "name string, body string")
    assert {r.name for r in S1.dead_code(functions, classes, calls, routes, bodies).collect()} == {"helper", "lonely"}
    edges = G.call_edges(graded)
    assert {r.name for r in S1.unreachable(functions, classes, edges, routes).collect()} == {"helper", "lonely", "named"}
    hops = S1.chain_hops(edges, "deep", "target", 12).collect()
    assert [(r.step, r.name) for r in sorted(hops, key=lambda r: r.step)] == [(0, "deep"), (1, "one"), (2, "two"), (3, "target")]
    assert S1.chain_hops(edges, "deep", "target", 2).count() == 0 and S1.chain_hops(edges, "handler", "target", 12, 0.5).count() == 0
    assert {r.caller for r in S1.callers(graded, functions, "target").collect()} == {"two", "direct"}


def test_ranks_equal_power_iteration(spark):
    rnd = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rnd.integers(0, 12, (40, 2))]
    nodes = spark.createDataFrame([(k,) for k in range(13)], "node long")
    got = {r.node: r.rank for r in G.pagerank(spark.createDataFrame(pairs, "src long, dst long"), nodes).collect()}
    flow = np.zeros((13, 13))
    for a, b in pairs:
        if a != b:
            flow[b, a] += 1
    out = flow.sum(axis=0)
    flow = np.where(out > 0, flow / np.maximum(out, 1), 1 / 13)
    rank = np.full(13, 1 / 13)
    for _ in range(200):
        rank = 0.15 / 13 + 0.85 * flow @ rank
    assert max(abs(got[k] - rank[k]) for k in range(13)) < 1e-5 and abs(sum(got.values()) - 1) < 1e-9


def test_components_join_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in G.components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_grades(spark):
    functions = spark.createDataFrame([("run", "A::run"), ("run", "B::run"), ("free", "free"), ("paint", "W::paint"), ("paint", "W::paint")], "name string, qualified_name string")
    calls = spark.createDataFrame([("run", "A::run", True), ("paint", "W::paint", True), ("free", None, False), ("run", None, True), ("gone", None, False), ("run", "C::run", False)], "callee string, guess string, is_method boolean")
    got = {(r.callee, r.guess): (r.confidence, r.resolved_callee) for r in G.grade_calls(calls, functions).collect()}
    assert got == {("run", "A::run"): (0.9, "A::run"), ("paint", "W::paint"): (0.7, "W::paint"), ("free", None): (0.6, None), ("run", None): (0.4, None), ("gone", None): (0.3, None), ("run", "C::run"): (0.4, None)}


def test_basis_vector_distances(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.70710678, 0.70710678]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.distance for r in R.knn(vectors, [1.0, 0.0], 10).collect()}
    assert got == {0: 0.0, 2: 0.292893, 1: 1.0, 3: 1.0}


def test_fusion_ignores_list_order(spark):
    a, b = (spark.createDataFrame(x, "k string, rank long") for x in ([("p", 0), ("q", 1)], [("q", 0), ("r", 1)]))
    one, two = R.rrf([a, b], "k", 5).collect(), R.rrf([b, a], "k", 5).collect()
    assert one == two and one[0].k == "q" and abs(one[0].score - (1 / 60 + 1 / 61)) < 1e-8


def test_identifiers_and_secrets(spark):
    row = spark.range(1).select(
        T.split_identifier(F.lit("HTTPServerFooBar_parse-v2")).alias("parts"),
        T.redact_secrets(F.lit('password = "hunter2x!" api_key = cfg.api_key ghp_' + "a" * 36 + " https://u:secretpw@h/")).alias("clean"),
        T.search_text(F.lit("parseBody parse")).alias("search"),
    ).first()
    assert row.parts == ["HTTP", "Server", "Foo", "Bar", "parse", "v2"]
    assert "hunter2x" not in row.clean and "cfg.api_key" in row.clean and "ghp_" not in row.clean and "https://u:[REDACTED:url-password]@h/" in row.clean
    assert row.search == "parseBody parse Body"


def test_similar_pairs_equal_brute_force(spark):
    texts = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta", "one two three", "epsilon delta gamma beta alpha", ""]
    rows = spark.createDataFrame([(k, "p", x) for k, x in enumerate(texts)], "doc_id long, project string, content string")
    assert [(r.a, r.b, r.jaccard) for r in M.similar_pairs(rows).collect()] == [(0, 1, 0.833333)]


def test_curation_archives_copies(spark):
    """Losers by comparing all records with all, against the query's operator; equal sets of tokens are copies."""
    texts = ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta", "one two three", "epsilon delta gamma beta alpha", "", "three two one one", "beta alpha gamma delta epsilon eta", "lone words here", "zeta alpha beta gamma delta epsilon", "one two three", "eta alpha beta gamma delta epsilon"]
    rows = [(k, p, x) for p in ("p", "q") for k, x in enumerate(texts if p == "p" else texts[::-1])]
    rows = [(k + 100 * (p == "q"), p, x) for k, p, x in rows]
    df = spark.createDataFrame(rows, "doc_id long, project string, content string")
    expected = set()
    for project in ("p", "q"):
        own, gone = [(k, set(x.split())) for k, p, x in rows if p == project and x], set()
        for b, right in reversed(own):
            for a, left in reversed(own):
                if a < b and a not in gone and b not in gone and len(left & right) >= 0.8 * len(left | right):
                    gone.add(a)
                    expected.add((project, a, b))
    assert {(r.project, r.loser, r.keeper) for r in M.curate_copies(df).collect()} == expected and len(expected) > 8
    assert {(r.doc_id, r.representative) for r in M.class_members(df).filter("project = 'p'").collect()} == {(0, 0), (1, 1), (2, 2), (3, 0), (5, 2), (6, 6), (7, 7), (8, 1), (9, 2), (10, 6)}


def test_parse_python_and_chunks(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\nclass A(B):\n    def run(self):\n        os.getcwd()\n        helper()\n")
    (tmp_path / "node_modules" / "b.py").write_text("x = 1\n")
    files = C.scan(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["pkg/a.py"]
    rows = {(r.kind, r.qualified_name, r.receiver, r.caller) for r in C.parse(files).collect()}
    assert rows == {("import", "os", None, None), ("class", "A", "B", None), ("function", "A.run", None, None), ("call", "getcwd", "os", "A.run"), ("call", "helper", None, "A.run")}
    body = "".join(f"line {k}\n" for k in range(9000))
    parts = C.split_body(body)
    assert len(parts) > 1 and all(len(p.encode()) <= C.CHUNK_BYTES for p in parts) and parts[1][200:] in body


def test_merge_and_classify(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert {r.path: r.action for r in C.classify(disk, known).collect()} == {"a": "unchanged", "b": "reindex", "c": "new", "d": "delete"}


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    source = tmp_path / "in"
    for k, rows in enumerate(([("a", 1), ("b", 1)], [("a", 3), ("c", 1)], [("a", 2)])):
        spark.createDataFrame(rows, "path string, at long").coalesce(1).write.mode("append").parquet(str(source))
        assert k >= 0
    stream = spark.readStream.schema("path string, at long").option("maxFilesPerTrigger", 1).parquet(str(source))
    read = S.maintain(stream, spark, str(tmp_path / "out"), "path", ["at"])
    assert {(r.path, r.at) for r in read().collect()} == {("a", 3), ("b", 1), ("c", 1)}
    again = S.upsert(read(), read(), "path", ["at"])
    assert again.count() == 3


def test_ledger_ties_are_stale(spark):
    files = spark.createDataFrame([("a", "p", 5), ("b", "p", 4), ("c", "p", 9)], "path string, project string, changed_at long")
    targeted = spark.createDataFrame([("c", 12)], "path string, ran_at long")
    wide = spark.createDataFrame([("p", 5)], "project string, ran_at long")
    assert [r.path for r in M.stale_files(files, targeted, wide).collect()] == ["a"]


NOTE = "id string, project string, content string, category string, status string, importance double, access_count long, created_at timestamp, last_accessed_at timestamp, tags string"


def note(k, content, importance=1.0, access=0, day=1, project="p", category="bug", tags="[]", status="active"):
    at = datetime.datetime(2024, 1, day)
    return (f"mem_{k}__{project}", project, content, category, status, importance, access, at, at, tags)


def test_curation_equals_comparing_all_with_all(spark):
    rnd = random.Random(4)
    texts = ["word%d word%d " % (k, k + 1) + " ".join("core%d" % x for x in range(rnd.choice([7, 8, 9]))) for k in (0, 1, 1, 0, 5, 5) for _ in range(4)] + ["alone here now", ""]
    rows = [note(k, x, rnd.choice([1.0, 3.0, 4.0, 5.0]), rnd.randrange(3), rnd.randrange(1, 25), tags=rnd.choice(["[]", '["L0"]'])) for k, x in enumerate(texts)]
    rows += [note(100 + k, x, day=k + 1, project="q") for k, x in enumerate(texts[:6])]
    now, want = "2024-05-20 00:00:00", {}
    for project in ("p", "q"):
        own = [r for r in rows if r[1] == project and not (r[5] >= 5 or r[5] >= 4 and "L0" in r[9])]
        own.sort(key=lambda r: (-r[7].timestamp(), r[0]))
        bags, gone = [{x for x in r[2].split() if len(x) >= 3} for r in own], set()
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                both = bags[i] | bags[j]
                if i in gone or j in gone or not bags[i] or not bags[j] or len(bags[i] & bags[j]) < 0.8 * len(both):
                    continue
                first = (int(own[i][5] * 100), own[i][6], own[i][7]) >= (int(own[j][5] * 100), own[j][6], own[j][7])
                loser, keeper = (j, i) if first else (i, j)
                gone.add(loser)
                want[own[loser][0]] = ("duplicate", own[keeper][0])
        for i, r in enumerate(own):
            if i not in gone and r[5] <= 2 and (datetime.datetime(2024, 5, 20) - r[8]).days >= 90:
                want[r[0]] = ("stale", None)
    got = {r.id: (r.reason, r.kept) for r in N.curate(spark.createDataFrame(rows, NOTE), now).collect()}
    assert got == want and sum(v[0] == "duplicate" for v in want.values()) > 8 and any(v[0] == "stale" for v in want.values())


def test_batches_are_added_in_order(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(6, 8))
    vectors = [(f"{k:03d}", (base[k % 6] + rnd.normal(size=8) * 0.15).tolist(), k >= 10) for k in range(40)]
    kept, want = [], []
    for key, v, new in vectors:
        v = np.array(v) / np.linalg.norm(v)
        near = min(((1 - v @ w, i) for i, (_, w) in enumerate(kept)), default=(9.0, -1))
        if new:
            want.append((key, "duplicate" if near[0] < 0.05 else "added", kept[near[1]][0] if near[0] < 0.05 else None))
        if not new or near[0] >= 0.05:
            kept.append((key, v))
    df = spark.createDataFrame([("p", *x) for x in vectors], "project string, id string, embedding array<double>, new boolean")
    got = sorted((r.id, r.outcome, r.of) for r in N.add(df.filter("not new"), df.filter("new"), 0.05).collect())
    assert got == want and {o for _, o, _ in want} == {"added", "duplicate"}


def test_sessions_names_and_guards(spark):
    rows = [note(1, "the login page crashes on start", 3.0), note(2, "write the manual", 3.0, category="todo"), note(3, "login was fixed", category="progress"), note(4, "other login bug", project="q"), note(5, "draft", 0.5, category="general", tags='["sid:x"]'), note(6, "pay page crashes", 3.0)]
    notes = spark.createDataFrame(rows, NOTE)
    closed = N.session_end(notes, "p", [["login", "crashes"], ["manual"], ["nothing"]], "2024-01-03 00:00:00").collect()
    assert [(r["item"], r["id"]) for r in closed] == [(0, "mem_1__p"), (1, "mem_2__p")]
    assert {r.id for r in N.stale_drafts(notes, "2024-03-01 00:00:00").collect()} == {"mem_5__p"}
    assert {r.id for r in N.renamed(notes, "p", "new").filter("project = 'new'").collect()} == {f"mem_{k}__new" for k in (1, 2, 3, 5, 6)}
    for bad in (lambda: N.renamed(notes, "p", "q"), lambda: N.renamed(notes, "p", "p"), lambda: N.check_project("__x"), lambda: N.check_arguments(importance=6), lambda: N.check_arguments(tags=["x"] * 33), lambda: N.check_arguments(reason="x" * 501)):
        with pytest.raises(ValueError):
            bad()
    assert N.renamed(notes, "p", "q", merge=True).filter("project = 'q'").count() == 6


def test_lexical_index_equals_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([(0, "alpha beta beta"), (1, "beta gamma"), (2, None), (3, ""), (4, "alpha alpha alpha delta")], "id long, text string")
    scan = {r.id: r.score for r in R.bm25(docs, "id", "text", ["alpha", "gamma", "none"]).collect()}
    index = R.LexicalIndex.write(docs, "id", "text", str(tmp_path / "index"))
    assert {r.id: r.score for r in index.search(["alpha", "gamma", "none"], "id").collect()} == scan and set(scan) == {0, 1, 4}
    assert R.bm25(docs, "id", "text", []).count() == 0


def test_names_come_before_texts(spark):
    rows = [(0, "embed_pending", "embed_pending fn", 0.0), (1, "EmbedPendingCapped", "EmbedPendingCapped embed pending", 0.1), (2, "other", "embed embed embed pending pending", 1.0), (3, "none", "nothing", 1.0)]
    found = [r.id for r in R.search_code(spark.createDataFrame(rows, "id long, name string, text string, rank double"), "embed_pending").collect()]
    assert found[0] == 0 and set(found) == {0, 1, 2}


def test_signatures_estimate_both_views(spark):
    one = "fn add(a: u8, b: u8) -> u8 { let total = a + b; if total > 9 { return total; } total * 2 }"
    two = one.replace("total", "sum").replace("add", "plus")
    other = "class Page { render() { for (const x of this.items) { draw(x); } } }"
    rows = [(k, x) for k, x in enumerate((one, two, other, "", "x"))]
    got = {r.id: r.score for r in R.similar_code(R.code_signatures(spark.createDataFrame(rows, "id long, body string"), "id", "body"), "id", 0, 9).collect()}
    assert got[1] > 0.5 and got.get(2, 0) < 0.3 and 3 not in got
    assert R.code_signature("") == [0xFFFFFFFF] * 128


def test_semantic_search_keeps_the_best_of_a_name(spark):
    rows = [(0, "a", "red green"), (1, "a", "red"), (2, "b", "green blue"), (3, "c", "")]
    chunks = spark.createDataFrame(rows, "id long, qualified_name string, text string")
    got = [(r.qualified_name, r.id) for r in R.semantic_search(chunks, R.embedded(chunks, "id", "text", 997), R.bag_vector("Red", 997), 2).collect()]
    assert got[0] == ("a", 1) and len(got) == 2
    assert R.bag_vector("", 4) == [1.0, 0.0, 0.0, 0.0]


def test_existence_gives_every_answer(spark):
    symbols = spark.createDataFrame([("calendar_sync", "calendar_sync", "a.py"), ("get_file", "get_file", "b.py"), ("export", "export", "c.py"), ("only_test", "only_test", "tests/x.py")], "name string, qualified_name string, path string")
    routes = spark.createDataFrame([("/metrics/page", "export", None), ("/gone", "missing", None)], "route string, handler_method string, handler_class string")
    bodies = spark.createDataFrame([("a.py", "x = 'permission'")], "path string, body string")
    ask = lambda q: tuple(R.check_exists(symbols, routes, bodies, q).first())[:3]
    assert ask("calendar_sync") == ("exists", 0.92, "exact") and ask("export") == ("exists", 0.85, "exact")
    assert ask("metrics page in the dashboard") == ("exists", 0.8, "route") and ask("calendar sync with phones") == ("exists", 0.82, "name")
    assert ask("calendar") == ("exists", 0.65, "name") and ask("export the universe") == ("weak", 0.5, "exact")
    assert ask("metrics universe") == ("weak", 0.45, "route") and ask("calendar universe") == ("weak", 0.45, "name")
    assert ask("permission universe") == ("weak", 0.3, "body") and ask("only_test")[0] == "absent" and ask("of it") == ("absent", 0.0, None)
    assert ask("get something file")[0] == "exists"  # all words of the name
    assert ask("get universe file now")[:1] == ("exists",)


def test_scopes_and_windows(spark):
    paths = spark.createDataFrame([(x,) for x in ("src/a.py", "src/x/b.rs", "src/x/c.ts", "lib/d.py", "src/x/y/e.py")], "path string")
    scope = lambda *a: {r.path for r in paths.filter(P1.in_scope(F.col("path"), *a)).collect()}
    assert scope(["src/x"]) == {"src/x/b.rs", "src/x/c.ts", "src/x/y/e.py"} and scope([], ["*.py", "!lib/**"]) == {"src/a.py", "src/x/y/e.py"}
    assert scope([], ["src/**/*.{py,rs}"], ["py"]) == {"src/a.py", "src/x/y/e.py"} and len(scope()) == 5
    texts = spark.createDataFrame([(1, "a\nbb\nccc\ndddd")], "k long, text string")
    assert [(r.line, r.text, r.truncated) for r in S1.read_window(texts, "k", 2, 3).collect()] == [(2, "bb", False), (3, "ccc", False)]
    assert [(r.line, r.truncated) for r in S1.read_window(texts, "k", 1, 4, most_bytes=6).collect()] == [(1, True), (2, True)]


def test_index_follows_files(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, x long")
    fresh = spark.createDataFrame([("b", 9)], "path string, x long")
    paths = spark.createDataFrame([("b",), ("c",)], "path string")
    assert sorted(map(tuple, I.replaced(table, fresh, paths).collect())) == [("a", 1), ("b", 9)]
    assert [tuple(r) for r in I.deleted({"t": table}, paths)["t"].collect()] == [("a", 1)]
    errors = spark.createDataFrame([("a", "f1", "e"), ("b", "f1", "e")], "path string, fingerprint string, error string")
    found = spark.createDataFrame([("a", "f2", "new"), ("b", "f1", "again"), ("c", "f3", "x"), ("c", "f3", "x")], "path string, fingerprint string, error string")
    assert sorted(map(tuple, I.with_errors(errors, found).collect())) == [("a", "f2", "new"), ("b", "f1", "e"), ("c", "f3", "x")]
    assert [r.path for r in I.pruned_errors(errors, spark.createDataFrame([("b",)], "path string")).collect()] == ["b"]
    cache = spark.createDataFrame([("h1", "m", 1)], "content_hash string, model string, embedding long")
    local = spark.createDataFrame([("h1", "m", 2), ("h2", "m", 3), ("h2", "m", 3)], "content_hash string, model string, embedding long")
    assert sorted(map(tuple, I.merged_cache(cache, local).collect())) == [("h1", "m", 1), ("h2", "m", 3)]
    assert I.should_compact(100, 20) and I.should_compact(10**6, 500) and not I.should_compact(100, 19)


def test_words_and_stems(spark):
    row = spark.range(1).select(
        T.matched_tokens(F.lit("индексатора быстро handlers"), F.array(F.lit("индексатор"), F.lit("handler"), F.lit("slow"))).alias("n"),
        T.preview(F.lit("\n  first line \nsecond")).alias("p"), T.truncate(F.lit("abcdef"), 3).alias("t"), T.one_line(F.lit(" a\n b\t c ")).alias("o"),
        T.verdict_pieces(F.lit("calendarSync::HTTPServer_v2 x")).alias("v"),
    ).first()
    assert (row.n, row.p, row.t, row.o) == (2, "first line", "abc…", "a b c") and sorted(row.v) == ["calendar", "httpserver", "sync", "v2"]


def test_recall_keeps_whole_records_within_a_budget(spark):
    rows = [note(1, "the indexer daemon restarts " + "x" * 100, 3.0), note(2, "daemon indexer restarts", 3.0), note(3, "daemon only", 3.0), note(4, "indexers and daemons restart", 0.0, category="general"), note(5, "indexer daemon restart draft", 3.0, tags='["sid:a"]'), note(6, "indexer daemon restarting twice", 3.0)]
    notes = spark.createDataFrame(rows, NOTE)
    ask = lambda **more: {r.id for r in N.recall(notes, "p", "why does the indexer daemon restart", "2024-01-03 00:00:00", floor=0.0, **more).collect()}
    assert ask() == {"mem_1__p", "mem_2__p", "mem_6__p"} and ask(budget=60) == {"mem_2__p", "mem_6__p"}
    assert len(ask(limit=1)) == 1 and ask(excluded=("mem_2__p",), budget=60) == {"mem_6__p"}
    assert N.recall(notes, "p", "daemon", "2024-01-03 00:00:00").count() == 0
    assert N.recall(notes, "p", "why does the indexer daemon restart", "2024-01-03 00:00:00").count() == 0  # so few records give no score of 5
