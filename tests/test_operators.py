"""Operators on small knowledge bases: values, and that a broken rule shows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import aggregate, chunks, graph, metrics, quality, recall, search, tagging
from quillspark.sources import notes as src

NOTE = "path string, title string, body string, flow string, stage string, substage string, domains array<string>, forms array<string>, tools array<string>, types array<string>, projects array<string>, topics array<string>, q_hooks array<string>, sources array<string>, updated string, stale boolean, confidence string"


def note(path, title="t", body="b", flow="视频", stage="1_选题", substage="案例", domains=(), types=(), topics=(), hooks=(), sources=("a.md",), updated="2024-01-01", stale=False, confidence="high"):
    return (path, title, body, flow, stage, substage, list(domains), [], [], list(types), [], list(topics), list(hooks), list(sources), updated, stale, confidence)


@pytest.fixture(scope="module")
def kb(spark):
    rows = [
        note("a.md", "剪辑教程", "如何剪辑视频 cutting videos", domains=["AI"], types=["教程"], topics=["剪辑", "视频"], hooks=["how do I cut a video quickly", "怎么剪辑视频"], updated="2024-03-01"),
        note("b.md", "选题", "选题方法 topics for videos", domains=["AI"], types=["案例"], topics=["选题", "视频"], updated="2024-02-01"),
        note("c.md", "发布", "发布流程 publishing", stage="2_发布", types=["复盘"], topics=["发布"], stale=True),
        note("d.md", "Vidéos", "les vidéos", flow="写作", domains=["商业"], types=["SOP"], topics=["写作"]),
    ]
    return src.indexable(spark.createDataFrame(rows, NOTE)).cache()


def paths(df):
    return [r.path for r in df.collect()]


def test_bm25_formula_and_floor(spark):
    rows = spark.createDataFrame([("1", "", "cat dog bird"), ("2", "", "cat cat fish fish"), ("3", "", "stone"), ("4", "", "tree leaf"), ("5", "", "")], "path string, title string, body string")
    asked = spark.createDataFrame([(0, "cats and dogs")], "query_id int, text string")
    got = {r.path: r for r in search.bm25(rows, asked).collect()}
    lengths = [3, 4, 1, 2, 0]
    mean = sum(lengths) / 5
    idf = lambda n: max(math.log((5 - n + 0.5) / (n + 0.5)), 1e-6)
    part = lambda n, f, d: idf(n) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))
    assert set(got) == {"1", "2"}
    assert got["1"].bm25 == pytest.approx(-(part(2, 1, 3) + part(1, 1, 3))) and got["2"].bm25 == pytest.approx(-part(2, 2, 4))
    split = {r.path: r.kept for r in search.split_by_floor(search.bm25(rows, asked)).collect()}
    assert split == {"1": True, "2": False}


def test_search_filters_and_ranks(kb):
    assert paths(search.search(kb, "videos")) == ["a.md", "b.md"] or paths(search.search(kb, "videos")) == ["b.md", "a.md"]
    assert paths(search.search(kb, filters={"domains": ["AI", "商业"]}, rank=["时间"])) == ["a.md", "b.md", "d.md"]
    assert paths(search.search(kb, filters={"domains": ["AI"], "types": ["案例"]})) == ["b.md"]
    assert paths(search.search(kb, exclude=["视频"])) == ["d.md"]
    assert paths(search.search(kb, primary={"stage": "选题", "flow": "视频"}, rank=["类型优先级"])) == ["a.md", "b.md"]
    assert "c.md" not in paths(search.search(kb)) and "c.md" in paths(search.search(kb, include_stale=True))
    assert search.stale_count(kb, {}).first().hidden == 1
    with pytest.raises(search.QueryError):
        search.search(kb, filters={"nope": ["x"]})
    first = search.search(kb, "how do I cut a video").first()
    assert first.path == "a.md" and first.hooked
    assert paths(search.pull(kb, {"filters": {"types": ["教程"]}, "limit": 5})) == ["a.md"]


def test_hook_thresholds(spark):
    hooks = spark.createDataFrame([("a", "how do I get started with the long video editing course today")], "path string, hook string")
    asked = spark.createDataFrame([(0, "what is the price"), (1, "how do I get started")], "query_id int, text string")
    assert {r.query_id for r in search.hook_matches(hooks, asked).collect()} == {1}


def test_held_pairs_against_brute_force(spark):
    rng = random.Random(3)

    def texts(longest):
        return sorted({"".join(rng.choice("ab😀") for _ in range(rng.randint(0, longest))) for _ in range(60)} | {"漢\n字"})

    inner, outer = texts(12), texts(40)
    found = search.held_pairs(spark.createDataFrame([(x,) for x in inner], "x string"), spark.createDataFrame([(y,) for y in outer], "y string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((x, y) for x in inner for y in outer if x and x in y)


def test_recall_channels_and_route(spark, kb):
    units = spark.createDataFrame([("u1", "relation", "剪辑", "写作", "d.md"), ("u2", "relation", "别的", "东西", "c.md")], "id string, type string, subject string, object string, doc_id string")
    route = recall.read_route({"keywords": ["怎么剪辑视频"], "need_relations": True, "top_k": 10}, kb)
    out = {r.path: r for r in recall.recall(kb, "", route, units).collect()}
    assert set(out) == {"a.md", "b.md", "d.md"}
    assert out["a.md"].weight == 4 and "hook" in out["a.md"].channels and out["d.md"].channels == ["relation"]
    soft = recall.read_route({"topics": ["没有", "剪辑"], "flow": "视频", "stage": "写作", "x": 1}, kb)
    assert {c for c, _ in soft.warnings} == {"unknown_topic", "unknown_field", "unknown_stage"} and soft.topics == ["剪辑"]
    mismatch = recall.read_route({"keywords": ["a"], "flow": "写作", "stage": "发布"}, kb)
    assert ("stage_flow_mismatch", "发布") in mismatch.warnings and mismatch.flow == "写作" and mismatch.stage == ""
    for bad in ([], "x", {"keywords": ["a", 1]}, {"top_k": 101}, {"top_k": True}):
        with pytest.raises(recall.RouteError):
            recall.read_route(bad, kb)
    with pytest.raises(recall.RouteError):
        recall.recall(kb, "")
    unnumbered = recall.recall(kb, "", recall.Route(topics=["视频"], stage="选题"))
    assert set(paths(unnumbered)) == {"a.md", "b.md"}


@pytest.mark.parametrize("order", ["descending", "random"])
def test_components_of_long_chains(spark, order):
    """Chains whose least id must cross many basins, and a loop beside them."""
    ids = [1, *range(120, 1, -1)] if order == "descending" else random.Random(20).sample(range(1, 1001), 1000)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (5000, 5000), (6001, 6000), (None, 1)], "src int, dst int")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == dict.fromkeys(ids, 1) | {5000: 5000, 6000: 6000, 6001: 6000}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 2)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "node int")
    assert {r.node: r.component for r in graph.components_of(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src int, dst int")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    assert {(r.degree, r.nodes) for r in graph.degree_histogram(edges, nodes).collect()} == {(0, 3), (1, 4), (2, 1)}
    assert {(r.node, r.hop) for r in graph.reach(edges, spark.createDataFrame([(1,)], "node int"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    relations = spark.createDataFrame([("视频", "视频剪辑", "d1"), ("剪辑", "发布", "d2"), ("写作", "x", "d3")], "subject string, object string, doc_id string")
    seeds = spark.createDataFrame([("视频",)], "concept string")
    assert {(r.doc_id, r.hop) for r in graph.traverse(relations, seeds, 2).collect()} == {("d1", 1), ("d2", 2)}
    notes = spark.createDataFrame([("x/a.md", "A", ["b#h", "A", "无"], ["视频"]), ("x/b.md", "B", [], ["视频剪辑"])], "path string, title string, links array<string>, topics array<string>")
    assert {(r.src, r.dst) for r in graph.explicit_edges(notes).collect()} == {("x/a.md", "x/b.md"), ("x/a.md", "x/a.md")}
    assert {(r.src, r.dst) for r in graph.concept_edges(relations, notes).collect()} == {("x/a.md", "x/b.md")}


def test_chunks(spark):
    text = "前言\n# 一\nabc\n00:01:23 说话\n## 二 \n" + "x" * 60
    got = chunks.map_documents(spark.createDataFrame([("p/x.md", text), ("q.md", "无锚点")], "path string, text string")).orderBy("path", "idx").collect()
    own = [r for r in got if r.path == "p/x.md"]
    assert [r.heading for r in own] == ["一", "00:01:23", "二"] and all(text[r.char_start : r.char_end] == r.segment for r in own)
    assert own[0].char_start == text.index("# 一") and own[-1].char_end == len(text)
    assert [(r.heading, r.char_start, r.char_end) for r in got if r.path == "q.md"] == [("", 0, 3)]


def test_segments(spark):
    table = "| 图 | 链接 |\n| a.png | https://x/y |\n| b.png | https://x/z |"
    fence = "```\nline\n\nline\n```"
    outer = "````\n```\ninner\n```\n\n" + "z" * 1600 + "\n````"
    wall = "w" * 1800
    text = "\n\n".join(["开头段落", table, "| 名 | 值 |\n| a | b |", fence, "引子：", wall, "末尾", outer])
    rows = chunks.segments(spark.createDataFrame([("c1", text)], "chunk_id string, segment string")).collect()
    cut = {text[r.start : r.start + r.len]: r for r in rows}
    dropped = [s for s, r in cut.items() if r.dropped]
    assert len(dropped) == 1 and dropped[0].startswith("| 图")
    assert any("| 名 |" in s for s, r in cut.items() if not r.dropped)
    assert all(("line\n\nline" in s) or ("line" not in s) for s in cut)
    glued = next(r for s, r in cut.items() if wall in s)
    assert glued.frag and glued.oversized_frag and "引子" in text[glued.start : glued.start + glued.len]
    whole = next(r for s, r in cut.items() if "inner" in s)
    assert whole.oversized_fence and outer in text[whole.start : whole.start + whole.len + 1]


def test_locate(spark):
    docs = spark.createDataFrame([("d", "aXbaXb. 引 用，文 aaaa")], "path string, text string")
    quotes = spark.createDataFrame([("d", q) for q in ("aXb", "引 用", "引用文", "aa", "没有", "(")], "path string, quote string")
    got = {r.quote: (r.verdict, r.n_places, r.start, r.end) for r in chunks.locate(quotes, docs).collect()}
    text = docs.first().text
    assert got["aXb"] == ("ambiguous", 2, 0, 3) and got["引 用"][:2] == ("unique", 1) and got["aa"][:2] == ("ambiguous", 3)
    verdict, _, start, end = got["引用文"]
    assert verdict == "normalized" and text[start:end] == "引 用，文"
    assert got["没有"][0] == "missing" and got["("][0] == "missing"
    lines = spark.createDataFrame([(1, "剪辑视频的步骤"), (2, "unrelated")], "line_id int, line string")
    evidence = spark.createDataFrame([("e1", "剪辑视频"), ("e2", "发布步骤")], "evidence_id string, quote string")
    assert {r.line_id: r.evidence_id for r in chunks.best_evidence(lines, evidence).collect()} == {1: "e1"}


def test_tagger(spark):
    words = tagging.Vocabulary(
        canon={"domains": ["herbs"], "tools": ["Rake"], "types": ["guide"], "forms": ["film"], "projects": ["Maze"], "sources": ["scan", "web"]},
        synonyms={"herbs": ["kräuter"], "scan": ["pdf"]},
        implies={"Maze": {"domains": ["herbs"], "forms": ["film"]}},
        tools_of=("herbs", ["Rake"]),
        source_priority=["scan", "web"],
    )
    rows = spark.createDataFrame([("web/rake guide.pdf",), ("misc/notes.md",), ("x/maze.md",), ("kräuter.md",)], "path string")
    got = {r.path: r for r in tagging.tag_paths(rows, words).collect()}
    first = got["web/rake guide.pdf"]
    assert (first.domains, first.tools, first.types, first.source_kind, first.confidence, first.needs_review) == (["herbs"], ["Rake"], ["guide"], "scan", 0.85, False)
    assert got["misc/notes.md"].confidence == 0.0 and got["misc/notes.md"].needs_review
    assert got["x/maze.md"].domains == ["herbs"] and got["x/maze.md"].forms == ["film"]
    assert got["kräuter.md"].domains == ["herbs"] and got["kräuter.md"].confidence == 0.4
    assert tagging.tag_summary(tagging.tag_paths(rows, words)).first().n == 4 and words.table(spark).where("canon = 'scan'").count() == 2
    tiers = tagging.tag_tiers(spark.createDataFrame([(["a"],)] * 4 + [(["b"],)] * 3, "t array<string>"), "t", 5, ["a"]).collect()
    assert {(r.tag, r.tier) for r in tiers} == {("a", "candidate"), ("b", "primary")}
    files = spark.createDataFrame([("a/x·精华笔记.md", 900), ("a/x.md", 900), ("b/y·精华笔记.md", 900), ("总览.md", 300), (".h/a.md", 900), ("t.md", 10), ("长总览.md", 900)], "path string, size bigint")
    assert set(paths(tagging.body_documents(files))) == {"a/x.md", "b/y·精华笔记.md", "长总览.md"}


def test_metrics(spark):
    gold = spark.createDataFrame([("a", "d", ["x", "y"]), ("b", "d", ["x"]), ("a", "t", [])], "path string, dimension string, labels array<string>")
    said = spark.createDataFrame([("a", "d", ["x", "z"]), ("c", "d", ["q"])], "path string, dimension string, labels array<string>")
    got = {r.dimension: r for r in metrics.classification(gold, said).collect()}
    assert (got["d"].tp, got["d"].fp, got["d"].fn, got["d"].f1) == (1, 1, 2, 0.4) and got["micro"].recall == 0.3333 and got["t"].f1 == 0.0
    assert metrics.macro(metrics.classification(gold, said)).first() == (0.4, False)
    assert {(r.kind, r.label) for r in metrics.label_errors(gold, said).collect()} == {("extra", "z"), ("missing", "y"), ("missing", "x")}
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id int, path string, rank int")
    relevant = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "y", 1), (3, "q", 1)], "query_id int, path string, grade int")
    got = {r.query_id: r for r in metrics.retrieval(ranked, relevant.drop("grade"), 3).collect()}
    assert (got[1].precision, got[1].recall, got[1].mrr) == (0.6667, 1.0, 0.5) and got[3].returned == 0
    assert got[1].ndcg == round((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)), 4)
    graded = {r.query_id: r for r in metrics.retrieval(ranked, relevant, 3).collect()}[1]
    assert graded.ndcg == round((1 / math.log2(3) + 2 / 2) / (2 + 1 / math.log2(3)), 4)
    latency = spark.createDataFrame([(float(i),) for i in range(1, 21)], "latency_ms double")
    assert metrics.retrieval_summary(metrics.retrieval(ranked, relevant, 3), latency).first().p95_ms == 19.0
    single = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "path string, label string")
    other = spark.createDataFrame([("a", "x"), ("b", "x")], "path string, label string")
    assert {(r.gold, r.predicted, r.n) for r in metrics.confusion(single, other).collect()} == {("x", "x", 1), ("y", "x", 1), ("x", None, 1)}
    assert {r.label: (r.tp, r.fp, r.fn) for r in metrics.label_macro_f1(single, other).collect()} == {"x": (1, 1, 1), "y": (0, 0, 1)}


def test_aggregations(spark, kb):
    got = {r.topic: (r.doc_count, r.docs) for r in aggregate.topics(kb).collect()}
    assert got["视频"] == (2, ["a.md", "b.md"])
    stages = aggregate.flow_overview(kb).where("flow = '视频' and stage = '1_选题'").collect()
    assert {(r.substage, r.n) for r in stages} == {("总览", 0), ("子技巧", 0), ("案例", 2), ("工具", 0), ("坑", 0)} and stages[0].stage_order == 1
    assert aggregate.stale_ratio(kb).first() == (4, 1, 0.25) and aggregate.stale_ratio(kb.where("false")).first().ratio is None
    files = spark.createDataFrame([("x.pdf",), ("y.pdf",), ("y.md",), ("z.srt",), ("w.txt",), ("w·精华笔记.md",)], "path string")
    assert {(r.kind, r.path, r.partner) for r in aggregate.file_pairs(files).collect()} == {("orphan_pdf", "x.pdf", None), ("orphan_srt", "z.srt", None), ("minutes", "w.txt", "w·精华笔记.md")}
    before = aggregate.snapshot(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, text string"))
    after = aggregate.snapshot(spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "5"), ("n/d", "4")], "path string, text string"))
    assert {(r.path, r.change) for r in aggregate.diff(before, after).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "deleted"), ("e", "added"), ("n/d", "added")}
    assert {(r.path, r.change, r.moved_to) for r in aggregate.sync_table(before, after).where("path in ('c', 'd')").collect()} == {("c", "deleted", None), ("d", "moved", "n/d")}
    rows = spark.createDataFrame([("n1", ["b"]), ("n2", ["x/c"]), ("n3", ["a"])], "path string, sources array<string>")
    assert {r.path for r in aggregate.stale_notes(aggregate.diff(before, after), rows).collect()} == {"n1", "n2"}
    batches = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "path string, batch int, v string")
    assert {(r.path, r.v) for r in aggregate.upsert(batches, "path", "batch").collect()} == {("k", "new"), ("j", "x")}
    assets = spark.createDataFrame([("l1", "`a b`"), ("l2", "ab"), ("l3", "c")], "locator string, text string")
    assert [(r.n, r.first_locator) for r in aggregate.duplicate_assets(assets).collect()] == [(2, "l1")]


def test_hook_and_unit_rules(spark):
    rows = [("ok", ["怎么剪辑视频呢", "如何选题才好呢", "什么时候发布呢"]), ("few", ["怎么剪辑视频呢"]), ("none", []), ("null", None), ("bad", ["短", "a,b 逗号在内", '{"text": 1}', " ", "怎么剪辑视频呢", "怎么剪辑视频呢？", "x" * 41, "带\\n换行的问法"])]
    got = {(r.subject, r.code): r.n for r in quality.hook_rules(spark.createDataFrame(rows, "path string, q_hooks array<string>")).collect()}
    assert got == {
        ("few", "too_few"): 1, ("none", "empty"): 1, ("null", "empty"): 1, ("bad", "too_many"): 1, ("bad", "too_short"): 1, ("bad", "comma_in_item"): 1,
        ("bad", "not_string"): 1, ("bad", "empty_item"): 1, ("bad", "dup"): 1, ("bad", "too_long"): 1, ("bad", "newline"): 1,
    }
    notes = spark.createDataFrame([("x/a.md", None), ("x/b.md", ["短"]), ("c.md", []), ("d.md", ["怎么剪辑视频呢", "如何选题才好呢", "什么时候发布呢"])], "path string, q_hooks array<string>")
    fill = spark.createDataFrame([("x/a.md", ["h"]), ("other/b.md", ["g"])], "doc_id string, hooks array<string>")
    assert {r.path: r.verdict for r in quality.backfill(notes, fill).collect()} == {"x/a.md": "write", "x/b.md": "replace", "c.md": "no_candidate", "d.md": "ok"}
    evidence = [("f", "§h#char=0-3", "abc")]
    units = [("1", "claim", "high", "text", evidence, ""), ("2", "claim", "high", "text", [], "guess"), ("3", "zzz", "high", "x", [], ""), ("4", "claim", "sure", "x", [], ""), ("5", "claim", "low", "x", [], ""), ("6", "claim", "low", "", [], "")]
    schema = "id string, type string, confidence string, text string, evidence array<struct<file:string,locator:string,quote:string>>, inference string"
    found = {(r.subject, r.code) for r in quality.unit_rules(spark.createDataFrame(units, schema)).collect()}
    assert found == {("2", "high_without_evidence"), ("2", "high_with_inference"), ("3", "bad_type"), ("4", "bad_confidence"), ("5", "low_confidence"), ("6", "missing_field")}


def test_extraction_and_coverage(spark):
    source = spark.createDataFrame([("f", "一共 15 个步骤，运行 `ls -l` 即可")], "path string, text string")
    at = lambda a, b: f"§h#char={a}-{b}"
    rows = [
        ("good", "15 个", [("f", at(0, 10), "15 个步骤")]), ("moved", "x", [("f", at(0, 3), "步骤")]), ("number", "16 个", [("f", at(0, 10), "15 个步骤")]),
        ("code", "`ls -a`", [("f", at(0, 22), "即可一共"[:0] + "15 个步骤")]), ("none", "x", [("g", at(0, 3), "abcd")]), ("dup", "x", [("f", at(0, 10), "15 个步骤"), ("f", at(0, 10), "15 个步骤")]),
    ]
    units = spark.createDataFrame(rows, "id string, text string, evidence array<struct<file:string,locator:string,quote:string>>")
    found = {(r.subject, r.code) for r in quality.extraction(units, source).collect()}
    assert found == {("moved", "quote_not_in_place"), ("moved", "evidence_thin"), ("number", "missing_number"), ("code", "missing_code"), ("none", "unchecked"), ("dup", "evidence_dup")}
    steps = spark.createDataFrame([("p", "procedure", [(1,), (2,)]), ("q", "procedure", [(1,), (3,)])], "id string, type string, steps array<struct<order:int>>")
    assert [r.subject for r in quality.ordered_steps(steps).collect()] == ["q"]


@pytest.fixture(scope="module")
def progress_base(spark):
    rows = []
    for doc, high in (("A", 3), ("B", 4), ("C", 2), ("D", 0)):
        rows += [(doc, f"{doc}-{i}", i * 100, i * 100 + 100, i < high) for i in range(5)]
    return spark.createDataFrame(rows, "path string, chunk_id string, char_start int, char_end int, high_value boolean")


def test_progress(spark, progress_base):
    at = [("n1", "A", 10), ("n2", "A", 110), ("n3", "A", 210), ("n4", "B", 0), ("n5", "B", 199)]
    places = spark.createDataFrame(at, "note string, path string, start int")
    status, lost = quality.progress(progress_base, places)
    assert {r.path: r.status for r in status.collect()} == {"A": "done", "B": "partial", "C": "todo", "D": "no_hv"} and lost.count() == 0
    assert status.agg(F.sum("high"), F.sum("done")).first() == (9, 5) and quality.next_todo(progress_base, places).first().chunk_id == "B-2"
    broken = spark.createDataFrame([*at[:-1], ("n5", "B", 999999), ("n6", "Z", 0)], "note string, path string, start int")
    status, lost = quality.progress(progress_base, broken)
    assert {(r.note, r.code) for r in lost.collect()} == {("n5", "ghost_locator"), ("n6", "unmapped_source")} and status.agg(F.sum("done")).first()[0] == 4
    assert not quality.progress_gate(status, lost, "B").first().ok and quality.progress_gate(status, lost, "A").first().ok


def test_verbatim(spark):
    notes = spark.createDataFrame([("same", "共 100 个"), ("more", "共 100 个，另 15 个"), ("less", "没有数"), ("free", "共 100 个\n## AI 推断\n作者未提、我的推论：300"), ("lost", "7")], "path string, body string")
    blocks = spark.createDataFrame([(p, 0, "# 3.1.2 块\n原文 100 个") for p in ("same", "more", "less", "free")], "path string, ord int, segment string")
    got = {r.path: (r.extra, r.missing, r.degraded) for r in quality.verbatim(notes, blocks).collect()}
    assert got == {"same": ([], [], False), "more": (["15"], [], False), "less": ([], ["100"], False), "free": ([], [], False), "lost": (["7"], [], True)}


def test_note_rules_and_links(spark, kb):
    good = "## 作者说\n## AI 推断\n## 待确认\n[[a]]"
    rows = spark.createDataFrame(
        [note("工作流/视频/1_选题/a.md", body=good, topics=["x"]), note("工作流/写作/1_选题/b.md", body=good, topics=["x"]), note("工作流/视频/1_选题/c.md", body="{{open}} [[无]]", confidence="low"), note("工作流/视频/2_发布/d.md", body=good, topics=["x"], sources=["gone.md"], confidence="")], NOTE
    )
    found = {(r.subject[-4], r.code) for r in quality.note_rules(rows).collect()}
    assert found == {("b", "flow_path"), ("c", "section_missing"), ("c", "topics_empty"), ("c", "slot_open"), ("c", "confidence_low"), ("d", "stage_path"), ("d", "confidence_missing")}
    files = spark.createDataFrame([("a.md",)], "path string")
    assert [r.code for r in quality.unreachable_sources(rows, files).collect()] == ["source_unreachable"]
    assert [r.target for r in quality.broken_links(rows).collect()] == ["无"]
    meta = spark.createDataFrame([(4, 3)], "schema_version int, notes_indexed bigint")
    assert quality.index_consistency(meta, rows, 4).first().code == "count_differs" and quality.index_consistency(meta, rows.limit(3), 4).first().status == "pass"
    assert quality.verdicts(quality.note_rules(rows)).where("status = 'fail'").first().n == 5


def test_readers_and_writers(spark, tmp_path):
    head = '---\ntitle: "标题"\nflow: 视频\nstage: 1_选题\nsubstage: 案例\ntopics: [剪辑, 视频]   # 注释\nq_hooks:\n  - "怎么剪: 辑"\n  - 如何选题\nsources:\n  - a.md\ncreated: 2024-01-02\nstale: True\n---\n'
    folder = tmp_path / "kb" / "工作流"
    folder.mkdir(parents=True)
    (folder / "a b.md").write_text(head + "# t\r\n> 一句足够长的总结文字\nbody", encoding="utf-8")
    (folder / "_总览.md").write_text(head, encoding="utf-8")
    (folder / "plain.md").write_text("no head", encoding="utf-8")
    root = f"file://{tmp_path}/kb"
    got = src.read_notes(spark, root).collect()
    assert len(got) == 1 and got[0].path == "工作流/a b.md"
    (folder / "_临时.md").write_text(head, encoding="utf-8")
    assert {r.path for r in src.read_notes(spark, root).collect()} == {"工作流/a b.md", "工作流/_临时.md"}
    (folder / "_临时.md").unlink()
    n = got[0]
    assert (n.title, n.topics, n.q_hooks, n.sources, n.updated, n.stale, n.summary) == ("标题", ["剪辑", "视频"], ["怎么剪: 辑", "如何选题"], ["a.md"], "2024-01-02", True, "一句足够长的总结文字")
    assert {r.path for r in src.files(spark, root).collect()} == {"工作流/a b.md", "工作流/plain.md", "工作流/_总览.md"}
    raw = spark.createDataFrame([(head + "body",)], "text string")
    new = raw.select(src.with_hooks(F.col("text"), F.array(F.lit("新问法"))).alias("text")).withColumn("path", F.lit("x.md"))
    again = src.parse_notes(new).first()
    assert again.q_hooks == ["新问法"] and again.body == "body" and again.sources == ["a.md"]
    src.write_index(src.read_notes(spark, root), f"{root}/index")
    assert spark.read.parquet(f"{root}/index/meta").first().notes_indexed == 1 and spark.read.parquet(f"{root}/index/posting").where("gram = '剪辑'").count() == 1
    with pytest.raises(src.EmptyInput):
        src.write_index(src.read_notes(spark, root).where("false"), f"{root}/index2")
    units = tmp_path / "u.jsonl"
    units.write_text('{"id":"1","evidence":{"file":"f","locator":"l","quote":"q"}}\n\n{"id":"2","evidence":[{"file":"a"},{"file":"b"}]}\nnot json\n', encoding="utf-8")
    read = src.read_units(spark, str(units)).collect()
    assert [len(r.evidence) for r in read if r.id] == [1, 2] and sum(r._corrupt is not None for r in read) == 1
    assert {(r.tag, r.n) for r in src.tag_sniff(spark.createDataFrame([("tags: [a, b；c]\nx",), ("tags: a",)], "text string")).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    made = src.convert(spark.createDataFrame([("a.docx", b"hi"), ("b.pdf", b"x")], "path string, content binary"), {"docx": lambda b: b.decode()}).collect()
    assert {(r.path, r.status, r.text) for r in made} == {("a.docx", "converted", "hi"), ("b.pdf", "skipped", None)}
