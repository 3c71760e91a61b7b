from quillspark.operators import aggregate, planning


def test_planning_tables(spark):
    stages = spark.createDataFrame([("f", "选题", 1), ("f", "2_发布", 2)], "flow string, stage string, order int")
    assert {r.folder for r in planning.stage_folders(stages).collect()} == {"工作流/f/1_选题", "工作流/f/2_发布"}
    files = spark.createDataFrame([("知识卡片.pdf",), ("问答.pdf",), ("z.pdf",), ("m.txt",), ("k.txt",), ("k·精华笔记.md",), ("s.srt",)], "path string")
    assert {r.path: r.action for r in planning.special_files(aggregate.file_pairs(files), True).collect()} == {"知识卡片.pdf": "extract_cards", "问答.pdf": "extract", "z.pdf": "register", "m.txt": "generate_essence"}
    docs = spark.createDataFrame([("B站/长长长长.md",), ("b站/短.md",), ("好物中等.md",), ("codex.md",), ("x.md",), ("y.md",), ("a.transcript.b站.md",)], "path string")
    got = [tuple(r) for r in planning.samples(docs).collect()]
    assert got[:2] == [("好物中等.md", "B站"), ("codex.md", "编程")] and len(got) == 5
    goals = spark.createDataFrame([("B", 0), ("A", 1), ("C", 2)], "form string, rank int")
    assert {r.form: (r.weight, r.single) for r in planning.goal_weights(goals).collect()} == {"B": (0.5, False), "A": (0.3333, False), "C": (0.1667, False)}
    loose = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("3", "x"), ("4", "y")], "path string, label string")
    assert [tuple(r) for r in planning.proposals(loose).collect()] == [("x", 3)]
    tags = spark.createDataFrame([("a", 0.95), ("b", 0.7), ("c", 0.2)], "path string, confidence double")
    assert [r.level for r in planning.triage(tags).orderBy("path").collect()] == ["high", "medium", "low"]
    assert [(r["project"], r["limit"], r["rank"]) for r in planning.recipes(["p", "q"], [{"project": "p", "rank": ["时间"]}])] == [("p", 50, ["时间"]), ("q", 50, ["相关度", "时间"])]
