"""Column functions on fixed examples and against small models in plain Python."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as t


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "x string").select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_grams_by_script(spark):
    def grams(x, **k):
        return one(spark, x, t.grams(F.col("x"), **k))

    assert grams("vidéos cats cas doc_maps.jsonl") == ["vidéos", "cat", "cas", "doc_map", "jsonl"]
    assert grams("AI选题") == ["ai", "选题"]
    assert grams("选题", single=True) == ["选", "题", "选题"] and grams("的题", single=True) == ["题", "的题"]
    assert grams("한국어") == ["한국", "국어"] and "한" not in grams("한국어", single=True)
    assert "か" in grams("かな", single=True)
    assert grams("关键词คัดค้น한국어문") == ["关键", "键词", "คั", "ัด", "ดค", "ค้", "้น", "น한", "한국", "국어", "어문"]
    assert not any(re.search("[一-鿿][ก-๙가-힣]", g) for g in grams("关键词คัด한국어"))
    assert grams("the a an", drop_stopwords=True) == ["the", "a", "an"] and grams("the video", drop_stopwords=True) == ["video"]
    assert grams("клучевые и слова", drop_stopwords=True) == ["клучевые", "слова"]
    assert grams(None) == [] and grams("题") == []
    assert len(t.STOP_WORDS_EN) == 50 and len(t.STOP_WORDS_RU) == 30


def test_stem(spark):
    for word, want in (("cities", "city"), ("running", "runn"), ("used", "used"), ("aimed", "aim"), ("boxes", "box"), ("cats", "cat"), ("cas", "cas"), ("ies", "ies"), ("ties", "tie"), ("ing", "ing"), ("élèves", "élèves")):
        assert one(spark, word, t.stem(F.col("x"))) == want, word


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="ab '\"1_.-、", max_size=12))
def test_stage_key_drops_one_leading_number(spark, x):
    got = one(spark, x, t.stage_key(F.col("x")))
    bare = x.strip(" ")
    if len(bare) > 1 and bare[0] == bare[-1] and bare[0] in "\"'":
        bare = bare[1:-1]
    assert got == re.sub(r"^\d+[ \t]*[_、.\-．][ \t]*", "", bare).strip(" ")


def test_chunk_features(spark):
    body = "步骤 1 2 3\n\n`ls -l`\n" + "因为" + "字" * 80 + "\n```\ncode\n```\nhttp://a.b"
    features, dense = one(spark, body, t.chunk_features(F.col("x"), F.lit("方法")), t.density(t.chunk_features(F.col("x"), F.lit("方法"))))
    assert features == list(t.FEATURE_WEIGHTS) and abs(dense - sum(t.FEATURE_WEIGHTS.values())) < 1e-9
    assert one(spark, "目录", t.chunk_features(F.col("x"), F.lit(""))) == []
    assert one(spark, "x", t.candidate_topics(F.lit("**方法**（一）"))) == ["方法一"] and one(spark, "x", t.candidate_topics(F.lit("#"))) == []


def test_numbers_commands_assets(spark):
    x = "图1,000 张 5-10 天 a15b 300% Mp7nwi0 `a b` `name` `x2` [[目标|别名]] {{slot}} `{{code}}` u?x-oss-process=1 缺失素材"
    assert one(spark, x, t.number_tokens(F.col("x"))) == ["1,000", "5-10", "300%", "1"]
    assert one(spark, x, t.command_spans(F.col("x"))) == ["a b", "x2", "{{code}}"][:2]
    assert one(spark, x, t.wikilinks(F.col("x"))) == ["目标"] and one(spark, "[[1000 ]]", t.wikilinks(F.col("x"))) == ["1000"]
    assert one(spark, x, t.slots(F.col("x"))) == ["{{slot}}"]
    assert tuple(one(spark, x, t.dead_assets(F.col("x")))) == (1, 1)
    assert [tuple(p) for p in one(spark, "§h#char=3-9 and #char=10-12", t.locators(F.col("x")))] == [(3, 9), (10, 12)]
    assert one(spark, "### 3.1.2 节点二\n1. 一 [char=4-5] §3.1 x#char=7-8 [[12|别名 9]] ![7](8) 42", t.number_tokens(t.without_noise(F.col("x")))) == ["9", "42"]
    scope = one(spark, "正文 300\n## AI 推断\n作者未提、我的推论：400\n其他 500", t.inference_scope(F.col("x")))
    assert "400" not in scope and "500" in scope and "300" in scope
    assert one(spark, " a\tb\n", t.squash(F.col("x"))) == "ab" and one(spark, "「好」, **x**！", t.norm(F.col("x"))) == "好x"


def test_headings_tables_files(spark):
    for x, want in (("**小标题**：", True), ("1.2.3 节点", True), ("一、开始", True), ("第3步 做", True), ("说明：", True), ("普通的一句话。", False)):
        assert one(spark, x, t.pseudo_heading(F.col("x"))) is want, x
    assert one(spark, "| a.png | http://x | b |\n| --- | --- | --- |", t.media_table(F.col("x"))) and not one(spark, "| a | b |", t.media_table(F.col("x")))
    for x, want in (("a.MD", "md"), ("b.vtt", "other_readable"), ("c.docx", "needs_convert"), ("d.heic", "image"), ("e", "other"), ("f.srt", "srt")):
        assert one(spark, x, t.file_class(F.col("x"))) == want
    assert one(spark, "intro\n> short\n> 这是一句足够长的总结\n", t.summary(F.col("x"))) == "这是一句足够长的总结"
    assert one(spark, "\"'a'\"", t.strip_quotes(F.col("x"))) == "'a'" and one(spark, "a\r\nb\rc", t.newlines(F.col("x"))) == "a\nb\nc"
