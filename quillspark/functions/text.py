"""Column functions on text: tokens, stems, chunk features, patterns, ids. All are built-in expressions.

Python's ``str`` and Spark's strings both count code points; offsets here are code points from 0. Texts are expected
with newlines as ``\\n``; ``newlines`` makes them so.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Vocabulary, patterns and weights that results depend on.
STOP_CHARS = "的了是在我你他她它们和与及也就都很还被把让给而但或一个不有个这那呢吗啊呀吧"
STOP_WORDS_EN = (
    "the a an and or but if than then that this these those it its is are was were be been being do does did doing have has had "
    "of in on at to for with without by from as into about over under not no nor only same so"
).split()
STOP_WORDS_RU = "и в во не что он она они мы вы ты с со к как а но да или если то при для от до из чтобы этот их её".split()
HAN_KANA = r"一-鿿㐀-䶿぀-ヿㇰ-ㇿ"
HANGUL_THAI = r"가-힣ᄀ-ᇿ㄰-㆏฀-๿"
STEM_RULES = (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))
LEAST_STEM = 3
TYPE_PRIORITY = {"教程": 1.0, "案例": 0.9, "SOP": 0.85, "复盘": 0.8, "问答": 0.7, "观点": 0.6, "素材": 0.5}
HEADING_TERMS = ("定义", "概念", "原理", "方法", "步骤", "流程", "注意", "结论")
CAUSAL_WORDS = ("因为", "所以", "导致", "意味着", "关键在于")
ACTION_WORDS = ("命令", "步骤", "点击", "安装", "脚本", "参数", "复制", "粘贴", "导出", "导入", "改成", "运行")
FEATURE_WEIGHTS = {"code": 0.6, "numbers": 0.3, "cmd": 0.3, "link": 0.1, "concept_heading": 0.3, "causal": 0.2, "actionable": 0.3, "narrative": 0.2}
NARRATIVE_CHARS = 80
LEAST_CHUNK = 50
HIGH_DENSITY = 0.5

WORD = rf"[[\p{{L}}\p{{N}}_̀-ͯ]&&[^{HAN_KANA}{HANGUL_THAI}]]+"
SEGMENT = rf"[{HAN_KANA}]+|[{HANGUL_THAI}]+|{WORD}"


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_quotes(text: Column) -> Column:
    """One layer of paired quotes goes."""
    return F.regexp_replace(F.trim(text), r"""(?s)^(["'])(.*)\1$""", "$2")


def stage_key(stage: Column) -> Column:
    """A stage's name without quotes and without its leading number."""
    return F.trim(F.regexp_replace(strip_quotes(stage), r"^\d+[ \t]*[_、.．\-][ \t]*", ""))


def stem(word: Column) -> Column:
    """A Latin word without the first of the usual suffixes that leaves three code points; other words as they are."""
    out = word
    for suffix, put in reversed(STEM_RULES):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) + len(put) >= LEAST_STEM)
        out = F.when(fits, F.concat(word.substr(F.lit(1), F.length(word) - len(suffix)), F.lit(put))).otherwise(out)
    return F.when(word.rlike(r"^[\x00-\x7f]*$"), out).otherwise(word)


def _pairs(chars: Column) -> Column:
    """All runs of two of some characters."""
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda x, y: F.concat(x, y))


def _stops(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def grams(text: Column, single: bool = False, drop_stopwords: bool = False) -> Column:
    """Index terms in order, by script: two-character runs of Han and kana (and with ``single`` their characters but stop
    characters), two-character runs of Hangul and Thai, and lower-cased stemmed words of all else.

    ``drop_stopwords`` takes English and Russian function words out, unless nothing else would be left.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), stem)

    def units(segment: Column) -> Column:
        pairs = _pairs(F.split(segment, ""))
        if single:
            han = F.concat(F.filter(F.split(segment, ""), lambda c: ~F.lit(STOP_CHARS).contains(c)), pairs)
        else:
            han = pairs
        first = segment.substr(1, 1)
        return F.when(first.rlike(f"[{HAN_KANA}]"), han).when(first.rlike(f"[{HANGUL_THAI}]"), pairs).otherwise(F.array(stem(F.lower(segment))))

    mixed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)), units))
    out = F.when(text.rlike(f"[{HAN_KANA}{HANGUL_THAI}]"), mixed).otherwise(words)
    if not drop_stopwords:
        return out
    stops = _stops(STOP_WORDS_EN + STOP_WORDS_RU)
    kept = F.filter(out, lambda w: ~F.array_contains(stops, w))
    return F.when(F.size(kept) > 0, kept).otherwise(out)


def query_grams(text: Column) -> Column:
    """The distinct terms of a query, without function words."""
    return F.array_distinct(grams(text, drop_stopwords=True))


def index_grams(text: Column) -> Column:
    """The terms under which a text is indexed."""
    return grams(text, single=True)


def summary(body: Column) -> Column:
    """The first quoted line of more than eight characters, without its mark."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith(">") & (F.length(x) > 8))
    return F.coalesce(F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^>\s*", "")), F.lit(""))


def doc_key(path: Column) -> Column:
    return F.concat(F.lit("doc-"), F.md5(path).substr(1, 8))


# Chunk features ----------------------------------------------------------------------------------------------------

FENCE = r"(?s)```.*?```"


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def chunk_features(segment: Column, heading: Column) -> Column:
    """Names of the features a chunk has, in order of the weights' table."""
    body = F.regexp_replace(segment, FENCE, "")
    narrative = F.exists(F.split(body, r"\n\s*\n"), lambda p: F.length(F.regexp_replace(p, r"^\s+|\s+$", "")) >= NARRATIVE_CHARS)
    has = {
        "code": segment.rlike(FENCE),
        "numbers": F.size(F.regexp_extract_all(body, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0))) >= 3,
        "cmd": body.rlike(r"`[^`\n]+`"),
        "link": body.rlike(r"https?://\S+"),
        "concept_heading": contains_any(heading, HEADING_TERMS),
        "causal": contains_any(body, CAUSAL_WORDS),
        "actionable": contains_any(body, ACTION_WORDS),
        "narrative": narrative,
    }
    return F.array_compact(F.array(*[F.when(has[name], F.lit(name)) for name in FEATURE_WEIGHTS]))


def density(features: Column) -> Column:
    """The features' weights summed, to two digits."""
    weights = F.create_map(*[x for k, v in FEATURE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.round(F.aggregate(features, F.lit(0.0), lambda acc, f: acc + F.element_at(weights, f)), 2)


def high_value(length: Column, dense: Column, features: Column) -> Column:
    return (length >= LEAST_CHUNK) & ((dense >= HIGH_DENSITY) | F.array_contains(features, "code"))


def skip_reason(length: Column, high: Column) -> Column:
    return F.when(~high, F.when(length < LEAST_CHUNK, "过短/目录").otherwise("低密度"))


def candidate_topics(heading: Column) -> Column:
    """The heading without marks, if it is of two to twenty characters."""
    bare = F.trim(F.regexp_replace(heading, r"[|\*#\[\]()（）:：]", ""))
    return F.when(F.length(bare).between(2, 20), F.array(bare)).otherwise(F.expr("cast(array() as array<string>)"))


# Patterns of verbatim and quality checks ---------------------------------------------------------------------------

# Fixed values.
NUMBER = r"(?<![0-9A-Za-z])\d[\d,\.]*(?:[-–—]\d[\d\.]*)?%?(?![0-9A-Za-z])"
COMMAND = r"`([^`\n]+)`"
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
SLOT = r"\{\{[^{}]+\}\}"
SIGNED_URL = r"x-oss-[A-Za-z-]+=|X-Amz-Signature|X-Amz-Credential|sig=[0-9a-f]{16,}"
MISSING_ASSET = r"缺失素材|\[[^\]]*:None\]|未随文复刻|未随文导出|请回[^，。\n]{0,8}原文查看"
LOCATOR = r"#char=(\d+)-(\d+)"


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def command_spans(text: Column) -> Column:
    """Inline code that looks like a command: with a space, slash, dollar sign, >, - or a digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(COMMAND), F.lit(1)), lambda x: x.rlike(r"[\s/$>\-]|\d"))


def dead_assets(text: Column) -> Column:
    """(signed urls, placeholders of missing assets)."""
    return F.struct(
        F.size(F.regexp_extract_all(text, F.lit(SIGNED_URL), F.lit(0))).alias("signed"), F.size(F.regexp_extract_all(text, F.lit(MISSING_ASSET), F.lit(0))).alias("missing")
    )


def squash(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"\s+", "")


def norm(text: Column) -> Column:
    """Without white space, markup and punctuation: what a quote is compared by."""
    return F.regexp_replace(text, r"[\s\p{P}\p{S}]+", "")


def without_code(text: Column) -> Column:
    """Without fenced and inline code."""
    return F.regexp_replace(F.regexp_replace(text, FENCE, ""), r"`[^`\n]*`", "")


def wikilinks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def slots(text: Column) -> Column:
    """Template slots outside code that nothing has filled."""
    return F.regexp_extract_all(without_code(text), F.lit(SLOT), F.lit(0))


def locators(text: Column) -> Column:
    """Array of (start, end) of the places a text names."""
    starts, ends = (F.regexp_extract_all(text, F.lit(LOCATOR), F.lit(g)) for g in (1, 2))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))


# What is taken out, and what stays of it.
NOISE = (
    (r"(?s)```.*?```", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[\[[^\]|]+\|([^\]]*)\]\]", "$1"),
    (r"\[\[[^\]]*\]\]", " "),
    (r"§[^`\n]*?#char=\d+-\d+", " "),
    (r"\[char=\d+(?:-\d+)?\]", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"https?://\S+", " "),
    (r"(?:assets|静态资源)/[^\s)`]+", " "),
    (r"(?m)^[ \t>]*#{1,6}[ \t]+\d+(?:\.\d+)*[ \t.、]*", ""),
    (r"(?m)^(?:[ \t>]*|[ \t>]*[-*+][ \t]+)\d+[\.、)]", ""),
)


def without_noise(text: Column) -> Column:
    """Without images, links, locators, urls, list marks and heading numbers, whose digits say nothing."""
    out = text
    for pattern, put in NOISE:
        out = F.regexp_replace(out, pattern, put)
    return out


def inference_scope(text: Column, heading: str = "## AI 推断", mark: str = "作者未提、我的推论：") -> Column:
    """The text but for marked inference lines after the inference heading, which claim no source."""
    head, tail = F.substring_index(text, heading, 1), F.regexp_extract(text, rf"(?s)\Q{heading}\E(.*)$", 1)
    kept = F.concat_ws("\n", F.filter(F.split(tail, "\n"), lambda x: ~F.regexp_replace(x, r"^[\s>*-]+", "").startswith(mark)))
    return F.when(text.contains(heading), F.concat(head, kept)).otherwise(text)


# First lines that stand for headings, cells that hold no text.
PSEUDO_HEADING = (
    r"^[ \t]{0,3}\*\*[^*\n]{2,60}\*\*[:：]?[ \t]*$",
    r"^[ \t]{0,3}\*\*[^*\n]{2,60}?\*\*",
    r"^[ \t]{0,3}\d+(?:\.\d+){1,4}[ \t]+\S",
    r"^[ \t]{0,3}[一二三四五六七八九十]{1,3}[、.．][ \t]*\S",
    r"^[ \t]{0,6}第[ \t]*[0-9一二三四五六七八九十]+[ \t]*[步讲节部课]",
    r"^[ \t]{0,3}[^*\n]{2,20}[:：][ \t]*$",
)
MEDIA_CELL = r"(?i)https?://|\]\(|x-oss-|\.(mp4|mov|m4a|mp3|wav|png|jpe?g|gif|webp|pdf|zip)\b|缺失素材|未随文|<img|<video|<audio"


def pseudo_heading(text: Column) -> Column:
    """Whether the first line reads like a heading without being one."""
    line = F.regexp_replace(F.substring_index(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", 1), r"\s+$", "")
    return line.rlike("|".join(PSEUDO_HEADING))


def media_table(text: Column) -> Column:
    """Whether at least half of two or more cells hold urls, files or placeholders."""
    html = F.regexp_extract_all(text, F.lit(r"(?s)<td>(.*?)</td>"), F.lit(1))
    cells = F.filter(F.transform(F.concat(F.split(text, r"\|"), html), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda c: (c != "") & ~c.rlike(r"^[-: ]+$"))
    return (F.size(cells) >= 2) & (F.size(F.filter(cells, lambda c: c.rlike(MEDIA_CELL))) * 2 >= F.size(cells))


# File classes ------------------------------------------------------------------------------------------------------

# Extensions by class.
FILE_CLASSES = {
    "md": "md",
    "pdf": "pdf",
    "txt": "txt",
    "srt": "srt",
    "other_readable": "vtt ass html htm rtf",
    "needs_convert": "docx epub odt",
    "image": "jpg jpeg png webp gif heic bmp",
    "video": "mp4 mov webm mkv avi",
    "archive": "zip rar 7z tar gz",
    "exec": "exe apk msi bat",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_class(path: Column) -> Column:
    out = F.lit("other")
    for name, extensions in FILE_CLASSES.items():
        out = F.when(extension(path).isin(extensions.split()), F.lit(name)).otherwise(out)
    return out
