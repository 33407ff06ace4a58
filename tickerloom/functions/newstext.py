"""Column functions over news text: dedup keys, sector names, score post-processing, small coercions.

White space is Unicode white space throughout, written (?U)\\s, as ideographic spaces are common in this text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns removed before dedup keys are compared, in order.
DEDUP_NOISE = (
    r"财联社\d{1,2}月\d{1,2}日电[，,:：]?",
    r"金十数据\d{1,2}月\d{1,2}日讯[，,:：]?",
    r"^\[?金十数据\]?[，,:：]?",
    r"^\[?财联社\]?[，,:：]?",
    r"\s*[-—]\s*金十数据\s*$",
    r"\s*[-—]\s*财联社\s*$",
    r"\s*金十数据\s*$",
    r"\s*财联社\s*$",
    r"同花顺\d{1,2}月\d{1,2}日讯[，,:：]?",
    r"^\[?同花顺\]?[，,:：]?",
    r"\s*[-—]\s*同花顺\s*$",
    r"\s*同花顺\s*$",
    r"[（(]同花顺[）)]\s*$",
    r"[“”\"'`‘’]",
    r"[，。；：！？、】【（）()、,.;:!?·\-—\[\]]",
    r"\s+",
)
# Titles of a template say nothing about the story.
TEMPLATE_TITLES = (r"^金十图示", r"^新闻联播今日要点", r"^今日要点$", r"^金十数据$", r"^财联社$", r"^快讯$")

# Sector names in order of precedence.
SECTORS = (
    "半导体", "白酒", "白色家电", "保险", "包装印刷", "厨卫电器", "电池", "电机", "电力", "电网设备", "多元金融", "电子化学品",
    "房地产", "风电设备", "非金属材料", "服装家纺", "纺织制造", "工程机械", "光伏设备", "贵金属", "轨交设备", "港口航运", "公路铁路运输", "钢铁",
    "光学光电子", "工业金属", "环保设备", "环境治理", "互联网电商", "黑色家电", "化学纤维", "化学原料", "化学制品", "化学制药", "IT服务", "机场航运",
    "军工电子", "军工装备", "家居用品", "计算机设备", "金属新材料", "教育", "建筑材料", "建筑装饰", "零售", "旅游及酒店", "美容护理", "煤炭开采加工",
    "贸易", "农产品加工", "农化制品", "能源金属", "汽车服务及其他", "汽车零部件", "汽车整车", "其他电源设备", "其他电子", "其他社会服务", "软件开发", "燃气",
    "塑料制品", "食品加工制造", "生物制品", "石油加工贸易", "通信服务", "通信设备", "通用设备", "文化传媒", "物流", "消费电子", "小家电", "小金属",
    "橡胶制品", "元件", "医疗服务", "医疗器械", "饮料制造", "油气开采及服务", "影视院线", "游戏", "银行", "医药商业", "养殖业", "自动化设备",
    "综合", "证券", "中药", "专用设备", "造纸", "种植业与林业",
)
# Other names of sectors, in order of precedence.
ALIASES = {
    "猪肉": "养殖业", "生猪": "养殖业", "猪价": "养殖业", "猪周期": "养殖业", "养猪": "养殖业", "养殖": "养殖业", "白电": "白色家电",
    "航运": "港口航运", "集运": "港口航运", "港口": "港口航运", "航空": "机场航运", "机场": "机场航运", "石油石化": "石油加工贸易",
    "炼化": "石油加工贸易", "炼油": "石油加工贸易", "油气": "油气开采及服务", "天然气": "油气开采及服务", "煤炭": "煤炭开采加工",
    "券商": "证券", "传媒": "文化传媒", "影视": "影视院线", "白酒": "白酒", "消费电子": "消费电子", "光伏": "光伏设备", "锂电": "电池",
    "半导体": "半导体", "芯片": "半导体", "汽车零部件": "汽车零部件", "整车": "汽车整车", "创新药": "化学制药", "仿制药": "化学制药",
    "中药": "中药", "疫苗": "生物制品", "医疗器械": "医疗器械", "医药商业": "医药商业", "CXO": "医疗服务", "cxo": "医疗服务",
    "军工": "军工装备", "军工电子": "军工电子", "军工装备": "军工装备", "稀土": "小金属", "黄金": "贵金属", "铜": "工业金属",
    "铝": "工业金属", "锌": "工业金属", "锂": "能源金属", "镍": "能源金属", "钴": "能源金属", "软件": "软件开发", "通信": "通信设备",
}
# What a story's text says about its sector, in order of precedence.
CONTENT_RULES = (
    (r"(冻猪肉|收储|生猪|猪粮比|猪价|母猪)", "养殖业"),
    (r"(券商|证券公司)", "证券"),
    (r"(煤炭|动力煤|焦煤|焦炭)", "煤炭开采加工"),
    (r"(原油|油气|天然气勘探|油田|钻井)", "油气开采及服务"),
    (r"(石化|炼油|成品油)", "石油加工贸易"),
    (r"(白酒|茅台|五粮液)", "白酒"),
    (r"(电影|票房|院线)", "影视院线"),
    (r"(游戏|版号)", "游戏"),
    (r"(航运|集运|港口)", "港口航运"),
    (r"(机场|航空公司|客运航线)", "机场航运"),
    (r"(消费电子|手机|耳机|平板|可穿戴)", "消费电子"),
    (r"(光伏|组件|硅片|电池片)", "光伏设备"),
    (r"(锂电|电芯|储能电池)", "电池"),
    (r"(半导体|芯片|晶圆|封测)", "半导体"),
    (r"(机器人|工业自动化|自动化产线)", "自动化设备"),
    (r"(创新药|新药|药品获批|仿制药)", "化学制药"),
    (r"(中药|中成药)", "中药"),
    (r"(疫苗|血制品|生物制药)", "生物制品"),
    (r"(医疗器械|器械)", "医疗器械"),
    (r"(SaaS|操作系统|数据库|软件)", "软件开发"),
    (r"(通信设备|光模块|基站|交换机)", "通信设备"),
)
# Words of strong events, of official sources, and events strong by themselves.
POSITIVE = (
    "收储", "补贴", "回购", "增持", "中标", "签约", "获批", "批准", "订单", "提价", "涨价", "上调", "降息", "降准",
    "减税", "免税", "落地", "正式实施", "量产", "突破", "首个", "首次", "扩产", "投产", "并购", "收购", "超预期",
)
NEGATIVE = (
    "处罚", "立案", "违约", "爆雷", "停产", "召回", "减持", "制裁", "封禁", "禁运", "退市", "裁员", "下修", "终止",
    "取消订单", "砍单", "亏损扩大", "暴雷", "调查", "断供", "事故", "停牌",
)
OFFICIAL = (
    "国务院", "国家发改委", "发改委", "财政部", "工信部", "商务部", "央行", "证监会", "国家能源局", "农业农村部", "卫健委",
)
HARD_EVENTS = (
    "收储", "中标", "量产", "获批", "回购", "增持", "提价", "涨价", "降息", "降准", "停产", "处罚", "立案", "制裁",
    "订单", "断供",
)
NO_REASON = "未返回有效分析理由。"


#: Unicode's white space; as a list of characters it is trimmed without a regular expression.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def one_of(characters: str) -> str:
    """A pattern of one of characters. The few below U+0100 are looked up in a table; those above are tried one by one, and
    only where a character is above too."""
    low = "".join(f"\\x{ord(c):02x}" for c in characters if ord(c) < 0x100)
    high = "".join(c for c in characters if ord(c) >= 0x100)
    return f"[{low}[\u0100-\uffff&&[{high}]]]"


def any_of(words: Iterable[str]) -> str:
    """A pattern of any of words, tried only where a character stands that one begins with: the ASCII ones by name."""
    words = list(dict.fromkeys(words))
    ascii_ = "".join(sorted({w[0] for w in words if w[0].isascii()}))
    return f"(?=[\u0100-\uffff{ascii_}])(?:{'|'.join(words)})"


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row: an expression that is mentioned twice is else evaluated twice, in a
    lambda once per element, and its mentions multiply where such expressions are nested.

    A column that body mentions itself means, in a select, an alias of that name that stands before: bind it with value.
    """
    return F.get(F.transform(F.array(value), body), 0)


#: The last three noise patterns only take characters away, so they are one class of characters.
_SITES = DEDUP_NOISE[:-3]
_GONE = WHITE + "".join(p.strip("+")[1:-1].replace("\\", "") for p in DEDUP_NOISE[-3:-1])
_CHARACTERS = one_of(_GONE) + "+"
_SITE_NAMES = ("财联社", "金十数据", "同花顺")


def dedup_text(text: Column) -> Column:
    """text in the form that is compared."""
    return bound(strip(text), _compared)


def _compared(plain: Column) -> Column:
    """dedup_text of a column that is stripped already; only texts that name a feed go through the feeds' patterns."""
    out = plain
    for pattern in _SITES:
        # White space by its characters: (?U) makes every class of a pattern slow.
        out = F.regexp_replace(out, "(?U)" + pattern if "\\d" in pattern else pattern.replace("\\s", f"[{WHITE}]"), "")
    named = plain.contains(_SITE_NAMES[0])
    for name in _SITE_NAMES[1:]:
        named = named | plain.contains(name)
    return F.lower(F.regexp_replace(F.when(named, out).otherwise(plain), _CHARACTERS, ""))


def dedup_title_ok(title: Column) -> Column:
    t = strip(title)
    return (F.length(t) >= 6) & ~t.rlike("|".join(TEMPLATE_TITLES))


def strip_title(content: Column, title: Column) -> Column:
    """content without a leading title, bracketed or not, and the separators after it; content if nothing is left."""
    return _without_title(strip(content), strip(title))


def _without_title(c: Column, t: Column) -> Column:
    """strip_title of columns that are stripped already; c and t are mentioned often, so they had better be plain columns."""
    open_, close = F.lit("【["), F.lit("】]")
    bare = F.when(F.length(c) > 0, F.when(F.contains(open_, F.substring(c, 1, 1)), F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))
    at = F.when(c.startswith(t), F.lit(0)).when(bare == 1, F.lit(1)).otherwise(F.lit(-1))
    after = F.when((at == 1) & ~F.substr(c, F.lit(2)).startswith(t), F.lit(None)).otherwise(F.substr(c, at + F.length(t) + 1))
    closed = bound(after, lambda r: F.when((F.length(r) > 0) & F.contains(close, F.substring(r, 1, 1)), F.substr(r, F.lit(2))).otherwise(r))
    # A null is stripped to nothing.
    rest = strip(F.regexp_replace(closed, r"(?U)^\s*[-—:：，,\s]*", ""))
    return F.when((at < 0) | (t == "") | (c == ""), c).otherwise(bound(rest, lambda r: F.when(r == "", c).otherwise(r)))


def dedup_keys(df: DataFrame, title: str = "title", content: str = "content", keys: str = "keys") -> DataFrame:
    """df with a story's keys: of its title where that says something, of its content, and of its content without the title.

    The three texts are columns of their own first, so that each is computed once.
    """
    texts = df.withColumns({"__t": strip(F.col(title)), "__c": strip(F.col(content))})
    t, c = F.col("__t"), F.col("__c")
    texts = texts.withColumn("__rest", _without_title(c, t))
    texts = texts.withColumns({"__named": _compared(t), "__whole": _compared(c), "__rest": _compared(F.col("__rest"))})
    named, whole, rest = F.col("__named"), F.col("__whole"), F.col("__rest")
    found = F.array(
        F.when(dedup_title_ok(t) & (named != ""), F.concat(F.lit("title::"), named)),
        F.when(F.length(whole) >= 12, F.concat(F.lit("content::"), whole)),
        F.when((t != "") & (F.length(rest) >= 12), F.concat(F.lit("content::"), rest)),
    )
    return texts.withColumn(keys, F.array_distinct(F.array_compact(found))).drop("__t", "__c", "__named", "__whole", "__rest")


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


#: What is left out of a compacted name besides white space: from a backslash to an underscore, but no ASCII hyphen.
_SEPARATORS = "、，,/；;（）()\\]^_—"


def norm_sector(name: Column) -> Column:
    """The sector a name means, or null: exact, contained, compacted, alias, contained alias."""
    return bound(strip(name), lambda raw: bound(F.translate(raw, WHITE + _SEPARATORS, ""), lambda compact: _sector(raw, compact)))


def _sector(raw: Column, compact: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    held = F.coalesce(*[F.when(F.contains(raw, F.lit(s)), F.lit(s)) for s in SECTORS])
    meant = F.coalesce(*[F.when(F.contains(raw, F.lit(a)) | F.contains(compact, F.lit(a)), F.lit(s)) for a, s in ALIASES.items()])
    # One pattern tells most names that mean nothing; only others are looked up.
    known = any_of((*SECTORS, *ALIASES))
    return F.when(raw.isin(*SECTORS), raw).when(
        raw.rlike(known) | compact.rlike(known),
        F.coalesce(
            held,
            F.when(compact.isin(*SECTORS), compact),
            F.try_element_at(alias, compact),
            meant,
        ),
    )


def infer_sectors(content: Column) -> Column:
    def hits(text: Column) -> Column:
        found = F.array(*[F.when(text.rlike("(?i)" + pattern), F.lit(sector)) for pattern, sector in CONTENT_RULES])
        # Every rule but one begins with a character of no Latin script.
        return F.when(text.rlike("(?i)[\u0100-\uffff]|SaaS"), F.slice(F.array_distinct(F.array_compact(found)), 1, 3)).otherwise(F.array().cast("array<string>"))

    return bound(content, hits)


def norm_sector_list(items: Column, content: Column, subjects: Column) -> Column:
    """At most three sectors: of the items, else of the subjects, else of the content; null if none."""
    def of(names: Column) -> Column:
        return F.slice(F.array_distinct(F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), norm_sector))), 1, 3)

    def first(lists: list[Column]) -> Column:
        """The first list that has an element; those after it are not worked out."""
        rest = first(lists[1:]) if lists[1:] else F.lit(None)
        return bound(lists[0], lambda found: F.when(F.size(found) > 0, found).otherwise(rest))

    return first([of(items), of(subjects), infer_sectors(F.coalesce(content, F.lit("")))])


def coerce_int(text: Column, default: int = 0) -> Column:
    """The first integer in text."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"-?\d+", 0).try_cast("bigint"), F.lit(default).cast("bigint"))


def json_int(value: Column, default: int = 0) -> Column:
    """An integer of a JSON value (a variant): numbers rounded, halves to even; of other text the first integer; default
    for true, false, null and text without one."""
    def read(value: Column) -> Column:
        kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
        number = F.rint(F.try_variant_get(value, "$", "double")).cast("bigint")
        return F.when(kind.isin("BOOLEAN", "VOID") | value.isNull(), F.lit(default).cast("bigint")).when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), number).otherwise(coerce_int(text, default))

    return bound(value, read)


def json_list(value: Column) -> Column:
    """A JSON list of names, or a text that lists them; null for nothing."""
    def read(value: Column) -> Column:
        names = F.filter(F.transform(F.try_variant_get(value, "$", "array<string>"), strip), lambda x: x != "")
        listed = bound(names, lambda items: F.when(F.size(items) > 0, items))
        return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(coerce_list(F.try_variant_get(value, "$", "string")))

    return bound(value, read)


def coerce_list(text: Column) -> Column:
    """A list written as text, or null."""
    def listed(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"[、，,;/；\n]+"), strip), lambda x: x != "")
        return F.when((t != "") & (F.lower(t) != "null"), bound(parts, lambda p: F.when(F.size(p) > 0, p)))

    return bound(strip(text), listed)


def _found(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(_names(words), lambda w: F.contains(text, w)))


def direction(content: Column) -> Column:
    return bound(F.coalesce(content, F.lit("")), lambda text: F.signum(_found(text, POSITIVE) - _found(text, NEGATIVE)).cast("int"))


def strong_event(content: Column) -> Column:
    def strong(text: Column) -> Column:
        backed = text.rlike(any_of(OFFICIAL)) | text.rlike(r"(?U)\d")
        return (text.rlike(any_of((*POSITIVE, *NEGATIVE))) & backed) | text.rlike(any_of(HARD_EVENTS))

    return bound(F.coalesce(content, F.lit("")), strong)


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(-100), F.least(F.lit(100), F.coalesce(score.cast("int"), F.lit(0))))


def score_postprocess(score: Column, sectors: Column, content: Column) -> Column:
    """A clamped score; a zero for a story with sectors takes the direction of its words."""
    def completed(row: Column) -> Column:
        size = F.when(strong_event(row["content"]), F.lit(35)).otherwise(F.lit(15))
        # Zero directed by words that have no direction is zero.
        told = bound(direction(row["content"]), lambda way: F.when(way != 0, way * size).otherwise(F.lit(0)))
        return F.when((row["clamped"] == 0) & (row["sectors"] > 0), told).otherwise(row["clamped"])

    size = F.size(F.coalesce(sectors, F.array().cast("array<string>")))
    return bound(F.struct(clamp_score(score).alias("clamped"), size.alias("sectors"), content.alias("content")), completed)


def analysis_payload(told: Column, content: Column, subjects: Column) -> Column:
    """struct(score, reason, companies, sectors) of what a scorer told, a JSON object in text: coerced, cleaned, completed.

    A missing reason becomes NO_REASON, companies are distinct, sectors are normalised, a zero score takes the direction
    of the words. Null where told holds no object.
    """
    def read(v: Column) -> Column:
        field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
        reason = bound(strip(F.try_variant_get(v, "$.reason", "string")), lambda r: F.when(r != "", r).otherwise(F.lit(NO_REASON)))

        def completed(sectors: Column) -> Column:
            score = score_postprocess(json_int(field("score")), sectors, content)
            return F.struct(score.cast("int").alias("score"), reason.alias("reason"), F.array_distinct(json_list(field("companies"))).alias("companies"), sectors.alias("sectors"))

        return F.when(v.isNotNull(), bound(norm_sector_list(json_list(field("sectors")), content, subjects), completed))

    return bound(parsed_object(told), read)


def needs_repair(content: Column, raw_sectors: Column, sectors: Column, raw_score: Column) -> Column:
    none = F.array().cast("array<string>")
    raw, size = F.size(F.coalesce(raw_sectors, none)) > 0, F.size(F.coalesce(sectors, none))
    score = F.coalesce(raw_score.cast("int"), F.lit(0))
    weak = (score == 0) | ((F.abs(score) < 45) & strong_event(content))
    return F.when(size > 0, weak).otherwise(raw)


def extract_json(text: Column) -> Column:
    """The object written in text: a fenced block's, else from the first brace to the last; null if there is none."""
    def found(t: Column) -> Column:
        bare = bound(F.regexp_extract(t, r"(?s)\{.*\}", 0), lambda o: F.when(o != "", o))
        return bound(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), lambda o: F.when(o != "", o).otherwise(bare))

    return bound(F.coalesce(text, F.lit("")), found)


def parsed_object(text: Column) -> Column:
    """The variant of the object written in text; null if there is none, or if more than one value stands there.

    The parser stops after the first value, so it reads a list that has to hold just that value.
    """
    text_listed = F.try_parse_json(F.concat(F.lit("["), extract_json(text), F.lit("]")))
    return bound(text_listed, lambda listed: F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant")))


def sentiment(score: Column) -> Column:
    s = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.when(s >= 20, F.lit("positive")).when(s <= -20, F.lit("negative")).otherwise(F.lit("neutral"))


def score_tag(score: Column) -> Column:
    s = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.when(s > 60, F.lit("利好")).when(s < -60, F.lit("利空")).otherwise(F.lit("中性"))


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, rounded by its binary value, halves to even; format_string would round its shortest decimal."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def fmt_num(x: Column) -> Column:
    """At most three decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(fixed(x, 3), r"0+$", ""), r"\.$", "")


def md_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(ref))
    return out


def join_list(items: Column) -> Column:
    names = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.when(F.size(names) > 0, F.array_join(names, "、")).otherwise(F.lit("None"))


def iso_date(text: Column) -> Column:
    """yyyyMMdd or ISO text as a date; null for anything else."""
    t = strip(text)
    return F.coalesce(F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")))


def normalize_date(text: Column) -> Column:
    """yyyyMMdd as yyyy-MM-dd, any other text trimmed but as it is, blank as null."""
    t = strip(text)
    return F.when(t == "", None).when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(t)


def safe_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def safe_int(text: Column, default: int = 0) -> Column:
    """A number's whole part."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def positive_int(text: Column, default: int) -> Column:
    n = safe_int(text, default)
    return F.when(n > 0, n).otherwise(F.lit(default).cast("bigint"))


def non_negative_int(text: Column) -> Column:
    return F.greatest(safe_int(text), F.lit(0).cast("bigint"))
