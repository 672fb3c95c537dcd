"""Line cleaning: notices, section heads, labels, credits, translations. Rules apply in a fixed order; each names itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import HAN, HANGUL, KANA, has_only_han, norm_letters, strip
from .vectors import once

# Patterns that decide which lines go.
NOTICE = (
    r"(?iU)未经.{0,16}(许可|授权|同意|允许).{0,24}(翻唱|翻录|翻弹|使用|商用|改编|发布|二创|转载|上传)|(著作权|版权|版税|侵权|著作人|权利人|权利保留).{0,30}"
    r"|.{0,30}(侵权必究|违者必究|版权所有|版权纠纷)|人工智能|\bAI\b.{0,12}(训练|生成|学习)|商用|商业使用|非商业|非盈利|购买租赁|私信购买|请评论|填翻授权|正式授权|获得授权"
    r"|(用|使用)(这个|此)\s*beat|音乐人$|^\W*翻唱\W*$|本(歌曲|作品|专辑|单曲)(来自|为|经过|声明|由|已)|网易音乐人|飓风计划|云上工作室|音乐人计划"
    r"|(伴奏|beat).{0,30}(商用|版税|购买|发歌|上传|免费版|评论)|(关注|评论).{0,12}(网易云|微博|公众号|抖音|B站|bilibili|下方)"
    r"|[©℗]|https?://|www\.|\b[\w.-]+@[\w-]+\.\w+|\b[\w-]+\.(com|cn|net|org)\b|LRC ?(generator|editor|by)|maker tool|lrc[焕by]|歌词(制作|贡献|编辑|校对|翻译)|贡献者"
    r"|(独家|短视频|音乐)平台|(出品|发行|宣发|监制|企划)[:：]?$"
)
# The same for find: runs that may be empty at its ends say nothing. Lines without a far character (Han, wide forms, two signs) can only have what NOTICE_NEAR lists.
NOTICE_FOUND = NOTICE.replace("利人|权利保留).{0,30}", "利人|权利保留)").replace("|.{0,30}(侵权必究", "|(侵权必究")
FAR = r"[\x{2117}\x{212A}\x{2E80}-\x{10FFFF}]"
NOTICE_NEAR = r"(?iU)©|https?://|www\.|\w[.-]*@[\w-]+\.\w|\w-*\.(com|cn|net|org)\b|LRC ?(generator|editor|by)|maker tool|lrc[by]"
SECTION = r"(?iU)^\W*(verse|chorus|hook|bridge|intro|outro|pre-?chorus|post-?chorus|refrain|refrão|interlude|breakdown|drop|rap|副歌|主歌|间奏|桥段|前奏|尾奏|说唱|独白)\W*\d*\W*(x\s*\d+)?\W*$"
SECTION_HEAD = r"(?iU)^\W*(verse|chorus|hook|bridge|intro|outro|pre-?chorus|refrain|interlude)\s*\.?\s*\d*\s*[:：]"
SINGER = r"(?iU)^\s*[(（\[【]\s*(男|女|合|男女|女男|合唱|齐|众|童|男生|女生|童声|all|both|male|female)\s*[)）\]】]\s*"
TAG = r"【[^】]*】|\[[^\]]*\]"
FURIGANA = f"([{HAN}々]+)[(（]([{KANA}]+)[)）]"
COLON = r"(?U)^\s*([^:：\[\]]{1,24}?)\s*[:：]\s*(.*)$"
CREDIT_WORD = (
    "作词|作曲|编曲|作編曲|詞|曲：|填词|词：|曲:|词:|混音|缩混|母带|录音|錄音|制作|製作|监制|監製|和声|和音|出品|发行|發行|企划|策划|统筹|統籌|宣传|封面|美工|后期|後期|原唱|翻唱|演唱|吉他|贝斯|貝斯"
    "|鼓：|键盘|鍵盤|弦乐|弦樂|配唱|调音|修音|人声|版权|版權|原曲|原作|改编|改編|作曲家|歌手|配音|策劃|助理|出版|OP|SP|ISRC|CV|[Pp]roduc|[Aa]rrang|[Cc]ompos|[Ll]yric|[Mm]ix|[Mm]aster|[Rr]ecord"
    "|[Vv]ocal|[Gg]uitar|[Bb]ass|[Dd]rum|[Ss]trings|[Pp]ublish|[Ss]upervis|[Ee]ngineer"
)
LEAD_CREDIT = r"(?U)^\s*(作词|作曲|编曲|作编曲|填词|混音|缩混|母带|录音|制作人|制作|监制|和声|出品|发行|企划|策划|统筹|原唱|演唱|吉他|贝斯|弦乐|配唱|人声|版权|原曲|改编|OP|SP|ISRC)"
SHORT_CREDITS = "词 曲 编 混 唱 歌 词作 曲作 演唱 原唱 主唱 鼓 弦 词曲 作 编曲 监制 制作 和声 吉他 贝斯 键盘 统筹 文案 海报 视频 剪辑 PV MV 翻 调 修".split()
PARENS = r"[(（][^()（）]*[)）]"
HAN_PARENS = f"[(（][^()（）]*[{HAN}][^()（）]*[)）]"
GLOSS = rf"(?U)(?<=[A-Za-z'])\s*[(（][{HAN}，、]{{1,10}}[)）]"
SPLIT = r"(?U)\s*(?:\s/\s|/|｜|\|)\s*"
TRAIL_SPACED = rf"(?U)(?<=\S)[\s　,，。.!！?？~]+[{HAN}，。、！？\s]{{3,}}$"
TRAIL_GLUED = rf"(?<=[{KANA}a-zA-Z])[{HAN}]{{6,}}[，。、！？]*$"


# The second cleaner's patterns, for lyrics whose credits stand among timed lines.
NOTICE_LINE = (
    r"(?U)^\s*[【\[(（].*(版权|授权|翻唱|商用|未经|著作权|监制|出品).*[】\])）]\s*$|版权所有|未经许可|未经授权|不得翻唱"
)
ROLE = (
    r"(?iU)词|曲|编|混|母带|录|鼓|吉他|贝斯|键盘|钢琴|弦|和声|和音|合音|监制|制作|统筹|总监|策划|出品|发行|顾问|宣传|PGM|OP|SP|舞|摄|灯光|音响"
    r"|Program|Producer|Mix|Master|Engineer|Lyric|Compos|Arrang|Guitar|Bass|Drum|Piano|Keyboard|Strings|Vocal|Studio|Record"
)
SPEAKER = r"(?U)^\s*([^:：]{1,40}?)\s*[:：]\s*(.*)$"

#: What clean_report counts, in this order.
RULES = ("title", "notice", "section", "singer", "furigana", "credit", "role", "split", "paren", "gloss", "korean", "trailing", "dropped_lines", "lines_changed")


def sung_text(line: Column) -> Column:
    """The sung part of a line: null for credits, notices and heads without text, without a leading label of a singer or part, else the line."""
    label, rest = F.regexp_extract(line, SPEAKER, 1), strip(F.regexp_extract(line, SPEAKER, 2))
    part = (F.length(label) <= 6) | label.contains("+") | label.contains("合")
    spoken = F.when((rest == "") | label.rlike(ROLE), F.lit(None)).when(part, rest).otherwise(line)
    return F.when(line.rlike(NOTICE_LINE), F.lit(None)).when(line.rlike(SPEAKER), spoken).otherwise(line)


def is_notice(line: Column) -> Column:
    """Whether NOTICE is found in a line."""
    return F.when(line.rlike(FAR), line.rlike(NOTICE_FOUND)).otherwise(line.rlike(NOTICE_NEAR))


def _holds(text: Column, *signs: str) -> Column:
    """Whether one of the signs is in the text: a rule that can't do without them is tried only then."""
    return reduce(Column.__or__, [text.contains(s) for s in signs])


def _may_trail(line: Column) -> Column:
    """Whether a line ends as TRAIL_SPACED and TRAIL_GLUED want it."""
    return F.right(line, F.lit(1)).rlike(rf"(?U)[{HAN}，。、！？\s]")


def clean_line(line: Column) -> Column:
    """(text, rules, rule): the cleaned line, all rules that changed it in order (lines_changed behind them if it is kept otherwise than it was) and the last of them; the empty text for a line that goes."""

    def made(text: Column, rules: Column) -> Column:
        return F.struct(text.alias("text"), rules.alias("rules")).cast("struct<text:string,rules:array<string>>")

    def noted(s: Column, rule: str) -> Column:
        return F.concat(s["rules"], F.array(F.lit(rule)))

    def changed(s: Column, text: Column, rule: str) -> Column:
        return made(text, F.when(text != s["text"], noted(s, rule)).otherwise(s["rules"]))

    def alive(s: Column, then: Column) -> Column:
        return F.when(s["text"] == "", s).otherwise(then)

    def step(s: Column, then) -> Column:
        """then(s), with s worked out once: a fold over one element binds it."""
        return F.element_at(F.transform(F.array(s), then), 1)

    one = lambda rule: F.array(F.lit(rule))
    s = F.when(is_notice(line), made(F.lit(""), one("notice"))).when(line.rlike(SECTION) | line.rlike(SECTION_HEAD), made(F.lit(""), one("section"))).otherwise(made(line, F.array().cast("array<string>")))
    s = step(s, lambda x: alive(x, changed(x, F.regexp_replace(x["text"], SINGER, ""), "singer")))
    s = step(s, lambda x: alive(x, made(strip(F.when(_holds(x["text"], "【", "["), F.regexp_replace(x["text"], TAG, " ")).otherwise(x["text"])), x["rules"])))
    s = step(s, lambda x: F.when(_holds(x["text"], "(", "（"), changed(x, F.regexp_replace(x["text"], FURIGANA, "$2"), "furigana")).otherwise(x))

    def credit(x: Column) -> Column:
        label, rest = F.regexp_extract(x["text"], COLON, 1), strip(F.regexp_extract(x["text"], COLON, 2))
        has = x["text"].rlike(COLON)
        goes = has & (label.rlike(CREDIT_WORD) | strip(label).isin(SHORT_CREDITS) | (rest == ""))
        role = has & (F.length(label) <= 6) & label.rlike(rf"(?U)^[{HAN}{KANA}{HANGUL}\w·]+$") & ~label.rlike("[a-zA-Z]")
        kept = F.when(role, made(rest, noted(x, "role"))).otherwise(x)
        return F.when(goes, made(F.lit(""), noted(x, "credit"))).otherwise(kept)

    s = step(s, lambda x: F.when(_holds(x["text"], ":", "："), credit(x)).otherwise(x))
    s = step(s, lambda x: F.when(x["text"].rlike(LEAD_CREDIT), made(F.lit(""), noted(x, "credit"))).otherwise(x))

    def translated(x: Column) -> Column:
        parts = F.filter(F.split(x["text"], SPLIT), lambda p: strip(p) != "")
        a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        one = (F.size(parts) == 2) & (has_only_han(a) != has_only_han(b))
        return F.when(one, made(F.when(has_only_han(a), b).otherwise(a), noted(x, "split"))).otherwise(x)

    s = step(s, lambda x: F.when(_holds(x["text"], "/", "|", "｜"), translated(x)).otherwise(x))

    def parenthesised(x: Column) -> Column:
        outside = F.regexp_replace(x["text"], PARENS, "")
        return F.when((strip(outside) != "") & ~outside.rlike(f"[{HAN}]"), changed(x, F.regexp_replace(x["text"], HAN_PARENS, ""), "paren")).when(outside.rlike(f"[{HAN}]"), changed(x, F.regexp_replace(x["text"], GLOSS, ""), "gloss")).otherwise(x)

    s = step(s, lambda x: F.when(_holds(x["text"], "(", "（"), parenthesised(x)).otherwise(x))
    s = step(s, lambda x: F.when(x["text"].rlike(f"[{HANGUL}]") & x["text"].rlike(f"[{HAN}]"), changed(x, F.regexp_replace(x["text"], f"[{HAN}]+", " "), "korean")).otherwise(x))
    gone = lambda x: F.arrays_overlap(x["rules"], F.array(*map(F.lit, ("notice", "section", "credit"))))
    s = step(s, lambda x: made(strip(F.regexp_replace(x["text"], r"(?U)\s+", " ")), F.when((x["text"] != line) & ~gone(x), noted(x, "lines_changed")).otherwise(x["rules"])))
    last = lambda x: F.try_element_at(F.filter(x["rules"], lambda r: r != "lines_changed"), F.lit(-1))
    return step(s, lambda x: F.struct(x["text"].alias("text"), x["rules"].alias("rules"), last(x).alias("rule")))


def _heads(title: Column):
    """Whether a line, by its place, is a title: among the first two, with a dash or title brackets or the title itself."""
    stem = norm_letters(title)
    return lambda t, i: (i < 2) & (t.contains(" - ") | t.contains("《") | ((stem != "") & (norm_letters(t) == stem)))


def _without_trail(t: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(t, TRAIL_SPACED, ""), TRAIL_GLUED, ""))


def clean_report(df: DataFrame, lines: str, title: Column) -> DataFrame:
    """df with the array of texts cleaned, and counts: a map from each of RULES to how often it took effect in the row.

    Title lines among the first two go, then each line is cleaned by itself, then trailing translations go if a quarter of
    the lines has one. Lines left empty go (dropped_lines; titles count apart).
    """
    x = F.col(lines)
    foreign = lambda t: t.rlike(f"[{KANA}{HANGUL}]") | t.rlike("[a-zA-Z]{2,}")
    hit = F.size(F.filter(x, lambda t: _may_trail(t) & foreign(t) & (t.rlike(TRAIL_SPACED) | t.rlike(TRAIL_GLUED))))
    heads = _heads(title)
    trails = lambda s, on: on & (s["text"] != "") & ~has_only_han(s["text"]) & (_without_trail(s["text"]) != "") & (_without_trail(s["text"]) != s["text"])
    ended = lambda s, on: F.when(trails(s, on), F.struct(_without_trail(s["text"]).alias("text"), F.concat(s["rules"], F.array(F.lit("trailing"))).alias("rules"))).otherwise(F.struct(s["text"].alias("text"), s["rules"].alias("rules")))
    made = once(hit >= 0.25 * F.size(x), lambda on: F.transform(F.filter(x, lambda t, i: ~heads(t, i)), lambda t: once(clean_line(t), lambda s: ended(s, on))))
    names = F.array(*map(F.lit, RULES))
    all_rules = lambda two: F.flatten(F.transform(two, lambda s: F.when(s["text"] == "", F.concat(s["rules"], F.array(F.lit("dropped_lines")))).otherwise(s["rules"])))
    titles = F.size(F.filter(x, heads))
    counted = lambda rules, n_titles: F.map_from_arrays(names, F.transform(names, lambda n: F.when(n == "title", n_titles).otherwise(F.size(F.filter(rules, lambda r: r == n)))))
    kept = lambda two: F.filter(F.transform(two, lambda s: s["text"]), lambda t: t != "")
    # each part is bound before it is used again: a lambda's body is worked out for every element
    both = once(made, lambda two: F.struct(kept(two).alias("lines"), once(titles, lambda n: once(all_rules(two), lambda rules: counted(rules, n))).alias("counts")))
    return df.withColumn("__made", both).withColumn("counts", F.col("__made.counts")).withColumn(lines, F.col("__made.lines")).drop("__made")


def clean_lines(df: DataFrame, lines: str, title: Column) -> DataFrame:
    """df with the array of texts cleaned (see clean_report)."""
    return clean_report(df, lines, title).drop("counts")
