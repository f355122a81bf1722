"""Column expressions over text: tokens, time words, redaction, features, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no information.
STOP = [
    "的", "了", "是", "在", "和", "与", "就", "都", "也", "很", "我们", "你们", "他们", "这个", "那个", "什么", "怎么", "可以", "一个", "不是", "没有", "就是",
]

# Words that name a period, longest forms first.
EXPLICIT_PERIODS = (
    r"\d{1,2}月\d{1,2}[日号]?|\d{1,2}[日号]|\d{1,2}月|[这上本下前那]?周[一二三四五六日天]|昨天|明天|前天|今天|上周|这周|本周|下周"
    "|上个月|这个月|下个月|去年|今年|明年|前年|寒假|暑假|上学期|下学期|上半年|下半年|年底|年初"
)
# Vague time words and the anchors that satisfy them.
FUZZY_PERIODS = [
    (["前几天", "前两天", "前些天", "头几天"], ["前天", "大前天", "前几天", "前两天", "前些天"]),
    (["这两天", "这几天"], ["这两天", "这几天", "昨天", "今天", "前天"]),
    (["那会儿", "那时候", "那天", "当天", "当时"], ["那天", "当天", "当时", "那天晚上", "上周", "这周"]),
    (["后来", "之后", "随后"], ["后来", "之后", "随后", "第二天", "次日"]),
]
# School stages by family.
ERAS = [["高中", "高一", "高二", "高三"], ["大学", "大一", "大二", "大三", "大四"], ["大专"]]


#: A word boundary by ASCII letters, digits and _ alone. What \b takes for a word's character depends on the Java version and is another thing in SQL.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """A pattern whose word boundaries are those of ASCII words."""
    return pattern.replace(r"\b", _EDGE)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Distinct keyword tokens: lower-cased ASCII runs of two or more, bigrams of Chinese runs, single characters of one."""
    s = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(s, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0))
    bigrams = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))),
        )
    )
    return F.array_except(F.array_distinct(F.concat(F.regexp_extract_all(s, F.lit("[a-z0-9_./:-]{2,}"), F.lit(0)), bigrams)), strings(STOP))


def explicit_periods(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EXPLICIT_PERIODS), F.lit(0)))


def fuzzy_anchors(text: Column) -> Column:
    """Anchors that satisfy the vague time words of a text, of all rules that it hits."""
    t = F.coalesce(text, F.lit(""))
    hit = [F.when(F.exists(strings(words), lambda w: F.contains(t, w)), strings(anchors)).otherwise(strings([])) for words, anchors in FUZZY_PERIODS]
    return F.array_distinct(F.flatten(F.array(*hit)))


def fuzzy_words(text: Column) -> Column:
    """The first word that a text has of each rule."""
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.get(F.filter(strings(words), lambda w: F.contains(t, w)), 0) for words, _ in FUZZY_PERIODS]))


def era_words(text: Column) -> Column:
    return F.filter(strings([w for family in ERAS for w in family]), lambda w: F.contains(F.coalesce(text, F.lit("")), w))


def era_anchors(text: Column) -> Column:
    """All stages of the families that a text names."""
    t = F.coalesce(text, F.lit(""))
    hit = [F.when(F.exists(strings(f), lambda w: F.contains(t, w)), strings(f)).otherwise(strings([])) for f in ERAS]
    return F.flatten(F.array(*hit))


def period_literals(text: Column) -> Column:
    return F.array_union(F.array_union(explicit_periods(text), fuzzy_words(text)), era_words(text))


def anchor_periods(text: Column) -> Column:
    """What an anchor's text can stand for; null where it names no period."""
    found = F.array_union(period_literals(text), fuzzy_anchors(text))
    return F.when(F.size(found) > 0, found)


def time_consistent(anchor: Column, text: Column) -> Column:
    """Three-valued: true where fact and anchor agree, false where the fact names another period, else null."""
    own = period_literals(text)
    t = F.coalesce(text, F.lit(""))
    return F.when(anchor.isNull() | (F.size(anchor) == 0), F.lit(None).cast("boolean")).when(F.arrays_overlap(own, anchor) | F.exists(anchor, lambda a: F.contains(t, a)), True).when(F.size(own) > 0, False)


def language(text: Column) -> Column:
    """Chinese from a tenth of Chinese among Chinese and Latin letters on, else English."""
    cjk = F.coalesce(F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]")), F.lit(0))
    latin = F.coalesce(F.regexp_count(text, F.lit("[A-Za-z]")), F.lit(0))
    return F.when((cjk > 0) & (cjk / (cjk + latin) >= 0.10), "Chinese").otherwise("English")


# Patterns of identifiers and what stands in for them, in the order of their use.
IDENTIFIERS = [
    (r"(?U)[\w.+-]+@[\w-]+\.[\w.]+", "***@***"),
    (r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)", "1**********"),
    (r"(?U)@\d{4,}", "@***"),
    (r"(?U)(?<!\d)\d{8,}(?!\d)", "***"),
]

# Forms of an instruction to give one answer.
ANSWER_INSTRUCTION = (
    r"(?i)enclosed in parentheses|only the correct answer|only one correct|single correct|choose the correct|e\.?\s?g\.,?\s*\(X\)"
    r"|只(?:需|要)?回答(?:唯一)?(?:正确)?(?:的)?(?:选项|答案)|仅(?:需|要)?回答(?:唯一)?(?:正确)?(?:的)?(?:选项|答案)"
    r"|选择(?:正确|最合适|最佳)的?(?:选项|答案)|正确答案是"
)
# Marks of feedback that a caller writes back, and the fields in it.
FEEDBACK_MARKS = ["streaming online qa feedback", "streaming-online-feedback"]
FEEDBACK_FIELDS = {
    "qa_id": r'"qa_id"\s*:\s*"([^"]*)"',
    "method": r'"method"\s*:\s*"([^"]*)"',
    "score": r'"score"\s*:\s*(-?[0-9.]+)',
    "question": r'"question"\s*:\s*"((?:[^"\\]|\\.)*)"',
    "predicted": r'"predicted_answer"\s*:\s*"((?:[^"\\]|\\.)*)"',
}
# Words of a question about the whole rather than one fact.
GLOBAL_HINTS = ["总结", "概括", "汇总", "压缩", "回顾", "总的", "整体", "总体", "一路", "这些日子", "这段时间", "都经历", "变化", "综合", "一直以来"]


def redact(text: Column) -> Column:
    """E-mail addresses, mobile numbers, @ with four digits or more, and runs of eight digits or more, in that order; a null text is empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, mask in IDENTIFIERS:
        out = F.regexp_replace(out, pattern, mask)
    return out


def has_answer_instruction(question: Column) -> Column:
    """Whether a question asks for one exact answer; such questions are answered narrowly (precision queries)."""
    return F.coalesce(question, F.lit("")).rlike(ANSWER_INSTRUCTION)


def is_feedback(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.contains(low, F.lit(FEEDBACK_MARKS[0])) | F.contains(low, F.lit(FEEDBACK_MARKS[1]))


def feedback_fields(text: Column, longest: int = 120) -> dict[str, Column]:
    """The five fields of a feedback message, null where one is missing; question and prediction with single spaces, cut."""
    out = {}
    for name, pattern in FEEDBACK_FIELDS.items():
        given = F.coalesce(text, F.lit(""))
        value = F.regexp_extract(given, pattern, 1)
        if name in ("question", "predicted"):
            value = F.left(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(longest))
        out[name] = F.when(given.rlike(pattern), value)
    return out


def asks_for_the_whole(question: Column) -> Column:
    return F.exists(strings(GLOBAL_HINTS), lambda w: F.contains(F.coalesce(question, F.lit("")), w))


def evidence_key(text: Column) -> Column:
    """Text without white space and punctuation, as evidence is compared."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{P}]+", "")


def valid_evidence(evidence: Column, conversation: Column) -> Column:
    e = evidence_key(evidence)
    return F.length(e).between(4, 300) & F.contains(evidence_key(conversation), e)


def date_of(ms: Column) -> Column:
    """Unix milliseconds as yyyy-MM-dd of the session's time zone; null unless positive."""
    return F.when(ms > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"))


def story_id(text: Column) -> Column:
    return F.concat(F.lit("story:"), F.left(F.sha1(text), F.lit(10)))


def truncate(text: Column, limit: int) -> Column:
    """Cut at a sentence end within the last 200 characters, else hard; the ellipsis counts."""
    cut = F.left(text, F.lit(limit))
    end = F.length(F.regexp_extract(cut, r"(?s)^(.*[。！？；\n.!?;])", 1))
    whole = F.length(text) <= limit
    return F.when(whole, text).when((end - 1 >= max(0, limit - 200)) & (end < limit), F.concat(F.rtrim(F.left(cut, end)), F.lit("…"))).otherwise(F.concat(F.left(F.rtrim(cut), F.lit(limit - 1)), F.lit("…")))


def bigram_cover(text: Column, whole: Column) -> Column:
    """Share of a text's character bigrams that another text has; null for texts of under two characters."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: t.substr(i, F.lit(2))))
    own = grams(text)
    return F.when(F.length(text) >= 2, F.size(F.array_intersect(own, grams(whole))) / F.size(own))


def space_dirname(user_id: Column) -> Column:
    """A folder name: letters, digits, _ and - as they are, other UTF-8 bytes percent-escaped; so is the first byte of a reserved name."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(user_id), F.lit(1))), lambda i: F.substring(F.hex(user_id.cast("binary")), (i - 1) * 2 + 1, F.lit(2)))
    plain = F.transform(bytes_, lambda h: F.when(F.decode(F.unhex(h), "ISO-8859-1").rlike("^[A-Za-z0-9_-]$"), F.decode(F.unhex(h), "ISO-8859-1")).otherwise(F.concat(F.lit("%"), h)))
    joined = F.array_join(plain, "")
    reserved = F.upper(joined).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(reserved, F.concat(F.lit("%"), F.get(bytes_, 0), F.substring(joined, 2, 1 << 30))).otherwise(joined)


def parse_probability(answer: Column) -> Column:
    """The first number of an answer, within 0 and 1; null where there is none."""
    p = F.regexp_extract(answer, r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(p != "", F.least(F.greatest(p.cast("double"), F.lit(0.0)), F.lit(1.0)))
