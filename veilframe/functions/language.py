"""Language and script tests on a text column. Null and empty texts count as ratio 0 and language 'other'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and words that occur in one script of Chinese only.
SIMPLIFIED_CHARS = "后发台里复面余划钟观厂广圆国东乐云内两丢为价众优冲况刘师于亏仅从兴举义乌专"
TRADITIONAL_CHARS = "後發臺裡複麵餘劃鐘觀廠廣圓國東樂雲內兩丟為價眾優衝況劉師於虧僅從興舉義烏專"
SIMPLIFIED_WORDS = ("开发", "软件", "后端", "互联网", "应用", "运维", "里程", "联系", "台阶", "复用")
TRADITIONAL_WORDS = ("開發", "軟體", "後端", "網際網路", "應用", "運維", "聯繫", "臺階", "複用")

# Numeric ids of language tags; zh tags are exact, others go by prefix.
TAG_PREFIXES = (("en", 1), ("ja", 2), ("ko", 3), ("fr", 10), ("de", 11), ("ru", 12), ("es", 13), ("it", 14), ("ar", 15), ("pt", 16))
ZH_TAGS = (("zh", 4), ("zh-cn", 5), ("zh-tw", 6), ("zh-hk", 7), ("zh-hans", 8), ("zh-hant", 9))

HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, F.lit(f"[^{chars}]"), F.lit("")))


def _ratio(text: Column, chars: str) -> Column:
    return F.when(F.length(text) > 0, _count(text, chars) / F.length(text)).otherwise(0.0)


def han_ratio(text: Column) -> Column:
    return _ratio(text, HAN)


def latin_ratio(text: Column) -> Column:
    return _ratio(text, "A-Za-z")


def quick_language(text: Column) -> Column:
    """zh from 30 % Han on, else en from 50 % Latin on, else other."""
    return F.when(han_ratio(text) >= 0.3, "zh").when(latin_ratio(text) >= 0.5, "en").otherwise("other")


def script_scores(text: Column) -> Column:
    """struct<simplified, traditional>: one point a character, two a listed word that occurs."""
    text = F.coalesce(text, F.lit(""))

    def score(chars, words):
        return _count(text, chars) + sum((F.when(F.contains(text, F.lit(w)), 2).otherwise(0) for w in words), F.lit(0))

    return F.struct(score(SIMPLIFIED_CHARS, SIMPLIFIED_WORDS).alias("simplified"), score(TRADITIONAL_CHARS, TRADITIONAL_WORDS).alias("traditional"))


def quick_script(text: Column) -> Column:
    s = script_scores(text)
    d = s["simplified"] - s["traditional"]
    return F.when(d >= 2, "Hans").when(d <= -2, "Hant")


def detect_language(text: Column) -> Column:
    """struct<lang, script, confidence, method>. Without a converter an undecided zh script counts as Hans."""
    lang, script = quick_language(text), quick_script(text)
    zh = lang == "zh"
    return F.struct(
        lang.alias("lang"),
        F.when(zh, F.coalesce(script, F.lit("Hans"))).alias("script"),
        F.when(zh & script.isNotNull(), 0.8).when(zh, 0.95).when(lang == "en", 0.9).otherwise(0.6).alias("confidence"),
        F.when(zh & script.isNull(), "default").otherwise("heuristic").alias("method"),
    )


def language_tag(text: Column) -> Column:
    """zh-Hans, zh-Hant, en, or en where nothing is recognised."""
    d = detect_language(text)
    return F.when(d["lang"] == "zh", F.concat(F.lit("zh-"), d["script"])).otherwise("en")


def select_language(text: Column, language: Column) -> Column:
    """The given tag, unless it is null, empty or auto: then zh-TW, zh-CN or what is detected."""
    d = detect_language(text)
    own = F.when(d["lang"] == "zh", F.when(d["script"] == "Hant", "zh-TW").otherwise("zh-CN")).otherwise("en")
    return F.when(language.isNull() | (language == "") | (F.lower(language) == "auto"), own).otherwise(language)


def language_id(tag: Column) -> Column:
    tag = F.lower(F.coalesce(tag, F.lit("")))
    out = F.lit(0)
    for name, n in TAG_PREFIXES:
        out = F.when(tag.startswith(name), n).otherwise(out)
    for name, n in ZH_TAGS:
        out = F.when(tag == name, n).otherwise(out)
    return out


def is_zh_family(tag: Column) -> Column:
    return language_id(tag).between(4, 9)


def is_zh_simplified(tag: Column) -> Column:
    tag = F.lower(F.coalesce(tag, F.lit("")))
    return (tag == "zh") | (tag.startswith("zh-") & ~tag.rlike("hant|tw|hk"))


def ner_model(tag: Column) -> Column:
    """Which recognizer serves a tag: zh or en."""
    return F.when(is_zh_family(tag), "zh").otherwise("en")


# Frequent function words that mark a language, most of them in one language only.
FUNCTION_WORDS = {
    "en": "the and of is was are with for this that have you not they from which would there their what".split(),
    "de": "der die das und ist nicht ich wir sie ein eine mit auf für von dem den wird auch sind".split(),
    "fr": "le les des est et une dans pour que qui vous nous sur pas avec sont être cette ce du".split(),
    "es": "el los las una por para que con del está pero como más muy su este hay desde son lo".split(),
    "it": "il gli della che non sono è di una per questo nella anche più alla con dei lo ha suo".split(),
    "pt": "os uma não para com do da em são está mais por como dos foi seu sua ao você isso".split(),
    "nl": "het een van niet dat zijn voor met op aan ook er maar naar heeft wordt deze bij hij de".split(),
}
# Scripts that are counted, and those that stand for one language.
SCRIPTS = {"latin": r"A-Za-z\x{C0}-\x{24F}", "han": HAN, "kana": r"\x{3041}-\x{30FF}", "hangul": r"\x{AC00}-\x{D7AF}", "cyrillic": r"\x{400}-\x{4FF}", "arabic": r"\x{600}-\x{6FF}", "greek": r"\x{370}-\x{3FF}"}
SCRIPT_LANGUAGES = {"han": "zh", "hangul": "ko", "cyrillic": "ru", "arabic": "ar", "greek": "el"}


def statistical_language(text: Column) -> Column:
    """A language by counts: of letters by script, and for Latin letters of frequent function words.

    Kana among the characters is Japanese; a script with more than half of the letters gives its
    language; else the language with most function words (ties in the order of the table). Texts
    without letters or such words, null and empty ones are English.
    """
    given = F.coalesce(text, F.lit(""))

    def decide(n):
        letters = sum((n[name] for name in SCRIPTS), F.lit(0))
        out = F.when(letters == 0, "en").when((n["kana"] > 0) & (n["kana"] * 10 >= n["han"] + n["kana"]), "ja")
        for name, lang in SCRIPT_LANGUAGES.items():
            out = out.when(n[name] * 2 > letters, lang)
        most = F.greatest(*[n[lang] for lang in FUNCTION_WORDS])
        for lang in FUNCTION_WORDS:
            out = out.when((most > 0) & (n[lang] == most), lang)
        return out.otherwise("en")

    def count(words):
        def hits_of(own):
            return F.size(F.filter(words, lambda w: w.isin(*own)))

        hits = [hits_of(own).alias(lang) for lang, own in FUNCTION_WORDS.items()]
        return let(F.struct(*hits, *[_count(given, chars).alias(name) for name, chars in SCRIPTS.items()]), decide)

    return let(F.split(F.lower(given), r"[^\p{L}]+"), count)


def convert_script(text: Column, given: str = SIMPLIFIED_CHARS, wanted: str = TRADITIONAL_CHARS) -> Column:
    """Characters of one script of Chinese as those of the other, one for one, so offsets stay. Pass longer tables for full coverage."""
    return F.translate(text, given, wanted)


def script_by_conversion(text: Column, simplified: str = SIMPLIFIED_CHARS, traditional: str = TRADITIONAL_CHARS) -> Column:
    """Hant if only the conversion to simplified changes the text, else Hans."""
    to_traditional, to_simplified = convert_script(text, simplified, traditional), convert_script(text, traditional, simplified)
    return F.when((to_traditional == text) & (to_simplified != text), "Hant").otherwise("Hans")


def rules_language(text: Column) -> Column:
    """Rules profile: from ten letters of both scripts on, 80 % of one script decides; else the quick test; blank is en.

    Looks at what follows an instruction prefix, if there is one, else at the whole text.
    """
    from veilframe.operators.spans import instruction_prefix_end

    rest = F.substring(text, instruction_prefix_end(text) + 1, F.length(text))
    han, latin = _count(rest, r"\x{4E00}-\x{9FFF}"), _count(rest, "A-Za-z")
    both = (han + latin >= 10) & (han > 0) & (latin > 0)
    quick = quick_language(rest)
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "en")
        .when(both & (latin / (han + latin) >= 0.8), "en")
        .when(both & (han / (han + latin) >= 0.8), "zh")
        .otherwise(F.when(quick == "zh", "zh").otherwise("en"))
    )
