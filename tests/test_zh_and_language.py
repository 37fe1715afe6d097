import pytest
from pyspark.sql import functions as F

from veilframe.functions import language as L
from veilframe.operators.zh_address import merge_text
from veilframe.plans.pipelines import entity_spans


def seeds(text, *parts, kind="PHYSICAL_ADDRESS"):
    return [{"start": text.index(p), "end": text.index(p) + len(p), "entity_type": kind, "score": 0.98, "seq": 1} for p in parts]


@pytest.mark.parametrize(
    "text, parts, want",
    [
        ("我的家庭住址：成都市高新区天府大道100号", ("成都市", "100号"), ["成都市高新区天府大道100号"]),
        ("上海市浦东新区银城中路501号陆家嘴金融广场18层", ("上海市",), ["上海市浦东新区银城中路501号陆家嘴金融广场18层"]),
        ("北京市朝阳区建国路 88 号", ("北京市", "88 号"), ["北京市朝阳区建国路 88 号"]),
        ("珠海市香洲路明月花园12栋508房", ("珠海市",), ["珠海市香洲路明月花园12栋508房"]),
        ("住在广州市越秀区北京西路黄埔花园13栋806房我的表哥在南昌市中山路2348号锦江花园6栋1403房", ("广州市", "南昌市"), ["广州市越秀区北京西路黄埔花园13栋806房", "南昌市中山路2348号锦江花园6栋1403房"]),
        ("上海市浦东新区", ("上海市",), []),
        ("中国浙江省", ("中国浙江省",), []),
        ("台北市大安區和平東路三段20巷5弄7號3樓", ("台北市",), ["台北市大安區和平東路三段20巷5弄7號3樓"]),
    ],
)
def test_addresses(text, parts, want):
    assert [text[x["start"] : x["end"]] for x in merge_text(text, seeds(text, *parts))] == want


def test_recombination():
    text = "他在北京市朝阳区建国路88号国贸中心5层工作"
    org = seeds(text, "国贸中心", kind="ORGANIZATION")
    name = seeds(text, "他", kind="USER_NAME")
    got = merge_text(text, name + seeds(text, "北京市") + org)
    assert [(x["entity_type"], text[x["start"] : x["end"]]) for x in got] == [("USER_NAME", "他"), ("PHYSICAL_ADDRESS", "北京市朝阳区建国路88号国贸中心5层")]
    assert merge_text("", []) == []


def test_gate(spark):
    text = "地址：成都市高新区天府大道100号"
    item = ("B-LOC", 0.98, 0, "成都市", 3, 6)
    df = spark.createDataFrame([(text, "zh", [item]), (text, "en", [item]), (None, "zh", None)], "text string, language string, ner array<struct<entity:string,score:float,index:int,word:string,start:int,end:int>>")
    got = [[(x["start"], x["end"]) for x in r["entity_spans"]] if r["entity_spans"] else [] for r in entity_spans(df).collect()]
    assert got == [[(3, 17)], [(3, 6)], []]


def test_language(spark):
    df = spark.createDataFrame([("软件开发后端互联网",), ("軟體開發後端",), ("hello there",), ("12 !",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(L.detect_language(F.col("t"))).collect()]
    assert [(r["lang"], r["script"]) for r in got] == [("zh", "Hans"), ("zh", "Hant"), ("en", None), ("other", None), ("other", None), ("other", None)]
    assert [r[0] for r in df.select(L.select_language(F.col("t"), F.lit("auto"))).collect()] == ["zh-CN", "zh-TW", "en", "en", "en", "en"]
    assert [r[0] for r in df.select(L.rules_language(F.col("t"))).collect()] == ["zh", "zh", "en", "en", "en", "en"]
    tags = spark.createDataFrame([("zh-TW",), ("zh-Hans",), ("ZH",), ("de-AT",), (None,)], "t string")
    rows = tags.select(L.language_id(F.col("t")), L.is_zh_family(F.col("t")), L.is_zh_simplified(F.col("t")), L.ner_model(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(6, True, False, "zh"), (8, True, True, "zh"), (4, True, True, "zh"), (11, False, False, "en"), (0, False, False, "en")]


def test_statistical_language(spark):
    texts = ["the letter is for you", "der Brief ist für dich", "la lettre est pour vous", "las cartas son para el rey", "il libro della zia", "os livros não estão", "het huis van de man", "привет всем", "你好世界", "これはペンです", "안녕하세요", "12 !", "", None, "Zxqv"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(L.statistical_language(F.col("t"))).collect()] == ["en", "de", "fr", "es", "it", "pt", "nl", "ru", "zh", "ja", "ko", "en", "en", "en", "en"]
    df = spark.createDataFrame([("东",), ("東",), ("x",), ("东東",), (None,)], "t string")
    assert [r[0] for r in df.select(L.script_by_conversion(F.col("t"))).collect()] == ["Hans", "Hant", "Hans", "Hans", "Hans"]
