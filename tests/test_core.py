"""Core profile: patterns, overlaps, masking, restoring."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.config import MaskConfig, PatternSpec
from veilframe.operators import mask as M
from veilframe.operators import ner as N
from veilframe.operators import spans as S
from veilframe.operators.lines import mask_lines, restore_lines
from veilframe.operators.meta_codec import decode, encode, map_from_json64, map_to_json64, meta_from_base64, meta_to_base64
from veilframe.operators.restore import placeholder_map, restore, restore_lenient, restore_text
from veilframe.patterns import CORE, by_name, with_extra
from veilframe.plans.pipelines import entity_spans, external, round_trip

TEXT = "Mail k.lee+9@post.test or open https://shop.example/a?b=1 and ask for Mia Roth."


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def masked(spark, text, cfg=None, **how):
    return M.mask(frame(spark, text), cfg=cfg or MaskConfig.all(), **how).first()["masked_text"]


def test_exact_spans(spark):
    ner = F.array(F.struct(F.lit(70).alias("start"), F.lit(78).alias("end"), F.lit("USER_NAME").alias("entity_type"), F.lit(0.98).alias("score"), F.lit(100).alias("seq")))
    rows = M.pii_spans(frame(spark, TEXT), cfg=MaskConfig.all(), ner=ner).first()["spans"]
    assert [tuple(r) for r in rows] == [(1, "EMAIL_ADDRESS", 5, 22, 0.9), (2, "URL_ADDRESS", 31, 57, 0.8), (3, "USER_NAME", 70, 78, 0.98)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("password: hunter2", "password: hunter2"),
        ("pass: hunter2", "pass: __PII_PASSWORD_1__"),
        ("4111111111111111", "__PII_PHONE_NUMBER_1__"),
        ("code 12345 and verification code: 9F4T2A", "code __PII_VERIFICATION_CODE_1__ and verification code: __PII_VERIFICATION_CODE_2__"),
        ("码12345码", "码12345码"),
        ("seed phrase: a b c d e f g h i j k l m", "seed phrase: a b c d e f g h i j k l m"),
        ("seed: a b c d e f g h i j k l", "__PII_RANDOM_SEED_1__"),
        ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "__PII_PRIVATE_KEY_1__"),
        ("-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----"),
        ("k " + "ab" * 32, "k __PII_PRIVATE_KEY_1__"),
        ("🙂 mail x@y.io 🙂", "🙂 mail __PII_EMAIL_ADDRESS_1__ 🙂"),
        ("", ""),
        (None, None),
    ],
)
def test_masking(spark, text, want):
    assert masked(spark, text) == want


def test_disabled_span_keeps_its_place(spark):
    assert masked(spark, "4111111111111111", MaskConfig.all().disable("PHONE_NUMBER")) == "4111111111111111"
    assert masked(spark, "x@y.io", MaskConfig.from_dict({"maskEmail": True, "maskAll": False})) == "x@y.io"
    assert "maskAddress" not in MaskConfig().switches
    assert MaskConfig.from_dict({"maskEmail": False}).switches == MaskConfig().disable("maskEmail").switches


def test_round_trip_batch(spark):
    texts = [
        "Parcels for Mia Roth go to 7 Mill Lane; write to mia.roth@post.test or ring +1-202-555-0188.",
        "请把货单发到 lan@post.test，或者打13812345678找兰兰。",
        "收件: 兰兰\n手机: +86 139-0000-0000\r\n编号 10001",
        "",
        None,
        "x" * 200_000 + " a@b.io",
    ]
    rows = round_trip(frame(spark, *texts), cfg=MaskConfig.all()).orderBy("id").collect()
    assert [r["restored_text"] for r in rows] == texts
    assert "@" not in rows[0]["masked_text"] and "0188" not in rows[0]["masked_text"] and "13812345678" not in rows[1]["masked_text"]
    up = round_trip(frame(spark, *texts), transform=external(lambda xs: ["> " + x for x in xs]), cfg=MaskConfig.all()).orderBy("id").first()
    assert up["restored_text"] == "> " + texts[0]


def test_clashing_columns_and_empty_table(spark):
    df = frame(spark, "a@b.io").withColumn("masked_text", F.lit(1)).withColumn("spans", F.lit("x"))
    assert M.mask(df).first()["masked_text"] == "__PII_EMAIL_ADDRESS_1__"
    assert M.mask(df.limit(0)).count() == 0
    assert M.pii_entities(df, "id").first()["entity_text"] == "a@b.io"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1@.: -\n_é码🙂https/", max_size=60), min_size=1, max_size=8))
def test_restore_inverts_mask(spark, texts):
    rows = restore(M.mask(frame(spark, *texts), cfg=MaskConfig.all())).orderBy("id").collect()
    assert [r["restored_text"] for r in rows] == texts


def test_greedy_overlap_against_brute_force(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(40):
        cases.append([(a := rng.randrange(30), a + rng.randrange(1, 12), "T", rng.choice([0.5, 0.6, 0.9]), i) for i in range(rng.randrange(8))])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"id int, spans {S.NO_SPANS}")
    got = [[tuple(x) for x in r[0]] for r in df.orderBy("id").select(S.resolve_overlaps(F.col("spans"))).collect()]
    want = []
    for c in cases:
        taken = []
        for x in sorted(c, key=lambda x: (-x[3], x[0] - x[1], x[0], x[4])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in taken):
                taken.append(x)
        want.append(sorted(taken))
    assert got == want


def test_filters(spark):
    df = spark.createDataFrame([([(0, 2, "A", 0.6, 0), (0, 2, "B", 0.7, 1), (3, 4, "A", 0.9, 2)], "de")], f"s {S.NO_SPANS}, lang string")
    s = F.col("s")
    rules = [("all", "*", 0.65, False), ("de", "A", None, True)]
    pick = lambda c: [(x["entity_type"], x["start"]) for x in df.select(c).first()[0]]
    assert pick(S.min_score_filter(s, rules, F.col("lang"))) == [("B", 0)]
    assert pick(S.min_score_filter(s, rules, F.lit("en"))) == [("B", 0), ("A", 3)]
    assert pick(S.whitelist_filter(s, {"all": ["A"], "de": ["B"]}, F.col("lang"))) == [("A", 0), ("B", 0), ("A", 3)]
    assert pick(S.whitelist_filter(s, {})) == [("A", 0), ("B", 0), ("A", 3)]
    assert pick(S.merge_spans(s, S.no_spans())) == [("B", 0), ("A", 3)]
    assert pick(S.merge_spans(s, S.no_spans(), blacklist=["B"], threshold=0.7)) == [("A", 3)]


def test_instruction_prefix(spark):
    df = frame(spark, "请翻译如下：a@b.io", "translate a@b.io: c@d.io", "a@b.io: c", None)
    got = [r[0] for r in df.orderBy("id").select(F.size(S.drop_prefix_spans(S.all_spans(F.col("text"), CORE), F.col("text")))).collect()]
    assert got == [1, 1, 1, 0]


def test_restore_edges(spark):
    meta = [(1, "EMAIL_ADDRESS", "a@b.io", 0.9), (2, "EMAIL_ADDRESS", "__PII_EMAIL_ADDRESS_1__", 0.9), (3, "PASSWORD", "gone", 0.9)]
    df = spark.createDataFrame([("__PII_EMAIL_ADDRESS_2__ __PII_EMAIL_ADDRESS_1__ __PII_EMAIL_ADDRESS_1__", meta), ("", []), (None, None)], f"t string, m array<{M.META}>")
    got = [r[0] for r in df.select(restore_text(F.col("t"), F.col("m"))).collect()]
    assert got == ["__PII_EMAIL_ADDRESS_1__ a@b.io __PII_EMAIL_ADDRESS_1__", "", None]


def test_lenient_restore(spark):
    m = {"__PII_EMAIL_ADDRESS_1__": "a$1@b.io", "__PII_PHONE_NUMBER_2__": r"\d5"}
    df = spark.createDataFrame([("x __PII_EMAIL_ADDRESS_1__ y pii_email_address_1 z PII_PHONE_2_ q _PII_X_9__ A$1@B.IO1__", m), (None, m), ("same", None)], "t string, m map<string,string>")
    got = [r[0] for r in df.select(restore_lenient(F.col("t"), F.col("m"))).collect()]
    assert got == [r"x a$1@b.io y a$1@b.io z \d5 q _PII_X_9__ a$1@b.io", None, "same"]


def test_lines(spark):
    rows = restore_lines(mask_lines(frame(spark, "a@b.io\r\n\nc@d.io", None, ""), cfg=MaskConfig.all())).orderBy("id").collect()
    assert rows[0]["masked_text"] == "__PII_EMAIL_ADDRESS_1__\n\n__PII_EMAIL_ADDRESS_1__"
    assert [r["restored_text"] for r in rows] == ["a@b.io\n\nc@d.io", None, ""]


def test_codecs(spark):
    meta = [{"entity_id": 1, "entity_type": "EMAIL_ADDRESS", "matched_text": "é@b.io", "score": 0.9}, {"entity_id": 2, "entity_type": "PASSWORD", "matched_text": "", "score": 0.6}]
    assert decode(encode(meta)) == meta and decode(encode([])) == [] and decode(b"junk") == [] and decode(None) == []
    rows = M.mask(frame(spark, "a@b.io 12345"), cfg=MaskConfig.all())
    back = rows.select("mask_meta", meta_from_base64(meta_to_base64(F.col("mask_meta"))).alias("b")).first()
    assert [(x[0], x[1], x[2]) for x in back["b"]] == [(x[0], x[1], x[2]) for x in back["mask_meta"]]
    maps = rows.select(map_from_json64(map_to_json64(placeholder_map(F.col("mask_meta")))), map_from_json64(F.lit("%%")), map_from_json64(F.base64(F.lit("no json")))).first()
    assert maps[0] == {"__PII_EMAIL_ADDRESS_1__": "a@b.io", "__PII_VERIFICATION_CODE_2__": "12345"} and maps[1] == {} and maps[2] == {}


def test_anonymize(spark):
    ops = {"EMAIL_ADDRESS": {"type": "mask", "chars_to_mask": 2, "masking_char": "#"}, "DEFAULT": {"type": "redact"}}
    assert M.anonymize(frame(spark, "a@b.io 12345!"), ops, cfg=MaskConfig.all()).first()["anonymized_text"] == "##b.io !"


def test_rules_profile(spark):
    cfg = MaskConfig.from_dict({"maskAll": True}, "rules")
    assert masked(spark, "host 10.0.0.7 id 110105200012310020", cfg, profile="rules") == "host __PII_IP_ADDRESS_1__ id __PII_CN_ID_2__"
    assert masked(spark, "host 10.0.0.7", MaskConfig(), profile="rules") == "host 10.0.0.7"
    fr = frame(spark, "appelez 01 99 00 39 99")
    assert M.mask(fr, cfg=cfg, profile="rules", language=F.lit("fr")).first()["masked_text"] == "appelez __PII_PHONE_NUMBER_1__"


ITEM = "array<struct<entity:string,score:float,index:int,word:string,start:int,end:int>>"


def items(spark, rows, text="x" * 40):
    return spark.createDataFrame([(text, [(e, s, i, "w", a, b) for i, (e, s, a, b) in enumerate(rows)])], f"text string, ner {ITEM}")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("I-PER", 0.9, 0, 2)], []),
        ([("B-PER", 0.9, 0, 2), ("I-PER", 0.8, 2, 4), ("E-PER", 0.7, 4, 6)], [("USER_NAME", 0, 6, 0.775)]),
        ([("B-PER", 0.9, 0, 2), ("B-PER", 0.9, 2, 4)], [("USER_NAME", 0, 2, 0.9), ("USER_NAME", 2, 4, 0.9)]),
        ([("B-PER", 0.9, 0, 2), ("I-LOC", 0.9, 2, 4), ("I-PER", 0.9, 4, 5)], [("USER_NAME", 0, 2, 0.9)]),
        ([("PER", 0.9, 0, 2), ("S-ORG", 0.9, 3, 5)], [("ORGANIZATION", 3, 5, 0.9)]),
        ([], []),
    ],
)
def test_bio(spark, rows, want):
    got = items(spark, rows).select(N.bio_spans(F.col("ner"), F.col("text"))).first()[0]
    assert [(x["entity_type"], x["start"], x["end"], round(x["score"], 4)) for x in got] == want


def test_subword_merge_and_alignment(spark):
    got = items(spark, [("B-PER", 0.9, 0, 2), ("I-PER", 0.6, 2, 4), ("I-PER", 0.6, 5, 6)]).select(N.merge_subwords(F.col("ner"))).first()[0]
    assert [(x["entity"], x["word"], x["start"], x["end"], round(x["score"], 3)) for x in got] == [("B-PER", "ww", 0, 4, 0.75), ("I-PER", "w", 5, 6, 0.6)]
    assert N.align_tokens("Zoë met Ann-Lee", ["zoe", "met", "Ann", "##Lee", "nope"]) == [(0, 3), (4, 7), (8, 11), (12, 15), (15, 15)]
    df = N.with_model(frame(spark, "Ann", None), lambda texts, langs: [[("B-PER", 0.9, 0, t, 0, len(t)), ("O", 0.1, 1, "", 0, 0)] for t in texts])
    assert [len(r["ner"]) for r in df.collect()] == [1, 1]


@pytest.mark.parametrize(
    "name, text, value",
    [
        ("phone", "tel ３３６７-０１６６-２５８０ ok", "３３６７-０１６６-２５８０"),
        ("bank", "card ４１１１１１１１１１１１１１１１ ok", "４１１１１１１１１１１１１１１１"),
        ("vcode", "code １２３４５６ ok", "１２３４５６"),
        ("password", "paſſword: hunter2", "hunter2"),
        ("rule_street", "at 12 Long Hill\u00a0Road\u00a0now", "12 Long Hill\u00a0Road"),
        ("rule_street", "at 12 Long Hill\u3000Road now", "12 Long Hill\u3000Road"),
        ("rule_user_name", "name\u00a0: Jo Doe", "name\u00a0: Jo Doe"),
        ("rule_cn_phone", "tel 13４００００１２３４ ok", "13４００００１２３４"),
        ("rule_bank", "card ６２２２ ０２１２ ３４５６ ７８９０ 123", "６２２２ ０２１２ ３４５６ ７８９０ 123"),
        ("rule_url", "see HTTP://LOCALHOST/A now", "HTTP://LOCALHOST/A"),
    ],
)
def test_hint_sees_what_the_pattern_sees(spark, name, text, value):
    got = frame(spark, text).select(S.find_spans(F.col("text"), by_name(name)).alias("s")).first()["s"]
    assert [text[x["start"] : x["end"]] for x in got] == [value]


def test_patterns_run_once_a_row(spark):
    df = frame(spark, "a@b.io 12345", None)
    long = [p for p in (mask_lines(df, cfg=MaskConfig.all()), M.mask(df, cfg=MaskConfig.all()), M.pii_entities(df, "id", cfg=MaskConfig.all()))]
    for x in long:
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == sum(p.score >= 0.5 for p in CORE)


def test_addresses_are_read_once(spark):
    rows = [("成都市天府大道100号", "zh", [("B-LOC", 0.9, 0, "成都市", 0, 3)])]
    df = spark.createDataFrame(rows, "text string, language string, ner array<struct<entity:string,score:float,index:int,word:string,start:int,end:int>>")
    plan = S.explode_rows(entity_spans(df), "entity_spans", "s", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_text_with_very_many_spans(spark):
    text = " ".join(f"é{i} code {10000 + i} a{i}@b.io 😀" for i in range(6000))
    row = M.mask(frame(spark, text), cfg=MaskConfig.all()).first()
    meta = {f"__PII_{m['entity_type']}_{m['entity_id']}__": m["matched_text"] for m in row["mask_meta"]}
    assert len(meta) >= 12_000 and re.sub(r"__PII_[A-Z_]+_[0-9]+__", lambda m: meta[m.group()], row["masked_text"]) == text


def test_many_overlapping_spans(spark):
    rng = random.Random(5)
    given = []
    for n in range(700):
        start = rng.randrange(4000)
        given.append((start, start + rng.randrange(1, 9), "T", rng.choice([0.5, 0.7, 0.9]), n))
    taken = []
    for x in sorted(given, key=lambda x: (-x[3], x[0] - x[1], x[0], x[4])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in taken):
            taken.append(x)
    df = spark.createDataFrame([(given,)], f"s array<{S.SPAN}>")
    assert [tuple(x) for x in df.select(S.resolve_overlaps(F.col("s"))).first()[0]] == sorted(taken)


def test_custom_patterns(spark):
    house = PatternSpec("order", "ORGANIZATION", r"#\d+", 0.6, validate=lambda v: F.when(F.length(v) > 4, 0.1).when(v == "#1", 0.97))
    again = PatternSpec("mine", "URL_ADDRESS", by_name("url").value, 0.9)
    assert [p.name for p in with_extra(CORE, [house, again])][:3] == ["email", "order", "phone"] and len(with_extra(CORE, [house, again])) == len(CORE) + 1
    rows = M.pii_entities(frame(spark, "see #1 and #12 and #12345678 and http://a.test/x"), "id", cfg=MaskConfig.all(), extra=[house, again]).orderBy("start").collect()
    assert [(r["entity_text"], r["score"]) for r in rows] == [("#1", 0.97), ("#12", 0.6), ("12345678", 0.5), ("http://a.test/x", 0.8)]


def test_fallback_and_engine_language(spark):
    df = frame(spark, "translate the following: ring 13800138000, IP 10.0.200.7", "13800138000: translate this")
    cfg = MaskConfig.from_dict({"maskAll": True}, "rules")
    scores = [[m["score"] for m in r["mask_meta"]] for r in M.mask(df, cfg=cfg, profile="rules", fallback=True).orderBy("id").collect()]
    assert scores == [[0.9, 0.9], [0.9]]
    got = [r[0] for r in spark.createDataFrame([("FR",), ("de",), (None,)], "l string").select(M.engine_language(F.col("l"))).collect()]
    assert got == ["fr", "en", "en"]


def test_operators_of_anonymize(spark):
    ops = {"EMAIL_ADDRESS": {"type": "mask", "chars_to_mask": 3, "from_end": True}, "VERIFICATION_CODE": {"type": "keep"}, "DEFAULT": {"type": "replace", "new_value": "it's"}}
    got = M.anonymize(frame(spark, "a@b.io 12345 http://x.test", None), ops, cfg=MaskConfig.all()).orderBy("id").collect()
    assert [r["anonymized_text"] for r in got] == ["a@b*** 12345 it's", None]


def test_script_conversion_around_a_model(spark):
    seen = spark.sparkContext.accumulator(0)

    def infer(texts, langs):
        seen.add(sum("東" in t for t in texts))
        return [[("B-LOC", 0.9, 0, t[:2], 0, 2)] for t in texts]

    df = spark.createDataFrame([("东门", "zh-CN"), ("東門", "zh-TW"), ("东门", "en")], "text string, language string")
    assert [r["ner"][0]["word"] for r in N.with_model(df, infer, language="language").collect()] == ["东门", "東門", "东门"] and seen.value == 2


def test_python_functions_over_results(spark):
    """A function that reads one result only, so that nothing else keeps the result's expression where it is."""
    df = frame(spark, "a@b.io 12345", None)
    longer = external(lambda xs: [x + "!" for x in xs])
    assert [r[0] for r in M.mask(df, cfg=MaskConfig.all()).select(longer("masked_text")).collect()] == ["__PII_EMAIL_ADDRESS_1__ __PII_VERIFICATION_CODE_2__!", "!"]
    assert [r[0] for r in mask_lines(df, cfg=MaskConfig.all()).select(longer("masked_text")).collect()][1] == "!"
    assert [r[0] for r in M.pii_spans(df, cfg=MaskConfig.all()).select(longer(F.to_json("spans"))).collect()][1] == "[]!"
    assert [r[0] for r in M.anonymize(df, {}, cfg=MaskConfig.all()).select(longer("anonymized_text")).collect()][0] == "<EMAIL_ADDRESS> <VERIFICATION_CODE>!"
