"""Masking: placeholders, splice, metadata.

``mask`` adds ``masked_text`` and ``mask_meta`` to a DataFrame; existing columns of
those names are replaced, all other columns are kept. Null text gives null masked
text and empty metadata; empty text stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.config import MaskConfig
from veilframe.operators import spans as S
from veilframe.patterns import FALLBACK, PROFILES, with_extra

META = "struct<entity_id:int,entity_type:string,matched_text:string,score:double>"
META_TYPE = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("entity_id", T.IntegerType()), ("entity_type", T.StringType()), ("matched_text", T.StringType()), ("score", T.DoubleType()))])
)


def enabled(spans: Column, cfg: MaskConfig) -> Column:
    if cfg.everything is not None:
        return spans if cfg.everything else S.no_spans()
    types = cfg.enabled_types()
    return F.filter(spans, lambda s: s["entity_type"].isin(*types)) if types else S.no_spans()


def detect(
    text: Column,
    cfg: MaskConfig,
    profile: str = "core",
    ner: Column | None = None,
    language: Column | None = None,
    min_score: float = 0.5,
    extra=(),
    fallback: bool = False,
) -> Column:
    """The spans that get placeholders.

    core: a switched-off type still takes its range and keeps its text, so the switch
    comes after overlap resolution. rules: the switch comes first, then overlaps; a language
    without rules of its own is read as English, and ``fallback`` adds the language-free
    pass of a few patterns with high scores. ``extra`` are further patterns of the caller.
    """
    specs = with_extra(PROFILES[profile], extra)
    if profile == "core":
        found = S.valid(S.all_spans(text, specs, ner, language, min_score), text, min_score)
        return enabled(S.resolve_overlaps(found), cfg)
    language = engine_language(language)
    found = S.drop_prefix_spans(S.valid(S.all_spans(text, specs, ner, language, 0.0), text, 0.0), text)
    found = S.min_score_filter(found, RULE_FILTERS, language)
    if fallback:
        found = F.concat(found, S.all_spans(text, FALLBACK, min_score=0.0))
    found = S.whitelist_filter(found, {"all": RULE_WHITELIST})
    return S.resolve_overlaps(enabled(found, cfg))


RULE_LANGUAGES = ("en", "zh", "fr")


def engine_language(language: Column | None, available=RULE_LANGUAGES) -> Column:
    """The language whose rules are applied: the given one in lower case, or English where there are none for it."""
    if language is None:
        return F.lit("en")
    return F.when(F.lower(language).isin(*available), F.lower(language)).otherwise("en")


# Thresholds and whitelist of the rules profile.
RULE_FILTERS = (("all", "*", 0.55, False),)
RULE_WHITELIST = (
    "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "CN_ID", "PERSON", "ORGANIZATION", "PHYSICAL_ADDRESS", "USER_NAME",
    "BANK_NUMBER", "PAYMENT", "VERIFY_CODE", "PASSWORD", "RANDOM_SEED", "PRIVATE_KEY", "URL",
)


def placeholder(entity_type: Column, entity_id: Column) -> Column:
    return F.concat(F.lit("__PII_"), entity_type, F.lit("_"), entity_id.cast("string"), F.lit("__"))


def splice(text: Column, spans: Column, put: str = "concat('__PII_', s.entity_type, '_', r.n, '__')") -> Column:
    """Replaces each span (ordered, disjoint) by ``put``, SQL as in :func:`spans.walk`: a placeholder unless given. Null text stays null."""
    done = F.coalesce(F.array_join(S.walk(text, spans, f"concat(r.gap, {put})"), ""), F.lit(""))
    rest = F.substring(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
    return F.concat(done, rest)


def build_meta(text: Column, spans: Column) -> Column:
    rows = S.walk(text, spans, "named_struct('entity_id', r.n, 'entity_type', s.entity_type, 'matched_text', r.value, 'score', s.score)")
    return F.when(spans.isNotNull(), F.coalesce(rows, F.array().cast(f"array<{META}>")))


def pii_spans(df: DataFrame, text="text", cfg: MaskConfig | None = None, out: str = "spans", **how) -> DataFrame:
    """Adds the array of masked spans with ids: ``array<struct<entity_id, entity_type, start, end, score>>``."""
    found = detect(F.col(text), cfg or MaskConfig(), **how)
    rows = F.transform(found, lambda s, i: F.struct((i + 1).alias("entity_id"), s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return S.computed(df, {out: rows})


def pii_entities(df: DataFrame, keys, text="text", cfg: MaskConfig | None = None, **how) -> DataFrame:
    """One row per masked span: the key columns, entity_id, entity_type, start, end, score, entity_text. Rows without spans vanish."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = pii_spans(df.select(*keys, text), text, cfg, "__spans", **how)
    return S.explode_rows(rows, "__spans", "__s", *keys, F.col(text).alias("__text")).select(
        *keys,
        F.col("__s.entity_id").alias("entity_id"),
        F.col("__s.entity_type").alias("entity_type"),
        F.col("__s.start").alias("start"),
        F.col("__s.end").alias("end"),
        F.col("__s.score").alias("score"),
        F.substring(F.col("__text"), F.col("__s.start") + 1, F.col("__s.end") - F.col("__s.start")).alias("entity_text"),
    )


def mask(df: DataFrame, text="text", cfg: MaskConfig | None = None, masked: str = "masked_text", meta: str = "mask_meta", **how) -> DataFrame:
    """Adds masked text and metadata; ``how``: profile, ner, language, min_score, extra, fallback as in :func:`detect`.

    The spans are their own projection, read by both outputs, so that the patterns run once.
    """
    found = df.withColumn("__found", detect(F.col(text), cfg or MaskConfig(), **how))
    source = F.col(text)
    return S.computed(found, {masked: splice(source, F.col("__found")), meta: build_meta(source, F.col("__found"))}).drop("__found")


def anonymize(df: DataFrame, operators: dict, text="text", cfg: MaskConfig | None = None, out: str = "anonymized_text", **how) -> DataFrame:
    """Per-type operators instead of placeholders.

    operators: entity type (or DEFAULT) to {"type": replace | redact | hash | mask | keep, ...}:
    replace takes new_value (else ``<TYPE>``), hash is SHA-256 in hex, mask takes
    masking_char and chars_to_mask (from the end if from_end). Types without an
    operator follow DEFAULT, else replace.
    """

    def one(op: dict) -> str:
        kind = op.get("type", "replace")
        if kind == "replace":
            return S.quoted(op["new_value"]) if "new_value" in op else "concat('<', s.entity_type, '>')"
        if kind in ("redact", "hash", "keep"):
            return {"redact": "''", "hash": "sha2(r.value, 256)", "keep": "r.value"}[kind]
        if kind == "mask":
            hidden = f"least({int(op.get('chars_to_mask', 1 << 30))}, length(r.value))"
            stars = f"repeat({S.quoted(op.get('masking_char', '*'))}, {hidden})"
            if op.get("from_end"):
                return f"concat(substring(r.value, 1, length(r.value) - {hidden}), {stars})"
            return f"concat({stars}, substring(r.value, {hidden} + 1))"
        raise ValueError(f"no such operator: {kind}")

    cases = " ".join(f"WHEN {S.quoted(kind)} THEN {one(op)}" for kind, op in operators.items() if kind != "DEFAULT")
    rest = one(operators.get("DEFAULT", {"type": "replace"}))
    put = f"CASE s.entity_type {cases} ELSE {rest} END" if cases else rest
    found = df.withColumn("__found", detect(F.col(text), cfg or MaskConfig(), **how))
    return S.computed(found, {out: splice(F.col(text), F.col("__found"), put)}).drop("__found")
