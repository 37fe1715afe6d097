"""Spans from recognizer tokens, given as an array column of
``struct<entity string, score float, index int, word string, start int, end int>``.

Null and empty arrays give no spans. No recognizer weights are shipped: ``with_model``
takes any function from texts to tokens; without one, detection is by pattern only.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from veilframe.functions import language as L
from veilframe.operators import spans as S

ITEM = "struct<entity:string,score:float,index:int,word:string,start:int,end:int>"
ITEMS = f"array<{ITEM}>"

# Label cores and the entity types they stand for.
CORE_TYPES = {
    "PER": "USER_NAME",
    "PERSON": "USER_NAME",
    "ORG": "ORGANIZATION",
    "LOC": "PHYSICAL_ADDRESS",
    "GPE": "PHYSICAL_ADDRESS",
    "FAC": "PHYSICAL_ADDRESS",
    "ADDRESS": "PHYSICAL_ADDRESS",
}


def label_core(label: Column) -> Column:
    label = F.coalesce(label, F.lit(""))
    return F.when(label.rlike("^[BSIE]-"), F.substring(label, 3, 1 << 20)).when(label != "", label).otherwise("MISC")


def label_tag(label: Column) -> Column:
    """B for B- and S-, I for I- and E-, O for a bare or empty label."""
    return F.when(label.rlike("^[BS]-"), "B").when(label.rlike("^[IE]-"), "I").otherwise("O")


def entity_type(core: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CORE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(core)), F.lit("NONE"))


def merge_subwords(items: Column) -> Column:
    """Joins neighbours with the same label core where one ends at the other's start.

    The first label and index stay, words are concatenated, the score is the mean.
    """
    state = F.struct(F.array().cast(ITEMS).alias("out"), F.lit(0).alias("n"))

    def step(acc, x):
        last = F.try_element_at(acc["out"], F.lit(-1))
        joins = F.coalesce((F.size(acc["out"]) > 0) & (label_core(last["entity"]) == label_core(x["entity"])) & (last["end"] == x["start"]), F.lit(False))
        merged = F.struct(
            last["entity"].alias("entity"),
            ((last["score"] * acc["n"] + x["score"]) / (acc["n"] + 1)).cast("float").alias("score"),
            last["index"].alias("index"),
            F.concat(last["word"], x["word"]).alias("word"),
            last["start"].alias("start"),
            x["end"].alias("end"),
        )
        return F.struct(
            F.when(joins, F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(merged)))
            .otherwise(F.concat(acc["out"], F.array(x)))
            .cast(ITEMS)
            .alias("out"),
            F.when(joins, acc["n"] + 1).otherwise(1).alias("n"),
        )

    return F.aggregate(F.coalesce(items, F.array().cast(ITEMS)).cast(ITEMS), state, step, lambda acc: acc["out"])


def bio_spans(items: Column, text: Column, seq: int = 100) -> Column:
    """Begin/inside folding: only a begin opens an entity; a same-type inside extends it;
    a same-type begin opens the next one unless its text starts with ``##``; another type
    or an untyped token ends it. The score is the running mean ``(so far + token) / 2``.
    """
    span = S.SPAN
    empty = F.lit(None).cast(span)
    state = F.struct(empty.alias("open"), S.no_spans().alias("out"))

    def step(acc, x):
        kind, tag = entity_type(label_core(x["entity"])), label_tag(x["entity"])
        fresh = F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("entity_type"), x["score"].cast("double").alias("score"), F.lit(seq).alias("seq")).cast(span)
        grown = F.struct(
            acc["open"]["start"].alias("start"),
            x["end"].alias("end"),
            acc["open"]["entity_type"].alias("entity_type"),
            ((acc["open"]["score"] + x["score"].cast("double")) / 2).alias("score"),
            acc["open"]["seq"].alias("seq"),
        ).cast(span)
        has = acc["open"].isNotNull()
        typed = kind != "NONE"
        same = has & typed & (acc["open"]["entity_type"] == kind)
        inside = same & ((tag != "B") | (F.substring(text, x["start"] + 1, F.lit(2)) == "##"))
        opens = typed & (tag == "B")
        flushed = F.when(has & ~F.coalesce(inside, F.lit(False)), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])
        return F.struct(F.when(F.coalesce(inside, F.lit(False)), grown).when(opens, fresh).otherwise(empty).cast(span).alias("open"), flushed.cast(S.NO_SPANS).alias("out"))

    done = F.aggregate(
        F.coalesce(items, F.array().cast(ITEMS)).cast(ITEMS), state, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])
    )
    return S.valid(done, text, 0.0)


def with_model(
    df: DataFrame, infer: Callable[[list[str], list[str]], list[list[tuple]]], text="text", language=None, out="ner", scripts: tuple[str, str] | None = (L.SIMPLIFIED_CHARS, L.TRADITIONAL_CHARS)
) -> DataFrame:
    """Adds a token column computed by ``infer(texts, languages)``, batch by batch over Arrow.

    ``infer`` returns per text tuples (entity, score, index, word, start, end); tokens labelled
    ``O`` are dropped. Text in simplified Chinese is shown to it in traditional characters, by the
    one-to-one tables ``scripts`` (None: as it is); words come back in the characters of the text.
    A failing recognizer is the caller's matter; none at all: :func:`no_items`.
    """
    there, back = (str.maketrans(*scripts), str.maketrans(*reversed(scripts))) if scripts else ({}, {})

    def simplified(tag: str) -> bool:
        tag = tag.lower()
        return tag == "zh" or tag.startswith("zh-") and not any(x in tag for x in ("hant", "tw", "hk"))

    lang = F.lit("en") if language is None else F.coalesce(F.col(language), F.lit("en"))

    @pandas_udf(ITEMS)  # parsed here, where a session exists
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs in parts:
            given, tags = texts.fillna("").tolist(), langs.tolist()
            found = infer([t.translate(there) if simplified(tag) else t for t, tag in zip(given, tags)], tags)
            rows = []
            for row, tag in zip(found, tags):
                items = [dict(zip(("entity", "score", "index", "word", "start", "end"), t)) for t in row if t[0] != "O"]
                rows.append([x | {"word": x["word"].translate(back)} if simplified(tag) and x["word"] else x for x in items])
            yield pd.Series(rows)

    return df.withColumn(out, run(F.col(text), lang))


def no_items() -> Column:
    return F.array().cast(ITEMS)


# Marks that join the parts of a word; word pieces are also sought without them.
CONNECTORS = "-'`‐‑‒–—―−·・⁃∙"


class _Reading:
    """A text in a comparable form, with the place in the text that each of its characters comes from."""

    def __init__(self, size: int, parts: Iterable[tuple[int, str]]):
        pairs = list(parts)
        self.form = "".join(c for _, c in pairs)
        self.places = [i for i, _ in pairs] + [size]

    def seek(self, wanted: str, after: int) -> tuple[int, int] | None:
        """Source range of the first hit at or after a source place."""
        at = self.form.find(wanted, bisect_left(self.places, after)) if wanted else -1
        return None if at < 0 else (self.places[at], self.places[at + len(wanted)])


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


def align_tokens(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Offsets of word pieces in a text, for use inside a recognizer.

    A piece is sought, ignoring case, behind the previous piece and then anywhere; failing that, the
    same two searches go over the text without accents and connecting marks. A piece that is nowhere
    gets an empty range where the previous one ended. Offsets count code points of ``text``.
    """
    lowered = [c.lower() if len(c.lower()) == 1 else c for c in text]
    exact = _Reading(len(text), enumerate(lowered))
    loose = _Reading(len(text), ((i, x) for i, c in enumerate(lowered) for x in _bare(c) if x not in CONNECTORS))
    out: list[tuple[int, int]] = []
    for token in tokens:
        behind = out[-1][1] if out else 0
        piece = (token or "").removeprefix("##").lower()
        searches = ((exact, piece, behind), (exact, piece, 0), (loose, _bare(piece), behind), (loose, _bare(piece), 0))
        hits = (reading.seek(wanted, after) for reading, wanted, after in searches)
        out.append(next(filter(None, hits), (behind, behind)))
    return out
