"""Queries pN_... over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilframe.llm import abuse, langid, lookalikes, packing, personal, pieces, runs, tokens
from veilframe.sources.readers import tables

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ---- 1: texts that look the same ----


@query("p1_found")
def p1_found(spark, folder):
    return lookalikes.look_alikes(tables(spark, folder)("mask_in"))


@query("p1_classes")
def p1_classes(spark, folder):
    return lookalikes.look_alike_classes(tables(spark, folder)("mask_in"))


@query("p1_forms")
def p1_forms(spark, folder):
    return lookalikes.normalise(tables(spark, folder)("mask_in"), ["request_id"]).select("request_id", "same_form").distinct()


# ---- 2: languages ----


def _network(read):
    return langid.fit_on(read("mask_in"), read("lang_samples"))


@query("p2_found")
def p2_found(spark, folder):
    read = tables(spark, folder)
    requests = read("mask_in").where(F.col("text").isNotNull()).select(F.struct("request_id", "language").alias("k"), "text")
    found = langid.segments(requests, _network(read), "k").where("whole").select("k.request_id", "k.language", "lang")
    return found.where(~F.array_contains(langid.labelled(F.col("language")), F.col("lang"))).select("request_id", "lang").distinct()


@query("p2_segments")
def p2_segments(spark, folder):
    read = tables(spark, folder)
    return langid.segments(read("mask_in"), _network(read)).distinct()


@query("p2_documents")
def p2_documents(spark, folder):
    read = tables(spark, folder)
    return langid.documents(read("mask_in"), _network(read)).distinct()


# ---- 3: runs of items ----

_RUNS = """WITH it AS (SELECT DISTINCT request_id AS k, token_index AS i, regexp_replace(upper(entity), '^[BIES][-_]', '') AS l, start_pos AS s, end_pos AS e
  FROM ner_item WHERE entity IS NOT NULL AND entity <> '' AND upper(entity) <> 'O' AND start_pos IS NOT NULL AND end_pos IS NOT NULL),
x AS (SELECT *, CASE WHEN i = lag(i) OVER w + 1 AND l = lag(l) OVER w AND s BETWEEN lag(s) OVER w - 2 AND lag(e) OVER w + 1 THEN 0 ELSE 1 END AS opens FROM it WINDOW w AS (PARTITION BY k ORDER BY i)),
y AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY i) AS run FROM x)
SELECT k AS request_id, {columns} FROM y GROUP BY k, run"""


@query("p3_found", _RUNS.format(columns="CAST(min(i) AS INTEGER) AS first_index, CAST(max(i) AS INTEGER) AS last_index") + " HAVING count(*) > 1")
def p3_found(spark, folder):
    rows = runs.collapse(tables(spark, folder)("ner_item"))
    return rows.where("n_items > 1").select("request_id", "first_index", "last_index")


@query(
    "p3_runs",
    _RUNS.format(columns="min(l) AS label_core, CAST(min(i) AS INTEGER) AS first_index, CAST(max(i) AS INTEGER) AS last_index, CAST(count(*) AS INTEGER) AS n_items, arg_min(s, i) AS start_pos, arg_max(e, i) AS end_pos, arg_max(e, i) - arg_min(s, i) AS duration"),
)
def p3_runs(spark, folder):
    return runs.collapse(tables(spark, folder)("ner_item"))


# ---- 4: personal information ----


@query("p4_found")
def p4_found(spark, folder):
    read = tables(spark, folder)
    return personal.spans(personal.bodies(read), personal.lexicon_from(read("entity_span"))).distinct()


@query("p4_masked")
def p4_masked(spark, folder):
    read = tables(spark, folder)
    return personal.mask(personal.bodies(read), personal.lexicon_from(read("entity_span"))).distinct()


# ---- 5: pieces ----

_LIMITED = """lim AS (SELECT lower(trim(model)) AS m, max_chars AS lim FROM model_limits),
body AS (SELECT DISTINCT 'mask_in' AS src, request_id AS record_id, text, (SELECT lim FROM lim WHERE m = 'mask_in') AS lim FROM mask_in
UNION SELECT DISTINCT 'call_in', call_id, text, coalesce((SELECT lim FROM lim WHERE m <> 'mask_in' AND m = lower(trim(coalesce(model, ''), chr(32) || chr(9) || chr(10) || chr(13)))), (SELECT lim FROM lim WHERE m = 'default')) FROM call_in)"""


@query(
    "p5_found",
    f"""WITH {_LIMITED} SELECT src, record_id, CASE WHEN list_max(list_transform(string_split_regex(text, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}.!?…。！？]'), lambda x: length(x))) > lim THEN 'forced' ELSE 'natural' END AS cut_kind
FROM body WHERE length(text) > lim""",
)
def p5_found(spark, folder):
    rows = pieces.split_long(pieces.bodies(tables(spark, folder)), with_text=False)
    return rows.where("piece_no = 2").select("src", "record_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut_kind")).distinct()


@query("p5_pieces")
def p5_pieces(spark, folder):
    rows = pieces.split(pieces.bodies(tables(spark, folder)))
    return rows.select("src", "record_id", "piece_no", "start_pos", "end_pos", "hard", "piece")


@query("p5_rejoined", f"WITH {_LIMITED} SELECT src, record_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) AS BIGINT) AS covered FROM body WHERE text IS NOT NULL")
def p5_rejoined(spark, folder):
    """Lengths of the texts against what their pieces cover once, by sums alone."""
    rows = pieces.split(pieces.bodies(tables(spark, folder))).select("src", "record_id", "piece_no", "start_pos", "end_pos", "piece").distinct()
    sums = rows.groupBy("src", "record_id").agg(F.max("end_pos").cast("bigint").alias("n_chars"), F.sum(F.length("piece")).alias("all"), F.sum("start_pos").alias("s"), (F.sum("end_pos") - F.max("end_pos")).alias("e"))
    return sums.select("src", "record_id", "n_chars", (F.col("all") - (F.col("e") - F.col("s"))).alias("covered"))


@query(
    "p5_bounds",
    f"""WITH {_LIMITED} SELECT src, record_id, true AS within_limit, true AS overlaps_exact, true AS at_boundaries, true AS as_in_text FROM body WHERE text IS NOT NULL AND length(text) > lim""",
)
def p5_bounds(spark, folder):
    """Of every text above its limit: whether all pieces keep the limit, share the overlap, end at a boundary unless cut hard, and equal the text."""
    given = pieces.bodies(tables(spark, folder)).distinct()
    rows = pieces.split(given).join(given, ["src", "record_id"]).where(F.length("text") > F.col("max_chars"))
    ends_well = F.expr(r"hard OR end_pos = length(text) OR rlike(substring(text, end_pos, 1), r'(?U)[\s.!?…。！？]')")
    w = Window.partitionBy("src", "record_id").orderBy("piece_no")
    before = F.lag("end_pos").over(w)
    rows = rows.select(
        "src", "record_id",
        (F.length("piece") <= F.col("max_chars")).alias("a"),
        F.coalesce(before - F.col("start_pos") == F.col("overlap_chars"), F.col("start_pos") == 0).alias("b"),
        ends_well.alias("c"),
        (F.col("piece") == F.expr("substring(text, start_pos + 1, end_pos - start_pos)")).alias("d"),
    )
    names = {"a": "within_limit", "b": "overlaps_exact", "c": "at_boundaries", "d": "as_in_text"}
    return rows.groupBy("src", "record_id").agg(*[F.bool_and(c).alias(n) for c, n in names.items()])


# ---- 6: tokens ----


@query("p6_ids")
def p6_ids(spark, folder):
    return tokens.encode(tables(spark, folder)("documents"))


@query("p6_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_round_trip(spark, folder):
    return tokens.decode(tokens.encode(tables(spark, folder)("documents")))


@query("p6_lengths")
def p6_lengths(spark, folder):
    return tokens.lengths(tables(spark, folder)("documents"))


# ---- 7: containers ----


def _packed(read):
    documents = read("documents")
    return packing.pack(tokens.lengths(documents), read("pack_sizes"), n=documents.count())


@query("p7_containers")
def p7_containers(spark, folder):
    return _packed(tables(spark, folder))


@query("p7_whole", "SELECT pack_name, doc_id, true AS whole, true AS unsplit_if_it_fits FROM documents, (SELECT DISTINCT pack_name FROM pack_sizes WHERE capacity_tokens > 0)")
def p7_whole(spark, folder):
    """Per document and capacity: whether its parts add up to its tokens, and whether it is split only above the capacity."""
    read = tables(spark, folder)
    sizes = tokens.lengths(read("documents")).withColumnRenamed("n_tokens", "size")
    parts = _packed(read).groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    rows = parts.join(sizes, "doc_id").join(read("pack_sizes").distinct(), "pack_name")
    return rows.select("pack_name", "doc_id", (F.col("n") == F.col("size")).alias("whole"), ((F.col("parts") == 1) | (F.col("size") > F.col("capacity_tokens"))).alias("unsplit_if_it_fits"))


@query("p7_overfull", "SELECT DISTINCT pack_name, CAST(0 AS BIGINT) AS overfull FROM pack_sizes WHERE capacity_tokens > 0")
def p7_overfull(spark, folder):
    """Per capacity: containers that hold more than it."""
    read = tables(spark, folder)
    per = _packed(read).groupBy("pack_name", "group_no", "container_no").agg(F.sum("n_tokens").alias("n")).join(read("pack_sizes").distinct(), "pack_name")
    return per.groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))


@query("p7_fill")
def p7_fill(spark, folder):
    """Per capacity: containers, tokens, and the share of space left unused."""
    read = tables(spark, folder)
    rows = _packed(read)
    per = rows.groupBy("pack_name", "group_no", "container_no").agg(F.sum("n_tokens").alias("n"))
    total = per.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return total.join(read("pack_sizes").select("pack_name", "capacity_tokens").distinct(), "pack_name").select(
        "pack_name", "containers", "n_tokens", "fullest", F.round(1 - F.col("n_tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused")
    )


# ---- 8: abusive, hateful and sexual language ----


def _scored(read, *more):
    documents = read("documents")
    classifier = abuse.fit_on(documents, read("review_marks"))
    if not more:
        return abuse.scores(documents, classifier)
    return abuse.scores(documents.select(F.struct("doc_id", *more).alias("k"), "text"), classifier, "k")


@query("p8_found")
def p8_found(spark, folder):
    kinds = F.array(*[F.when(F.col(c) >= abuse.THRESHOLD, F.lit(c)) for c in abuse.CATEGORIES])
    return _scored(tables(spark, folder)).select("doc_id", F.explode(F.array_compact(kinds)).alias("category"))


@query("p8_scores")
def p8_scores(spark, folder):
    return _scored(tables(spark, folder))


@query("p8_scored", "SELECT doc_id, source, true AS scored, coalesce(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') = '' AS blank FROM documents")
def p8_scored(spark, folder):
    """Every document has three scores from 0 to 1, and a blank one scores 0 in all."""
    text = F.col("text")
    blank = F.coalesce(F.regexp_replace(text, r"[ \t\n\r]", ""), F.lit("")) == ""
    rows = _scored(tables(spark, folder), "source", blank.alias("blank")).select("k.*", F.greatest(*abuse.CATEGORIES).alias("most"), F.least(*abuse.CATEGORIES).alias("least"))
    return rows.select("doc_id", "source", ((F.col("least") >= 0) & (F.col("most") <= 1) & (~F.col("blank") | (F.col("most") == 0))).alias("scored"), "blank")


@query("p8_sources")
def p8_sources(spark, folder):
    """Per source: documents, and the share of them found in each category."""
    rows = _scored(tables(spark, folder), "source").select("k.source", *abuse.CATEGORIES)
    return rows.groupBy("source").agg(
        F.count("*").alias("n_documents"), *[F.round(F.avg((F.col(c) >= abuse.THRESHOLD).cast("double")), 6).alias(f"{c}_rate") for c in abuse.CATEGORIES]
    )


@query("p8_reviews", """WITH last AS (SELECT doc_id, category, reviewer, arg_max(mark, {'a': marked_at, 'b': mark}) AS mark FROM review_marks
  WHERE mark IN (0, 1) AND category IN ('abuse', 'hate', 'sexual') AND doc_id IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, category, avg(mark) AS share FROM last GROUP BY ALL) SELECT doc_id, category, CASE WHEN share > 0.5 THEN 1 ELSE 0 END AS mark FROM s WHERE share <> 0.5""")
def p8_reviews(spark, folder):
    """The reviewers' majority, which the classifier learns from."""
    return abuse.reviews(tables(spark, folder)("review_marks"))
