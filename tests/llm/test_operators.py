"""Operators of the llm package against brute force, public libraries and edge cases."""

import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe.llm import abuse, langid, lookalikes, packing, personal, pieces, runs, tokens


def texts(spark, *values, extra=False):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "request_id bigint, text string")
    return df.withColumn("lang", F.lit("x")).withColumn("f", F.lit(1)) if extra else df


# ---- 1 ----


def test_look_alikes(spark):
    group = ["café Ab", "café Ab", "ｃafé Ab", "cаfé Ab", "ca​fé Ab"]
    others = ["cafe Ab", "café ab", "café  Ab", "café Ab.", "café\nAb", "", None, "​", "ﬁn", "fin", "Fin"]
    df = texts(spark, *group, *others, "café Ab", extra=True)
    df = df.unionByName(df.where("request_id = 1"))
    got = {tuple(r) for r in lookalikes.look_alikes(df).collect()}
    want = {(a, b) for a, b in combinations(range(5), 2)} | {(i, 16) for i in range(1, 5)} | {(11 - 1 + 0, 12)} | {(13, 14)}
    want = {p for p in want if p != (10, 12)} | {(10, 12)}
    assert got == want
    assert lookalikes.look_alikes(df.limit(0)).count() == 0


def test_look_alike_classes_and_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "HOT", 5)
    values = ["café"] * 9 + ["ｃafé"] * 3 + ["cafe", "x", "x", None, ""]
    df = texts(spark, *values, extra=True)
    df = df.unionByName(df.where("request_id < 3"))
    pairs = [tuple(r) for r in lookalikes.look_alikes(df).collect()]
    assert sorted(pairs) == sorted((a, b) for a in range(9) for b in range(9, 12))
    rows = {r["request_id"]: r for r in lookalikes.look_alike_classes(df).collect()}
    assert {k: r["n_links"] for k, r in rows.items()} == {**dict.fromkeys(range(9), 3), **dict.fromkeys(range(9, 12), 9), 12: 0, 13: 0, 14: 0, 16: 0}
    assert len({rows[k]["class_id"] for k in range(12)}) == 1 and rows[13]["class_id"] == rows[14]["class_id"] and len({r["class_id"] for r in rows.values()}) == 4
    assert lookalikes.look_alike_classes(df.limit(0)).count() == 0


def test_rewriting_ends_where_forms_lead_back():
    r = lookalikes.Rewriter({"a": "b", "b": "a"})
    assert r("ac") == r("bc")


def test_rewriting_is_stable():
    r = lookalikes.Rewriter(lookalikes.build_classes({"a": 9, "e": 9, "é": 8, "́": 5}))
    rng = random.Random(1)
    alphabet = "aeéАеοﬁｆ́​  カｶﾞ゙İi"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert r(r(t)) == r(t)
    assert r(None) is None and r("") == "" and len(r("é" * 50_000)) == 50_000


def test_union_find():
    u = lookalikes.UnionFind()
    for a, b in ("ab", "bc", "de"):
        u.union(a, b)
    assert sorted(map(sorted, u.classes())) == [["a", "b", "c"], ["d", "e"]]


# ---- 2 ----


def test_labels(spark):
    df = spark.createDataFrame([("en_GB",), ("Deutsch",), ("PTB",), ("zh-Hans",), (" spa ",), ("",), (None,), ("auto",), ("en/fr",)], "l string")
    assert [r[0] for r in df.select(langid.labelled(F.col("l"))).collect()] == [["en"], ["de"], [], ["zh"], ["es"], [], [], [], ["en", "fr"]]


def test_sentences():
    t = "My name is A. Smith. Really?! 好的。再见！ x@y.io\n- End"
    assert [t[a:b] for a, b in langid.sentences(t)] == ["My name is A. Smith.", "Really?!", "好的。", "再见！", "x@y.io", "End"]
    assert langid.sentences("") == []
    ok = lambda s: langid.is_sentence(langid.plain(s), s)
    assert ok("The garden bench arrived with a small scratch.") and ok("办公室里没有人知道书桌放在哪里。") and ok("番号12の身分証は田中さんのものです。")
    assert not ok("Rosk Pellinore, 106 Quarry Street") and not ok("Name: Lorcan Harkaway; Phone: 07700 900688") and not ok("鞄、机、手紙、ランプ、手紙")


def test_network_learns(spark):
    base = {"en": "the children walked along the river until the sun went down", "de": "die kinder gingen am fluss entlang bis die sonne unterging", "fr": "les enfants ont marché le long de la rivière"}
    words = {k: v.split() for k, v in base.items()}
    rng = random.Random(3)
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(9)) + "."
    net = langid.fit([(k, v + ".") for k, v in base.items()], [(k, make(k)) for k in base for _ in range(80)], epochs=8)
    held = [(k, make(k)) for k in base for _ in range(30)]
    found = langid.Identifier(net).segments([t for _, t in held])
    assert sum(len(f) == 1 and f[0][2] == k for (k, _), f in zip(held, found)) >= 81
    rows = langid.documents(texts(spark, base["de"] + ".", None, "", "12 34", extra=True), net).orderBy("request_id").collect()
    assert [r["lang"] for r in rows] == ["de", None, None, None]
    mixed = make("en") + " " + make("fr")
    assert [s[2] for s in langid.Identifier(net).segments([mixed])[0]] == ["en", "fr"]


def test_short_stretches_keep_their_segment():
    who = langid.Identifier(langid.Network.new(len(langid.LANGS)))
    parts = {"The children walked along the river.": ("en", 0.99), "Guten Tag!": ("de", 0.99), "Rosk Pellinore": ("fr", 0.6), "The lamp arrived with a small scratch.": ("en", 0.99)}
    for given, (lang, sure) in parts.items():
        who.seen[langid.plain(given)] = p = langid.np.full(10, (1 - sure) / 9)
        p[langid.LANGS.index(lang)] = sure
    text = "\n".join([*parts, "q" * 40])
    found = who.segments([text])[0]
    # the greeting is a segment, the unclear name goes with the sentences, a code has no language
    assert [(text[a:b], lang, whole) for a, b, lang, _, whole in found] == [
        ("The children walked along the river.", "en", True), ("Guten Tag!", "de", False), ("Rosk Pellinore\nThe lamp arrived with a small scratch.", "en", True)
    ]
    assert all(0 < f[3] <= 1 for f in found)


# ---- 3 ----


def brute_runs(rows):
    out, by = set(), {}
    for k, i, l, s, e in set(rows):
        by.setdefault(k, {})[i] = (l, s, e)
    for k, items in by.items():
        run = None
        for i in sorted(items):
            l, s, e = items[i]
            core = None if l is None or l.upper() == "O" or s is None or e is None else (l[2:] if l[:1].upper() in "BIES" and l[1:2] in ("-", "_") else l).upper()
            joins = run and core and i == run[1] + 1 and core == run[2] and run[3] - 2 <= s <= run[4] + 1
            if joins:
                run = (run[0], i, core, s, e)
            else:
                if run and run[1] > run[0]:
                    out.add((k, run[0], run[1]))
                run = (i, i, core, s, e) if core else None
        if run and run[1] > run[0]:
            out.add((k, run[0], run[1]))
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_runs(spark, monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    monkeypatch.setattr(runs, "WIDE", block * 4)
    rng = random.Random(block)
    rows = []
    for k in range(12):
        at = 0
        for i in range(rng.randrange(60)):
            if rng.random() < 0.85:
                at += rng.choice([0, 1, 2, 3])
                rows.append((k, i, rng.choice(["B-PER", "I-PER", "i_per", "PER", "O", None]), None if rng.random() < 0.04 else at, at + rng.randrange(1, 4)))
    rows += rng.sample(rows, 10)
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "request_id bigint, token_index int, entity string, start_pos int, end_pos int, b double")
    got = {tuple(r) for r in runs.collapse(df).where("n_items > 1").select("request_id", "first_index", "last_index").collect()}
    assert got == brute_runs(rows)
    assert runs.collapse(df.limit(0)).count() == 0


def test_runs_prefer_the_labelled_copy(spark):
    rows = [(1, 1, "B-PER", 0, 3), (1, 2, "I-PER", 4, 6), (1, 2, None, 4, 6), (1, 2, "O", 4, 6), (1, 3, "I-PER", 6, 9), (1, 3, "I-PER", None, None)]
    df = spark.createDataFrame(rows, "request_id bigint, token_index int, entity string, start_pos int, end_pos int")
    got = runs.collapse(df).first()
    assert (got["first_index"], got["last_index"], got["n_items"], got["duration"]) == (1, 3, 3, 9)


# ---- 4 ----

LEXICON = personal.learn([("Orla Pellinore", "PER"), ("Pellinore, Orla", "USER_NAME"), ("Rosk Tarnholt", "PERSON")] * 4 + [("Tarnholt Trust", "ORG")] + [(s + g, "PER") for s in ("蔺", "司徒") for g in ("青禾", "知渔")] * 3)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to (x.y+1@mail.test).", [("x.y+1@mail.test", "EMAIL_ADDRESS")]),
        ("Write to x.y (at) mail.test or a dot b at mail dot test now", [("x.y (at) mail.test", "EMAIL_ADDRESS"), ("a dot b at mail dot test", "EMAIL_ADDRESS")]),
        ("Write to х@mаil.test", [("х@mаil.test", "EMAIL_ADDRESS")]),
        ("Call +44 (0)20 7946 0209, order 6328005593", [("+44 (0)20 7946 0209", "PHONE_NUMBER")]),
        ("Call (312) 5​55-0179.", [("(312) 5​55-0179", "PHONE_NUMBER")]),
        ("the ID is QQ 73 95 53 C, v 3.14.50", [("QQ 73 95 53 C", "ID_NUMBER")]),
        ("ISBN 999-1-8242-3138-1 and 2021-03-24 05:33", []),
        ("Orla J. Pellinore met Tarnholt, Rosk of Tarnholt Trust", [("Orla J. Pellinore", "USER_NAME"), ("Tarnholt, Rosk", "USER_NAME")]),
        ("ＯＲＬＡ PELLINORE", [("ＯＲＬＡ PELLINORE", "USER_NAME")]),
        ("at Flat 4, 170 Quarry Street, Marlowby 20100 and", [("Flat 4, 170 Quarry Street, Marlowby 20100", "PHYSICAL_ADDRESS")]),
        ("in der Birkenallee 65c, 12023 Krähenstein.", [("Birkenallee 65c, 12023 Krähenstein", "PHYSICAL_ADDRESS")]),
        ("我叫司徒青禾，住在云溪市北渡区松柏街78号10栋974室。", [("司徒青禾", "USER_NAME"), ("云溪市北渡区松柏街78号10栋974室", "PHYSICAL_ADDRESS")]),
        ("zero seven seven zero zero nine zero zero one two three", [("zero seven seven zero zero nine zero zero one two three", "PHONE_NUMBER")]),
        ("", []),
        (None, []),
    ],
)
def test_personal(text, want):
    assert [(text[a:b], k) for a, b, k in personal.find(text, LEXICON)] == want


@pytest.mark.parametrize(
    "text, value, kind",
    [
        ("Call zero-two-zero-seven-nine-four-six-zero-two-zero-nine now", "zero-two-zero-seven-nine-four-six-zero-two-zero-nine", "PHONE_NUMBER"),
        ("on five, five, five, one, two, three, four, five, six, eight.", "five, five, five, one, two, three, four, five, six, eight", "PHONE_NUMBER"),
        ("tel 07700 nine zero zero one two three", "07700 nine zero zero one two three", "PHONE_NUMBER"),
        ("ID one one zero one zero five one nine four nine one two three one zero zero two X ok", "one one zero one zero five one nine four nine one two three one zero zero two X", "ID_NUMBER"),
        ("mine: Q Q seven three nine five five three C.", "Q Q seven three nine five five three C", "ID_NUMBER"),
        ("al zero sei sei due uno quattro cinque otto nove tre", "zero sei sei due uno quattro cinque otto nove tre", "PHONE_NUMBER"),
        ("ligue nove um dois três quatro cinco seis sete oito zero", "nove um dois três quatro cinco seis sete oito zero", "PHONE_NUMBER"),
        ("bel nul zes een twee drie vier vijf zes zeven acht", "nul zes een twee drie vier vijf zes zeven acht", "PHONE_NUMBER"),
        ("тел. восемь девять один два три четыре пять шесть семь восемь", "восемь девять один два три четыре пять шесть семь восемь", "PHONE_NUMBER"),
        ("电话一三八零零一三八零零零，谢谢", "一三八零零一三八零零零", "PHONE_NUMBER"),
        ("電話はゼロきゅうゼロいちにさんよんごろくななはち です", "ゼロきゅうゼロいちにさんよんごろくななはち", "PHONE_NUMBER"),
        ("at one seven zero Quarry Street, Marlowby 20100 and", "one seven zero Quarry Street, Marlowby 20100", "PHYSICAL_ADDRESS"),
        ("mail x@mail dot test now", "x@mail dot test", "EMAIL_ADDRESS"),
        ("mail x {at} mail [punkt] test now", "x {at} mail [punkt] test", "EMAIL_ADDRESS"),
        ("ana arroba correo punto test", "ana arroba correo punto test", "EMAIL_ADDRESS"),
        ("ivan собака mail точка test", "ivan собака mail точка test", "EMAIL_ADDRESS"),
        ("Orla at rosk.sallowby at mail.test", "rosk.sallowby at mail.test", "EMAIL_ADDRESS"),
        ("order six three two eight zero zero five five nine three", None, None),
        ("look at example.com and meet at one point two, one two times", None, None),
    ],
)
def test_spelled_and_disguised(text, value, kind):
    assert [(text[a:b], k) for a, b, k in personal.find(text, LEXICON)] == ([(value, kind)] if value else [])


@pytest.mark.parametrize("n", [0, 100, 400])
def test_numbers_in_long_runs(n):
    x = "x" * n
    for text in (f'{{"a":"{x}","tel":"+442079460209","b":"{x}"}}', f"q={x}&tel=+442079460209&k={x}", f"{x},+442079460209,{x}"):
        assert [(text[a:b], k) for a, b, k in personal.find(text, LEXICON)] == [("+442079460209", "PHONE_NUMBER")]
    assert personal.find(f"id={x}&nin=QQ739553C&k={x}", LEXICON) == [(n + 8, n + 17, "ID_NUMBER")]
    assert personal.find("0f3a9b7c21" * 40, LEXICON) == []


def test_personal_tables(spark):
    df = spark.createDataFrame([("mask_in", 1, "mail a@b.test", 0), ("call_in", 1, None, 0), ("call_in", 2, "x" * 300_000 + " a@b.test", 0)], "src string, record_id bigint, text string, start_pos int")
    assert sorted((r["src"], r["record_id"], r["end_pos"] - r["start_pos"]) for r in personal.spans(df, LEXICON).collect()) == [("call_in", 2, 8), ("mask_in", 1, 8)]
    assert [r["masked_text"] for r in personal.mask(df, LEXICON).limit(2).collect()] == ["mail __PII_EMAIL_ADDRESS_1__", None]
    assert personal.spans(df.limit(0), LEXICON).count() == 0


def test_long_local_parts_and_word_counts(spark):
    long = "a" * 100 + ".b@mail.example"
    assert personal.find(f"to {long} now", personal.learn([])) == [(3, 3 + len(long), "EMAIL_ADDRESS")]
    assert personal.find("@" * 20_000 + "a" * 20_000, personal.learn([])) == []
    rows = [("Ann Harkaway", "USER_NAME")] * 4 + [("Bell Harkaway", "PER")] * 2 + [("Ann Street 5", "PHYSICAL_ADDRESS"), ("王小明", "USER_NAME"), (None, None), ("", "USER_NAME")]
    df = spark.createDataFrame(rows, "span_text string, entity_type string").withColumn("word", F.lit(1))
    a, b = personal.lexicon_from(df), personal.learn([(t, k) for t, k in rows if t])
    assert a.roles == b.roles == {"ann": "G", "harkaway": "S"}
    assert personal.lexicon_from(df.limit(0)).roles == {}


def test_rare_names_are_found_however_many_words_there_are(spark):
    n = 100_001
    word = lambda start: F.concat(F.lit(start), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    rare = spark.range(n).select(F.concat_ws(" ", word("Al"), word("Be")).alias("span_text"), F.lit("PER").alias("entity_type"), F.explode(F.sequence(F.lit(1), F.lit(3))))
    often = spark.range(20).select(F.lit("Orla Pellinore"), F.lit("PER"), F.lit(1))
    lexicon = personal.lexicon_from(rare.union(often))
    assert len(lexicon.roles) == 2 * n + 2
    df = spark.createDataFrame([("mask_in", 1, "saw Albaaaaa Bebaaaaa, then Orla Pellinore")], "src string, record_id bigint, text string")
    assert sorted((r["start_pos"], r["end_pos"]) for r in personal.spans(df, lexicon).collect()) == [(4, 21), (28, 42)]
    assert personal.mask(df, lexicon).first()["masked_text"] == "saw __PII_USER_NAME_1__, then __PII_USER_NAME_2__"


def test_han_names_of_tables_and_of_lists(spark):
    rows = [(s + g, "PER") for s in ("蔺", "司徒", "王") for g in ("青禾", "知渔", "小明")] + [("饕饕青禾", "PER")] * 5 + [("饕知渔", "PER")] * 4 + [("Ann Bell", "PER")] * 3 + [("Ann " + "x" * 80, "ORG")] * 8
    a, b = personal.lexicon_from(spark.createDataFrame(rows, "span_text string, entity_type string")), personal.learn(rows)
    assert a.roles == b.roles == {"蔺": "s", "司徒": "s", "王": "s", "青禾": "g", "知渔": "g", "小明": "g", "饕饕青禾": "w", "bell": "S"}
    text = "饕饕青禾和饕知渔，司徒小明与王青禾。徒小明"
    want = [(text[x:y], k) for x, y, k in personal.find(text, b)]
    assert want == [("饕饕青禾", "USER_NAME"), ("司徒小明", "USER_NAME"), ("王青禾", "USER_NAME")]
    assert personal.find(text, a) == personal.find(text, b)


# ---- 5 ----


def test_pieces_hold_limits_and_overlap():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab .!\n。é́🙂") if rng.random() < 0.4 else "w" for _ in range(rng.randrange(1, 200)))
        limit = rng.randrange(2, 40)
        overlap = rng.randrange(0, limit)
        cut, forced = pieces.cut(text, limit, overlap)
        assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in cut)
        assert all(p[1] - n[0] == overlap and n[1] > p[1] for p, n in zip(cut, cut[1:]))
        stretch = max(map(len, "".join("\0" if c.isspace() or c in pieces.STOPS else c for c in text).split("\0")))
        assert forced == (stretch > limit)


def test_piece_tables(spark):
    df = spark.createDataFrame([("a", 1, "one two three four", 10, 2), ("a", 2, None, 10, 2), ("a", 3, "", 10, 2), ("a", 4, "x" * 25, 10, 0)], "src string, record_id bigint, text string, max_chars int, overlap_chars int")
    rows = pieces.split(df).orderBy("record_id", "piece_no").collect()
    assert [(r["record_id"], r["piece"]) for r in rows if r["record_id"] != 4] == [(1, "one two "), (1, "o three "), (1, "e four"), (3, "")]
    assert [len(r["piece"]) for r in rows if r["record_id"] == 4] == [10, 10, 5]


# ---- 6 ----


def test_bpe_is_exact(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    ref = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ref.encode_special_tokens = True
    rng = random.Random(2)
    values = ["".join(rng.choice("ab 1,.\n\r\t'sé码🙂 　\x1c:>-") for _ in range(rng.randrange(60))) for _ in range(400)]
    values += ["<|endoftext|>", "12:00:00,123 --> 12:00:01,456\nHi", "a" * 3000, "", None]
    df = texts(spark, *values, extra=True).withColumnRenamed("request_id", "doc_id")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert all(got[i] == (ref.encode(v, add_special_tokens=False).ids if v else []) for i, v in enumerate(values))
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert all(back[i] == (v or "") for i, v in enumerate(values))
    assert all(r["n_tokens"] == len(got[r["doc_id"]]) for r in tokens.lengths(df).collect())


# ---- 7 ----


def test_first_fit_decreasing():
    rng = random.Random(8)
    for _ in range(100):
        cap = rng.randrange(1, 50)
        sizes = sorted((rng.randrange(0, cap + 1) for _ in range(rng.randrange(40))), reverse=True)
        free, want = [], []
        for s in sizes:
            k = next((i for i, f in enumerate(free) if f >= s), len(free))
            if k == len(free):
                free.append(cap)
            free[k] -= s
            want.append(k)
        assert packing.first_fit_decreasing(sizes, cap) == want


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = random.Random(9)
    sizes = [rng.choice([0, 3, 10, 25, 130, 200]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([("s", 50), ("s", 50), ("l", 100)], "pack_name string, capacity_tokens int")
    rows = packing.pack(df, packs).collect()
    for name, cap in (("s", 50), ("l", 100)):
        used, total, parts = {}, {}, {}
        for r in rows:
            if r["pack_name"] == name:
                used[r["group_no"], r["container_no"]] = used.get((r["group_no"], r["container_no"]), 0) + r["n_tokens"]
                total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
                parts[r["doc_id"]] = parts.get(r["doc_id"], 0) + 1
        assert total == dict(enumerate(sizes)) and max(used.values()) <= cap
        assert all(parts[i] == max(1, -(-s // cap)) for i, s in enumerate(sizes))
    assert packing.pack(df.limit(0), packs).count() == 0


# ---- 8 ----


def test_abuse_plain_and_sentences():
    assert abuse.plain("You S.C.U.M.B.A.G, m0r0n, $@v@g3$, fuuuuck") == "you scumbag, moron, savages, fuck"
    t = "1\n00:00:01,000 --> 00:00:02,000\n<i>What a</i>\n\n2\n00:00:02,000 --> 00:00:03,000\ngreat day. - Yes?\n- No."
    assert abuse.sentences(t) == ["What a great day.", "- Yes?", "No."]
    assert abuse.mend("schÃ¶ner") == "schöner" and abuse.mend("plain") == "plain"


def test_abuse_scores(spark):
    c = abuse.fit([])
    hit = lambda s: [k for k, v in zip(abuse.CATEGORIES, c.scores(abuse.plain(s))) if v >= abuse.THRESHOLD]
    # wording that is not among the labelled sentences
    assert "abuse" in hit("What an ugly brainless m***n you are.") and "abuse" in hit("I will k1ll you, you bastard") and "abuse" in hit("fag") and "abuse" in hit("kys") and "abuse" in hit("die!")
    assert "hate" in hit("Refugees are vermin and they must be wiped out.") and "sexual" in hit("He touched her naked breasts until she moaned.")
    for s in ("The women voted in the election.", "My neighbours are muslims.", "The doctor examined her breasts for cancer.", "", "12 34", "!!"):
        assert hit(s) == []
    gap = [c.scores(abuse.plain(f"the film is about {g}")) for g in ("foreigners", "women", "muslims", "peasants")]
    assert max(abs(a - b).max() for a in gap for b in gap) < 0.2
    df = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\nYou are a worthless loser."), (2, ""), (3, None), (4, "x" * 200_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["abuse"] for r in abuse.scores(df.withColumn("abuse", F.lit("x")), c).collect()}
    assert got[1] >= 0.5 and got[2] == got[3] == 0.0 and got[4] < 0.5


def test_marks_teach_new_wording():
    """Insults that no labelled sentence holds are learned from marked documents, one of ten marks being wrong."""
    rng = random.Random(4)
    calm = ["we sail at noon today", "bring the lamp upstairs", "the soup is still warm", "who painted this gate", "my uncle sold the barn", "rain fell on the roof"]
    rude = ["you utter grobnik", "what a grobnik he is", "a snivelling plonter like you", "you plonter"]
    rows = []
    for n in range(240):
        own = rng.sample(calm, 4)
        bad = n % 4 == 0
        if bad:
            own[rng.randrange(4)] = rng.choice(rude)
        rows.append((". ".join(own) + ".", {"abuse": int(bad) ^ (rng.random() < 0.1)}))
    c = abuse.fit(rows)
    assert c.scores("you snivelling grobnik")[0] >= 0.5 and all(c.scores(s)[0] < 0.5 for s in calm)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_labelled_sentences_are_not_taken_from_the_tables():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    blob = " ".join(" ".join(t.lower().split()) for t in texts if t)
    assert not [s for _, s in abuse.written() if len(s) > 14 and s in blob]


def test_reviews(spark):
    rows = [(1, "a", "abuse", 1, 1), (1, "a", "abuse", 0, 0), (1, "b", "abuse", 1, 1), (1, "c", "abuse", 0, 1), (2, "a", "hate", None, 1), (3, "a", "hate", 1, 1), (3, "b", "hate", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, reviewer string, category string, mark int, marked_at int")
    assert [tuple(r) for r in abuse.reviews(df).collect()] == [(1, "abuse", 1)]
