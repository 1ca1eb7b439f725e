"""Operators for training data against brute force on small fixtures."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import distinct, leaks, packing, percentiles, queries, topn
from rivulet.llm import sentences as S
from tests.oracle import DATA, check

has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@has_data
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    if name in queries.ORACLE:
        check(spark, queries.QUERIES[name], queries.ORACLE[name])
    else:
        assert queries.QUERIES[name](spark, DATA).count() > 0


# distinct counts


@pytest.mark.parametrize("n", [0, 1, 3, 50, 3000, 60000])
def test_distinct_within_error(spark, n):
    df = spark.range(n).select((F.col("id") * 7919).alias("x"), F.lit("g").alias("g")).unionAll(spark.createDataFrame([(None, "g")], "x long, g string"))
    rows = distinct.estimates(distinct.sketch(df.unionAll(df), {"g": F.col("g")}, {"x": F.col("x")}, 1024), ["g"], 1024).collect()
    if n == 0:
        assert rows == []
    else:
        assert abs(rows[0].estimate - n) <= max(4 * rows[0].std_error, 0.1) and rows[0].std_error <= 0.03 * n


def test_sketches_merge_like_one(spark):
    df = spark.range(5000).select((F.col("id") % 900).alias("x"), (F.col("id") % 3).alias("day"))
    one = distinct.sketch(df, {"all": F.lit(1)}, {"x": F.col("x")}, 256)
    parts = distinct.sketch(df, {"day": F.col("day")}, {"x": F.col("x")}, 256)
    merged = distinct.merge(parts.unionByName(parts).withColumn("all", F.lit(1)), ["all"])
    assert sorted((r.bucket, r.bits) for r in one.collect()) == sorted((r.bucket, r.bits) for r in merged.collect())
    with pytest.raises(ValueError):
        distinct.sketch(df, {}, {"x": F.col("x")}, 1000)


# top N


@pytest.mark.parametrize(
    "text, value",
    [("$1297.48", 1297.48), ("USD 6,945.69", 6945.69), ("(280.13)", -280.13), ("593.67-", -593.67), ("2.51766e+03", 2517.66), ("  0001138.30 ", 1138.3), ("+6,309.52", 6309.52), ("-$5", -5.0), ("($1,280)", -1280.0), ("-0.00", 0.0), ("71l.56", None), ("-", None), ("see note", None), ("", None), (None, None), ("#REF", None), ("1,2", None), ("NaN", None)],
)
def test_amount(spark, text, value):
    assert spark.createDataFrame([(text,)], "c string").select(topn.amount(F.col("c"))).first()[0] == value


@pytest.mark.parametrize("seed, groups", [(1, 1), (2, 7), (3, 300)])
def test_top_n_equals_brute_force(spark, seed, groups):
    rng = random.Random(seed)
    rows = [(rng.randrange(groups) if rng.random() > 0.3 else 0, rng.choice([rng.randrange(6), None]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g long, s long, i long").withColumn("s", F.col("s").cast("double")).withColumn("pid", F.lit(1)).withColumn("place", F.lit("clash")).repartition(5)
    got = topn.top_n(df, ["g"], "s", "i", F.lit(4), 4)
    want = []
    for g in range(groups):
        best = sorted([(-s, i) for gg, s, i in rows if gg == g and s is not None])[:4]
        want += [(g, k + 1, i) for k, (_, i) in enumerate(best)]
    assert sorted((r.g, r.rnk, r.item) for r in got.collect()) == want


def test_top_n_of_nothing(spark):
    assert topn.top_n(spark.createDataFrame([], "g long, s double, i long"), ["g"], "s", "i", F.lit(4), 4).count() == 0


def test_latest(spark):
    df = spark.sql("select * from values (1, timestamp'2020-01-01', 'a'), (1, timestamp'2021-01-01', null), (2, null, 'b'), (null, null, 'c') t(k, loaded_at, v)")
    assert sorted(map(tuple, topn.latest(df, "k", "v").collect())) == [(1, None), (2, "b")]


# percentiles


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 2), (3, 700)])
def test_percentiles_equal_brute_force(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, float("nan"), float(rng.randrange(50)), -0.0, 1e300])) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    halves = [percentiles.frequencies(d, ["g"], "v") for d in (df.where("g is null"), df.where("g is not null"))]
    shares = (0.0, 0.25, 0.5, 1.0)
    got = sorted((r.g or "", r.share, r.value, r.n) for r in percentiles.percentiles(percentiles.merged(halves, ["g"]), ["g"], shares).collect())
    want = []
    for g in {g for g, _ in rows}:
        vals = sorted(v + 0.0 for gg, v in rows if gg == g and v is not None and v == v)
        want += [(g or "", p, vals[max(1, int(np.ceil(p * len(vals)))) - 1], len(vals)) for p in shares if vals]
    assert got == sorted(want)


def test_names_of_groups(spark):
    df = spark.createDataFrame([(1, 2.0)], "pid long, v double").withColumn("value", F.lit("clash"))
    state = percentiles.frequencies(df, ["pid"], "v")
    assert [tuple(r) for r in percentiles.percentiles(state, ["pid"], [0.5]).collect()] == [(1, 0.5, 2.0, 1)]
    for bad in (lambda: percentiles.frequencies(df, ["value"], "v"), lambda: distinct.sketch(df, {"bits": F.col("pid")}, {"x": F.col("v")})):
        with pytest.raises(ValueError):
            bad()


# containers


def fits(rows, sizes, capacity):
    fill, pieces = {}, {}
    for doc, piece, first, n, box in rows:
        fill[box] = fill.get(box, 0) + n
        pieces.setdefault(doc, []).append((piece, first, n))
    assert max(fill.values(), default=0) <= capacity
    for doc, n in sizes.items():
        got = sorted(pieces.pop(doc))
        assert sum(x[2] for x in got) == n and [x[1] for x in got] == [sum(y[2] for y in got[:k]) for k in range(len(got))]
        assert n > capacity or len(got) == 1
        assert all(x[2] == capacity for x in got[:-1])
    assert not pieces
    return len(fill)


def first_fit_decreasing(sizes, capacity):
    boxes = 0
    room = []
    for n in sorted(sizes, reverse=True):
        boxes += n // capacity
        n %= capacity
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(capacity - n)
        else:
            room[k] -= n
    return boxes + len(room)


@pytest.mark.parametrize("seed, n, most", [(1, 0, 10), (2, 1, 300), (3, 3000, 250), (4, 400, 60), (5, 500, 101)])
def test_pack(spark, seed, n, most):
    rng = random.Random(seed)
    sizes = {k: rng.randrange(most) for k in range(n)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartition(3).withColumn("piece", F.lit(1)).withColumn("container", F.lit("clash"))
    boxes = fits(map(tuple, packing.pack(df, 100).collect()), sizes, 100)
    assert boxes <= first_fit_decreasing(sizes.values(), 100) * 1.02 + 2


def test_pack_sizes_that_fill_nothing(spark):
    sizes = {k: 60 for k in range(500)}
    got = packing.pack(spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long"), 100, carry=50)
    assert fits(map(tuple, got.collect()), sizes, 100) == 500


def test_pack_items_in_order_of_size(spark):
    sizes = {k: 73 if k < 600 else 24 for k in range(1200)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartitionByRange(2, F.col("n_tokens").desc())
    assert fits(map(tuple, packing.pack(df, 100, carry=100).collect()), sizes, 100) <= 601


def test_search_empties_containers():
    block = packing.Block(np.array([60, 60, 40, 30, 40, 30, 70, 70]), 100)
    before = block.used
    block.search()
    assert block.used <= before and block.used == 4 and block.fill.sum() == 400


def test_token_count(spark):
    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no vocabulary")
    got = [r[0] for r in spark.createDataFrame([("",), (None,), ("hello <|endoftext|> world " * 3,)], "t string").select(packing.token_count(F.col("t"))).collect()]
    assert got[:2] == [0, None] and got[2] > 9


# leaks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_leak(doc, item, least):
    """Some passage of the item, beginning and ending with equal tokens, with at most one edit in eight."""
    least = min(least, len(item))
    for a in range(len(item)):
        for b in range(a + least, min(len(item), a + 3 * least) + 1):
            for s in range(len(doc)):
                if doc[s] != item[a]:
                    continue
                for e in range(s + 1, min(len(doc), s + (b - a) + 6) + 1):
                    if doc[e - 1] == item[b - 1] and distance(doc[s:e], item[a:b]) * 8 <= b - a:
                        return True
    return False


@pytest.mark.parametrize("seed", range(40))
def test_leak_equals_brute_force(seed):
    rng = random.Random(seed)
    words = [chr(97 + k) * 3 for k in range(20)]
    item = [rng.choice(words) for _ in range(rng.choice([6, 12, 20, 26]))]
    take = rng.randrange(8, 22)
    start = rng.randrange(max(1, len(item) - take))
    passage = item[start : start + take]
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(passage))
        passage[k : k + 1] = rng.choice([["zzz"], [], [passage[k], "zzz"]])
    doc = [rng.choice(words) for _ in range(6)] + passage + [rng.choice(words) for _ in range(6)]
    assert bool(leaks.Automaton([(1, item)]).find(doc)) == brute_leak(doc, item, leaks.WORDS)


@pytest.mark.parametrize("a, b", [("L’Été, ÇA", "l ete ca"), ("ｌｏｏｓｅ ﬁn", "loose fin"), ("rés­ervoir", "reservoir"), ("Straße", "strasse"), ("ガ", "ｶﾞ"), ("don_t", "don t")])
def test_forms_of_characters(a, b):
    assert leaks.tokens(a) == leaks.tokens(b)


def test_items_and_shared_passages(spark):
    shared = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, f"Choose the best answer.\n{shared} alpha beta gamma delta", "x"), (2, f"{shared} omega psi chi phi", "y"), (3, None, "z"), (4, "", "z"), (5, "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒", "z")], "item_id long, item_text string, doc_id string")
    docs = spark.createDataFrame(
        [(1, f"x {shared.upper().replace(' ', ', ')} y"), (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, ""), (5, "「乙丙、丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪」"), (6, "Choose the best answer. " * 5), (7, ("a " * 60000) + shared), (1, shared), (8, shared.replace("three", "drei") + " alpha"), (None, shared)],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (5, 5), (7, 1), (7, 2), (8, 1), (8, 2), (None, 1), (None, 2)}
    assert leaks.passages(docs, items, block_tokens=1).select("doc_id", "item_id").distinct().count() == len(got)
    span = leaks.passages(docs.where("doc_id = 5"), items).first()
    assert (span.start_pos, span.end_pos, span.edits) == (1, 30, 0)
    assert leaks.leaks(docs, items.where("false")).count() == 0 and leaks.leaks(docs.where("false"), items).count() == 0
    assert leaks.removals(docs, items).where("doc_id = 7").first().drop is False
    garbled = "Où l’été déjà fini, l’élève égaré relève une clé près des prés"
    one = spark.createDataFrame([(1, garbled)], "item_id long, item_text string")
    bad = spark.createDataFrame([(1, garbled.encode().decode("cp1252", "replace"))], "doc_id long, text string")
    assert leaks.leaks(bad.where("text not like '%�%'"), one).count() == (0 if "�" in bad.first().text else 1)


def test_every_passage_is_cut(spark):
    w = [f"w{k}" for k in range(60)]
    one = leaks.Automaton([(1, w)])
    assert one.find(["x", *w[:30], "zzz", *w[31:], "y"]) == {0: [(60, 1, 1, 60)]}
    assert one.find([*w, "x", *w]) == {0: [(60, 0, 0, 59), (60, 0, 61, 120)]}
    assert one.find([*w[:20], *"abcdefghij", *w[40:]]) == {0: [(20, 0, 0, 19), (20, 0, 30, 49)]}
    long = [f"v{k}" for k in range(2000)]
    copy = ["zzz" if k % 12 == 11 else x for k, x in enumerate(long)][:-1]
    assert [s[2:] for s in leaks.Automaton([(1, long)]).find(["x", *copy, "y"])[0]] == [(1, 1999)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w[40:], *"klmnopqrst"]))], "item_id long, item_text string")
    filler = " ".join(f"f{k}" for k in range(400))
    docs = spark.createDataFrame([(1, f"{filler}. {' '.join([*w[:30], 'zzz', *w[31:]])}! {filler} {' '.join(w)} k l m n. {filler}")], "doc_id long, text string")
    text = docs.first().text
    row = leaks.removals(docs, items).first()
    assert row.drop is False and len(row.cuts) == 2
    for a, b in reversed(row.cuts):
        text = text[:a] + text[b:]
    assert text.split() == f"{filler}. ! {filler} . {filler}".split()


def brute_stretches(doc, item, least):
    """Unions of all passages (as in brute_leak) of the document, by place."""
    least, spans = min(least, len(item)), []
    for s in range(len(doc)):
        for a in range(len(item)):
            if doc[s] != item[a]:
                continue
            row = list(range(len(doc) - s + 1))
            for b in range(a + 1, len(item) + 1):
                row, last = [b - a], row
                for k, y in enumerate(doc[s:], 1):
                    row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (item[b - 1] != y)))
                if b - a >= least:
                    spans += [(s, s + k - 1) for k, d in enumerate(row) if k and d * 8 <= b - a and doc[s + k - 1] == item[b - 1]]
    out = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], q)
        else:
            out.append([p, q])
    return out


def test_stretches_against_brute_force():
    """Where they begin and end, with items quoted twice and up to ten edits a copy."""
    counts = [stretch_case(random.Random(seed)) for seed in range(200)]
    assert sum(f for f, _ in counts) >= 0.995 * sum(t for _, t in counts)
    assert all(f >= 0.9 * t for f, t in counts)


def stretch_case(rng):
    item = [f"w{k}" for k in range(rng.choice([14, 30, 64]))]
    doc = ["x"] * rng.randrange(3)
    for _ in range(rng.choice([1, 2])):
        copy = item[rng.randrange(3) :]
        for _ in range(rng.randrange(11)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([["zzz"], [], [copy[k], "zzz"]])
        doc += copy + ["y"] * rng.randrange(20)
    got = leaks.Automaton([(1, item)]).find(doc).get(0, [])
    want = brute_stretches(doc, item, leaks.WORDS)
    # all leaked text lies in a stretch, and no stretch takes in more than the leaks it joins
    inside = lambda spans: {t for p, q in spans for t in range(p, q + 1)}
    found, true = inside([s[2:] for s in got]), inside(want)
    assert found <= true and bool(got) == bool(want)
    return len(found), len(true)


def test_a_short_item_adds_little_work():
    rng = random.Random(1)
    voc = [f"w{k}" for k in range(300)] + ["the"] * 40
    items = [(k, [rng.choice(voc) for _ in range(100)]) for k in range(300)]
    doc = [rng.choice(voc) for _ in range(40000)]

    def seconds(some):
        automaton, times = leaks.Automaton(some), []
        for _ in range(3):
            began = time.perf_counter()
            automaton.find(doc)
            times.append(time.perf_counter() - began)
        return min(times)

    assert seconds([*items, (-1, ["the"])]) < 2 * seconds(items) + 0.05
    assert len(leaks.Automaton([*items, (-1, ["the"])]).find(doc)[300]) == doc.count("the")


def test_coverage_counts_all_leaked_tokens(spark):
    w, f = [f"w{k}" for k in range(40)], [f"f{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(w[:20])), (2, " ".join(w[20:])), (3, "Où l’été déjà fini, l’élève égaré relève une clé près des prés")], "item_id long, item_text string")
    garbled = "Voilà. Où l’été déjà fini, l’élève égaré relève une clé près des prés. Voilà, le reste du texte n’est pas à couper, bien qu’il soit écrit à la même époque que l’autre."
    bad = garbled.encode("utf-8").decode("latin-1").translate({b: bytes([b]).decode("cp1252") for b in set(leaks.CP1252.values())})
    # pieces of 20 words each, together 40 of 70 words; the same text twice, and another one of the same id
    docs = spark.createDataFrame([(1, " ".join([*w[:20], *f, *w[20:]])), (2, " ".join([*w[:20], *f, *w[:9]])), (2, " ".join([*w[:20], *f, *w[:9]])), (2, " ".join([*f, *w[20:]])), (3, bad)], "doc_id long, text string")
    got = {r.doc_id: r for r in leaks.removals(docs, items).collect()}
    assert {k: r.drop for k, r in got.items()} == {1: True, 2: False, 3: False}
    assert leaks.ungarbled(bad) == garbled and len(got[3].cuts) == 1
    (a, b), = got[3].cuts
    assert leaks.ungarbled(bad[:a] + bad[b:]) == garbled.replace("Où l’été déjà fini, l’élève égaré relève une clé près des prés", "")


# sentences

CASES = [
    "The cart left at 10 a.m. Friday. | It closes at 5 p.m. | The end",
    "See Fig. 5 and pp. 88-128 (cf. No. 90) for it. | Next",
    "Mrs. Quillen met Lt. Bresk on Oct. 5, 1901, at 9:13 a.m. sharp. | In 1922. | 14 ferries passed.",
    "It cost $.75 vs. 2.5 in Jan. 1997. | The file map.tar.gz lists 4 ft. 4 in. of rope. | Visit www.a-b.example/v1.0/a.html or write to d.j@t.example now.",
    "It spread through the U.S. and the U.K. within 7.5 years. | D. C. Jastor counted it. | They kept a dock, etc. | The end.",
    "“The bracket counted it!” shouted Velmora. | [The ferry sank.] | The end.",
    "“First one. | Second one.” | Next one. | “Stop! Go,” said he. | Velmora wrote: \"It sank.\" | The end?! | Yes!!",
    "Why did Sorrit stop? | “He forgot the pulley …”, came the reply. | It sank twice… and rose. | It almost ... sank. | It sank... | (It did.)",
    "The dock.| The attic sank.|No mark here",
    "1. The axle sorted it! |\n|2. The loom. |\n|(3) Another one",
    "Um 3.54 Uhr fuhr Fr. Velmora vom 5. Kanal (vgl. Kap. 8.1) ab. | Bresk kam am 4. Juni. | Der 19. Wagen steht i. d. R. in der Pellamstr. 71. | Siehe S. 69 ff. und Nr. 26 bzw. Abb. 4. | Eimer usw. | „Ist das so?“, fragte Orlan. | „So ist es.“ | Ja.",
    "En 31 av. J.-C., le vol. 9 existait déjà… ou presque. | « Quoi encore ! » répond M. Bresk. | « Rien. » | Vers 5 h. 48 à Brindlow, no. 12 bis. | Fin",
    "La Sra. Yarrine llegó a las 8.48 p. m. con Ud. y el Prof. Ninfold. | ¿Cruza?, preguntó Orlan. | ¡Sí! | Véase la pág. 97 (núm. 9.6) del tomo.",
    "Д. П. Тарнвик живёт на ул. Веломорской, д. 8. | Цена 61 тыс. крон, т. к. гл. 2 утеряна. | Вёдра и т. д. | «Да!» — сказал Орлан. | Конец.",
    "Ο κ. Βελμόρας μένει εκεί, αρ. 71. | Ως το 58 π.Χ. με κ.ά. εργαλεία. | «Γιατί;» ρώτησε ο δρ. Όρλαν. | Πού; | Εδώ.",
    "«معا؟» سأل أورلان. | «برميل.» | عد ببطء. | قال د. فلمور إن ص. 89 والجزء 8.4؛ دون.",
    "“पास?” ओर्लन ने पूछा। | इसका भार 7.9 कि. ग्रा. है। | श्री के. पी. वेल्मोर पास।",
    "第7.4版由A. B. Orlan公司修订。| “窗帘！”她喊道，后面。| 他说：“晒干。”| 石头。| 露台……狭窄的果园。| （沙地。）| 工坊（见第6.5节），冰川？！",
    "波止場にいます（第4.8節を参照。）古いいます。| 「あとで。」と言った。| 「風が？」| 雲の『いい！』は73円で。| 羅針盤をいます……| 蝋燭の棚。",
    "ร่มทุ่งหญ้า | หน้าต่างแผนที่ 439 ทะเล | ทองแดง",
]


def units(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("start_pos", F.lit("clash"))
    out = {}
    for r in S.sentence_units(docs.drop("start_pos")).collect():
        out.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    return [sorted(out.get(k, [])) for k in range(len(texts))]


def meant_units(case):
    text, spans = "", []
    for part in case.split("|"):
        start = len(text) + len(part) - len(part.lstrip(" "))
        text += part
        if part.strip():
            spans.append((start, start + len(part.strip(" "))))
    return text, spans


def test_sentence_cases(spark):
    texts, want = zip(*[meant_units(c) for c in CASES])
    got = units(spark, texts)
    for text, g, w in zip(texts, got, want):
        assert [text[a:b] for a, b in g] == [text[a:b] for a, b in w]
        assert g == list(w)


def test_sentences_of_odd_texts(spark):
    long_ = "A cart left. " * 3000
    texts = ["", None, " \n 　", "\r\nA.   Über 3\nzwei\r\n", "...", long_, "x" * 50000, ".", "🚢 left. 🚢 came."]
    got = units(spark, texts)
    assert got[:5] == [[], [], [], [(2, 4), (7, 13), (14, 18)], [(0, 3)]]
    assert got[5] == [(13 * k, 13 * k + 12) for k in range(3000)] and got[6] == [(0, 50000)] and got[7] == [(0, 3)] and got[8] == [(0, 7), (8, 15)]


def test_garbled_text_has_the_units_meant(spark):
    good = "Der Kessel fällt. Größer ist „nichts“, sagte sie. Brücke"
    bad = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in good.encode())
    want = [(len(good[:a].encode()), len(good[:b].encode())) for a, b in units(spark, [good])[0]]
    assert units(spark, [bad]) == [want]
    russian = "«Да!» — сказал Орлан. Цена 61 тыс. крон. Конец"
    assert units(spark, [russian.replace("—", "-").encode("cp1251").decode("koi8-r")]) == units(spark, [russian.replace("—", "-")])


@has_data
def test_units_cover_every_text(spark):
    """Units don't overlap, and no character but blanks is left out."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text is not null")
    texts = dict(map(tuple, docs.collect()))
    found = {}
    for r in S.sentence_units(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for doc, text in texts.items():
        at = 0
        for a, b in sorted(found.get(doc, [])):
            assert at <= a < b <= len(text) and not text[at:a].strip(S.BLANKS)
            at = b
        assert not text[at:].strip(S.BLANKS)


def garble(text):
    return text.encode().decode("latin-1").translate({b: bytes([b]).decode("cp1252") for b in set(leaks.CP1252.values())})


@pytest.mark.parametrize("first, again", [("“Stop!” he said. ", "A cart left the dock. "), ("", "“Stop! Go!” he said. A cart left. "), ("", garble("“Größe!” he said. Über die Brücke. ")), ("", "“窗帘！”她喊道，后面。露台……狭窄的果园。"), ("", ".")])
def test_sentences_take_time_in_proportion_to_the_line(spark, first, again):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def cpu():  # of the JVM, so that other work on the machine doesn't count
        with open(f"/proc/{pid}/stat") as f:
            return sum(map(int, f.read().rpartition(")")[2].split()[11:13])) / os.sysconf("SC_CLK_TCK")

    def seconds(n):
        one = spark.createDataFrame([(1, (first + again * (n // len(again))) + "a")], "doc_id int, text string")
        began = cpu()
        S.sentences(one).agg(F.sum(F.length("sentence"))).collect()
        return cpu() - began

    seconds(600_000)  # compiled by then
    fixed = min(seconds(100) for _ in range(2))
    half, whole = (min(seconds(n) for _ in range(2)) - fixed for n in (300_000, 600_000))
    assert whole <= 2.9 * max(half, 0.5) + 4, (fixed, half, whole)  # some seconds for the compiler and garbage; 4 times, and minutes, if it were quadratic


def test_restored_sentences(spark):
    texts = ["Τι; Ναι\u037e Ο δρ. Α. “Ή! όχι.”, είπε", "第7.4版……狭窄（见。）他：“晒干！”她说。", "Was? ask?x=1 “Eins! zwei.”, sagte er… und"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in S.sentences(docs).collect():
        assert r.sentence == texts[r.doc_id][r.start_pos : r.end_pos]
    docs = spark.createDataFrame([(1, "Mr. A left. It was 3.5!")], "doc_id int, text string")
    assert sorted(r.sentence for r in S.sentences(docs).collect()) == ["It was 3.5!", "Mr. A left."]
