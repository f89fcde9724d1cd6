import itertools
import math

from gaugeworks.llm import license_scan as L

NOTICES = [text for _, text, _ in L.TEMPLATES]
TEXTS = [
    None, "", "   ", "plain words only", "All rights reserved.", "ALL-RIGHTS reserved all rights\nreserved", "small rights reserved",
    "cc by cc-by CC BY 4", "accc by", "GNU General  Public License", "general public licenses",
    "x Released under the MIT License. y", "the mit license", "Licensed under the Apache License, Version 2.0.",
    "apache foo license", "This work is licensed under the GNU General Public License, version 3", "éall rights reserved",
    "all rights reserved" + " pad" * 3000 + " released under the MIT License", "İ K all rights reserved", "mit\x00license released under the mit license",
]


def brute(texts):
    """Every template at every offset of every text; no index."""
    words = [L.words_of(t or "") for t in texts]
    weights = {v: math.log((2 + len(texts)) / (1 + sum(v in w for w in map(set, words)))) for v in L.vocabulary()}
    out = []
    for w in words:
        base = sorted((i, lab) for p, lab in L.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        labels, score = {lab for _, lab in base}, 0.5 if base else 0.0
        where = {}
        for i, x in enumerate(w):
            where.setdefault(x, []).append(i)
        for label, text, phrases in L.TEMPLATES:
            own = L.words_of(text)
            total = math.fsum(weights[x] for x in own)
            held = {}
            for k, x in enumerate(own):
                for i in where.get(x, ()):
                    held.setdefault(i - k, []).append(k)
            for o, places in held.items():
                share = sum(weights[own[k]] for k in places) / total if total else 1.0
                spots = [next(k for k in range(len(own)) if own[k : k + len(p)] == p) for p in map(L.words_of, phrases)]
                keys = {k + j for k, p in zip(spots, phrases) for j in range(len(L.words_of(p)))}
                if keys <= set(places) and share >= L.SHARE:
                    labels.add(label)
                    score = max(score, min(share, 1.0))
        out.append((len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)))
    return out


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, licence string, words string")
    rows = L.report(docs).orderBy("doc_id").collect()
    return [(*tuple(r)[1:-1], round(r["score"], 9)) for r in rows]


def documents(spark, small_dir):
    return [r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]


def damaged(notice):
    """The notice with one word replaced, left out, put in, and with its beginning or end gone."""
    words = notice.split()
    for k in range(0, len(words), 2):
        yield " ".join([*words[:k], "other", *words[k + 1 :]])
        yield " ".join(words[:k] + words[k + 1 :])
        yield " ".join([*words[:k], "more", *words[k:]])
    yield " ".join(words[2:])
    yield " ".join(words[:-2])


def test_against_brute_force(spark):
    assert scanned(spark, TEXTS) == brute(TEXTS)


def test_against_brute_force_on_documents(spark, small_dir):
    texts = documents(spark, small_dir)
    got = scanned(spark, texts)
    assert got == brute(texts)
    assert {"mit", "apache-2.0"} <= {x for r in got for x in r[5].split(",")}


def test_damaged_notices_against_brute_force(spark, small_dir):
    texts = documents(spark, small_dir) + [d for n in NOTICES for d in damaged(n)]
    got = scanned(spark, texts)
    assert got == brute(texts)
    assert any(0.8 <= r[6] < 1 for r in got)


def test_several_notices_among_chance_words(spark, small_dir):
    chance = " source code copy person software granted creative attribution gnu mozilla version 3 terms 2 0 apache binary " * 40
    mixed = [" -- ".join(pair) for pair in itertools.combinations(NOTICES, 2)] + [" -- ".join(NOTICES)]
    texts = documents(spark, small_dir) + mixed + [chance + x + chance for x in NOTICES] + [x + " pad" * 5000 + chance for x in NOTICES[::-1]]
    got = scanned(spark, texts)
    assert got == brute(texts)
    by_text = dict(zip(texts, got))
    for (a, one, _), (b, two, _) in itertools.combinations(L.TEMPLATES, 2):
        assert {a, b} <= set(by_text[f"{one} -- {two}"][5].split(","))


def test_mentions_give_no_label(spark, small_dir):
    mentions = [
        "we do not use the mit license here", "this work says apache license only", "the mozilla public license is long",
        "source and binary forms are not wanted", "creative commons and eclipse public license differ",
    ]
    got = scanned(spark, documents(spark, small_dir) + mentions)[-len(mentions) :]
    assert [(r[5], r[6]) for r in got] == [("", 0.0)] * len(mentions)


def test_words_of_no_text_weigh_most():
    weights = dict.fromkeys(L.vocabulary(), 1.0) | {"mozilla": 9.0, "eclipse": 5.0}
    index = L.index_of(weights)
    assert all(any(q["t"] == t for places in index["postings"].values() for q in places) for t in range(len(L.TEMPLATES)))
    assert {"mozilla", "eclipse"} <= set(index["postings"])
    assert sum(map(len, index["postings"].values())) < sum(len(t["words"]) for t in index["templates"])


def test_empty_table(spark):
    assert scanned(spark, []) == []
