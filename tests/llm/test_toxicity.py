import math
import random

import pytest
from cases import SCHEMA, nasty_rows, prose

from chunkwise.llm import toxicity


def test_fold():
    assert toxicity.without_marks(toxicity.fold("1D10T ｉｄｉｏｔ iｄ​ïot")).split() == ["idiot"] * 3
    assert toxicity.fold("mоrоn").split() == ["moron"]  # Cyrillic o
    assert toxicity.fold(None) == "  " and toxicity.fold("").strip() == ""
    assert toxicity.fold("你好。idiot，再见").split() == ["你好", "idiot", "再见"]
    for text in ("𝐢𝐝𝐢𝐨𝐭", "𝓘𝓓𝓘𝓞𝓣", "ⓘⓓⓘⓞⓣ", "ＩＤ１０Ｔ".replace("Ｔ", "Ｏt"), "ıdıot", "i\u00addiot"):
        assert toxicity.without_marks(toxicity.fold(text)).split()[0].startswith("idio"), text
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    assert set(toxicity.fold(every)) & set("!$%&()*+,-./:;<=>?[]^_`{|}~@。，、！？「」–—…“”🙂") == set()


def brute_sum(text, model):
    folded = toxicity.fold(text)
    spans = [(i, i + len(p)) for p in map(toxicity.fold, model.exceptions) for i in range(len(folded)) if folded.startswith(p, i)]
    return sum(w for t, w in model.terms for i in range(len(folded)) if folded.startswith(t, i) and not any(a <= i and i + len(t) <= b for a, b in spans))


def test_matching_against_brute_force():
    model = toxicity.Model(((" clown ", 2.0), (" idio", 1.5), (" trash", 1.0)), factors=(-2.0, 1.0, 0.5))
    matcher = toxicity.Matcher(model)
    for text in ["", None, "clown clown, clown", "clown fish", "a clown fish clown", "idiotic 1diots", "trash can trash", "clowns"]:
        x, y = matcher.features(text)
        assert x == pytest.approx(math.log1p(brute_sum(text, model)))
        assert 0 <= matcher.score(text) <= 1
    long = "word " * 400
    assert matcher.score("you clown") > matcher.score(long + "you clown") > matcher.score(long)


def labelled(spark, n=600):
    rng = random.Random(7)
    words = ["zorgle", "blarfing", "blarfed", "blarfs"]
    docs, labels = [], []
    for i in range(n):
        body = prose(rng, rng.randint(5, 200)).split()
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            body.insert(rng.randint(0, len(body)), rng.choice(words).replace("o", rng.choice("o0")).upper())
        docs.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0), (None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, l)
    assert {t.strip() for t, _ in model.terms} <= {"zorgle", "blar", "blarf", "blarfi", "blarfe", "blarfing", "blarfed", "blarfs"}
    truth = dict(labels)
    got = {r["id"]: r["score"] for r in toxicity.scored(d, model).collect()}
    assert all((s >= 0.5) == bool(truth[i]) for i, s in got.items())
    kept = toxicity.keep_clean(d, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in labels if not x}


def brute_terms(rows, least):
    """Words by how many distinct toxic and other texts hold them, counted plainly."""
    found = {}
    for text, label in set(rows):
        for word in set(text.lower().split()):
            found.setdefault(word, [0, 0])[label] += 1
    return {w for w, (other, toxic) in found.items() if toxic >= least and not other}


def test_copies_count_once(spark):
    rng = random.Random(5)
    rows = [(f"{prose(rng, 60)} zorgle {prose(rng, 60)}", 1) for _ in range(100)] + [(prose(rng, 120), 0) for _ in range(600)]
    junk = f"{prose(rng, 100)} qwertzuiop {prose(rng, 100)}"
    rows += [(junk, 1)] * 60 + [(f"{junk} {prose(rng, 2)}", 1) for _ in range(60)]  # one text, copied and nearly copied
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert {t.strip() for t, _ in model.terms} <= {"zorgle"[:n] for n in range(4, 7)}
    assert "zorgle" in brute_terms([r for r in rows if "qwertz" not in r[0]], 50)


def test_rare_terms_are_taken_on_their_evidence(spark):
    rng = random.Random(6)
    rare = [f"zz{prose(rng, 1)}{i}zz" for i in range(30)]
    rows = [(f"{prose(rng, 30)} {rare[i % 30]} {prose(rng, 30)}", 1) for i in range(600)] + [(prose(rng, 60), 0) for _ in range(3000)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    matcher = toxicity.Matcher(model)
    assert all(matcher.score(f"a text with {toxicity.fold(w).strip()} in it") >= 0.5 for w in rare)
    assert sum(matcher.score(t) >= 0.5 for t, label in rows if not label) <= 3


def test_exceptions_are_learned(spark):
    rng = random.Random(8)
    rows = [(f"{prose(rng, 40)} zorgle {prose(rng, 40)}", 1) for _ in range(300)]
    rows += [(f"{prose(rng, 40)} zorgle bridge {prose(rng, 40)}" if i < 25 else prose(rng, 80), 0) for i in range(2000)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert "zorgie bridge" in model.exceptions or "zorgle bridge" in model.exceptions
    matcher = toxicity.Matcher(model)
    assert matcher.score("we walked over the zorgle bridge at night") < 0.5 <= matcher.score("what a zorgle you are my friend")


def test_nasty_rows(spark):
    df = spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3)
    docs, labels = labelled(spark, 200)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.scored(df, model).collect()
    assert len(out) == len(nasty_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.keep_clean(df, model).columns == df.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.scored(empty, model).collect() == []
    nothing = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.scored(df, nothing).collect()} == {0.0}
