import hashlib
import random
import re

import pytest
from cases import SCHEMA, nasty_rows, prose

from chunkwise.llm import decontaminate, exact_dedup, url_filter


@pytest.mark.parametrize("keep", ["max", "min"])
def test_content_sort(spark, keep):
    rows = [r[:2] for r in nasty_rows()]
    out = exact_dedup.content_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep=keep).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""), []).append(i)
    for r in out:
        norm = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        ids = [i for i in groups[norm] if i is not None]
        assert r["group_size"] == len(groups[norm])
        assert r["keep_id"] == ((max if keep == "max" else min)(ids) if ids else None)
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    kept = [r["text_sha256"] for r in out if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_hot_texts_are_salted(spark):
    assert exact_dedup.hot_hashes(spark.createDataFrame(nasty_rows(), SCHEMA), "text")


def test_deduplicate_carries_clashing_columns(spark):
    df = spark.createDataFrame(nasty_rows(), SCHEMA)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns and out.count() == len({(t or "").lower() for _, t, *_ in nasty_rows()})
    with pytest.raises(ValueError):
        exact_dedup.content_sort(df)
    assert exact_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1?x=/de/", "http://example.org", "http://example.org/", "http://a.example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/",
    "http://x.com/FR/", "http://x.com/de/?q", "http://com/de/#f", "http://www.casino-win.com/en/", "http://cheap-pills.org/es/", "x://a://b.org/", "http://x.org:80/", "http://x.com?/de/", "http://ÄB.org/é",
]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest)[0]) :])[0]
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    labels = [set(re.findall("[a-z0-9]+", x)) for x in host.split(".")[:-1]]
    spam = any(x & set(url_filter.STRONG) or len(x & set(url_filter.WEAK)) > 1 for x in labels)
    return url, host, path, rule, rules.get(rule) or ("block" if spam else "allow")


@pytest.mark.parametrize("chunk,literals", [(4096, 20_000), (3, 20_000), (4096, 10)])
def test_url_filter(spark, monkeypatch, chunk, literals):
    df = spark.createDataFrame([(u, i, "old") for i, u in enumerate(URLS * 2)], "url string, page_id long, verdict string")
    rules = [*url_filter.CONTRACT, *url_filter.SPAM[:: 1 if chunk > 3 else 40]]
    monkeypatch.setattr(url_filter, "CHUNK", chunk)
    monkeypatch.setattr(url_filter, "LITERALS", literals)
    got = [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, "url", rules).collect()]
    want = sorted(map(brute_verdict, URLS * 2), key=str)
    assert sorted(got, key=str) == want if chunk > 3 else [g[:4] for g in sorted(got, key=str)] == [w[:4] for w in want]
    assert url_filter.judge(df.limit(0), "url", rules).collect() == []
    assert {r["verdict"] for r in url_filter.judge(df, "url", []).collect()} == {"allow"}


@pytest.mark.parametrize("literals", [20_000, 1])
def test_url_filter_carries_columns_of_any_name(spark, monkeypatch, literals):
    monkeypatch.setattr(url_filter, "LITERALS", literals)
    df = spark.createDataFrame([("http://www.casino-win.com/en/", 1, 2, 3, 4, 5)], "`a.b` string, _won int, HOST int, `x``y` int, _url int, Key int")
    out = url_filter.judge(df, "a.b", url_filter.SPAM)
    assert out.columns == ["a.b", "_won", "x`y", "_url", "Key", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in out.collect()] == [("http://www.casino-win.com/en/", 1, 3, 4, 5, "www.casino-win.com", "/en/", None, "block")]


LINES = {
    "||example.com^": (["http://example.com/", "http://a.example.com", "http://example.com:80/x"], ["http://example.community/", "http://badexample.com/"]),
    "||ads.*.net/banner": (["http://ads.x.net/banner", "http://b.ads.x.y.net/banners/1"], ["http://ads.net/banner", "http://ads.x.net/Banner"]),
    "/track/*.gif|": (["http://x.org/track/a.gif"], ["http://x.org/track/a.gifs", "http://x.org/track.gif"]),
    "|shop.": (["http://shop.example.org/"], ["http://a.shop.example.org/"]),
    "promo^": (["http://x.org/promo/", "http://x.org/autopromo", "http://x.org/my-promo"], ["http://x.org/promos"]),
    "@@||example.com/help": (["http://example.com/help/me"], []),
}


@pytest.mark.parametrize("literals", [20_000, 1])
def test_filter_lists(spark, monkeypatch, tmp_path, literals):
    monkeypatch.setattr(url_filter, "LITERALS", literals)
    (tmp_path / "list.txt").write_text("! a list\n\n# words\n" + "\n".join(LINES) + "\n||example.com^\n")
    rules = url_filter.load(spark, f"file://{tmp_path}/list.txt")
    assert [r.name for r in rules] == list(LINES)
    cases = [(u, line, fits) for line, both in LINES.items() for fits, urls in zip((True, False), both, strict=True) for u in urls]
    for r in rules:
        one = {x["url"]: x["rule"] for x in url_filter.judge(spark.createDataFrame([(u,) for u, line, _ in cases if line == r.name], "url string"), "url", [r, *url_filter.CONTRACT[:0]]).collect()} if literals > 1 else {}
        assert all((one[u] == r.name) == fits for u, line, fits in cases if line == r.name and one)
    every = {x["url"]: (x["rule"], x["verdict"]) for x in url_filter.judge(spark.createDataFrame([(u,) for u, *_ in cases], "url string"), "url", rules).collect()}
    assert every["http://example.com/help/me"] == ("@@||example.com/help", "allow") and every["http://example.com/"] == ("||example.com^", "block")
    with pytest.raises(ValueError):
        url_filter.pattern_rule("||a.example^$third-party")


def brute_containment(docs, items, k, threshold):
    def cut(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        return {(len(w[i : i + k]), *w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    out = []
    for d, t in docs:
        have = cut(t)
        for i, u in items:
            want = cut(u)
            if want and len(have & want) >= threshold * len(want):
                out.append((d, i, len(have & want), len(want)))
    return sorted(out, key=str)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 4, 5, 6, 8, 9, 12, 13, 14, 20, 21, 30, 45, 60, 70, 140, 300])]
    items += [(100, items[12][1].upper() + "!"), (101, None), (102, ""), (103, items[12][1]), (None, items[9][1])]
    docs = [(i, t) for i, t, *_ in nasty_rows()]
    for n, (i, t) in enumerate(items[:20] * 3):
        words = (t or "").split()
        for _ in range(n // 20):  # changed words
            if len(words) > 20:
                words[rng.randrange(len(words))] = "other"
        body = prose(rng, rng.choice([0, 30, 4000])).split()
        at = rng.randint(0, len(body))
        docs.append((2000 + n, " ".join(body[:at] + words + body[at:])))
    docs.append((None, items[14][1]))
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute_containment(docs, items, 5, 0.8)
    got = [(r["id"], r["item"], r["shared"], r["shingles"]) for r in decontaminate.find(d, i).collect()]
    assert sorted(got, key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)  # many blocks of items
    got = [(r["id"], r["item"], r["shared"], r["shingles"]) for r in decontaminate.find(d, i).collect()]
    assert sorted(got, key=str) == want
    rows = [(x, t, "k", 1, 1.0) for x, t in docs]
    kept = decontaminate.remove(spark.createDataFrame(rows, SCHEMA), i)
    assert kept.columns == ["doc_id", "text", "keep_id", "_key", "group_size"]
    bad = {str(x) for x, *_ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x) for x, _ in docs if str(x) not in bad - {"None"} and not (x is None and _ == items[14][1]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.find(empty, i).collect() == [] and decontaminate.find(d, empty.withColumnRenamed("doc_id", "item_id")).collect() == []
