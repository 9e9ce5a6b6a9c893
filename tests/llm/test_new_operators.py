"""The URL filter, whitening and collocations against plain versions, and on hard tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlight.llm import collocations, queries, url_filter, whitening

# --- collocations -------------------------------------------------------------


def plain_collocations(rows, max_n=3, least=10, share=0.5, top=2000):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, max_n + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("max_n,least", [(3, 10), (4, 3), (2, 2)])
def test_collocations_match_a_plain_version(spark, max_n, least):
    rng = random.Random(max_n)
    words = ["a", "B", "Ç", "ç", "c-d", "É", "x.y", "new", "York", "city"]
    rows = []
    for i in range(200):
        text = "".join(rng.choice(["new York city", *words]) + rng.choice([" ", "  ", "\t", ", ", "\n", "! ", " "]) for _ in range(rng.choice([0, 1, 5, 40])))
        rows.append((i % 50, text if i % 17 else None, rng.choice(["en", "fr", "und", None])))
    docs = spark.createDataFrame(rows + rows[:20], "doc_id int, text string, lang string")
    out = collocations.collocations(docs, max_n=max_n, least=least, top=30)
    want = plain_collocations([r[1:] for r in rows + rows[:20]], max_n, least, top=30)
    assert sorted(tuple(r[c] for c in NAMES) for r in out.collect()) == want and len(want) > 5
    assert [t for _, t in out.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5


def test_collocations_on_hard_tables(spark):
    names = "_lang string, _phrase string, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], names)).count() == 0
    rows = [("x", "y", None, None), ("x", "y", " .. ", "en"), ("x", "y", "of the " * 40_000, None)]
    found = collocations.collocations(spark.createDataFrame(rows, names)).collect()
    assert {(r["lang"], r["n"]) for r in found} == {("und", 80_000)}
    assert [(r["phrase"], r["a"]) for r in found] == [("of the of", 39_999), ("the of the", 39_999)]


def test_scores_beyond_64_bits_are_exact(spark):
    rng = random.Random(3)
    rows = [(a := rng.randrange(1, 10**13), a + rng.randrange(10**12), a + rng.randrange(10**14)) for _ in range(50)] + [(10**16 - 1, 10**16 - 1, 10**16)]
    out = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").withColumn("s", collocations.score("a", "l", "r")).collect()
    assert all(x["s"] == 10**6 * x["a"] ** 2 // (x["l"] * x["r"]) for x in out)


def test_phrases_become_rows_once_a_stretch(spark):
    """Not once an occurrence: each row costs CPU time from its making to its sum."""
    docs = spark.createDataFrame([("en", "of the " * 5_000)] * 8, "_lang string, _text string").coalesce(1)
    rows = {bytes(r["_key"]): r["_f"] for r in collocations.phrases(docs, (0, 1, 2, 3)).collect()}
    assert rows == {b"\nen": 80_000, b"of\nen": 40_000, b"the\nen": 40_000, b"of the\nen": 40_000, b"the of\nen": 39_992, b"of the of\nen": 39_992, b"the of the\nen": 39_992}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_stretches_cut_no_phrase(spark, size):
    rng = random.Random(size)
    texts = ["", "ab", "AB", "cd\x00e f", " \t", ".", "É é,É é", "x y z " * 30, "one piece, two  pieces!\nthree\tand\x0bfour"]
    rows = [(rng.choice(["en", "", "e n\n", "und", None]), rng.choice([*texts, None])) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("coalesce(lang, 'und') _lang", "text _text").filter("_text IS NOT NULL").coalesce(2)
    found = Counter()
    for r in collocations.phrases(docs, (0, 1, 2, 4), size).collect():
        found[bytes(r["_key"])] += r["_f"]
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            for m in (0, 1, 2, 4):
                want.update((" ".join(w[i : i + m]) + "\n" + ("und" if lang is None else lang)).encode() for i in range(len(w) - max(m, 1) + 1))
    assert found == want


def test_wide_phrases_keep_their_words(spark):
    """Numbers of long phrases are made anew before they pass 64 bits."""
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([("en", " ".join(words))] * 2, "_lang string, _text string").coalesce(1)
    rows = {bytes(r["_key"]).decode(): r["_f"] for r in collocations.phrases(docs, (9,)).collect()}
    assert rows == {" ".join(words[i : i + 9]) + "\nen": 2 for i in range(2992)}


# --- whitening ----------------------------------------------------------------


def plain_whitening(rows, components=4):
    sound = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in sound}), dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    cov = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return {(i, k + 1): (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)), (np.array(v) - s / n) @ u[:, k] / math.sqrt(e[k]), e[k] / np.trace(cov)) for i, v in sound for k in range(len(e))}


@pytest.mark.parametrize("dims,tile,block", [(7, 3, 16), (5, 5, 1000), (9, 4, 7)])
def test_whitening_matches_a_plain_version(spark, dims, tile, block):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0, 1 + d) for d in range(dims)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(100)]  # a hot vector counts once in the fit
    rows += [(900, None), (901, [None] + [0.0] * (dims - 1)), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, [-0.001] + [0.0] * (dims - 1))]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5), tile=tile, row_block=block).collect()
    want = plain_whitening(rows)
    assert {(r["vec_id"], r["component"]) for r in out} == set(want) and len(out) == len(want)
    signs = {k: np.sign(sum(r["whitened"] * want[r["vec_id"], k][2] for r in out if r["component"] == k)) for k in range(1, 5)}
    for r in out:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["whitened"] * signs[r["component"]] == pytest.approx(whitened, abs=1e-9) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_of_the_query_matches_a_plain_version(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = plain_whitening(rows)
    out = queries.op12_whitening(spark, sf_dir).collect()
    assert {(r["vec_id"], r["component"]): (r["n"], r["deviation"]) for r in out} == {k: v[:2] for k, v in want.items()}
    assert all(abs(abs(r["whitened"]) - abs(want[r["vec_id"], r["component"]][2])) < 1e-8 for r in out)


def test_whitening_on_hard_tables(spark):
    kind = "vec_id string, x int, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", 1, [1.0, 2.0])] * 3, kind)).count() == 0  # one distinct vector
    rows = [("a", 1, [1.0, 2.0]), (None, 1, [3.0, 2.0]), ("c", 1, [5.0, 2.0, 1.0]), ("d", 1, []), ("a", 1, [1.0, 2.0])]
    out = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"], abs(round(r["whitened"], 9))) for r in out) == [("None", 1, 2, 1.0), ("a", 1, 2, 1.0), ("a", 1, 2, 1.0)]
    large = [("a", 1, [1e30, 0.0]), ("b", 1, [0.0, 1.0])]
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(large, kind)).collect()} == {None}


# --- URL filter ---------------------------------------------------------------


def plain_parts(url):
    after = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", after)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", after[len(host) :])[0] if after[len(host) :][:1] == "/" else ""


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)


def plain_filter(urls, rules=url_filter.RULES, support=3, share=0.02, weight=4.0, reject=0.25):
    """(host, path, rule, verdict, template) of each URL, from trees held in dictionaries."""
    rows = []
    for url in urls:
        host, path = plain_parts(url)
        rule = plain_rule(host, path, rules)
        rows.append({"host": host, "path": path, "rule": rule, "rest": path.removeprefix("/").split("/") if path else [], "template": ""})
    good = lambda rs: sum(1 for r in rs if r["rule"] and r["rule"].allow)
    known = lambda rs: sum(1 for r in rs if r["rule"])
    by_host = defaultdict(list)
    for r in rows:
        by_host[r["host"]].append(r)
    for rs in by_host.values():
        for r in rs:
            r["purity"] = (good(rs) + weight * 0.5) / (known(rs) + weight)
    while going := [r for r in rows if r["rest"]]:
        nodes = defaultdict(list)
        for r in going:
            nodes[r["host"], r["template"]].append(r)
        for rs in nodes.values():
            enough = max(support, share * len(rs))
            segs = [r["rest"][0].replace("{", "%7B").replace("}", "%7D") for r in rs]
            shapes = [re.sub("[0-9]+", "{*}", s) for s in segs]
            seg_n, shape_n = Counter(segs), Counter(h for s, h in zip(segs, shapes) if s != h)
            kinds = [re.sub("[0-9]+", "0", re.sub("[^0-9.]+", "a", r["rest"][1])) if len(r["rest"]) > 1 else "$" for r in rs]
            names = [s if seg_n[s] >= enough else h if shape_n[h] >= enough else "{*}" for s, h in zip(segs, shapes)]
            pool, groups = Counter(kinds), defaultdict(list)
            for b in set(names):
                own = [r for r, x in zip(rs, names) if x == b]
                seen = Counter(k for k, x in zip(kinds, names) if x == b)
                chi = sum((seen[k] - len(own) * pool[k] / len(rs)) ** 2 / (len(own) * pool[k] / len(rs)) for k in pool)
                df, g, n = len(pool) - 1, good(rs), known(rs)
                if known(own) and 0 < g < n:
                    df += 1
                    for got, all_ in ((good(own), g), (known(own) - good(own), n - g)):
                        chi += (got - known(own) * all_ / n) ** 2 / (known(own) * all_ / n)
                like = not df or round(chi, 9) <= df * (1 - 2 / (9 * df) + 3.09 * math.sqrt(2 / (9 * df))) ** 3
                groups["" if like else b].append(b)
            for members in groups.values():
                own = [r for r, x in zip(rs, names) if x in members]
                name = members[0] if len(members) == 1 else "{" + "|".join(sorted(members)) + "}"
                below = (good(own) + weight * own[0]["purity"]) / (known(own) + weight)
                for r in own:
                    r |= {"template": f"{r['template']}/{name}", "rest": r["rest"][1:], "purity": below}
    return [(r["host"], r["path"], r["rule"] and r["rule"].host + r["rule"].path, "allow" if (r["rule"].allow if r["rule"] else r["purity"] >= reject) else "block", r["template"]) for r in rows]


def judged(spark, urls, **kw):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, _host string")
    out = url_filter.url_filter(pages, **kw).collect()
    return [tuple(r[c] for c in ("host", "path", "rule", "verdict", "template")) for r in sorted(out, key=lambda r: r["page_id"])]


def test_url_filter_matches_a_plain_version(spark):
    rng = random.Random(5)
    hosts = ["A.example.com", "b.example.com", "spam.example.com", "x.example.org", "example.org", "org", "notorg", "y.net", "com"]
    urls = []
    for i in range(900):
        h = hosts[min(int(rng.expovariate(0.5)), 8)]
        lang = "de" if h.startswith("spam") and rng.random() < 0.7 else rng.choice(["en", "es", "fr", "de", "it"])
        tail = rng.choice([f"/{lang}/{i}", f"/{lang}/{i}.html", f"/{lang}/{i}/", f"/{lang}/post-{i % 7}/{rng.choice('abc')}", f"/{lang}", "/", "", f"/q{i}/z", "/{x}/y"])
        urls.append(f"http://{h}{tail}{rng.choice(['', '?a=/de/', '#top', '#?'])}")
    urls += [None, "", "example.org/es/1", "://", "http://", "x://com/fr/?", "http://u@com:80/fr/1", "http://com?/fr/", "http://com#/fr/", "a://b://com/fr/"]
    found = judged(spark, urls)
    assert found == plain_filter(urls)
    verdicts = Counter((rule, verdict) for _, _, rule, verdict, _ in found)
    assert verdicts[None, "block"] > 10 and verdicts[None, "allow"] > 100
    assert "block" in {v for h, _, rule, v, _ in found if rule is None and h == "spam.example.com"}


def test_url_filter_of_the_query_matches_a_plain_version(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").orderBy("page_id").collect()
    out = sorted(queries.op11_url_filter(spark, sf_dir).collect(), key=lambda r: r["page_id"])
    assert [tuple(r[c] for c in ("host", "path", "rule", "verdict", "template")) for r in out] == plain_filter([p["url"] for p in pages])


def test_url_filter_on_hard_tables(spark):
    assert judged(spark, []) == []
    deep = "http://h.org/" + "/".join(str(i) for i in range(40))
    (host, path, rule, verdict, template), = judged(spark, [deep], depth=4)
    assert (host, rule, verdict, template) == ("h.org", "org/", "allow", "/{*}/{*}/{*}/{*}") and path == deep[12:]
    long = f"http://h.org/{'a' * 100_000}"
    assert [r[:4] for r in judged(spark, [long, long])] == [("h.org", long[12:], "org/", "allow")] * 2
    tied = (url_filter.Rule("a.org", "/x", True), url_filter.Rule("org", "/x/yz", False), url_filter.Rule("org", "/x/yz", True))
    assert judged(spark, ["q://a.org/x/yz"], rules=tied)[0][2:4] == ("org/x/yz", "block")
