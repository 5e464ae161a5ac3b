"""Line rules, url cascade, leaks, page text, toxicity, quality and the language model, against plain Python."""

import itertools
import os
import random
import re

import numpy as np
import pytest

from factorloom.llm import decontaminate, html_main, line_rules, masked_lm, quality, toxicity, url_cascade
from factorloom.llm.common import held_out

WORDS = re.compile("[^\x20\x09-\x0D]+")
ODD = [(1, None, "s"), (2, "", "s"), (None, "  \n\t", None), (3, "x " * 40_000, "s"), (4, "a b c", "s"), (4, "a b c", "s")]


# ---- line rules

def slow_base(text):
    words = WORDS.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_stats(frame):
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b c a b c", "a a a a", "x\n x\nx\n\ny\x0by", "#a <b>|é😀\x85 $ %&*"]
    texts += ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    got = line_rules.base_stats(frame([(i, t) for i, t in enumerate(texts)])).collect()
    for r in got:
        n = slow_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])


def line_docs():
    own = lambda i, k: " ".join(f"w{i}x{k}y{j}" for j in range(20))
    rows = [(i, f"{own(i, 0)}\nShared footer line\n{own(i, 1)}\n{own(i, 2)}", "hot") for i in range(40)]
    rows += [(100 + i, "Shared footer line\n" * 30 + own(i, 9), "hot") for i in range(3)]
    rows += [(200 + i, "\n".join(own(7, k) for k in range(5)), "hot") for i in range(60)]  # copies are no boilerplate
    rows += [(300 + i, "\n".join(own(8, k) for k in range(5)) + f"\nend {i}", "hot") for i in range(60)]  # nor near copies
    return rows


def test_frequent_lines_and_depletion(frame):
    df = frame(line_docs())
    kept = {r["doc_id"]: r["kept"] for r in line_rules.judge(df).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(3))
    assert all(kept[200 + i] and kept[300 + i] for i in range(60))
    texts = {r["doc_id"]: r["text"] for r in line_rules.clean(df).collect()}
    assert set(texts) == {i for i, k in kept.items() if k}
    assert "footer" not in texts[0] and texts[0].count("\n") == 2 and texts[200] == line_docs()[43][1]


def test_a_block_goes_whole_and_near_copies_do_not_outvote(frame):
    """Five lines that always stand together; 400 near copies of one text hold a line of another source's block as well."""
    own = lambda i, k: " ".join(f"w{i}x{k}y{j}" for j in range(30))
    block = [f"Licence line {k} of the same five" for k in range(5)]
    rows = [(i, "\n".join([own(i, 0), *block, own(i, 1)]), "hot") for i in range(100)]
    rows += [(1000 + i, "\n".join([own(-1, k) for k in range(6)] + block[:1] + [f"copy {i}"]), "near") for i in range(400)]
    rows += [(2000 + i, f"{own(i, 3)}\n{block[0]}\n{own(i, 4)}", "near") for i in range(30)]
    texts = {r["doc_id"]: r["text"] for r in line_rules.clean(frame(rows)).collect()}
    assert len(texts) == len(rows) and not any("Licence" in t for t in texts.values())
    assert all(texts[1000 + i].count("\n") == 6 for i in range(400)) and texts[5] == f"{own(5, 0)}\n{own(5, 1)}"


def test_frequent_lines_against_plain_counts(spark, frame):
    rng = random.Random(4)
    pool = [" ".join(f"p{k}q{j}" for j in range(rng.randrange(1, 12))) for k in range(30)]
    rows = []
    for i in range(300):
        lines = [rng.choice(pool[:3] if i % 3 == 0 else pool) for _ in range(rng.randrange(6))]
        lines += [" ".join(f"o{i}n{k}m{j}" for j in range(rng.randrange(20))) for k in range(rng.randrange(4))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(40)] + rows[:5]
    split = lambda t: [(n, x.lower(), len(WORDS.findall(x))) for n, x in enumerate(t.split("\n")) if WORDS.findall(x)]
    texts, often, votes = {(s, t) for _, t, s in rows}, {}, {}
    for s, t in texts:
        for _, x, _ in split(t):
            often.setdefault((s, x), set()).add(t)
    for s, t in texts:
        hit = [(w, -n, x) for n, x, w in split(t) if len(often[s, x]) >= 5]
        if hit:
            mine = 2 * sum(w for w, _, _ in hit) < sum(w for _, _, w in split(t))
            for _, _, x in hit:
                votes.setdefault((s, x), set()).add(t if mine else max(hit)[2])
    size = {s: sum(s == h for h, _ in texts) for s, _ in texts}
    bad = {k for k, v in votes.items() if len(v) >= 5 and 1000 * len(v) >= 100 * size[k[0]]}
    assert 0 < len(bad) < len(often)
    expected = {}
    for i, t, s in rows:
        at = {n for n, x, _ in split(t) if (s, x) in bad}
        gone, total = sum(w for n, _, w in split(t) if n in at), sum(w for _, _, w in split(t))
        if at:
            expected[i] = (at, 100 * (total - gone) < 30 * total)
    df = frame(rows)
    keys = df.select("doc_id", line_rules.row_key("doc_id", "source", "text").alias("key")).distinct()
    for limit in (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "-1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = line_rules.removals(df.repartition(7), min_documents=5, min_per_mille=100).join(keys, "key").collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert {r["doc_id"]: (set(r["at"]), r["depleted"]) for r in got} == expected


def test_clean_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "s", 999, 7, 8, 9)],
                               "doc_id long, text string, source string, n_words int, _text int, row int, at int")
    assert line_rules.clean(df).collect() == df.collect()


def test_line_rules_odd_rows(frame):
    got = line_rules.judge(frame(ODD)).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got)
    assert line_rules.judge(frame([])).count() == 0 and line_rules.clean(frame([])).columns == ["doc_id", "text", "source", "key"]


# ---- url cascade

def test_cascade_is_exact(spark):
    universe = spark.createDataFrame([(f"k{i}",) for i in range(5000)] + [(None,)], "key string")
    listed = spark.createDataFrame([(f"k{i * 13}",) for i in range(300)] + [("elsewhere",), (None,)], "key string")
    levels = url_cascade.build_cascade(listed, universe)
    assert len(levels) > 2
    got = universe.selectExpr("key", url_cascade.listed_in(levels, "key") + " AS found").filter("found").collect()
    assert {r["key"] for r in got} == {f"k{i * 13}" for i in range(300)}


def test_cascade_bounds(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    assert url_cascade.build_cascade(keys.limit(0), keys) == []
    with pytest.raises(ValueError):
        url_cascade.build_cascade(keys, keys, max_bits=10)


def test_urls(spark):
    from factorloom.llm.queries import URL_RULES

    cases = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
             "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
             "https://m.example.com/en/1#t": ("m.example.com", "/en/1", "example.com/en/", "block"),
             "https://m.example.com/de/1": ("m.example.com", "/de/1", "com/", "allow"),
             "https://com": ("com", "", None, "allow"), "x://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
             "x://bad.org?u=http://b.net/es/": ("bad.org", "", None, "block"), "x://a.bad.org/p/" + "q" * 9999:
             ("a.bad.org", "/p/" + "q" * 9999, None, "block"), "x://notbad.org/": ("notbad.org", "/", None, "allow"),
             "x://" + "a." * 2000 + "bad.org/": ("a." * 2000 + "bad.org", "/", None, "block")}
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = url_cascade.judge(df, URL_RULES, spark.createDataFrame([("bad.org",)], "key string")).collect()
    want = list(cases.values())
    assert [tuple(r)[1:] for r in sorted(got)] == want
    assert url_cascade.judge(df.limit(0), URL_RULES, spark.createDataFrame([("bad.org",)], "key string")).count() == 0


# ---- leaks

def distance_to_substring(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != t)))
    return min(row)


def test_myers_distance():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (90, 60))
        assert decontaminate.best_match(decontaminate.masks(p), len(p), t)[0] == min(len(p), distance_to_substring(p, t))


def test_leaks_against_all_distances(spark, frame):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 25)))) for i in range(12)] + [(90, None), (91, ""), (92, "!?")]
    docs = []
    for i in range(80):
        item = list(rng.choice(items[:12])[1])
        for _ in range(rng.choice([0, 1, 3, 6, 15, 30])):
            item[rng.randrange(len(item))] = rng.choice(["x", "", "yz"])
        docs.append((i, " ".join(word() for _ in range(30)) + ". " + "".join(item).upper() + " - " + word()))
    docs += [(None, items[0][1]), (500, None), (501, ""), (502, items[1][1]), (502, items[1][1])]
    want = []
    for d, t in docs:
        for i, x in items:
            n = decontaminate.normal(x)
            k = decontaminate.budget(len(n), 0.1, 16)
            if n and distance_to_substring(n, decontaminate.normal(t)) <= k:
                want.append((str(d), i, distance_to_substring(n, decontaminate.normal(t))))
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 200):
        got = decontaminate.find_leaks(frame(docs), table, block_bytes=block_bytes).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in got) == sorted(want)
    clean = decontaminate.without_leaks(frame(docs), table)
    leaked = {d for d, *_ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in docs if str(d) not in leaked)
    assert clean.columns == ["doc_id", "text", "source", "key"] and decontaminate.find_leaks(frame([]), table).count() == 0
    assert decontaminate.find_leaks(frame(docs), table.limit(0)).count() == 0


def test_leaks_use_the_whole_share(spark, frame):
    rng = random.Random(8)
    items = [(n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for n in (5, 10, 20, 31, 64, 100, 200, 500)]
    docs, want = [], []
    for n, t in items:
        for edits in (int(0.1 * n), int(0.1 * n) + 1):  # spread evenly: the hardest for pieces
            copy = list(t)
            for j in range(edits):
                copy[(2 * j + 1) * n // (2 * edits)] = rng.choice("0123456789")
            docs.append((len(docs), "0 1 2 " + "".join(copy) + " 3 4 5"))
            if edits == int(0.1 * n):
                want.append((docs[-1][0], n, edits))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(frame(docs), table).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == want
    kept = decontaminate.without_leaks(frame(docs), table).collect()
    assert sorted(r["doc_id"] for r in kept) == [d for d, _ in docs if d not in {w[0] for w in want}]


def test_outward_verification_loses_nothing():
    rng = random.Random(9)
    for _ in range(400):
        item = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 70)))
        copy = list(item)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = rng.choice(["a", "b", "", "aa", "ba"])
        text = "".join(rng.choice("ab") for _ in range(20)) + "".join(copy) + "ab"
        found = decontaminate.Matcher([(1, item)], 0.1, rng.choice([1, 16, 40])).find(text)
        least = distance_to_substring(item, text)
        assert [f[1] for f in found] == ([least] if least <= int(0.1 * len(item)) else [])


# ---- pages

PAGES = [("<div class='ad'>x</div><p>a&nbsp; b<br>c<b>d</b>e", "a b cde"),
         ("<article><header><h1>T</h1><p>by</p></header><p>x > y &lt;z&gt;</p><nav>n</nav><article class=comment>c</article></article><p>q", "T x > y <z>"),
         ("<p title='a > b'>ok<!-- no --> go <script>var a='<p>';</script>fin <a href='x", "ok go fin"), ("", ""), (None, ""),
         ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"), ("<div><p>a<div>b</p>c</div>", "a b c"),
         ("<main><p>m</p><form>f</form></main><section id='comments'>q</section>", "m"), ("1 < 2 &amp; 3 <b>4</b>", "1 < 2 & 3 4"),
         ("<p>x<!-- open", "x"), ("<p>cut <b", "cut"), ("<SCRIPT>a</Script ><P>up</P>", "up")]


@pytest.mark.parametrize("page,text", PAGES)
def test_page_text(page, text):
    assert html_main.main_text(page) == (text, 0)


def test_deep_and_broken_pages_end():
    text = lambda page: html_main.main_text(page)[0]
    assert text("<div>" * 30_000 + "x") == "x" and html_main.content_of("<div>" * 30_000 + "x")[1]
    assert text("<a " * 30_000) == "" and text("<" * 3000) == "<" * 3000
    assert text("<!--" * 30_000) == "" and text("</p>" * 3000) == ""


def test_templates_go_and_articles_stay(spark):
    template = "<div class='x'>Our site<ul><li>one</li><li>two</li></ul></div>"
    rows = [(i, f"http://t.example/{i}", f"<body>{template}<div><p>own words {i}</p><p>often said</p></div>") for i in range(30)]
    rows += [(100 + i, f"http://a.example/{i}", f"<article>{template}<p>own {i}</p><p>often said</p></article>") for i in range(30)]
    rows += [(200 + i, "http://c.example/", "<body><p>a copied page</p>") for i in range(40)] + [(300, None, None), (301, "x", "")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    for limit in (1 << 20, 0):
        got = {r["page_id"]: r["text"] for r in html_main.extract(df, broadcast_bytes=limit).collect()}
        assert len(got) == len(rows) and got[300] == got[301] == ""
        assert all(got[i] == f"own words {i}" for i in range(30))
        assert all(got[100 + i] == f"own {i} often said" for i in range(30))
        assert all(got[200 + i] == "a copied page" for i in range(40))
    assert html_main.extract(df.limit(0)).count() == 0


def test_templates_without_telling_names(spark):
    """Blocks on 6 % of a host's pages go, in and beside articles; passages and a group of copies of an article stay."""
    block = lambda k: f"<div class='x{k}'>Block {k}<ul><li>entry {k}</li></ul></div>"
    rows = []
    for i in range(500):
        own = f"<p>own words {i}</p>"
        if i % 2:
            page = f"<body>{block(i % 16)}<article>{own}{block(i % 16 + 20)}<p>often said</p></article>{block(99)}"
        else:
            page = f"<body>{block(i % 16)}<div>{own}</div>"
        rows.append((i, "http://h.example/", page))
    rows += [(1000 + i, "http://h.example/", f"<nav>{i}</nav><article><p>one</p><table><tr><td>cell</table></article>") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, None, None)], "page_id long, url string, html string")
    for limit in (1 << 20, 0):
        got = [(r["page_id"], r["text"], r["template_chars"] > 0) for r in html_main.extract(df, broadcast_bytes=limit).collect()]
        assert len(got) == len(rows) + 4 and len(set(got)) == len(rows) + 1
        assert all(x in got for i in range(500) for x in [(i, f"own words {i}" + " often said" * (i % 2), True)])
        assert all((1000 + i, "one cell", False) in got for i in range(300)) and (None, "", False) in got


def test_recurring_subtrees_against_plain_counts(spark):
    """Counts over pages that differ in their article, and levels, against a plain version; blocks do go on real pages."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{sf}/pages.parquet")
    host = lambda u: re.search("://([^/?#]*)", u)[1].lower() if u and re.search("://([^/?#]*)", u) else ""
    seen, pages = {}, {}
    for r in df.collect():
        copy, hashes = html_main.content_of(r["html"])
        pages.setdefault(host(r["url"]), set()).add(copy)
        for h in hashes:
            seen.setdefault((host(r["url"]), h), set()).add(copy)
    expected = {}
    for (s, h), copies in seen.items():
        n, total = len(copies), len(pages[s])
        level = 3 if n >= 6 and n >= 0.3 * total else 2 if n >= 6 and n >= 0.05 * total else 1 if n >= 3 and 2 ** n >= total else None
        if level:
            expected[s, h] = level
    found = html_main.recurring_subtrees(html_main._scan(df, "url", "html"), min_pages=3)
    assert {(r["host"], r["h"]): r["level"] for r in found.collect()} == expected and expected
    assert html_main.extract(df, min_pages=3).filter("template_chars > 0").count() > 0


# ---- toxicity

@pytest.fixture(scope="module")
def letters():
    from collections import Counter

    counts = Counter()
    for word in ("idiot moron stupid trash clown loser the reading of plain words and letters in this little corpus is told "
                 "by a good teller all day pattern tiller seller mission").split() * 3:
        for pair in itertools.pairwise(["", *word, ""]):
            counts[pair] += 1
    return toxicity.CharModel.fit(counts)


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("id!ot", "idiot"), ("iiiidiot", "idiot"), ("m.o.r.o.n", "moron"),
                                        ("$tup1d!!", "stupid"), ("moron***", "moron"), ("seller", "seller"), ("2024", "2024"), ("", "")])
def test_restore(letters, token, word):
    assert toxicity.restore(token, letters) == word


def test_viterbi_is_the_cheapest_path(letters):
    def paths(token, i=0, text="", cost=0.0):
        if i == len(token):
            yield cost, text
        for j, out, price in toxicity.arcs(token)[i] if i < len(token) else []:
            yield from paths(token, j, text + out, cost + price)

    for token in ("1d10t", "l00sser", "c!!own", "t-r-4-$h", "aa11"):
        total = lambda c, t: c + sum(letters.of(a, b) for a, b in itertools.pairwise(["", *t, ""]))
        best = min(total(c, t) for c, t in paths(token))
        found = toxicity.viterbi(token, letters)
        assert min(total(c, t) for c, t in paths(token) if t == found) == pytest.approx(best)


def toxic_docs(n=600):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(3, 9)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [word() for _ in range(30)]
        if bad:
            for w in rng.sample(["idiot", "moron", "trash", "clown"], 2):
                words.insert(rng.randrange(30), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    return rows, labels


def test_toxicity_model(spark, frame):
    rows, labels = toxic_docs()
    extra = [(1000, "you 1d10t and m o r o n here"), (1001, None), (1002, ""), (None, "plain"), (1003, "y " * 30_000), (1003, "y " * 30_000)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    df = frame(rows + extra)
    model = toxicity.fit(df, table)
    got = toxicity.score(df, model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for s in score.values())
    out = [r["doc_id"] for r in spark.createDataFrame(rows, "doc_id long, text string").filter(held_out("doc_id" and __import__("pyspark").sql.functions.col("doc_id"))).collect()]
    assert len(out) > 60 and np.mean([(score[i] >= 0.5) == (i % 5 == 0) for i in out]) > 0.97
    assert score[1000] >= 0.5 and max(score[1001], score[1002], score[1003], score[None]) < 0.5
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["score"] < 0.5 for r in got)
    again = toxicity.fit(df, table)
    assert again == model
    # held-out labels are never read
    flipped = spark.createDataFrame([(i, 1 - t if i in set(out) else t, q) for i, t, q in labels], table.schema)
    assert toxicity.fit(df, flipped) == model


def test_toxicity_without_data(frame, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.fit(frame([]), none)
    assert toxicity.score(frame([]), model).count() == 0
    assert all(r["score"] < 0.5 for r in toxicity.score(frame(ODD), toxicity.fit(frame(ODD), none)).collect())


# ---- quality

def test_context_sums(frame):
    rows = [(1, "Aa bb, aa 12"), (2, None), (3, ""), (4, "aa")]
    got = {r["bucket"]: list(r)[1:] for r in quality.context_sums(frame(rows).repartition(3)).collect()}
    vectors, reader, want = quality.index_vectors().astype(int), quality.Words(), {}
    for _, t in rows:
        ids = reader.ids(t).tolist()
        for i, b in enumerate(ids):
            n, v = want.get(b, (0, np.zeros(quality.DIMS, int)))
            near = [ids[j] for j in range(max(0, i - 2), min(len(ids), i + 3)) if j != i]
            want[b] = (n + 1, v + sum((vectors[x] for x in near), np.zeros(quality.DIMS, int)))
    assert got == {b: [n, *v.tolist()] for b, (n, v) in want.items()}


def test_quality_model(spark, frame):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "plain", "word"]) + ("***" if i % 4 == 0 and rng.random() < 0.7 else "")
                         for _ in range(40))) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(500)], "doc_id long, quality int")
    df = frame(rows + ODD)
    model = quality.fit(df, labels)
    got = quality.score(df, model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in score.values())
    import zlib

    out = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0 and i > 4]
    assert np.mean([(score[i] >= 0.3) == (i % 4 > 0) for i in out]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(df, quality.fit(df, none)).collect()} == {0.5}
    assert quality.score(frame([]), quality.fit(frame([]), none)).count() == 0


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality.best_temperature(3 * z, y) == pytest.approx(3, rel=0.15)


# ---- masked language model

def test_counts_and_vocabulary(frame):
    rows = [(i, "a a b, C c" + (" rare%d" % i if i % 7 == 0 else "")) for i in range(50)] + ODD
    from collections import Counter

    want = Counter(p.lower() for _, t, *_ in rows for p in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t or ""))
    got = {r["word"]: r["n"] for r in masked_lm.word_counts(frame(rows).repartition(4), keep=3).collect()}
    assert got == dict(want)
    v = masked_lm.build_vocabulary(frame(rows), max_words=3, buckets=4, n_classes=2)
    # The words of the corpus, and one unseen word for each bucket without any, have all the mass of their classes.
    ids = [v.id_of(w) for w in want]
    ids += sorted(set(range(1, v.size)) - set(ids))
    assert len(ids) > v.size
    assert np.allclose(np.bincount(v.classes[ids], np.exp(v.share[ids].astype(float)), 2), 1, atol=1e-5)


def test_a_bucket_of_many_words_makes_none_of_them_likelier(frame):
    few = [(i, "a b " + f"x{chr(97 + i)}") for i in range(4)]
    many = few + [(9, " ".join(chr(97 + i) + chr(97 + k) + "q" for i in range(26) for k in range(26)))]
    share = [masked_lm.build_vocabulary(frame(rows), max_words=2, buckets=1, n_classes=1) for rows in (few, many)]
    assert share[1].share[share[1].id_of("xa")] < share[0].share[share[0].id_of("xa")]
    assert masked_lm.Ids(masked_lm.build_vocabulary(frame(few), max_words=2, buckets=1 << 17)).of("zz y a").max() > 1 << 16


def test_rows_of_one_token_teach_and_sums_are_those_of_single_steps(frame):
    """Every place is trained on: rows of one to three tokens too. The sums of a step are those of single words."""
    df = frame([(i, "a") for i in range(40)])
    start = masked_lm.fit(df, max_words=2, buckets=2, n_classes=2, rounds=0)
    taught = masked_lm.fit(df, max_words=2, buckets=2, n_classes=2)
    assert not np.array_equal(start.network.flat(), taught.network.flat())
    rng = np.random.default_rng(0)
    c, t = rng.integers(0, 5, (100, 4)).astype(np.int32), rng.integers(0, 3, 100)
    net = masked_lm.Network.start(6, 3)
    x, h = net.hidden(c)
    p = np.exp(h @ net.w2 + net.b2)
    p /= p.sum(1, keepdims=True)
    p[np.arange(100), t] -= 1
    dx = ((p / 100) @ net.w2.T * (1 - h * h) @ net.w1.T).reshape(-1, masked_lm.EMBED)
    slow = net.embed.copy()
    for word, step in zip(c.ravel(), dx):
        slow[word] -= 0.5 * 4 * step
    # The hidden layer of the pass is updated after its slopes are taken.
    assert np.allclose(masked_lm.train_block(net, c, t, 0.5).embed, slow, atol=1e-5)


def test_numbers_beyond_exp_are_held_back_and_steps_sort_short_ids(monkeypatch):
    """The greatest number of a class is taken off only where exp could overflow; ids that fit are sorted as 16 bits."""
    rng = np.random.default_rng(0)
    c, t = rng.integers(0, 5, (100, 4)).astype(np.int32), rng.integers(0, 3, 100)
    flat = masked_lm.Network.start(6, 3)
    steep = masked_lm.Network(*(a * 400 for a in flat.arrays()))
    assert steep.steep() and not flat.steep()
    taught = masked_lm.train_block(steep, c, t, 0.5).flat()
    monkeypatch.setattr(masked_lm.Network, "steep", lambda self: True)
    assert np.allclose(masked_lm.train_block(steep, c, t, 0.5).flat(), taught) and np.isfinite(taught).all()
    always = masked_lm.train_block(flat, c, t, 0.5).flat(), flat.log_classes(c, t)
    monkeypatch.setattr(masked_lm.Network, "steep", lambda self: False)
    never = masked_lm.train_block(flat, c, t, 0.5).flat(), flat.log_classes(c, t)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(always, never))
    kinds, sort = [], np.argsort
    monkeypatch.setattr(masked_lm.np, "argsort", lambda x, **how: kinds.append(x.dtype) or sort(x, **how))
    masked_lm.train_block(flat, c, t, 0.5)
    assert kinds == [np.uint16]


def test_steep_numbers_count_whole():
    """No number of a class is cut: log probabilities far below -40 are those of the full numbers."""
    rng = np.random.default_rng(2)
    c, t = rng.integers(0, 5, (100, 4)).astype(np.int32), rng.integers(0, 3, 100)
    steep = masked_lm.Network(*(a * 400 for a in masked_lm.Network.start(6, 3).arrays()))
    z = (steep.hidden(c)[1] @ steep.w2 + steep.b2).astype(np.float64)
    whole = z - z.max(1, keepdims=True)
    whole = (whole - np.log(np.exp(whole).sum(1, keepdims=True)))[np.arange(100), t]
    assert whole.min() < -100 and np.allclose(steep.log_classes(c, t), whole, rtol=1e-4, atol=1e-3)


def test_gradient_learns_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    ids = np.tile([1, 2, 3, 4, 5, 6], 300).astype(np.int32)
    net = masked_lm.Network.start(8, 8)
    around, target = masked_lm.contexts(ids), ids.astype(np.int64)
    before = net.log_classes(around, target).mean()
    for _ in range(8):
        net = masked_lm.train_block(net, around, target, 0.5)
    assert net.log_classes(around, target).mean() > before + 1
    every = sum(np.exp(net.log_classes(around[:50], np.full(50, k))) for k in range(8))
    assert np.allclose(every, 1, atol=1e-4) and rng is not None
    assert masked_lm.contexts(ids)[2].tolist() == [1, 2, 4, 5] and masked_lm.contexts(ids)[0].tolist() == [0, 0, 2, 3]


def test_scores(frame):
    rows = [(i, "the cat sat on the mat and the dog ran " * 4) for i in range(60)] + [(90, "mat dog the the on cat ran sat and the " * 4)] + ODD
    df = frame(rows).repartition(3)
    model = masked_lm.fit(df, max_words=50, buckets=8, n_classes=8, rounds=3)
    got = masked_lm.score(df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[10]["mean_log_probability"] > by[90]["mean_log_probability"]
    assert by[2]["n_tokens"] == 0 and by[2]["log_probability"] == 0 and by[2]["mean_log_probability"] is None
    ids = masked_lm.Ids(model.vocabulary).of(rows[60][1])
    slow = sum(float(model.network.log_classes(masked_lm.contexts(ids)[i:i + 1], model.vocabulary.classes[ids[i:i + 1]])[0])
               + float(model.vocabulary.share[ids[i]]) for i in range(len(ids)))
    assert by[90]["log_probability"] == pytest.approx(slow, rel=1e-4)
    assert masked_lm.score(frame([]), masked_lm.fit(frame([]))).count() == 0
    both = masked_lm.fit_and_score(df, max_words=50, buckets=8, n_classes=8, rounds=3).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in both) == sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got)
    assert masked_lm.fit_and_score(frame([])).count() == 0
