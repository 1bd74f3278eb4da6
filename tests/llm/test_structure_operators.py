"""HTML, sharding, WARC, LM scores, top-k and the Jaccard join against brute force and edge cases."""

import base64
import datetime
import gzip
import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagitta.llm import html, jaccard, ppm, sharding, topk, warc


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="page"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><div id="cookie-notice">Accept</div><article><header><h1>Ti&shy;tle &amp; more</h1></header><p><b>One&nbsp;two<br>three<p>four <em>five</em>six</p><aside>side</aside><form><p>mail</p></form>
<div class="share-buttons">Share</div><pre>a\n  b</pre><table><tr><td>x</td><td>y</td></tr></table><ul><li>i<li>j</ul>&lt;b&gt; &#x41;&notanentity;</article><section id="comments"><p>Nice!</p></section><footer>(c)</footer></body></html>"""
    alone = lambda page: html.main_text(html.blocks(page), [])[0].split("\n")
    assert alone(page) == ["Ti­tle & more", "One two", "three", "four fivesix", "a b", "x", "y", "i", "j", "<b> A¬anentity;"]
    assert [x for x, k in html.blocks(page) if k == html.DROPPED_LINE] == ["Site", "Home", "Buy", "Accept", "side", "mail", "Share", "Nice!", "(c)"]
    assert html.blocks(None) == html.blocks("") == html.blocks("<script>never closed") == []
    assert html.blocks("<p>a <b>b") == [("a b", html.PLAIN)]
    assert alone('<div class="wrapper with-sidebar"><p>kept</p><div class="sidebar">gone</div><p style="display: none">gone</p><p hidden>gone</p><p data-hidden="1">kept, too</p></div>') == ["kept", "kept, too"]
    assert alone('<main><h1 class="article-header">Title</h1><p>x<div role="navigation">1 2 3</div><ul class="commentList"><li>no</ul>y</main><p>outside') == ["Title", "x", "y"]
    # a stray quote ends with its tag; quotes behind an equals sign may hold a >
    assert alone('<p>Hello <a href=x">link</a> there</p><p>Second</p>') == ["Hello link there", "Second"]
    assert alone('<p title="a > b">one</p><p title=\'>\'>two</p><p title="never closed>three</p>') == ["one", "two", "three"]
    # a mark is a whole word of the class, with nothing but general words beside it
    assert alone('<article><p class="share-price">Up</p><p class="ad-hoc">committee</p><p class="lead share-buttons">gone</p><p class="ad-box">gone</p><p>a <span class="ad">x</span> b</article>') == ["Up", "committee", "a b"]


def test_common_lines():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices("abcde", k=rng.randint(0, 9)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.common_lines(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_extraction(spark):
    plain = lambda body: f"<body><div>Menu one</div><div>Menu two</div>{body}<div>All about us</div></body>"
    same = "<article><p>Same story</p></article>"
    rows = [(1, "http://h/a/1", plain("<p>First text</p><p>goes on</p><p>and on</p><p>to its end</p>")), (2, "http://h/a/2", plain("<p>Second text</p><p>is another</p><p>altogether</p><p>you see</p>")), (3, "http://other/x", plain("<p>Alone</p>")), (4, None, None), (5, "no url", ""), (6, "http://k/1", same), (7, "http://k/2", same), (7, "http://k/2", same), (None, "http://[bad", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("lines", F.lit(2))
    found = sorted(((r["page_id"] or 0, r["text"], r["n_shared"]) for r in html.extract(pages).collect()))
    assert found == [(0, "x", 0), (1, "First text\ngoes on\nand on\nto its end", 3), (2, "Second text\nis another\naltogether\nyou see", 3), (3, "Menu one\nMenu two\nAlone\nAll about us", 0), (4, "", 0), (5, "", 0), (6, "Same story", 0), (7, "Same story", 0), (7, "Same story", 0)]
    assert html.extract(pages.limit(0)).count() == 0


def test_extraction_without_marked_articles(spark):
    """Sites of which only comparison tells what each page repeats: the same result in any number of parts."""
    rng = random.Random(9)
    rows, want = [], {}
    for host in range(6):
        menu = [f"host {host} menu {i}" for i in range(3)]
        for n in range(1 if host == 5 else 25):
            i = host * 100 + n
            body = [f"page {i} line {k} {rng.random()}" for k in range(rng.randint(4, 9))]
            section = [f"section {n // 5} of {host}"]
            rows.append((i, f"https://site{host}.example/s{n // 5}/{n:03}", "".join(f"<div>{x}</div>" for x in [*menu, *section, *body, f"contact {host}"])))
            want[i] = ("\n".join(body), 5)
    # without a neighbour nothing can be told
    want[500] = ("\n".join([*menu, *section, *body, "contact 5"]), 0)
    # copies next to each other: the other neighbour tells
    rows.append((900, "https://site0.example/s4/024", rows[24][2]))
    want[900] = want[24]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for parts in (1, 4, 211):
        found = {r["page_id"]: (r["text"], r["n_shared"]) for r in html.extract(pages, parts).collect()}
        wrong = {i for i in want if found[i] != want[i]}
        # the last of the copies has only the other copy beside it, and keeps all
        assert wrong <= {900}, wrong
        assert sum(n for _, n in found.values()) >= 600 and found[900][0].endswith("contact 0")


def test_extraction_of_the_pages(spark):
    """Differencing and structure on the whole table: lines that pages share go, the marked article stays."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = html.extract(pages).collect()
    again = html.extract(pages.repartition(5), 37).collect()
    assert sorted((r["page_id"], r["text"], r["n_shared"]) for r in found) == sorted((r["page_id"], r["text"], r["n_shared"]) for r in again)
    print("lines that differencing took:", sum(r["n_shared"] for r in found))
    of = {r["page_id"]: html.main_text(html.blocks(r["html"]), [])[0] for r in pages.collect()}
    assert all(of[r["page_id"]] == r["text"] for r in found)


def test_sharding(spark):
    rng = random.Random(4)
    texts = ["hot " * 40] * 300 + ["t%d " % i * rng.randint(1, 60) for i in range(580)] + [None] * 10 + ["", "long " * 3000]
    rows = [(i, t, i, i, "k") for i, t in enumerate(texts)] + [(None, "no id", 7, 1, "k"), (5, texts[5], 5, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, size int, key string")
    out = sharding.histogram_shards(docs, rows_per_cell=20).collect()
    assert len(out) == len(rows) and {*out[0].asDict()} == {"row", "size", "shard", "slot"}
    assert sorted(map(repr, (tuple(r["row"]) for r in out))) == sorted(map(repr, rows))
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in out:
        assert r["size"] == len((r["row"]["text"] or "").encode()) + 1
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == [*range(len(s))] for s in slots.values()) and {*slots} == {*range(8)}
    longest = max(r["size"] for r in out)
    mean = sum(size.values()) / 8
    assert all(abs(v - mean) <= 1.5 * longest for v in size.values())
    # equal texts stand together: one run of places in the order of shards and slots
    order = [r["row"]["text"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a == "hot " * 40 and b != "hot " * 40 for a, b in zip(order, order[1:] + [None])) == 1
    assert sharding.histogram_shards(docs.limit(0)).count() == 0
    assert sharding.histogram_shards(docs.limit(1)).count() == 1


def test_sharding_against_a_sort(spark):
    """All rows sorted by key: shards are runs of it, cut where the bytes below come nearest to equal shares."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "word " * rng.randint(0, 30)) for i in range(3000)], "doc_id long, text string")
    found = sharding.histogram_shards(docs, tolerance=0.0).withColumn("key", sharding.sort_key(F.col("row.text"), F.col("row.doc_id"))).collect()
    found.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [r["key"] for r in found] == sorted(r["key"] for r in found)
    below, total, want = 0, sum(r["size"] for r in found), []
    for r in found:
        want.append(min(7, int((below + r["size"] / 2) * 8 // total)))
        below += r["size"]
    assert [r["shard"] for r in found] == want


def test_sharding_of_equal_rows(spark):
    """Thousands of rows with one id and text, and of rows without either, are divided as any others."""
    for row in ((3, "the same text"), (None, None)):
        out = sharding.histogram_shards(spark.createDataFrame([row] * 4000, "doc_id long, text string").repartition(3)).collect()
        shards = Counter(r["shard"] for r in out)
        assert {*shards} == {*range(8)} and max(shards.values()) - min(shards.values()) <= 40
        assert all(sorted(r["slot"] for r in out if r["shard"] == n) == [*range(m)] for n, m in shards.items())


@pytest.mark.parametrize("clustered", [True, False])
def test_uniform_threshold(clustered):
    """Entries without a list at the threshold are never added up, all that reach the cutoff are found, and on clustered vectors
    candidates that can't reach it any more get no further lists."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32)) * 100
    c = np.floor(centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 32)) * 5) if clustered else np.floor(rng.normal(size=(900, 32)) * 100)
    q, other = c[:10], np.ones((10, 900), bool)
    other[:, 5] = False
    full = (q @ c.T).astype(np.int64)
    for cut in (np.sort(full, axis=1)[:, -5], np.sort(full, axis=1)[:, 40], np.full(10, topk.LOWEST)):
        i, j, scores, made, collected = topk.reaching(q, c, other, cut)
        want = {(a, b) for a, b in zip(*np.nonzero((full >= cut[:, None]) & other))}
        assert {*zip(i.tolist(), j.tolist())} == want and (scores == full[i, j]).all()
        lists = np.stack([q[:, a:z] @ c[:, a:z].T for a, z in topk._cuts(32)])
        at_threshold = ((lists * topk.SLICES >= cut[:, None]).any(0) & other).sum()
        assert len(want) <= collected <= at_threshold
        if cut[0] > 0:
            assert collected < 0.5 * full.size and (not clustered or made < 0.9 * full.size * topk.SLICES)
    i, j, scores = topk.head(q, c, other, 5)
    assert (scores == full[i, j]).all() and len(i) == 50
    # one list where products don't fit
    big = c[:50] * 2.0**24
    i, j, scores, _, _ = topk.reaching(big[:3], big, other[:3, :50], np.zeros(3, np.int64))
    assert (scores >= 0).all() and {*zip(i.tolist(), j.tolist())} == {(a, b) for a, b in zip(*np.nonzero((full[:3, :50] >= 0) & other[:3, :50]))}


def test_alignment_of_many_equal_lines():
    """Twenty thousand equal lines on two pages: by bits, not by pairs."""
    n = 20_000
    a, b = ["y", *["x"] * n, "q"], ["z", *["x"] * n, "y"]
    began = time.time()
    tracemalloc.start()
    found = html.common_lines(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and most < 50 << 20 and time.time() - began < 5
    page = "<body>" + "<table>" + "<tr><td>x</td></tr>" * 6_000 + "</table><p>own {}</p></body>"
    pages = [html.blocks(page.format(k)) for k in (1, 2)]
    assert html.main_text(pages[0], [pages[1]])[1] >= 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://a/5", "a\r\n\r\nWARC/1.1\r\nb"), (None, "http://n", "<p>é</p>"), (None, "http://m", "alone"), (6, "http://a/6", "x" * 100000), (2, "http://a/2b", "<p>é</p>"), (7, "http://a/7", "alone too")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).withColumn("first_id", F.lit(9))
    for k in range(2):
        path = str(tmp_path / f"w{k}")
        warc.write_archives(pages.repartition(3) if k else pages, path)
        got = warc.read_archives(spark, path).collect()
        # record ids are unique, also those of repeated pages, and each revisit's response is there
        ids = {r["record_id"]: r for r in got}
        named = [r for r in got if r["refers_to_id"]]
        assert len(ids) == len(rows) and all(ids[r["refers_to_id"]]["page_id"] == r["refers_to"] and ids[r["refers_to_id"]]["record_type"] == "response" for r in named)
        # the page 2 is there twice, so its revisits name no record
        assert sorted(r["page_id"] or 0 for r in got if r["record_type"] == "revisit" and r not in named) == [0, 1] and len(named) == 1
        assert all(time.time() - 600 < datetime.datetime.fromisoformat(r["date"]).timestamp() <= time.time() + 1 for r in got)
        # any reader sees the records one after the other, each a member of its own
        data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / f"w{k}").glob("part-*")))
        assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) and data.endswith(b"\r\n\r\n")
        first = next(p for p in sorted((tmp_path / f"w{k}").glob("part-*")) if p.stat().st_size).read_bytes()
        member = zlib.decompressobj(31)
        assert warc.parse_record(member.decompress(first))[7] in ids and member.unused_data.startswith(warc.BETWEEN)
        assert len(got) == len(rows)
        payloads = {r["payload_digest"]: r["payload"] for r in got if r["record_type"] == "response"}
        seen = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
        want = Counter()
        groups = defaultdict(list)
        for i, _, h in rows:
            groups[h or ""].append(i)
        for i, _, h in rows:
            data = (h or "").encode()
            best = max((x for x in groups[h or ""] if x is not None), default=None)
            again = best is not None and i != best
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None] += 1
        assert seen == want
        assert {*payloads.values()} == {h or "" for _, _, h in rows}
    least = warc.resolve_revisits(pages, min_bytes=9)
    assert {r["page_id"] for r in least.where("record_type = 'revisit'").collect()} == {1, None}
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_ppm(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["the", "of", "Thin", "é", "x,y", "rareword"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(150)] + [(200, None), (201, ""), (None, "the of"), (3, "the of of the"), (202, "zzz qqq zzz"), (203, "the\x0bof\x1cx\xa0y " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("word", F.lit(1))
    split = lambda t: (t or "").encode().lower().split()
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learned for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    for frequent in (400_000, 5):
        monkeypatch.setattr(ppm, "FREQUENT", frequent)
        model, rare = ppm.train(docs, ~ppm.held_out())
        found = defaultdict(list)
        for r in ppm.score(docs, model, rare).collect():
            found[r["doc_id"], r["n_tokens"]].append(r)
        assert sum(map(len, found.values())) == len(rows)
        for i, t in rows:
            tokens = [*split(t), None]
            base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in tokens)
            for r in found[i, len(tokens)]:
                assert r["n_known"] == sum(w in counts for w in tokens) and r["train_tokens"] == n and r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    # after any context, the probabilities of all symbols add up to one
    for context in (b"", b"the o", b"qqqqq", b"\xc3", b"thin "):
        start = ppm.grams(context)[-1]
        codes = (start & ~np.uint64((1 << ppm._BITS) - 1)) + np.arange(ppm._SYMBOLS, dtype=np.uint64)
        assert (10 ** model.trie.log10(codes)).sum() == pytest.approx(1, abs=1e-5)
    nothing, rare = ppm.train(docs.limit(0), ~ppm.held_out())
    row = ppm.score(docs.where("doc_id = 3"), nothing, rare).collect()[0]
    assert row["n_known"] == 0 and row["score"] == pytest.approx(-math.log10(257) * (len(rows[3][1].encode()) + 1), rel=1e-6) or row["n_tokens"] == 5


def test_ppm_scores_do_not_depend_on_what_the_trie_holds(spark, monkeypatch):
    rng = random.Random(11)
    syllables = ["the", "of", "th", "é", " ", "ing ", "xy"]
    rows = [(i, "".join(rng.choices(syllables, k=rng.randint(0, 12)))) for i in range(60)] + [(200, None), (201, "zzz qqq the"), (None, "thexx of"), (3, "the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    symbols = lambda t: [0] * ppm.ORDER + [b + 1 for b in (t or "").encode().lower()] + [0]
    after = defaultdict(Counter)
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            s = symbols(t)
            for at in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    after[tuple(s[at - k : at])][s[at]] += 1

    def log10(context, symbol):
        out, gone = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            new = {x: n for x, n in after.get(context[ppm.ORDER - k :], {}).items() if x not in gone}
            whole = sum(new.values()) + len(new)
            if symbol in new:
                return out + math.log10(new[symbol] / whole)
            out += math.log10(len(new) / whole) if new else 0
            gone |= {*new}
        return out - math.log10(ppm._SYMBOLS - len(gone))

    want = Counter()
    for i, t in rows:
        s = symbols(t)
        want[i, round(sum(log10(tuple(s[at - ppm.ORDER : at]), s[at]) for at in range(ppm.ORDER, len(s))), 3)] += 1
    for nodes in (1 << 20, 90, 5):
        monkeypatch.setattr(ppm, "NODES", nodes)
        model, rare = ppm.train(docs, ~ppm.held_out())
        assert len(model.tables) == {1 << 20: 0, 5: ppm.ORDER + 1}.get(nodes, len(model.tables)) and (nodes > 90 or model.tables)
        assert Counter((r["doc_id"], round(r["score"], 3)) for r in ppm.score(docs, model, rare).collect()) == want


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = [(i, [float(x) for x in rng.normal(0, 0.3, 8).astype(np.float32)]) for i in range(300)]
    hot = [(1000 + i, base[7][1]) for i in range(120)]
    odd = [(2000, None), (2050, [float("nan")] * 8), (2051, [1.0] * 7 + [None]), (2100, []), (None, base[0][1]), (2150, [1.0, 2.0]), (2151, [0.5, 0.25]), (2200, [1e6] * 8)]
    rows = base + hot + odd + [base[3]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("q", F.lit(2))
    for block in (4096, 3):
        monkeypatch.setattr(topk, "BLOCK", block)
        got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0)).collect())
        valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
        want = []
        for q, x in valid:
            if q % 50 == 0:
                scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in valid if i != q and len(y) == len(x))
                want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)]
        assert got == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def brute_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = [*range(len(rows))]

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if rows[x][0] is not None and rows[y][0] is not None and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i if i is not None else -1, len(sets[x]), least[find(x)] if i is not None else -1) for x, (i, _) in enumerate(rows))


def corpus(seed):
    """Groups of near copies around both thresholds, chains, shared passages, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(14):
        text = [word() for _ in range(rng.choice([6, 20, 60, 200, 700]))]
        for _ in range(rng.choice([1, 2, 5, 25, 40])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                text = copy
    rows += [" ".join([word() for _ in range(60)] + passage) for _ in range(40)]
    rows += [" ".join(passage[: rng.randint(3, 40)]) for _ in range(40)]
    rows += ["Exact  Copy of this text here"] * 30 + ["one", "one two", "One\ntwo", "three words only", "", " \t"] + [rows[0].upper()]
    ids = rng.sample(range(10_000), len(rows))
    return [*zip(ids, rows), (20_000, None), (None, rows[0]), (ids[0], rows[0])]


@pytest.mark.parametrize(("width", "percent", "seed", "all_pairs"), [(4, 85, 1, 16), (5, 80, 2, 16), (4, 85, 3, 2)])
def test_jaccard(spark, monkeypatch, width, percent, seed, all_pairs):
    monkeypatch.setattr(jaccard, "ALL_PAIRS", all_pairs)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("sig", F.lit("y")).repartition(5)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in jaccard.jaccard_components(docs, width, percent).collect())
    assert found == brute_components(rows, width, percent)


def test_near_duplicates_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (3, ""), (4, None), (None, "a b c d e f g")], "doc_id long, text string").withColumn("component_id", F.lit(5))
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_near_duplicates_by_row(spark):
    """Each text keeps one row, also where rows of one id have different texts."""
    w, u = "a b c d e f g h", "i j k l m n o p"
    docs = spark.createDataFrame([(1, w), (2, w), (2, u), (3, u), (3, u.upper()), (4, ""), (4, None), (4, "")], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("sig", F.lit("x"))
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, w), (2, u), (4, ""), (4, "")]
    again = jaccard.drop_near_duplicates(docs.where("doc_id = 3"))
    assert again.count() == 1


def test_words_that_collide_under_powers_modulo_two_to_the_64(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for x, y in ((word, other), (word[:64], other[:64])):
        rows = [(1, f"one two {x} four"), (2, f"one two {y} four"), (3, f"one two {x} four")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in jaccard.jaccard_components(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
        assert sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(docs).collect()) == [1, 2]


def test_word_hashes_stand_for_words():
    rng = random.Random(11)
    words = ["".join(rng.choices("abé", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)]
    data = "\n".join(words).encode()
    found, starts = jaccard.word_hashes(data)
    seen = {}
    assert len(found) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, found.tolist())) and len({*seen.values()}) == len(seen)
    assert [data[i : i + len(w.encode())].decode() for w, i in zip(words, starts)] == words


def test_large_groups(spark):
    """2,000 near copies of one text, and a line in every document, beside texts at the edge of linking."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    line = " ".join(f"common{i}" for i in range(30))
    rows = []
    for i in range(2000):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            copy[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, line + "".join(f" y{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 3, 5, 40])))) for i in range(400)]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    assert found == brute_components(rows, 4, 85)


def test_combination_keys():
    """Two sets that may link without a rare token in common always share a combination."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        percent = int(rng.choice([80, 85, 90]))
        n = int(rng.choice([3, 7, 9, 13, 20, 40, 100, 400]))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        apart = (100 - percent) * 2 * n // (100 + percent)
        gone, more, ra, rb = (int(v) for v in rng.multinomial(rng.integers(0, apart + 1), [0.25] * 4))
        fa, fb = x[: max(1, n - ra)], np.concatenate([x[gone : max(1, n - ra)], rng.integers(0, 2**63, more).astype(np.uint64)])
        na, nb = len(fa) + ra, len(fb) + rb
        both = len(np.intersect1d(fa, fb))
        if both and 100 * both >= percent * (na + nb - both) and (na, ra) != (nb, rb):
            a, b = (np.concatenate([np.empty(0, np.uint64), *jaccard.combination_keys(np.sort(f), k, r, percent)]) for f, k, r in ((fa, na, ra), (fb, nb, rb)))
            assert len(np.intersect1d(a, b)), (percent, na, nb, ra, rb)


def test_frequent_tokens(spark, monkeypatch):
    """With a sketch that calls nearly everything frequent, combinations and centres must find the same."""
    monkeypatch.setattr(jaccard, "token_classes", lambda counts: (counts > 1).astype(np.uint8))
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in jaccard.jaccard_components(docs).collect())
    assert found == brute_components(rows, 4, 85)
