"""Corpus operators against brute-force versions and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlens.llm import bpe, extract, jaccard, lines, mixing, pii, quality, queries, rules, topk, warc
from tests.llm.conftest import MEDIUM, ODD, SMALL

GAP = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(GAP, text or "") if w]


def pairs(spark, path=SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


# ---------------------------------------------------------------- op1
def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab1.2@+-( )45 9") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in [t or "" for _, t in pairs(spark, MEDIUM)] + made:
        want = brute_base(text)
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == want, text


def test_pii_rows(spark, docs_of):
    got = pii.find(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    row = next(r for r in got if r.doc_id == 8)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    empty = next(r for r in got if r.doc_id == 1)
    assert empty.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs_of([])).count() == 0


def test_spelled_out_addresses_need_nothing_else_in_the_text():
    forms = ["jane.doe (at) example.org", "jane {at} example.org", "jane [at] example [dot] org", "jane at example.com", "jane (at) example dot org"]
    for form in forms:
        for text in (f"write to {form} now", f"write to {form}. The rest", f"{form}. Bob (at) web.de is next"):
            base, loose = pii.candidates(text)
            assert not base and form in [text[a:b] for k, a, b in loose if k == 0], text
    assert pii.candidates("host fe:dc:ba:ab:cd:ef:fa:ce up")[1] == [(1, 5, 28)]
    text = "we stayed at home. The door"
    (span,) = pii.candidates(text)[1]
    assert pii.votes(text, *span, False)[1:3] == (pii.NO, pii.NO)


def test_em_prefers_agreeing_labelers():
    good = pii.code_of(3, (1, 1, 1, 1, 1), (2, 2, 1))
    weak = pii.code_of(3, (2, 0, 2, 0, 0), (2, 0, 0))
    p = pii.em_probabilities({good: 500, weak: 400})
    assert p[good] > 0.95 and p[weak] < 0.2
    w = pii.train_classifier({good: 500, weak: 400}, p)
    assert pii.pattern_probability(good, w) > 0.9 > 0.5 > pii.pattern_probability(weak, w)


# ---------------------------------------------------------------- op2
def brute_components(rows):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 7, 12, 30, 60, 150]))]
        for _ in range(rng.randint(1, 14)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("options", [{}, {"small_run": 1}, {"miss_bits": None}])
def test_join_components(spark, docs_of, options):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.NgramJaccardJoin(docs_of(rows), **options).documents().collect()}
    assert got == brute_components(rows)


def test_join_keeps_links_that_only_long_runs_hold(spark, docs_of):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(2304)]  # 2300 shingles
    rows = [(0, " ".join(base))]
    for i in range(1, 301):  # supersets at 0.76 to 0.80, none of them linked to another
        rows.append((i, " ".join(base + [f"s{i}x{k}" for k in range(rng.randint(576, 724))])))
    got = jaccard.NgramJaccardJoin(docs_of(rows)).documents().collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_join_odd_rows(spark, docs_of):
    got = jaccard.NgramJaccardJoin(docs_of(ODD)).documents().collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1
    assert by[10].component_id == 9 and by[None].component_id is None
    assert jaccard.NgramJaccardJoin(docs_of([])).documents().count() == 0


def test_runs_over_batches_are_whole():
    sig = np.repeat(np.arange(8), [1, 3, 40, 2, 9, 1, 30, 4])
    fp = np.arange(len(sig))
    group = np.where((sig == 6) | (sig == 7), 5, fp)  # two runs of a single group
    for size in (1, 2, 7, 100):
        reader, got, low, high = jaccard._RunReader(4, chunk=5), defaultdict(list), {}, {}
        given = [reader.read(sig[at:at + size], fp[at:at + size], group[at:at + size], False) for at in range(0, len(sig), size)]
        for _, s, m, g in [row for rows in [*given, reader.read(sig[:0], fp[:0], group[:0], True)] for row in rows]:
            got[s] += m.tolist()
            low[s], high[s] = min(g.min(), low.get(s, g.min())), max(g.max(), high.get(s, g.max()))
        mixed = {s: sorted(m) for s, m in got.items() if low[s] < high[s]}
        assert mixed == {s: fp[sig == s].tolist() for s in (1, 2, 3, 4)}
        assert 7 not in got  # a short run of one group is not given at all


def test_representatives_are_of_every_group():
    members, groups = np.arange(100, 140), np.repeat([5, 3, 9], [4, 30, 6])
    drawn = [jaccard.representatives(s, members, groups).tolist() for s in range(20)]
    of = dict(zip(members.tolist(), groups.tolist(), strict=True))
    assert all(sorted(of[m] for m in d) == [3, 5, 9] and of[d[0]] == 3 for d in drawn)
    assert len({d[0] for d in drawn}) > 5


def test_groups_of_near_copies_are_not_compared_block_by_block(spark, docs_of):
    rng = random.Random(9)
    rows = []
    for words_of in (300, 2000):  # near copies of one text each
        base = [f"b{words_of}x{k}" for k in range(words_of)]
        for _ in range(1500 if words_of == 300 else 300):
            text = list(base)
            for _ in range(rng.randint(0, words_of // 100)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(text)))
    join = jaccard.NgramJaccardJoin(docs_of(rows))
    links = join._linked(join._stars(join._signature_rows("seeds").distinct()), None)
    member = jaccard.connected_components(links, "a", "b")
    needed = join._needed(join._runs(member), member)
    assert needed.count() < 2 * len(rows)  # without the seeds: over 100 a text
    got = {r.doc_id: r.component_id for r in join.documents().collect()}
    assert got == {i: 0 if i < 1500 else 1500 for i in range(len(rows))}


def test_groups_that_share_a_passage_are_compared_a_few_times(spark, docs_of):
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(120)]
    rows = []
    for g in range(40):  # near copies of a text with the passage; groups are not linked to each other
        own = [f"g{g}x{k}" for k in range(100)]
        for _ in range(8):
            text = list(own)
            text[rng.randrange(100)] = f"e{rng.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(passage + text)))
    join = jaccard.NgramJaccardJoin(docs_of(rows))
    shared = join._shared(join._signature_rows("seeds").distinct())
    member = jaccard.connected_components(join._linked(join._star_pairs(shared), None), "a", "b")
    runs = join._runs(member, join._met(shared))
    assert runs.where("long").count() > 20
    assert join._between_groups(runs).count() < 1000  # of classes drawn anew for every signature: 1418
    got = {r.doc_id: r.component_id for r in join.documents().collect()}
    assert got == {i: i // 8 * 8 for i in range(len(rows))}


@pytest.mark.parametrize("n, size, band", [(5, 13, 11), (9, 17, 12), (6, 12, 11)])
def test_spare_blocks_are_those_that_chance_leaves_over(n, size, band):
    d = (size + min(jaccard.upper(band), size * 4 // 3)) // 7  # elements in which linked sets differ at most
    changed = Counter({0: 1.0})
    for _ in range(d):
        after = Counter()
        for k, p in changed.items():
            after[k] += p * k / n
            after[k + 1] += p * (n - k) / n
        changed = after
    for bits in (1, 2, 4, 8):
        r = jaccard.spare_blocks(n, size, band, miss_bits=bits)
        assert r >= n - d - 1 == jaccard.spare_blocks(n, size, band, miss_bits=None)
        assert r == n - d - 1 or sum(p for k, p in changed.items() if n - k <= r) < 2.0 ** -bits
        assert sum(p for k, p in changed.items() if n - k <= r + 1) >= 2.0 ** -bits


def test_a_passage_that_many_share_is_left_out_by_texts_with_enough_other_blocks(spark, docs_of):
    rng = random.Random(13)
    passage = [f"p{k}" for k in range(64)]
    rows = [(i, " ".join([f"t{i}x{k}" for k in range(50)] + passage + [f"u{i}x{k}" for k in range(50)])) for i in range(300)]
    for i in range(0, 40, 2):  # linked ones among them
        words = rows[i][1].split()
        for k in rng.sample(range(len(words)), 3):
            words[k] = f"e{i}x{k}"
        rows.append((300 + i, " ".join(words)))
    join = jaccard.NgramJaccardJoin(docs_of(rows), seeds=0)
    member = spark.createDataFrame([], "node long, component long")
    runs = join._runs(member)
    in_long = runs.where("long").selectExpr("sum(size(members))").first()[0]
    needed = join._needed(runs, member)
    assert in_long > 3 * len(rows)
    assert needed.count() < in_long / 8  # with d + 1 blocks alone: all of them
    got = {r.doc_id: r.component_id for r in join.documents().collect()}
    assert got == {i: i if i < 300 else i - 300 for i, _ in rows}


@pytest.mark.parametrize("seeds", [0, 1, 50])
def test_seeds_change_no_component(spark, docs_of, seeds):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.NgramJaccardJoin(docs_of(rows), seeds=seeds, small_run=1).documents().collect()}
    assert got == brute_components(rows)


# ---------------------------------------------------------------- op3
def test_mixing_meets_the_limit(spark, docs_of):
    rows = [(i, "tok " * 50, "en", "big" if i % 10 else f"s{i % 3}", 1) for i in range(900)] + [(1000, None, "en", None, 0)]
    got = mixing.mix(docs_of(rows), max_repeats=2.0, block_tokens=100).collect()
    assert len(got) == len(rows) and all(r["copies"] >= 1 for r in got)
    tokens, taken = Counter(), Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r["copies"]
    least = min(v for v in tokens.values() if v)
    total, most = sum(tokens.values()), max(tokens.values())
    a = max(0.0, 1 - math.log(2.0) / math.log(most / least))
    for s, n in tokens.items():
        if n:
            want = n * (n / most) ** (a - 1)
            assert want - 1e-3 * n <= taken[s] <= want + 110, (s, n, want, taken[s])
    assert abs(sum({r.source: r.weight for r in got}.values()) - 1) < 1e-6 and total
    again = mixing.mix(docs_of(rows), max_repeats=2.0, block_tokens=100).collect()
    assert sorted((r.doc_id, r["copies"]) for r in got) == sorted((r.doc_id, r["copies"]) for r in again)


def test_mixing_entropy_and_odd_rows(spark, docs_of):
    rows = [(i, "tok " * 20, "en", "a" if i % 4 else "b", 1) for i in range(400)]
    got = mixing.mix(docs_of(rows), target_entropy=0.65).collect()
    w = {r.source: r.weight for r in got}
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.65) < 1e-3
    odd = docs_of([(*r, "en", None if i % 2 else "s", 1) for i, r in enumerate(ODD)])
    assert mixing.mix(odd).count() == len(ODD) and mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(docs_of([])).count() == 0


# ---------------------------------------------------------------- op4
def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((f"u{rng.randint(0, 9)}", rng.randint(0, 5), n, "t", None, 0, "", n) for n in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(map(warc.capture_order, warc.LoserTree(runs, warc.capture_order))) == sorted(warc.capture_order(e) for r in runs for e in r)


def test_archives_round_trip_in_order(spark):
    pages = [(i, f"http://www.h{i % 3}.org:80/p{i % 7}?q#f", "é" * 600 if i % 4 == 0 else f"<p>{i}\r\n\r\n" + "x" * 1200) for i in range(60)]
    pages += [(60, None, None), (61, "weird\r\nurl", ""), (None, "http://a.b/", "é" * 600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archive_and_index(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert by[56].record_type == "response" and by[0].record_type == by[None].record_type == "revisit" and by[0].refers_to == 56
    ordered = sorted(got, key=lambda r: (r.range_no, r.position))
    keys = [(r.url_key, r.ts) for r in ordered]
    assert keys == sorted(keys)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_index(none).count() == 0


def test_merge_over_many_ranges(spark):
    pages = [(i, f"http://h{i % 11}.org/{i % 5}", f"{i}") for i in range(500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc.write_archives(df, f"{warc.checkpoint_dir(spark)}/many-{random.random()}", records_per_file=20)
    got = warc.merge_runs(warc.read_runs(spark, path), rows_per_range=60).collect()
    ordered = sorted(got, key=lambda r: (r.range_no, r.position))
    assert len({r.range_no for r in got}) > 3 and len(got) == 500
    assert [(r.url_key, r.ts) for r in ordered] == sorted((r.url_key, r.ts) for r in got)


def test_ranges_are_even_when_few_keys_are_sampled(spark):
    pages = [(i, f"http://h{i % 97}.org/{i}", f"{i}") for i in range(2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc.write_archives(df, f"{warc.checkpoint_dir(spark)}/few-{random.random()}", records_per_file=20)
    for sample_keys in (40, 100):  # one key of 50, and of 20, for runs of 20
        got = warc.merge_runs(warc.read_runs(spark, path), rows_per_range=250, sample_keys=sample_keys).collect()
        sizes = Counter(r.range_no for r in got)
        assert sum(sizes.values()) == 2000 and len(sizes) == 8 and max(sizes.values()) < 1000
        ordered = sorted(got, key=lambda r: (r.range_no, r.position))
        assert [(r.url_key, r.ts) for r in ordered] == sorted((r.url_key, r.ts) for r in got)


# ---------------------------------------------------------------- op5
def test_article_text_of_every_page(spark):
    import html as H

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"<(?:br|/?p|/?h1)>", article)]
        assert extract.main_text(r.html) == " ".join(b for b in blocks if b)


def test_page_rules(spark):
    page = """<body><header><a href=/>Site</a></header><nav><ul><li><a href=x>Home</a></li></nav><form>Name <input></form>
      <div id="cookie-notice">We use cookies and that is the way it is for all of us here today.</div><main><h1>Title here</h1>
      <p>This is the first of the long paragraphs and it has a lot of the words that are in the list of them.</p><p>Short &amp; odd</p>
      <aside>The related news of the day and all of it</aside><script>if (a < b) "</p>"</script>
      <section class="comments"><p>I am the reader and this is what I have to say about it all, and more.</p></section></main>
      <footer>© the owner</footer>"""
    text = extract.main_text(page)
    assert text.startswith("Title here This is the first") and text.endswith("Short & odd")
    assert [extract.main_text(x) for x in ("", "<", "<p", "<<>>", "a < b", "<!-- x", "<script>never closed")][0] == ""
    assert extract.main_text("<nav>unclosed menu<article><p>Text</p></article>") == "Text"
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "x" * 100000)], "page_id long, url string, html string")
    assert [r.n_chars for r in extract.extract(df).orderBy("page_id").collect()][:2] == [0, 0]
    assert extract.extract(df.limit(0)).count() == 0


LONG_TEXT = "This is the first of the long paragraphs and it has a lot of the words that are in the list of them."


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>Site</title><meta charset=x><body><p>{LONG_TEXT}</p>", LONG_TEXT),  # a head without its end
    (f"<head><title>Site</title><article><p>{LONG_TEXT}</p></article>", LONG_TEXT),
    (f"<article><h1><a href=/x>A linked heading</a></h1><p>{LONG_TEXT}</p><p>End.</p></article>", f"A linked heading {LONG_TEXT} End."),
    ("<article><p>Read <a href=x>this other long report on the same matter</a> now</p><p>End.</p></article>", "Read this other long report on the same matter now End."),
    (f"<article><p>{LONG_TEXT}</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><p>End.</p></article>", f"{LONG_TEXT} End."),
    (f"<article><div class='social-history box'><p>{LONG_TEXT}</p></div><div class='related-posts'><p>{LONG_TEXT}</p></div></article>", LONG_TEXT),
    (f"<article><div class='adBanner'>Buy it</div><div id='newsletter_signup'>Mail</div><p>{LONG_TEXT}</p></article>", LONG_TEXT),
    ("<body><p>" + "这是一个很长的中文段落，它讲述了很多事情。" * 12 + "</p><p>结束。</p>", "这是一个很长的中文段落，它讲述了很多事情。" * 12 + " 结束。"),
])
def test_pages_off_the_beaten_track(page, text):
    assert extract.main_text(page) == text


def test_page_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG_TEXT}</p>", "x", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in extract.extract(df).collect()] == [(1, "u", LONG_TEXT, len(LONG_TEXT))]


def test_text_about_copyright_is_no_notice():
    heading, short = "Copyright in Europe", "The copyright of a book is held by its author, and the sign © is not needed for that."
    body = "This is the first of the long paragraphs and it has a lot of the words that are in the list of them."
    article = f"<article><h1>{heading}</h1><p>{body}</p><p>{short}</p><p>© 2020 The Owner</p></article>"
    page = f"<body><nav>Home</nav>{article}<div>Copyright (c) 2021 by Site</div><div>© the owner</div><div>Acme. All rights reserved.</div></body>"
    assert extract.main_text(page) == f"{heading} {body} {short}"
    assert extract.main_text(f"<body><div><p>{body}</p><p>{short}</p></div><p>Site © 2021</p></body>") == f"{body} {short}"


# ---------------------------------------------------------------- op6
def test_quality_on_held_out_rows(spark):
    got = queries.op6_quality_classifier(spark, MEDIUM).alias("s").join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) >= 0.97


def test_quality_odd_rows(spark, docs_of):
    docs = docs_of(ODD)
    labels = spark.createDataFrame([(4, 1), (9, 0), (9, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    weights = quality.train(docs, labels, F.lit(True), shards=2)
    scores = quality.score(docs, weights).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert quality.train(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    kept = quality.scored_rows(docs, weights)
    assert kept.columns == [*docs.columns, "score"] and quality.score(docs.limit(0), weights).count() == 0


def test_ftrl_and_scores_match_a_plain_version():
    """Sparse dictionaries and scalar updates in place of arrays."""
    def vector(text):
        data = np.frombuffer(text.encode(), np.uint8)
        out = defaultdict(float)
        for grams, (_, _, scale) in zip(quality.features(data, 12), quality.ORDERS, strict=True):
            for g in grams.tolist():
                out[g] += scale / len(grams)
        return out

    rng = random.Random(3)
    texts = [(" ".join(rng.choice(["Good", "fine,", "word", "x1", "##"][:3 + 2 * bad]) for _ in range(rng.randint(0, 30))), 1 - bad) for bad in (0, 1) * 20]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-3):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    def probability(v):
        return 1 / (1 + math.exp(-max(-30, min(30, sum(weight(i) * x for i, x in v.items())))))

    for _ in range(3):
        for text, label in texts:
            v = {**vector(text), 1 << 12: 1.0}
            p = probability(v)
            for i, w, x in [(i, weight(i), x) for i, x in v.items()]:
                g = (p - label) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w
                n[i] += g * g
    rows = [(*quality.sparse_vector(np.frombuffer(t.encode(), np.uint8), 12), float(label)) for t, label in texts]
    weights = quality.ftrl(rows, 12, 3)
    assert all(abs(weights[i] - weight(i)) < 1e-9 for i in range(len(weights)))
    for text, _ in texts:
        assert abs(quality.text_score(np.frombuffer(text.encode(), np.uint8), weights, 12) - probability({**vector(text), 1 << 12: 1.0})) < 1e-9


def test_a_label_trains_with_one_row(spark, docs_of, monkeypatch):
    docs = docs_of([(1, f"text {k}") for k in range(500)] + [(2, "other text")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    trained = quality.train(docs, labels, F.lit(True), train_rows=2, shards=1)
    once = quality.train(docs_of([(1, "text 0"), (2, "other text")]), labels, F.lit(True), train_rows=2, shards=1)
    assert (trained == once).all()


# ---------------------------------------------------------------- op7
def test_bpe_matches_the_library(spark, docs_of):
    encoder, _ = bpe._tables(bpe.load_ranks(), bpe.public_tokenizers.PATTERN)
    rng = random.Random(2)
    made = [(100 + i, "".join(rng.choice("ab c  \n\t'sé1,.日本") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows = [*ODD, *made, *pairs(spark)[:40]]
    for options in ({"chunk_chars": 50, "overlap_chars": 20}, {"chunk_chars": 32768, "overlap_chars": 1024}):
        got = bpe.decode(bpe.encode(docs_of(rows), **options)).collect()
        want = Counter((i, np.asarray(encoder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
        both = bpe.round_trip(docs_of(rows), **options).collect()
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in both) == want
    assert bpe.encode(docs_of([])).count() == 0 and bpe.round_trip(docs_of([])).count() == 0


# ---------------------------------------------------------------- op8
def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 5)).round(1))]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # one common vector
    bad = [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0]), (440, [float("nan")] * 5), (460, [float("inf")] * 5), (None, [0.0] * 5), (480, [1.0, 2.0]), (500, [])]
    df = spark.createDataFrame([*rows, *bad, rows[0]], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, shard_rows=64, leaf_rows=8, query_rows=10).collect()
    assert sorted(map(tuple, got)) == brute_top([*rows, rows[0]], 7)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_top(rows, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for at, (q, vector) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(vector, v, strict=True)), i) for other, (i, v) in enumerate(whole) if other != at)[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


def test_rows_that_repeat_an_id_are_candidates_of_their_own(spark):
    import duckdb

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.5, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 3.0])] + [(7, [0.25, k / 8]) for k in range(40)]
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, row string, dim int")
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 20 == 0, shard_rows=8, leaf_rows=2, query_rows=2).collect()))
    assert got == brute_top(rows, 20)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(queries.ORACLE_SQL["op8_exact_topk"]).fetchall())


@pytest.mark.parametrize("big", [1e30, 2.0**40])
def test_scores_beyond_a_long_are_an_error(spark, big):
    table = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(table, F.col("vec_id") % 20 == 0).collect()


# ---------------------------------------------------------------- op9
def brute_rules(rows, limit, percent=50):
    held = defaultdict(set)
    norm = lambda x: " ".join(words(x)).lower()
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if words(x):
                held[s, norm(x)].add((i, t))
    out = []
    for i, t, s in rows:
        t = t or ""
        w, real = words(t), [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        cover = {p for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lost = sum(len(words(x)) for x in real if len(held[s, norm(x)]) > limit)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(real) - len(set(real)), len(cover), failed, lost,
                    not failed and not lost * 100 > len(w) * percent))
    return out


def test_rules_match_brute_force(spark, docs_of):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    got = rules.apply_rules(table, max_docs_per_host=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute_rules(rows, 2))
    odd = [(i, t, "en", None if k % 2 else "s") for k, (i, t) in enumerate(ODD)]
    got = rules.apply_rules(docs_of(odd), max_docs_per_host=1).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_rules([(i, t, s) for i, t, _, s in odd], 1)))
    assert rules.apply_rules(docs_of([])).count() == 0


def test_frequent_lines_leave_the_text(spark, docs_of):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    mine = [(-1, "A  menu\n\nfirst\n a MENU \nlast", "en", "s"), (-2, "a menu\n\n", "en", "s"), (-2, "a menu\n\n", "en", "s"), (-3, "a menu", "en", "s"),
            (-4, "a menu\nof another host", "en", None), (-5, None, "en", "s"), (None, "a menu\nno id", "en", "s"), (-6, "", "en", "s")]
    rows = [tuple(r) for r in table.collect()] + mine
    norm = lambda x: " ".join(words(x)).lower()
    held = defaultdict(set)
    for i, t, _, s in rows:
        for x in (t or "").split("\n"):
            if words(x):
                held[s, norm(x)].add((i, t))
    want = [(i, t if t is None else "\n".join(x for x in t.split("\n") if len(held[s, norm(x)]) <= 2)) for i, t, _, s in rows]
    got = rules.cleaned(docs_of(rows), max_docs_per_host=2)
    found = got.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(want)
    assert (-1, "\nfirst\nlast") in want and (-4, "a menu\nof another host") in want and (-2, "\n") in want
    before = {(i, t): len(words(t)) for i, t, _, _ in rows}
    assert sorted(r.n_removed_words for r in found) == sorted(before[i, t] - len(words(w)) for (i, t, _, _), (_, w) in zip(rows, want))
    assert rules.apply_rules(docs_of(rows)).columns == [c for c in got.columns if c != "text"]


# ---------------------------------------------------------------- op10
def brute_lines(rows):
    seen, gone = set(), defaultdict(set)
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        full = [(n, " ".join(words(x)).lower()) for n, x in enumerate((t or "").split("\n")) if words(x)]
        for k in range(max(len(full) - 2, 1) if full else 0):
            run = tuple(x for _, x in full[k:k + 3])
            if run in seen:
                gone[i].update(n for n, _ in full[k:k + 3])
            seen.add(run)
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), len(gone[i])) for i, t in rows]


def test_line_dedup_matches_brute_force(spark, docs_of):
    rows = [*pairs(spark), (10**6, "a\nb\nc\nd\ne"), (10**6 + 1, "x\nB\nC\n\n D \ny"), (10**6 + 2, "b\nc\nd\nb\nc\nd"), (None, "a\nb\nc")]
    got = lines.remove_repeated_lines(docs_of(rows)).select("doc_id", "text", "n_removed_lines").collect()
    assert Counter(map(tuple, got)) == Counter(brute_lines(rows))
    odd = lines.remove_repeated_lines(docs_of(ODD))
    by = {r.doc_id: r for r in odd.collect()}
    assert odd.count() == len(ODD) and by[1].text is None and by[10].text == "" and by[4].text == "one" and by[9].n_removed_lines == 0
    assert odd.columns == [*docs_of(ODD).columns, "n_removed_lines"] and lines.remove_repeated_lines(docs_of([])).count() == 0
