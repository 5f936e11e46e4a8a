"""The document operators against brute force: edge cases, copies, ties, repeated rows and extra columns."""

import hashlib
import json
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontam, html, langid, licenses, packing, quality, records, simhash, substring, suffix, tokens
from strandlake.llm.common import Rolled, exchange, groups, mix, packed, unpack, within
from strandlake.session import scratch

rng = np.random.default_rng(3)
WORDS = "the and of thing there einer nicht schon über école été año señor con para that is in on it".split()
say = lambda n: " ".join(rng.choice(WORDS, n))
PASSAGE, LONG = say(60), say(9000)
NOTICE = "This work is licensed under the GNU General Public License, version 3. All rights reserved. Licensed under CC BY-NC 4.0."
TEXTS = [None, "", " \t\n", "one", "Two words", "&&& ### 123", say(12), say(13), say(300), f"{say(40)} {PASSAGE} {say(30)}", f"{say(5)}\n{PASSAGE}\n{PASSAGE}", PASSAGE.upper(), LONG, LONG + " tail", NOTICE, f"{say(20)} {NOTICE}", "a a a a a a " * 20, "x" * 5000, "same\nsame\nother\n" * 9, "İstanbul ΑΣ. K <|endoftext|>", PASSAGE, PASSAGE]
ROWS = [(k, t, "en" if k % 3 else None, "s", k, "extra") for k, t in enumerate(TEXTS)] + [(8, TEXTS[8], "en", "s", 1, "again"), (9, say(40), None, None, None, None), (None, PASSAGE, "fr", "s", 1, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def of(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_rolled_windows():
    x = rng.integers(0, 5, 400).astype(np.uint64)
    h = Rolled(x).windows(np.arange(391), 10)
    same = {}
    for k in range(391):
        assert same.setdefault(x[k : k + 10].tobytes(), h[k]) == h[k]
    assert len(set(same.values())) == len(same)


def test_op1(docs, none):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in ROWS]
    for d, w in split:
        for i in range(len(w) - 12) if d is not None else ():
            least[g] = min(least.get(g := tuple(w[i : i + 13]), d), d)
    want = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - 12) if d is not None else ():
            if least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        want[d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = substring.deduplicate(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept_text"])) for r in got) == want
    assert substring.deduplicate(none).count() == 0
    with pytest.raises(ValueError):
        substring.removed_spans(docs, 12, 7)


@pytest.fixture(scope="module")
def hot(spark):
    """One passage in every document, at places of all remainders, and a text in a third of the rows."""
    same = say(90)
    rows = [(k, same if k % 3 == 0 else f"{say(int(k) % 11)} {PASSAGE} {say(5)} {k} {PASSAGE}") for k in range(400)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()


def test_op1_hot_passages_and_copies(hot):
    rows, docs = hot
    least, split = {}, [(d, t.encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            least.setdefault(tuple(w[i : i + 13]), d)
    want = Counter()
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want[d, len(gone)] += 1
    assert of(substring.deduplicate(docs).collect(), "doc_id", "n_removed") == want


def test_op6_hot_passages_and_copies(hot):
    rows, docs = hot
    often = Counter(b[i : i + 200] for _, t in rows for b in [t.encode()] for i in range(len(b) - 199))
    want = Counter()
    for d, t in rows:
        b = t.encode()
        want[d, len({j for i in range(len(b) - 199) if often[b[i : i + 200]] > 1 for j in range(i, i + 200)})] += 1
    got = suffix.repeated_spans(suffix.keyed(docs), 200, 2, 5)
    runs = Counter()
    for r in got.groupBy("uid").agg(F.collect_list("spans").alias("s")).join(suffix.keyed(docs), "uid").select("doc_id", "s", F.length("text").alias("n")).collect():
        runs[r["doc_id"], int(within([bytes(x) for x in r["s"]], r["n"]).sum())] += 1
    assert runs == Counter({k: v for k, v in want.items() if k[1]})


def test_hot_hashes_cost_their_bucket_few_entries():
    n = 60_000
    h = np.where(np.arange(n) % 3 == 0, np.uint64(77), mix(np.arange(n, dtype=np.uint64)))
    columns = [np.arange(n), np.arange(n) * 7, np.arange(n) % 50]

    def first(h, columns):
        order, starts, run = groups(h)
        known = np.empty(n, bool)
        known[order] = columns[0][order] > np.minimum.reduceat(columns[0][order], starts)[run]
        return ~known, known

    sent = [b for b in packed(iter([(h, columns)]), 40, 8, (8, 8, 4), first)]
    assert sum(x for b in sent for x in b.column("n").to_pylist() if x > 0) == len(np.unique(h))
    most = max(sum(-x for b in sent for k, x in zip(b.column("bucket").to_pylist(), b.column("n").to_pylist()) if x < 0 and k == bucket) for bucket in range(40))
    assert most < 2 * n / 3 / 40  # what is known already is dealt evenly
    back = list(unpack(iter(sorted(sent, key=lambda b: b.column("bucket")[0].as_py())), 8, (8, 8, 4)))
    assert sorted(np.concatenate([x[1] for x in back]).tolist()) == list(range(n))


def test_more_buckets_than_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 100).cast("int").alias("bucket"), F.col("id"))
    got = exchange(rows, 100, 8).withColumn("p", F.spark_partition_id()).collect()
    assert all(r["p"] == r["bucket"] % 8 for r in got)
    for p in range(8):
        own = [r["bucket"] for r in got if r["p"] == p]
        assert own == sorted(own)


def test_groups_of_two_hashes():
    h, second = np.array([5, 5, 5, 2, 5], np.uint64), np.array([1, 2, 1, 9, 2])
    order, starts, run = groups(h, second)
    assert [sorted(order[run == k].tolist()) for k in range(len(starts))] == [[3], [0, 2], [1, 4]]


def test_op2():
    w, pair = html.trained()
    right = total = 0
    for page, content in html.labelled_pages(60, seed=5):
        found = html.extract(page, w, pair).split("\n\n")
        for t in content:
            total += 1
            right += any(t in f for f in found)
        wrong = sum(f.split()[-1].startswith("z") for f in found if f)
        right -= wrong
    assert right / total > 0.97
    page = "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two <b>three</b>, and so on it goes.<br><p>Fünf&nbsp;sechs &lt;x&gt;. More words here.</article><div class='comments'><p>First! Nice one.</p></div><footer>(c)</footer>"
    assert html.extract(page, w, pair) == "A & B\n\nOne two three, and so on it goes.\n\nFünf sechs <x>. More words here."
    for odd in (None, "", "<", "<p", "<!-- x", "<script>var a='<p>';", "</p></p>", "<a title=it's>x</a>" * 50, "<div " + "a='\"" * 2000):
        assert isinstance(html.extract(odd, w, pair), str)


def test_op2_attributes_are_names_and_values():
    w, pair = html.trained()
    words = "One two three, and so on it goes. Four five six, and more words of the same article follow here."
    page = lambda tag, more="": html.extract(f"<body>{tag}<h1>Title</h1><p>{words}{more}</p><p>{words}</p></article></body>", w, pair)
    whole = f"Title\n\n{words}\n\n{words}"
    for tag in ("<article>", '<article aria-hidden="false">', '<article data-title="A hidden valley">', "<article title='x hidden=y' data-id=z>", "<article data-hidden>"):
        assert page(tag) == whole, tag
    assert page("<article>", ' <a href="/hidden-valley.html">seven</a> and eight.') == f"Title\n\n{words} seven and eight.\n\n{words}"
    for tag in ("<article hidden>", '<article class="x"HIDDEN>', "<article id=a hidden=''>", '<article style="color:red; display: none">'):
        assert page(tag) == "", tag
    names = lambda tag: html.parse(tag)[0][1].names
    assert names('<div id="content" width="5" data-grid="ad">') == {"content"}
    assert names("<div data-class=ad CLASS = 'post body' id=main/>") == {"post", "body", "main"}
    assert names('<div id=main id="ad">') == {"main"}


def other_pages(n, seed):
    """Pages of another maker: tables, nested boxes and other names than the training pages have; with their true text."""
    draw = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(draw.integers(len(xs)))]
    words = lambda lo, hi: " ".join(draw.choice(WORDS, int(draw.integers(lo, hi))))
    for _ in range(n):
        blocks = [words(3, 8)] + [". ".join(words(8, 25) for _ in range(int(draw.integers(2, 5)))) + "." for _ in range(int(draw.integers(2, 9)))]
        inner = f"<h1>{blocks[0]}</h1>" + "\n".join(f"<p class=par>{b}" + pick("</p>", "") for b in blocks[1:])
        if draw.random() < 0.5:
            inner = f"<div class='row'><div class='col'>{inner}</div></div>"
        inner = pick("<article class=text>{}</article>", "<div class='blog post' id=p1>{}</div>", "<main role=main><section>{}</section></main>", "<div itemprop=articleBody>{}</div>").format(inner)
        links = "".join(f"<a href='/{k}'>{words(1, 3)}</a> | " for k in range(int(draw.integers(4, 12))))
        before = pick("<div id=topbar>{}</div>", "<nav class=top><table><tr><td>{}</td></tr></table></nav>", "<header><b>Site</b> {}</header>").format(links)
        after = pick("<aside><h4>More</h4>{}</aside>", "<div class='related-stories related'>{}</div>", "<ol class=comments><li>Nice one, thanks. <li>{}</ol>").format(links) + f"<footer>{words(3, 9)}. {links}</footer>"
        yield f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p {{}}</style></head><body>{before}{inner}{after}<script>var x = '<p>no</p>'</script></body></html>", "\n\n".join(blocks)


def test_op2_on_pages_of_another_maker():
    w, pair = html.trained()
    pages = list(other_pages(120, 3))
    exact = sum(html.extract(page, w, pair) == text for page, text in pages)
    right = total = kept = 0
    for page, text in pages:
        got, want = Counter(html.extract(page, w, pair).split()), Counter(text.split())
        right, kept, total = right + (got & want).total(), kept + got.total(), total + want.total()
    assert right / total > 0.97 and right / kept > 0.97 and exact > 100


@pytest.mark.parametrize("page", ["<b>" * 20000 + "</i>" * 20000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000, "<p>a" * 20000, "<div>" * 20000 + "x" + "</div>" * 20000, "<article><p>" + "word, and more. " * 60000 + "</p></article>"])
def test_op2_deep_and_long_pages_take_linear_time(page):
    import time

    w, pair = html.trained()
    began = time.process_time()
    text = html.extract(page, w, pair)
    assert time.process_time() - began < 5
    assert ("word, and more." in text) == ("article" in page) and (len(text) > 900_000 or "article" not in page)


def test_op2_table(spark):
    page = next(iter(other_pages(1, 8)))[0]
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "y"), (None, "v", "", "z"), (3, "w", "<p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")  # text clashes with the result's
    got = [tuple(r) for r in html.main_text(df).collect()]
    want = next(iter(other_pages(1, 8)))[1]
    assert Counter(got) == Counter([(1, "u", want), (1, "u", want), (2, None, ""), (None, "v", ""), (3, "w", "")])
    assert html.main_text(df.limit(0)).count() == 0


def test_op2_messages_are_exact():
    nodes, texts = html.parse("<div><p>a</p><p>b<b>c</b></p></div>")
    own, pair = rng.normal(size=len(nodes)), rng.normal(size=(2, 2))
    z, m = 0.0, np.zeros(len(nodes))
    for s in range(1 << len(nodes)):
        x = [s >> k & 1 for k in range(len(nodes))]
        p = np.exp(sum(o * v for o, v in zip(own, x)) + sum(pair[x[n.parent]][x[k]] for k, n in enumerate(nodes) if k))
        z, m = z + p, m + p * np.array(x)
    for trees in ([nodes], [nodes[:1], nodes, html.parse("<p>x</p>")[0], nodes]):  # by itself, and among others
        forest = html.Forest(trees)
        x = np.zeros(sum(map(len, trees)))
        for at, tree in zip(forest.starts, trees):
            if tree is nodes:
                x[at : at + len(nodes)] = own
        got, joint, logz = html.marginals(forest, x, pair)
        for at, tree in zip(forest.starts, trees):
            if tree is nodes:
                assert np.allclose(got[at : at + len(nodes)], m / z) and np.isclose(logz[at], np.log(z))
        assert np.allclose(joint[forest.parent >= 0].sum(axis=(1, 2)), 1)


def encoded(end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x, *_ in ROWS]


crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, docs, none):
    folder = scratch(spark, "t")
    manifest = records.write_records(docs, folder, tokens.vocabulary())
    got = records.read_records(manifest).collect()
    assert of(got, "doc_id", "n_tokens", "ids_crc32") == Counter((d, len(i), crc(i)) for d, i in encoded(2))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    m = manifest.first()
    assert len(records.read_record(m["records"], 0)) > 0
    assert records.read_records(records.write_records(none, scratch(spark, "t"), tokens.vocabulary())).count() == 0
    with pytest.raises(ValueError):
        import io

        records.unframe(io.BytesIO(records.frame(b"abcdef").replace(b"c", b"d")))


def test_op4(spark, docs, none):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "Two words"), (2, "one"), (10, "gnu general public license"), (3, None), (4, "!!"), (None, "and")], "item_id long, text string")
    assert decontam.windows(bench, 13).count() == 51  # null, empty and nameless items have none
    window = lambda w: [tuple(w)] if 0 < len(w) < 13 else [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
    items = [(i, w) for i, t in ((1, PASSAGE), (2, "Two words"), (2, "one"), (10, "gnu general public license")) for w in window(decontam.words_in(t.encode()))]
    want = Counter()
    for d, t, *_ in ROWS:
        w = decontam.words_in((t or "").encode())
        hit, ids = set(), set()
        for i, x in items:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    ids.add(i)
        want[d, len(w), len(hit), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    for most in (1_000_000, 20, 3):  # one pass, and several
        got = decontam.contamination(docs, bench, most=most).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"])), r["contaminated"]) for r in got) == want
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_op5(docs, none):
    got = quality.judge(docs).collect()
    want = Counter()
    for d, t, *_ in ROWS:
        w = (t or "").encode().split()
        threes = Counter(zip(w, w[1:], w[2:]))
        rep = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if threes[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want[d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    assert of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.judge(none).count() == 0


def kneser_ney(words, order=quality.ORDER):
    """Modified Kneser-Ney over words by dictionaries: p(symbol, context) and the symbols."""
    counts = [Counter() for _ in range(order + 1)]
    for w in words:
        w = f" {w} "
        for i in range(1, len(w)):
            g = w[max(0, i - order + 1) : i + 1]
            counts[len(g)][g] += 1
    for k in range(order - 1, 0, -1):
        for g in {g[1:] for g in counts[k + 1]} if k else ():
            if not g.startswith(" ") or len(g) == 1:
                counts[k][g] = sum(x[1:] == g for x in counts[k + 1])
    symbols = sorted(counts[1])
    off = []
    for k in range(1, order + 1):
        n = [0, *(sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4))]
        if not n[1] or not n[2]:
            off.append([0, 0.5, 0.5, 0.5])
            continue
        y = n[1] / (n[1] + 2 * n[2])
        off.append([0, *(min(j, max(0.1, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else j / 2 for j in (1, 2, 3))])

    def p(symbol, context):
        k = len(context) + 1
        below = p(symbol, context[1:]) if context else 1 / (len(symbols) + 1)
        own = {g[-1]: c for g, c in counts[k].items() if g[:-1] == context}
        if not own:
            return below
        d = [off[k - 1][min(c, 3)] for c in own.values()]
        mine = own.get(symbol, 0)
        return (mine - off[k - 1][min(mine, 3)] + sum(d) * below) / sum(own.values())

    return p, symbols


def test_op5_model_against_dictionaries(spark):
    texts = {"en": [say(60), say(9), "ab ab abc zzz"], None: ["über über ab", "x"], "one": ["q"]}
    rows = [(k, t.encode(), lang) for k, (lang, ts) in enumerate(texts.items()) for t in ts] + [(9, b"", "en"), (10, b" \n", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text binary, lang string")
    table = quality.model(quality.count(df))
    path = scratch(spark, "model")
    quality.sharded(table, path)
    for lang, ts in texts.items():
        p, symbols = kneser_ney([w for t in ts for w in t.split()])
        got = {r["gram"]: r["p"] for r in table.where(F.col("lang").eqNullSafe(lang)).collect() if r["p"] is not None}
        assert all(np.isclose(x, p(g[-1], g[:-1])) for g, x in got.items() if g) and len(got) > len(symbols)
        assert all(np.isclose(sum(p(x, c) for x in [*symbols, "unknown"]), 1) for c in ("", *{g[:-1] for g in list(got)[:40] if g}))
        words = quality.Words([t.encode() for t in ts] + [b"abx  never seen \xc3\xbc ab"])  # known words and others, which back off
        (logs, n), again = quality.word_logs([(words, quality.seed_of(lang)), (quality.Words([b"q ab"]), quality.seed_of("one"))], path)
        assert np.allclose(again[0], quality.word_logs([(quality.Words([b"q ab"]), quality.seed_of("one"))], path)[0][0])
        for w, x, m in zip(words.words, logs, n):
            s = f" {w} "
            want = sum(np.log(p(s[i] if s[i] in symbols else "unknown", s[max(0, i - quality.ORDER + 1) : i])) for i in range(1, len(s)))
            assert np.isclose(x, want, rtol=1e-5) and m == len(w) + 1


def test_op5_rejects_low_quality(spark):
    """The driver's labels: of documents that pass the base rules, the band rejects low quality far more often."""
    sf = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, sf).where("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["x"] for r in got.groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("x")).collect()}
    assert share[1] < 0.02 and share[0] > 5 * share[1] and share[0] > 0.1


def test_op5_what_it_counts_grows_with_the_corpus(spark):
    one = spark.createDataFrame([(k, "".join(map(chr, rng.integers(97, 123, 30))).encode(), "en") for k in range(400)], "doc_id long, text binary, lang string").persist()
    assert quality.count(one).count() > 1.5 * quality.count(one.where("doc_id < 200")).count()


def test_op5_ties_and_one_language_without_good_documents(spark):
    same = say(80)
    df = spark.createDataFrame([(k, same, "en") for k in range(9)] + [(20, "too short", "xx"), (21, None, "yy")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[k]["kept"] for k in range(9)) and len({got[k]["log_ppl"] for k in range(9)}) == 1
    assert not got[20]["kept"] and not got[21]["kept"] and got[20]["low"] is None


def test_op6(docs, none):
    texts = [(d, (t or "").encode()) for d, t, *_ in ROWS]
    often = Counter(b[i : i + 400] for _, b in texts for i in range(len(b) - 399))
    want = Counter()
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if often[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want[d, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    got = suffix.deduplicate(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == want
    assert suffix.deduplicate(none).count() == 0


def test_difference_cover():
    for q in (3, 5, 17):
        v, cover = suffix.difference_cover(q)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) == q + 1


def test_op7(docs, none):
    got = packing.pack_documents(docs, tokens.vocabulary()).collect()
    want = Counter((d, k, a, len(i[a : a + 4096]), crc(i[a : a + 4096])) for d, i in encoded(1) for k, a in enumerate(range(0, len(i), 4096)))
    assert of(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, tokens.vocabulary()).count() == 0


@pytest.mark.parametrize("lengths", [[100], [4096] * 5, [2049] * 7, [2048] * 6, [1] * 9000, [1365, 1366, 1365] * 40, rng.integers(1, 4097, 3000).tolist()])
def test_packing_plan(lengths):
    h = Counter(lengths)
    plan = packing.plan(dict(h), 4096)
    packed = Counter()
    for times, parts in plan:
        assert sum(a * b for a, b in parts) <= 4096
        for a, b in parts:
            packed[a] += times * b
    assert packed == h
    bound = max(-(-sum(lengths) // 4096), sum(x > 2048 for x in lengths))
    assert sum(t for t, _ in plan) <= bound * 1.02 + 1


def test_packing_program_covers_and_places_the_pieces():
    draw = np.random.default_rng(11)
    h = Counter(np.minimum(4096, 1 + draw.lognormal(6, 1, 2000).astype(int)).tolist())
    lengths, need = np.array(sorted(h)), np.array([h[x] for x in sorted(h)])
    used, bound = packing.solve(lengths, need, 4096)
    done = np.zeros(len(lengths))
    for config, x in used.items():
        assert sum(lengths[k] * m for k, m in config) <= 4096
        for k, m in config:
            done[k] += m * x
    assert (done >= need * (1 - 1e-6)).all() and (done <= need * 1.02 + 1e-6).all()
    assert sum(used.values()) <= 1.04 * bound and bound >= lengths @ need / 4096 - 1e-6
    out, left = packing.cover(lengths, need, 4096)
    assert left.sum() < 0.2 * need.sum()
    placed = Counter()
    for times, parts in out:
        for a, b in parts:
            placed[a] += times * b
    assert all(placed[a] + r == n for a, r, n in zip(lengths.tolist(), left, need))


def test_op8(spark, none):
    syllables = {"aa": "the ing ion er an".split(), "bb": "der ung sch ein ich".split(), "cc": "que los ado ez ar".split()}
    rows = [(k, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(30)), lang) for k, lang in enumerate(list(syllables) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 ²!", "aa"), (None, rows[0][1], None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df, langid.pieces_file()), ["doc_id", "lang"]).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([out[k]["lang_pred"] == rows[k][2] for k in held]) > 0.95
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(none, langid.fit(none, langid.pieces_file()), ["doc_id"]).count() == 0
    assert langid.identify(df, None, ["doc_id"]).where("lang_pred != 'und'").isEmpty()


def test_op8_forward_sums_all_segmentations():
    names = sorted({"a", "b", "ab", "ba", "aba", "abbaabbaabba", langid.MARK})
    v = langid.Vocabulary(names)
    p = rng.random((v.size + 2, 2)) / 10
    p[v.size], p[v.size + 1] = 0, langid.FLOOR

    def brute(w, lang):  # by words' ends, so that long words end too; exact fractions can't underflow
        from fractions import Fraction

        sums = [Fraction(1)]
        for end in range(1, len(w) + 1):
            got = sum(sums[end - len(x)] * Fraction(float(p[k, lang])) for k, x in enumerate(names) if w[:end].endswith(x))
            sums.append(got if got or w[end - 1] in names else sums[end - 1] * Fraction(langid.FLOOR))
        return sums[-1]

    def log(x):
        return np.log(float(x.numerator >> (s := max(0, x.numerator.bit_length() - 900)))) + s * np.log(2) - np.log(float(x.denominator >> (t := max(0, x.denominator.bit_length() - 900)))) - t * np.log(2)

    words = [langid.MARK + w for w in ("abab", "b", "aabba", "abbaabbaabba" * 5, "ab" * 300, "aabxxxa", "x" * 60)]
    got = langid.log_likelihoods(v, p, words)
    assert np.allclose(got, [[log(brute(w, lang)) for lang in range(2)] for w in words])


def test_op8_training_shares_words_among_segmentations():
    names = sorted({"a", "b", "ab", langid.MARK})
    v = langid.Vocabulary(names)
    p = langid.train(v, [Counter({langid.MARK + "ab": 4, langid.MARK + "a": 1})], rounds=1)
    whole = {"a": 0.05 + 4 / (1 + v.size) + 1, "b": 0.05 + 4 / (1 + v.size), "ab": 0.05 + 4 * v.size / (1 + v.size), langid.MARK: 5.05}
    assert np.allclose(p[: v.size, 0], np.array([whole[x] for x in names]) / sum(whole.values()))


def test_sql_twins(spark, docs):
    con = duckdb.connect()
    documents, benchmark = docs.select("doc_id", "text").toArrow(), spark.createDataFrame([(1, PASSAGE), (2, "one")], "item_id long, text string").toArrow()  # noqa: F841
    for name in ("documents", "benchmark"):
        con.register(name, locals()[name])
    want = sorted(map(repr, con.sql(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, round(score, 9) FROM ({licenses.OP9_SQL})").fetchall()))
    got = sorted(map(repr, [tuple(r) for r in licenses.scan(docs).withColumn("score", F.round("score", 9)).collect()]))
    assert got == want
    assert {"gpl-3.0", "cc-by-nc", "gpl", "cc-by", "reserved"} <= set(next(r["labels"] for r in licenses.scan(docs).where("doc_id = 14").collect()).split(","))
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert licenses.scan(docs.limit(0)).count() == 0
    want = sorted(map(repr, con.sql(f"SELECT * FROM ({substring.OP1_SQL}) WHERE doc_id IS NOT NULL").fetchall()))
    got = substring.deduplicate(docs.where("doc_id is not null")).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"]).hexdigest())) for r in got) == want
    want = sorted(map(repr, con.sql(f"SELECT * FROM ({suffix.OP6_SQL})").fetchall()))
    got = suffix.deduplicate(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]) // 8, hashlib.sha256(r["kept"]).hexdigest())) for r in got) == want
    want = sorted(map(repr, con.sql(f"SELECT doc_id, n_words, n_hit, n_items, contaminated FROM ({decontam.OP4_SQL})").fetchall()))
    got = decontam.contamination(docs, spark.createDataFrame([(1, PASSAGE), (2, "one")], "item_id long, text string")).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), r["contaminated"])) for r in got) == want


def test_op10(docs, none):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [(d, fp(t)) for d, t, *_ in ROWS]
    got = simhash.near_groups(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter(f)
    group = {x: {x} for _, x in f}
    for x in group:
        for y in group:
            if (x ^ y).bit_count() <= 2 and group[x] is not group[y]:
                both = group[x] | group[y]
                for z in both:
                    group[z] = both
    name = {x: min((d for d, y in f if y in group[x] and d is not None), default=None) for x in group}
    assert all(r["component_id"] == name[r["fp"] % (1 << 64)] for r in got)
    assert simhash.near_groups(none).count() == 0
    kept = [(r["doc_id"], fp(r["text"])) for r in simhash.one_of_each(docs).collect()]
    assert sorted(name[x] if name[x] is not None else -1 for x in {min(group[x]) for x in group}) == sorted(-1 if d is None else d for d, _ in kept)
    assert len({min(group[x]) for _, x in kept}) == len(kept)  # one of each group, also of two that begin with one doc_id


@pytest.mark.parametrize("bits", [2, 4])
def test_op10_links_in_dense_lists(spark, bits):
    near = [x ^ (1 << int(b)) for x in rng.integers(0, 1 << 62, 40).tolist() for b in rng.integers(0, 62, 6)]
    base = sorted({*range(1, 4000, 3), *near, 0, (1 << 63) - 1})  # lists of all lengths: most values share 32 bits and more
    signed = [(x,) for x in base] + [(-1,), (-2,), (-(1 << 63),)]
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.near_links(spark.createDataFrame(signed, "fp long"), bits).collect()]
    base = np.array([x % (1 << 64) for (x,) in signed], np.uint64)

    def roots(pairs):
        parent = {int(x): int(x) for x in base}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for u, v in pairs:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
        return [find(int(x)) for x in base]

    linked = [(int(base[i]), int(base[j])) for i in range(len(base)) for j in np.flatnonzero(np.bitwise_count(base[i] ^ base) <= bits)]
    assert roots(links) == roots(linked)
    assert len(links) <= (6 if bits == 2 else 70) * len(base)


def test_op10_tally_drops_pairs_that_share_a_list_alone():
    a = np.array([0, 0x01010101], np.uint64)  # four bytes shared, four differ
    assert (simhash._least_reached(a, 0xFFFFFFFF, 2, 6) == a).all()
    assert (simhash._least_reached(a, 0xFFFFFFFF, 4, 4) == 0).all()


def pipeline_by_force(rows, items):
    """(doc_id, piece, start, length, crc) of the pipeline, without Spark: rows of doc_id and text, benchmark texts."""
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t in rows if t and any(map(str.isalpha, t))]
    f = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3)) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    rows = [min((rows[k] for k in range(len(rows)) if group[k] == g), key=lambda r: r[0]) for g in sorted(set(group))]
    least, out = {}, []
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(d, least.get(tuple(w[i : i + 13]), d))
    for d, t in rows:
        w = t.encode().split()
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        if len(gone) < len(w) or not gone:
            out.append((d, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t))
    tok, pieces = Tokenizer.from_file(tokens.vocabulary()), Counter()
    for d, t in out:
        w, hit = decontam.words_in(t.encode()), set()
        for x in (x for i in items for x in decontam.item_windows(i.encode(), 13)):
            hit |= {p + j for p in range(len(w)) if tuple(w[p : p + len(x)]) == x for j in range(len(x))}
        if not hit or 20 * len(hit) < len(w):
            ids = tok.encode(t, add_special_tokens=False).ids + [1]
            pieces.update((d, k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096)))
    return pieces


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    near = [(100 + k, " ".join(w if i != 40 + k else "other" for i, w in enumerate(TEXTS[8].split())), "en", "s", 1, None) for k in range(3)]
    ids = docs.where("doc_id is not null").unionByName(spark.createDataFrame(near, SCHEMA))
    ids.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, NOTICE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, f) in enumerate(P.STAGES):
        out = f(spark, step, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r["doc_id"] for r in step.select("doc_id").collect()}
    assert seen["language"] == {d for d, t, *_ in [*ROWS, *near] if d is not None and t and any(map(str.isalpha, t))}
    assert 20 in seen["language"] and 21 not in seen["near_duplicates"] and not {100, 101, 102} & seen["near_duplicates"]
    assert 14 not in seen["decontaminate"] and 8 in seen["pack"]
    want = pipeline_by_force([(r["doc_id"], r["text"]) for r in ids.collect()], [NOTICE])
    assert of(step.collect(), "doc_id", "piece", "start", "length", "ids_crc32") == want


def test_pipeline_of_nothing_and_of_rows_without_ids(spark, tmp_path):
    import corpus_pipeline as P

    for name, rows in (("none", []), ("odd", [(None, say(30), "en", None, None, None), (None, say(30), "en", None, None, None), (1, None, None, None, None, None), (2, "x " * 30_000, "en", "s", 1, None), (2, "x " * 30_000, "en", "s", 1, None)])):
        top = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
        got = Counter(r["doc_id"] for r in P.run(spark, top).collect())
        assert got == (Counter() if name == "none" else Counter({None: 2, 2: got[2]})) and (name == "none" or got[2] > 0)


def test_packing_program_carries_the_packing(spark):
    """Of the driver's documents, the program's configurations place nearly all; best fit the few that are left."""
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokens.vocabulary(), 1, 4096)
    h = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(h))
    need = np.array([h[int(x)] for x in lengths])
    out, left = packing.cover(lengths, need, 4096)
    assert lengths @ left < 0.2 * (lengths @ need) and left.sum() < 0.2 * need.sum()
    bound = max(-(-int(lengths @ need) // 4096), int(need[lengths > 2048].sum()))
    assert sum(t for t, _ in packing.plan(h, 4096)) <= bound * 1.01 + 1
