"""The operators of the llm package against brute force, SQL and edge cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from simlattice.llm import ann, bpe, cotrain, hosts, html, jaccard, lm, mixing, queries, rules, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids int, cell long, comp long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def rows_of(texts):
    return [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", None if t is None else len(t), 0.5, 1, 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, short, long, equal, nearly equal and repeated rows; extra columns with names of results."""
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 40)) + f" x{i}" for i in range(4)]
    near = [base[0] + " tail", base[0].replace("alpha", "ALPHA"), "head " + base[1]]
    texts = [None, "", " \n\t", "one", "One", "two words", *base, *near, "a b c d e " * 3000, "é\u00a0ü 日本 \U0001f642 don't <|endoftext|> x" + " y" * 12]
    return spark.createDataFrame(rows_of(texts) + rows_of(texts)[6:8], DOCS)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = plain_words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [2, 4096])
def test_jaccard_equals_brute_force(spark, odd, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SALT", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**6).select("doc_id", "text", "lang", "source", "n_chars"))
    expected = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == expected
    kept = [r.doc_id for r in jaccard.one_per_group(docs).collect()]
    assert sorted(kept) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_trees_drop_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.append(rng.choice(base, rng.integers(10, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64))) for _ in range(30)]
        n = len(sets)
        a, b = jaccard.tree_pairs(np.arange(n), np.array([len(s) for s in sets]), np.arange(n), np.full(n, -1), [jaccard.bitmap(s) for s in sets], 75)
        left = set(zip(a.tolist(), b.tolist()))
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    assert (j, i) in left


def test_rules_against_sql_and_edges(spark, odd):
    check_sql(spark, "op2_rules")
    got = {r.doc_id: r for r in rules.ledger(odd).collect()}
    assert [got[i].n_words for i in range(6)] == [0, 0, 0, 1, 1, 2] and got[0].failures & 1
    assert got[13].n_repeat_words == got[13].n_words == 15000
    rows = rules.ledger(odd)
    only = {(r["policy"], r["rule"]): r for r in rules.ablation(rows).collect()}
    bits = [r.failures for r in rows.collect()]
    for (policy, rule), r in only.items():
        bit, mask = 1 << list(rules.RULES).index(rule), rules.mask(policy)
        assert r["rejected"] == sum(bool(b & bit) for b in bits) and r["rejected_alone"] == sum(b & mask == bit for b in bits)


def check_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    expected = sorted([tuple(str(plain(v)) for v in r) for r in found.fetchall()])
    assert sorted(tuple(str(plain(r[c])) for c in names) for r in df.collect()) == expected


@pytest.mark.parametrize("name", ["op4_mix", "op6_hosts"])
def test_sql(spark, name):
    check_sql(spark, name)


def test_mix_edges(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    again = {(r.doc_id, r.repeats) for r in mixing.mix(odd.repartition(3)).collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}
    taken = collections.Counter()
    for r in rows:
        assert r["size"] == len(plain_words(r.text)) and 0 <= r.repeats <= 2
        taken[r.source] += r["size"] * r.repeats
    for r in rows:
        assert abs(taken[r.source] - r.target) <= max(x["size"] for x in rows if x.source == r.source)
    assert sum({r.source: r.target for r in rows}.values()) <= 1.5 * sum(r["size"] for r in rows) + 1e-6


def test_mix_water_level(spark):
    sources = spark.createDataFrame([(1.0, 1.0), (2.0, 100.0), (3.0, 2.0)], "weight double, cap double")
    assert mixing.water_level(sources, 9.0) == pytest.approx(3.0)
    assert mixing.water_level(sources, 1e6) is None


def test_hosts_edges(spark):
    urls = [None, "no scheme", "http://", "http://A.Example.COM/en/1?x#y", "http://b.net/es/", "http://b.net", "x://c.co.uk/q://r", "x://.a", "http://b.net/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in hosts.judge(pages, hosts.RULES).collect()}
    assert len(got) == len(urls)
    assert [(got[i].host, got[i].path) for i in range(7)] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/en/1"), ("b.net", "/es/"), ("b.net", ""), ("c.co.uk", "/q://r")]
    assert got[3].rule == "example.com/en/" and got[4].verdict == "block" and got[5].rule is None
    assert {r.verdict for r in got.values()} <= {"allow", "block"}


def test_lm_equals_counting(spark, odd):
    docs = odd.select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lm.lm_scores(docs, held, order=3, mu=2.0, block_bytes=20_000).collect()
    seqs = [(r.doc_id, ["<s>", *plain_words(r.text), "</s>"]) for r in docs.collect()]
    counts = collections.Counter()
    for i, q in seqs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tuple(q[j - k + 1 : j + 1]) for k in (1, 2, 3) for j in range(k - 1, len(q)))
    one = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(one.values()), len(one)
    ones, twos = (sum(c == x for c in one.values()) for x in (1, 2))
    d = min(0.9, max(0.1, ones / (ones + 2 * twos)))
    expected = []
    for i, q in seqs:
        base = score = 0.0
        for j in range(1, len(q)):
            c = one.get(q[j], 0)
            base += math.log10((c + 1) / (n + v + 1))
            p = (c - d) / n if c else d * v / n
            for k in (2, 3):
                if j >= k - 1 and counts[tuple(q[j - k + 1 : j])]:
                    p = (counts[tuple(q[j - k + 1 : j + 1])] + 2.0 * p) / (counts[tuple(q[j - k + 1 : j])] + 2.0)
            score += math.log10(p)
        expected.append((i, len(q) - 1, n, round(base, 6), round(score, 6)))
    assert sorted((r.doc_id, r.n_tokens, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(expected)


def test_lm_counts_ngrams_by_all_bits(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    scores = lambda: {r.doc_id: round(r.score, 9) for r in lm.lm_scores(docs, F.col("doc_id") % 3 == 0, order=2).collect()}
    expected = scores()
    turned = lm.mix
    monkeypatch.setattr(lm, "mix", lambda x: (turned(x) << np.uint64(32)) | (turned(x) >> np.uint64(32)))
    assert scores() == expected
    monkeypatch.setattr(lm, "mix", lambda x: turned(x) << np.uint64(24))
    assert scores() == expected


def test_lm_blocks_stay_bounded_on_repeated_rows(spark):
    rows = [(None, "alpha beta " * 50)] * 300 + [(7, f"gamma {i % 10} " * 50) for i in range(300)] + [(i, f"delta {i} " * 50) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) for _, t in rows)
    held = docs.select(F.col("doc_id").alias("id"), "text")
    placed = lm.blocked(held, size // 20_000 + 1, 20_000)
    once, again = (collections.Counter((r.block, r.id, r.text) for r in placed.collect()) for _ in range(2))
    assert once == again and sum(once.values()) == len(rows)
    assert max(collections.Counter({b: sum(n * len(t) for (c, _, t), n in once.items() if c == b) for b, _, _ in once}).values()) < 3 * 20_000
    out = [[(r.doc_id or -1, r.n_tokens, r.train_tokens, round(r.score, 6)) for r in lm.lm_scores(docs, F.col("doc_id") % 3 == 0, block_bytes=b).collect()] for b in (20_000, 10**9)]
    assert sorted(out[0]) == sorted(out[1]) and len(out[0]) == len(rows)


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_lm_automaton_states_and_arcs(monkeypatch, segment):
    monkeypatch.setattr(lm, "SEGMENT", segment)
    texts = ["0abab1", "0abc1", "0x1", "0abaxabcab1"]  # the last two are not learned from
    word = np.array([int(c, 36) for t in texts for c in t])
    place = np.concatenate([np.arange(len(t)) for t in texts])
    names = [sorted({t[j : j + k] for t in texts for j in range(len(t) - k + 1)}) for k in (1, 2, 3)]
    ends = [np.array([names[k - 1].index(t[j - k + 1 : j + 1]) if j >= k - 1 else -1 for t in texts for j in range(len(t))]) for k in (1, 2, 3)]
    seen = [np.array([sum(t[j:].startswith(g) for t in texts[:2] for j in range(len(t))) for g in held]) for held in names]
    n, v, mu, d = 9, 4, 2.0, 0.5
    machine = lm.Automaton(ends, seen, mu, d, n, v)
    assert len(machine.fail) == 1 + sum((c > 0).sum() for c in seen[:2]) and len(machine.keys) == sum((c > 0).sum() for c in seen)
    count = {g: int(c) for held, counts in zip(names, seen) for g, c in zip(held, counts)}

    def p(history, w):
        if not history:
            return (count[w] - d) / n if count[w] else d * v / n
        below = p(history[1:], w)
        return (count.get(history + w, 0) + mu * below) / (count[history] + mu) if count.get(history) else below

    expected = [sum(math.log10(p(t[max(0, j - 2) : j], t[j])) for j in range(1, len(t))) for t in texts]
    assert machine.walk(ends[0], place, 3) == pytest.approx(expected)


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rng = np.random.default_rng(2)
    pieces = ["'", "s", "ll", " ", "\n", "\u00a0", "a", "é", "12", "!", "<|endoftext|>", "日本", "aaaa", "'S"]
    texts |= {1000 + i: "".join(rng.choice(pieces, rng.integers(0, 30))) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(docs, bpe.default_vocabulary(), with_ids=True).collect()}
    for i, text in texts.items():
        ids = whole.encode(text, add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd.drop("cell"), bpe.default_vocabulary()), bpe.default_vocabulary(), name="round")
    assert all(r["round"] == (r.text or "") for r in back.collect())


def test_ann_recall_ties_and_invalid(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0, None] + [0.0] * 62), (9005, [1.0]), (None, [1.0] * 64)]
    first = rows.filter("vec_id = 0").first().embedding
    same = [(9050 + i, first) for i in range(20)]
    all_rows = rows.unionByName(spark.createDataFrame(bad + same, rows.schema))
    got = collections.defaultdict(list)
    for r in ann.nearest(all_rows, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    valid = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()} | {i: np.array(v, float) for i, v in same}
    ids = sorted(valid)
    m = np.array([valid[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for q, found in got.items():
        c = np.round(m @ m[ids.index(q)], 12)
        best = [i for _, i in sorted(zip(-c, ids)) if i != q][:5]
        assert len(found) == 5 and all(abs(s - c[ids.index(i)]) < 1e-9 for i, s in found)
        hit += len(set(best) & {i for i, _ in found})
        total += 5
    assert set(got) == {i for i in ids if i % 50 == 0} and hit >= 0.9 * total
    assert [i for i, _ in got[0]] == [9050, 9051, 9052, 9053, 9054]


def test_ann_groups_hold_a_chunk_of_queries(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.unionByName(rows.filter("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 10**6))
    found = lambda: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(rows, F.col("id") % 2 == 0).collect())
    expected = found()
    matrix = ann.matrix

    def small(column, dim):
        assert len(column) <= 30, "a group of too many rows"
        return matrix(column, dim)

    monkeypatch.setattr(ann, "QUERIES", 10, raising=False)
    monkeypatch.setattr(ann, "PART", 10)
    monkeypatch.setattr(ann, "matrix", small)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert found() == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ann_scan_with_a_carried_bound_reads_less_than_half():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((2000, 64))
    rows = ann.unit(centres[rng.integers(0, 2000, 50_000)] + 0.5 * rng.standard_normal((50_000, 64)))
    queries = rows[:32]
    centroids = ann.fit_centroids(rows[:8192], 223)
    near = np.argsort(-(queries @ centroids.T), axis=1)
    of = np.argmax(rows @ centroids.T, axis=1)
    read = hit = 0
    for i, q in enumerate(queries):
        distance = ((rows - q) ** 2).sum(axis=1)
        first, rest = np.flatnonzero(of == near[i, 0]), np.flatnonzero(of != near[i, 0])
        bound = np.sort(distance[first])[5:6]
        _, at, n = ann.scan(queries[i : i + 1], rows[rest], bound, 6)
        found = np.concatenate([first, rest[at]])
        read += n + len(first) * 64
        hit += len(set(found[np.argsort(distance[found])[:6]]) & set(np.argsort(distance)[:6]))
    assert read < 0.5 * 32 * 50_000 * 64 and hit >= 0.95 * 32 * 6


@pytest.mark.parametrize("bound", [np.inf, 1.9])
def test_ann_scan_keeps_ties_and_everything_when_short(bound):
    rng = np.random.default_rng(3)
    rows = ann.unit(rng.standard_normal((300, 64)))
    rows[200:] = rows[0]
    who, at, _ = ann.scan(rows[:2], rows, np.full(2, bound), 6)
    assert set(at[who == 0]) == {0, *range(200, 300)}
    assert len(ann.scan(rows[:2], rows[:3], np.full(2, np.inf), 6)[0]) == 6
    assert len(ann.scan(rows[:2], rows[:0], np.full(2, np.inf), 6)[0]) == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body><header>Site head</header><nav><ul><li><a href=#>Menu</a></ul></nav>
<div class="ad-7">Buy now</div><div id=main class="post-%d"><h1>Title &amp; more</h1><p>First   paragraph of a long article with words, <b>bold<br>and</b> <a href=x>link</a>.<p>Second paragraph that is long enough.
<form>Name <input></form><aside>Aside</aside><div class="cookie notice">We use cookies</div></div><section class="comments"><p>A reader comment that is rather long to read.</p></section><footer>&copy; foot</footer>"""


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE % i) for i in range(6)] + [(10, None, None), (11, "x", ""), (12, "http://h0.org/z", "<p>Only text &lt;here&gt;"), (13, "http://q.org", "<div <p>a <b")]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == "Title & more\nFirst paragraph of a long article with words, bold and link.\nSecond paragraph that is long enough."
        assert got[i].n_chars == len(got[i].text)
    assert got[10].text == got[11].text == "" and got[12].text == "Only text <here>" and len(got) == len(rows)


def test_html_keeps_text_around_nested_containers(spark):
    def p(name, n):
        return f"<p>{(name + ' ') * n}</p>".replace(" </p>", "</p>")

    nested = f"<html><body><nav>Menu</nav><article><h1>Head</h1><p>Intro.</p>{p('lead', 20)}<section>{p('one', 75)}</section><section>{p('two', 75)}</section></article></body></html>"
    quoted = f"<html><body><article><h1><a href=x>Head</a></h1><div><div>{p('lead', 9)}<blockquote>{p('quote', 90)}</blockquote><p>Fin.</p></div></div></article></body></html>"
    direct = f"<html><body><article>{p('long', 200)}<section><p>Short end of the text, in a section.</p></section></article></body></html>"
    inside = f"<html><body><article><section>{p('all', 90)}</section></article></body></html>"
    cell = f"<html><body><div>Skip</div><table><tr><td>{p('cell', 50)}</td><td><div>{p('more', 300)}</div></td></tr></table></body></html>"
    frame = f"<html><body><h1>Head</h1><article><section>{p('all', 90)}</section></article></body></html>"
    words = lambda name, n: " ".join([name] * n)
    expected = {
        nested: ["Head", "Intro.", words("lead", 20), words("one", 75), words("two", 75)],
        quoted: ["Head", words("lead", 9), words("quote", 90), "Fin."],
        direct: [words("long", 200), "Short end of the text, in a section."],
        inside: [words("all", 90)],
        cell: [words("cell", 50), words("more", 300)],
        frame: ["Head", words("all", 90)],
    }
    hosts_of = {"one": [nested] * 3, "mix": [inside] * 5 + [nested, quoted, direct, frame, cell], "alone": [quoted], "sections": [nested] * 4 + [direct], "cells": [cell] * 2 + [frame]}
    rows = [(i, f"http://{h}.org/{i}", page) for h, pages in hosts_of.items() for i, page in enumerate(pages, 100 * len(h) + ord(h[0]) * 1000)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        found = got[i].split("\n")
        assert [line for line in found if line != "Skip"] == expected[page]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    truth = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(t == g.predicted for t, g in truth) >= 0.9 * len(truth)


def test_isotonic_is_rising_and_exact():
    xs, ys = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(ys) >= 0).all() and np.interp(1.0, xs, ys) == np.interp(2.0, xs, ys)


def test_cotraining(spark):
    got = {r.doc_id: r for r in cotrain.op1_cotrain(spark, "/root/testdata/sf0.01").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert sum(got[r.doc_id].kept == bool(r.quality) for r in truth) >= 0.95 * len(truth)


def test_cotraining_samples_labels_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(cotrain, "SAMPLE", 40)
    drawn = []
    monkeypatch.setattr(cotrain, "co_train", lambda views, y, free: drawn.append((len(y), set(y), free.count())))
    docs = spark.createDataFrame(rows_of([f"{w} {i}" for i, w in enumerate(WORDS * 5)]), DOCS).filter("doc_id < 50")
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(45), *range(100, 5100)]], "doc_id long, quality int")
    cotrain.fit(docs, labels)
    assert drawn == [(40, {0.0, 1.0}, 5)]
    with pytest.warns(UserWarning, match="every document is kept"):
        assert cotrain.fit(docs, labels.filter("doc_id >= 100 or quality = 1")) is None


def test_cotraining_views_teach_each_other(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = (rng.random(6000) < 0.5).astype(float)
    one, two = (rng.standard_normal((6000, 40)) + np.where(np.arange(40) < 6, 0.9, 0) * (2 * y[:, None] - 1) for _ in range(2))
    known, free, test = slice(0, 150), slice(150, 4000), slice(4000, 6000)
    table = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(one[free], two[free])], "one array<double>, two array<double>")

    def accuracy():
        found = cotrain.co_train([one[known], two[known]], y[known], table)
        return [((m.raw(v[test]) >= 0) == y[test]).mean() for m, v in zip(found["views"], (one, two))], found["given"]

    taught, given = accuracy()
    assert all(sum(n for (taker, _), n in r.items() if taker == t) > 500 for r in given for t in (0, 1))
    monkeypatch.setattr(cotrain, "ROUNDS", 0)
    alone, none = accuracy()
    assert none == [] and min(np.array(taught) - np.array(alone)) > 0.01


def test_cotraining_gates():
    y = np.array([1.0] * 40 + [0.0] * 60)
    high, low = cotrain.gates(np.r_[np.full(40, 2.0), np.full(60, -1.0)], y)
    assert (high, low) == (2.0, -1.0)
    assert cotrain.gates(np.zeros(4), np.array([0.0, 1, 0, 1])) == (np.inf, -np.inf)
    views = [cotrain.View(), cotrain.View()]
    for v in views:
        v.mean, v.scale, v.weights = 0.0, 1.0, np.array([1.0, 0.0])
    said = cotrain.claimed(views, [(1, -1), (1, -1)], [np.array([[2.0], [2.0], [0.0]]), np.array([[2.0], [-2.0], [-2.0]])])
    assert [s.tolist() for s in said] == [[1, -1, -1], [1, -1, 0]]


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"a b {i}", "x" if i % 3 else None, 7, 8, 9, 10) for i in range(12)], "doc_id long, text string, source string, _none int, _name int, size int, target int")
    plain = {r.doc_id: r for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    for r in mixing.mix(docs).collect():
        assert (r._none, r._name, r.size, r.target, r.repeats) == (7, 8, 3, plain[r.doc_id].target, plain[r.doc_id].repeats)
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns
    assert {(r._none, r._name, r.size, r.target) for r in copies.collect()} == {(7, 8, 9, 10)}
    assert copies.count() == sum(r.repeats for r in plain.values())


def test_models_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(15)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        assert len(cotrain.classified(odd, labels).collect()) == odd.count()
        fitted = toxicity.fit(odd, labels, F.lit(True))
        assert len(toxicity.scores(odd, fitted).collect()) == odd.count()


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        jaccard.jaccard_components(none), jaccard.one_per_group(none), rules.ledger(none), mixing.repeated(none), hosts.judge(pages, hosts.RULES), lm.lm_scores(none, F.lit(False)),
        bpe.digests(none, bpe.default_vocabulary()), ann.nearest(vectors, F.lit(True)), html.main_text(pages), cotrain.classified(none, labels), toxicity.scores(none, toxicity.fit(none, labels, F.lit(True))),
    ]
    assert [df.collect() for df in results] == [[]] * len(results)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    held = [r.asDict() for r in docs.collect()]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, spark.createDataFrame(held, docs.schema), SF)
        assert out.columns == names
        after = [r.asDict() for r in out.collect()]
        whole = {r["doc_id"]: r for r in held}
        assert after and all(whole[r["doc_id"]] == r for r in after)
        if place == 2:
            expected = brute_components([(r["doc_id"], r["text"]) for r in held])
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in expected.items() if i == c)
        held = after
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(held, docs.schema), SF).collect()
    texts = {r["doc_id"]: r["text"] for r in held}
    assert len(last) == len(held) and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_registration():
    assert sorted({int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES) and "pipeline" in entry.queries()
