"""Chat, searches, pages and urls against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborscan.llm import ann, chat, htmltext, topk, urlfilter


def test_streamed_edited_and_regenerated_messages(spark):
    log = [(1, "m1", 1, "message", "user", "Hi"), (1, "m1", 2, "delta", None, " there"), (1, "m2", 3, "message", "assistant", ""),
           (1, "m2", 4, "delta", None, "wro"), (1, "m2", 5, "delta", None, "ng"), (1, "m2", 7, "regenerate", None, None),
           (1, "m2", 8, "delta", None, "rig"), (1, "m2", 9, "delta", None, "ht"), (1, "m1", 6, "edit", None, "Hello"),
           (2, "a", 1, "delta", "assistant", "no start"), (None, "n", None, "message", None, None), (3, "d", 1, "message", "user", "same"), (3, "d", 1, "message", "user", "same")]
    random.Random(1).shuffle(log)
    events = spark.createDataFrame([(*e, 0) for e in log], "conv_id long, message string, seq long, kind string, role string, text string, log int")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.fold(events).collect()}
    assert got == {1: [("user", "Hello"), ("assistant", "right")], 2: [("assistant", "no start")], None: [("", "")], 3: [("user", "same")] * 2}
    assert chat.fold(events.limit(0)).count() == 0


def test_formatting_is_reversible_and_masks_the_assistant(spark):
    texts = ["</s>[INST] ok [/INST]", "&lt;/s> &amp; &", "", None, "<s><s>", "[INST", "x" * 50_000, "&#91;INST] [/INST]", "日本 \n"]
    rows = [(i, t, r, texts[(i + t) % len(texts)]) for i in range(9) for t, r in enumerate(["user", "assistant", "system", "assistant", None, "<s>"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold(chat.rows_as_events(df))).select(
        "conv_id", chat.turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("loss"), "formatted", "segments").collect()
    for r in out:
        want = [(role or "", text or "") for i, _, role, text in rows if i == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted


def searchable(spark, n=700, dims=6, seed=2):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, dims)), 2).astype(np.float32)
    x[50:90] = x[0]
    rows = [(int(i), [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(9000, None, 1), (9050, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (9100, [float("nan")] * dims, 1), (9150, [float("inf")] * dims, 1), (None, [1.0] * dims, 1)]
    return x.astype(float), spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 150)
    monkeypatch.setattr(topk, "QUERIES", 5)
    x, df = searchable(spark)
    q = np.floor(256 * x).astype(np.int64)
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    want = []
    for i in range(0, len(x), 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(len(x)) if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == want
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 1


def test_repeated_ids_do_not_crowd_out_others(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(120, 6))
    x[3] *= 9  # the best of many queries stands fifty times, with unlike rows too
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] * 2 + [(3, [float(v) for v in x[3]])] * 50
    rows += [(3, [float(v) for v in x[3] * (1 + n / 100)]) for n in range(1, 41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, set()).add(tuple(v))

    def want(query, k, score):
        best = sorted((-max(score(q, v) for q in vectors[query] for v in vectors[j]), j) for j in vectors if j != query)[:k]
        return [(query, n + 1, j) for n, (_, j) in enumerate(best)]

    whole = lambda q, v: sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(q, v))
    got = [(r.query_id, r.rank, r.vec_id) for r in topk.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [x for i in range(0, 120, 20) for x in want(i, 5, whole)]
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()}
    exact = {(i, j) for i in range(0, 120, 20) for _, _, j in want(i, 5, lambda q, v: float(np.dot(q, v)))}
    assert len(got) == 30 and len(got & exact) >= 0.9 * 30


def test_sliced_sums_and_digits():
    draw = np.random.default_rng(4)
    for value in (*range(-40, 41), 255, -256, 1000):
        assert sum(sign << shift if sign > 0 else -(1 << shift) for shift, sign in topk.signed_digits(value)) == value
    for _ in range(20):
        n, dims = int(draw.integers(1, 200)), int(draw.integers(1, 9))
        values = draw.integers(-300, 300, (n, dims))
        block = topk.SlicedBlock(np.arange(n), values, left_out=int(draw.integers(0, 4)))
        weights = draw.integers(-300, 300, dims)
        ids, scores = block.best(weights, -1, 4)
        want = sorted((-int(values[i] @ weights), i) for i in range(n))[:4]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest_neighbours_reach_the_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(x))
    whole = np.stack([x[i] for i in ids])
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    hits = total = 0
    for i in ids[ids % 20 == 0]:
        scores = whole @ x[i]
        scores[ids == i] = -9
        best = set(ids[np.argsort(-scores, kind="stable")[:20]].tolist())
        own = [r for r in got if r.query_id == i]
        assert [r.rank for r in sorted(own, key=lambda r: (-r.score, r.vec_id))] == list(range(1, len(own) + 1))
        assert all(abs(r.score - x[i] @ x[r.vec_id]) < 1e-12 for r in own)
        hits, total = hits + len(best & {r.vec_id for r in own}), total + 20
    assert hits >= 0.9 * total


def test_nearest_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 20)
    x, df = searchable(spark, 300)
    x[7] *= 40  # inner products, not angles: a long vector is near to many
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(8000, [0.0] * 6), (8020, None), (8040, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert all(r.query_id < 300 and r.vec_id < 300 and r.query_id != r.vec_id for r in got)
    hits = 0
    for i in range(0, 300, 20):
        best = sorted((-float(sum(a * b for a, b in zip(x[i], x[j]))), j) for j in range(300) if j != i)[:5]
        hits += len({j for _, j in best} & {r.vec_id for r in got if r.query_id == i})
    assert hits >= 0.9 * 75
    first = sorted((r.rank, r.vec_id) for r in got if r.query_id == 60)
    copies = [j for j in range(300) if j != 60 and (x[j] == x[60]).all()]
    assert len(copies) > 30 and all(a <= b for a, b in zip([v for _, v in first if v in copies], sorted(v for _, v in first if v in copies)))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind, n", [("one long row", 5000), ("lognormal norms", 5000), ("far from all", 5000), ("unit", 15), ("unit", 60)])
def test_nearest_neighbours_of_any_norms(spark, monkeypatch, kind, n):
    monkeypatch.setattr(ann, "ROWS", 1500)
    draw = np.random.default_rng(9)
    x = draw.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one long row":
        x[1] *= 40
    elif kind == "lognormal norms":
        x *= np.exp(draw.normal(size=(n, 1)))
    elif kind == "far from all":  # no query's bucket holds a row but some of the queries
        x = np.where(np.arange(n)[:, None] % 100 == 0, x[:1], -x[:1]) + x / 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % (100 if n > 1000 else 5) == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = range(0, n, 100 if n > 1000 else 5)
    want = {i: set([j for j in np.argsort(-(x @ x[i]), kind="stable").tolist() if j != i][:20]) for i in asked}
    assert all(len(got[i]) == len(want[i]) for i in asked)
    assert sum(len(got[i] & want[i]) for i in asked) >= (0.9 if n > 1000 else 1) * sum(map(len, want.values()))


PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="sidebar"><p>Side {n}</p></div><article><h1>Head&amp;line {n}</h1>{body}<aside>Related</aside><form><label>Name</label></form></article>
<div id="comments"><p>Reader {n}</p></div><footer>Foot &copy;</footer></body></html>"""


def page(n, body):
    return PAGE.format(n=n, body=body)


def test_articles_without_the_rest(spark):
    bodies = ["<p>One <b>bo</b>ld\n text.</p>", "<p>One</p><p>Two&nbsp;&lt;x&gt;</p><ul><li>a</li><li>b</li></ul>", "<p>A</p><div class='ad'>Buy <div>now</div></div><p>B<br>C<p>D",
              "<!-- no --><p>E</p><p></p>", "<h2>F</h2><p>G</p><p>H</p><p>I</p>"]
    want = ["One bold text.", "One Two <x> a b", "A B C D", "E", "F G H I"]
    rows = [(i, f"http://h.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    rows += [(20, "http://other.example/", "<p>No article &amp"), (21, None, None), (22, "http://h.example/x", ""), (23, "x", page(9, bodies[0]).split('<aside>')[0] + '<asi'), (24, "http://h.example/24", page(4, bodies[3]))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(df, htmltext.learn(df)).collect()}
    for i, text in enumerate(want):
        assert got[i].text == f"Head&line {i} {text}" and got[i].n_chars == len(got[i].text)
    assert (got[20].text, got[21].text, got[22].text) == ("No article &", "", "")
    assert got[23].text == "Head&line 9 One bold text." and got[24].text == "Head&line 4 E"
    assert sum(r.fits for r in got.values()) >= 3
    assert htmltext.extract(df.limit(0), htmltext.learn(df.limit(0))).count() == 0


def test_names_that_only_sound_like_the_rest():
    page = ("<body class='has-sidebar'><div class='site-header'>Top</div><article class='post-12 comments-open has-sidebar'><p>Kept</p><div class='post-content has-ads'>Also</div>"
            "<div class='ad-slot-3'>Buy</div><section id='comments'><article class='comment'>Reader</article></section></article><div class='main-nav'>Nav</div></body>")
    assert htmltext.extracted(page, None) == ("Kept Also", False)


def test_wrappers_fold_and_align():
    def keys(text):
        return text.split()

    def fits(wrapper, text):
        return wrapper.span(keys(text)) is not None

    pages = ["body ul li # /li li # /li /ul p # /p /body", "body ul li # /li /ul h2 # /h2 p # /p p # /p /body", "body ul li # /li /ul p # /p p # /p div.x # /div /body"]
    wrapper = htmltext.Wrapper(htmltext.infer([keys(p) for p in pages]))
    assert all(fits(wrapper, p) for p in pages)
    assert fits(wrapper, "body ul " + "li # /li " * 9 + "/ul h2 # /h2 " + "p # /p " * 7 + "/body")
    assert not fits(wrapper, "body table # /table /body") and not fits(wrapper, "body p # /p /body")
    pairs = htmltext.Wrapper(htmltext.infer([keys("body " + "h2 # /h2 p # /p " * n + "/body") for n in (1, 3, 2)]))
    assert fits(pairs, "body " + "h2 # /h2 p # /p " * 6 + "/body")


def test_rules_and_reputation(spark):
    pages = [(1, "HTTP://WWW.Example.COM/en/x?q#f"), (2, "http://a.example.com/en/x"), (3, "http://example.com/en"), (4, "https://b.net/es/1"), (5, "https://b.net/de/1"),
             (6, None), (7, "no scheme"), (8, "x://"), (9, "http://bad.org/1"), (10, "http://sub.bad.org/2"), (11, "http://good.org/3"), (12, "http://notexample.com/en/"), (13, "http://k?x"), (13, "http://k?x")]
    pages += [(100 + i, f"http://bad.org/p{i}") for i in range(60)] + [(200 + i, f"http://good.org/p{i}") for i in range(60)]
    outcomes = [(100 + i, True) for i in range(60)] + [(200 + i, i == 0) for i in range(60)] + [(5, None), (777, True)]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, host int")
    args = spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame(outcomes, "page_id long, bad boolean")
    got = [tuple(r) for r in urlfilter.judge(df, *args).where("page_id < 100").orderBy("page_id").collect()]
    assert got == [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/x", "example.com/en/", "block"), (3, "example.com", "/en", "com/", "allow"),
        (4, "b.net", "/es/1", "net/es/", "block"), (5, "b.net", "/de/1", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "bad.org", "/1", None, "block"), (10, "sub.bad.org", "/2", None, "block"), (11, "good.org", "/3", None, "allow"), (12, "notexample.com", "/en/", "com/", "allow"),
        (13, "k", "", None, "allow"), (13, "k", "", None, "allow")]
    assert urlfilter.judge(df.limit(0), *args).count() == 0
    assert urlfilter.judge(df, args[0].limit(0), args[1].limit(0)).where("verdict = 'block'").count() == 0


def test_outcomes_of_repeated_and_null_page_ids(spark, tmp_path):
    import duckdb

    from arborscan.llm import queries

    draw = random.Random(3)
    pages = [(draw.choice([1, 1, 1, None, 2, 3 + i]), f"http://h{draw.randint(0, 9)}.d{draw.randint(0, 3)}.org/x/{draw.randint(0, 60)}") for i in range(400)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)]
    tables = {"pages": spark.createDataFrame(pages, "page_id long, url string"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    seen = []
    judged = queries.urlfilter.reputation
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries.urlfilter, "reputation", lambda hosts, outcomes: seen.append(outcomes) or judged(hosts, outcomes))
        queries.op10_url_filter(spark, str(tmp_path)).count()
    want = duckdb.sql(f"""SELECT regexp_extract(url, '://([^/]*)', 1), count(*), sum((quality = 0)::INT)::INT FROM '{tmp_path}/pages.parquet/*.parquet'
     JOIN '{tmp_path}/labels.parquet/*.parquet' ON doc_id = regexp_extract(url, '/([0-9]+)', 1)::BIGINT GROUP BY 1 ORDER BY 1""").fetchall()
    got = seen[0].groupBy("host").agg(F.count("*"), F.sum(F.col("bad").cast("int"))).orderBy("host").collect()
    assert [tuple(r) for r in got] == want


def test_digest_of_a_trap_conversation(spark):
    from arborscan.llm import queries

    row = queries.op3_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    trap = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{trap}\nassistant\n{trap}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(trap), hashlib.sha256(trap.encode()).hexdigest())
