"""Near-duplicates, language, packing, token files and pipeline against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from arborscan.llm import langid, mixing, neardup, packing, shingles, tokenfile, tokens

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(tokens.public())
    own.encode_special_tokens = True
    return own


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def word_set(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i: i + words]) for i in range(len(found) - words + 1)}


def components(docs, words, similarity):
    sets = [(i, word_set(t, words)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                high, low = sorted((root(i), root(j)), reverse=True)
                parent[high] = low
    return {i: (len(x), root(i)) for i, x in sets}


def family(seed, count, words, changes):
    """Copies of one text, each with some words changed: near enough to link in chains, not all to one."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(draw.randrange(changes + 1)):
            own[draw.randrange(words)] = f"x{draw.randrange(5000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("words,similarity,cut", [(3, 85, False), (5, 80, True)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, words, similarity, cut):
    if cut:  # many parts, blocks and stripes
        for name, size in (("_TOGETHER", 4), ("_BLOCK", 3), ("_STRIPE", 5)):
            monkeypatch.setattr(neardup, name, size)
    texts = family(1, 40, 120, 6) + family(2, 25, 60, 3) + ["one two"] * 3 + ["ONE\ttwo", "İ one two", "a", "", None, "  \n", LONG, LONG + " end"]
    texts += [f"unlike text number {i} with words {i * 7}" for i in range(20)]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, component_id string, kept int")
    got = {r.doc_id: r for r in neardup.groups(rows, words, similarity).collect()}
    want = components(docs, words, similarity)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert neardup.groups(spark.createDataFrame([], schema)).count() == 0
    got = neardup.groups(spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, None)], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 7, True)]


def test_circulant_estimates_similarity():
    draw = np.random.default_rng(3)
    hashing = shingles.Circulant(512)
    for share in (0.5, 0.85):
        common = draw.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64)
        own = [draw.integers(0, 1 << 63, int(1000 * (1 - share))).astype(np.uint64) for _ in range(2)]
        a, b = (hashing.signature(np.concatenate([common, x])) for x in own)
        true = len(common) / (len(common) + sum(map(len, own)))
        assert abs((a == b).mean() - true) < 0.1


def test_shingles_of_sliced_arrays():
    texts = ["a b c d", None, "", "x", "A b C  d\n"]
    array = pa.array(["zzz"] + texts)[1:]
    found = list(shingles.sets(array, 3, characters=4))
    assert [len(x) for x in found] == [2, 0, 0, 1, 2]
    assert (found[0] == found[4]).all()


TEXTS = [(4, "Hello, world! don't stop  here\n\n next"), (1, None), (9, ""), (3, "<|endoftext|> naïve Straße 東京 🙂"), (2, LONG), (7, "x" * 9000),
         (8, "tabs\tand\x85other\u2003spaces 'twas 12345 ab12cd we'll"), (6, "Éai les, oution.%%% mentai&&& eau***")]


def test_pieces_encode_like_the_library(spark, tokenizer):
    odd = ["a'b c'd 'll we'll", "x  y   z", " lead", "trail ", "\n\n\n", "a\u00a0b", "co\u0301mbined", "ɏz ˈ word,'s", "(hello)world's", "1,000.5%", "\x1c\x1d word\x1f"]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoded(pa.array(odd), tokens.definition(tokens.public()))] == [ids_of(tokenizer, t)[:-1] for t in odd]


def test_random_texts_encode_like_the_library(tokenizer):
    draw = random.Random(11)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\u2003", "\x85", "\x1c", "a", "word", "É", "été", "×", "÷", "ɏ", "Ж", "東", "🙂", "'s", "'ll", "'", ",", ".", "!?", "12", "½",
             "co\u0301", "Straße", "under_score", "-", "<|endoftext|>"] + [f" neu{i}wort" for i in range(300)]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(3000)]
    column = pa.array([None, "skipped", *texts])[1:]
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoded(column, tokens.definition(tokens.public()))]
    assert got[1:] == [ids_of(tokenizer, t)[:-1] for t in texts]
    small = tokens.Encoder(tokens.definition(tokens.public()))
    small.known = {str(i): b"" for i in range(tokens._REMEMBERED + 1)}  # the memory starts a new generation
    data, bounds = np.frombuffer(texts[5].encode(), np.uint8), np.array([0, len(texts[5].encode())])
    assert [np.frombuffer(b, "<u4").tolist() for b in small.encode(data, bounds)] == [got[6]]


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(i, t, "y") for i, t in TEXTS], "doc_id int, text string, shard string").repartition(3)
    folder = tokenfile.write(docs, tokens.public(), f"file://{tmp_path}/tokens")
    got = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, text) in zip(got, sorted(TEXTS), strict=True):
        ids = ids_of(tokenizer, text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_reader_takes_only_the_frames_it_needs(tmp_path):
    path = f"{tmp_path}/shard"
    with open(path, "wb") as sink:
        writer = tokenfile.ShardWriter(sink)
        bodies = {i: np.arange(i, i + n, dtype="<u4") for i, n in ((1, 10), (2, tokenfile.FRAME_IDS * 2 + 5), (3, 1), (8, 7))}
        for doc_id, ids in bodies.items():
            writer.add(doc_id, ids.tobytes())
        writer.add(None, b"\0\0\0\0")
        writer.close()
    reader = tokenfile.open_shard(f"file://{path}")
    assert len(reader.entries) == 3
    assert (reader.document(8) == bodies[8]).all() and (reader.document(2) == bodies[2]).all() and (reader.document(1) == bodies[1]).all()
    with pytest.raises(KeyError):
        reader.document(0)
    broken = bytearray(open(path, "rb").read())
    broken[int(reader.offsets[1]) + 40] ^= 1
    open(path, "wb").write(bytes(broken))
    reader = tokenfile.open_shard(path)
    assert (reader.document(8) == bodies[8]).all()
    with pytest.raises(Exception):
        reader.document(2)


def test_token_files_of_a_plain_path_get_a_scheme(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    folder = tokenfile.write(docs, tokens.public(), f"{tmp_path}/plain")
    assert folder == f"file://{tmp_path}/plain" and tokenfile.read(spark, folder).count() == 1
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("fs.defaultFS", "viewfs://store/")
    hadoop.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    try:
        assert tokenfile._qualified(spark, "/in/x") == "viewfs://store/in/x"
    finally:
        hadoop.unset("fs.defaultFS")


def test_empty_token_files(spark, tmp_path):
    folder = tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), tokens.public(), f"file://{tmp_path}/none")
    assert tokenfile.read(spark, folder).count() == 0


def packed_right(rows, tokenizer, texts, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, text in texts:
        ids, want = ids_of(tokenizer, text), []
        stops = [len(ids)] if len(ids) <= capacity else list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
        for i, stop in enumerate(stops):
            start = stops[i - 1] if i else 0
            want.append((i, start, stop - start, crc(ids[start:stop])))
        assert sorted(pieces[doc_id]) == want
    return len(by)


def test_packing_keeps_every_id(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, offset int")
    rows = packing.pack_documents(docs, tokens.public(), 256).collect()
    packed_right(rows, tokenizer, TEXTS, 256)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokens.public()).count() == 0


def test_packing_of_a_table_is_tight(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, tokens.public()).collect()
    used = packed_right(rows, tokenizer, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 2048)


def test_plans_use_every_item_once():
    draw = random.Random(5)
    for _ in range(30):
        capacity = draw.choice([10, 64, 2048])
        counts = {draw.randint(1, capacity): draw.randint(1, 60) for _ in range(draw.randint(0, 40))}
        used = defaultdict(int)
        for bins, inside in packing.plan(counts, capacity, groups=7):
            assert bins > 0 and sum(x * k for x, k in inside) <= capacity
            for length, k in inside:
                used[length] += bins * k
        assert used == counts


def test_languages_of_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out))
    rows = langid.predict(docs.where(held_out), model).collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_training_sample_is_bounded_and_of_all_keys(spark, monkeypatch):
    taught = {}
    monkeypatch.setattr(langid, "fit", taught.update)
    rows = [(None, f"aaa null {i}", "x") for i in range(3000)] + [(7, f"bbb seven {i}", "x") for i in range(3000)] + [(i, f"ccc other {i}", "x") for i in range(3000)]
    rows += [(9, "ddd copy", "y")] * 3000 + [(i, f"eee {i}", "y") for i in range(50)]
    collected = []
    frame = type(spark.range(1))
    whole = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(whole(self)) or collected[-1])
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert max(map(len, collected)) <= 2 * 2 * langid.DOCUMENTS
    kinds = [t[:3] for t in taught["x"]]
    assert 50 < len(kinds) <= 2 * langid.DOCUMENTS and all(kinds.count(k) >= 10 for k in ("aaa", "bbb", "ccc"))
    assert taught["y"].count("ddd copy") == 1 and len(taught["y"]) == 51


def test_language_of_odd_texts(spark):
    model = langid.fit({"aa": ["abc abd abe " * 30], "bb": ["xyz xyw xyq " * 30]})
    odd = [None, "", "123 !?", "abc abd", "xyz", "q" * 5000, LONG, "日本語", "ABC"]
    rows = spark.createDataFrame([(i, t, "kept", 1.0) for i, t in enumerate(odd)], "i int, text string, lang string, score double")
    got = {r.i: r for r in langid.predict(rows, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 8)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert got[7].lang_pred == "aa" and got[7].score == 0 and got[0].lang == "kept"
    assert langid.predict(rows, langid.fit({})).where("lang_pred <> 'und'").count() == 0
    assert langid.train(rows.limit(0).withColumn("doc_id", F.lit(1))).languages == ()


def test_phrases_are_longest_matches():
    draw = random.Random(8)
    train = "".join(draw.choice("ab ") for _ in range(300))
    model = langid.fit({"l": [train], "m": ["c"]})
    known = "".join(chr(x) for x in langid.symbols([train], model.alphabet)[0])
    for _ in range(40):
        text = "".join(draw.choice("ab c") for _ in range(draw.randint(1, 200)))
        line = "".join(chr(x) for x in langid.symbols([text], model.alphabet)[0])
        phrases, at = 0, 0
        while at < len(line):
            end = at + 1
            while end < len(line) and line[at: end + 1] in known:
                end += 1
            phrases, at = phrases + 1, end
        assert model.phrases([text])[0][0, 0] == phrases


def test_pipeline_stages(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.select("*", F.lit(1).alias("score"), F.lit("x").alias("epoch"), F.lit(2).alias("_bucket"))
    odd = extra.unionByName(spark.createDataFrame([(-1, None, None, None, None, 1, "x", 2), (-2, "12 34", "en", "s", 5, 1, "x", 2)], extra.schema))
    named = corpus_pipeline.language(spark, odd, FOLDER)
    assert named.columns == odd.columns and named.count() == docs.where("text rlike '[A-Za-z]'").count()
    kept = corpus_pipeline.near_duplicates(spark, named, FOLDER)
    want = components([(r.doc_id, r.text) for r in named.collect()], neardup.WORDS, neardup.SIMILARITY)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    mixed = corpus_pipeline.mixture(spark, kept, FOLDER)
    assert mixed.columns == odd.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in kept.collect()}
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    rows = corpus_pipeline.packed(spark, mixed, FOLDER).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(tokenizer, r.text)) for r in mixed.collect())
    assert len(corpus_pipeline.run(spark, FOLDER).columns) == 7
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, FOLDER)
        assert empty.count() == 0 and empty.columns == docs.columns


def test_mixture_of_skewed_sources(spark):
    rows = [(i, "big" if i % 10 else f"s{i % 3}", 1 + i % 50, "tag") for i in range(3000)] + [(9000, None, 40, "t"), (9001, "none", 0, "t"), (9002, "s1", None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, place string")
    mixed = mixing.mix(docs, max_repeats=3.0, block_tokens=2000)
    got = mixed.collect()
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id] += 1
    assert set(copies) == {r[0] for r in rows} and copies[9001] == 1
    tokens_in, available = defaultdict(int), defaultdict(int)
    for r in got:
        tokens_in[r.source] += r.n_tokens
    for i, s, n, _ in rows:
        available[s] += n or 0
    assert tokens_in["big"] == available["big"]
    assert all(tokens_in[s] <= 3 * available[s] + 50 for s in available)
    assert max(tokens_in[s] / available[s] for s in available if available[s]) > 2.9
    assert mixing.mix(docs.limit(0)).count() == 0


def test_weights_reach_an_entropy(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("z", 0)], "source string, tokens long")
    rows = mixing.weights(totals, max_repeats=None, entropy=0.9).collect()
    share = np.array([r.weight for r in rows if r.weight])
    assert abs(-(share * np.log(share)).sum() - 0.9) < 1e-6 and abs(share.sum() - 1) < 1e-9
    with pytest.raises(ValueError):
        mixing.weights(totals, 2.0, 0.5)


def test_registered_queries_of_this_subpackage():
    names = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert {f"op{i}" for i in range(1, 11)} <= names and "pipeline" in contract.queries()


def test_memory_of_an_encoder_is_small(monkeypatch):
    own = tokens.Encoder(tokens.definition(tokens.public()))
    for step in range(5):
        own._ids([f"x{n}" for n in range(60_000 * step, 60_000 * (step + 1))])
    assert len(own.known) + len(own.older) <= 250_000
    sizes = []

    class Sized:
        def encode(self, data, bounds):
            sizes.append(len(data))
            return [b""] * (len(bounds) - 1)

    monkeypatch.setattr(tokens, "encoder", lambda definition: Sized())
    assert len(list(tokens.encoded(pa.array(["word " * 20_000] * 100), ""))) == 100
    assert sum(sizes) == 10_000_000 and max(sizes) <= 1 << 22
