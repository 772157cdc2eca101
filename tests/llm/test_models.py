"""Packing, neighbours, URL filters, WARC, the classifier and the pipeline."""

import hashlib
import io
import random
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import packing, quality, registry, urls, warc
from lodestone.llm.neighbours import nearest
from lodestone.llm.packing import Plan, pack

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- packing


def check_packing(rows, length):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_pieces_and_sequences(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = registry.op3_best_fit_packing(spark, sf).collect()
    want = {}
    for d in docs.collect():
        ids = [*tok.encode(d.text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d.doc_id, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    used, total = check_packing(rows, 2048), sum(r.length for r in rows)
    assert used <= -(-total // 2048) + 2


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "e", "s", 0), (1, "", "e", "s", 0), (None, "a <|endoftext|> 中文", "e", "s", 0)], DOCS)
    rows = pack(spark, df).collect()
    assert sorted(r.length for r in rows)[:2] == [1, 1] and len(rows) == 3 and check_packing(rows, 2048) == 1
    assert pack(spark, df.filter("false")).count() == 0


def test_both_tokenizers_agree():
    slow, _ = packing._encoders(None)
    for t in ["It's 12 o'clock,  now\n\n\tgo", "Übergröße naïve café ß", "x" * 500, " ", "a b", "0x1f != 'tis"]:
        assert packing.token_ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_local_search_keeps_the_pieces_and_saves_sequences(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(200, 1200) for _ in range(400))
    plan = Plan(counts, 2048)
    before = plan.sequences
    squares = sum(n * sum(p) ** 2 for p, n in plan.groups.items())
    plan.improve()
    held = Counter()
    for p, n in plan.groups.items():
        assert sum(p) <= 2048
        for s in p:
            held[s] += n
    assert held == counts and plan.sequences <= before
    assert sum(n * sum(p) ** 2 for p, n in plan.groups.items()) >= squares


def test_local_search_betters_a_poor_plan():
    rng = random.Random(8)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000))
    plan = Plan(counts, 2048, rising=True)
    least, before = -(-sum(s * n for s, n in counts.items()) // 2048), plan.sequences
    assert before > 1.1 * least
    assert plan.improve().sequences <= 1.005 * least + 1


def gaining(plan):
    """An exchange that raises the sum of squared fills, from all pairs of patterns."""
    under = {p: sum(p) for p in plan.groups if sum(p) < plan.length}
    for a, fill in under.items():
        gives = {(s,) for s in a} | {(a[i], a[j]) for i in range(len(a)) for j in range(i + 1, len(a))}
        for b, full in under.items():
            if a == b and plan.groups[a] < 2:
                continue
            for out in gives:
                for back in {*b, 0} if len(out) == 1 else set(b):
                    more = sum(out) - back
                    if 0 < more <= plan.length - full and more > fill - full:
                        return a, b, out, back
    return None


def test_local_search_ends_where_nothing_gains():
    rng = random.Random(5)
    counts = Counter(rng.randint(300, 1000) for _ in range(1000))
    plan = Plan(counts, 2048)
    assert gaining(plan)
    before = plan.sequences
    plan.improve()
    held = Counter()
    for p, n in plan.groups.items():
        for s in p:
            held[s] += n
    assert held == counts and plan.sequences < before and gaining(plan) is None


# ---------------------------------------------------------------- neighbours


def brute_nearest(vectors, asked, k):
    out = {}
    for q in asked:
        near = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in near[:k]]
    return out


def test_recall_on_the_small_table(spark, sf):
    rows = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in registry.op4_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    x = np.array([rows[i] for i in sorted(rows)], dtype=np.float64)
    ids = np.array(sorted(rows))
    hits = 0
    for q in [i for i in rows if i % 20 == 0]:
        s = x @ np.array(rows[q], dtype=np.float64)
        best = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        assert len(got[q]) == 20
        hits += len(set(best) & set(got[q]))
    assert hits / (20 * len(got)) >= 0.9


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [3.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest(spark, df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    vectors = {0: (1, 0), 20: (0, 2), 1: (1, 1), 2: (1, 1), 3: (3, 1)}
    assert got == brute_nearest(vectors, [0, 20], 20)
    assert nearest(spark, df.filter("false"), df).count() == 0
    assert nearest(spark, df, df.filter("false")).count() == 0


@pytest.mark.parametrize("kind", ["mixed norms", "an outlier"])
def test_recall_where_norms_differ(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)] * 0.5 + rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.exp(rng.normal(0, 0.5, 3000))[:, None] if kind == "mixed norms" else np.where(np.arange(3000) == 7, 3.0, 1.0)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest(spark, df.withColumns({"id": F.lit(1), "key": F.lit(2)}), df.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    each = []
    for q in range(0, 3000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        each.append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
    assert np.mean(each) >= 0.9 and min(each) >= 0.5, (np.mean(each), min(each))


def test_a_hot_bucket_is_spread(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=8), (700, 1)) + rng.normal(size=(700, 8)) * 1e-3, rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits, got = 0, defaultdict(list)
    for r in nearest(spark, df, df.filter("vec_id % 50 = 0"), k=5).collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 1000, 50):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(got[q]))
    assert hits >= 0.9 * 100


# ---------------------------------------------------------------- URLs


def test_url_parts_and_rules():
    assert urls.split("HTTP://A.Example.ORG/p/Q?x#y") == ("a.example.org", "/p/Q")
    assert urls.split("http://h#f/x") == ("h", "")
    assert urls.split(None) == urls.split("no scheme") == urls.split("") == ("", "")
    rules = urls.Rules(registry.RULES)
    assert rules.of("x.example.org", "/es/1") == ("example.org/es/", "block")
    assert rules.of("example.org", "/en/17") == ("example.org/en/1", "block")
    assert rules.of("example.org", "/en/2") == ("org/", "allow")
    assert rules.of("notexample.org", "/es/1") == ("org/", "allow")
    assert rules.of("a.com", "/fr/x") == ("com/fr/", "allow") and rules.of("a.com", "/de/") == ("com/de/", "block")
    assert rules.of("example.org", "") == (None, None) == rules.of("", "")


def test_url_query_matches_brute_force(spark, sf):
    rows = registry.op2_url_filter(spark, sf).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path = urls.split(pages[r.page_id])
        fits = [(x, v) for x, v in registry.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "block" if r.score >= urls.CUT else "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best)


def test_url_model_and_odd_urls(spark):
    model = urls.Regression.fit(list(urls.LABELLED))
    hosts, paths = zip(*(urls.split(u) for u, _ in urls.LABELLED), strict=True)
    assert ((model.scores(list(hosts), list(paths)) >= 0.5) == np.array([v == 1 for _, v in urls.LABELLED])).all()
    held = model.scores(["casino-bets.example.net", "blog.library.example.net"], ["/en/12", "/en/12"])
    assert held[0] > 0.5 > held[1]
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "://", "x"), (3, "http://é.org/ü", "x")], "page_id long, url string, host string")
    got = urls.judge_urls(spark, df, registry.RULES).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in got] == [("", ""), ("", ""), ("", ""), ("é.org", "/ü")]
    assert urls.judge_urls(spark, df.filter("false"), registry.RULES).count() == 0


# ---------------------------------------------------------------- WARC


def test_round_trip_of_odd_pages(spark):
    long = "ü" * 600
    rows = [(1, "http://a/é b\n", long), (5, "u", long), (3, None, long), (5, "u", long), (7, "v", "short"), (8, "v", "short"), (9, "w", None), (None, "n", long), (10, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, h in rows:
        revisit = h == long and i in (1, 3)
        want.append((i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, pages.filter("false")).count() == 0


def test_payloads_come_back(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = warc.write_archives(spark, pages, f"file://{tmp_path}/w", archive_bytes=20_000)
    assert made.count() > 1
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, made, payloads=True, range_bytes=5_000).filter("record_type = 'response'").collect()}
    assert got == {r.page_id: r.html for r in pages.collect()}


def test_archive_reader_on_other_writers_files():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"hello")
        z.writestr("b/c.bin", b"\x00" * 100)
        z.comment = b"PK\x05\x06 in a comment"
    raw = data.getvalue()
    found = warc.Archive(lambda at, n: raw[at : at + n], len(raw))
    at, n = found.locate("a.txt")
    assert raw[at : at + n] == b"hello" and set(found.members) == {"a.txt", "b/c.bin"}
    with pytest.raises(ValueError, match="end of central"):
        warc.Archive(lambda at, n: b"x" * n, 100)


def test_zip64_directory():
    """An archive whose end record holds only markers, so that all numbers come from ZIP64 records."""
    name, body = b"m", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(body), len(body), len(body), len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + entry + end64 + locator + end
    found = warc.Archive(lambda at, n: raw[at : at + n], len(raw))
    at, n = found.locate("m")
    assert raw[at : at + n] == body


# ---------------------------------------------------------------- classifier


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    f, x = np.array([1, 5, 7, 11]), rng.normal(size=4)
    want = 0.3 + (m.w[f] * x).sum() + sum((m.v[f[i]] @ m.v[f[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m._raw(1, np.zeros(4, dtype=int), f, x)[0][0] == pytest.approx(want)


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op9_quality(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.85
    assert got.predicted[got.quality == 1].mean() > 0.95


def test_classifier_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "e", "s", None), (2, "", "e", "s", 0), (2, "a b", "e", "s", 3), (None, "x " * 50_000, "e", "s", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(spark, df.withColumn("score", df.doc_id), quality.train(spark, df, none)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    machine = quality.train(spark, df, some)
    assert all(0 <= r.score <= 1 for r in quality.score(spark, df, machine).collect())
    assert quality.score(spark, df.filter("false"), machine).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, before = docs.columns, docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before.count()
    kept = spark.read.parquet(f"{tmp_path}/3")
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in kept.collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())


def test_rows_that_share_an_id_keep_their_texts(spark, sf):
    texts = ["one two three four five six seven", "eight nine ten eleven twelve thirteen", "eight nine ten eleven twelve thirteen"]
    docs = spark.createDataFrame([(5, t, "en", "s", len(t)) for t in texts], DOCS)
    assert sorted(r.text for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect()) == sorted(texts[:2])


def test_pipeline_on_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_any_benchmark_passage_removes_a_document(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = ["own words " * 1000 + item + " and more" * 1000, "own words " * 1000, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in corpus_pipeline.without_benchmarks(spark, docs, sf).collect()} == {1, 2, 3}


def test_stages_keep_columns_that_have_the_names_of_results(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    names = ["score", "predicted", "n_lines", "n_dropped", "n_words", "n_hit", "spans", "items", "contaminated", "component_id", "row_", "_order"]
    docs = docs.withColumns({n: F.lit(7) for n in names})
    for twice in (docs, docs.unionByName(docs)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, twice, sf)
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
            assert {r[n] for r in got.collect() for n in names} == {7}


def test_rows_of_one_id_are_judged_each(spark, sf):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a), (5, a.upper()), (5, b), (None, b), (None, "x"), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = [r.text and r.text.lower() for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect()]
    assert sorted(got, key=str) == sorted([a, b, "x", None], key=str)
