"""All queries and the pipeline over tables with nulls, repeated rows, clashing columns, and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import registry

CLASHING = """row _row row_ batch id tokens family part digest refers_to license template found hash n h1 h2 label place i t o r host path rule verdict rank vec
key dim norm2 query_id score predicted n_lines n_dropped n_words n_hit items contaminated spans component_id n_shingles length piece start offset task k number
archive records bytes owner repo owners repos live many kind blob token side pivot component node many_ a b held_out payload""".split()


def tables(spark, folder, rows: bool):
    extra = {c: F.lit(7) for c in CLASHING}

    def save(name, data, schema, clash=True):
        df = spark.createDataFrame(data if rows else [], schema)
        df = df.withColumns({k: v for k, v in extra.items() if k not in df.columns}) if clash else df
        df.write.parquet(f"{folder}/{name}.parquet")

    words = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \n\t", "x", words, words, words + " more", words.upper(), "é 中文 \U0001f600 " * 30, "a\n" * 500, "word " * 60_000, "y" * 300_000, "token = abc123def456 key0123456789", "Licensed under CC BY 4.0"]
    docs = [(i if i % 5 else None, t, None if i % 3 else "en", None if i % 4 else "s", None if i % 2 else len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[4]] * 12 + [(3, "another text of id three", "en", "s", 24), (None, words, "en", "s", 5)]
    save("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    save("labels", [(1, 1, 0), (2, 0, 0), (2, 1, None), (None, 1, 1), (3, None, 0), (4, 7, 0), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    save("benchmark", [(1, words), (None, "alpha beta"), (2, None), (2, ""), (3, "x"), (3, "x")], "item_id long, text string")
    pages = [(1, "http://a.example.org/es/", "<p>" * 600), (2, None, "<p>" * 600), (2, None, "<p>" * 600), (None, "no url", None), (3, "://", ""), (None, "http://ORG", "<p>" * 600), (4, "https://x.com/fr/é?q#f", "é" * 900)]
    save("pages", pages, "page_id long, url string, html string")
    nan = float("nan")
    save("embeddings", [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (0, [0.5, 0.5]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [0.0, 0.0]), (None, [1.0, 1.0]), (6, [1.0]), (40, [3.0, 4.0])], "vec_id long, embedding array<double>")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("none"), False)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, odd, empty, name):
    n = spark.read.parquet(f"{odd}/documents.parquet").count()
    got = registry.QUERIES[name](spark, odd).collect()
    rows = {"op2": 7, "op5": n, "op6": n, "op7": 7, "op8": n, "op9": n, "op10": n}.get(name.split("_")[0])
    assert len(got) == rows if rows else len(got) >= (n if name.startswith("op3") else 1)
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and {r.score for r in out.select("score").distinct().collect()} <= {7}
        else:
            assert out.count() > 0
    assert corpus_pipeline.run(spark, odd).count() >= 0 and corpus_pipeline.run(spark, empty).count() == 0
