"""Plain versions of what SQL can't say, and very long inputs."""

import random
import re
import time
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as decon
from lodestone.llm import licenses, quality, secrets, urls
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.words import ALNUM, Block

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


# ---------------------------------------------------------------- licences


def words(t):
    return [m for m in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_aligned_matches_cover_what_a_plain_lcs_does(spark):
    rng = random.Random(11)
    long = [(i, n, t) for i, (n, t) in enumerate(licenses.TEMPLATES) if len(words(t)) > 30]
    texts, of = [], []
    for i, _, t in long:
        for share in (0.0, 0.03, 0.08, 0.15, 0.4):
            mine = []
            for w in re.findall(r"\S+", t):
                r = rng.random()
                mine += [w] if r >= share else [[], [f"qq{rng.randrange(99)}"], [w, f"qq{rng.randrange(99)}"]][rng.randrange(3)]
            texts.append("\n".join(["zz yy xx " * 5, " ".join(mine), "ww é vv " * 5]))
            of.append(i)
    got = {(r.doc_id, r.template): r for r in licenses.scan_licenses(spark, frame(spark, texts)).collect()}
    found = 0
    for d, i in enumerate(of):
        template = words(licenses.TEMPLATES[i][1])
        want = longest_common(template, words(texts[d])) / len(template)
        row = got.get((d, i))
        if want >= licenses.COVERAGE:
            assert row is not None and row.coverage == pytest.approx(want), (d, i, want)
            inside = words(texts[d][row.start : row.end])
            assert longest_common(template, inside) == round(want * len(template)) and inside[0] in template and inside[-1] in template
            found += 1
        else:
            assert row is None
    assert found > 3 * len(long)


def test_many_notices_in_one_text(spark):
    text = "é " + " Released under the MIT License. x" * 30_000
    began = time.time()
    rows = licenses.scan_licenses(spark, frame(spark, [text])).collect()
    assert len(rows) == 30_000 and {text[r.start : r.end] for r in rows} == {"Released under the MIT License"}
    assert time.time() - began < 60


def test_licences_with_clashing_columns_and_no_rows(spark):
    df = frame(spark, ["Licensed under CC BY 4.0", None]).withColumns({c: F.lit("x") for c in ("license", "template", "coverage", "start", "end")})
    rows = licenses.scan_licenses(spark, df).collect()
    assert {r.doc_id for r in rows} == {0} and [r.license for r in rows if r.coverage == 1] == ["CC-BY-4.0-notice"]
    assert licenses.scan_licenses(spark, df.filter("false")).count() == 0


# ---------------------------------------------------------------- secrets


def plain_spans(texts, owners):
    """All spans, by loops over the text of each kind; ownership by sets."""
    entropy = lambda v: -sum(v.count(c) / len(v) * log2(v.count(c) / len(v)) for c in set(v))
    found = []
    for t in texts:
        t, base, more = t or "", [], []
        for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            if len(m[2]) >= 6:
                base.append((m.start(), 0, m.end(), m[2]))
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        for m in re.finditer("[A-Za-z0-9+/_-]+", t):
            if len(m[0]) >= 20 and not m[0].isdigit() and entropy(m[0]) >= secrets.BITS and sum(c in "0123456789" for c in m[0]) >= 3:
                more.append((m.start(), 3, m.end(), m[0]))
        for m in secrets._VALUE.finditer(t):
            name = re.search(r"""([A-Za-z]+)["']?\x20{0,4}\Z""", t[: m.start()])
            if name and re.search("(auth|bearer|cert|credential|credentials|key|pass|pat|pin|pwd|session|sig|signature)$", name[1].lower()) and sum(c in "0123456789" for c in m[1]) >= 3:
                more.append((m.start(1), 4, m.end(1), m[1]))
        more += [(m.start(1), 5, m.end(1), m[1]) for m in re.finditer(r"://[^\s/:@]{1,64}:([^\s/:@]{4,})@", t)]
        last = 0
        for x in sorted(more, key=lambda x: (x[0], -x[1])):
            if x[0] >= last and not any(x[0] < b and a < x[2] for a, _, b, _ in base):
                base.append(x)
                last = x[2]
        found.append(sorted(base))
    out = []
    for spans in found:
        mine = []
        for a, k, b, v in spans:
            holders = [i for i, s in enumerate(found) if any(x[3] == v for x in s)]
            live = len({owners[i] for i in holders}) <= secrets.MOST_OWNERS and len(holders) <= secrets.MOST_REPOS
            if k < 3 or live:
                mine.append((a, k, b, live))
        out.append(mine)
    return out


def test_spans_match_a_plain_scan(spark):
    rng = random.Random(3)
    value = lambda n, c: "".join(rng.choice(c) for _ in range(n))
    lower, mixed = "abcdefghij0123456789", "abcXYZ0123456789+/_-"
    pool = [value(24, lower) for _ in range(6)] + [value(30, mixed) for _ in range(6)] + ["0123456789abcdef" * 2, "AKIA" + "Q2" * 10]
    forms = ["token = {}", 'API_KEY:"{}"', "see {} there", "auth: '{}'", "my_key={}", "https://me:{}@host/x", "private key : {}", "pass={}", "{}"]
    texts = [None, "", "https://a:b@c", "passwordé = abcdef1"]
    for _ in range(150):
        parts = [rng.choice(["and", "é", "x:", "=", "the 12345"]) for _ in range(rng.randrange(6))]
        parts += [rng.choice(forms).format(rng.choice(pool) if rng.random() < 0.5 else value(rng.randint(4, 40), rng.choice([lower, mixed]))) for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    owners = [f"o{i % 7}" for i in range(len(texts))]
    got = secrets.scan_secrets(spark, frame(spark, texts, lambda i: owners[i])).orderBy("doc_id").collect()
    want = plain_spans(texts, owners)
    assert [[(s.start, s.kind, s.end, s.live) for s in r.spans] for r in got] == want
    kinds = {k for spans in want for _, k, _, _ in spans}
    assert kinds == set(range(6)) and any(not live for spans in want for *_, live in spans)


def test_secrets_of_a_long_text():
    text = " ".join(f"token=abc{i:09d} zq{i * 7919 + 12345:010d}QwErTyUiOp" for i in range(40_000))
    began = time.time()
    assert len(secrets.candidates(text)) == 80_000
    assert time.time() - began < 20


# ---------------------------------------------------------------- URLs


def test_hosts_of_very_many_labels():
    rules = urls.Rules([("example.org/es/", "block"), ("org/", "allow"), ("a.b.c.d/", "block")])
    began = time.time()
    long = "a." * 1_000_000
    assert rules.of(long + "example.org", "/es/x") == ("example.org/es/", "block")
    assert rules.of(long + "org", "/es/x") == ("org/", "allow")
    assert rules.of(long + "com", "/") == (None, None) and rules.of("", "/") == (None, None)
    assert rules.of("a.b.c.d", "/x")[0] == "a.b.c.d/" and rules.of("b.c.d", "/x")[0] is None and rules.of("x.a.b.c.d", "/")[0] == "a.b.c.d/"
    assert time.time() - began < 1


def test_a_very_long_url(spark):
    df = spark.createDataFrame([(1, "http://" + "a." * 500_000 + "org/" + "x" * 500_000, "c"), (2, None, "c")], "page_id long, url string, verdict string")
    rows = urls.judge_urls(spark, df, [("org/", "allow")]).orderBy("page_id").collect()
    assert rows[0].rule == "org/" and len(rows[0].path) == 500_001 and rows[1].host == ""
    assert urls.judge_urls(spark, df.filter("false"), []).count() == 0


# ---------------------------------------------------------------- classifier


def test_features_match_a_plain_count():
    texts = ["One one two\nthree three  three 42!", "", "x", "Übergröße ist da\n\nÜbergröße ist da", "a b " * 300]
    text, feature, value = quality.features([t.encode() for t in texts], [np.array([1.0, np.nan, 3.0, 40.0, 5000.0])])
    for i, t in enumerate(texts):
        mine = {int(f): float(v) for f, v in zip(feature[text == i], value[text == i], strict=True)}
        each = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
        block = Block([w.encode() for w in each], quality.SPACED) if each else None
        count = {}
        for k in range(len(each)):
            f = int(block.word[k] >> np.uint64(49))
            count[f] = count.get(f, 0) + 1
        norm = sum(np.log1p(n) ** 2 for n in count.values()) ** 0.5
        assert {f: pytest.approx(np.log1p(n) / norm) for f, n in count.items()} == {f: v for f, v in mine.items() if f < quality.WORDS}
        raw, lines = t.encode(), t.split("\n")
        share = lambda ok: sum(map(ok, raw)) / max(len(raw), 1)  # noqa: B023, E731
        letter = lambda b: 97 <= b < 123 or 65 <= b < 91 or b >= 128
        stats = [share(lambda b: not letter(b) and not 48 <= b < 58 and b not in b" \t\n\r\x0b\x0c"), share(lambda b: 48 <= b < 58), share(lambda b: 65 <= b < 91), share(lambda b: b in b" \t\n\r\x0b\x0c"), len(set(lines)) / len(lines)]
        stats += [sum(a == b for a, b in zip(each, each[1:], strict=False)) / max(len(each), 1), len(count) / max(len(each), 1)]
        bins = [min(15, int(np.arcsin(np.sqrt(min(1, s))) * 2 / np.pi * 16)) for s in stats]
        bins += [min(15, int(np.log2(1 + x))) for x in (len(each), 4 * len(raw) / max(len(each), 1), len(each) / len(lines), [1, 0, 3, 40, 5000][i])]
        assert {f for f in mine if f >= quality.WORDS} == {quality.WORDS + 16 * k + b for k, b in enumerate(bins)}


def test_training_rows_are_bounded(spark):
    rng = random.Random(1)
    good, bad = "the quick brown fox jumps over a lazy dog".split(), "click buy now cheap win prize".split()
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(40)) for i in range(300)]
    docs = frame(spark, texts).withColumns({"_order": F.lit(1), "_label": F.lit(1), "_id": F.lit(1), "place": F.lit(1), "label": F.lit(2)})
    docs = docs.unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(2000).select()))  # an id that very many rows share
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] * 3, "doc_id long, quality int")
    for most in (quality.FEATURES, 3000):
        machine = quality.train(spark, docs, labels, most=most)
        rows = quality.score(spark, docs, machine).select("doc_id", "score", "_order").distinct().collect()
        assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 1) for r in rows]) > 0.95
    assert quality.train(spark, docs, labels, most=1).bias == 0


# ---------------------------------------------------------------- benchmark, lines


def test_the_index_takes_little_memory():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    rows = [(str(i), " ".join(rng.choice(vocab) for _ in range(60)).encode()) for i in range(2000)]
    windows = decon._Windows(rows, 13)
    index = decon._Index(windows, {k: np.zeros(len(s), dtype=np.int64) for k, s in windows.every.items()})
    size = sum(x.nbytes for v in index.by_k.values() for x in v) + sum(x.nbytes for x in (windows.begin, windows.size, windows.k, windows.text, windows.first, windows.block.data, windows.block.word, windows.block.start, windows.block.end))
    assert size <= decon.EACH * sum(len(t) for _, t in rows)
    assert len(windows) == 2000 * 48 and index.windows.owners(0) <= {str(i) for i in range(2000)}


def test_long_texts_whole(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    long = "w " * 300_000 + passage + " v" * 300_000
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    row = decon.decontaminate(spark, frame(spark, [long]), bench).first()
    assert (row.n_words, row.n_hit, row.contaminated, row.spans[0].start) == (600_013, 13, False, 300_000)
    lines = "\n".join(["same"] * 100_000)
    assert [r.n_dropped for r in dedup_lines(spark, frame(spark, [lines] * 2), limit=2).collect()] == [100_000] * 2
    assert len(words(passage)) == 13 and len(Block([passage.encode()], ALNUM).word) == 13
