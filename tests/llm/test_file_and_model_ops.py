"""Packing, token files, WARC packages, classifiers and the pipeline: round trips, brute force and held-out accuracy."""

import base64
import functools
import hashlib
import importlib.util
import io
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granulo.llm import common, files, grams, language, packing, token_counts, tokens, toxicity, warc

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "a b"), (904, "a b"), (905, "é " * 3000), (906, "xyz" * 2000), (907, "12 34!"), (908, "<|endoftext|> x"), (909, "hello <|endoftext|> x<|endoftext|><|endoftext|>\n <|endoftext")]


@functools.cache
def reference_tokenizer(ordinary):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = ordinary
    return t


def reference_ids(text, ordinary=False):
    """Of the vocabulary file as it is; ordinary: strings of added tokens are like any other."""
    return reference_tokenizer(ordinary).encode(text or "", add_special_tokens=False).ids


# ---- tokens and packing -----------------------------------------------------------------------


def test_identifiers_equal_those_of_the_json_vocabulary(spark, sf):
    path = tokens.default_path()
    texts = [r.text for r in common.table(spark, sf, "documents").limit(60).collect()] + [t or "" for _, t in ODD]
    for t in texts:
        assert tokens.encode(t, path, tokens.ADDED) == reference_ids(t) and tokens.encode(t, path) == reference_ids(t, True)
    assert tokens.encode("hello <|endoftext|> x", path, tokens.ADDED) == [31373, 220, 50256, 2124]


def test_parts_meet_where_tokens_begin():
    path = tokens.default_path()
    r = random.Random(0)
    text = "".join(r.choice(["a", "b ", " c", "  ", "\n", " é", "  x", "1", " 2", "!", " '", "'s", "　"]) for _ in range(4000))
    whole = tokens.encoder(path).encode_ordinary(text)
    for size in (7, 50, 333):
        parts = tokens.parts(text, size)
        assert "".join(parts) == text and [i for p in parts for i in tokens.encoder(path).encode_ordinary(p)] == whole


def test_packing_round_trip(spark, docs_of):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "x", "Zürich"]) for _ in range(r.choice([1, 20, 300, 900])))) for i in range(60)] + ODD
    out = packing.best_fit(docs_of(rows)).collect()
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append(x)
    assert by.keys() == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array([*reference_ids(t), 2], "<u4")
        mine = sorted(by[i], key=lambda x: x.piece)
        assert [x.piece for x in mine] == list(range(len(mine))) and sum(x.length for x in mine) == len(ids)
        at = 0
        for k, x in enumerate(mine):
            assert x.start == at and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            assert x.length == 1024 if k else x.length <= 1024 and (len(ids) > 1024 or x.length == len(ids))
            at += x.length
    seqs = {}
    for x in out:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.best_fit(docs_of([])).count() == 0


def brute_fills(counts, gap):
    have = [x for x, n in counts.items() for _ in range(min(n, 3)) if x <= gap]
    one = {(a,) for a in have if a == gap}
    two = {tuple(sorted((have[i], have[j]))) for i in range(len(have)) for j in range(i) if have[i] + have[j] == gap}
    three = {tuple(sorted((have[i], have[j], have[k]))) for i in range(len(have)) for j in range(i) for k in range(j) if have[i] + have[j] + have[k] == gap}
    return one, two, three


def test_exact_complements_match_brute_force():
    r = random.Random(3)
    for _ in range(60):
        counts = Counter(r.randint(1, 25) for _ in range(r.randint(1, 9)))
        shelf = packing.Shelf(dict(counts), 64)
        for gap in range(1, 60):
            for fill, want in zip((shelf.single(gap), shelf.pair(gap), shelf.triple(gap)), brute_fills(counts, gap), strict=True):
                assert (fill is not None) == bool(want) and (fill is None or tuple(sorted(fill)) in want)


def test_plans_use_every_piece_once():
    r = random.Random(4)
    for _ in range(20):
        counts = dict(Counter(min(64, int(r.expovariate(0.05)) + 1) for _ in range(r.randint(0, 500))))
        plan = packing.plan(counts, 64)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += times
        assert used == Counter(counts)
        need, got = -(-sum(x * n for x, n in counts.items()) // 64), sum(t for _, t in plan)
        halves = sum(n for x, n in counts.items() if 2 * x > 64)
        assert got <= max(need, halves) * 1.1 + 2


# ---- token files ------------------------------------------------------------------------------


def test_token_counts_across_blocks(spark, docs_of, tmp_path):
    rows = [(i, "tok " * (i % 9)) for i in range(40)] + ODD
    folder = f"file://{tmp_path}/t"
    where = token_counts.write_tokens(docs_of(rows, 3), folder)
    want = {i: len(reference_ids(t, True)) for i, t in rows}
    for block in (2, 6, 64, 1 << 20):
        d = token_counts.documents(token_counts.separators(spark, folder, block_bytes=block))
        assert {r.doc_id: r.n_tokens for r in where.join(d, ["file", "ordinal"]).collect()} == want, block
    empty = f"file://{tmp_path}/e"
    assert token_counts.write_tokens(docs_of([]), empty).join(token_counts.documents(token_counts.separators(spark, empty)), ["file", "ordinal"]).count() == 0


def test_tokens_behind_the_last_separator_are_no_document(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([5, 6, 50256, 50256, 7, 7, 7, 50256, 1, 2], "<u2").tobytes())
    got = token_counts.documents(token_counts.separators(spark, f"file://{tmp_path}", block_bytes=4)).collect()
    assert sorted((r.ordinal, r.start, r.n_tokens) for r in got) == [(0, 0, 2), (1, 3, 0), (2, 4, 3)]


# ---- WARC -------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, refers_to string").repartition(2)


def expected(rows, least=0):
    digest = {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows}
    top = {}
    for i, (_, d) in digest.items():
        top[d] = max(i, top.get(d, i))
    return {i: (n, d, "revisit", top[d]) if n >= least and top[d] != i else (n, d, "response", None) for i, (n, d) in digest.items()}


@pytest.mark.parametrize("least", [0, 6])
def test_warc_round_trip(spark, tmp_path, least):
    rows = [(i, f"http://e/{i}", f"<p>{i % 5} é</p>" * (i % 7)) for i in range(50)] + [(60, None, None), (61, "http://e/a b\r\nX: y", ""), (62, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (63, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (64, "u", "z" * 300_000)]
    folder = f"file://{tmp_path}/w"
    warc.write_packages(pages_of(spark, rows), folder, least)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_packages(spark, folder).collect()}
    assert got == expected(rows, least)
    many = warc.record_ranges(spark, folder, range_bytes=500).collect()
    assert sum(len(r.sizes) for r in many) == len(rows) and len(many) > 5


def test_warc_empty(spark, tmp_path):
    warc.write_packages(pages_of(spark, []), f"file://{tmp_path}/w")
    assert warc.read_packages(spark, f"file://{tmp_path}/w").count() == 0


def test_directories_of_other_writers():
    for wide in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in ("a.txt", "b/c.bin"):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                    f.write(name.encode() * 10)
            z.comment = b"a comment"
            z.writestr(zipfile.ZipInfo("packed"), b"x" * 1000, zipfile.ZIP_DEFLATED)
        data = out.getvalue()
        read = lambda at, n, data=data: data[at : at + n]
        d = warc.central_directory(read, len(data))
        assert list(d) == ["a.txt", "b/c.bin", "packed"]
        assert read(*warc.stored_member(read, d, "b/c.bin")) == b"b/c.bin" * 10
        with pytest.raises(ValueError):
            warc.stored_member(read, d, "packed")
    with pytest.raises(ValueError):
        warc.central_directory(lambda at, n: b"", 0)


def test_zip64_directory():
    """The largest forms, written by hand: counts and offsets that only the ZIP64 records hold."""
    import struct

    body = b"hello"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"m" + struct.pack("<HHQQ", 1, 16, 5, 5)
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    at = len(local) + len(body)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + body + central + end64 + locator + end
    read = lambda o, n: data[o : o + n]
    assert read(*warc.stored_member(read, warc.central_directory(read, len(data)), "m")) == body


def test_writer_leaves_whole_files_only(tmp_path):
    with pytest.raises(RuntimeError), files.writer(f"file://{tmp_path}/f.bin") as out:
        out.write(b"part")
        raise RuntimeError
    assert not (tmp_path / "f.bin").exists()


# ---- classifiers ------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = language.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True} and len(got) == docs.count()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_a_rare_language_is_learned(spark, docs_of):
    common.prepare(spark)
    rows = [(i, "the and of with that", "en") for i in range(2000)] + [(5000 + i, "kuma mana saidi wafula", "sw") for i in range(5)] + [(None, "kuma", "sw")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = language.sample(docs, 50)
    assert Counter(x[0] for x in few) == {"en": 50, "sw": 5} and language.train(docs)[0] == ["en", "sw"]


def test_language_odd_rows(spark, docs_of):
    common.prepare(spark)
    rows = [(i, "the and of with that " * 3) for i in range(20)] + [(30 + i, "der die und nicht ein " * 3) for i in range(20)]
    train = spark.createDataFrame([(i, t, "en" if i < 30 else "de") for i, t in rows] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    got = {r.doc_id: r for r in language.predict(docs_of([*ODD, (1, "the and of"), (2, "nicht und die")]), model).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 907)] == ["und"] * 4 and got[900].score == 0
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "de")
    assert language.train(train.limit(0)) is None and {r.lang_pred for r in language.predict(docs_of(ODD), None).collect()} == {"und"}
    assert language.predict(docs_of([]), model).count() == 0


def test_ftrl_separates_and_stays_sparse():
    r = np.random.default_rng(0)
    rows = [(y, np.array([y, 2 + int(r.integers(50))]), np.array([1.0, 1.0])) for y in r.integers(0, 2, 400).tolist()]
    w = language.fit_ftrl(rows, 2, 60)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[52:60] == 0).all()
    assert language.temperature(np.array([[9.0, 0], [0, 9.0], [9.0, 0]]), np.array([0, 1, 1])) > 1


def test_gram_sums_match_counts():
    r = np.random.default_rng(1)
    sym, offs = r.integers(97, 110, 500), np.array([0, 3, 3, 120, 121, 500])
    table = r.normal(size=((1 << 10) + 1, 2))
    table[-1] = 0
    total, count = grams_sums(sym, offs, table)
    for k, (a, b) in enumerate(zip(offs, offs[1:], strict=False)):
        at, n = grams.counts(sym[a:b], (1, 2, 3), 10)
        assert np.allclose(total[k], (table[at] * n[:, None]).sum(axis=0)) and count[k] == n.sum()


def grams_sums(sym, offs, table):
    old, grams.SLICE = grams.SLICE, 64
    try:
        return grams.sums(sym, offs, (1, 2, 3), table, 10)
    finally:
        grams.SLICE = old


def test_toxicity_learns_words_and_misspellings(spark, docs_of):
    common.prepare(spark)
    r = random.Random(0)
    clean = ["river", "stone", "window", "garden", "letter", "morning", "paper", "yellow"]
    make = lambda bad: " ".join(r.choice(clean) for _ in range(40)) + (" disgusting worthless" if bad else "")
    rows = [(i, make(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 1), (5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels)
    probe = [(1, make(True)), (2, make(False)), (3, make(False) + " disgustingg wortthless"), (4, None), (5, ""), (6, "disgusting"), *ODD[2:]]
    got = {x.doc_id: x for x in toxicity.score(docs_of(probe), model).collect()}
    assert [got[i].predicted for i in range(1, 6)] == [1, 0, 1, 0, 0] and all(0 <= x.score <= 1 for x in got.values()) and len(got) == len(probe)
    assert got[903].score == got[904].score
    nothing = toxicity.train(docs_of(rows), labels.filter("toxic = 0"))
    assert {x.predicted for x in toxicity.score(docs_of(probe), nothing).collect()} == {0}
    assert toxicity.train(docs_of(rows), labels.limit(0))[1] < 0 and toxicity.score(docs_of([]), model).count() == 0


def test_toxicity_of_a_text_that_repeats_an_n_gram_without_end(spark, docs_of):
    """100,000 different words share n-grams, whose weights no half-precision number holds."""
    common.prepare(spark)
    long = " ".join(f"abc{k:x}zz" for k in range(100_000))
    k, n = toxicity.bag(pa.array([long]))
    assert n.max() > 65_504
    few = grams.bounded(k, n, toxicity.MAX_BAG)
    assert len(few[0]) == toxicity.MAX_BAG and np.isclose(few[1].sum(), n.sum())
    rows = [(0, long)] + [(i, "plain words here" + (" disgusting worthless" if i % 2 else "")) for i in range(1, 200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    table, bias = toxicity.train(docs_of(rows), labels)
    assert np.isfinite(table).all() and np.isfinite(bias)
    got = {x.doc_id: x for x in toxicity.score(docs_of(rows), (table, bias)).collect()}
    assert all(0 <= x.score <= 1 for x in got.values()) and np.mean([got[i].predicted == i % 2 for i in range(1, 200)]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    """Of the labelled documents that nothing was learned from, nearly all toxic ones are found, and few others."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, sf).filter("held_out").join(common.table(spark, sf, "labels"), "doc_id").collect()
    bad, good = ([x.predicted for x in got if x.toxic == y] for y in (1, 0))
    assert len(bad) > 30 and np.mean(bad) >= 0.85 and np.mean(good) <= 0.04, (len(bad), np.mean(bad), np.mean(good))


def test_toxicity_bags_match_sums():
    texts = pa.array(["Ab cd ab\tzz", "", None, "x" * 200_000 + " q", " lead and lead "])
    table = np.random.default_rng(0).normal(size=(1 << toxicity.BITS) + 1)
    table[-1] = 0
    total, count = toxicity.sums(texts, table)
    for k in range(len(texts)):
        at, n = toxicity.bag(texts.slice(k, 1))
        assert np.isclose((table[at] * n).sum(), total[k]) and np.isclose(n.sum(), count[k])


# ---- pipeline ---------------------------------------------------------------------------------


@pytest.mark.skipif(not importlib.util.find_spec("corpus_pipeline"), reason="the pipeline is not here")
def test_pipeline_matches_brute_force(spark, sf):
    import corpus_pipeline
    from test_text_ops import components_brute, data, dedup_brute, measures

    from granulo.llm import decontamination, line_dedup, quality

    raw = data(spark, sf)
    docs = common.table(spark, sf, "documents")
    led = {r.doc_id: r.kept for r in quality.apply_policy(quality.ledger(docs)).collect()}
    one = [(i, t) for i, t in raw if led[i]]
    assert all(measures(t)[0] >= 10 for _, t in one)
    lines = dedup_brute(one, line_dedup.MIN_RUN_WORDS)
    two = [(i, lines[i]) for i, t in one if lines[i] == t or lines[i].split()]
    groups = components_brute(two)
    three = [(i, t) for i, t in two if groups[i][1] == i]
    bench = [(r.item_id, decontamination.words(pa.array([r.text]))[0]) for r in common.table(spark, sf, "benchmark").collect()]

    def leaks(t):
        h = decontamination.words(pa.array([t]))[0]
        for _, w in bench:
            for d in range(-len(w) + 1, len(h)):
                a, b = max(0, d), min(len(h), len(w) + d)
                e = h[a:b] == w[a - d : b - d]
                if e.sum() >= min(13, len(w)) and decontamination.stretch(e) >= min(13, len(w)):
                    return True
        return False

    short = [(i, t) for i, t in three if len(t) < 3000]
    out = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    assert kept <= {i for i, _ in three} and {i for i, t in short if not leaks(t)} == kept & {i for i, _ in short}
    left = dict(three)
    total = Counter()
    for r in out:
        total[r.doc_id] += r.length
    for i in list(kept)[:40]:
        assert total[i] == len(reference_ids(left[i])) + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_registered_queries_match_sql(spark, sf):
    import __spark_entry__ as entry
    from test_entry import same

    from granulo.llm import registry

    for name, sql in registry.oracle_sql().items():
        same(spark, sf, name, registry.queries()[name], sql)
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
