"""Operators on texts against brute force: on small tables and on cases that break things."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest


from granulo.llm import common, decontamination, line_dedup, ngram_jaccard, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "a b"), (904, "a b"), (905, "é " * 3000), (906, "x" * 300_000), (907, "\n\n\n"), (908, "a b"), (909, "The End."), (910, " nbsp here　wide")]


def random_docs(seed=0, n=60):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and r.random() < 0.5:
            words = r.choice(docs).split(" ")
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(VOCABULARY)
            docs.append(" ".join(words))
        else:
            docs.append(" ".join(r.choice(VOCABULARY) for _ in range(r.randint(1, 120))).replace("w7 ", "w7\n"))
    return list(enumerate(docs))


def data(spark, sf):
    return [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]


# ---- shared hashing ---------------------------------------------------------------------------


def test_word_hashes_agree_with_split():
    texts = [t for _, t in [*random_docs(3), *ODD]]
    h, at = common.word_hashes(pa.array(texts, pa.string()))
    words = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    seen = {}
    for w, x in zip((w for ws in words for w in ws), h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_hashes_across_segments():
    long = " ".join(VOCABULARY * 3000)
    h, at = common.word_hashes(pa.array([long]))
    assert at[-1] == len(VOCABULARY) * 3000 and len(np.unique(h)) == len(VOCABULARY)
    assert common.word_hashes(pa.array(["b", long, "c"]).slice(1, 1))[0].tolist() == h.tolist()


# ---- quality ----------------------------------------------------------------------------------


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    win = defaultdict(list)
    for i in range(len(w) - 4):
        win[tuple(w[i : i + 5])].append(i)
    hit = {i + j for v in win.values() if len(v) > 1 for i in v for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_ledger(spark, docs_of):
    rows = [*random_docs(), *ODD, (950, "p q r s t u " * 6), (951, "l1 a\nl1 a\nl2"), (952, "## ** $$ a %"), (953, "p q r s t p q r s t x")]
    got = quality.apply_policy(quality.ledger(docs_of(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        n = measures(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.doc_id
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    df = docs_of(rows)
    out = quality.keep(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept


def test_ablations_add_up(spark, docs_of):
    led = quality.ledger(docs_of([*random_docs(), *ODD])).cache()
    bits = [r.fail_bits for r in led.collect()]
    for r in quality.ablations(led).collect():
        b = quality.BIT[r.rule]
        assert (r.failed, r.failed_only_here, r.kept_without) == (sum(1 for x in bits if x & b), bits.count(b), sum(1 for x in bits if not x & ~b))
    assert quality.ledger(docs_of([])).count() == 0


# ---- personal data ----------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base(t):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        if {"email": "@", "ip": ".", "phone": "+"}.get(kind, "") not in (t or ""):
            continue  # the plain forms try each start of a long run
        for m in re.finditer(form, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(out)), Counter(x[3] for x in out)


def test_pii_base_spans(spark, docs_of):
    r = random.Random(5)
    bits = ["a@b.co", "x.y@z", "@", "a@b.c_d@e.ff", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "5500005555555559", "+1 (212) 555-0199", "+49 30 123", "+1.", "é", " ", "12", "-", "+", "9" * 30, "a@b.co1.2.3.4", "\n", ".", "0"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", "é "]) for _ in range(r.randint(0, 25)))) for i in range(300)] + ODD + [(990, "1" * 20_000 + " " + "1 " * 5000), (991, "a" * 100_000 + "@b.c")]
    for x in pii.detect(docs_of(rows)).collect():
        want, n = base(dict(rows)[x.doc_id])
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(n[k] for k in FORMS), dict(rows)[x.doc_id]
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in x.spans.split(",") if not s.startswith("id:")) == want


def pii_brute(rows):
    """All spans of each text, by a plain version of seeds, patterns, instances and rounds."""
    import regex

    occ, spans = [], [[] for _ in rows]
    for at, (_, text) in enumerate(rows):
        t = text or ""
        spans[at] += [(int(s), list(FORMS).index(kind), int(e)) for kind, s, e in (x.split(":") for x in base(t)[0].split(",") if x)]
        spans[at] += [(m.start(), pii.SECRET_KIND, m.end()) for m in regex.finditer(pii.SECRET, t)]
        found = list(regex.finditer(pii.CANDIDATE, t))
        for j, m in enumerate(found):
            before = t[found[j - 1].end() if j else 0 : m.start()].split()
            behind = t[m.end() : found[j + 1].start() if j + 1 < len(found) else len(t)].split()
            c = regex.match(r"^([^\p{L}0-9+(]*+)(.*?)[^\p{L}0-9)]*$", m[0])
            core, s = c[2], m.start() + len(c[1])
            if len(core) < pii.MIN_LENGTH:
                continue
            sh = regex.sub("[a9]{3,}", "x", regex.sub("[0-9]+", "9", regex.sub(r"\p{L}+", "a", core)))
            patterns = ["l " + (before[-1].lower() if before else "") + " " + sh, "r " + sh + " " + (behind[0].lower() if behind else ""), "i " + core[:4].lower() + " " + sh]
            occ.append((at, s, s + len(core), core, patterns, any(b < s + len(core) and e > s for b, _, e in spans[at])))
    edges = Counter((p, o[3]) for o in occ for p in o[4])
    share = {i: sum(o[5] for o in occ if o[3] == i) / sum(1 for o in occ if o[3] == i) for i in {o[3] for o in occ}}
    confidence = {}
    for _ in range(pii.ROUNDS):
        score = {(p, i): max([share[i], *[c for q, c in confidence.items() if q != p and (q, i) in edges]]) for p, i in edges}
        confidence = {}
        for p in {p for p, _ in edges}:
            mine = {i: n for (q, i), n in edges.items() if q == p}
            if sum(mine.values()) >= pii.MIN_SUPPORT and sum(score[p, i] >= pii.BELIEVED for i in mine) >= pii.MIN_KNOWN:
                confidence[p] = sum(n * score[p, i] for i, n in mine.items()) / sum(mine.values())
    for at, s, e, _, patterns, seed in occ:
        if not seed and any(confidence.get(p, 0) >= pii.MIN_CONFIDENCE for p in patterns):
            spans[at].append((s, pii.ID_KIND, e))
    return [",".join(f"{pii.NAMES[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in spans]


def test_pii_spans_match_a_plain_version(spark, docs_of):
    r = random.Random(9)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    things = [lambda: f"u{number(2)}@mail{r.randint(1, 3)}.com", lambda: f"10.0.{r.randint(0, 255)}.7", lambda: f"+1 212 555 {number(4)}", lambda: f"AC-{number(6)}", lambda: f'"{number(4)}abc{number(3)}"', lambda: f"password={number(12)}", lambda: f"AKIA{number(16)}", lambda: number(5), lambda: "Version 2.0.", *[lambda: "pay " + r.choice(["4111111111111111", "5500005555555559", "4012888888881881"] * 4 + [number(16)])] * 3]
    rows = []
    for i in range(160):
        w = []
        for _ in range(r.randint(0, 6)):
            w += [r.choice(VOCABULARY[:30]), *r.choice([[], ["account"], ["mail", "to"], ["call"], ["key", "="]]), r.choice(things)(), *r.choice([[], ["please"], [",", "thanks"]])]
        rows.append((i, " ".join(w)))
    rows += [*ODD, (5, rows[7][1]), (None, "account AC-123456 please"), (None, None)]
    want = pii_brute(rows)
    assert sum(x.count("id:") for x in want) > 3 and sum(x.count("secret:") for x in want) > 10
    got = pii.detect(docs_of(rows)).collect()
    assert Counter((x.doc_id, x.spans) for x in got) == Counter((i, x) for (i, _), x in zip(rows, want, strict=True))
    for x in got:
        kinds = Counter(s.split(":")[0] for s in x.spans.split(",") if s)
        assert (x.n_email, x.n_secret, x.n_id, x.n_spans) == (kinds["email"], kinds["secret"], kinds["id"], sum(kinds.values()))


def test_pii_patterns_find_unseen_identifiers(spark, docs_of):
    rows = [(i, f"some words then contact: u{i}@mail{i}.example.com and more") for i in range(12)] + [(50, "some words then contact: u77@mail9.examplecom and more"), (51, "it is 12345 here"), (52, None)]
    got = {r.doc_id: r for r in pii.detect(docs_of(rows)).collect()}
    assert got[3].n_email == 1 and got[51].n_id == 0 and got[52].spans == ""
    cards = [(i, f"pay by card 411111111111111{d} now") for i, d in enumerate([1] * 9)] + [(20, "pay by card 4111111111111112 now"), (21, "use card 5500005555555559 now")]
    got = {r.doc_id: r for r in pii.detect(docs_of(cards)).collect()}
    assert got[20].n_card == 0 and got[20].spans == "id:12:28" and got[0].n_card == 1
    assert pii.detect(docs_of([])).count() == 0


def test_pii_bootstraps_past_its_seeds(spark, docs_of):
    """Numbers behind `badge` are never seeds; those that also stand behind `card` are believed, and so make `badge` a pattern."""
    seeds = [(i, f"card 4111111111111111{' ' * i}paid") for i in range(30)] + [(40, "card 5500005555555559 paid")]
    bridge = [(100 + i, f"card 9999-{i} and later badge 9999-{i} there") for i in range(4)]
    got = {r.doc_id: r for r in pii.detect(docs_of([*seeds, *bridge, (200, "then badge 1234-9 went"), (201, "some other 1234-8 went")])).collect()}
    assert got[200].spans == pii_brute([*seeds, *bridge, (200, "then badge 1234-9 went"), (201, "some other 1234-8 went")])[-2]
    assert got[201].n_id == 0


def test_pii_time_grows_with_the_text(spark, docs_of):
    import time

    pii.detect(docs_of([(1, "a@b.co")])).collect()
    t = time.time()
    (x,) = pii.detect(docs_of([(1, "a@b.co 10.0.0.1 " * 65_000)], 1)).collect()
    assert x.n_email == x.n_ip == 65_000 and time.time() - t < 60


# ---- line dedup -------------------------------------------------------------------------------


def dedup_brute(rows, least):
    lines = {i: [(k, x.strip(" \t\r\x0b\x0c"), len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for i, t in rows}
    seen = {}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                if sum(x[2] for x in lines[i][a:b]) >= least:
                    seen.setdefault(tuple(x[1] for x in lines[i][a:b]), (i, a))
    out = {}
    for i, t in rows:
        dead = set()
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                key = tuple(x[1] for x in lines[i][a:b])
                if key in seen and seen[key] < (i, a):
                    dead |= {x[0] for x in lines[i][a:b]}
        out[i] = t if not dead else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead)
    return out


@pytest.mark.parametrize("least", [1, 5, 12])
def test_line_dedup_matches_brute_force(spark, docs_of, least):
    r = random.Random(least)
    lines = [" ".join(r.choice(VOCABULARY) for _ in range(r.randint(1, 7))) for _ in range(12)] + ["", "  ", "x  "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 14)))) for i in range(40)] + ODD
    df = docs_of(rows)
    got = line_dedup.dedup(df, least).collect()
    assert {x.doc_id: x.text for x in got} == dedup_brute(rows, least)
    assert line_dedup.clean(df, least).columns == df.columns


def test_line_dedup_keeps_first_copies(spark, docs_of):
    p = " ".join(VOCABULARY[:60])
    rows = [(2, f"one\n{p}"), (1, f"{p}\ntwo"), (3, p), (4, None)]
    assert {r.doc_id: r.text for r in line_dedup.clean(docs_of(rows)).collect()} == {1: f"{p}\ntwo", 2: "one", 4: None}
    assert line_dedup.clean(docs_of([])).count() == 0


def test_line_dedup_of_repeated_rows(spark, docs_of):
    line = lambda name, n: "\n".join(f"{name}{k} a b c d e" for k in range(n))
    p, q = line("p", 10), line("q", 8)
    rows = [(5, p), (5, p), (1, f"own words\n{p}"), (7, f"{q}\nshort"), (7, f"{line('z', 3)}\n{p}\n{line('y', 9)}"), (7, "short"), (8, q), (None, line("n", 6)), (None, line("n", 6)), (9, None), (9, None)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    keyed = [(k, rows[i][1]) for k, i in enumerate(order)]
    want = dedup_brute(keyed, line_dedup.MIN_RUN_WORDS)
    for parts in (1, 3):
        got = line_dedup.dedup(docs_of(rows, parts)).collect()
        assert Counter((x.doc_id, x.text) for x in got) == Counter((rows[order[k]][0], t) for k, t in want.items())


def test_maximal_runs(spark, docs_of):
    r = random.Random(3)
    lines = [" ".join(r.choice(VOCABULARY) for _ in range(4)) for _ in range(10)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for i in range(30)]
    keyed = docs_of(rows, 1).select("doc_id", "text", "doc_id").toDF("doc_id", "text", "row").cache()
    texts, dead = dict(rows), defaultdict(set)
    for x in line_dedup.maximal_runs(keyed, 8).collect():
        mine, its = texts[x.doc_id].split("\n"), texts[x.of_doc_id].split("\n")
        assert mine[x.start : x.start + x.lines] == its[x.of_start : x.of_start + x.lines] and (x.of_doc_id, x.of_start) < (x.doc_id, x.start)
        dead[x.doc_id] |= set(range(x.start, x.start + x.lines))
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead[i]) for i, t in rows}
    assert left == dedup_brute(rows, 8)
    keyed.unpersist()


def test_frequent_lines_take_their_own_way(spark, docs_of, monkeypatch):
    """Lines, pairs and runs with more rows than HOT_ROWS are joined where they lie, and ordered in cells."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    r = random.Random(8)
    lines = [" ".join(r.choice(VOCABULARY) for _ in range(3)) for _ in range(9)]
    rows = [(i, "\n".join(r.choice(lines[: 1 + r.randrange(9)]) for _ in range(r.randint(1, 14)))) for i in range(60)]
    got = line_dedup.dedup(docs_of(rows), 7).collect()
    assert {x.doc_id: x.text for x in got} == dedup_brute(rows, 7)


# ---- n-gram Jaccard ---------------------------------------------------------------------------


def components_brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_components_match_brute_force(spark, docs_of, seed, monkeypatch):
    for name, small in (("TILE_ROWS", 3), ("CHUNK_TOKENS", 400), ("OFTEN", 3), ("BUCKET_CHARS", 500)) if seed else ():
        monkeypatch.setattr(ngram_jaccard, name, small)
    rows = [*random_docs(seed, 90), *ODD, (960, "A b c D e f g"), (961, "a B c d e f g")]
    df = docs_of(rows)
    got = ngram_jaccard.components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_brute(rows) and len(got) == len(rows)
    one = ngram_jaccard.one_each(df)
    assert one.columns == df.columns and {r.doc_id for r in one.collect()} == {c for _, c in components_brute(rows).values()}


def test_jaccard_chain_and_empty(spark, docs_of):
    base_ = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(25):  # each links to the next alone
        rows.append((i, " ".join(base_)))
        base_ = [*base_[3:], *[f"n{i}_{k}" for k in range(3)]]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.components(docs_of(rows)).collect()} == components_brute(rows)
    assert ngram_jaccard.components(docs_of([])).count() == 0
    assert {r.component_id for r in ngram_jaccard.components(docs_of([(1, None), (2, "")])).collect()} == {1, 2}


def test_one_each_of_repeated_and_null_ids(spark, docs_of):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (3, a), (5, a + " x"), (None, a), (None, b), (None, b), (None, c), (7, "own"), (7, "other"), (None, None), (None, "")]
    df = docs_of(rows)
    one = ngram_jaccard.one_each(df)
    assert one.columns == df.columns
    assert Counter((x.doc_id, x.text) for x in one.collect()) == Counter([(3, a), (None, b), (None, c), (7, "own"), (7, "other"), (None, None), (None, "")])


def test_a_forest_connects_what_all_pairs_do():
    r = np.random.default_rng(1)
    for _ in range(40):
        n = int(r.integers(2, 30))
        comp = r.integers(0, 12, n) * 7
        i, j = (x[comp[x0] != comp[x1]] for x0, x1 in [r.integers(0, n, (2, int(r.integers(0, 80))))] for x in (x0, x1))
        p, q = ngram_jaccard.forest(i, j, r.integers(0, 5, len(i)), comp)

        def joined(a, b):
            label = {c: c for c in comp.tolist()}
            for x, y in zip(comp[a].tolist(), comp[b].tolist(), strict=True):
                lo, hi = sorted((label[x], label[y]))
                label = {c: lo if k == hi else k for c, k in label.items()}
            return label

        assert joined(p, q) == joined(i, j) and len(p) <= 2 * 12
        assert set(zip(p.tolist(), q.tolist(), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_bitmap_bound_never_undercuts():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        x, y = ngram_jaccard.bitmap(a, 512), ngram_jaccard.bitmap(b, 256)
        x = ngram_jaccard.fold(x, len(y))
        bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert bound >= len(np.intersect1d(a, b))


# ---- decontamination --------------------------------------------------------------------------


def test_decontamination(spark, docs_of):
    r = random.Random(2)
    items = [(k, " ".join(r.choice(VOCABULARY) for _ in range(n))) for k, n in enumerate((40, 30, 15, 8))] + [(9, None), (10, "")]
    w = items[0][1].split()
    swapped = " ".join("zz" if i in (9, 20, 31) else x for i, x in enumerate(w))
    rows = [(0, f"pre {items[0][1]} post"), (1, swapped.upper()), (2, " ".join(w[:8])), (3, ", ".join(w[5:25])), (4, "x " + items[3][1]), (5, " ".join(r.choice(VOCABULARY) for _ in range(400))), (6, f"{items[1][1]}! {items[2][1]}?"), *ODD]
    test = spark.createDataFrame(items, "item_id long, text string")
    want = {0: [0], 1: [0], 3: [0], 4: [3], 6: [1, 2]}
    for most in (2_000_000, 30):
        got = {x.doc_id: x for x in decontamination.overlaps(docs_of(rows), test, most).collect()}
        assert {i: list(x.item_ids) for i, x in got.items() if x.contaminated} == want and len(got) == len(rows)
        df = docs_of(rows)
        clean = decontamination.filter_clean(df, test, most)
        assert clean.schema == df.schema and {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - want.keys()
        assert decontamination.overlaps(docs_of([]), test, most).count() == 0
    for most in (2_000_000, -1):
        assert not decontamination.overlaps(docs_of(rows), test.limit(0), most).filter("contaminated").count()


def test_items_shorter_than_any_mask_are_found(spark, docs_of):
    items = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in range(1, 8)] + [(20, "S2X0, s2x1"), (21, None), (22, "")]
    rows = [(n, f"w1 {t} w2 {t}!") for n, t in items[:7]] + [(30 + n, " ".join(t.split()[:-1])) for n, t in items[1:7]] + [(40, "s3x0 s3x1 w1 s3x2"), (41, "s2x0"), (42, "s2x1"), (43, items[2][1]), *ODD]
    test = spark.createDataFrame(items, "item_id long, text string")
    want = {n: ([n, 20] if n == 2 else [n], n) for n in range(1, 8)} | {43: ([3], 3)}
    df = docs_of(rows, 1)
    got = decontamination.overlaps(df, test).collect()
    assert {x.doc_id: (list(x.item_ids), x.matched) for x in got if x.contaminated} == want and len(got) == len(rows)
    assert {x.doc_id for x in decontamination.filter_clean(df, test).collect()} == {i for i, _ in rows} - want.keys()


def test_repeated_rows_are_judged_alike_with_an_index_and_with_tables(spark, docs_of):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(6)]
    rows = [(1, f"{items[0][1]} {items[4][1]}"), (1, items[2][1]), (1, "clean"), (None, items[3][1]), (None, "clean"), (None, None)]
    test = spark.createDataFrame(items, "item_id long, text string")
    for most in (2_000_000, 30):
        got = decontamination.overlaps(docs_of(rows), test, most).collect()
        assert Counter((x.doc_id, x.contaminated, tuple(x.item_ids), x.matched) for x in got) == Counter([(1, True, (0, 4), 15), (1, True, (2,), 15), (1, False, (), 0), (None, True, (3,), 15), (None, False, (), 0), (None, False, (), 0)])


def overlap_brute(texts, items):
    """item: best stretch, for each text; every diagonal of every pair is measured."""
    cut = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", (t or "").lower())
    out = []
    for t in texts:
        h, found = np.array(cut(t), object), {}
        for i, x in items:
            w = np.array(cut(x), object)
            for d in range(1 - len(w), len(h)) if len(w) else ():
                a, b = max(0, d), min(len(h), len(w) + d)
                best = decontamination.stretch(h[a:b] == w[a - d : b - d])
                if best >= min(decontamination.MIN_MATCH, len(w)):
                    found[i] = max(best, found.get(i, 0))
        out.append(found)
    return out


def test_overlaps_match_brute_force_with_an_index_and_with_tables(spark, docs_of):
    r = random.Random(11)
    few = VOCABULARY[:6]  # words recur, within items too
    items = [(k, " ".join(r.choice(few if k % 2 else VOCABULARY) for _ in range(r.choice([3, 7, 13, 20, 40])))) for k in range(14)] + [(50, "w1 w1 w1 w1 " * 5), (51, None), (52, "?")]
    texts = []
    for k in range(60):
        w = [r.choice(few) for _ in range(10)] + (items[r.randrange(15)][1].split() if k % 3 else []) + [r.choice(VOCABULARY) for _ in range(10)]
        texts.append(" ".join("zz" if r.random() < 0.12 else x for x in w))
    rows = [*enumerate(texts), (900, "w1 " * 300), (901, None), (902, "")]
    want = {i: f for (i, _), f in zip(rows, overlap_brute([t for _, t in rows], items), strict=True)}
    assert 15 < sum(map(bool, want.values())) < 60
    test = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(rows, 3)
    for most in (2_000_000, 10):
        got = {x.doc_id: x for x in decontamination.overlaps(df, test, most).collect()}
        assert {i: (x.contaminated, list(x.item_ids), x.matched) for i, x in got.items()} == {i: (bool(f), sorted(f), max(f.values(), default=0)) for i, f in want.items()}
        assert {x.doc_id for x in decontamination.filter_clean(df, test, most).collect()} == {i for i, f in want.items() if not f}


def test_equal_words_cost_as_many_hits_as_there_are_words():
    index = decontamination.Index([(1, "a " * 1000)])
    h, at = decontamination.words(pa.array(["a " * 10_000, "b"]))
    assert sum(len(p) for p, _ in index.hits(h, at)) < 8 * 11_000
    assert index.scan(pa.array(["a " * 10_000, "b"])) == {0: {1: 1000}}


def test_no_qualifying_stretch_is_missed():
    r = random.Random(6)
    want, got = [], []
    for n in (13, 14, 16, 24, 58):
        items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k in range(40)]
        index = decontamination.Index(items)
        for rate in (0.15, 0.25, 0.3):
            texts = ["pre " + " ".join("zz" if r.random() < rate else w for w in t.split()) + " post" for _, t in items]
            found = index.scan(pa.array(texts))
            for k, t in enumerate(texts):
                best = decontamination.stretch(np.array([w != "zz" for w in t.split()[1:-1]]))
                want.append({k: best} if best >= decontamination.MIN_MATCH else {})
                got.append(found.get(k, {}))
    assert got == want and 100 < sum(map(bool, want)) < 550
    fourth = " ".join("zz" if j % 4 == 3 else f"w{j}" for j in range(100))
    assert decontamination.Index([(1, " ".join(f"w{j}" for j in range(100)))]).scan(pa.array([fourth])) == {0: {1: 75}}


def test_columns_of_any_name_stay(spark):
    """Helpers' own names, in either case, as columns of the input."""
    names = ["m__", "id__", "dead__", "n_lines", "N_Deleted", "row__", "ROW", "group__", "part__", "cls", "h", "seg", "root", "item_ids"]
    long = " ".join(VOCABULARY[:40])
    texts = [long, long + " and one", f"{long}\nown line", " ".join(VOCABULARY[50:90]), "few words", None]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(2)
    test = spark.createDataFrame([(1, " ".join(VOCABULARY[55:75]))], "item_id long, text string")
    for f, kept in ((quality.keep, {0, 1, 2, 3}), (line_dedup.clean, {0, 1, 2, 3, 4, 5}), (ngram_jaccard.one_each, {0, 3, 4, 5}), (lambda d: decontamination.filter_clean(d, test), {0, 1, 2, 4, 5}), (lambda d: decontamination.filter_clean(d, test, 3), {0, 1, 2, 4, 5})):
        out = f(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert {r.doc_id for r in got} == kept and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_best_stretch():
    e = np.array([1, 1, 0, 1, 1, 1, 0, 0, 0, 1], bool)
    assert decontamination.stretch(e) == 3 or decontamination.stretch(e) == 5
    assert decontamination.stretch(np.zeros(0, bool)) == 0 and decontamination.stretch(np.ones(7, bool)) == 7


def test_real_tables(spark, sf):
    rows = data(spark, sf)
    docs = common.table(spark, sf, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.components(docs).collect()}
    assert got == components_brute(rows)
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()} == dedup_brute(rows, line_dedup.MIN_RUN_WORDS)
    for x in pii.detect(docs).select("doc_id", "base_sha256").collect():
        assert x.base_sha256 == hashlib.sha256(base(dict(rows)[x.doc_id])[0].encode()).hexdigest()
