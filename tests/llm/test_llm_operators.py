"""Each operator against a brute-force version on small tables, and on nulls, blanks, ties, empty tables and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metricloom.llm import decontaminate, embedding_dedup, license_scan, ngram_join, packing, quality, substring_dedup, support, toxicity, url_filter, warc
from metricloom.llm.weak import LabelModel, chosen_terms

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, rep string, label string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed=3):
    """Copies, near copies, shared passages, blanks, nulls, a very long text and very frequent words."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "two one"), (5, "One  TWO"), (6, base), (7, base), (8, base.upper())]
    for i in range(9, 40):
        w = base.split()
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(i, f"{text(30)} {passage} {text(30)}") for i in range(40, 60)]
    rows += [(i, text(r.randint(1, 80))) for i in range(60, 80)]
    rows += [(80, text(6000)), (81, "the " * 500), (82, "the " * 500 + "end"), (83, text(49)), (84, text(50))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], DOCS)


def reach(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# -- 6


def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, reach(sets, links)


def test_ngram_join(spark):
    rows = corpus(4)
    sets, component = jaccard_brute(rows)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == component
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in component.items() if i == c}


def test_ngram_join_many_near_copies_of_each_other(spark):
    """A group whose members are near the base, not each other, and members that link with nothing."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for k in r.sample(range(200), r.choice((1, 3, 4, 5, 8))):
            w[k] = f"x{i}-{k}" if i % 2 else f"x{k}"
        rows.append((i, " ".join(w)))
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(spark, rows)).collect()} == jaccard_brute(rows)[1]


def test_ngram_join_of_repeated_ids_and_heavy_keys(spark, monkeypatch):
    """Texts of one id are one node, whole repeats one row; heavy keys or not, the rows are the same."""
    r = random.Random(12)
    text = lambda n: " ".join(f"q{r.randrange(5000)}" for _ in range(n))
    a, b = text(80), text(90)
    rows = [(5, a), (3, b), (5, b + " tail"), (9, a + " tail"), (9, a + " tail"), (2, text(70)), (7, ""), (7, text(40))]
    want = [(2, 66, 2), (3, 86, 3), (5, 76, 3), (5, 87, 3), (7, 0, 7), (7, 36, 7), (9, 77, 3)]
    for heavy in (support.HEAVY, 1):
        monkeypatch.setattr(support, "HEAVY", heavy)
        got = sorted(tuple(x) for x in ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
        assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_at_the_threshold(spark, seed):
    """Pairs on both sides of 0.8 of all lengths, over frequent shingles."""
    r = random.Random(seed)
    rows, common = [], [f"c{i}" for i in range(60)]
    for g in range(60):
        n = r.choice((5, 6, 9, 14, 25, 60, 150))
        base = [f"g{g}-{i}" for i in range(n)] + (common[: r.randrange(60)] if g % 2 else [])
        for k in range(3):
            w = list(base)
            at = r.randrange(len(w))
            w[at : at + r.randrange(max(1, n // 8) + 1)] = [f"z{g}-{k}-{i}" for i in range(r.randrange(max(1, n // 12) + 1))]
            rows.append((g * 3 + k, " ".join(w)))
    r.shuffle(rows)
    sets, component = jaccard_brute(rows)
    assert {x.doc_id: x.component_id for x in ngram_join.jaccard_components(frame(spark, rows)).collect()} == component


def test_parity_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 8 + 1, dtype=np.uint64)]))
        p, q = ngram_join._parities([a, b])
        assert sum(int(x).bit_count() for x in (p ^ q).view(np.uint64)) <= len(np.setxor1d(a, b))
    assert ngram_join._parities([np.zeros(0, np.uint64)]).tolist() == [[0, 0, 0, 0]]


def test_keep_one_with_clashing_columns(spark):
    names = ("key", "sid", "rep", "head", "n_shingles", "component_id", "t", "rows")
    df = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in corpus()], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns and {x.doc_id for x in got.collect()} == {i for i, c in jaccard_brute(corpus())[1].items() if i == c}


# -- 8


def substring_brute(rows, k=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        windows = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        gone = {x for j, g in enumerate(windows) if g in first for x in range(j, j + k)}
        for g in windows:
            first.setdefault(g, i)
        # a window that starts again in its own first document stays
        gone = {x for j, g in enumerate(windows) if first[g] < i for x in range(j, j + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(spark):
    rows = [*corpus(), (-5, corpus()[6][1] + " tail")]
    for width in (substring_dedup.WIDTH, 0.01):  # the narrow sketch takes nearly every window for repeated
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows), width=width).collect()}
        assert got == substring_brute(rows)


def test_substring_sketch_never_counts_too_low(spark):
    r = random.Random(8)
    pairs = [(d, 0, a) for d in range(200) for a in r.sample(range(3000), 20)]
    df = spark.createDataFrame(pairs, "doc_id long, key long, anchor long")
    n = collections.Counter(a for _, _, a in pairs)
    repeated = {p for p in pairs if n[p[2]] > 1}
    for width in (8, 0.05):
        got = {tuple(x) for x in substring_dedup.suspects(df, width).collect()}
        assert repeated <= got and (width < 1 or len(got) < len(repeated) + 0.4 * (len(pairs) - len(repeated)))


def test_substring_dedup_of_repeated_ids(spark, monkeypatch):
    """Rows of one id with different texts are judged each by its own windows; heavy keys or not, the rows are the same."""
    r = random.Random(4)
    text = lambda n: " ".join(f"u{r.randrange(10_000)}" for _ in range(n))
    shared, own = text(60), text(120)
    rows = [(1, f"{shared} {text(10)}"), (2, f"{text(5)} {shared}"), (2, own), (3, own), (2, own), (4, f"{own}  x"), (4, own.replace(" ", "  "))]
    for heavy in (support.HEAVY, 1):
        monkeypatch.setattr(support, "HEAVY", heavy)
        got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.dedup(frame(spark, rows)).collect())
        assert got == [(1, 70, 0), (2, 65, 60), (2, 120, 0), (2, 120, 0), (3, 120, 120), (4, 120, 120), (4, 121, 120)]


def test_cut_documents_with_clashing_columns(spark):
    names = ("n_words", "n_removed", "kept_text", "key", "at", "copy", "anchor", "digest", "cell")
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = substring_dedup.cut_documents(df)
    assert got.columns == df.columns
    assert all(x[n] == f"{n}{x.doc_id}" for x in got.collect() for n in names)
    assert substring_dedup.dedup(df).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_cut_documents(spark):
    rows = corpus()
    want = substring_brute(rows)
    got = {r.doc_id: r for r in substring_dedup.cut_documents(frame(spark, rows)).collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    for i, r in got.items():
        if want[i][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[i][2] and r.n_chars == len(r.text)
        else:
            assert r.text == dict(rows)[i]


# -- 3


def windows_brute(rows, items):
    out = {}
    for d, t in rows:
        w = words((t or "").lower())
        doc = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, u in items:
            v = words((u or "").lower())
            item = collections.Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
            n = sum(item.values())
            best = None
            for start in range(max(len(doc) - n, 0) + 1) if n and doc else ():
                part = collections.Counter(doc[start : start + n])
                both = sum((part & item).values())
                share = both / (sum(part.values()) + n - both)
                if share >= 0.8 and (best is None or share > best[0]):
                    best = (share, start)
            if best:
                out[d, i] = best
    return out


def test_decontaminate(spark):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate((15, 30, 30, 57, 4, 5, 200))]
    items[2] = (2, items[1][1])
    rows = [(0, None), (1, ""), (2, "a b"), (3, " ".join(items[0][1][:14]))]
    for d in range(4, 40):
        i, w = items[d % 7]
        w = list(w)
        for _ in range(d % 3):
            w[r.choice((0, 1, len(w) - 1, len(w) // 2))] = "changed"
        rows.append((d, " ".join([*text(r.randrange(30)), *w, *text(r.randrange(30))])))
    rows.append((50, " ".join(items[3][1]).upper()))
    items = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, "")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): (x.similarity, x.start) for x in decontaminate.matches(frame(spark, rows), bench).collect()}
    want = windows_brute(rows, items)
    assert set(got) == set(want) and (50, 3) in got
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    left = {x.doc_id for x in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in want}


# -- 4


def test_packing(spark):
    rows = [*corpus(), (100, "Hello, world. <|endoftext|> It's <|ENDOFTEXT|> ÉCOLE ñandú × ÷ 3.14, σΣ Σ."), (101, "x" * 50_000), (102, " ".join(f"word{i}." for i in range(20_000)))]
    got = packing.pack_documents(frame(spark, rows), TOKENIZER).toPandas()
    t = Tokenizer.from_file(TOKENIZER)
    pieces = dict(list(got.groupby("doc_id")))
    assert set(pieces) == {i for i, _ in rows}
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        p = pieces[i].sort_values("start")
        assert p.start.tolist() == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() == len(ids) and (p.doc_tokens == len(ids)).all() and (p.length > 0).all()
        assert p.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(p.start, p.length, strict=True)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        total = int(s.length.sum())
        assert total <= 4096 and total & (total - 1) == 0


def test_plan_solves_the_histogram():
    rng = np.random.default_rng(0)
    a = packing.combinations(16)
    assert (np.arange(1, 17) @ a <= 16).all()
    x = packing.nnls(a, h := rng.integers(0, 50, 16).astype(float))
    assert (x >= 0).all() and np.abs(a @ x - h).max() < 1e-6 * 50 + 1e-6 or np.linalg.norm(a @ x - h) <= np.linalg.norm(h)
    assert packing.plan(np.zeros(64))[0] == []


# -- 5


def test_warc_round_trip(spark):
    html = ["<p>é</p>\r\n\r\nWARC/1.1 not a header", "", None, "same", "same", "same", "x" * 100_000]
    rows = [(i, None if i == 4 else f"http://h/{i}\r\nX: y", h, "r") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder, index = warc.write_archives(pages)
    assert index.count() == len(rows)
    got = {r.page_id: r for r in warc.read_records(folder, index, payload=True).collect()}
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    for i, h in enumerate(html):
        data, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = last[h or ""] == i
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", last[h or ""]))
        assert bytes(r.payload) == (data if first else b"")
    some = warc.read_records(folder, index.filter("page_id in (0, 6)"))
    assert {r.page_id for r in some.collect()} == {0, 6}
    assert index.select("archive").distinct().count() > 1
    folder, index = warc.write_archives(pages, least=5)
    assert {r.page_id: r.record_type for r in index.collect()}[3] == "response"


def test_ranges_are_coalesced():
    assert warc._ranges(np.array([0, 10, 500, 510]), np.array([10, 10, 10, 10]), 100, 20) == [(0, 2), (2, 4)]
    assert warc._ranges(np.array([0, 90, 180]), np.array([90, 90, 90]), 200, 20) == [(0, 2), (2, 3)]
    assert warc._ranges(np.array([0]), np.array([10_000]), 100, 20) == [(0, 1)]


# -- 7


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + rng.normal(scale=0.02, size=16)]) for i in range(80)]
    rows += [(200 + i, [float(x) for x in base[7] * (1 + i % 3)]) for i in range(30)] + [(240 + i, rows[8][1]) for i in range(5)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] * 16), (305, [float("inf")] * 16), (306, [1.0, 2.0]), (307, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, links int")
    good = {i: np.float32(v).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    links = [(a, b) for a in good for b in good if a < b and cos(good[a], good[b])]
    component, count = reach([i for i, _ in rows], links), collections.Counter(x for p in links for x in p)
    for block in (1024, 8):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        found = sum(r.n_links for r in got.values()) / 2
        assert 0.9 * len(links) <= found <= len(links) and all(r.n_links <= count[i] for i, r in got.items())
        assert {i: r.component_id for i, r in got.items()} == component
        assert all(r.kept == (i == r.component_id) for i, r in got.items()) and got[302].n_links == 0


def test_embeddings_of_extreme_magnitude(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e200, 2e200]), (2, [1e-310, 2e-310]), (3, [1e308, -1e308]), (4, [5e-324, 0.0]), (5, [1e-300, 0.0]), (6, [1e-200, 1e-200]), (7, [1.7e308, 1.7e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    # 0 to 2 lie at 63 degrees, 6 and 7 at 45: 18.4 degrees apart, a cosine of 0.9487
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_pivots_in_two_levels_find_the_nearest():
    rng = np.random.default_rng(7)
    points = embedding_dedup._unit(rng.normal(size=(4096, 32)))
    p, x = embedding_dedup.Pivots(points), embedding_dedup._unit(rng.normal(size=(500, 32)))
    got = p.nearest(x, 8)
    want = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :8]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got, want, strict=True)]) > 3.5 and all(len(set(a)) == 8 for a in got)
    cos = np.take_along_axis(x @ points.T, got, 1)
    assert (np.diff(cos, axis=1) <= 1e-12).all()
    few = embedding_dedup.Pivots(points[:20])
    assert (few.nearest(x, 8) == np.argsort(-(x @ points[:20].T), axis=1, kind="stable")[:, :8]).all()


# -- 10 and 1


def test_toxicity_learns_terms_and_holds_out(spark):
    r = random.Random(1)
    plain = [f"p{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [r.choice(plain) for _ in range(30)]
        if bad:
            w[r.randrange(30)] = r.choice(["vexxer", "vexxing", "grolk"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, "vexxion! p3"), (5003, "the " * 20000)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[5002].predicted == 1 and got[5000].score == got[5001].score < 0.5
    # labels of held-out rows are not looked at
    flipped = known.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(toxicity.fit(docs, flipped).weights, model.weights)
    # one label does not make a posterior: clean-looking rows labelled toxic are told apart by their votes
    wrong = known.withColumn("toxic", F.when((F.col("doc_id") % 15 == 1), 1).otherwise(F.col("toxic")))
    other = toxicity.fit(docs, wrong)
    again = {x.doc_id: x.predicted for x in toxicity.score(docs, other).collect()}
    assert not any(again[i] for i in range(1500) if i % 15 == 1 and i % 5) and np.mean([again[i] for i in range(0, 1500, 5)]) > 0.95
    # unlabelled rows count in the label model
    few = toxicity.fit(docs, known.filter("doc_id < 750"))
    votes = few.label_model.chance[:, 1, 0]
    assert abs(votes.sum() - 1) < 1e-9 and few.label_model.prior > 0.1
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.predicted}


def test_toxicity_scores_as_a_plain_sum(spark):
    """Scores over whole batches against one word at a time."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    table, seen = model.voters.table, {}

    def columns(word):
        if word not in seen:
            seen[word] = set(chosen_terms(pa.array([word]), table)[1].tolist())
        return seen[word]

    rows = {r.doc_id: r.text for r in docs.collect()}
    for x in toxicity.score(docs, model).collect():
        t = rows[x.doc_id] or ""
        found = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t)
        own = set().union(*(columns(w) for w in set(found)))
        patterns = toxicity.pattern_votes(pa.array([t]))[0] == 1
        lexicon = any(w.lower() in toxicity.LEXICON for w in found)
        assert patterns[0] == lexicon
        odds = model.bias + sum(model.weights[c] for c in own) + model.pattern_weights[patterns].sum()
        assert abs(x.score - 1 / (1 + np.exp(-odds))) < 1e-9 and x.predicted == int(x.score >= 0.5)


def test_label_model_of_a_table_is_that_of_the_rows(spark):
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    votes = np.where(rng.random((3000, 5)) < np.where(y[:, None], 0.6, 0.05), 1, -1).astype(np.int8)
    votes[(votes != 1).all(1), 4] = 0
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    df = spark.createDataFrame([(bytes(p.tobytes()), int(c)) for p, c in zip(patterns, n, strict=True)], "votes binary, n long").repartition(3)
    whole = spark.createDataFrame([(bytes(p.tobytes()), 1) for p in votes], "votes binary, n long").repartition(5)
    a, b = (LabelModel(0.3).fit_table(x, 5, toxicity.first_guess, belief=toxicity.BELIEF, strength=0.001) for x in (df, whole))
    assert np.allclose(a.chance, b.chance, atol=1e-5) and np.allclose(a.weight, b.weight, atol=1e-4)
    assert ((a.posterior(votes) > 0.5) == y).mean() > 0.85


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.4
    right = np.array([0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((4000, 4)) < right, y[:, None], ~y[:, None]).astype(np.int8)
    votes[rng.random(votes.shape) < 0.2] = -1
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    model = LabelModel(0.5).fit(votes, np.clip((votes == 1).mean(1) + 0.2, 0.1, 0.9))
    assert np.abs(model.accuracies()[1:4] - right[1:]).max() < 0.1
    assert model.weight[0] < 0.8 < model.weight[2]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85


def test_quality_without_labels(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["the", "garden", "is", "green.", "and", "water", "runs", "over", "stones.", f"t{r.randrange(900)}"]) for _ in range(n)).capitalize() + "."
    rows, good = [], {}
    for i in range(600):
        t = text(60)
        kind = i % 10
        if kind == 0:
            t = " ".join(w + r.choice(("%%%", "***", "###")) for w in t.split())
        elif kind == 1:
            t = t.upper().replace(" ", "!! ")
        elif kind == 2:
            t = "Again " * 200
        rows.append((i, t))
        good[i] = kind > 2
    rows += [(900, None), (901, ""), (902, "x"), (903, "the garden is green. " * 5000)]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in quality.score(docs, quality.fit(docs)).collect()}
    assert np.mean([got[i].kept == g for i, g in good.items()]) > 0.97
    assert not got[900].kept and not got[901].kept and got[900].score == got[901].score


def test_quality_label_model_sees_all_rows(spark):
    docs = frame(spark, [(i, "The garden is green. Water runs over stones.") for i in range(300)] + [(i, "| a " * 40) for i in range(300, 306)] + [(None, None), (307, "")])
    v, counts = quality.vote_counts(docs)
    own = [quality.votes(quality.statistics(pa.array([r.text]))[0])[0] for r in docs.collect()]
    assert collections.Counter({tuple(x): n for x, n in zip(v.tolist(), counts.tolist(), strict=True)}) == collections.Counter(tuple(x.tolist()) for x in own)
    # the accuracies do not depend on the scorer's sample, and counted patterns weigh as repeated rows
    few, all_rows = quality.fit(docs, train_rows=5), quality.fit(docs)
    assert np.array_equal(few.accuracies, all_rows.accuracies)
    rows = np.array(own)
    model = LabelModel(0.8).fit(rows, np.where((rows == 0).any(1), 0.1, 0.95), belief=quality.BELIEF, strength=0.05)
    assert np.allclose(model.accuracies(), all_rows.accuracies)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0))).count() == 0


# -- 2


def rule_brute(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = []
    for action, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/700?x", "https://example.com/en/1", "http://net/de/", "http://b.net/de/8", "http://x.example.net/de/81#f", "ftp://org/es/?q",
            "http://com/EN/", "http://examplecom/en/", "http://h?x://y/z", "http://É.COM/en/", "http://a\nb.org/es/x", "http://casino-pills.example.info/en/5", "http://garden.example.info/en/5"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    for r in url_filter.judge(df).collect():
        host, path, rule, action = rule_brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (action is None or r.verdict == action)
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert got[15] == "block" and got[16] == "allow"


def auc(p, y):
    rank = np.argsort(np.argsort(p, kind="stable"), kind="stable")
    pos = int(y.sum())
    return (rank[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


def test_trees_on_sites_they_have_not_seen():
    rows = url_filter.seed_urls()
    folds = url_filter._fold_of(pa.array([u for u, _ in rows]))
    trees, shares = url_filter.fit([r for r, k in zip(rows, folds, strict=True) if k])
    rest = [r for r, k in zip(rows, folds, strict=True) if not k]
    p, y = trees.predict(url_filter.features(pa.array([u for u, _ in rest]), shares)), np.array([v for _, v in rest])
    assert auc(p, y) > 0.95 and len(y) > 500


GOOD = "https://www.mercedes-benz.com/en https://coca-cola.com/ https://stack-exchange.com/q/1234 https://www.rolls-royce.com/ https://3m.com/products https://harley-davidson.com https://www.hewlett-packard.de/a/b https://en.wikipedia.org/wiki/Main_Page https://www.bbc.co.uk/news/world-1234567 https://www.lemonde.fr/politique/article/2024/01/05/titre-d-article_6209_823448.html https://docs.python.org/3/library/re.html https://7-eleven.com/ https://www.t-mobile.de"
BAD = "https://www.pornhub.com/ http://casino.example.com/en/5 http://viagra.example.net/ https://freeporn.de/x https://onlinecasino.com https://bestpokerslots.example.info/ http://xk3j9fq2lm8vz0rt7pq.info/a http://login.secure.verify.account.baner.com/index.html https://cheap-viagra-24.org/p"


def test_names_with_hyphens_are_not_bad_and_bad_ones_need_none():
    trees, shares = url_filter.fit()
    score = lambda urls: trees.predict(url_filter.features(pa.array(urls.split()), shares))
    assert (score(GOOD) < 0.5).all() and (score(BAD) >= 0.5).all()


def features_brute(url, shares):
    """One URL at a time."""
    url = url or ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query, host = rest[len(host) + len(path) :], re.sub("[A-Z]", lambda m: m.group().lower(), host)
    size = lambda t: len(t.encode())

    def entropy(t):
        n = collections.Counter(t.encode())
        return -sum(c / size(t) * np.log2(c / size(t)) for c in n.values())

    def pieces(t, table):
        b = re.sub("[A-Z]", lambda m: m.group().lower(), t).encode()
        hit = [table[url_filter._pieces(np.frombuffer(b[i : i + 4], dtype=np.uint8), np.zeros(4, np.int64))[1][0]] for i in range(len(b) - 3) if re.fullmatch(rb"[a-z0-9]{4}", b[i : i + 4])]
        return [max([*hit, shares.base]), min([*hit, shares.base])]

    digits = [len(re.findall("[0-9]", t)) for t in (host, path, query)]
    labels = host.split(".")
    return [
        size(url), size(host), size(path), size(query), path.count("/"), host.count("-"), host.count("."), query.count("="),
        sum(digits) / max(size(host) + size(path) + size(query), 1), digits[0] / max(size(host), 1), entropy(host), entropy(path),
        (shares.suffix.get(labels[-1], shares.base) + shares.suffix.get(".".join(labels[-2:]), shares.base)) / 2, *pieces(host.rpartition(".")[0] if "." in host else host, shares.piece),
    ]


def test_url_features_one_by_one():
    _, shares = url_filter.fit(url_filter.seed_urls()[::37])
    urls = [None, "", "no scheme", "http://", "http://É.Com/\u00e9?x=1", "a://b\nc/d\ne?f=\n", "x" * 3000, "h://" + "a.b-" * 900 + "/casino/" * 50, *GOOD.split(), *BAD.split(), *(u for u, _ in url_filter.seed_urls()[::101])]
    got = url_filter.features(pa.array(urls, pa.string()), shares)
    assert np.allclose(got, [features_brute(u, shares) for u in urls])
    assert url_filter.features(pa.array([], pa.string()), shares).shape == (0, got.shape[1])


def test_trees_of_a_long_ordered_list_see_both_classes(spark, monkeypatch):
    rows = url_filter.seed_urls()
    bad = sum(y for _, y in rows)
    assert [y for _, y in rows] == [1] * bad + [0] * (len(rows) - bad)
    trees, shares = url_filter.fit(rows, most=bad)
    y = np.array([y for _, y in rows])
    p = trees.predict(url_filter.features(pa.array([u for u, _ in rows]), shares))
    assert auc(p, y) > 0.95
    chosen = url_filter._training_rows([*rows, (None, 1), ("", 0)], bad)
    assert len(chosen) == bad and 0.4 < np.mean([y for _, y in chosen]) < 0.6
    assert chosen == url_filter._training_rows([*rows, (None, 1), ("", 0)][::-1], bad)
    assert url_filter._training_rows(rows, len(rows)) == rows
    # a table as labelled URLs, with a bound
    table = spark.createDataFrame([(u, v, "h") for u, v in [*rows, (None, 1), ("http://x/", None)]], "url string, label int, host string")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[::50])], "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.judge(pages, (), labelled=table).collect()}
    assert auc(np.array([got[i] for i in range(len(got))]), y[::50]) > 0.95
    assert len(support.hashed_sample(table, "url", 500).collect()) == 500
    assert url_filter.judge(pages, (), labelled=table.limit(0)).count() == len(got)


# -- 9


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    rows = [(0, None), (1, ""), (2, "Some text.\nReleased under the MIT License."), (3, mit), (4, "Licensed under CC BY-NC 4.0.\nwords\nAll rights reserved."), (5, "Released under the MIT License. " * 3), (6, "A license of another kind."), (7, "x " * 50_000 + "\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {i: list(r.licenses) for i, r in got.items()} == {0: [], 1: [], 2: ["MIT"], 3: ["MIT"], 4: ["CC-BY-NC-4.0", "proprietary"], 5: ["MIT"], 6: [], 7: ["Apache-2.0"]}
    assert list(got[3].sentence_ids) == ["mit-grant", "mit-notice"] and list(got[5].sentence_ids) == ["mit-ref"] * 3
    assert all(any(m in s for m in license_scan.MARKERS) for t in license_scan.SENTENCES.values() for s in t)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{}Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{}Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_license_scan_spdx_lines_and_numbered_clauses(spark):
    names = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0"}
    spdx = [(lead.format(f"SPDX-License-Identifier: {x}"), y) for x, y in names.items() for lead in ("{}", "# {}\nimport os", "/* {} */\nint x;", "Copyright A. B.\n\n// {}", "Some words. {}")]
    marks = [("1. ", "2. ", "3. "), ("\n1. ", "\n2. ", "\n3. "), ("1) ", "2) ", "3) "), ("(a) ", "(b) ", "(c) "), ("a. ", "b. ", "c. "), ("* ", "* ", "* "), ("- ", "- ", "- "), ("(i) ", "(ii) ", "(iii) "), ("", "", "")]
    bsd = [BSD.format(*m) for m in marks]
    bsd += [t.replace("\n", "\n * ") for t in bsd] + [" ".join(t.split()) for t in bsd] + [t.replace("\n", "\r\n") for t in bsd]
    rows = [*spdx, *((t, "BSD-3-Clause") for t in bsd), ("Licensed under the Mozilla Public License, version 2.0. 3. More words", "MPL-2.0"), ("Licensed under the GNU General Public License version\n3. More.", "GPL-3.0"), ("1) " * 50_000 + "\nAll rights reserved.", "proprietary")]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    assert {i: list(r.licenses) for i, r in got.items()} == {i: [y] for i, (_, y) in enumerate(rows)}
    assert all(list(got[len(spdx) + i].sentence_ids) == ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"] for i in range(len(bsd)))


APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL = """This program is free software;
you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version.
"""


def test_license_scan_of_lines_and_wrapped_text_together(spark):
    apache, mit = ["apache-ref", "apache-comply", "apache-basis"], ["mit-grant", "mit-notice", "as-is"]
    words = "some words without an end\n"
    cases = [
        (APACHE + MIT, apache + mit), (MIT + APACHE, mit + apache), ((APACHE + MIT).replace("\n", "\n * "), apache + mit), ((APACHE + MIT).replace("\n", "\r\n"), apache + mit), (APACHE, apache),
        (words + "Licensed under CC BY 4.0\n" + words + "\n" + MIT, ["cc-by-ref", *mit]), (MIT + words + "Licensed under CC BY 4.0\n" + words, [*mit, "cc-by-ref"]),
        (words + "SPDX-License-Identifier: GPL-3.0-only\n" + words + "\n" + BSD.format("1. ", "2. ", "3. ") + MIT, ["gpl3-ref", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", *mit]),
        ("SPDX-License-Identifier: GPL-3.0-only\n\n" + BSD.format("1. ", "2. ", "3. "), ["gpl3-ref", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
        (GPL, ["gpl-free"]), (GPL.replace("\n", "\n    ") + "Licensed under CC BY 4.0.  released under cc0 1.0", ["gpl-free", "cc-by-ref", "cc0-ref"]),
        ("\n \n" * 50_000 + MIT, mit), (words * 20_000 + "All rights reserved\n" + words, ["all-rights"]),
    ]
    got = {r.doc_id: list(r.sentence_ids) for r in license_scan.scan(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert got == {i: ids for i, (_, ids) in enumerate(cases)}
    both = license_scan.scan(frame(spark, [(0, APACHE + MIT)])).first()
    assert list(both.licenses) == ["Apache-2.0", "MIT"]
    # a known sentence inside a longer one has its identifier, so the longest reading of a place loses none
    known = [(f" {s} ", code) for code, texts in license_scan.SENTENCES.items() for s in texts]
    assert all(code == other for s, code in known for longer, other in known if s in longer)


def licenses_brute(text):
    """The rules by plain Python: sentences, then what is not known by ever smaller pieces, then rules as sub-sequences."""
    scan = license_scan
    known = {s: code for code, texts in scan.SENTENCES.items() for s in texts}

    def plain(piece):
        bare = regex.sub(f"^(?:[^A-Za-z0-9(\\[]*{scan._NUMBER}){{1,4}}", "", piece, flags=regex.A)
        return regex.sub(" +", " ", regex.sub(scan._CLEAN, " ", bare.lower(), flags=regex.A)).strip(" ")

    def codes(piece, breaks):
        if plain(piece) in known:
            return [known[plain(piece)]]
        if not breaks or not regex.search(r"[\n\r;:.!?]\s|[\n\r]|\s\s", piece, flags=regex.A):
            return []
        return [c for p in regex.split(breaks[0], piece, flags=regex.A) for c in codes(p, breaks[1:])]

    ids = [c for p in regex.split(scan._END, text or "", flags=regex.A) for c in codes(p, scan._BREAKS)]
    follows = lambda parts, it: all(p in it for p in parts)
    names = {name for name, parts in scan.RULES if follows(parts, iter(ids))}
    return ids, sorted(names - {weak for strong, weak in scan.STRONGER if strong in names})


def test_license_scan_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    odd = ["some text. licensed under the mit license. more", "a: Licensed under CC BY 4.0; b", MIT.lower(), f"x. {APACHE}\n{GPL} y.", "SPDX-License-Identifier: LGPL-2.1-or-later\n" + MIT, "Licensed under the GNU Lesser General Public License, version 3. Done", BSD.format("1. ", "2. ", "3. ") + "ISC.\nlicensed under the ISC license.", None, "", "\u2028 All rights reserved\u00a0."]
    texts |= {-1 - i: t for i, t in enumerate(odd)}
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in license_scan.scan(frame(spark, list(texts.items()))).collect()}
    assert got == {i: licenses_brute(t) for i, t in texts.items()}
    assert got[-1][1] == ["MIT"] and got[-2][1] == ["CC-BY-4.0"] and got[-3][1] == ["MIT"] and got[-5][1] == ["LGPL-2.1", "MIT"] and got[-6][1] == ["LGPL-3.0"] and got[-7][1] == ["BSD-3-Clause", "ISC"]


# -- null ids, repeated rows, empty tables, components


def test_null_ids_and_repeated_rows(spark):
    rows = [*corpus()[:12], *corpus()[5:8], (None, "one two three four five six"), (None, None), (3, "quite another text " * 30)]
    docs = frame(spark, rows)
    n = len(rows)
    assert {r.doc_id for r in ngram_join.jaccard_components(docs).collect()} == set(range(12))
    assert substring_dedup.dedup(docs).filter("doc_id = 6").select("n_removed").distinct().collect()[0][0] == 0
    assert substring_dedup.dedup(docs).count() == n - 2
    assert packing.pack_documents(docs, TOKENIZER).filter("start = 0").count() == n
    assert license_scan.scan(docs).count() == quality.score(docs, quality.fit(docs)).count() == n
    labels = spark.createDataFrame([(1, 1, 0), (6, None, 1), (None, 1, 1), (6, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out is null or score is null").count() == 0
    bench = spark.createDataFrame([(None, "one two three four five six"), (1, None)], "item_id long, text string")
    assert decontaminate.matches(docs, bench).count() == 0
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (1, None, "other"), (None, "u", "h")], "page_id long, url string, html string")
    folder, index = warc.write_archives(pages)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_records(folder, index).collect()) == [(1, 1), (1, 1), (1, 5)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links) for r in embedding_dedup.near_duplicates(vectors).collect()) == [(1, 1), (1, 1), (2, 0)]
    assert url_filter.judge(spark.createDataFrame([(None, None), (None, "http://a/b")], "page_id long, url string")).count() == 2




def test_empty_tables(spark):
    docs = frame(spark, [])
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder, index = warc.write_archives(pages)
    for df in (
        ngram_join.jaccard_components(docs), substring_dedup.dedup(docs), decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string")), packing.pack_documents(docs, TOKENIZER),
        warc.read_records(folder, index), embedding_dedup.near_duplicates(vectors), url_filter.judge(pages), license_scan.scan(docs), toxicity.score(docs, toxicity.fit(docs, labels)), quality.score(docs, quality.fit(docs)),
    ):
        assert df.count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (150, 200)] + [(i, i) for i in range(300, 303)]
    got = {r.node: r.label for r in support.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "packing"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], d).persist())
        assert len(frames) == len(corpus_pipeline.STAGES) + 1 or frames[-1].columns == docs.columns
    rows = [(r.doc_id, r.text) for r in frames[1].collect()]
    component = jaccard_brute(rows)[1]
    assert {r.doc_id for r in frames[2].collect()} == {i for i, c in component.items() if i == c}
    want = substring_brute([(r.doc_id, r.text) for r in frames[2].collect()])
    assert {r.doc_id for r in frames[3].collect()} == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    bad = windows_brute([(r.doc_id, r.text) for r in frames[3].collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()])
    assert {r.doc_id for r in frames[4].collect()} == {r.doc_id for r in frames[3].collect()} - {i for i, _ in bad}
    assert {r.doc_id for r in frames[5].collect()} == {r.doc_id for r in frames[4].collect()}
