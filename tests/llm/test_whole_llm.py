"""Cases that former cuts of the training-data operators missed."""

import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.llm import ann, decontaminate, licenses, lines, neardup, packing, secrets, suffix, toxicity

LONG = "one passage of well over forty characters that many pages hold"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_long_lines_go_whatever_their_neighbours_are(spark):
    r = random.Random(4)
    pool = [LONG, LONG + " again", "x" * 40, "y" * 39, "short", "", "a line that is long enough to be deleted once seen"]
    texts = [LONG, f"a\n{LONG}\nb", f"{LONG}\nc\n{LONG}", "y" * 39, "z\n" + "y" * 39, LONG] + ["\n".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(40)]
    one, two, want = set(), set(), {}
    for d, t in enumerate(texts):
        ls, gone = t.split("\n"), set()
        for i, line in enumerate(ls):
            if line in one and len(line) >= 40:
                gone.add(i)
            one.add(line)
            pair = tuple(ls[i : i + 2])
            if len(pair) == 2:
                if pair in two and sum(map(len, pair)) >= 40:
                    gone |= {i, i + 1}
                two.add(pair)
        want[d] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone), sum(i - 1 not in gone for i in gone))
    got = lines.drop_repeated_lines(docs(spark, texts), 2, line_chars=lines.MIN_CHARS).collect()
    assert {x.doc_id: (x.text, x.n_removed, x.n_runs) for x in got} == want and want[1][0] == "a\nb" and want[5][0] == ""


def maximal_runs(texts, least):
    """What is left of each text without its maximal runs that also start earlier and hold enough characters, by comparing all places."""
    split = [t.split("\n") for t in texts]
    places = [(d, i) for d, ls in enumerate(split) for i in range(len(ls))]
    out = {}
    for d, ls in enumerate(split):
        gone = set()
        for i in range(len(ls)):
            for e, j in places:
                if (e, j) >= (d, i):
                    break
                n = 0
                while i + n < len(ls) and j + n < len(split[e]) and ls[i + n] == split[e][j + n]:
                    n += 1
                if sum(map(len, ls[i : i + n])) >= least:
                    gone |= set(range(i, i + n))
        out[d] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone), sum(i - 1 not in gone for i in gone))
    return out


def test_maximal_runs_go_whole(spark, tmp_path):
    r = random.Random(14)
    pool = ["", "a", "bb", "eleven char", "x" * 25, "y" * 39, "z" * 40, LONG, "only " * 3]
    passage = ["short", "", "x" * 25, "bb", "", "eleven char", "only once here", "", "q" * 12]
    texts = ["\n".join(passage), "start\n" + "\n".join(passage) + "\nend", "\n".join(passage[2:] + ["tail"]), "\n" * 90, "\n" * 60, "a\n" * 100, "a\n" * 70 + "b", "y" * 39 + "\n\n\nno", "no\n" + "y" * 39 + "\n\n\n", ""]
    texts += ["\n".join(r.choice(pool[: r.choice([3, 6, 9])]) for _ in range(r.randint(1, 30))) for _ in range(60)] + texts[:3]
    want = maximal_runs(texts, lines.MIN_CHARS)
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = lines.drop_repeated_lines(docs(spark, texts)).collect()
    assert {x.doc_id: (x.text, x.n_removed, x.n_runs) for x in got} == want
    assert want[1][0] == "start\nend" and want[2][0] == "tail" and want[4][1] == 0
    assert {x.doc_id: (x.n_removed, x.n_runs) for x in lines.op4_line_dedup(spark, str(tmp_path)).collect()} == {d: w[1:] for d, w in want.items()}


def test_each_depth_is_the_shortest_part_with_enough_characters():
    r = random.Random(3)
    for _ in range(300):
        sizes = [r.choice([0, 0, 1, 5, 30, 60]) for _ in range(r.randint(1, 12))]
        ahead, back = lines.depths(np.array(sizes), None, 40, None)
        for i in range(len(sizes)):
            assert ahead[i] == next((k for k in range(1, len(sizes) - i + 1) if sum(sizes[i : i + k]) >= 40), 0)
            assert back[i] == next((k for k in range(1, i + 2) if sum(sizes[i + 1 - k : i + 1]) >= 40), 0)


def seconds(run):
    began = time.time()
    run()
    return time.time() - began


@pytest.mark.parametrize("make", [lambda n: "\n".join(f"line number {i % (n // 2)} of a long text, well over forty characters" for i in range(n)), lambda n: "ab\n" * n], ids=["long lines", "short lines"])
def test_time_of_line_dedup_grows_with_the_text(spark, make):
    run = lambda n: lambda: lines.drop_repeated_lines(docs(spark, [make(n)])).agg({"n_removed": "sum"}).collect()
    seconds(run(2_000))
    short, long = seconds(run(20_000)), seconds(run(200_000))
    assert long < 12 * short + 5


def bag(w, size=5):
    return collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else collections.Counter([tuple(w)])


def similarity(a, b):
    return sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())


def vocabulary(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def check_items(spark, texts, items):
    """find_items against all item-sized windows of each text, or the whole of a shorter one."""
    want = {}
    for d, w in enumerate(texts):
        for i, x in enumerate(items):
            best = max(similarity(w[s : s + len(x)], x) for s in range(max(1, len(w) - len(x) + 1)))
            if best >= 0.75:
                want[d, i] = best
    found = decontaminate.find_items(docs(spark, [" ".join(w) for w in texts]), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): x for x in found}
    assert got.keys() == want.keys() and len(got) == len(found)
    for (d, i), x in got.items():
        assert abs(x.similarity - want[d, i]) < 1e-12
        assert abs(similarity(texts[d][x.start_word : x.start_word + len(items[i])], items[i]) - want[d, i]) < 1e-12
    return want


def test_best_window_between_two_alignments_is_found(spark):
    r = random.Random(11)
    texts, items = [], []
    for n in range(44, 58):
        x = vocabulary(r, n)
        items.append(x)
        edited = ["first", *x[1 : n // 2], "two", "more", *x[n // 2 : -1], "last"]
        texts.append(vocabulary(r, 30) + edited + vocabulary(r, 30))
        texts.append(edited)
    want = check_items(spark, texts, items)
    assert {(2 * (n - 44), n - 44) for n in range(46, 53)} <= want.keys()


def test_texts_shorter_than_the_item_are_found(spark):
    r = random.Random(12)
    x, y, tiny = vocabulary(r, 50), vocabulary(r, 9), vocabulary(r, 3)
    texts = [x[:-1], x[1:], x[:40], x[:39], x[:38], x[:37], x[:4], y[:-1], y[:-2], tiny[:2], tiny, x[:20] + ["new"] + x[20:45]]
    want = check_items(spark, texts, [x, y, tiny])
    assert want[0, 0] == 45 / 46 and (3, 0) in want and (4, 0) not in want and (10, 2) in want


def test_a_benchmark_of_several_passes_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    r = random.Random(13)
    items = [vocabulary(r, n) for n in (1, 2, 4, 5, 6, 9, 20, 20, 300, 700)]
    texts = [vocabulary(r, 10) + x + vocabulary(r, 3) for x in items] + [x[: len(x) * 9 // 10] for x in items] + [items[6] + items[8] + items[2]]
    assert len(check_items(spark, texts, items)) > 14


@pytest.mark.parametrize("word", [lambda i: "same", lambda i: f"w{i % 50}", lambda i: f"w{i}"], ids=["one word", "a cycle", "all different"])
def test_time_of_decontamination_grows_with_the_text(spark, word):
    items = spark.createDataFrame([(1, " ".join(word(i) for i in range(40)))], "item_id long, text string")
    run = lambda n: lambda: decontaminate.find_items(docs(spark, [" ".join(word(i) for i in range(n))] * 2), items).collect()
    seconds(run(1_000))
    short, long = seconds(run(20_000)), seconds(run(200_000))
    assert long < 12 * short + 5


def test_time_of_the_secret_scan_grows_with_the_matches(spark):
    make = lambda n: " ".join(f"{i:032x} token=abcdefgh{i} Zz{i:030d}" for i in range(n))
    run = lambda n: lambda: secrets.scan(spark.createDataFrame([(1, make(n), "s")], "doc_id long, text string, source string")).agg({"n_hex": "sum", "n_assign": "sum"}).collect()
    seconds(run(200))
    short, long = seconds(run(4_000)), seconds(run(40_000))
    assert long < 12 * short + 5


def test_opaque_runs_that_touch_a_base_span_are_left_out(spark):
    r = random.Random(31)
    parts = ["token=" + "Ab1" * 9, "Ab1" * 9, "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "Zz", "AKIA" + "A1" * 9, "x", "secret: abcdefgh+Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1"]
    texts = ["".join(r.choice(parts) + r.choice([" ", "/", "", ","]) for _ in range(r.randint(1, 8))) for _ in range(80)]
    got = secrets.scan(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    for x in got:
        t = texts[x.doc_id]
        find = lambda p, g, n: [m.span() for m in re.finditer(p, t) if len(m.group(g)) >= n]
        base = find(secrets.ASSIGN, 2, 8) + find(secrets.ACCESS, 0, 16) + find(secrets.HEX, 0, 32)
        runs = [(a, b) for a, b in find(secrets.OPAQUE, 0, 24) if all(re.search(p, t[a:b]) for p in ("[0-9]", "[a-z]", "[A-Z]")) and not any(c < b and a < d for c, d in base)]
        listed = [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("opaque")]
        assert set(listed) <= set(runs) and len(listed) + x.n_example >= len(runs)


def test_templates_are_a_parameter_and_edited_ones_are_retrieved(spark):
    r = random.Random(41)
    names = [("X", f"t{n}", " ".join(vocabulary(r, n))) for n in (6, 12, 30, 80, 200)]
    texts, want = [], set()
    for _ in range(300):
        _, name, text = r.choice(names)
        w = text.split()
        for _ in range(r.randint(0, max(1, len(w) // 24))):
            w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(vocabulary(r, r.randint(0, 9)) + w + vocabulary(r, r.randint(0, 9))))
        if 100 * len(bag(texts[-1].split()).keys() & bag(text.split()).keys()) >= 75 * len(bag(text.split())):
            want.add((len(texts) - 1, name))
    assert len(want) > 150 and {(x.doc_id, x.template) for x in licenses.scan(docs(spark, texts), names).collect()} == want


def test_equal_rows_are_dealt_over_shards(spark):
    rows = [(None, "one two three", "s")] * 300 + [(7, "same same", "t")] * 300 + [(i, "three words here", "u") for i in range(100)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=12, shard_docs=50).toPandas()
    assert len(got) == 700 and got["length"].sum() == 300 * 3 + 300 * 2 + 100 * 3
    assert got["shard"].value_counts().max() < 110 and (got.groupby(["shard", "bin"])["length"].sum() <= 12).all()


def slow_model(sets, dense, y):
    """The chain's linear model by definition: features in a loop, the same loss to its minimum by Newton's method."""
    n1, n0 = y.sum(), len(y) - y.sum()
    told = []
    for f in sorted(set().union(*map(set, sets))):
        a, b = sum(f in s for s, t in zip(sets, y) if t), sum(f in s for s, t in zip(sets, y) if not t)
        p = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) ** 2 / max(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12)
        if a + b >= toxicity.MIN_DOCS and z >= toxicity.CHANCE:
            told.append((-z, f))
    used = sorted(f for _, f in sorted(told)[: toxicity.KEEP])
    row = lambda s, d: np.array([*(float(f in s) for f in used), *d, 1.0])
    x = np.array([row(set(s), d) for s, d in zip(sets, dense)])
    weight = np.array([0.5 / n1 if t else 0.5 / n0 for t in y])
    ridge = np.append(np.full(x.shape[1] - 1, 1e-4), 0)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-12 * np.eye(len(w)), x.T @ ((p - y) * weight) + ridge * w)
    return lambda s, d: 1 / (1 + np.exp(-np.clip(row(set(s), d) @ w, -30, 30)))


def test_chain_equals_a_slow_one(monkeypatch):
    monkeypatch.setattr(toxicity, "MIN_DOCS", 3)
    r = random.Random(51)
    sets, labels = [], []
    for _ in range(400):
        junk, toxic = r.random() < 0.4, r.random() < 0.3
        s = {r.randrange(100, 160) for _ in range(12)} | ({r.randrange(5)} if junk ^ (r.random() < 0.15) else set()) | ({r.randrange(10, 14)} if toxic ^ (r.random() < 0.1) else set())
        sets.append(np.array(sorted(s), np.int32))
        labels.append((float(not junk), float(toxic)))
    y, folds = np.array(labels), np.arange(400) % toxicity.FOLDS
    models, _ = toxicity.fit_chain(sets, y, folds)
    got = toxicity.predict_chain(models, sets)
    dense, told, at_scoring = [()] * 400, [], [()] * 400
    for k in range(2):
        model = slow_model(sets, dense, y[:, k])
        told.append([model(s, d) for s, d in zip(sets, at_scoring)])
        out = [0.0] * 400
        for f in range(toxicity.FOLDS):
            part = slow_model([s for s, g in zip(sets, folds) if g != f], [d for d, g in zip(dense, folds) if g != f], y[folds != f, k])
            for i in np.flatnonzero(folds == f):
                out[i] = part(sets[i], dense[i])
        dense = [(*d, p) for d, p in zip(dense, out)]
        at_scoring = [(*d, p) for d, p in zip(at_scoring, told[k])]
    assert np.abs(got - np.array(told).T).max() < 0.02


def test_toxicity_takes_any_column_name_and_repeated_rows(spark):
    rows = [(i % 20, ("bad " if i % 2 else "fine ") + "words", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd ``name, of` string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] * 3, "doc_id long, quality int, toxic int")
    models, thresholds = toxicity.train(df, labels)
    out = toxicity.score(df, models)
    assert out.columns[:3] == df.columns and {(x.doc_id % 2, x.p_toxic >= thresholds[-1]) for x in out.collect()} == {(0, False), (1, True)}


def test_near_duplicates_take_different_texts_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    r = random.Random(61)
    core, rows = vocabulary(r, 80), []
    for k in range(40):
        w = core[:]
        w[r.randrange(80)] = f"edited{k}"
        rows.append((k % 12, " ".join(w)))
    rows += [(50, " ".join(vocabulary(r, 60))), (3, " ".join(vocabulary(r, 60)))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {x.component_id for x in got if x.doc_id == 50} == {50}
    assert {x.component_id for x in got if x.doc_id not in (3, 50)} == {0}


def test_suffixes_of_many_groups_copies_and_one_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_BYTES", 500)
    monkeypatch.setattr(suffix, "MOST_TASKS", 4)
    r = random.Random(71)
    hot, bits = "".join(r.choice("abcd ") for _ in range(260)), ["".join(r.choice("xyz") for _ in range(r.randint(1, 130))) for _ in range(12)]
    texts = ["".join([r.choice(bits), hot[r.randint(0, 60) : r.randint(170, 260)], r.choice(bits)]) for _ in range(120)] + [hot] * 30 + ["é" * 55] * 3 + ["short"] * 9 + ["", None] + ["ab" * 400, "ab" * 300]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, hot), (7, "another text of one id " + hot)]
    seen, want = set(), {}
    for d, t in sorted({(d, t) for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, xxhash_order(spark, x[1]))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want.setdefault(d, []).append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone)))))
    got = {}
    for x in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():  # batches of several rows
        got.setdefault(x.doc_id, set()).add((x.n_bytes, x.n_removed, x.n_spans))
    assert {d: set(v) for d, v in want.items()} == got


def test_repeated_rows_in_one_batch_are_one_document(spark):
    r = random.Random(72)
    text = "".join(r.choice("abcdefgh") for _ in range(400))
    rows = [(1, text), (1, text), (2, text[:250] + "x" * 30), (2, text[:250] + "x" * 30)]
    got = [(x.doc_id, x.n_removed) for x in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 250), (2, 250)]


def xxhash_order(spark, text):
    """Texts of one doc_id stand in the order of their hash."""
    return spark.range(1).select(F.xxhash64(F.lit(text).cast("string"))).first()[0]


def test_a_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 40)
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 6))
    v[50:300] = v[50]
    v[0] = v[50]
    ids = [*range(400), *[0] * 9, *[120] * 8, 7]
    rows = [(i, v[i].tolist()) for i in ids]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    assert ann.few_copies(df, "vec_id", "embedding", 5).count() == 149 + 1 + 5 + 5
    got = {}
    for x in ann.nearest(df.where("vec_id % 20 = 0"), df, 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    for q in range(0, 400, 20):
        want = sorted((-s, i) for i, s in zip(ids, ann.cosines(np.repeat(v[q : q + 1], len(ids), 0), v[ids])) if i != q)[:5]
        assert sorted(got[q]) == [(k, i) for k, (_, i) in enumerate(want, 1)]


def test_short_license_templates_are_found_inside_texts(spark):
    short = ["Licensed under MIT License", "Released under MIT License", "Licensed under ISC License", "Released under ISC License"]
    texts = [x for t in short for x in (t, f"Some words first. {t.upper()}.", f"{t}, and so on", f"a {t} b", t.replace("under", "under the"), t.rpartition(" ")[0])]
    texts += [None, "", "x", "Released under", "MIT License"]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = {(d, t) for d, x in enumerate(texts) for t in short if f" {plain(t)} " in f" {plain(x)} "}
    got = [(x.doc_id, x.template.partition(": ")[2], x.n_matched, x.n_template) for x in licenses.scan(docs(spark, texts)).collect()]
    got = [x for x in got if x[1] in short]
    assert len(want) == 16 and sorted(got) == sorted((*x, 1, 1) for x in want)
