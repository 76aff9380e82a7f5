"""Each operator against a plain version on one awkward table, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from massline.llm import common, embeddings, fingerprint, language, mix, near_dup, packing, quality, secrets, substrings, toxicity
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, size string, taken int, grp int"


def prose(rng, n, stems=("the", "on", "and", "re", "th", "ing", "ble", "er")):
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 300)) for _ in range(60)]
    texts = base[:]
    for i in range(12):  # near copies
        w = base[i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [base[20], base[20], "", None, "one", "two words", "Ärger  über\n\nÜbung 😀 " * 40, "a" * 700, prose(rng, 20000), "x" + base[30][:400] + "y", 'password = "hunter2hunter2" AKIA' + "Z" * 16 + " " + "0f" * 14]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", None]), 0, 0.5, "s", "z", 1, 2) for i, t in enumerate(texts)]
    return out + [out[3], (None, base[5], "en", "s1", 0, 0.5, "s", "z", 1, 2), (7_000_000_000, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def scratch(spark):
    return common.Scratch(spark, "test")


def test_fingerprints(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 20)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(fingerprint.fingerprints(docs).collect()) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for i, r in enumerate(order):
        if sum(x[0] == r[0] for x in order) > 1:
            continue
        text, other = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == fingerprint.digest(text.encode()) and g.edited_fingerprint == fingerprint.digest(edited.encode())
        assert g.near_next == fingerprint.likeness(g.fingerprint, fingerprint.digest(other.encode()))
    assert fingerprint.fingerprints(empty).count() == 0
    # One id with very many texts falls to many ranges, and each text still meets the next.
    same = spark.createDataFrame([(None if i % 2 else 4, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    placed, n = fingerprint.with_next(same)
    assert n > 10 and max(r["count"] for r in placed.groupBy("grp").count().collect()) < 80
    th = {r.text: r.th for r in same.select("text", F.xxhash64("text").alias("th")).collect()}
    chain = sorted((i % 2 == 0, th[f"text {i}"], f"text {i}") for i in range(400))
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + chain[(i + 1) % 400][2][: len(t) // 2]).encode()).hexdigest() for i, (_, _, t) in enumerate(chain)}
    assert {r.edited_sha256 for r in fingerprint.fingerprints(same).collect()} == want
    assert fingerprint.likeness("00", None) == 0.0
    a, b = fingerprint.digest(b"abc" * 50), fingerprint.digest(b"xyz" * 500)
    assert fingerprint.likeness(a, a) == 1.0 and 0 <= fingerprint.likeness(a, b) < 1


def plain_digest(data):
    counts = [0] * 128
    if len(data) < 3:
        for b in data:
            counts[b * 2 % 128] += 1
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a * (65599 * 65599) ^ b * 65599 ^ c) % 2**32
        counts[h * 0x9E3779B1 % 2**32 >> 25] += 1
    low, mid, high = (sorted(counts)[i] for i in (31, 63, 95))
    code = min(255, round(np.log(len(data) + 1) / np.log(1.2)))
    quartiles = [(c > low) + (c > mid) + (c > high) for c in counts]
    return f"{code:02x}" + bytes(sum(quartiles[i + k] << 2 * k for k in range(4)) for i in range(0, 128, 4)).hex(), code, quartiles


def test_digest_against_plain_version():
    rng = random.Random(21)
    texts = [b"", b"a", b"ab", b"abc", "é😀".encode(), *[prose(rng, n).encode() for n in (5, 50, 500)], *[rng.randbytes(n) for n in (3, 128, 4000)]]
    plain = [plain_digest(t) for t in texts]
    assert [fingerprint.digest(t) for t in texts] == [p[0] for p in plain]
    for da, ca, qa in plain:
        for db, cb, qb in plain:
            far = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(qa, qb)) + 6 * min(20, abs(ca - cb))
            assert abs(fingerprint.likeness(da, db) - (1 - far / (128 * 6 + 120))) < 1e-12


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    vecs = [(c + rng.standard_normal(16) * s).astype("f4").tolist() for c in centres for s in (0, 0.1, 0.15, 0.2, 0.25, 0.3) for _ in range(6)]
    data = [(i, v, i % 2 if i % 13 else None) for i, v in enumerate(vecs)]
    data += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, [], 1), (1005, vecs[4][:8], 0), (2, vecs[2], 0), (None, vecs[2], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = embeddings.near(df, scratch(spark)).collect()
    assert len(got) == len(data)
    use = [(k, np.array(v, float), l) for k, v, l in data if k is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = defaultdict(list), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, (a, x, la) in enumerate(use):
        n = sum(1 for j, (b, y, lb) in enumerate(use) if i != j and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93)
        links[a].append(n)
        for b, y, lb in use:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    found = defaultdict(list)
    for r in got:
        found[r.vec_id].append(r.n_links)
        if r.vec_id in links:
            assert r.component_id == find(r.vec_id) and r.kept == (r.vec_id == find(r.vec_id))
    assert all(sorted(found[k]) == sorted(v) for k, v in links.items())
    assert all(found[k] == [0] for k in range(1000, 1006))
    assert embeddings.near(df.limit(0), scratch(spark)).count() == 0


def test_embeddings_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = (np.ones(8) + rng.standard_normal((90, 8)) * 0.35).astype("f4")
    got = embeddings.near(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"), scratch(spark)).collect()
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    n = (u @ u.T >= 0.93).sum(1) - 1
    found = np.array([r.n_links for r in sorted(got)])
    assert (found <= n).all() and found.sum() >= 0.999 * n.sum()


def test_embeddings_recall(spark, monkeypatch):
    """Sparse pairs right above the least cosine, with clashing extra columns and extreme lengths of vectors."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    other = rng.standard_normal((300, 24))
    other -= (other * x[:300]).sum(1)[:, None] * x[:300]
    other /= np.sqrt((other * other).sum(1))[:, None]
    y = 0.9305 * x[:300] + (1 - 0.9305**2) ** 0.5 * other
    scale = np.where(np.arange(1800) % 3 == 0, 1e-200, np.where(np.arange(1800) % 3 == 1, 1e200, 1.0))
    data = [(i, (v * s).tolist(), 1, "x", 3, 4) for i, (v, s) in enumerate(zip(np.vstack([x, y]), scale))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, content string, rep int, n_links int")
    for enough in (1, 10**9):
        monkeypatch.setattr(embeddings, "ENOUGH", enough)
        got = {r.vec_id: r for r in embeddings.near(df, scratch(spark)).collect()}
        assert sum(got[i].n_links >= 1 and got[1500 + i].component_id <= i for i in range(300)) >= 297 and 0.9 <= got[0].recall <= 1


def test_enough_nearest():
    assert embeddings.enough_nearest({2: 10, 5: 5}, 0.5) == (5, 1.0) and embeddings.enough_nearest({6: 90, 9: 9, 30: 1}, 0.95) == (9, 0.99)
    assert embeddings.enough_nearest({}, 0.999) == (embeddings.LEAST_NEAREST, 1.0)
    rng = np.random.default_rng(2)
    a, b = (np.argsort(rng.random((50, 12)), 1) for _ in range(2))
    want = [next(n for n in range(1, 13) if len({*p[:n]} & {*q[:n]}) >= 2) for p, q in zip(a.tolist(), b.tolist())]
    assert embeddings.needed(a, b).tolist() == want


def test_language(spark, docs, rows, empty):
    rng = random.Random(1)
    made = {"en": ("the", "ing", "tion", "er"), "fr": ("eau", "é", "oi", "le"), "de": ("sch", "ung", "ü", "er")}
    table = [(i, prose(rng, 60, made[l]), l) for i, l in enumerate(rng.choices(list(made), k=150))]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = language.train(df)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == l and 0 <= got[i].score <= 1 for i, _, l in table)
    both = spark.createDataFrame([(1, table[0][1] + " " + prose(rng, 60, made["fr"] if table[0][2] != "fr" else made["de"]))], "doc_id long, text string")
    assert len(language.identify(both, model).first().languages) == 2
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(out) == len({r[0] for r in rows})
    assert all(out[r[0]].lang_pred == "und" for r in rows if not r[1])
    assert language.train(empty) is None and language.identify(empty, None).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_language_sets_of_any_size(spark):
    rng = random.Random(3)
    stems = {f"l{i}": [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "xyzwv" if (ord(a) * 7 + ord(b) * 3 + ord(c)) % 7 == i] for i in range(7)}
    table = [(i, prose(rng, 200, stems[f"l{i % 7}"]), f"l{i % 7}") for i in range(140)] + [(500 + i, prose(rng, 200, ["qu", "quo", "iq"]), "rare") for i in range(8)]
    model = language.train(spark.createDataFrame(table, "doc_id long, text string, lang string"), most=20)
    assert "rare" in model.names
    every = " ".join(prose(rng, 120, s) for s in stems.values())
    odd = [(1, every), (2, "² ½ 12 ③"), (3, "ª"), (4, "12 + x")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert len(got[1].languages) == 7 and got[2].lang_pred == "und" and got[3].lang_pred != "und" and got[4].lang_pred != "und"


def test_mixture_against_plain_em():
    rng = np.random.default_rng(9)
    units = np.array([3, 1, 5])
    loglik = rng.standard_normal((9, 3)) * 5
    share, total = language.mixture(loglik, units)
    at = 0
    for n, got, value in zip(units, share, total):
        rows, p = np.exp(loglik[at : at + n]), np.full(3, 1 / 3)
        for _ in range(language.STEPS):
            post = rows * p
            p = (post / post.sum(1, keepdims=True)).mean(0)
        assert np.allclose(got, p) and np.isclose(value, np.log(rows @ p).sum())
        at += n


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.default_path()
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(slow.encode(r[1] or "", add_special_tokens=False).ids + [0])
    got = packing.pack(docs, path, scratch(spark)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, docs_ in want.items():
        assert sum(r.length for r in by[k]) == sum(map(len, docs_))
        if len(docs_) == 1:
            ids, at = np.array(docs_[0], "<u4"), 0
            for r in sorted(by[k], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    short = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.WINDOW and at & (at - 1) == 0
        short += at < packing.WINDOW
    assert short <= 10
    assert packing.pack(empty, path, scratch(spark)).count() == 0


def test_encoder_equals_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = packing.Encoder(packing.default_path())

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("ab  \n\t 　é'sll1,.<|endoftext|>😀"), max_size=40))
    def same(text):
        assert encoder.ids(text).tolist() == [*encoder.slow.encode(text, add_special_tokens=False).ids, 0]

    same()


def test_added_tokens_are_those_of_the_file(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = packing.default_path()
    slow, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert encoder.ids("see <|endoftext|> here").tolist() == [3826, 220, 50256, 994, 0]
    assert not encoder.whole

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "it's", "é", "😀"]), max_size=12).map("".join))
    def same(text):
        assert encoder.ids(text).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 0]

    same()
    texts = ["see <|endoftext|> here", "<|endoftext|>", "one<|endoftext|><|endoftext|> two "]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, scratch(spark)).collect()
    for i, text in enumerate(texts):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_encoder_takes_a_text_at_once(monkeypatch):
    """Not a call for each new word, nor an encoder for each task; long texts and long white space give the tokenizer's ids."""
    encoder, calls = packing.Encoder(packing.default_path()), []
    monkeypatch.setattr(encoder, "fast", type("Counted", (), {"encode_ordinary": lambda self, text, f=encoder.fast: calls.append(text) or f.encode_ordinary(text)})())
    text = " ".join(f"né{i}ab" for i in range(1000))
    want = [*encoder.slow.encode(text, add_special_tokens=False).ids, 0]
    assert encoder.ids(text).tolist() == want and len(calls) == 1
    for chunk in (1, 2, 7, 100):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        for x in (text, "a  b \n c\t d  ", "   ", " \n x<|endoftext|> y  z", "word \u3000\x85 déjà\x1c vu " * 50):
            assert encoder.ids(x).tolist() == [*encoder.slow.encode(x, add_special_tokens=False).ids, 0]
    assert len(encoder.ids("\n" * 1_100_000 + "x")) == len(encoder.slow.encode("\n" * 1_100_000 + "x", add_special_tokens=False).ids) + 1
    assert packing._encoder(packing.default_path(), 0) is packing._encoder(packing.default_path(), 0)


def test_packing_merges(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    df = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(200)], "doc_id long, text string").repartition(11)
    got = packing.pack(df, packing.default_path(), scratch(spark)).collect()
    total = sum(r.length for r in got)
    lengths = defaultdict(int)
    for r in got:
        lengths[r.sequence_id] += r.length
    assert sum(1 for n in lengths.values() if n == 1024) == total // 1024
    assert all(n & (n - 1) == 0 for n in lengths.values())


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(2)
    table, marks = [], []
    for i in range(300):
        t = prose(rng, 40)
        bad = rng.random() < 0.3
        table.append((i, t + (" " + rng.choice(["idiot", "grumpfel", "grumpfels"]) if bad else "")))
        marks.append((i, None, int(bad)))
    df, labels = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(b) for i, _, b in marks]) > 0.98
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    plain = toxicity.train(df, labels.limit(0))
    assert {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), plain).collect()}[1] > 0.5
    assert toxicity.score(empty, plain).count() == 0


def test_label_model():
    """Accuracies and a correlated pair of voters from votes alone; posteriors against their definition."""
    rng = np.random.default_rng(8)
    y = rng.random(6000) < 0.25
    accuracy = [(0.7, 0.02), (0.6, 0.03), (0.5, 0.01), (0.4, 0.02)]
    v = np.column_stack([rng.random(6000) < np.where(y, a, b) for a, b in accuracy])
    v = np.column_stack([v, np.where(rng.random(6000) < 0.95, v[:, 0], rng.random(6000) < 0.1)]).astype(np.uint8)
    v = np.column_stack([v, ~v.any(1)]).astype(np.uint8)
    start = np.where(rng.random(6000) < 0.97, y, ~y).astype(float)
    model = toxicity.LabelModel.fit(v, start, np.full(6000, 1 / 6000))
    assert abs(model.prior - y.mean()) < 0.05
    assert {frozenset((j, int(a))) for j, a in enumerate(model.parent) if a >= 0} >= {frozenset((0, 4))}
    p = model.posterior(v)
    for j, (a, b) in enumerate(accuracy):
        assert abs((p @ v[:, j]) / p.sum() - a) < 0.15 and abs(((1 - p) @ v[:, j]) / (1 - p).sum() - b) < 0.05
    assert np.mean((p > 0.5) == y) > 0.92
    for row, got in zip(v[:50], p[:50]):
        like = [np.prod([model.chance[k, j, row[a] if a >= 0 else 0, 1] for j, a in enumerate(model.parent) if row[j]]) for k in (0, 1)]
        assert abs(got - model.prior * like[1] / (model.prior * like[1] + (1 - model.prior) * like[0])) < 1e-9


def plain_repeats(texts):
    seen = defaultdict(int)
    for b in texts:
        for s in range(len(b) - 199):
            seen[b[s : s + 200]] += 1
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                cover[s : s + 200] = b"\1" * 200
        out.append(cover)
    return out


def plain_removal(rows):
    data = [(t or "").encode() for _, t in rows]
    want = defaultdict(list)
    for (i, _), b, c in zip(rows, data, plain_repeats(data)):
        want[i].append((len(b), sum(c), len([x for x in bytes(c).split(b"\0") if x]), hashlib.sha256(bytes(x for x, k in zip(b, c) if not k)).hexdigest()))
    return {k: sorted(v) for k, v in want.items()}


def removal(df, spark):
    got = defaultdict(list)
    for r in substrings.remove(df, scratch(spark)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("most", [3000, 1])
def test_substrings(spark, docs, rows, empty, most, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", most)
    monkeypatch.setattr(common, "TEXT_BYTES", 20_000)
    want = plain_removal([(r[0], r[1]) for r in rows])
    assert removal(docs, spark) == want and any(v[0][1] for v in want.values())
    assert substrings.remove(empty, scratch(spark)).count() == 0


@pytest.mark.parametrize("most", [3000, 7])
def test_substrings_hot_anchor(spark, most, monkeypatch):
    """One line, and one passage, in many texts: all contexts of an anchor differ, most by what is around them."""
    monkeypatch.setattr(substrings, "MOST", most)
    rng = random.Random(12)
    line, passage = prose(rng, 16)[:120], prose(rng, 60)[:320]
    data = [(i, f"{prose(rng, 25)} {line if i % 3 else passage}{rng.choice('ab')} {prose(rng, 25)}") for i in range(90)]
    want = plain_removal(data)
    assert removal(spark.createDataFrame(data, "doc_id long, text string").repartition(4), spark) == want
    assert sum(v[0][1] > 0 for v in want.values()) >= 30


def test_pieces_share_keys():
    """Two contexts with an equal string have pieces with that string under one key, at every width."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 400).astype(np.uint8).tobytes()
    for width in (64, 16, 1):
        for place in (0, 3, 60, 168):
            whole = [(k, p + j, c[j : j + 200]) for k, p, n, c in substrings.split(text[:368][: 200 + 168 - place], place, 169 - place, width) for j in range(n)]
            part = [(k, p + j, c[j : j + 200]) for k, p, n, c in substrings.split(text[5:368][: 200 + 160 - place], place + 5, 161 - place, width) for j in range(n)] if place + 5 <= 168 - 5 else []
            assert len(whole) == 169 - place and set(part) <= set(whole)


def test_suffix_sort_against_sets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        pieces = [rng.integers(97, 99, 260).astype(np.uint8).tobytes() for _ in range(3)]
        texts = [pieces[i % 3][: 230 + i % 7] if i % 2 else bytes([i]) + pieces[i % 3][:229] for i in range(9)]
        off = np.array([i % 2 == 0 for i in range(9)], np.int64)
        count = np.array([len(t) - 199 for t in texts], np.int64)
        hit = substrings.repeated(texts, np.zeros(9, np.int64), off, count)
        places = defaultdict(list)
        k = 0
        for i, t in enumerate(texts):
            for j in range(count[i]):
                places[(j - off[i], t[j : j + 200])].append(k)
                k += 1
        want = np.zeros(k, bool)
        for v in places.values():
            if len(v) > 1:
                want[v] = True
        assert (hit == want).all()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def plain_spans(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_secrets(spark, docs, rows, empty):
    rng = random.Random(9)
    tricky = ["secret:token:abcdefgh", "😀 é API_KEY='abc' token=abcdef passwd", "token=" + "A" * 30, "AKIAAKIA" + "B" * 15, "AKIA" * 9, "deadbeef" * 3 + "x" + "0" * 24, "x" * 24, "Password : \"p.a-s_s=w/o+rd1\"" * 5]
    tricky += ["".join(rng.choices(["token", "=", ":", " ", "a1b2c3", "'", "AKIA", "F" * 17, "ab" * 13, "é"], k=30)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for r in secrets.scan(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind_no < 3] == plain_spans(tricky[r.doc_id]), tricky[r.doc_id]
    assert secrets.scan(docs).count() == len(rows) and secrets.scan(empty).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan(docs)).collect() if r.doc_id is not None}
    assert all(clean[r[0]] == r[1] for r in rows if r[0] is not None and not plain_spans(r[1]))
    assert clean[next(r[0] for r in rows if r[1] and r[1].startswith("password"))] == '[SECRET]" [SECRET] [SECRET]'


def plain_battery(token):
    """(p, ok, n) of a candidate, or None where it is too short."""
    v = token.rstrip("=")
    if len(v) < 16:
        return None
    _, _, a, phi, q = next((e for e in secrets.ENCODINGS if re.search(e[1], v)), secrets.ENCODINGS[-1])
    n, codes = len(v), np.array([ord(c) for c in v], float)
    kind = lambda c: "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other"
    changes = sum(kind(x) != kind(y) for x, y in zip(v, v[1:]))
    chi = sum((v.count(c) - n / a) ** 2 / (n / a) for c in set(v)) + (a - len(set(v))) * n / a
    dev = codes - codes.mean()
    rho = (dev[1:] * dev[:-1]).sum() / (dev * dev).sum() if (dev * dev).sum() > 1e-6 else 1.0
    z = (a - 1 + (n - 1) * phi - chi) / (2 * (a - 1) + 4 * n * phi) ** 0.5
    if q:
        natural = secrets.NATURAL_CHANGE
        z = (z + (changes - (n - 1) * natural) / ((n - 1) * natural * (1 - natural)) ** 0.5 + (secrets.NATURAL_SERIAL - abs(rho)) * n**0.5) / 3**0.5
    ok = chi <= a - 1 + 4 * (2 * (a - 1)) ** 0.5 and (not q or abs(changes - (n - 1) * q) <= 4 * ((n - 1) * q * (1 - q)) ** 0.5) and abs(rho) * n**0.5 <= 3.3
    return 1 / (1 + np.exp(min(700, 1.5976 * z + 0.07056 * z**3))), ok, n


def plain_threshold(tokens):
    judged = [x for x in map(plain_battery, tokens) if x]
    m, mean, best = len(judged), np.mean([n for _, _, n in judged]), 0.0
    steps = sorted({int(np.ceil(np.log(p / n) * secrets.STEPS)) for p, _, n in judged})
    for s in steps:
        edge = np.exp(s / secrets.STEPS)
        if edge * mean <= secrets.FDR * sum(p / n <= edge * (1 + 1e-12) for p, _, n in judged) / m:
            best = edge
    return best


def battery_texts():
    import base64

    rng = random.Random(11)
    keys = [base64.b64encode(rng.randbytes(rng.choice((24, 30, 45)))).decode() for _ in range(40)] + [rng.randbytes(20).hex().upper() for _ in range(10)] + [base64.b32encode(rng.randbytes(20)).decode() for _ in range(10)]
    names = ["getTheNumberOfElementsInTheList", "donaudampfschifffahrtsgesellschaft", "path/to/some/other/file/name", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabcabc", "_____________________________", "1234567890" * 3, "THE_MAXIMUM_LENGTH_OF_A_NAME", "=" * 30]
    return keys, names


def test_randomness_battery(spark):
    keys, names = battery_texts()
    texts = [f"see {t} here" for t in keys + names] + [f"password={keys[0]} é {keys[1]}, {names[0]} {keys[2]}", "token: " + keys[3] + " AKIA" + keys[4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(i, m) for i, t in enumerate(texts) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t)]
    limit = secrets.threshold(df)
    assert limit > 0 and abs(limit / plain_threshold([m[0] for _, m in found]) - 1) < 1e-9
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secrets.scan(df).collect()}
    want = defaultdict(list)
    for i, m in found:
        x = plain_battery(m[0])
        if x and x[1] and x[0] / x[2] <= limit and not any(a < m.end() and m.start() < b for _, a, b in plain_spans(texts[i])):
            want[i].append((m.start(), m.end()))
    assert {k: v for k, v in got.items() if v} == dict(want)
    assert sum(bool(got[i]) for i in range(len(keys))) >= 0.85 * len(keys) and not any(got[i] for i in range(len(keys), len(keys) + len(names)))
    assert secrets.threshold(df.limit(0)) == 0.0 and secrets.scan(spark.createDataFrame([(1, "x " + keys[0])], "doc_id long, text string"), 0.0).first().spans == []


def test_secrets_in_linear_time(spark):
    import time

    rng = random.Random(13)
    text = " ".join(rng.randbytes(12).hex() if i % 3 else f"token={rng.randbytes(9).hex()}" for i in range(10_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = secrets.redact(secrets.scan(df)).first()
    assert [(s.kind, s.start, s.end) for s in got.spans if s.kind_no < 3] == plain_spans(text) and not re.search("[0-9a-f]{18}", got.text)
    assert time.time() - began < 60


def test_spans_apart(spark):
    rng = random.Random(14)
    data = []
    for i in range(60):
        at = sorted(rng.sample(range(200), 20))
        mine = [{"start": a, "end": b} for a, b in zip(at[::2], at[1::2])]
        base = [{"start": a, "end": a + rng.randint(1, 30)} for a in rng.choices(range(200), k=rng.randint(0, 5))]
        data.append((i, mine if i else [], base))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(data, f"i int, s {kind}, b {kind}")
    for r in df.select("s", "b", secrets.apart(F.col("s"), F.col("b")).alias("x")).collect():
        assert r.x == [x for x in r.s if not any(y.start < x.end and x.start < y.end for y in r.b)]


def test_quality(spark, docs, rows, empty):
    rng = random.Random(4)
    table, marks = [], []
    for i in range(240):
        bad = rng.random() < 0.4
        lines = ["\n".join(prose(rng, 15) for _ in range(4))]
        if bad:
            lines.append(" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, 120).split()))
        table.append((i, "\n".join(lines)))
        marks.append((i, int(not bad), 0))
    df, labels = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    field = quality.train(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, field).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, q, _ in marks]) > 0.97
    out = quality.score(docs, field)
    assert out.count() == len(rows) and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r.score for r in out.where("text is null or text = ''").collect()} == {0.0}
    assert quality.train(df, labels.where("quality = 1")) == 1.0 and quality.train(empty, labels.limit(0)) == 0.5
    assert quality.score(empty, 0.5).count() == 0


def test_field_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    lines = np.array([1, 4, 3])
    score, trans = rng.standard_normal(8), rng.standard_normal((2, 2))
    p, expected = quality.Chains(lines).marginals(score, trans, True)
    at, all_pairs = 0, np.zeros((2, 2))
    for n in lines:
        weight, total, pairs = np.zeros(n), 0.0, np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + t] * y[t] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            weight += w * np.array(y)
            for t in range(n - 1):
                pairs[y[t], y[t + 1]] += w
        assert np.allclose(p[at : at + n], weight / total)
        all_pairs += pairs / total
        at += n
    assert np.allclose(expected, all_pairs)


def test_hidden_line_labels():
    """Bad texts are good lines around bad ones: the field must find which, from texts' labels alone."""
    rng = np.random.default_rng(5)
    lines, own, label, truth = [], [], [], []
    for i in range(160):
        bad = i % 2
        n = int(rng.integers(6, 14))
        y = np.ones(n, int)
        if bad:
            at = int(rng.integers(0, 2))
            y[at : at + n * 3 // 4 + 1] = 0
        x = rng.standard_normal((n, quality.N_OWN)) * 0.3
        x[:, 0] = np.log1p(100)
        x[:, 4] += np.where(y == 1, 1.0, -1.0)
        lines.append(n), own.append(x), label.append(1 - bad), truth.append(y)
    field = quality.fit(np.array(lines), np.vstack(own), np.array(label))
    x = quality.with_neighbours(np.array(lines), (np.vstack(own) - field.mean) / field.std)
    p, _ = quality.Chains(np.array(lines)).marginals(x @ field.weights, field.trans)
    assert np.mean((p > 0.5) == np.concatenate(truth)) > 0.93
    share, _ = field.shares(np.array(lines), np.expm1(np.vstack(own)[:, 0]), np.vstack(own))
    assert np.mean((1 / (1 + np.exp(-field.slope * share - field.shift)) >= 0.5) == (np.array(label) == 1)) > 0.97


def test_mix(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mix, "ROWS_PER_RANGE", 10)
    got = mix.mix(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*SCHEMA.replace(",", "").split()[::2], "source_size", "target"}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += size(r[1])
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    total, capped = sum(per.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in capped}
        share = {s: (total - sum(capped.values())) * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in share if share[s] > 3 * per[s]]
        if not over:
            break
        capped |= {s: 3 * per[s] for s in over}
    target = capped | share
    taken = defaultdict(int)
    for r in got:
        assert r.size == size(r.text) and r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in per)
    assert mix.mix(empty).count() == 0
    x = spark.createDataFrame([(" a  b\nc d ",)], "text string")
    assert [x.select(mix.head(F.col("text"), F.lit(n))).first()[0] for n in (1, 2, 3, 4)] == [" a", " a  b", " a  b\nc", " a  b\nc d"]


def plain_groups(rows, width, num, den):
    sets, parent = [], {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((i, {tuple(w)} if 0 < len(w) < width else {*zip(*(w[k:] for k in range(width)))}))
    for x, a in sets:
        for y, b in sets:
            if x is not None and y is not None and a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, empty, width, num):
    want = plain_groups([(r[0], r[1]) for r in rows], width, num, 100)
    got = near_dup.groups(docs, scratch(spark), width, num, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len({c for _, c in want.values()}) < len(want) - 5
    assert near_dup.groups(empty, scratch(spark), width, num, 100).count() == 0


def test_near_duplicates_family(spark, monkeypatch):
    """A family of copies of copies, with groups in blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = []
    for i in range(150):
        w = (texts[rng.randrange(len(texts))].split() if texts and rng.random() < 0.4 else base)[:]
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(w))
    data = list(enumerate(texts))
    want = plain_groups(data, 3, 85, 100)
    got = near_dup.groups(spark.createDataFrame(data, "doc_id long, text string"), scratch(spark), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_one_id(spark):
    """Two texts share an id: links of either are found, whatever the order of the rows."""
    rng = random.Random(18)
    a, b = prose(rng, 90), prose(rng, 90)
    data = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (9, b), (9, a + " else"), (8, prose(rng, 90)), (1, a)]
    for order in (data, data[::-1]):
        got = near_dup.groups(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), scratch(spark)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (8, 8), (9, 1), (9, 1)]
        assert len({r.group for r in got}) == 3


def test_sketch_estimates():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) * np.uint64(2**58) for n in (3, 40, 60, 90, 200)]
    k = 16
    sketch = near_dup.padded([x[:k] for x in sets], k)
    for i, x in enumerate(sets):
        hit, size = near_dup.estimates(sketch[i], sketch)
        for j, y in enumerate(sets):
            union = np.union1d(x, y)[:k]
            assert size[j] == len(union) and hit[j] == sum(v in x[:k] and v in y[:k] for v in union)


def test_shingle_counts():
    rng = random.Random(2)
    for width in (1, 3, 5):
        for n in (0, 1, 2, 4, 5, 30, 3000):
            for kinds in (2, 20, 5000):
                words = [b"w%d" % rng.randrange(kinds) for _ in range(n)]
                assert near_dup.n_shingles(words, width) == len(near_dup.shingle_set(words, width))
    assert near_dup.n_shingles([b"w%d" % (i % 300_000) for i in range(300_010)], 5) == 300_000


@pytest.mark.parametrize("busy", [50_000, 3])
def test_components(spark, busy, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    monkeypatch.setattr(common, "BUSY", busy)
    got = common.connected_components(scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert all(r.component == find(r.node) for r in got) and len(got) == len({x for e in edges if e[0] != e[1] for x in e})
