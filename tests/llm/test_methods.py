"""The operators against brute force, exact round trips and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import language_id, minhash, toxicity
from veritab.llm import substring_dedup as substring_module
from veritab.llm._components import connected_components
from veritab.llm.decontamination import contaminated, decontaminate
from veritab.llm.exact_dedup import exact_dedup
from veritab.llm.line_dedup import fuzzy_lines
from veritab.llm.mixing import mix, mix_report
from veritab.llm.quality import importance_resample, select_top, with_ids
from veritab.llm.substring_dedup import later_copies, substring_dedup
from veritab.llm.token_output import EliasFano, Encoder, default_tokenizer, document_boundaries, find_documents, token_output, write_tokens


def words(rng, n, vocabulary=400):
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3):
    """Texts with exact and near copies, shared passages and short ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 120)) for _ in range(25)]
    passage = words(rng, 60)
    texts = base + [base[0], base[1].upper(), base[2] + " tail", passage + " " + base[3], base[4] + " " + passage, "", "short", None]
    for t in base[5:9]:
        w = t.split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    e = EliasFano.encode(np.array(values, np.uint64))
    e = EliasFano(len(values), *e.parts())
    assert e.decode().tolist() == values
    assert [e.select(i) for i in range(0, len(values), 7)] == values[::7]


@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=80))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_the_library(text):
    e = test_encoder_equals_the_library.encoder
    assert e.encode(text).tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2]


test_encoder_equals_the_library.encoder = Encoder(default_tokenizer(), 2)


def test_tokens_round_trip(spark):
    rows = corpus()
    tokenizer = test_encoder_equals_the_library.encoder.tokenizer
    at, want = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_output(frame(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_substrings(spark):
    rows = [*corpus(), (500, "ab" * 200), (501, "x" * 99), (502, "ñ" * 120), (502, "ñ" * 120)]
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(t[p : p + 100])
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_exact(spark):
    rows = [(i, random.Random(i % 7).choice(["Ä b", "ä B", "A b", "a B", "hot", "hot"])) for i in range(200)]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for r in exact_dedup(frame(spark, rows), support=0.1).collect():
        same = [i for i, t in rows if low(t) == low(dict(rows)[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 40)), rng.choice(["a", "a", "a", "a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    got = mix_report(docs).collect()
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 20 for s in names)
    assert Counter(map(tuple, mix_report(docs.repartition(6)).collect())) == Counter(map(tuple, got))
    mixed = Counter(r.doc_id for r in mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})


def shingle_counts(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard_p(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def test_probability_jaccard_and_signatures():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = {int(x): int(c) for x, c in zip(rng.choice(60, 30, False), rng.integers(1, 4, 30), strict=True)}
        b = {int(x): int(c) for x, c in zip(rng.choice(60, 40, False), rng.integers(1, 4, 40), strict=True)}
        arrays = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (a, b)]
        want = jaccard_p(Counter(a), Counter(b))
        assert minhash.probability_jaccard(*arrays[0], *arrays[1]) == pytest.approx(want)
        doc = np.repeat([0, 1], [30, 40])
        r = minhash.prob_minhash(doc, np.concatenate([arrays[0][0], arrays[1][0]]), np.concatenate([arrays[0][1], arrays[1][1]]), 2, 4000)
        assert abs((r[0] == r[1]).mean() - want) < 0.04
        links = minhash.linked_parts([arrays[0], arrays[1]], np.array(["x", "y"]), want - 1e-9)
        assert links and not minhash.linked_parts([arrays[0], arrays[1]], np.array(["x", "y"]), want + 1e-6)


def components(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(160, links)
    assert got == {v: want[v] for link in links for v in link if any(v in x and x[0] != x[1] for x in links)}


def test_near_duplicates(spark):
    rows = corpus()
    sets = [shingle_counts(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and jaccard_p(sets[i], sets[j]) >= 0.8]
    want = components(len(rows), links)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.cluster_id for r in got} == dict(enumerate(want))
    assert {r.doc_id for r in got if r.kept} == set(want)


def test_copies_of_texts_without_words(spark):
    rows = [(1, "-----"), (2, "-----"), (3, "----"), (4, ""), (5, ""), (6, None), (7, "日本語の文章"), (8, "日本語の文章")]
    got = {r.doc_id: r.cluster_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "A train leaves at 30 km per hour and Anna waits 30 minutes while the other train takes 45 minutes to arrive there")], "item_id long, text string")
    same = "x y z. A train leaves at 80 km per hour and Maria waits 80 minutes while the other train takes 12 minutes to arrive there now"
    other = same.replace("waits 80", "waits 81")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(spark, [(1, same), (2, other), (3, "a train leaves the house and nothing else")]), items).collect()}
    assert got == {(1, 1)}


def test_fuzzy_lines(spark):
    many = " ".join(f"w{i}" for i in range(61_000))
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(1, f"{long}\n\nsame"), (2, f"{long.replace('word77 ', 'edited ')}\nSAME \nother"), (3, many + "\nother"), (4, many)]
    got = {(r.doc_id, r.pos): r.kept for r in fuzzy_lines(frame(spark, rows)).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): True, (2, 0): False, (2, 1): False, (2, 2): True, (3, 0): True, (3, 1): False, (4, 0): False}


def test_crf_blocks_equal_the_whole_chain():
    rng = np.random.default_rng(1)
    emit, which, counts, change = rng.normal(0, 2, (50, 3)), rng.integers(0, 50, 400), np.array([200, 0, 1, 63, 64, 65, 7]), rng.normal(0, 1, (3, 3))
    got, at = language_id.document_marginals(emit, which, counts, change), 0
    for n, g in zip(counts, got, strict=True):
        if n:
            assert np.allclose(language_id.forward_backward(emit[which[at : at + n]][None], change)[0][0].sum(axis=0), g)
        at += n


def test_crf_labels_switched_text():
    rng = random.Random(4)
    make = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(n))
    kinds = {"aa": ["tha", "ing", "ous", "wer"], "bb": ["ció", "lla", "ñez", "que"]}
    crf = language_id.train([make(s, 60) for s in kinds.values() for _ in range(20)], [k for k in kinds for _ in range(20)], sequences=400, epochs=4)
    text = make(kinds["aa"], 12) + " " + make(kinds["bb"], 12)
    assert [y for _, y, _ in language_id.label_words(crf, text)] == ["aa"] * 12 + ["bb"] * 12


def test_gru_gradient():
    s = toxicity.Settings(buckets=64, hidden=3, window=5)
    model, rng = toxicity.BiGru.fresh(s), np.random.default_rng(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask, y = rng.normal(size=(4, 5, s.inputs)), np.arange(5) < np.array([[5], [3], [1], [5]]), np.array([1.0, 0, 1, 0])

    def loss():
        f = model.states(lambda t: x[:, t] @ model.p["in_f"] + model.p["on_f"], 4, mask, "f")
        b = model.states(lambda t: x[:, t] @ model.p["in_b"] + model.p["on_b"], 4, mask, "b")
        z = model.pooled(f, b, mask)[1] @ model.p["out"] + model.p["bias"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = model.gradient(x, mask, y)
    for k in ("in_f", "at_f", "on_f", "in_b", "at_b", "on_b", "attend", "out", "bias"):
        i = tuple(rng.integers(0, n) for n in model.p[k].shape)
        old = model.p[k][i]
        model.p[k][i] = old + 1e-3
        up = loss()
        model.p[k][i] = old - 1e-3
        down = loss()
        model.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        w = words(rng, rng.randrange(20, 90), 300).split()
        if bad := i % 6 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten"]) + rng.choice(["ish", "ness", "en", "ist", "al"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    got = toxicity.toxicity(frame(spark, [*rows, (5000, None)]), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got)
    assert all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id == 5000).predicted == 0


def test_importance_resampling(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60, 40) if i % 2 else " ".join(f"z{rng.randrange(40)}" for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 400, 4)], "doc_id long, quality int")
    got = importance_resample(frame(spark, rows), labels).collect()
    assert sum(r.selected for r in got) == 200
    assert np.mean([r.doc_id % 2 for r in got if r.selected]) > 0.99
    top = sorted(got, key=lambda r: -r.gumbel_key)[:200]
    assert {r.doc_id for r in top} == {r.doc_id for r in got if r.selected}


def test_rows_with_ids(spark):
    rng = random.Random(14)
    some = [rng.randrange(-100_000, 100_000) for _ in range(500)] + [0, 1, -1, 32768, 32769, -32768, 1 << 40, None]
    rows = spark.createDataFrame([(i,) for i in [*range(-40_000, 40_000, 7), *some]], "id long")
    ids = spark.createDataFrame([(i,) for i in some[::2] + [0, 32769, None]], "id long")
    want = Counter(r.id for r in rows.collect() if r.id in {i for i in [*some[::2], 0, 32769] if i is not None})
    assert Counter(r.id for r in with_ids(rows, ids).collect()) == want


def test_select_top_with_ties(spark):
    rows = spark.createDataFrame([(i, i, float(i % 3)) for i in range(90)], "doc_id long, rid long, k double")
    got = {r.doc_id for r in select_top(rows, "k", 0.5).where("selected").collect()}
    assert got == {i for i, _ in sorted(((i, (i % 3, i)) for i in range(90)), key=lambda x: x[1])[-45:]}


def test_documents_are_found_by_select(spark, tmp_path):
    rows = [(i * 3, t) for i, t in corpus()] + [(None, "no name"), (9, "a second text of document nine")]
    tokenizer = test_encoder_equals_the_library.encoder.tokenizer
    write_tokens(frame(spark, rows).repartition(4), str(tmp_path / "t"), default_tokenizer(), block_ids=500)
    starts = {(r.doc_id, r.start) for r in document_boundaries(spark, str(tmp_path / "t")).collect()}
    got = find_documents(spark, str(tmp_path / "t"), [9, 30, 31, 90]).collect()
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows if i in (9, 30, 31, 90))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all((r.doc_id, r.start) in starts for r in got)
    assert find_documents(spark, str(tmp_path / "t"), []).count() == 0


def removed_bytes(rows):
    """What substring_dedup should say, by a set of all strings of 100 bytes."""
    seen, want = set(), []
    for i, t in sorted(rows):
        t = t.encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(t[p : p + 100])
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return want


def test_substrings_over_pieces_in_several_rounds(spark, monkeypatch):
    """Texts of more than one piece, and equal strings that meet only across pieces, with other surroundings each time."""
    rng, calls = random.Random(8), []
    monkeypatch.setattr(substring_module, "reranked", lambda p, one, two, rank, real=substring_module.reranked: calls.append((one, two)) or real(p, one, two, rank))
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (60, 99, 100, 101, 130, 160)]
    fill = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(i, fill(rng.randrange(40, 200)) + passages[i % 6][rng.randrange(20) :] + fill(30) + passages[(i + 1) % 6] + fill(rng.randrange(90))) for i in range(60)]
    rows.append((100, fill(1_300_000) + passages[3] + fill(1_300_000) + passages[5]))
    rows.append((101, fill(900_000) + passages[5] + passages[3]))
    got = substring_dedup(frame(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed_bytes(rows)
    assert calls == [("r0", "r1"), ("r2", "r3")]  # strings of 50 bytes from 25; those of 100 are the last pairs


def test_prefix_doubling_from_single_ranks(spark):
    """More rounds, on ranks of one letter."""
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(400))
    rows = [(p, *[ord(text[p + i]) for i in range(8)]) for p in range(len(text) - 7)]
    got = {r.pos for r in later_copies(spark.createDataFrame(rows, "pos long, " + ", ".join(f"r{i} long" for i in range(8))), 1, 8).collect()}
    seen, want = set(), set()
    for p in range(len(text) - 7):
        if text[p : p + 8] in seen:
            want.add(p)
        seen.add(text[p : p + 8])
    assert got == want


def test_coverage_of_verbatim_windows(spark):
    """Decontamination against brute force, on texts without placeholders."""
    rng = random.Random(10)
    letters = ["".join(rng.choice("klmnoprstu") for _ in range(5)) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(letters, k=n))
    items = [(i, say(rng.randrange(3, 30))) for i in range(12)]
    docs = []
    for i in range(80):
        w = items[i % 12][1].split()
        if i % 3:
            w[rng.randrange(len(w))] = rng.choice(letters)
        docs.append((i, f"{say(20)} {' '.join(w)} {say(20)}" if i % 7 else say(60)))
    grams = lambda w, n: [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
    want = {}
    for d, text in docs:
        for i, item in items:
            w = item.split()
            n = min(5, len(w))
            held = set(grams(text.split(), n))
            matched = sum(g in held for g in grams(w, n))
            if matched >= 0.8 * len(grams(w, n)):
                want[d, i] = (len(grams(w, n)), matched)
    got = contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in got} == want and want


def test_log_weights(spark):
    """Against counts of words and pairs, with so many buckets that none meet."""
    rng = random.Random(12)
    rows = [(i, words(rng, 30, 25)) for i in range(60)] + [(60, None), (61, "")]
    good = set(range(0, 60, 7))
    labels = spark.createDataFrame([(i, 1) for i in good] + [(1, 0)], "doc_id long, quality int")
    counts = [Counter(), Counter()]
    grams = lambda t: (w := (t or "").split()) + list(zip(w, w[1:], strict=False))
    for i, t in rows:
        counts[0].update(grams(t))
        if i in good:
            counts[1].update(grams(t))
    buckets = 4_000_037
    total = [sum(c.values()) + buckets for c in counts]
    for r in importance_resample(frame(spark, rows), labels, buckets=buckets).collect():
        g = grams(dict(rows)[r.doc_id])
        want = sum(np.log((counts[1][x] + 1) / total[1]) - np.log((counts[0][x] + 1) / total[0]) for x in g)
        assert r.n_ngrams == len(g) and r.log_weight == pytest.approx(want)


def test_which_rows_the_stages_drop(spark):
    rng = random.Random(13)
    base = [words(rng, 60, 300) for _ in range(12)]
    item = words(rng, 25, 500)
    docs = frame(spark, [*enumerate(base), (20, base[0]), (21, base[1] + " end"), (22, base[2] + " " + item), (23, None), (24, None)])
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(docs).collect() if r.doc_id < 22) == list(range(12))
    left = decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} == {22}
    texts, marks = [], []
    for i in range(400):
        w = words(rng, 40, 200).split()
        if bad := i % 5 == 0:
            w.insert(rng.randrange(40), "vilest")
        texts.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    clean = toxicity.drop_toxic(frame(spark, texts), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {r.doc_id for r in clean.collect()} == {i for i, bad in marks if not bad}


def test_bytes_of_arrow_slices():
    from veritab.llm._words import words as cut

    texts = pa.array(["zero", "Éa b-1", None, "", "x"]).slice(1)
    w = cut(texts)
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == ["éa", "b", "1", "x"]
    assert w.doc.tolist() == [0, 0, 0, 3] and w.first.tolist() == [0, 3, 3, 3, 4]
