"""Corpus operators on small fixtures: contracts, edge cases, brute force."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sumring.llm import jaccard_join, line_dedup, lm, minhash, mixing, piece_fst, pivots, quality, token_store, warc
from sumring.llm.common import connected_components, fresh_path
from sumring.llm.wordhash import shingle_hashes, word_hashes

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, keys string, blk int"


def corpus(n=60, seed=1):
    """Random documents, copies, near copies, nulls, empty and white-space texts, a repeated row, an extra long one; extra columns that
    clash with names used inside."""
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 120)))) for i in range(n)]
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1].upper()), (n + 3, None), (n + 4, ""), (n + 5, " \t\n"), (n + 6, "one two"), (n + 7, "One  two"), (None, rows[5][1]), (4, rows[4][1])]
    base = list(rng.choice(WORDS, 300))
    rows += [(n + 10 + k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(0, 40, 4)]
    rows.append((n + 60, " ".join(rng.choice(WORDS, 20_000))))
    return [(i, t, ["en", None, "de"][k % 3], ["src0", "src1", None][k % 3], None if t is None else len(t), 1, "x", 2) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_match_split():
    texts = [b"", b"  ", b"A b\x0bC\x0c\td\ne", "É a é".encode(), b"x" * 5000]
    h, counts = word_hashes(texts)
    want = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    names = {}
    for word, x in zip([w for ws in want for w in ws], h, strict=True):
        assert names.setdefault(word, x) == x
    assert len(set(names.values())) == len(names)
    assert len(shingle_hashes(h[:2], 3)) == 1 and len(shingle_hashes(h[:0], 3)) == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    from sumring.llm import common

    monkeypatch.setattr(common, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(500 + i, 500) for i in range(40)] + [(60 + i, 59 + i) for i in range(30)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(90)} | {500 + i: 500 for i in range(40)}


BIG = 2**60


@pytest.fixture(scope="module")
def big_ids(spark):
    """Ids that doubles cannot tell apart, beside a null, in one batch; columns named like inner ones."""
    text = " ".join(WORDS[:60])
    rows = [(BIG + 1, text + " one", "en", "src1", 1), (None, "x y z", None, None, None), (BIG + 3, text + " two", "en", "src1", 3), (BIG + 5, " ".join(WORDS[100:160]), "de", "src0", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    extra = {c: F.lit(7).cast("long") for c in ("_k", "_l", "_s", "_upto", "room", "end_epoch", "_bp_host", "_bp_n", "_bp_keys", "_text", "__text", "_gone", "key", "bucket", "last", "range", "extra", "_host", "_end", "_quality_score", "n", "keys", "x")}
    return df.withColumns(extra).cache()


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is not None, x))


def test_large_ids_beside_nulls(spark, big_ids):
    pytest.importorskip("public_tokenizers")
    want, tail = [None, BIG + 1, BIG + 3, BIG + 5], big_ids.columns[5:]
    same = lambda df: [r[c] for r in df.collect() for c in tail]
    assert ids(lm.score_documents(None, lm.train_model(big_ids))) == want
    cut = line_dedup.drop_boilerplate(big_ids)
    assert ids(cut) == want and set(same(cut)) == {7} and set(big_ids.columns) < set(cut.columns)
    vectors = spark.createDataFrame([(BIG + 1, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (BIG + 3, [0.0, 1.0], 1), (BIG + 5, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int").coalesce(1)
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(vectors).collect()}
    assert out == {BIG + 1: (1, BIG + 1), BIG + 5: (1, BIG + 1), BIG + 3: (0, BIG + 3), None: (0, None)}
    pages = big_ids.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit("z" * 2000).alias("html"))
    got = {r["page_id"]: r["refers_to"] for r in warc.read_records(warc.write_archives(pages, fresh_path(spark, "big"))).collect()}
    assert got == {None: None, BIG + 1: BIG + 5, BIG + 3: BIG + 5, BIG + 5: None}
    assert ids(minhash.fingerprints(big_ids)) == want
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(big_ids).collect()}
    assert classes == {None: None, BIG + 1: BIG + 1, BIG + 3: BIG + 1, BIG + 5: BIG + 5}
    labels = spark.createDataFrame([(BIG + 1, 1), (BIG + 5, 0)], "doc_id long, quality int")
    rated = quality.scored(big_ids, quality.train(big_ids, labels))
    assert ids(rated) == want and set(same(rated)) == {7} and sorted(str(r["n_chars"]) for r in rated.collect()) == ["1", "3", "None", "None"]
    coded = piece_fst.encode_decode(big_ids, piece_fst.model_path(), [c for c in big_ids.columns if c != "text"])
    assert ids(coded) == want and set(same(coded)) == {7} and coded.columns[: len(big_ids.columns) - 1] == [c for c in big_ids.columns if c != "text"]
    mixed = mixing.mix(big_ids, share=(2, 1))
    assert sorted(set(ids(mixed)), key=str) == sorted(want, key=str) and set(same(mixed)) == {7} and mixed.columns == [*big_ids.columns, "mix_epoch", "mix_tokens", "mix_domain"]


def test_stages_keep_ids_and_columns(spark, big_ids, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(BIG + 1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, big_ids, str(tmp_path))
        assert set(ids(out)) <= {None, BIG + 1, BIG + 3, BIG + 5}, name
        assert len(set(ids(out))) == (3 if "Jaccard" in name else len(set(ids(out)))), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == big_ids.columns, name


def test_lm(spark, docs):
    out = lm.score_documents(docs, lm.train_model(docs.where(lm.crc_mod(F.col("doc_id"), 10) != 0))).toPandas()
    assert len(out) == docs.count()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = {}
    for i, ws in rows:
        for w in [*ws, None] if not held(i) else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None]), 6) for _, ws in rows)
    assert sorted(out.base_score.round(6)) == want
    assert (out.train_tokens == n).all() and (out.score < 0).all() and out.n_tokens.min() == 1
    assert lm.score_documents(empty(spark), lm.train_model(empty(spark))).count() == 0


def brute_lm(train, texts, weights, seen):
    """log10 probabilities of ``texts`` bit by bit, from the definitions."""
    slots = {}
    for t in train:
        flat = b"\xfe" * 6 + t + b"\xff"
        for at in range(6, len(flat)):
            for o in lm.ORDERS:
                slots.setdefault((o, flat[at - o : at]), []).append(f"{flat[at]:08b}")
    out = []
    for t in texts:
        flat, total = b"\xfe" * 6 + t + b"\xff", 0.0
        for at in range(6, len(flat)):
            bits, cost = f"{flat[at]:08b}", 0.0
            for k in range(8):
                node, x, known = int("1" + bits[:k], 2), [], 0
                for o in lm.ORDERS:
                    same = [b for b in slots.get((o, flat[at - o : at]), []) if b.startswith(bits[:k])]
                    taken = sum(b[k] == bits[k] for b in same)
                    known += bool(same)
                    x.append(np.log((taken + lm.DELTA) / (len(same) - taken + lm.DELTA)))
                z = float(np.clip(weights[:, known * 256 + node] @ np.array(x), -12, 12))
                up = z if bits[k] == "1" else -z
                bucket = int(np.rint((min(8, max(-8, up)) + 8) * 4))
                zeros, ones = seen[node * 65 + bucket]
                one = min(max((ones + 32 / (1 + np.exp(8 - bucket / 4))) / (zeros + ones + 32), 2**-16), 1 - 2**-16)
                cost -= np.log10((1 / (1 + np.exp(-z)) + (one if bits[k] == "1" else 1 - one)) / 2)
            total += cost
        out.append(-total)
    return out


def test_lm_scores_against_brute_force(spark, docs):
    some = docs.where("doc_id < 12 or doc_id > 61 and doc_id < 68 or doc_id is null")
    model = lm.train_model(some, lm.crc_mod(F.col("doc_id"), 10) != 0)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in some.collect()]
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0]
    assert model["seen"].sum() == 8 * sum(len(t) + 1 for t in train)  # the map has seen every bit of every training text
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm.score_documents(None, model).collect())
    want = sorted((str(i), x) for (i, _), x in zip(rows, brute_lm(train, [t for _, t in rows], model["weights"], model["seen"]), strict=True))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-4, atol=1e-3)


def test_lm_does_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "WINDOW", 5000)  # long texts in windows too
    held = lm.crc_mod(F.col("doc_id"), 10) != 0
    got = []
    for n in (1, 8):
        model = lm.train_model(docs.repartition(n), held)
        got.append([sorted((str(r["doc_id"]), r["score"], round(r["base_score"], 6), r["n_known"]) for r in out.collect()) for out in (lm.score_documents(None, model), lm.score_documents(docs, model))])
    assert got[0][0] == got[1][0] == got[0][1] == got[1][1]


def test_lm_beats_tokens_on_held_out_text(spark):
    rng = np.random.default_rng(8)
    stems = ["tion", "ing", "the", "and", "er", "ou", "ea", "th"]
    word = lambda: "".join(rng.choice(stems, rng.integers(1, 5)))
    df = spark.createDataFrame([(i, " ".join(word() for _ in range(60))) for i in range(300)], "doc_id long, text string")
    out = lm.score_documents(None, lm.train_model(df, lm.crc_mod(F.col("doc_id"), 10) != 0)).where("held_out").toPandas()
    assert len(out) > 15 and out.score.sum() > 1.2 * out.base_score.sum()


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    grams = np.array(sorted({int.from_bytes(bytes([*rng.integers(97, 100, 6), b]), "big") for b in rng.integers(0, 256, 400)} | {int.from_bytes(b"bacaba" + bytes([b]), "big") for b in range(256)}), np.uint64)
    low = np.unique(lm.shorter(grams, 2), return_counts=True)
    slots = lm.Slots(grams, rng.integers(0, 9, len(grams)).astype(float), (low[0], low[1] * 3.0))
    m = lm.Mixer(rng.normal(0.3, 0.1, (lm.N, lm.GATES)), rng.integers(0, 50, (256 * lm.BUCKETS, 2)).astype(float))
    cost = m.costs(slots, np.flatnonzero(grams >> np.uint64(8) == int.from_bytes(b"bacaba", "big")))
    assert len(cost) == 256 and abs((10 ** -(cost / lm.UNIT)).sum() - 1) < 1e-4


def test_line_dedup(spark):
    rows = [(i, f"menu\nbody {i}\n\nfoot", "h") for i in range(30)] + [(90, "menu\nunique", "other"), (91, None, "h"), (92, "", None), (93, "body 1\nmenu\n", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"line_hash": F.lit(1), "n_lines": F.lit(9)})
    out = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert out[4]["text"] == "body 4\n" and out[4]["n_lines"] == 4 and out[4]["n_dropped"] == 2
    assert out[90]["text"] == "menu\nunique" and out[91]["text"] is None and out[92]["text"] == "" and out[93]["text"] == "body 1\n"
    assert line_dedup.drop_boilerplate(empty(spark)).count() == 0
    hosts = spark.createDataFrame([("https://u:p@www.Ex.com:80/x",), (None,), ("nothing",)], "u string").select(line_dedup.url_host(F.col("u"))).collect()
    assert [h[0] for h in hosts] == ["ex.com", "", ""]


def test_line_dedup_with_and_without_broadcast(spark, docs, monkeypatch):
    rows = [(i, "\n".join(["menu", f"a{i % 7}", f"b{i}"] + ["foot"] * (i % 2)), "h" if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for most in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        got.append(sorted(map(tuple, line_dedup.drop_boilerplate(df).collect())))
    assert got[0] == got[1] and any(r[-1] for r in got[0])


def test_line_stage_cuts_what_stands_on_8_percent_of_a_host(spark):
    import corpus_pipeline

    rows = [(i, f"body {i}" + "\nmenu" * (i < 16) + "\nphrase" * (i % 23 == 0), "h", 0) for i in range(200)]
    out = corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), "").collect()
    assert len(out) == 200
    assert all(r["text"] == rows[r["doc_id"]][1].replace("\nmenu", "") and r["n_chars"] == len(r["text"]) for r in out)


@pytest.mark.parametrize("block", [pivots.BLOCK, 30])
def test_pivots_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "TILE", 1000)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    near = base[:60] + rng.normal(scale=0.03, size=(60, 24))
    hot = base[0] + rng.normal(scale=0.02, size=(80, 24))
    v = np.vstack([base, near, hot, base[:5]]).astype(np.float32)
    rows = [(i, [float(x) for x in r], i % 2 if i < 150 else 0) for i, r in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, [1.0] * 24, None), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (None, rows[1][1], 1)]
    out = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    assert len(out) == len(rows)
    ok = [r for r in rows if r[0] is not None and r[0] not in (900, 901, 902, 903)]
    links, parent = {r[0]: 0 for r in ok}, {r[0]: r[0] for r in ok}
    for a in ok:
        for b in ok:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    low, high = sorted((parent[a[0]], parent[b[0]]))
                    parent = {k: low if p == high else p for k, p in parent.items()}
    got = out.dropna(subset=["vec_id"]).set_index("vec_id")
    found, true = sum(got.n_links[i] for i in links), sum(links.values())
    assert true > 1000 and 0.9 * true <= found <= true
    assert all(got.n_links[i] <= n for i, n in links.items()) and (got.n_links[[900, 901, 902, 903]] == 0).all()
    if found == true:
        assert all(got.component_id[i] == p for i, p in parent.items())
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://f", ""), (None, "http://g", big), (7, "x\r\ny", big), (7, "again", big), (8, "u", "z\r\n\r\nWARC/1.1 " * 200_000)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), fresh_path(spark, "warctest"))
    out = warc.read_records(index).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if r["page_id"] in (1, 2) else ("response", None))
        assert r["record_type"] == "revisit" or r["html"] == html
    some = warc.read_records(index.where("page_id = 8")).collect()
    assert len(some) == 1 and some[0]["html"] == rows[-1][2]
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), fresh_path(spark, "warctest"))).count() == 0


def test_huffman():
    rng = np.random.default_rng(0)
    for size, n in ((1, 10), (2, 5), (300, 5000), (40_000, 60_000)):
        ids = (rng.zipf(1.3, n) % size).astype(np.uint32)
        lengths = token_store.code_lengths(np.bincount(ids, minlength=size))
        assert lengths.max() <= token_store.LIMIT and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        stream, marks = token_store.pack(ids, lengths, token_store.canonical(lengths))
        assert (token_store.unpack(stream, marks, n, token_store.decoding_table(lengths)) == ids).all()
    skew = np.array([2**k for k in range(40)])
    assert token_store.code_lengths(skew, 6).max() == 6
    assert token_store.code_lengths(np.zeros(5, int)).max() == 0


def test_tokens(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    enc = token_store.Encoder.of(path)
    tok = tokenizers.Tokenizer.from_file(path)
    for text in ("a b  c\x0bd\x1cg <|endoftext|>x it's İstanbul ÀÉ é ́x 12ab\x85q", "'s don't", "", " "):
        assert np.frombuffer(enc([text])[0], "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]
    rng = np.random.default_rng(7)
    parts = [*"aAbsStTrRd'\"|<>.,;-_ \t\x1c\x85 ÀéßÿŸ×÷1２̸́ΣİǅK#@", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "n't", "re"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 24))) for _ in range(2000)]
    for at in range(0, len(texts), 100):  # whole batches, whose chunks are cut, cached and put together again
        some = texts[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc(some)] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in some]
    tokens = token_store.encoded(docs, path)
    lengths = token_store.code_lengths(token_store.count_ids(tokens, tok.get_vocab_size()))
    out = token_store.read_tokens(token_store.write_tokens(tokens, fresh_path(spark, "toktest"), lengths), lengths).toPandas().sort_values("start")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ids = [[*tok.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]
    assert out.n_tokens.tolist() == [len(x) for x in ids] and out.start.tolist() == np.cumsum([0, *map(len, ids[:-1])]).tolist()
    assert out.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    tokens = token_store.encoded(empty(spark), path)
    none = token_store.code_lengths(token_store.count_ids(tokens, tok.get_vocab_size()))
    assert token_store.read_tokens(token_store.write_tokens(tokens, fresh_path(spark, "toktest"), none), none).count() == 0


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark, docs):
    out = minhash.fingerprints(docs).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault((r["doc_id"], r["edited_sha256"]), []).append(r)
    prints = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[i, hashlib.sha256(changed.encode()).hexdigest()].pop()
        assert r["n_chars"] == len(text) and prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert abs(r["near_edited"] - jaccard(sets(text, 5), sets(changed, 5))) < 0.16
        assert abs(r["near_next"] - jaccard(sets(text, 5), sets(after, 5))) < 0.16
    one = minhash.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    assert minhash.fingerprints(empty(spark)).count() == 0


def test_fingerprint_ranges_beyond_one_level(spark, monkeypatch):
    rows = [(int(i), f"t{i} " * 30) for i in np.random.default_rng(3).permutation(500) * 3] + [(None, "null"), (9, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, minhash.fingerprints(df).collect()), key=str)
    monkeypatch.setattr(minhash, "FANOUT", 4)
    monkeypatch.setattr(minhash, "RANGE_CHARS", 4000)
    assert minhash.with_ranges(df, 14).select("range").distinct().count() > 8
    assert sorted(map(tuple, minhash.fingerprints(df).collect()), key=str) == want


@pytest.mark.parametrize("block, star", [(jaccard_join.BLOCK, jaccard_join.STAR), (500, jaccard_join.STAR), (500, 1)])
def test_jaccard_join(spark, docs, block, star, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "STAR", star)
    out = jaccard_join.classes(docs).collect()
    rows = [(r["doc_id"], sets(r["text"], 3)) for r in docs.collect()]
    parent = {i: i for i, _ in rows if i is not None}
    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 90 * len(a | b):
                low, high = sorted((parent[i], parent[j]))
                parent = {k: low if p == high else p for k, p in parent.items()}
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == sorted(((i, len(s), parent.get(i)) for i, s in rows), key=str)
    assert jaccard_join.classes(empty(spark)).count() == 0


def test_near_duplicate_stage_against_brute_force(spark):
    """Pairs around a Jaccard of 0.8 on 5-word shingles, many of them under 0.9 on 3-word ones."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 200)))) for i in range(60)]
    for i in range(60):
        words = rows[i][1].split()
        for at in rng.integers(0, len(words), 1 + len(words) // 60):
            words[at] = f"y{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "a b c"), (303, "A  b c"), (304, rows[0][1].upper())]
    five = {i: sets(t, 5) for i, t in rows}
    parent = {i: i for i, _ in rows}
    for i, a in five.items():
        for j, b in five.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((parent[i], parent[j]))
                parent = {k: low if p == high else p for k, p in parent.items()}
    loose = [i for i in range(60) if parent[100 + i] == i and jaccard(sets(rows[i][1], 3), sets(rows[60 + i][1], 3)) < 0.9]
    assert len(loose) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, p in parent.items() if i == p)


def test_keys_are_shared_by_linked_pairs_of_the_pipeline():
    rng = np.random.default_rng(6)
    for n in [*range(1, 60), 200, 777, 3000]:
        for _ in range(3):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, n * 0.2 + 1))
            grow = int((n - drop) / 0.8 - n) if drop < n else 0
            b = np.union1d(rng.choice(a, n - drop, replace=False), rng.integers(0, 2**63, max(0, grow)).astype(np.uint64))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 80 * (len(a) + len(b) - inter):
                assert set(jaccard_join.keys_of(a, 80, 100).tolist()) & set(jaccard_join.keys_of(b, 80, 100).tolist())


def test_keys_are_shared_by_every_linked_pair():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 200, 777, 3000]:
        for _ in range(3):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, n * 0.1 + 1))
            grow = int((n - drop) / 0.9 - n) if drop < n else 0
            b = np.union1d(rng.choice(a, n - drop, replace=False), rng.integers(0, 2**63, max(0, grow)).astype(np.uint64))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 90 * (len(a) + len(b) - inter):
                assert set(jaccard_join.keys_of(a).tolist()) & set(jaccard_join.keys_of(b).tolist())


def test_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**62, rng.integers(5, 200))) for _ in range(120)]
    items = base + [np.unique(np.concatenate([x[2:], rng.integers(0, 2**62, 1)])) for x in base]
    points, sizes = np.array([jaccard_join.count_vector(x) for x in items]), np.array([len(x) for x in items])
    tree = jaccard_join.Tree(points, sizes)
    for i in range(len(items)):
        hits = set(tree.search(points[i], sizes[i]).tolist())
        assert {j for j in range(len(items)) if jaccard_join.linked(items[i], items[j])} <= hits


def test_quality(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join(rng.choice(WORDS, 80)) + ".\n" + " ".join(rng.choice(WORDS, 30)) + "."
    bad = lambda: " ".join(w + "%%%" for w in rng.choice(WORDS, 80))
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 > 0)) for i in range(300)]
    df = spark.createDataFrame([*((i, t) for i, t, _ in rows), (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, q) for i, _, q in rows), (1, None), (None, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r["s"] for r in quality.scored(df, quality.train(df, labels), "s").collect()}
    assert np.mean([(out[i] >= quality.CUT) == bool(q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.97
    assert all(0 <= x <= 1 for x in out.values()) and len(out) == 303
    none = quality.train(df, labels.where("quality = 1"))
    assert quality.accepted(df, none).count() == df.count()
    assert quality.scored(empty(spark), none).count() == 0


def test_pairwise_fit_against_plain_descent():
    """The weights minimise the Bradley-Terry loss over the very pairs, found here by plain gradient descent."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, quality.N_FEATURES))
    good = x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=2.0, size=80) > 0
    model = quality.fit(x, good, seed=7)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    n = quality.PAIRS_EACH * min(len(a), len(b))
    d = z[np.random.default_rng(7).permutation(np.resize(a, n))] - z[np.resize(b, n)]
    ridge = np.r_[np.full(quality.N_FEATURES - 128, quality.L2), np.full(128, quality.L2_HASHED)]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + (ridge * w * w).sum() / 2
    w = model["w"].copy()
    start = loss(w)
    for _ in range(200):
        w = w - 0.05 * (ridge * w - d.T @ (1 / (1 + np.exp(d @ w))) / n)
    assert start <= loss(w) + 1e-6 and start < loss(np.zeros_like(w)) / 2


def test_long_texts_are_read_whole_in_windows(monkeypatch):
    text = " ".join(np.random.default_rng(2).choice(WORDS, 3000))
    want = quality.features(text), word_hashes([text.encode()])
    monkeypatch.setattr(quality, "WINDOW", 1000)
    assert np.allclose(quality.features(text), want[0])
    got = word_hashes([b"a", text.encode(), b""], 500)
    assert (got[0][1:] == want[1][0]).all() and got[1].tolist() == [1, 3000, 0]


def test_pieces():
    spm = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    sp, m = spm.SentencePieceProcessor(model_file=path), piece_fst.Machine.of(path)
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz  \n.,ÉüßБ日😀\t▁")
    texts = ["", " ", "  ", "\n", "Hello  world\nfoo ▁x", "a\n\n b \n", "日本語 and 😀😀", "if (x == 0) {\n        return -1;\n    }"] + ["".join(rng.choice(letters, 60)) for _ in range(400)]
    for t in texts:
        ids = np.frombuffer(m.encode(t), np.uint32).tolist()
        assert ids == sp.encode(t), t
        assert m.decode(ids) == t.replace("▁", " ")


def test_normaliser_settings():
    """Each machine against plain string functions; its table form against its walk."""
    for text in ("", " ", "a", " a  b ", "  x", "y  ", "one two", "\n a"):
        words = [w for w in text.split(" ") if w]
        for prefix in (True, False):
            for gap, escape in (("▁", True), (" ", False)):
                first = gap if prefix else ""
                squeezed = piece_fst.Normaliser(prefix, True, escape)
                assert squeezed(text) == (first + gap.join(words) if words else "")
                plain = piece_fst.Normaliser(prefix, False, escape)
                assert plain(text) == (first + text.replace(" ", gap) if text else "") == plain.walk(text)


def test_settings_that_are_not_covered_are_refused(tmp_path):
    public = pytest.importorskip("public_tokenizers")
    data = open(public.path("piece_bpe_32k.model"), "rb").read()
    at = data.rindex(b"identity") - 2
    for extra in (b"\x12\x02ab", b"\x32\x01a"):  # a character map, rules
        bad = tmp_path / "bad.model"
        size = data[at - 1]
        bad.write_bytes(data[: at - 1] + bytes([size + len(extra)]) + data[at : at + size] + extra + data[at + size :])
        with pytest.raises(ValueError):
            piece_fst.Normaliser.of(str(bad))


def test_best_path_against_a_composition_of_explicit_machines():
    """Viterbi over (last piece, prefix of the next), one character of the normalised chain after another."""
    public = pytest.importorskip("public_tokenizers")
    m = piece_fst.Machine(public.path("piece_bpe_32k.model"))
    rng, begins = np.random.default_rng(5), {p[:k] for p in m.id for k in range(1, len(p) + 1)}
    for text in ["", "hello", "the cat  sat", "日本é", *("".join(rng.choice(list("abet hiß日."), 14)) for _ in range(40))]:
        states = {(-1, ""): (0.0, ())}
        for c in m.normal(text):
            after: dict = {}
            for (last, prefix), (cost, out) in states.items():
                word = prefix + c
                moves = [((last, word), 0.0, ())] if word in begins else []
                piece = m.id.get(word)
                if piece is not None and (last < 0 or m.merges(m.piece[last] + word) == [m.piece[last], word]):
                    moves.append(((piece, ""), 1.0, (piece,)))
                if not prefix and c not in m.id:
                    moves.append(((-1, ""), 1e3, tuple(m.byte[b] for b in c.encode())))
                for state, weight, put in moves:
                    if state not in after or cost + weight < after[state][0]:
                        after[state] = (cost + weight, out + put)
            states = after
        best = min(v for (_, prefix), v in states.items() if not prefix)
        assert list(best[1]) == np.frombuffer(m.encode(text), np.uint32).tolist(), text


def test_piece_query_edges(spark, docs):
    pytest.importorskip("public_tokenizers")
    out = piece_fst.encode_decode(docs, piece_fst.model_path(), ["doc_id", "range"]).collect()
    assert len(out) == docs.count() and all(r["round_trip"] for r in out) and min(r["n_pieces"] for r in out) == 0
    assert piece_fst.encode_decode(empty(spark), piece_fst.model_path(), ["doc_id"]).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 30))), ["en", "de", None][i % 3], f"src{i % 5}") for i in range(400)] + [(500, None, "en", "src0"), (501, "", None, None), (3, "dup dup", "en", "src3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"budget": F.lit(1), "bucket": F.lit(2), "epoch": F.lit(0)})
    out = mixing.mix(df)
    assert out.columns[: len(df.columns)] == df.columns
    leaf = out.groupBy("mix_domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("mix_tokens").alias("took")).toPandas()
    have = pd.DataFrame(rows, columns=["i", "t", "lang", "source"]).fillna({"t": "", "lang": "", "source": ""})
    have["tokens"] = have.t.str.split().map(len)
    have["domain"] = np.where(have.source == "src0", "web", "curated")
    want = budgets(have)
    for r in leaf.itertuples():
        room = want[r.mix_domain, r.lang, r.source] - r.took
        assert 0 <= room < 30 or r.took == 2 * have[(have.lang == r.lang) & (have.source == r.source)].tokens.sum()
    assert mixing.mix(empty(spark)).count() == 0


def budgets(have):
    """Plain recursive water filling."""
    leaf = have.groupby(["domain", "lang", "source"]).tokens.sum() * 2

    def fill(budget, kids):  # kids: name -> (weight, capacity)
        out, left = {}, dict(kids)
        while left:
            w = sum(x for x, _ in left.values())
            full = [k for k, (x, c) in left.items() if c * w <= budget * x]
            if not full:
                return out | {k: budget * x // w for k, (x, _) in left.items()}
            for k in full:
                out[k] = left.pop(k)[1]
                budget -= out[k]
        return out

    total = int(leaf.sum()) // 2 * 9 // 10
    result = {}
    domains = fill(total, {d: (mixing.DOMAIN_WEIGHTS.get(d, 1), int(leaf[d].sum())) for d in leaf.index.levels[0]})
    for d, b in domains.items():
        langs = fill(b, {x: (mixing.LANG_WEIGHTS.get(x, 1), int(leaf[d][x].sum())) for x in leaf[d].index.get_level_values(0).unique()})
        for x, c in langs.items():
            result |= {(d, x, s): v for s, v in fill(c, {s: (1, int(n)) for s, n in leaf[d][x].items()}).items()}
    return result


def plain_pipeline(rows, model):
    """The five stages in plain Python, from their definitions (the classifier's weights are given): (doc_id, ids) of every row that comes out."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_fst.model_path())
    rows = [r for r in rows if quality.score(model, quality.features(r[1])[None])[0] >= quality.CUT]
    pages = {}
    for _, text, _, source in rows:
        pages.setdefault(source or "", set()).add(text or "")
    cut = set()
    for host, texts in pages.items():
        count = {}
        for t in texts:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        cut |= {(host, line) for line, k in count.items() if k >= 5 and k > 0.065 * len(texts)}
    rows = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s or "", x.strip(" ")) not in cut), g, s) for i, t, g, s in rows]
    five, parent = [(r[0], sets(r[1], 5)) for r in rows], {r[0]: r[0] for r in rows}
    for i, a in five:
        for j, b in five:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((parent[i], parent[j]))
                parent = {k: low if p == high else p for k, p in parent.items()}
    rows = [r for r in rows if parent[r[0]] == r[0]]
    have = pd.DataFrame([("web" if s == "src0" else "curated", g or "", s or "", len((t or "").split())) for _, t, g, s in rows], columns=["domain", "lang", "source", "tokens"])
    room, out = budgets(have), []
    for (domain, lang, source), left in room.items():
        leaf = [r for r in rows if ("web" if r[3] == "src0" else "curated", r[2] or "", r[3] or "") == (domain, lang, source)]
        order = sorted((e, int(hashlib.md5(f"{mixing.SEED}:{e}:{r[0]}".encode()).hexdigest()[:15], 16), r[0], r[1]) for e in (1, 2) for r in leaf)
        for _, _, i, t in order:
            left -= len((t or "").split())
            if left < 0:
                break
            out.append((i, tuple(sp.encode(t or ""))))
    return sorted(out)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in corpus(80, 9) if r[0] is not None][:-2]
    rows = [(i, t if t is None or k % 5 else f"{t}\nmenu of the site", g, s, n) for k, (i, t, g, s, n) in enumerate(rows) if i != 4 or k == 4]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = quality.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    got = sorted((r["doc_id"], tuple(r["piece_ids"])) for r in out)
    want = plain_pipeline([r[:4] for r in rows], model)
    assert got == want and 20 < len(got) and all(r["round_trip"] for r in out)


def test_star_classes_keep_linked_sets_together():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets_ = []
    for _ in range(40):
        own = np.unique(np.concatenate([passage, rng.integers(0, 1 << 62, int(rng.integers(40, 600)), dtype=np.uint64)]))
        for _ in range(int(rng.integers(1, 4))):
            sets_.append(np.unique(np.where(rng.random(len(own)) < 0.06, rng.integers(0, 1 << 62, len(own), dtype=np.uint64), own)))
    points, sizes = np.array([jaccard_join.count_vector(x, jaccard_join.POINT) for x in sets_]), np.array([len(x) for x in sets_])
    label = jaccard_join.star_classes(points, sizes, 80, 100)
    pairs = [(i, j) for i in range(len(sets_)) for j in range(i) if jaccard_join.linked(sets_[i], sets_[j], 80, 100)]
    assert pairs and all(label[i] == label[j] for i, j in pairs)
    assert len(set(label.tolist())) > 20  # the shared passage joins no classes


def test_points_of_long_texts_fold_and_keep_their_bound():
    """Around 8 * 256 shingles points of two widths meet; the bound is never below the overlap, and linked sets stay together."""
    rng = np.random.default_rng(17)
    assert [jaccard_join.coordinates(n) for n in (0, 2048, 2049, 5000, 10**7)] == [256, 256, 512, 1024, 4096]
    sets_ = []
    for n in (1900, 2040, 4500, 40_000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets_ += [np.unique(base), np.unique(np.r_[base, rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]), np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))]
    points = [jaccard_join.count_vector(s, jaccard_join.coordinates(len(s))).astype("<u4").tobytes() for s in sets_]
    assert len({len(p) for p in points}) > 2
    for i in range(0, len(sets_), 3):
        own, near, other = sets_[i : i + 3]
        both = jaccard_join.folded(points[i : i + 3])
        assert (both.sum(1) == [len(own), len(near), len(other)]).all()
        assert np.minimum(both[0], both[1]).sum() >= len(np.intersect1d(own, near))
        label = jaccard_join.star_classes(both, both.sum(1), 80, 100)
        assert label[1] == 0
        assert label[2] == 2
