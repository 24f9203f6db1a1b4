"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import chat, common, langid, minhash, mixing, packing, pii, tokens, vectors, warc

TOKENIZER = tokens.default_tokenizer()
LONG = "word " * 60_000
TEXTS = [None, "", "   ", "\n\t x", "a", "A a", "one two three", LONG, "x" * 200_000, "İ ΑΣ ΑΣ. \x85x\xa0y", "<|endoftext|> b <|startoftext|>", "tab\tnew\x0bline\x0c end ", "\x1ca\x1fb", "naïve café — 東京 😀", "one two three"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 0, "extra") for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "s1", 0, "extra"), (3, "\n\t x", "en", "s0", 0, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length long, tokens string").repartition(3)


def _library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# Words and tokens ---------------------------------------------------------------------------------


def test_words_of_slices():
    texts = pa.array([f"Ab{i} cD \x0b{i}  E" if i % 7 else None for i in range(400)] + [" x ", ""])
    for a, b in ((0, 402), (100, 50), (399, 3)):
        part = texts.slice(a, b)
        for lower in (False, True):
            at, words, n = common.split_words(part, lower)
            want = [(t or "").encode().split() for t in part.to_pylist()]
            want = [[w.lower() for w in x] if lower else x for x in want]
            assert [words[i] for i in at] == [w for x in want for w in x] and n.tolist() == list(map(len, want))


def test_encoder_equals_library():
    rng = random.Random(4)
    alphabet = "aB'sſtéÉ́̇<|> endoftext1२\t\n\x0b\x1c\x85　😀汉ΣİıŁ-_.,"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    e = tokens.WordEncoder(TOKENIZER, limit=300)
    for a in range(0, len(texts), 100):
        ids, n = e.encode(pa.array(texts[a : a + 100]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == _library(texts[a : a + 100])


def test_word_encoder_marks_and_letters():
    """Words of any letters with marks behind them, contractions and special strings, as the library has them."""
    import random

    rng, alphabet = random.Random(7), "abZÉßİΣς'\"*%$#<>|-_.,!?0９Ⅷ²éñ\u0338\u0301ﬁǅ東あ\u200d😀KΩʹ \t\n\x85"
    e = tokens.WordEncoder(TOKENIZER, limit=300)
    assert e.by_word
    for _ in range(20):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(100)] + ["ab<|startoftext|> x<|endoftext|>* \r\n", None, ""]
        ids, n = e.encode(pa.array(texts))
        want = _library(texts)
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    docs_ = [rng.integers(2, 40, rng.integers(0, 300)) for _ in range(200)]
    ids = np.concatenate([np.append(d, 1) for d in docs_]).astype(np.uint32)
    blob = tokens.pack_shard(list(range(200)), ids, np.array([len(d) + 1 for d in docs_]), 49408, 1)
    s = tokens.Shard(blob)
    assert (s.all_ids() == ids).all() and len(s.rules) and len(s.symbols) < len(ids)
    assert all((s.ids(k) == np.append(d, 1)).all() for k, d in enumerate(docs_))
    assert (tokens.rule_lengths(s.rules, 49408)[49408:] == s.lengths).all()
    rng = np.random.default_rng(4)
    for a, b in np.sort(rng.integers(0, len(ids) + 1, (200, 2)), axis=1).tolist() + [[0, 0], [0, 1], [len(ids) - 1, len(ids)]]:
        assert (s.range(a, b) == ids[a:b]).all() and len(s.range(a, b)) == b - a
    pairs = {}  # no pair that may be replaced occurs 16 times any more
    closes = np.zeros(49408 + len(s.rules), bool)
    closes[1] = True
    for i, (_, y) in enumerate(s.rules):
        closes[49408 + i] = closes[y]
    for i, (x, y) in enumerate(zip(s.symbols[:-1].tolist(), s.symbols[1:].tolist())):
        pairs[x, y] = pairs.get((x, y), 0) + (not closes[x])
    assert max(pairs.values()) < 16
    with pytest.raises(ValueError):
        tokens.Shard(b"x" * 100)


@pytest.mark.parametrize("end", [1, 5])
def test_repair_of_runs(end):
    """Runs of one id, documents of one id, an empty sequence and repeated documents."""
    for ids in ([], [end], [end] * 50, [7] * 99 + [end], ([3, 4, 5, 6] * 20 + [end]) * 30, [2, end] * 40):
        ids = np.array(ids, np.uint32)
        n = np.diff(np.flatnonzero(ids == end), prepend=-1) if end not in (3, 4, 5, 6) else np.array([len(ids)] if len(ids) else [], int)
        s = tokens.Shard(tokens.pack_shard(list(range(len(n))), ids, n, 10, end))
        assert (s.all_ids() == ids).all() and (tokens.rule_lengths(s.rules, 10)[10:] == s.lengths).all()


def test_any_tokenizer(spark):
    """A tokenizer that the word table does not suit encodes whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["Ab cD  ef", None, "", "x" * 3000, "é 東京\n\ny"]
    ids, n = tokens.encoder_for(path).encode(pa.array(texts))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want)) and tokens.encoder_for(TOKENIZER).by_word
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokens.read_token_shards(tokens.write_token_shards(df, path, 50256)).collect()}
    assert got == {i: w + [50256] for i, w in enumerate(want)}


def test_token_shards(spark, docs):
    shards = tokens.write_token_shards(docs, shard_tokens=1000)
    got = tokens.read_token_shards(shards).collect()
    assert sorted((r["start"], r["ids_crc32"]) for r in tokens.read_token_shards(shards, digest=True).collect()) == sorted((r["start"], zlib.crc32(r["ids"])) for r in got)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = [i + [1] for i in _library([t for _, t in rows])]
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0] + list(map(len, want)))[:-1].tolist()
    assert tokens.read_token_shards(tokens.write_token_shards(docs.where("false"))).count() == 0


# WARC ---------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    html = {1: "a" * 100, 2: "a" * 100, 3: "b" * 99, 4: "b" * 99, 5: None, 6: "", 7: fake * 40, 8: "é" * 70, 9: "é" * 70, 10: "x\r\n\r\n" * 30, 11: "WARC/1.0\r\n" * 500, 12: "z" * 50_000}
    rows = [(k, None if k == 4 else f"http://h/\r\n{k}" + "/long" * 500_000 * (k == 5), h, 1) for k, h in html.items()] + [(None, "u", "a" * 100, 1), (7, "u", fake * 40, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(2)
    warc.write_archives(df, f"file://{tmp_path}/w")
    for chunk in (20_000, 1 << 20):
        got = warc.read_archives(spark, f"file://{tmp_path}/w", chunk).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r["page_id"], []).append(r)
        assert {k: by[k][0]["refers_to"] for k in html if by[k][0]["record_type"] == "revisit"} == {2: 1, 9: 8}
        assert all(bytes(by[k][0]["payload"]).decode() == (h or "") for k, h in html.items() if k not in (2, 9))
        assert by[2][0]["payload_length"] == 100 and by[2][0]["payload_digest"] == hashlib.sha256(b"a" * 100).hexdigest()
        assert by[None][0]["record_type"] == "response" and [r["record_type"] for r in by[7]] == ["response"] * 2
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    part.write_bytes(part.read_bytes()[:-60])
    with pytest.raises(ValueError):
        warc.read_archives(spark, f"file://{tmp_path}/w").count()
    warc.write_archives(df.where("false"), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


# Chat ---------------------------------------------------------------------------------------------


def test_chat_strings():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "", "[/INST]", "␛"]), "".join(rng.choice(["</s>", "<s>", "[INST]", " [/INST]", "␛", "␛1", "<", "/s>", "x", "\n", "é"]) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text.encode()[a:b].decode()) for a, b in spans] == [t for _, t in turns]


def test_chat(spark):
    rows = [(1, 2, "assistant", "</s>[INST] x"), (1, 1, "user", "hi"), (1, 3, None, None), (2, None, "assistant", "é😀 " * 50), (2, 1, "assistant", ""), (None, 1, "assistant", "t"), (1, 2, "assistant", "</s>[INST] x"), (3, 0, "assistant", "long " * 20_000)]
    # columns that clash with those of the result
    df = spark.createDataFrame([(*r, 7, "x", [1]) for r in rows], "conv_id long, turn long, role string, text string, loss_mask int, formatted string, turns array<int>")
    made = chat.format_conversations(df)
    out = {r["conv_id"]: r for r in made.collect()}
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(out) == set(back) == {1, 2, 3, None}
    assert chat.parse(out[1]["formatted"]) == [("user", "hi"), ("assistant", "</s>[INST] x"), ("assistant", "</s>[INST] x"), ("", "")]
    assert list(zip(back[1]["roles"], back[1]["texts"])) == chat.parse(out[1]["formatted"])
    assert back[1]["loss_text"] == "</s>[INST] x" * 2 and back[2]["loss_text"] == "é😀 " * 50 and back[3]["loss_text"] == "long " * 20_000
    assert all(len(r["input_ids"]) == len(r["loss_mask"]) == len(r["token_ends"]) and r["token_ends"][-1] == len(r["formatted"].encode()) for r in out.values())
    for r in out.values():  # the library's own offsets, in characters
        want = chat._tokenizer(chat.default_tokenizer()).tokenizer.encode(r["formatted"], add_special_tokens=False)
        assert want.ids == r["input_ids"]
        spans, at = list(zip(r["span_starts"], r["span_ends"])), 0
        for end, on in zip(r["token_ends"], r["loss_mask"]):
            assert on == any(a <= at and end <= b for a, b in spans)
            at = end
    assert chat.format_conversations(df.where("false")).count() == 0 and chat.read_back(made.where("false")).count() == 0


def test_chat_query(spark, tmp_path):
    """The whole query against its SQL, on texts with control strings, escapes and nulls."""
    import duckdb

    rng = random.Random(4)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "␛", "␛1", "word ", "é😀", "\n", " "]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", None]), None if i % 11 == 0 else "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(120)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op2_chat_format(spark, str(tmp_path)).toPandas().sort_values("conv_id").reset_index(drop=True)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(chat.SQL).df().sort_values("conv_id").reset_index(drop=True)[list(got.columns)]
    assert len(got) == 41 and (got.astype(str) == want.astype(str)).all().all()


# Near duplicates ----------------------------------------------------------------------------------


def _sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def _components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies(seed=3, groups=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(3000)]
    texts = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(words)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    texts = near_copies() + TEXTS + ["one two", "One  two"]
    ids = [10 * i + 3 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)] + [(None, texts[0], "x", "y")], "doc_id long, text string, n string, sig string").repartition(3)
    out = minhash.near_duplicates(df, k=k).collect()
    sets = dict(zip(ids, _sets(texts, k)))
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _components(ids, linked)
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(ids) + 1 and got[None]["component_id"] is None
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i in ids)
    assert minhash.near_duplicates(df.where("false"), k=k).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """Pairs at a similarity of 0.816 among 600 variants of one text that are 0.66 similar to each other."""
    rng = random.Random(5)
    base, texts = [f"b{i}" for i in range(80)], []
    for i in range(570):
        at = rng.sample(range(1, 79, 3), 4)
        texts.append([f"v{i}x{j}" if j in at else w for j, w in enumerate(base)])
        if i < 30:
            other = [j for j in range(1, 79, 3) if j not in at]
            there = at[:2] + rng.sample(other, 2)
            texts.append([texts[-1][j] if j in at[:2] else f"u{i}x{j}" if j in there else w for j, w in enumerate(base)])
    texts = [" ".join(x) for x in texts]
    ids = rng.sample(range(10_000), len(texts))
    sets = _sets(texts, 2)
    want = _components(ids, [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    out = minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long"), "a", "b").collect()}
    ids = {x for e in edges for x in e}
    want = _components(ids, edges)
    assert all(got.get(i, i) == want[i] for i in ids)
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# Language -----------------------------------------------------------------------------------------


def test_gradients():
    m = langid.BiGRU(["a", "b", "c"], 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    codes, label = rng.integers(0, 4, (6, 5)), rng.integers(0, 3, 5)
    _, grad = m.gradients(codes, label)
    for name in ("xf", "ub", "cf", "ib", "o", "q"):
        at = tuple(0 for _ in m.p[name].shape)
        old, e = m.p[name][at], 1e-2
        m.p[name][at] = old + e
        up = m.gradients(codes, label)[0]
        m.p[name][at] = old - e
        down = m.gradients(codes, label)[0]
        m.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_forward_pass():
    """The batched, windowed prediction against a plain loop over single bytes."""
    m = langid.BiGRU(["a", "b", "c"], 4)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc é東 ") for _ in range(n)) for n in (1, 5, 127, 128, 129, 400)]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(codes, d):
        h, s, out = m.hidden, np.zeros(m.hidden), []
        for c in codes:
            x = m.p[f"x{d}"][c].astype(float) + m.p[f"i{d}"]
            g = s @ m.p[f"u{d}"]
            z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h:])
            s = (1 - z) * s + z * np.tanh(x[2 * h :] + (r * s) @ m.p[f"c{d}"])
            out.append(s)
        return np.array(out)

    def pooled(text):
        data, total = text.encode(), np.zeros(3)
        for a in range(0, len(data), langid.WINDOW):
            codes = list(data[a : a + langid.WINDOW])
            padded = codes + [0] * (langid.WINDOW - len(codes))
            both = np.concatenate([states(padded, "f"), states(padded[::-1], "b")[::-1]], 1)
            e = np.exp(both @ m.p["o"] + m.p["q"])
            total += (e / e.sum(1, keepdims=True))[: len(codes)].sum(0)
        return total / len(data)

    lang, score = langid.predict(m, texts)
    for t, k, v in zip(texts, lang, score):
        p = pooled(t)
        assert (k == "und") == (not any(map(str.isalpha, t))) and (k == "und" or (m.languages[p.argmax()] == k and v == pytest.approx(p.max(), abs=1e-5)))


def test_language(spark, docs):
    rng = random.Random(2)
    make = lambda words: " ".join(rng.choices(words, k=60))
    words = {"en": "the of and to in that was with thing".split(), "de": "der die und ich nicht ein schön für über".split()}
    rows = [(i, make(words[k]), k) for i, k in enumerate(["en", "de"] * 150)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train, sample=200, steps=120)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    got = {r["doc_id"]: r for r in langid.identify(train, model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.95
    clash = langid.identify(docs.selectExpr("*", "'old' as lang_pred", "5 as score", "1 as row"), model)
    assert clash.columns == [*docs.columns, "row", "lang_pred", "score"] and clash.where("lang_pred = 'old' or score = 5 or row != 1").count() == 0
    out = langid.identify(docs, model).collect()
    assert len(out) == docs.count() and set(out[0].asDict()) == {*docs.columns, "lang_pred", "score"}
    for r in out:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(map(str.isalpha, r["text"]))) and 0 <= r["score"] <= 1
    assert langid.train(train.where("false")).languages == ["und"] and langid.identify(docs.where("false"), model).count() == 0


# Vectors ------------------------------------------------------------------------------------------


def _vectors(spark, n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[100:140] = x[100] + rng.normal(size=(40, dim)) * 0.05
    x[200:260] = x[200]
    x[300] = x[301] * 3
    rows = [(i, v.tolist(), int(i % 3) if not 100 <= i < 260 else 1) for i, v in enumerate(x)]
    bad = [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [float("inf")] * dim, 1), (n + 5, [1.0], 1), (n + 6, x[0].tolist(), None), (None, x[0].tolist(), 0), (n + 7, [], 1)]
    return x, rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").repartition(3)


def test_search(spark):
    x, rows, df = _vectors(spark)
    out = vectors.search(df, df.where("vec_id % 10 = 0"), recall=0.99, centroids=6, sample=400).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d0 = np.vstack([d, d[:1]])  # row n + 6 repeats row 0's vector
    hits = total = 0
    for q in range(0, 600, 10):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        full = np.append(d0[:600, q], d0[600, q])
        ids = np.append(np.arange(600), 606)
        best = [int(ids[i]) for i in np.lexsort((ids, full)) if ids[i] != q][:10]
        hits += len({v for _, v, _ in got} & set(best))
        total += 10
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(s == pytest.approx(full[v if v < 600 else 600]) for _, v, s in got)
        assert all(a[2] < b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got, got[1:]))
    assert hits / total >= 0.9
    few = df.where("vec_id < 4")
    assert vectors.search(few, few).groupBy("query_id").count().collect() == [r for r in vectors.search(few, few).groupBy("query_id").count().collect() if r["count"] == 3]
    assert vectors.search(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("more", [{}, {"shard_rows": 40, "part_rows": 30}, {"shard_rows": 20, "spread": 0.0}])
def test_near_vectors(spark, more):
    x, rows, df = _vectors(spark)
    df = df.selectExpr("*", "1 as id", "'x' as rows", "2 as shard", "5 as _row", "3 as n_links")
    out = vectors.near_vectors(df, **more).collect()
    assert {r["audit_recall"] for r in out} == {1.0}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    close = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    want = _components(range(600), [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    got = {r["vec_id"]: r for r in out}
    assert len(out) == len(rows) + 9
    assert all(got[i]["n_links"] == close[i].sum() and got[i]["component_id"] == want[i] for i in range(600))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(600, 608))
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_near_vectors_across_shards(spark):
    """A pair on the two sides of a shard boundary counts for both ends, without help from the audit."""
    def ray(degrees, k):
        v = np.zeros(8)
        v[:2] = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        v[2 + k % 6] = 1e-3 * k
        return (v / np.linalg.norm(v)).tolist()

    rows = [(k, ray(90 * (k % 2), k)) for k in range(80)] + [(100, ray(35, 0)), (101, ray(45.5, 0)), (102, ray(55, 0)), (103, ray(44.5, 0))]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v in rows])
    close = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, shard_rows=30, audit=0).collect()}
    assert [got[i] for i, _ in rows] == close.sum(1).tolist() and close[80, 81] and close[82, 83]


def test_flat_graph():
    """Pruned graphs against all distances: nothing within the radius is lost, and searches arrive from the
    medoid among clustered vectors."""
    rng = np.random.default_rng(2)
    for crowd in (0.02, 0.3):
        x = vectors._unit(np.repeat(rng.normal(size=(20, 16)), 15, 0) + rng.normal(size=(300, 16)) * crowd)
        graph = vectors.as_matrix(vectors.robust_prune(x, 0.4), len(x))
        got = {(int(a), int(b)) for part in vectors.range_search(x, x, graph, 0.2, np.arange(len(x)), 37) for a, b in zip(part[0], part[1])}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.2))}
        at, far = vectors.walk(x, x, graph, int(((x - x.mean(0)) ** 2).sum(1).argmin()))
        assert np.allclose(((x - x[at]) ** 2).sum(1), far) and (far < 1e-12).mean() > 0.5
    assert len(vectors.robust_prune(np.ones((1, 3)), 0.4)) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_recall(spark):
    """The whole query on a whole test table against a full scan."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    ids, x = ids[np.abs(x).sum(1) > 0], x[np.abs(x).sum(1) > 0]
    got = {}
    for r in vectors.op5_multi_index(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(d[ids == v][0]) for v, s in got[q].items())
        hits.append(np.isin(ids[best], list(got[q])).mean())
    assert np.mean(hits) >= 0.9


def test_repeated_vectors(spark):
    """Rows that share a vec_id are one node, and take one rank of a query at most."""
    rows = [(i % 40, [float(i % 40), 1.0, float(i % 7)], 1) for i in range(80)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, query_id string")
    assert vectors.near_vectors(df).count() == 80
    out = vectors.search(df, df.where("vec_id < 3")).collect()
    assert {r["query_id"] for r in out} == {0, 1, 2} and all(len({r["vec_id"] for r in out if r["query_id"] == q}) == 10 == sum(r["query_id"] == q for r in out) for q in range(3))


# Personal data ------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(9)
    pieces = ["a.b@c.d", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456", "+1", " ", "é😀", "0", "12", "_d@e.f", "-", "999", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "1" * 30_000, "a" * 60_000, "1." * 20_000, "a@b.c" * 300, "1-" * 20_000 + "2", "a.b@c.d " + "word " * 30_000 + "1.2.3.4"]
    # columns with the names of inner ones stay, one of the output's name is replaced
    df = spark.createDataFrame([(i, t, "x", 5, "y", "z") for i, t in enumerate(texts)], "doc_id long, text string, t string, row int, spans string, pii string")
    for r in pii.find_pii(df).collect():
        assert (r["t"], r["row"], r["spans"]) == ("x", 5, "y")
        t = r["text"] or ""
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in PLAIN] == _base(t), t[:200]
        assert all(t[s["start"] : s["end"]] == s["text"] and 0 < s["score"] <= 1 for s in r["pii"])
    one = pii.find_pii(spark.createDataFrame([("my bank iban DE89 3704 0044 0532 0130 00 ok", 1), ("DE89 3704 0044 0532 0130 01", 2)], "text string, i int")).orderBy("i").collect()
    assert [s["kind"] for s in one[0]["pii"] if s["kind"] == "iban"] == ["iban"] and not [s for s in one[1]["pii"] if s["kind"] == "iban"]
    red = pii.find_pii(spark.createDataFrame([("é mail a@b.c and 1.2.3.4!",)], "text string")).select(pii.redact(F.col("text"), F.col("pii"))).first()[0]
    assert red == "é mail <EMAIL> and <IP>!"
    got = {s["text"]: s["score"] for s in pii.find_pii(spark.createDataFrame([("Mail: a@b.c, then " + "x" * 50 + " d@e.f; CALL +49 30 123456",)], "text string")).first()["pii"]}
    assert got == {"a@b.c": 0.9, "d@e.f": 0.8, "+49 30 123456": 0.75}
    assert pii.find_pii(df.where("false")).count() == 0


def test_pii_of_many_matches(spark):
    """Time goes with the matches, not with their square, and redaction keeps the rest."""
    import time

    took, piece = [], "é to a@b.co, 10.0.0.1 "
    for n in (2_000, 32_000):
        df = spark.createDataFrame([(piece * n,)], "text string")
        start = time.time()
        r = pii.find_pii(df).select(F.size("pii").alias("n"), F.col("pii")[2 * n - 1]["end"].alias("end"), pii.redact(F.col("text"), F.col("pii")).alias("red")).first()
        took.append(time.time() - start)
        assert r["n"] == 2 * n and r["end"] == len(piece) * n - 1 and r["red"] == "é to <EMAIL>, <IP> " * n
    assert took[1] < 16 * 4 * max(took[0], 0.5)


def test_iban_before_other_words(spark):
    """An IBAN followed by capitals or numbers, or that begins inside another proposal, is found whole."""
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    cases = [
        ("DE89370400440532013000 EUR 50", ["DE89370400440532013000"]), ("x DE89370400440532013000 2024 paid", ["DE89370400440532013000"]),
        (f"{german} I paid", [german]), (f"é😀 {german} BIC COBADEFFXXX", [german]), (f"{german} {british} {german}", [german, british, german]),
        (f"AB12 3456 {british} 7", [british]), (f"DE12 3456 {german} EUR", [german]), (german[:-1] + "1 EUR", []), ("DE89370400440532013000EUR", []),
        (f"{german}", [german]), (british + " OK" * 5000, [british]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    for r in pii.find_pii(df).withColumn("red", pii.redact(F.col("text"), F.col("pii"))).collect():
        found = [s for s in r["pii"] if s["kind"] == "iban"]
        assert [s["text"] for s in found] == cases[r["i"]][1], r["text"][:80]
        assert all(r["text"][s["start"] : s["end"]] == s["text"] for s in found) and not any(x in r["red"] for x in cases[r["i"]][1])


# Mixing and packing -------------------------------------------------------------------------------


def _brute_exponent(totals, target, limit):
    """The exponent by a fine scan instead of bisection, with weights of its own."""
    live = [n for n in totals if n]
    best = None
    for i in range(200_000, -1, -1):
        x = i / 200_000
        raw = np.array(live, float) ** x
        w = raw / raw.sum()
        rates = w / np.array(live)
        if target is not None and -(w * np.log(w)).sum() < target * np.log(len(live)) - 1e-12:
            continue
        best = x
        break
    best = 0.0 if target is None else best
    while rates_ratio(live, best) > limit:
        best += 1 / 200_000
    return best


def rates_ratio(live, x):
    rates = np.array(live, float) ** (x - 1)
    return rates.max() / rates.min()


@pytest.mark.parametrize("target, limit", [(0.9, 1e9), (1.0, 3.0), (None, 2.0), (0.5, 1.5)])
def test_exponent(target, limit):
    totals = {900: 1, 90: 2, 10: 1, 0: 1}
    x = mixing.find_exponent(totals, target, limit)
    assert x == pytest.approx(_brute_exponent([900, 90, 90, 10], target, limit), abs=2e-5)
    assert mixing.find_exponent({5: 1}, 0.5, 2.0) == 1.0 and mixing.find_exponent({}, 0.5, 2.0) == 1.0


def test_mix(spark, docs):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), "big" if i % 10 else rng.choice(["x", "y"]), i, "a", 3) for i in range(800)]
    # columns that clash with added and inner ones
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight long, u string, v int")
    n = {i: len(t.split()) for i, t, *_ in rows}
    total = {}
    for i, _, s, *_ in rows:
        total[s] = total.get(s, 0) + n[i]
    x = _brute_exponent(list(total.values()), None, 2.0)
    weight = {s: k**x / sum(m**x for m in total.values()) for s, k in total.items()}
    budget = max(k / weight[s] for s, k in total.items())
    out = mixing.mix(df, repeat_limit=2.0, block_tokens=2000).collect()
    drawn, filled = {}, {}
    for r in out:
        assert r["tokens"] == n[r["doc_id"]] and r["copies"] >= 1 and len(r["blocks"]) == r["copies"] and (r["u"], r["v"]) == ("a", 3)
        assert r["weight"] == pytest.approx(weight[r["source"]], abs=1e-4)
        drawn[r["source"]] = drawn.get(r["source"], 0) + r["tokens"] * r["copies"]
        for b in r["blocks"]:
            filled.setdefault(b, {}).setdefault(r["source"], []).append(r["tokens"])
    assert len(out) == 800 and all(-2 <= drawn[s] - weight[s] * budget <= 70 for s in total)
    assert set(filled) == set(range(-(-round(budget) // 2000)))
    for parts in filled.values():  # each block about full, with a hash for the order
        assert sum(map(sum, parts.values())) == pytest.approx(budget / len(filled), rel=0.3)
    twice = [r["blocks"] for r in out if r["copies"] == 2]
    assert twice and len({b[1] - b[0] for b in twice}) > 2 and all(a <= b for a, b in twice)  # epochs differ in order
    half = mixing.mix(df, repeat_limit=2.0, budget=round(budget) // 2, block_tokens=500).collect()
    assert {r["copies"] for r in half} <= {0, 1} and abs(sum(r["tokens"] * r["copies"] for r in half) - budget / 2) < 130
    assert all(len(r["blocks"]) == r["copies"] for r in half)
    edge = mixing.mix(docs).collect()
    assert len(edge) == docs.count() and all(r["copies"] >= 1 for r in edge)
    assert mixing.mix(docs.where("false")).count() == 0
    made = mixing.draw(mixing.mix(df, block_tokens=2000), ["doc_id"], "block")
    assert sorted((r["doc_id"], r["block"]) for r in made.collect()) == sorted((r["doc_id"], b) for r in out for b in r["blocks"])
    assert mixing.draw(mixing.mix(df), ["doc_id"]).columns == ["doc_id"]


def test_many_sources(spark):
    """More sources than rows of any other test: no limit on their number."""
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 5 as int)) as text", "cast(id as string) as source")
    assert mixing.mix(df).where("copies >= 1 and size(blocks) = copies").count() == 3000


def _check_bins(rows, cap):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap.tokens and len(parts) <= cap.documents and sum(n * n for _, n in parts) <= cap.attention
    return len(bins)


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(100, 3, 6000)])
@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_packing(spark, cap, rule):
    rng = np.random.default_rng(1)
    top = min(cap.tokens, int(cap.attention**0.5))
    sizes = np.concatenate([rng.integers(1, top + 1, 700), np.full(300, top // 3), [1] * 50, [top] * 5]).tolist()
    # names of inner and of added columns
    df = spark.createDataFrame([(i, 0, int(n), "x", 7, "k", 8, 9) for i, n in enumerate(sizes)], "doc_id long, piece int, length long, rank string, salt int, key string, offset int, run int")
    out = packing.pack(df, cap, rule=rule, group_rows=100).collect()
    assert len(out) == len(sizes) and all((r["rank"], r["salt"], r["key"], r["run"]) == ("x", 7, "k", 9) for r in out)
    again = packing.pack(df.union(df).withColumn("piece", F.lit(None).cast("int")), cap, rule=rule, group_rows=100).collect()
    assert len(again) == 2 * len(sizes) and _check_bins(again, cap)
    assert packing.pack(df.where("false"), cap).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("length", F.lit(None).cast("long")), cap)
    used = _check_bins(out, cap)
    assert used <= 1.25 * max(sum(sizes) / cap.tokens, len(sizes) / cap.documents, sum(n * n for n in sizes) / cap.attention) + 60
    with pytest.raises(ValueError):
        packing.plan_packing({cap.tokens + 1: 1}, cap)


def test_pack_documents(spark, docs):
    out = packing.pack_documents(docs, "test-pieces").collect()
    _check_bins(out, packing.Capacity())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = sorted((-1 if d is None else d, k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for (d, _), ids in zip(rows, _library([t for _, t in rows])) for k, p in enumerate([(ids + [0])[a : a + 2048] for a in range(0, len(ids) + 1, 2048)]))
    assert got == want
    assert packing.pack_documents(docs.where("false"), "test-pieces").count() == 0


# Pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    """run() against brute force: rejected languages, groups of copies, redaction, draws, bins."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    words = "der the und and les des que los with eine house".split()
    base = [" ".join(rng.choices(words, k=80)) + f" n{i} m{i}" for i in range(60)]
    texts = base + base[:10] + ["12 34 !!", "", None, "mail a@b.co now " + base[0][::-1]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language ID", "MinHash near-dedup", "PII", "mixing sources to target weights", "best-fit packing"]
    kept = docs
    for _, stage in cp.STAGES[:-1]:
        kept = common.store(stage(spark, kept, str(tmp_path)), "test-stage")
        assert kept.columns == docs.columns
    sets = _sets(base, 5)
    near = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {i for i, r in _components(range(60), near).items() if i == r} | {73}
    got = {r["doc_id"]: r for r in kept.collect()}
    assert set(got) == want and "<EMAIL>" in got[73]["text"] and "a@b.co" not in got[73]["text"]
    out = cp.run(spark, str(tmp_path)).collect()
    _check_bins(out, packing.Capacity())
    assert {r["doc_id"] for r in out} == want and len(out) == kept.count()


def test_pipeline_edges(spark, tmp_path):
    """Tables that are empty, have no label, repeat rows, hold nulls in every column or a very long text."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int, row string"
    word = lambda i: " ".join(f"w{(i * 31 + j * j) % 997}x{i}" for j in range(40))
    plain = [(i, word(i), "en", "s", 9, 1, "r") for i in range(12)]
    odd = plain + [plain[3], plain[3], (50, word(3), None, None, None, None, None), (None, word(4), None, "s", 1, 1, None), (None, word(4), "en", "t", 1, 1, None), (51, None, "en", "s", 0, 1, ""), (52, "", None, None, 0, 1, ""), (53, "long " * 60_000 + "a@b.co", "de", "t", 5, 1, "")]
    cases = {"empty": [], "plain": plain, "unlabelled": [(*r[:2], None, *r[3:]) for r in plain], "odd": odd}
    for name, rows in cases.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        kept = docs
        for k, (_, stage) in enumerate(cp.STAGES[:-1]):
            kept = common.store(stage(spark, kept, f"{tmp_path}/{name}"), "test-stage")
            assert kept.columns == cp.COLUMNS
            if k == 1:
                once = kept
        texts = {r["doc_id"]: r["text"] for r in kept.collect()}
        out = cp.run(spark, f"{tmp_path}/{name}").collect()
        _check_bins(out, packing.Capacity())
        if name == "empty":
            assert not out and not texts
        elif name == "odd":  # repeated rows once, the copy with the larger id, and texts without letters gone
            assert set(texts) == {*range(12), None, 53} and once.where("doc_id = 3").count() == 1 and once.where("doc_id is null").count() == 2
            assert texts[53] == "long " * 60_000 + "<EMAIL>" and {r["doc_id"] for r in out} == set(texts)
        else:
            assert {r["doc_id"] for r in out} == set(range(12)) == set(texts)
        if name == "unlabelled":
            assert kept.where("lang is not null").count() == 0
