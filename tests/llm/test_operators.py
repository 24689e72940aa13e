"""Small fixtures against brute force, round trips, and edge cases of each operator."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import components, decontamination, embedding_join, encoding, language_id, packing, quality, shared, sharding, similar, simhash, substring_dedup, token_records, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, score double, extra string"


def docs(spark, texts):
    """Rows with extra columns, one of them named like an output."""
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "a <|endoftext|> b", "\n\n", "...", "one", "one", (None, "one"), (5, "one"), "a b c " * 3000, "é" * 50, "日本 語", "x" * 5000]


# --- shared

def test_materialize_and_release(spark):
    df = shared.materialize(spark.range(5), "t")
    assert df.count() == 5 and shared.shared_base(spark).startswith("file:/")
    shared.release(df)


@pytest.mark.parametrize("most", [0, 200_000])
def test_joins_by_hot_keys(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) as g")
    keys = rows.groupBy(F.col("g").alias("k")).agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out, table = shared.join_keys(rows, keys, "g", keys.count())
    assert out.columns == ["id", "g", "least"] and (table is None) == (most > 0)
    assert sorted(map(tuple, out.collect())) == [(i, 7, 0) if i % 3 == 0 else (i, i, 0 if i == 7 else i) for i in range(3000)]
    if table is not None:  # only the key of a third of the rows is broadcast
        hot = table.where(F.col("n") > 3000 / int(spark.conf.get("spark.sql.shuffle.partitions")))
        assert [r.k for r in hot.collect()] == [7]


@pytest.mark.parametrize("most", [0, 200_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    rows = [*pairs, (None, 1), (2, None)]
    got = {r.node: r.component_id for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 language ID

def test_language(spark):
    words = {"en": ["the", "thing", "order", "within", "other"], "de": ["und", "nicht", "über", "schön", "ein"], "xx": ["qua", "zop", "kri", "vex", "jum"]}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[k], k=60)), k, 0.1, "x") for i, k in enumerate(list(words) * 20)]
    table = spark.createDataFrame(rows, DOCS)
    found = language_id.fit(table)
    assert set(found) == set(words)
    out = language_id.identify(table, found)
    assert out.where("lang_pred <> lang").count() == 0 and out.where("rejected").count() == 0
    assert out.columns.count("score") == 1 and "extra" in out.columns
    odd = language_id.identify(docs(spark, [*ODD, "12 34"]), found).collect()
    for r in odd:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    empty = language_id.fit(table.where("lang is null"))
    assert empty == {} and language_id.identify(table, empty).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(table.limit(0), found).count() == 0


def code_lengths(text, dictionaries):
    """Bytes of a whole text under each dictionary, compressed block by block with contexts of their own."""
    import zstandard as z

    code = " ".join("".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.lower()).split()).encode()
    out = {}
    for k, d in dictionaries.items():
        window = max(18, (max(map(len, dictionaries.values())) + 8192).bit_length())
        params = z.ZstdCompressionParameters(window_log=window, chain_log=16, hash_log=17, search_log=3, min_match=4, target_length=8, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        pad = bytes(range(1, 49))
        content = z.ZstdCompressionDict(d + pad, dict_type=z.DICT_TYPE_RAWCONTENT)
        parts = [z.ZstdCompressor(dict_data=content, compression_params=params).compress(pad + code[i : i + 4096]) for i in range(0, len(code), 4096)]
        undo = z.ZstdDecompressor(dict_data=content, max_window_size=1 << 27)
        assert b"".join(undo.decompress(p, max_output_size=1 << 20)[48:] for p in parts) == code
        out[k] = sum(map(len, parts))
    return out


@pytest.mark.parametrize("languages", [2, 64])
def test_language_is_that_of_the_shortest_code(spark, monkeypatch, languages):
    """Against code lengths made anew, from dictionaries of whole texts, in one block and in several."""
    monkeypatch.setattr(language_id, "LANGUAGES", languages)
    rng = random.Random(21)
    vocabulary = {k: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(60)] for k in ("aa", "bb", "cc", "dd", "ee")}
    vocabulary["ff"] = vocabulary["aa"][:30] + vocabulary["bb"][:30]
    rows = [(i, " ".join(rng.choices(vocabulary[k], k=rng.choice([3, 40, 900, 3000]))), k, 0.0, "x") for i, k in enumerate([*vocabulary, "aa"] * 6)]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    found = language_id.fit(table)
    assert len(found.files) == (2 if languages == 2 else 0)
    dictionaries = {k: d for block in found.blocks() for k, d in block.items()}
    for k, d in dictionaries.items():  # made of whole texts: at most one a slot, and of nothing else
        left = d
        for t in sorted((t for _, t, lang, *_ in rows if lang == k), key=len, reverse=True):
            left = left.replace(language_id.canonical(t) + b" ", b"", 1)
        assert left == b"" and len(d) > 5000
    assert list(dictionaries)[0] == "aa" and sorted(dictionaries) == sorted(vocabulary)
    tests = [r[1] for r in rows[:12]] + [" ".join(rng.choices(vocabulary["aa"] + vocabulary["cc"], k=50)), "zz yy", "a"]
    for r in language_id.identify(docs(spark, tests), found).collect():
        want = code_lengths(r.text, dictionaries)
        sizes = sorted(want.values())
        assert r.lang_pred == min(want, key=want.__getitem__) and r.margin == sizes[1] - sizes[0]
        assert r.rejected == (r.margin < max(language_id.MIN_BYTES, language_id.MIN_SHARE * sizes[0]))


def test_language_held_out(spark, sf):
    out = language_id.op1_language_id(spark, sf)
    held = out.where("held_out").join(shared.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95 and out.count() == shared.table(spark, sf, "documents").count()


# --- encoding

def library(path):
    """A tokenizer as the library loads it, shared with no code under test."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_is_exact(path):
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "é", "é", "́", "1", "23", "'s", "'", "!", "..", "İ", "Σ", "　", "\x85", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "日本", "</w>", "\r\n", "THE", "über", "ß.", "a,b|c", "\n\n", "%%%", "And\nÉa."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    texts += [f"{a}{t}{b}" for t in ("<|endoftext|>", "<|startoftext|>") for a in ("", " ", "hello ", "x", "\n") for b in ("", " ", " world", "x", t)]
    enc, lib = encoding.Encoder(path), library(path)
    for _ in range(2):
        got = enc.encode([None, *texts])
        want = [np.array(e.ids, enc.dtype).tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert got == [b"", *want]
    assert lib.token_to_id("<|endoftext|>") in np.frombuffer(enc.encode(["hello <|endoftext|> world"])[0], enc.dtype)


# --- 2 token records

def ids_of(path, text):
    return np.array([*library(path).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_frames():
    raw = token_records.frame(b"abc") + token_records.frame(b"")
    first, at = token_records.unframe(raw)
    assert (first, token_records.unframe(raw, at)[0]) == (b"abc", b"")
    for i in range(len(raw)):
        broken = raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :]
        with pytest.raises(ValueError):
            _, at = token_records.unframe(broken)
            token_records.unframe(broken, at)
    assert token_records.unpack(token_records.pack(None, b"\x01\x00", False))[0] is None
    assert token_records.unpack(token_records.pack(-7, b"\x01\x00\x00\x00", True))[1].tolist() == [1]


@pytest.mark.parametrize("roll", [64, 1 << 20])
def test_token_records(spark, roll):
    texts = [*ODD[:8], "a word " * 40, "last"]
    table = docs(spark, texts)
    out = token_records.read(token_records.write(table, BYTE, shared.shared_path(spark, "tok"), roll_bytes=roll)).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.doc_id) for r in table.collect()))
    at = 0
    for r, (_, _, _, text, doc) in zip(sorted(out, key=lambda r: r.start), rows, strict=True):
        ids = ids_of(BYTE, text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_records.read(token_records.write(table.limit(0), BYTE, shared.shared_path(spark, "tok"))).count() == 0


@pytest.mark.parametrize("roll", [64, 1 << 20])
def test_token_records_in_any_order(spark, roll):
    texts = [f"{i} " * (i % 7) for i in range(60)]
    manifest = token_records.write(docs(spark, texts), BYTE, shared.shared_path(spark, "tok"), roll_bytes=roll)
    order = [int(x) for x in np.random.default_rng(3).permutation(60)] + [5, 5, None]
    out = token_records.fetch(manifest, spark.createDataFrame([(n,) for n in order], "number long").coalesce(1)).collect()
    assert [(r.number, r.doc_id) for r in out] == [(n, n) for n in order]
    assert all(r.ids is None if r.number is None else r.ids == ids_of(BYTE, texts[r.number]).tolist() for r in out)
    with pytest.raises(Exception, match="record numbers"):
        token_records.fetch(manifest, spark.createDataFrame([(60,)], "number long")).collect()


# --- 3 decontamination

def brute_hits(text, items):
    w = decontamination.words(text)
    hit, found = set(), set()
    for item, t in items:
        p = decontamination.words(t)
        for i in range(max(len(p) - 7, min(1, len(p)))):
            win = p[i : i + 8]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found |= set() if item is None else {str(item)}
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(5)
    word = ["aa", "b", "Cc", "dé", "e1", "f", "g", "h"]
    items = [(i, " ".join(rng.choices(word, k=rng.choice([0, 2, 5, 8, 9, 14])))) for i in range(25)] + [(90, None), (91, ""), (None, "e1 f e1"), (93, "zz zz"), (3, "aa b aa b aa b aa b"), (92, "aa, b; aa-b aa b AA b")]
    texts = ["; ".join(rng.choices([*word, "zz"], k=rng.randrange(60))) for _ in range(40)] + ODD + [items[4][1] * 3, "b " * 500]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, texts)
    for size in (1 << 20, 300):  # in one block and in many
        out = decontamination.search(table.drop("score"), bench, phrase_bytes=size).collect()
        for r in out:
            n, hit, found = brute_hits(r.text, [i for i in items])
            assert (r.n_words, r.n_hit, r.item_ids) == (n, hit, found)
            assert sum(s.end - s.start for s in r.spans) == hit
            if r.spans:
                cut = decontamination.words(decontamination.cut_spans(r.text, r.spans))
                assert len(cut) <= n - hit + 0 or hit == 0
    assert decontamination.search(table, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    index = decontamination.FMIndex(text, 6)
    patterns = np.ones((30, 4), np.int64)
    lengths = rng.integers(1, 5, 30)
    for i, n in enumerate(lengths):
        patterns[i, 4 - n :] = rng.integers(2, 6, n)
    lo, hi = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, lo, hi):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[4 - n :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- 4 packing

def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert(points, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = points[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing(spark):
    texts = [*ODD[:9], "one two three " * 900, "again"]
    table = docs(spark, texts)
    out = packing.pack(table, WORD, sequence=64, with_ids=True).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    full = [sum(r.length for r in rows) for _, rows in sorted(by_seq.items())]
    assert all(n == 64 for n in full[:-1]) and sorted(by_seq) == list(range(len(full)))
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    want = sorted(len(ids_of(WORD, r.text)) for r in table.collect())
    assert sum(want) == sum(full) and sum(r.length for r in out if r.doc_id == 9) == len(ids_of(WORD, texts[9]))
    assert packing.pack(table.limit(0), WORD).count() == 0


def test_ranges_hold_like_numbers_of_tokens(spark):
    """A third of the rows under one key, a few very long ones: the largest range is under twice the median."""
    rng = random.Random(31)
    rows = [(i, rng.choice([3, 50, 50, 400]) if i % 50 else 3000, 7 << 20 | rng.randrange(1 << 20) if i % 3 == 0 else rng.randrange(1 << 40)) for i in range(20_000)]
    table = spark.createDataFrame(rows, "id long, n long, pos long")
    bounds = packing.range_bounds(table, 20)
    assert len(bounds) == 19 and packing.range_bounds(table.limit(0), 20) == [] and packing.range_bounds(table, 1) == []
    got = table.withColumn("p", packing.range_of(F.col("pos"), bounds)).collect()
    sizes = {}
    for r in got:
        assert r.p == sum(b <= r.pos for b in bounds)
        sizes[r.p] = sizes.get(r.p, 0) + r.n
    sizes = sorted(sizes.values())
    assert len(sizes) == 20 and sizes[-1] < 2 * sizes[10]


def test_neighbours_on_the_curve_are_alike(spark):
    """Neighbours share a language far more often than chance would have it, long and short texts alike."""
    docs_ = shared.table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 200 and lang is not null")
    keys = packing.encoded(docs_, WORD, "doc_id", "text", 2).select("key", "id", "n")
    rows = keys.join(docs_, F.col("id") == F.col("doc_id")).orderBy("key", "id").select("lang", "n", "key").collect()
    langs = [r.lang for r in rows]
    alike = sum(a == b for a, b in zip(langs, langs[1:])) / (len(langs) - 1)
    chance = sum((langs.count(x) / len(langs)) ** 2 for x in set(langs))
    assert alike > chance + 0.5 * (1 - chance), (alike, chance)
    long = [r for r in rows if r.n > sorted(x.n for x in rows)[len(rows) * 9 // 10]]
    assert len({r.key for r in long}) > 0.95 * len({r.n for r in long})


# --- 5 WARC

@pytest.mark.parametrize("roll", [300, 1 << 20])
def test_warc(spark, roll):
    long, other = "<p>" + "é" * 80, "y" * 100
    rows = [(3, "http://a/ b\r\nX: y", long), (1, None, long), (2, "u", other), (2, "u", other), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (None, "u", long), (10, "u", ""), (2, "u", long)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    out = shared.shared_path(spark, "warc")
    manifest = warc.write(table, out, roll_bytes=roll)
    again = warc.write(table, shared.shared_path(spark, "warc"), roll_bytes=roll)
    assert sorted((r.bytes, r.n_records) for r in manifest.collect()) == sorted((r.bytes, r.n_records) for r in again.collect())
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read(manifest).collect())
    want = []
    seen = set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and (h or "").encode() == data), default=None)
        revisit = len(data) >= 100 and first is not None and (page != first or (page, data) in seen)
        seen.add((page, data))
        want.append((page or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else 0))
    assert got == sorted(want)
    fsys, path = shared.filesystem(manifest.first().file)
    with fsys.open_input_file(path) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.read(warc.write(table.limit(0), shared.shared_path(spark, "warc"))).count() == 0


# --- 6 quality

def test_quality(spark, sf):
    out = [r for r in quality.op6_quality(spark, sf).join(shared.table(spark, sf, "labels"), "doc_id").collect() if r.quality is not None]
    assert all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]  # rows no label was learned from
    assert len(held) >= 10 and sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    good, bad = ([r.score for r in held if r.quality == y] for y in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) > 0.95 * len(good) * len(bad)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(5)] + [(None, 1, "x"), (1, None, "x")], "doc_id long, quality int, score string")
    table = docs(spark, ODD)
    ranker = quality.fit(table, labels)
    scored = quality.score(table, ranker).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not (r.text or "").strip()}) == 1
    for bad in (labels.limit(0), labels.where("quality = 1")):
        assert {round(r.score, 9) for r in quality.score(table, quality.fit(table, bad)).collect()} == {0.3}


def test_quality_cut_is_of_all_labelled_rows(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["aa", "Bb", "c1", "d.", "#e", "| f"]) for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["same"] * 30
    ys = {i: int(rng.random() < 0.3 + 0.4 * (len(t) > 60)) for i, t in enumerate(texts) if i % 7}
    labels = spark.createDataFrame([*ys.items()], "doc_id long, quality int")
    ranker = quality.fit(docs(spark, texts).repartition(3), labels, rows=40)
    u = np.sort(ranker.utility(np.array([quality.features(texts[i]) for i in ys])))
    bad = sum(y == 0 for y in ys.values())
    assert ranker.cut == (u[bad - 1] + u[bad]) / 2


def test_exact_cut(spark):
    for good, bad in (([1.0, 2.0, 3.0], [-1.0, 0.0]), ([1.0] * 5, [1.0] * 3 + [-2.5]), ([-1e300, 5e-324], [0.0, 2.0, 2.0]), ([0.5], [0.25])):
        rows = [(y, int(quality._flip(np.array([v]).view(np.int64))[0])) for y, side in ((1, good), (0, bad)) for v in side]
        u = sorted(good + bad)
        got = quality.exact_cut(spark.createDataFrame(rows, "y int, key long"), {0: len(bad), 1: len(good)})
        assert got == (u[len(bad) - 1] + u[len(bad)]) / 2


def test_bradley_terry_orders():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (200, len(quality.FEATURES))), rng.normal(0, 1, (200, len(quality.FEATURES)))
    r = quality.bradley_terry(good, bad)
    assert (r.utility(good).mean() > r.utility(bad).mean()) and (r.utility(good) > np.median(r.utility(bad))).mean() > 0.95


def test_bradley_terry_is_the_least_loss():
    """The weights against plain descent on the logistic loss of all pairs' differences."""
    rng = np.random.default_rng(2)
    k = len(quality.FEATURES)
    good, bad = rng.normal(0.7, 1, (15, k)), rng.normal(0, 1, (14, k))
    r = quality.bradley_terry(good, bad, pairs=15 * 14)
    a, b = (np.clip((v - r.mean) / r.scale, -8, 8) for v in (good, bad))
    pairs = np.array([x - y for x in a for y in b])

    def loss(w):
        return np.logaddexp(0, -pairs @ w).mean() + quality.RIDGE / 2 * w @ w

    w = np.zeros(k)
    for _ in range(60_000):
        w += 0.05 * (pairs.T @ (1 / (1 + np.exp(pairs @ w))) / len(pairs) - quality.RIDGE * w)
    assert abs(loss(r.weights) - loss(w)) < 1e-3 and np.abs(r.weights - w).max() < 0.1 * np.abs(w).max()


def test_quality_scores_are_row_by_row(spark):
    """Scores of the operator against features and utility made anew, with repeated rows; an empty table gives none."""
    ranker = quality.Ranker(np.zeros(len(quality.FEATURES)), np.ones(len(quality.FEATURES)), np.linspace(-1, 1, len(quality.FEATURES)), 0.2, 1.5)
    texts = [*ODD, "one", "A b! c? 12 | x#"]
    table = docs(spark, texts).repartition(2)
    for r in quality.score(table, ranker).collect():
        x = np.clip(quality.features(r.text), -8, 8)
        z = 1.5 * (sum(v * w for v, w in zip(x, ranker.weights)) - 0.2) + np.log(0.3 / 0.7)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12 and r.predicted == (r.score >= 0.3)
    assert quality.score(table.limit(0), ranker).count() == 0
    empty = quality.fit(table.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert {round(r.score, 9) for r in quality.score(table, empty).collect()} == {0.3}
    words = "Ab cd! ab cd cd é | 12"  # 8 words, 22 characters, 23 bytes
    f = dict(zip(quality.FEATURES, quality.features(words)))
    assert f["log_words"] == np.log1p(8) and f["distinct_words"] == 7 / 8 and f["digit"] == 2 / 23 and f["high"] == 2 / 23 and f["bangs"] == 1 / 8
    assert f["same_next"] == 1 / 8 and f["top_word"] == 2 / 8 and f["capitals"] == 1 / 7 and f["distinct_pairs"] == 7 / 8 and f["empty"] == 0


# --- 7 sharding

def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT", 20)
    texts = ["hot"] * 150 + [f"t{i % 90}" for i in range(270)] + [None, "", (3, "t1"), (3, "t1"), (None, "t2")]
    out = sharding.shard(docs(spark, texts).withColumn("size", F.lit(1)).withColumn("label", F.lit("x"))).collect()
    n = len(texts)
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert len(out) == n and set(sizes) == set(range(8)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    groups = {}
    for r in out:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 30 and {(r.size, r.text_crc32) for r in out} >= {(1, 0), (4, zlib.crc32(b"hot"))}
    assert sharding.shard(docs(spark, []).limit(0)).count() == 0
    assert sorted(r.slot for r in sharding.shard(docs(spark, ["a", "b"])).collect()) == [0, 0]


def cut_groups(spark, texts):
    """Groups of equal rows that have several labels, and rows a label."""
    rows = docs(spark, texts).select("doc_id", "text").repartition(4)
    out = sharding.propagate(rows, ["text"], "doc_id").select("text", "label").collect()
    assert len(out) == len(texts)
    groups, sizes = {}, {}
    for r in out:
        groups.setdefault(r.text, set()).add(r.label)
        sizes[r.label] = sizes.get(r.label, 0) + 1
    return {t for t, s in groups.items() if len(s) > 1}, sizes


def test_sharding_joins_rare_copies(spark):
    cut, sizes = cut_groups(spark, [f"t{i}" for i in range(20_000)] + [f"t{i}" for i in range(15)])
    assert not cut and max(sizes.values()) < 2750


def test_sharding_joins_small_groups_beside_a_hot_one(spark):
    cut, sizes = cut_groups(spark, ["hot"] * 2700 + [f"t{i}" for i in range(4500)] + [f"t{i}" for i in range(900)])
    assert cut <= {"hot"} and max(sizes.values()) < 1.1 * 8100 / 8


def test_sharding_is_native(spark, sf):
    plan = sharding.op7_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


# --- 8 embeddings

@pytest.mark.parametrize("block", [7, 1024])
def test_embeddings(spark, block):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 6))
    vecs = [(i, (base[i % 12] + rng.normal(scale=rng.choice([0.02, 0.3]), size=6)).astype(np.float32).tolist()) for i in range(90)]
    vecs += [(100 + i, vecs[3][1]) for i in range(9)] + [(200, [2 * x for x in vecs[3][1]]), (300, None), (301, [0.0] * 6), (302, [float("nan")] + [1.0] * 5), (303, [None] + [1.0] * 5), (304, []), (305, vecs[3][1][:5]), (None, vecs[3][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<float>, kept int")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in vecs if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: {j for j in good if j != i and good[i] @ good[j] >= 0.9} for i in good}
    got = {r.vec_id: r for r in embedding_join.near_duplicates(table, block=block).collect()}
    assert len(got) == len(vecs)
    for i, r in got.items():
        reach, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert r.n_links == len(near.get(i, ())), i
        if i is not None:
            assert r.component_id == min(reach) and r.kept == (i == min(reach))
    assert embedding_join.near_duplicates(table.limit(0)).count() == 0
    assert embedding_join.near_duplicates(table.where("embedding is null")).count() == 1


def test_distant_blocks_are_skipped(spark):
    for fan in (2, 8):
        boxes = spark.createDataFrame([(i, float(i), i + 0.5, 0.0, 0.1) for i in range(40)], "b long, lo0 double, hi0 double, lo1 double, hi1 double")
        pairs = embedding_join.block_pairs(boxes, 40, 2, 0.6, fan)
        assert sorted((r.i, r.j) for r in pairs.collect()) == sorted([(i, i) for i in range(40)] + [(i, i + 1) for i in range(39)])
    assert embedding_join.block_pairs(boxes.limit(0), 0, 2, 0.6).count() == 0


def test_clustered_vectors_meet_their_own_blocks_only(spark, monkeypatch):
    """Blocks of distant clusters are skipped, the driver sees no pair, and the links are all there."""
    rng = np.random.default_rng(18)
    centres = np.concatenate([np.eye(8), -np.eye(8)])
    vecs = [(i, (centres[i % 16] + rng.normal(scale=0.05, size=8)).tolist()) for i in range(800)]
    seen = []
    links = embedding_join._links
    monkeypatch.setattr(embedding_join, "_links", lambda todo, *a: seen.append(sum(len(r.js) for r in todo.collect())) or links(todo, *a))
    got = embedding_join.near_duplicates(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), block=10, grid_dims=8).collect()
    x = np.array([v for _, v in vecs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    assert seen[0] < 0.3 * 82 * 81 / 2


# --- 9 substring dedup

def test_substrings(spark):
    rng = random.Random(9)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" + ("." if i % 9 == 8 else "") for i in range(n)) + ". "

    passage, own = prose(70), [prose(40) for _ in range(6)]
    long = " ".join(f"q{i}" for i in range(60)) + ". "  # one sentence
    texts = [own[0] + passage + own[1], own[2] + passage.upper() + own[3], own[4] + long, long + own[5], passage, *ODD, passage + own[0], "same thing here and there too again now. " * 40]
    out = {(r.doc_id, i): r for i, r in enumerate(substring_dedup.remove(docs(spark, texts).withColumn("n_removed", F.lit("x"))).orderBy("doc_id").collect())}
    got = {k[0]: r for k, r in out.items()}
    assert got[0].text == texts[0] and got[0].n_removed == 0 and got[2].text == texts[2]
    assert "W" not in got[1].text and own[2].strip() in got[1].text and got[1].n_removed == 1
    assert got[4].text.strip() == "" and "q30" not in got[3].text
    assert out and len(out) == len(texts)
    last = got[len(texts) - 1]
    assert 0 < len(last.text) < len(texts[-1])
    nulls = [r for r in out.values() if r.text is None]
    assert len(nulls) == 1 and nulls[0].n_removed == 0
    assert substring_dedup.remove(docs(spark, []).limit(0)).count() == 0


def test_substrings_to_both_ends_and_without_spaces(spark):
    rng = random.Random(10)
    sentence = lambda n, mark: " ".join(f"{mark}{rng.randrange(10**6)}" for _ in range(n)) + ". "
    passage = "".join(sentence(n, "p") for n in (12, 4, 4, 4))
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n)) + "。"
    solid = "".join(han(n) for n in (9, 15, 8))
    own = [sentence(15, "o") + sentence(15, "o") for _ in range(4)]
    wide = [han(14) + han(14) for _ in range(4)]
    texts = [own[0] + passage + own[1], own[2] + passage + own[3], wide[0] + solid + wide[1], wide[2] + solid + wide[3]]
    got = [r.text for r in substring_dedup.remove(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], own[2] + own[3], texts[2], wide[2] + wide[3]]


def brute_removed(rows):
    """The text each (id, text) is left with, from all runs of pieces compared as words."""

    def cut_up(t):
        parts = substring_dedup.pieces(t) if t else []
        n = len(parts)
        count = lambda a, b: sum(len(p[2]) for p in parts[a:b])
        runs = set()
        for i in range(n):
            on = [j for j in range(i + 3, n + 1) if count(i, j) >= 20]
            back = [j for j in range(i - 1, -1, -1) if i + 1 - j >= 3 and count(j, i + 1) >= 20]
            runs |= {(i, on[0])} if on else set()
            runs |= {(back[0], i + 1)} if back else set()
        return parts, sorted((i, j, tuple(" ".join(p[2]).lower() for p in parts[i:j])) for i, j in runs)

    made = [cut_up(t) for _, t in rows]
    rank = [(i is None, i or 0, xxhash.xxh64(t or "", seed=42).intdigest() if i is None else 0) for i, t in rows]
    signed = [(z, i, u - (1 << 64) if u >> 63 else u) for z, i, u in rank]
    first = {}
    for r, (_, runs) in zip(signed, made):
        for *_, words in runs:
            first[words] = min(first.get(words, r), r)
    out = []
    for (_, t), r, (parts, runs) in zip(rows, signed, made):
        gone, seen = set(), set()
        for i, j, words in runs:
            if words in seen or first[words] != r:
                gone.update(range(i, j))
            seen.add(words)
        ends = [(parts[k][0], parts[k][1]) for k in sorted(gone)]
        kept, at = "", 0
        for k, (a, b) in enumerate(ends):
            if k and ends[k - 1][1] <= a and sorted(gone)[k] == sorted(gone)[k - 1] + 1:
                at = b
                continue
            kept += t[at:a]
            at = b
        out.append(t if t is None else kept + t[at:])
    return out


def test_substrings_against_brute_force(spark):
    """Shared passages, repeats inside a text, null ids, several rows of an id and repeated rows."""
    rng = random.Random(19)
    sentences = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([2, 5, 9, 11, 25]))) + rng.choice([". ", "! ", "\n"]) for _ in range(25)]
    rows = [(rng.choice([None, None, *range(20)]), "".join(rng.choices(sentences, k=rng.randrange(14)))) for _ in range(70)]
    rows += [(None, None), (3, None), rows[5], rows[5], (None, rows[7][1]), (None, rows[7][1])]
    got = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = sorted(zip((i for i, _ in rows), brute_removed(rows)), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert all(sum(x.end - x.start for x in r.removed) > 0 for r in got if r.n_removed)


# --- 10 SimHash

def brute_print(text):
    import re

    w = re.findall(rb"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for t in [*[t if not isinstance(t, tuple) else t[1] for t in ODD], "A b\tc\x0bD e\x1cf ÀÉ", "a b", "a b c"]:
        assert simhash.fingerprint(t) == brute_print(t)


def test_simhash_groups(spark):
    rng = random.Random(10)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        for _ in range(3):
            fps.append(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps += [0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 63) - 1, (1 << 62) - 1]
    want = {(min(a, b), max(a, b)) for a in map(_signed, fps) for b in map(_signed, fps) if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    table = spark.createDataFrame([(_signed(f),) for f in set(fps)], "fp long")
    assert {(r.a, r.b) for r in simhash.near_pairs(table).collect()} == want


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_simhash_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, "other text here", base, base + " tail", *ODD]
    rows = docs(spark, texts)
    out = simhash.near_duplicates(rows).collect()
    prints = {}
    for r in rows.collect():
        prints.setdefault(brute_print(r.text), []).append(r.doc_id)
    reps = list(prints)
    group = {f: f for f in reps}
    for _ in reps:
        for a in reps:
            for b in reps:
                if bin(a ^ b).count("1") <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min(i for f in reps if group[f] == g for i in prints[f] if i is not None) for g in set(group.values())}
    assert len(out) == len(texts)
    for r in out:
        assert r.component_id == least[group[r.fp & (1 << 64) - 1]]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2, 512])
def test_similar_texts(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = [" ".join(base)]
    for edits in range(1, 12):
        w = list(base)
        for at in rng.sample(range(200), edits):
            w[at] = f"x{rng.randrange(900)}"
        texts.append(" ".join(w))
    texts += [" ".join(base), "four words are here", "four words are there", *[t for t in ODD if not isinstance(t, tuple)]]
    rows = docs(spark, texts)
    sets = {t: set(similar.simhash.shingle_hashes(t, 5).tolist()) for t in texts}
    group = {t or "": t or "" for t in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and both >= 0.8 * len(sets[a] | sets[b]) and group[a or ""] != group[b or ""]:
                    group[a or ""] = group[b or ""] = min(group[a or ""], group[b or ""])
                    changed = True
    got: dict = {}
    want: dict = {}
    by_id = {r.doc_id: r.text for r in rows.collect()}
    for r in similar.groups(rows).collect():
        got.setdefault(r.group, set()).add(r.id)
        want.setdefault(group[by_id[r.id] or ""], set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    kept = similar.keep_first(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {min(v) for v in want.values()}


def brute_kept(rows):
    """(id, text) of the row that stays in each group of ``rows``, by all pairs."""
    sets = {t: set(similar.simhash.shingle_hashes(t, 5).tolist()) for _, t in rows}
    group = {t: t for t in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and both >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    best = {}
    for i, t in rows:
        key = (i is None, i or 0, hashlib.md5(t.encode()).hexdigest())
        if group[t] not in best or key < best[group[t]][0]:
            best[group[t]] = (key, (i, t))
    return sorted((v[1] for v in best.values()), key=str)


@pytest.mark.parametrize("tile", [3, 512])
def test_keep_first_knows_rows_apart(spark, monkeypatch, tile):
    """Null ids, ids of several rows, and ids that stand in several groups."""
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "PIVOTS", 2)
    rng = random.Random(11)
    texts = []
    for g in range(4):
        base = [f"w{g}{rng.randrange(900)}" for _ in range(120)]
        for edits in range(6):
            w = list(base)
            for at in rng.sample(range(120), edits):
                w[at] = f"x{rng.randrange(900)}"
            texts.append(" ".join(w))
    texts += ["x", "y", ""]
    rows = [(rng.choice([None, None, 1, 2, 3, 4, 5, 6]), rng.choice(texts)) for _ in range(90)] + [(1, "x"), (None, "x"), (None, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in similar.keep_first(table).collect()), key=str)
    assert got == brute_kept(rows)


def test_large_clusters_cost_a_copy_a_text(spark, monkeypatch):
    """A group of near copies of many tiles is linked by its pivots; nothing is left to compare across tiles."""
    monkeypatch.setattr(similar, "TILE", 8)
    rng = random.Random(12)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = []
    for i in range(100):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(w))
    seen = []
    compare = similar._compare
    monkeypatch.setattr(similar, "_compare", lambda d, *a: seen.append(d.count()) or compare(d, *a))
    assert similar.keep_first(docs(spark, texts)).count() == 1
    assert len(seen) == 1 and seen[0] <= 100 + similar.PIVOTS * 13


def test_similar_takes_odd_tables(spark):
    rows = docs(spark, ["a b c d e f"])
    assert similar.keep_first(rows.limit(0)).count() == 0
    twice = rows.union(rows).union(rows.selectExpr("cast(null as long)", *rows.columns[1:]))
    assert [r.doc_id for r in similar.keep_first(twice).collect()] == [rows.first().doc_id]


def most_broadcast(spark, run):
    """Rows of the largest table that was broadcast while ``run()`` ran."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(60_000)
    before = {e.executionId() for e in _seq(store.executionsList())}
    run()
    bus.waitUntilEmpty(60_000)
    most = 0
    for e in _seq(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in _seq(store.planGraph(e.executionId()).allNodes()):
                if node.name() == "BroadcastExchange":
                    ids = [m.accumulatorId() for m in _seq(node.metrics()) if m.name() == "number of output rows"]
                    most = max([most, *[int(values.apply(i).replace(",", "")) for i in ids if values.contains(i)]])
    return most


def _seq(xs):
    return [xs.apply(i) for i in range(xs.size())]


@pytest.mark.parametrize("tile", [4, 512])
def test_near_dedup_broadcasts_counted_tables_only(spark, monkeypatch, tile):
    """What explode makes of a few KB isn't broadcast, whatever the planner takes it for; nor is a list of cells a text."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "PIVOTS", 2)
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(40))) for i in range(60)]
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(120), i % 6):
            w[at] = f"x{rng.randrange(900)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(30)]
    table = shared.materialize(spark.createDataFrame(rows, "doc_id long, text string"), "rows")
    got = []
    assert most_broadcast(spark, lambda: got.extend(similar.keep_first(table).collect())) <= 20
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_kept(rows)


def test_simhash_broadcasts_counted_tables_only(spark, monkeypatch):
    """Fingerprints, their cells and their groups aren't broadcast by the planner's estimate."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 20)
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(80)]
    texts += texts[:30]
    rows = shared.materialize(docs(spark, texts), "rows")
    out = []
    assert most_broadcast(spark, lambda: out.extend(simhash.near_duplicates(rows).collect())) <= 20
    prints = [brute_print(t) for t in texts]
    assert all(bin(a ^ b).count("1") > 2 for a in set(prints) for b in set(prints) if a != b)
    assert sorted((r.doc_id, r.fp, r.component_id) for r in out) == [(i, _signed(f), i % 80) for i, f in enumerate(prints)]
