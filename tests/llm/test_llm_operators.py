"""Each operator of the subpackage against a brute-force version, and on the cases with defined results."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from folioflow.llm import components, edits, jpeg, langid, lines, media, mixing, neardup, packing, quality, sharding, toxicity
from folioflow.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, node string"
WORDS = "the of and to in is that for with on as by it from this be are was at not alpha beta gamma delta".split()


def table(spark, rows):
    """Documents, with two columns more whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "s", "n") for i, t, lang, src in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty fields, ties, repeated rows, white space, long words and texts, and other scripts."""
    rng = random.Random(3)
    long = prose(rng, 3000)
    rows = [
        (1, None, None, None), (None, "no id " + prose(rng, 30), "en", "a"), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, long, "en", "a"), (5, long, "en", "b"), (6, long + " more", "en", "b"),
        (7, "twin", "de", "c"), (7, "twin", "de", "c"), (8, "x" * 5000, "fr", "c"), (9, "日本語のテキスト 😀 ñandú", "es", "d"), (10, "a\n\nb\na", "en", "d"), (None, None, None, None), (11, "one two three", "en", "a"), (12, "One two  three", "en", "a"),
    ]
    rows += [(100 + k, prose(rng, 60), "en", "a") for k in range(30)]
    base = prose(rng, 80).split()
    for k in range(20):
        w = list(base)
        w[rng.randrange(80)] = f"edit{k}"
        rows.append((200 + k, " ".join(w) + "\nshared line number one of all these texts\n" + prose(rng, 12), "en", "b"))
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).limit(0)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def input_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


# -- 1


def test_packing(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, text, _ in input_of(odd):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    pieces = rows_of(packing.pack(odd))
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and all(p["offset"] == 0 for p in pieces)
    got, at = Counter(), 0
    for k, p in enumerate(sorted(pieces, key=lambda p: p["sequence_id"])):
        assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= 2048 and len(p["ids"]) == p["length"] and p["bucket"] == int(math.log2(p["length"]))
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        if p["start"] == 0:
            ids = []
        assert p["start"] == len(ids)
        ids += p["ids"]
        if len(ids) == p["doc_tokens"]:
            got[p["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            at += 1
    assert got == want


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, " " * 5000 + "x", "\n" * 3000, "<|endoftext|> x", "don't  stop it now", "日本語 😀 naïve ÅΩ", "\x00\x01﻿", "12345 67.8", "é‍🏽"])
def test_ids_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    assert packing.encoder(packing.default_vocabulary())(text) == t.encode(text, add_special_tokens=False).ids


def test_piece_lengths():
    assert packing.piece_lengths(5) == [4, 1] and packing.piece_lengths(4096 + 3) == [2048, 2048, 2, 1] and packing.piece_lengths(2048) == [2048]


# -- 2


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, left, target = sum(sizes.values()), set(order), {}
    rest = total
    while left:
        w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            target |= {s: rest * weight[s] / w for s in left}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            left.discard(s)
    return target


def test_mixing(odd):
    sizes, n = defaultdict(int), Counter()
    for i, text, src in input_of(odd):
        sizes[src] += len(words_of(text))
        n[i, src, len(words_of(text))] += 1
    target = brute_targets(sizes)
    got = rows_of(mixing.mix_documents(odd))
    by_id = {(i, size): src for i, src, size in n}
    assert Counter((r["doc_id"], by_id[r["doc_id"], r["size"]], r["size"]) for r in got) == n
    taken = defaultdict(int)
    for r in got:
        src = by_id[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[src] and r["target"] == pytest.approx(target[src]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[src] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix_documents(odd.repartition(7)))))


def test_mixed_documents_are_whole(odd):
    had = Counter(map(str, rows_of(odd)))
    got = Counter(map(str, rows_of(mixing.mixed_documents(odd))))
    assert set(got) <= set(had) and all(got[k] <= 3 * had[k] for k in got)


def test_mixing_repeated_rows(spark):
    docs = table(spark, [(1, "a b c d", "en", "x")] * 30 + [(2, "a b", "en", "y")] * 10)
    got = rows_of(mixing.mix_documents(docs))
    assert sum(r["taken"] for r in got if r["doc_id"] == 2) == pytest.approx(60, abs=10) and len(got) == 40


# -- 3


def brute_walk(text):
    """Output characters of the walk, place by place."""
    c, j, out = edits.classes_of(text), 0, []
    for k in c:
        while True:
            out.append(int(k))
            last = int(edits.STAYS[k, j % edits.PERIOD]) == 1
            j += 1
            if last:
                break
    return out


def test_walks_step_by_step():
    rng = random.Random(1)
    texts = ["", "a", "é😀", prose(rng, 40), prose(rng, 7)] + [prose(rng, rng.randint(1, 30)) for _ in range(60)]
    for t, print_ in zip(texts, edits.fingerprints(texts), strict=True):
        walk = brute_walk(t)
        want = np.zeros(edits.SLOTS, np.uint8)
        for k in range(edits.SLOTS if walk else 0):
            place = max(r for r in edits._RECORDS[k] if r <= len(walk))
            want[k] = edits._NIBBLES[k, walk[place - 1]]
        assert (want == print_).all()


def test_likeness_follows_edits():
    rng = random.Random(2)
    t = prose(rng, 300)
    few, many = t.replace("the", "tho", 3), t[: len(t) // 2] + prose(rng, 150)
    a, b, c, d = edits.fingerprints([t, few, many, prose(rng, 300)])
    assert edits.likeness(a, a) == 1 and edits.likeness(a, b) > 0.85 > edits.likeness(a, c) > 0.4 > edits.likeness(a, d)


def test_fingerprint_documents(odd):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    src = sorted(((i, t or "") for i, t, _ in input_of(odd)), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = Counter()
    for k, (i, t) in enumerate(src):
        nxt, half = src[(k + 1) % len(src)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = edits.fingerprints([t, edited, nxt])
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), edits.as_text(a), edits.as_text(b), round(edits.likeness(a, b), 9), round(edits.likeness(a, c), 9)] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows_of(edits.fingerprint_documents(odd)))
    assert got == want


def test_edit_classes(spark, empty):
    """Against all pairs of fingerprints."""
    rng = random.Random(4)
    texts = [None, "", "a", "a"]
    for k in range(12):
        base = prose(rng, 60 + 20 * k)
        texts += [base, base + "!", base.replace("the", "thy", 1), base.replace(" ", "  ", 1), prose(rng, 5) + base[len(base) // 3 :]]
    docs = table(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    prints = edits.fingerprints([t or "" for t in texts])
    sets = [set(enumerate(p.tolist())) for p in prints]
    least = round((edits.ALIKE * 15 / 16 + 1 / 16) * edits.SLOTS)
    root = brute_components(sets, least, 2 * edits.SLOTS - least)
    want = {k: min(j for j, r in enumerate(root) if r == root[k]) for k in range(len(texts))}
    got = rows_of(edits.fingerprint_classes(docs))
    assert {r["doc_id"]: r["class_id"] for r in got} == want and 10 < len(set(want.values())) < len(texts) - 10
    assert len(got) == len(texts) and edits.fingerprint_classes(empty).count() == 0


def test_bands_of_like_fingerprints():
    """Pairs that are equal in just as many samples as a link needs nearly always share a band, unlike ones nearly never."""
    rng = np.random.default_rng(5)
    least = round((edits.ALIKE * 15 / 16 + 1 / 16) * edits.SLOTS)
    one = rng.integers(0, 16, (3000, edits.SLOTS)).astype(np.uint8)
    two = one.copy()
    for row in two:
        at = rng.choice(edits.SLOTS, edits.SLOTS - least, replace=False)
        row[at] = (row[at] + rng.integers(1, 16, len(at))) % 16
    x, y = (edits.band_keys([edits.as_text(r) for r in side]) for side in (one, two))
    assert (x == y).any(axis=1).mean() > 0.996 and not (x[1:] == y[:-1]).any()


# -- 4


def test_media(odd):
    got = Counter()
    for r in rows_of(media.media_of_documents(odd)):
        got[r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]] += 1
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
    want = Counter()
    for i, t, _ in input_of(odd):
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert got == want


def test_any_bytes_come_back():
    r = np.random.default_rng(1)
    payloads = [r.integers(0, 256, 192 * k, dtype=np.uint8).tobytes() for k in (1, 2, 7, 8, 9, 40)] + [bytes([128]) * 192 * 20, bytes([128] * 191 + [3]) * 9, (bytes([128] * 40 + [255] + [0] * 20) * 40)[:1920]]
    images = jpeg.decode(jpeg.encode(payloads))
    assert [jpeg.stored_bytes(i) for i in images] == payloads


def huffman_by_bits(table):
    codes, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            codes[format(code, f"0{n}b")] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def brute_dc(data):
    """Luminance DC values of a 4:4:4 file, bit by bit."""
    image = jpeg.parse(data)
    scan = image.scans[0]
    tables = [[huffman_by_bits(t) for t in pair] for pair in scan.tables]
    out = []
    for seg in scan.segments:
        bits, at, last = "".join(format(b, "08b") for b in seg), 0, [0, 0, 0]

        def symbol(table):
            nonlocal at
            n = next(n for n in range(1, 17) if bits[at : at + n] in table)
            at += n
            return table[bits[at - n : at]]

        def number(size):
            nonlocal at
            v = int(bits[at : at + size] or "0", 2)
            at += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        while len(bits) - at >= 8 and len(out) < (image.width // 8) * (image.height // 8):
            for c in range(3):
                last[c] += number(symbol(tables[c][0]))
                k = 1
                while k < 64:
                    rs = symbol(tables[c][1])
                    if rs == 0:
                        break
                    k += rs >> 4
                    number(rs & 15)
                    k += 1
                if c == 0:
                    out.append(last[0])
    return out


def test_decoder_against_bits():
    payload = bytes(range(256)) * 3 + b"Text of a page, " * 36
    data = jpeg.encode([payload])[0]
    image = jpeg.decode([data])[0]
    assert image.blocks[0][:, :, 0].ravel().tolist() == brute_dc(data)
    assert jpeg.thumbnail(image).shape == (image.height // 8, image.width // 8) and jpeg.thumbnail(image)[0, 0] == payload[0]


def test_damaged_files_have_an_error(spark):
    good = jpeg.encode([b"x" * 192])[0]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate([good, None, b"", b"GIF89a", good[:40], good[:-30]])], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in rows_of(media.read_images(df))}
    assert got[0]["error"] is None and (got[0]["width"], got[0]["height"]) == (8, 8) and all(got[k]["error"] and got[k]["width"] is None for k in range(1, 6))


# -- 5, 7, 9


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(600):
        words = prose(rng, rng.randint(20, 80)).split()
        toxic, bad = k % 5 == 0, k % 4 == 1
        if toxic:
            for w in rng.sample(["vile", "awful", "nasty"], rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w)
        if bad:
            words = [w + rng.choice(["$$$", "%%%"]) for w in words]
        docs.append((k, " ".join(words), "en", f"s{k % 3}"))
        if k % 2 or k % 5 == 0:
            labels.append((k, int(not bad), int(toxic)))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(labelled, odd, empty):
    docs, labels = labelled
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["keep"] for r in rows_of(quality.score(docs, model))}
    assert sum(got[k] == (k % 4 != 1) for k in range(600)) >= 590
    assert len(rows_of(quality.score(odd, model))) == odd.count() and quality.score(empty, model).count() == 0
    assert {r["quality"] for r in rows_of(quality.qualities(odd, labels.limit(0)))} == {0.5}


def test_shapes_cover_whole_words():
    assert quality.shape("日本語" * 20 + "。12") == "x。0" and quality.shape("a1" * 30) == "x0" * 30 and quality.shape("") == "" and quality.shape("Word") == "Xx"
    one, two = (quality.content("字" * 50 + end)[0] for end in ("。", "、"))
    assert set(one[one >= quality.WORDS]) != set(two[two >= quality.WORDS])


def test_toxicity(labelled, odd, empty):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in rows_of(toxicity.score(docs, model))}
    assert sum(got[k]["rejected"] == (k % 5 == 0) for k in range(600)) >= 597
    kept = {r["doc_id"] for r in rows_of(toxicity.without_toxic(docs, labels))}
    assert kept == {k for k in got if not got[k]["rejected"]}
    assert len(rows_of(toxicity.score(odd, model))) == odd.count() and toxicity.score(empty, model).count() == 0
    none = rows_of(toxicity.severities(odd, labels.limit(0)))
    assert not any(r["rejected"] for r in none) and toxicity.without_toxic(odd, labels.limit(0)).count() == odd.count()


def test_training_on_repeated_ids(spark, labelled):
    """Many rows of one labelled id: the fit is the same however the rows are dealt out, and no row displaces others."""
    docs, labels = labelled
    some = docs.where("doc_id < 5").collect()
    many = spark.createDataFrame([(r["doc_id"], f"copy {k} {r['text']}", *r[2:]) for r in some for k in range(200)], docs.schema)
    docs = docs.union(many)
    for train, weights in ((toxicity.train, lambda m: (m.weights, m.thresholds)), (quality.train, lambda m: m.views), (lambda d, _: langid.train(d), lambda m: (m.weights, m.transitions))):
        one, two = weights(train(docs, labels)), weights(train(docs.repartition(7, "text"), labels))
        assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    p = 1 / (1 + np.exp(-((x @ [2.0, -1.0, 0.5])[:, None] - np.array([-0.5, 1.5])[None])))
    y = (rng.random(4000)[:, None] < p).sum(axis=1)
    w, theta = toxicity.fit_ordinal(x, y, ridge=0)
    assert np.allclose(w, [2, -1, 0.5], atol=0.25) and np.allclose(theta, [-0.5, 1.5], atol=0.25)


VOICES = {"aa": "the and of to in with that".split(), "bb": "der und die das mit nicht ein".split(), "cc": "le la les et dans que pour".split()}


def test_language(spark, odd, empty):
    rng = random.Random(7)
    rows = []
    for k in range(240):
        lang = sorted(VOICES)[k % 3]
        rows.append((k, " ".join(rng.choice(VOICES[lang]) + rng.choice(["", "x", "y"]) for _ in range(30)), lang, "s"))
    docs = table(spark, rows)
    got = rows_of(langid.languages_of(docs))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == sorted(VOICES)[r["doc_id"] % 3] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    model = langid.train(docs)
    post = langid.label(model, ["the and of to in".split() + "der und die das mit".split()])[0]
    assert [model.languages[k] for k in post.argmax(axis=1)] == ["aa"] * 5 + ["bb"] * 5
    und = {r["doc_id"] for r in rows_of(langid.predict(odd, model)) if r["lang_pred"] == "und"}
    assert {1, 2, 3} <= und and 9 not in und and langid.languages_of(empty).count() == 0
    assert {r["lang_pred"] for r in rows_of(langid.predict(odd, None))} == {"und"}
    assert rows_of(langid.predict(table(spark, [(1, "² 3 ½ __ 7", "en", "s")]), model))[0]["lang_pred"] == "und"


def test_training_words_come_from_whole_texts():
    places = [int(w) for w in langid.drawn_words([str(k) for k in range(3000)])]
    assert len(places) == langid.TRAIN_WORDS and places == sorted(places) and all(any(k <= p < k + 500 for p in places) for k in range(0, 3000, 500))
    assert langid.drawn_words(["a"] * 3) == ["a"] * 3


def test_a_long_document_is_one_chain():
    rng = np.random.default_rng(2)
    model = langid.Field(["a", "b", "c"], [set(), set(), set()])
    model.weights += rng.normal(size=model.weights.shape).astype(np.float32) / 4
    model.transitions += 2 * np.eye(3) + rng.normal(size=(3, 3)) / 2
    model.starts += [2, -1, 0]
    documents = [[f"w{rng.integers(50)}" for _ in range(n)] for n in (3 * langid.WINDOW + 1, 0, 5, 2 * langid.WINDOW)]
    for words, got in zip(documents, langid.label(model, documents), strict=True):
        psi, move = np.exp(model.emissions(words)), np.exp(model.transitions)
        alpha, beta = [], [np.ones(3)]
        for t in range(len(words)):
            now = psi[t] * (np.exp(model.starts) if t == 0 else alpha[-1] @ move)
            alpha.append(now / now.sum())
        for t in range(len(words) - 1, 0, -1):
            now = move @ (psi[t] * beta[0])
            beta.insert(0, now / now.sum())
        want = [a * b / (a @ b) for a, b in zip(alpha, beta, strict=False)]
        assert len(got) == len(words) and np.allclose(got, np.array(want).reshape(-1, 3))


def test_forward_backward_against_all_paths():
    import itertools

    model = langid.Field(["a", "b", "c"], [set(), set(), set()])
    rng = np.random.default_rng(8)
    model.transitions, model.starts = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(4, 2, 3))
    post, _ = model.posteriors(scores, np.array([4, 2]))
    for chain, n in ((0, 4), (1, 2)):
        want, z = np.zeros((n, 3)), 0
        for path in itertools.product(range(3), repeat=n):
            s = model.starts[path[0]] + sum(scores[t, chain, k] for t, k in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
            z += math.exp(s)
            for t, k in enumerate(path):
                want[t, k] += math.exp(s)
        assert np.allclose(post[:n, chain], want / z)


# -- 6, 10


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def brute_components(sets, num, den):
    parent, find = union_find(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and common * den >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates(odd, empty):
    src = input_of(odd)
    sets = []
    for _, t, _ in src:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = brute_components(sets, 85, 100)
    least: dict[int, int | None] = {}
    for (i, _, _), r in zip(src, root, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = Counter((i, len(s), i if not s else least[r], i == (i if not s else least[r])) for (i, _, _), s, r in zip(src, sets, root, strict=True))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(neardup.near_duplicate_rows(odd)))
    assert got == want and neardup.near_duplicate_rows(empty).count() == 0
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in rows_of(kept))[7] == 1


def test_a_group_with_spread_out_copies(spark):
    """Copies near a common base but not all near each other: links that only other copies have must not be lost."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 6])):
            w[at] = f"e{k}_{at}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    root = brute_components(sets, 85, 100)
    least = {r: min(k for k, x in enumerate(root) if x == r) for r in root}
    got = {r["doc_id"]: r["component_id"] for r in rows_of(neardup.near_duplicate_rows(table(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])))}
    assert got == {k: least[r] for k, r in enumerate(root)} and len(set(got.values())) > 2


def test_chunk_keys_meet_for_all_pairs_under_the_threshold():
    rng = np.random.default_rng(10)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, 50).astype(np.uint64)
        b = a.copy()
        b[rng.choice(50, 19, replace=False)] ^= np.uint64(1)
        assert set(neardup.chunk_keys(a, 5).tolist()) & set(neardup.chunk_keys(b, 5).tolist())


def test_components_of_chains(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(1000)] + [(2100, 2101), (2101, 2100), (5, 5), (3205, 3200), (3205, 3210)]
    cuts = []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: cuts.append(1) or cut(df))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 1006 and {got[k] for k in range(1001)} == {got[0]} and got[2101] == got[2100] and got[3210] == got[3205] == got[3200]
    assert len({got[0], got[2100], got[3200]}) == 3 and all(got[r] == r for r in got.values())
    assert len(cuts) / 2 < 15  # two tables a round


def test_bits_of_pairs_at_the_threshold():
    for s, n in ((0.85, 50), (0.8, 48), (0.8, 80)):
        p, m = (1 - s) / 2, components.most_bits(s, n)
        tail = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m + 1, n + 1))
        assert tail <= components.RISK < tail + math.comb(n, m) * p**m * (1 - p) ** (n - m)


def test_large_groups_are_joined_in_parts(spark, monkeypatch):
    """One hot group, so small limits that every split is taken."""
    from folioflow.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 20)
    rows = spark.createDataFrame([(k, k % 3 if k < 30 else 9) for k in range(300)], "node long, root long")
    groups = spark.createDataFrame([(0, 10, "x"), (1, 10, "y"), (2, 10, "z"), (9, 270, "w")], "root long, size long, name string")
    assert Counter(r["name"] for r in common.of_groups(rows, "root", groups).collect()) == {"x": 10, "y": 10, "z": 10, "w": 270}


def test_no_link_is_lost_in_blocks(spark, monkeypatch):
    """Groups with many outsiders, in blocks and salts of a few rows: the components are those of all pairs that share a key."""
    monkeypatch.setattr(components, "BLOCK", 3)
    monkeypatch.setattr(components, "RUN", 4)
    rng = random.Random(12)
    base = list(range(100, 160))
    sets = []
    for k in range(90):
        mine = set(base) - set(rng.sample(base, rng.choice([2, 5, 8, 11]))) | {rng.randrange(10**6) for _ in range(rng.choice([0, 1, 6]))}
        sets.append(mine)
        if k % 3 == 0:  # a copy of an outsider, in one place different
            sets.append(mine - {min(mine)} | {k})
    text = lambda x: " ".join(map(str, sorted(x)))
    nodes = spark.createDataFrame([(k, [1], 0, 0) for k in range(len(sets))], "node long, keys array<long>, b0 long, b1 long")
    texts = spark.createDataFrame([(k, text(x)) for k, x in enumerate(sets)], "node long, text string")
    found = components.linked_components(nodes, lambda some: components.cut(some.join(texts, "node")), (80, 100), 64, lambda t: np.array(sorted(map(int, t.split())), np.uint64))
    root = {r["node"]: r["root"] for r in found.collect()}
    want = brute_components(sets, 80, 100)
    same = lambda of: {frozenset(k for k in range(len(sets)) if of(k) == r) for r in {of(k) for k in range(len(sets))}}
    assert same(lambda k: root.get(k, k)) == same(lambda k: want[k]) and len(set(want)) > 3


INSIDE = ["key", "c_id", "c_key", "row", "least", "g_id", "g_th", "drop", "th", "root", "n_lines", "n_removed", "source_", "whole", "threshold", "times", "copy", "node", "k", "h", "_1"]


def test_columns_of_any_name_stay(spark):
    rows = [(k, f"line {k} of this table with words {k * 7}\nshared line of all the texts in here", "en", "s" if k % 2 else "t", 0, *(f"{c}{k}" for c in INSIDE)) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INSIDE))
    want = {r["doc_id"]: [r[c] for c in INSIDE] for r in docs.collect()}
    for f in (neardup.without_near_duplicates, mixing.mixed_documents):
        out = f(docs)
        got = rows_of(out)
        assert out.columns == docs.columns and got and all([r[c] for c in INSIDE] == want[r["doc_id"]] for r in got)
    out = lines.without_duplicate_lines(docs, total="all of them", gone="went")
    assert out.columns == [*docs.columns, "all of them", "went"] and all([r[c] for c in INSIDE] == want[r["doc_id"]] for r in rows_of(out))


def test_rows_without_words_all_stay(spark):
    schema = "doc_id long, text string, extra string, m map<string,int>"
    rows = [(None, None, "a", {"x": 1}), (None, "", "b", None), (3, "", "c", None), (3, "", "d", None), (None, None, "e", None), (3, " \t", "f", None)]
    same = [(4, "the very same words in here", "g", None), (4, "the very same words in here", "h", {"y": 2}), (5, "the very same words in here", "i", None)]
    docs = spark.createDataFrame(rows + same, schema)
    got = sorted(r["extra"] for r in rows_of(neardup.without_near_duplicates(docs)))
    assert got[:6] == list("abcdef") and len(got) == 7 and got[6] in "gh"
    assert got == sorted(r["extra"] for r in rows_of(neardup.without_near_duplicates(docs.repartition(5))))


def test_line_dedup(odd, empty):
    src = sorted(((i, xxhash.xxh64_intdigest((t or "").encode()), t) for i, t, _ in input_of(odd)), key=lambda r: (r[0] is not None, r[0] or 0))
    found = [(i, n, lines.normal(x)) for i, _, t in src for n, x in enumerate((t or "").split("\n")) if lines.normal(x)]
    distinct = sorted({x for _, _, x in found})
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in distinct]
    root = dict(zip(distinct, brute_components(sets, 80, 100), strict=True))
    first: dict[int, tuple] = {}
    for i, n, x in found:
        first.setdefault(root[x], (i, n))
    want = Counter()
    for i, _, t in src:
        want[i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not lines.normal(x) or first[root[lines.normal(x)]] == (i, n))] += 1
    got = Counter((r["doc_id"], r["text"]) for r in rows_of(lines.cleaned_documents(odd)))
    assert got == want and lines.cleaned_documents(empty).count() == 0
    assert lines.without_duplicate_lines(odd).columns == [*odd.columns, "n_lines", "n_removed"]


def test_like_lines_share_a_band():
    """Pairs with a similarity from 0.80 to 0.81, by whole sets: of bands with too many rows one pair in forty shares none."""
    rng, pairs = random.Random(5), []
    while len(pairs) < 2000:
        one = "x" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(rng.randint(60, 140))) + "x"
        two = list(one)
        for _ in range(rng.randint(1, 3)):
            two[rng.randrange(len(two))] = rng.choice("0123456789")
        a, b = ({x[k : k + 5] for k in range(len(x) - 4)} for x in (one, "".join(two)))
        if 0.80 <= len(a & b) / len(a | b) < 0.81:
            pairs.append((one, "".join(two)))
    x, y = (lines.band_keys(list(side))[0] for side in zip(*pairs, strict=True))
    assert (x == y).any(axis=1).mean() > 0.993


# -- 8


def brute_shard(doc_id, shards):
    def u(s):
        h = 42 if doc_id is None else xxhash.xxh64_intdigest(int(doc_id).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53)

    return min(range(shards), key=u)


def test_sharding(odd, empty):
    got = rows_of(sharding.shard_documents(odd))
    want = Counter()
    for i, t, _ in input_of(odd):
        raw = (t or "").encode()
        want[i, len(raw) + 8, zlib.crc32(raw), "key", brute_shard(i, 24), brute_shard(i, 25)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and sharding.shard_documents(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, rows_of(sharding.shard_documents(odd.repartition(5)))))


def test_weights_share_the_keys(spark):
    n = Counter(r["shard"] for r in sharding.assign(spark.range(20000).withColumnRenamed("id", "key"), "key", [1.0, 3.0]).collect())
    assert n[1] / n[0] == pytest.approx(3, rel=0.1)


# -- all


@pytest.mark.parametrize("f", [packing.packed_documents, mixing.mix_documents, mixing.mixed_documents, edits.fingerprint_documents, edits.fingerprint_classes, media.media_of_documents])
def test_empty_tables_give_no_row(empty, f):
    assert f(empty).count() == 0


def test_pipeline(spark, tmp_path, labelled):
    import corpus_pipeline

    docs, labels = labelled
    docs.drop("shard", "node").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = step.columns
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == names
        step.write.parquet(path := f"{tmp_path}/{f.__name__}")
        step = spark.read.parquet(path)
    want = Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows_of(packing.packed_documents(step)))
    got = Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows_of(corpus_pipeline.run(spark, str(tmp_path))))
    assert got == want and got


def test_groups_of_frequent_keys(spark):
    from folioflow.llm import components as linking

    nodes = spark.range(20000).selectExpr("id AS node", "array(if(id % 3 = 0, -1, id), 100000 + id DIV 2, 200000 + id) AS keys")
    got = {tuple(r) for r in linking._groups(nodes).select("k", "c", "lo", "hi", "x").collect()}
    want: dict[int, list[int]] = {}
    for n in range(20000):
        for k in (-1 if n % 3 == 0 else n, 100000 + n // 2, 200000 + n):
            want.setdefault(k, []).append(n)
    expected = set()
    for k, found in want.items():
        if len(found) > 1:
            x = 0
            for n in found:
                x ^= n
            expected.add((k, len(found), min(found), max(found), x))
    assert got == expected
