"""The ten operators against brute force, and their defined results for odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers

from twofold.llm import bpe, components, decontaminate, licenses, lm, mixing, quality, simhash, suffix, toxicity, weaklabel
from twofold.llm.eliasfano import EliasFano

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, row string, a long, words string, cell int, done int"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "house", "river", "élan", "日本", "x9", "Stone", "moon,", "a.\nThe", "sky"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.replace("house", "boat", 1)
    passage = words(rng, 60)
    out = {
        1: base, 2: near, 3: base, 4: None, 5: "", 6: " \t\n ", 7: "one", 8: words(rng, 30) + " " + passage, 9: passage + " " + words(rng, 25),
        10: "ab " * 400, 11: words(rng, 6000), 12: "z" * 5000, 13: "Licensed under CC BY-NC 4.0.\n" + words(rng, 40), 14: words(rng, 40) + "\nAll rights reserved.",
        15: "cc by general PUBLIC license all rights reserved cc by", 16: "!!! ### $$$", 17: "line one\nline one\n\nline one\nother",
    }
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, "r", 1, "w", 2, 3) for k, t in texts.items()]
    return spark.createDataFrame(rows + [rows[0]], SCHEMA).cache()  # one row twice


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def b(text):
    return (text or "").encode()


def by_id(table):
    return {r["doc_id"]: r for r in table.collect()}


def test_quality(docs, texts, nothing):
    rows = by_id(quality.quality_metrics(docs, PIECES, BYTES))
    assert len(rows) == len(texts)
    for k, t in texts.items():
        ws = re.findall(rb"[^\x20\x09-\x0D]+", b(t))
        grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        hit = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in b(t).split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
        want = (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs, PIECES, BYTES)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if r["kept"]}
    assert quality.quality_metrics(nothing, PIECES, BYTES).count() == 0


def test_entropy_is_over_the_byte_tokens(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    # the first article of the Universal Declaration of Human Rights in Amharic, and words of mixed scripts
    texts = {
        1: "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል።",
        2: "the house ነጻና moon 😀 river x9 sky ûɐ stone of and ልጅ 日本 a",
    }
    rows = by_id(quality.quality_metrics(spark.createDataFrame([(k, t, None) for k, t in texts.items()], "doc_id long, text string, lang string"), PIECES, BYTES))
    for k, t in texts.items():
        tokens = [i for w in t.split() for i in lib.encode(w)]
        n, shares = len(tokens), [c / len(tokens) for c in Counter(tokens).values()]
        want = -sum(p * math.log2(p) for p in shares) / math.log2(n)
        assert rows[k]["entropy_ratio"] == pytest.approx(want, abs=1e-9)
    assert rows[1]["band"] == "*" and rows[1]["fallback_share"] > 0.5 and rows[1]["kept"]


def test_token_counts(docs, texts, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = by_id(bpe.token_counts(docs, PIECES, limit=100))
    for k, t in texts.items():
        n = len(lib.encode(t or ""))
        assert (rows[k]["n_tokens"], rows[k]["n_bytes"], rows[k]["over_limit"]) == (n, len(b(t)), n > 100)
    odd = ["  a  b ", "▁x <s></s><unk><0x0A>", "😀\x00\n\n\t", "a" * 300, " " * 70, "日本語ñ　ﬁ"]
    assert bpe.TokenCounter(bpe.piece_model(PIECES))(odd) == [len(lib.encode(t)) for t in odd]
    assert bpe.token_counts(nothing, PIECES).count() == 0


def test_unbroken_text(spark):
    """Words without spaces: equal to the library, and no round for each merge."""
    import time

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = bpe.piece_model(PIECES)
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    runs = [
        "".join(rng.choice(letters) for _ in range(6000)), "thequickbrownfoxjumpsoverthelazydog" * 200, "ab" * 5000, "a" * 4001, " " * 3001,
        "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4000)), "".join(rng.choice("aeinrst") for _ in range(6000)), "=" * 1000 + "-" * 999, "인권" * 900,
    ]
    runs += ["".join(rng.choice("thenrais ▁") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    assert bpe.TokenCounter(model)(runs) == [len(lib.encode(t)) for t in runs]
    began = time.perf_counter()
    for text in ("".join(rng.choice(letters) for _ in range(1 << 20)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1 << 18)), "abcd" * (1 << 18)):
        assert bpe.TokenCounter(model)([text]) == [len(lib.encode(text))]
    assert time.perf_counter() - began < 60
    long = spark.createDataFrame([(1, runs[0] * 20, "en"), (2, runs[5] * 50, None)], "doc_id long, text string, lang string")
    assert quality.quality_metrics(long, PIECES, BYTES).count() == 2


# the first article of the Universal Declaration of Human Rights
ARTICLES = {
    "Hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "*": "มนุษย์ทั้งหลายเกิดมามีอิสระ และ เสมอภาคกัน ใน เกียรติศักด และ สิทธิ ต่างมี เหตุผล และ มโนธรรม และ ควร ปฏิบัติ ต่อกัน ด้วย เจตนารมณ์ แห่ง ภราดรภาพ",
    "Cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Latin": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
}


def test_prose_of_all_scripts_is_kept(spark):
    rng = random.Random(15)
    rows, want = [], {}
    for k, (band, text) in enumerate(ARTICLES.items()):
        ws = text.split()
        for j, n in enumerate((0, 300, 5000)):  # the article, and longer texts of its words
            rows.append((10 * k + j, text if not n else " ".join(rng.choice(ws) for _ in range(n)), None))
            want[10 * k + j] = band
    for j, (low, high) in enumerate(((0x1200, 0x1300), (0xAC00, 0xD7A0), (0x3041, 0x3097), (0x0905, 0x0939))):
        rows.append((100 + j, " ".join("".join(chr(rng.randrange(low, high)) for _ in range(rng.randrange(2, 6))) for _ in range(200)), None))
    found = by_id(quality.quality_metrics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, BYTES))
    assert {k: found[k]["band"] for k in want} == want
    assert [(k, r["band"], r["entropy_ratio"], r["fallback_share"]) for k, r in found.items() if not r["kept"] and not r["base_failed"]] == []
    junk = spark.createDataFrame([(1, "xx " * 11, "en"), (2, "qzxkvj" * 400 + " a b c d e f g h i j k", "en"), (3, "# $ % & * | < > @ ! " * 3, "en")], "doc_id long, text string, lang string")
    assert not any(r["kept"] for r in quality.quality_metrics(junk, PIECES, BYTES).collect())


def test_fertility_against_the_libraries(spark, docs, texts):
    import sentencepiece

    lib, encoding = sentencepiece.SentencePieceProcessor(model_file=PIECES), quality.byte_encoding(BYTES)
    rows = by_id(quality.quality_metrics(docs, PIECES, BYTES))
    for k, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tokens = [i for w in ws for i in lib.encode(w)]
        chars = sum(map(len, ws))
        pieces = chars / len(tokens) if tokens else 0.0
        share = sum(map(lib.is_byte, tokens)) / len(tokens) if tokens else 0.0
        n_bytes = sum(len(encoding.encode_ordinary(" " + w)) if len(w) <= 256 else sum(len(encoding.encode_ordinary(w[i : i + 256])) for i in range(0, len(w), 256)) for w in ws)
        shares = [c / len(tokens) for c in Counter(tokens).values()]
        ratio = -sum(p * math.log2(p) for p in shares) / math.log2(min(len(tokens), 1024)) if len(tokens) > 1 else 1.0
        r = rows[k]
        assert (r["chars_per_token"], r["fallback_share"], r["entropy_ratio"], r["chars_per_byte_token"]) == pytest.approx((pieces, share, ratio, chars / max(n_bytes, 1)), abs=1e-9)
        low, high, most, least, least_byte = quality.BANDS[r["band"]]
        assert r["kept"] == (not r["base_failed"] and low <= pieces <= high and share <= most and ratio >= least and chars / max(n_bytes, 1) >= least_byte)


def fingerprint(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", b(text).lower())
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(fps):
    root = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                if (fps[x] ^ fps[y]).bit_count() <= 2 and root[x] != root[y]:
                    root[x] = root[y] = min(root[x], root[y])
                    changed = True
    return root


def test_simhash(spark, docs, texts, nothing):
    got = by_id(simhash.near_duplicate_groups(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id"))
    fps = {k: fingerprint(t) for k, t in texts.items()}
    assert {k: r["h"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r["component_id"] for k, r in got.items()} == brute_components(fps)
    assert simhash.near_duplicate_groups(nothing).count() == 0


@pytest.mark.parametrize(("segments", "cell"), [(2, 64), (2, 2), (4, 0)])
def test_links_join_all_that_differ_by_two_bits(spark, segments, cell):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {k: base[k % 6] ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for k in range(80)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in fps.values()]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), segments, cell).collect()
    every = {x for x, in signed}
    near = {(x, y) for x in every for y in every if x > y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
    assert len(found) == len(near) and {(r["a"], r["b"]) for r in found} == near
    if segments != 2 or cell != 64:
        return
    node = components.components(simhash.links(spark.createDataFrame(signed, "fp long")), "a", "b")
    root = {r["node"]: r["root"] for r in node.collect()}
    group = {k: root.get(s[0], s[0]) for (k, s) in zip(fps, signed, strict=True)}
    want = brute_components(fps)
    for x in fps:
        for y in fps:
            assert (group[x] == group[y]) == (want[x] == want[y])


def test_segments_change_the_tables(spark):
    one = spark.createDataFrame([(5,)], "fp long")
    sizes = [tuple(t.count() for t in simhash.segment_tables(one, m)) for m in (1, 2, 4)]
    assert sizes == [(1, 1 + 64 + 64 * 63 // 2), (2, 1 + 32 + 1), (3, 3)]
    assert [simhash.radii(m) for m in (1, 2, 3, 4)] == [[2], [1, 0], [0, 0, 0], [0, 0, 0, -1]]


def test_components_of_stars(spark):
    rng = random.Random(16)
    edges = [(5000, i) for i in range(1, 900)] + [(0, i) for i in range(900, 1700)] + [(i, i + 1) for i in range(6000, 6040)] + [(3, 3), (7, 1200)]
    edges += [(rng.randrange(8000, 8100), rng.randrange(8000, 8100)) for _ in range(60)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for x, y in edges:
            if root[x] != root[y]:
                root[x] = root[y] = min(root[x], root[y])
                changed = True
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_keep_first_of_groups(spark):
    rng = random.Random(17)
    a, other = (" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(2))
    near = other + " more"
    rows = [(1, a, "x", 1), (2, a, "y", 2), (2, other, "z", 3), (3, near, "z", 4), (4, None, None, 5), (5, "", "e", 6), (None, "no id here at all", "n", 7), (None, "quite another text", "n", 8)]
    rows += [(1, a, "x", 1), (9, "once more with feeling", "s", 9), (9, "once more with feeling", "t", 10), (10, " ".join([a] * 60), "long", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, `a.b` long").repartition(3)
    out = simhash.keep_first_of_groups(docs)
    assert out.dtypes == docs.dtypes
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, a), (2, other), (4, None), (None, "no id here at all"), (None, "quite another text"), (9, "once more with feeling"), (10, " ".join([a] * 60))]
    # the long text repeats the first one's shingles, and is its copy as a set
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    x, y = grams(a), grams(want[-1][1])
    if len(x & y) >= 0.8 * len(x | y):
        want.pop()
    assert got == sorted(want, key=str)
    assert simhash.keep_first_of_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("places", [simhash.SIEVE, 1 << 8])
def test_sieve_loses_no_row(spark, monkeypatch, places):
    monkeypatch.setattr(simhash, "SIEVE", places)
    rows = [(None if i == 5 else i % 700, bytes([i % 7])) for i in range(1500)]
    every = spark.createDataFrame(rows, "doc_id long, tag binary")
    keys = {(None, bytes([5])), *rows[100:160], *rows[900:930]}
    found = simhash.sifted(every, spark.createDataFrame(list(keys), "doc_id long, tag binary")).collect()
    assert sorted(map(str, rows)) == sorted(str((r["doc_id"], bytes(r["tag"]))) for r in found)
    doubt = [(r["doc_id"], bytes(r["tag"])) for r in found if r["maybe"]]
    assert keys <= set(doubt)
    if places == simhash.SIEVE and places > 1 << 8:
        assert set(doubt) == keys
    none = simhash.sifted(every, every.limit(0))
    assert none.where("maybe").count() == 0 and none.count() == len(rows)


def test_crowded_cells_of_near_copies(spark):
    rng = random.Random(18)
    common = [f"c{rng.randrange(900)}" for _ in range(200)]
    texts = {}
    for g in range(40):  # all share a long passage, few are near copies
        base = common + [f"w{rng.randrange(5000)}" for _ in range(150)]
        copy = list(base)
        copy[rng.randrange(350)] = "new"
        texts[g], texts[1000 + g] = " ".join(base), " ".join(copy)
    source = [f"s{rng.randrange(5000)}" for _ in range(150)]
    for g in range(200):  # a crowd of copies of one text, with few to many edits, some of them edited again or cut
        copy = list(source)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = f"e{rng.randrange(5000)}"
        texts[2000 + g] = " ".join(copy)
        if g % 3 == 0:
            copy[rng.randrange(len(copy))] = "again"
            texts[3000 + g] = " ".join(copy[rng.randrange(12) :])
    found = {r["doc_id"]: r["component_id"] for r in simhash.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = groups_of(near_pairs(texts), texts)
    assert len(set(want.values())) > 60
    assert found == want


def test_first_of_groups(spark, docs):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for k in range(5):
            text = list(base)
            for _ in range(k % 3):
                text[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(text)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[k] == k // 100 * 100 for k, _ in rows) >= 0.95 * len(rows)
    assert all(found[k] // 100 == k // 100 for k, _ in rows)
    odd = {r["doc_id"]: r["component_id"] for r in simhash.first_of_groups(docs).collect()}
    assert odd[3] == 1 and odd[5] == odd[6] == 4 and odd[8] == 8 and odd[11] == 11


def test_near_copies_in_a_crowd_are_all_found(spark):
    rng = random.Random(8)
    texts = {}
    for g in range(60):  # long texts over one small vocabulary: alike in their words, not in their shingles
        base = [f"w{rng.randrange(400)}" for _ in range(4000)]
        copy = list(base)
        for _ in range(20):
            copy[rng.randrange(4000)] = f"w{rng.randrange(400)}"
        texts[g], texts[1000 + g] = " ".join(base), " ".join(copy)
    found = simhash.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: k % 1000 for k in texts}


def near_pairs(texts, least=0.8):
    """Pairs of ids whose five-word shingles have that Jaccard similarity, by comparing all."""
    sets = {}
    for k, t in texts.items():
        ws = b(t).lower().split()
        sets[k] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}
    return {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y])}


def edited(rng, n, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    copy = list(base)
    for i in rng.sample(range(n), changes):
        copy[i] = f"x{rng.randrange(10**6)}"
    return " ".join(base), " ".join(copy)


def test_near_copies_of_all_sizes_are_found(spark):
    rng = random.Random(12)
    texts = {}
    for g in range(150):
        n = rng.choice([30, 50, 80, 150])
        texts[g], texts[1000 + g] = edited(rng, n, max(1, n // 50))
    near = near_pairs(texts)
    assert len(near) > 100
    found = {r["doc_id"]: r["component_id"] for r in simhash.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [p for p in near if found[p[0]] != found[p[1]]] == []


def groups_of(pairs, ids):
    root = {k: k for k in ids}
    for _ in ids:
        before = dict(root)
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
        if root == before:
            break
    return root


def test_near_copies_come_from_fingerprints(spark):
    """The near-dedup's links of texts that share no min-hash key come from SimHash, verified on whole shingle sets."""
    rng = random.Random(21)
    texts = {}
    for g in range(60):
        texts[2 * g], texts[2 * g + 1] = edited(rng, 1500, 1 + g % 3)
    grams = {k: simhash.gram_hashes(b(t)) for k, t in texts.items()}
    fps = {k: simhash.majority_bits(x) for k, x in grams.items()}
    rows = [(k, (False, k, hashlib.md5(b(t)).digest()), simhash.signed(fps[k]), [k]) for k, t in texts.items()]
    nodes = spark.createDataFrame(rows, "num long, one struct<none: boolean, doc_id: long, tag: binary>, fp long, bands array<long>")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = []
    found = {(r["a"], r["b"]) for r in simhash.near_links(nodes, docs, 0.8, made).collect()}
    near = {(max(x, y), min(x, y)) for x, y in near_pairs(texts) if (fps[x] ^ fps[y]).bit_count() <= 2}
    assert len(near) > 10 and {(max(p), min(p)) for p in found} == near
    signed = simhash.set_signatures(docs).collect()
    assert {r["doc_id"]: r["fp"] for r in signed} == {k: simhash.signed(x) for k, x in fps.items()}


def test_near_copies_are_verified_on_whole_texts(spark):
    rng = random.Random(13)
    texts = {}
    for g in range(200):
        n = rng.randrange(100, 500)
        texts[g], texts[1000 + g] = edited(rng, n, rng.randrange(n // 55, n // 35 + 1))  # similarities of about 0.75 to 0.85
    near = near_pairs(texts)
    assert 40 < len(near) < 160
    found = {r["doc_id"]: r["component_id"] for r in simhash.first_of_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == groups_of(near, texts)


def brute_cut(texts, length):
    seen, out = set(), {}
    for k in sorted(texts):
        t = b(texts[k])
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        out[k] = gone
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup(spark, docs, texts, nothing, hot):
    rng = random.Random(5)
    bits = [words(rng, rng.randint(8, 80)) for _ in range(10)]
    more = dict(texts) | {100 + i: " ".join(rng.choice(bits)[rng.randint(0, 30) :] for _ in range(3)) for i in range(25)}
    frame = spark.createDataFrame([(k, t) for k, t in more.items()], "doc_id long, text string").repartition(5)
    rows = by_id(suffix.deduplicate(frame, hot=hot))
    for k, gone in brute_cut(more, 100).items():
        left = bytes(np.frombuffer(b(more[k]), np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        r = rows[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == (len(gone), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    odd = docs.withColumns({"a.b": F.lit(4), "doc": F.lit(5)})
    twice = [r for r in suffix.deduplicate(odd, rest=["row", "a", "a.b", "doc"]).collect() if r["doc_id"] == 1]
    assert twice[0]["rest"]["a.b"] == 4 and twice[0]["rest"]["doc"] == 5
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_removed"] == 0 and twice[0]["rest"]["row"] == "r"
    assert suffix.deduplicate(nothing, hot=hot).count() == 0


def test_maximal_repeats_hold_all_occurrences():
    text = b"xABCDEFGHIJKLy" + b"qABCDEFGHIJKLw" + b"pABCDEFGHIJKLz"
    zero = np.zeros(1, dtype=np.int64)
    found = suffix.repeats_of(zero, zero, zero, zero, [text], 8)
    assert list(zip(found[2].tolist(), found[3].tolist(), strict=True)) == [(15, 27), (29, 41)]


def full_scan(rows, items):
    """Rows of `leaks` by looking at every window of every text for every item."""
    stats = decontaminate.Stats.of([(i, t) for i, t in items if t])
    out = {}
    for k, text in rows:
        ws = decontaminate.words_of(text or "")
        for i, t in items:
            own = decontaminate.words_of(t or "")
            if not own:
                continue
            parts, width = decontaminate.item_parts(t), decontaminate.passage_width(len(own))
            impact = stats.impacts(Counter(own))
            for a in range(0, len(ws), width // 4):
                window = ws[a : a + width]
                q, w = (share(p, window) for p in parts)
                if q >= 0.8 and w >= 0.8:
                    score = sum(impact[x] for x in own_terms(own, window))
                    n, first, best, bq, bw = out.get((k, i), (0, a, 0.0, 0.0, 0.0))
                    out[k, i] = (n + 1, first, max(best, score), max(bq, q), max(bw, w))
    return out


def own_terms(own, window):
    return set(own) & set(window)


def share(part, ws):
    n = min(5, len(part))
    own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    have = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    return len(own & have) / len(own) if own else 1.0


def leak_rows(table):
    return {(r["doc_id"], r["item_id"]): (r["n_passages"], r["first_word"], round(r["score"], 9), round(r["question_overlap"], 9), round(r["answer_overlap"], 9)) for r in table.collect()}


def test_decontamination(spark, docs, texts, nothing):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 150)))) for i in range(70)] + [(900, None), (901, ""), (902, "What is the x? Moon"), (903, "Who? Me"), (3, "one two three? four")]
    shared = [rng.choice(vocabulary) for _ in range(45)]
    items += [(1000 + i, " ".join([*shared, f"own{i}", f"last{i}"])) for i in range(60)]
    rows = []
    for k in range(120):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(5, 400))]
        if k % 2 == 0:
            part = items[rng.randrange(len(items))]
            own = (part[1] or "").upper().split()
            for _ in range(rng.randrange(4)):  # some words are changed, some lost at the ends
                if own:
                    own[rng.randrange(len(own))] = "changed"
            own = own[rng.randrange(3) : len(own) - rng.randrange(3)]
            at = rng.randrange(len(t))
            t[at:at] = own
        rows.append((k, " ".join(t)))
    rows += [(500, " ".join(shared[1:] + ["own7", "last7"])), (501, None), (502, ""), (503, "who me"), (504, " ".join([rows[0][1]] * 30))]
    want = {k: (n, first, round(s, 9), round(q, 9), round(w, 9)) for k, (n, first, s, q, w) in full_scan(rows, items).items()}
    assert len(want) > 60 and any(k == 500 for k, _ in want)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert leak_rows(decontaminate.leaks(frame, bench)) == want
    assert leak_rows(decontaminate.leaks(frame, bench, block_bytes=3000)) == want  # some items a block
    few = [x for x in items if x[0] < 5 or x[0] > 1054 or x[0] in (900, 1007)]  # an item a block
    want_few = {k: (n, first, round(s, 9), round(q, 9), round(w, 9)) for k, (n, first, s, q, w) in full_scan(rows, few).items()}
    assert leak_rows(decontaminate.leaks(frame, spark.createDataFrame(few, "item_id long, text string"), block_bytes=1)) == want_few
    kept = decontaminate.clean(frame.selectExpr("*", "1 as item_id", "2 as df", "3 as score"), bench)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in want}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(nothing, bench).count() == 0


def test_a_larger_benchmark_hides_no_item():
    """An item that shares 45 words with others is found by its overlap, however many share them and however blocks are cut."""
    rng = random.Random(19)
    shared = [f"w{i}" for i in range(45)]
    items = [(i, " ".join([*shared, f"id{i}?", *(f"a{rng.randrange(50)}" for _ in range(6))])) for i in range(200)]
    words = decontaminate.words_of(items[0][1])
    text = [f"x{i}" for i in range(30)] + shared + ["changed"] + words[46:] + [f"y{i}" for i in range(30)]
    stats = decontaminate.Stats.of(items)
    for block in (items[:1], items[:10], items):
        found = decontaminate.ItemIndex(block, stats).search([text])[0]
        assert found[0][0] == 0 and found[0][4:] == (pytest.approx(41 / 42), 1.0)
        assert found[0] == decontaminate.ItemIndex(items, stats).search([text])[0][0]


def test_retrieval_loses_no_item():
    rng = random.Random(2)
    items = [(i, " ".join(f"t{int(rng.random() ** 2 * 300)}" for _ in range(rng.randint(10, 30)))) for i in range(300)]
    index = decontaminate.ItemIndex(items, decontaminate.Stats.of(items))
    (lists,) = index.classes
    impact = [{} for _ in items]
    for t, j, x in zip(lists.term_of, lists.items, lists.impact, strict=True):
        impact[j][int(t)] = x
    some = 0
    for _ in range(80):
        text = [f"t{int(rng.random() ** 2 * 300)}" for _ in range(40)] + items[rng.randrange(300)][1].split()[:20]
        nums = index.numbers(text)
        have = sorted(set(nums[nums >= 0].tolist()))
        got = lists.retrieve(have)
        want = {j: sum(x for t, x in w.items() if t in have) for j, w in enumerate(impact)}
        want = {j: x for j, x in want.items() if x >= 1 - 1e-9}
        assert dict(got) == pytest.approx(want) and len(got) == len(want)
        some += len(want)
        cells = np.arange(len(nums)) // (len(nums) // 4 + 1) + 4
        assert not want or lists.passages(nums, cells).size
    assert some > 20


def test_licenses(docs, texts, nothing):
    rows = by_id(licenses.license_scan(docs))
    for k, t in texts.items():
        low = b(t).decode().translate(str.maketrans(licenses.UPPER, licenses.LOWER))
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = {p: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()] for p in licenses.BASE}
        every = [i for x in places.values() for i in x]
        r = rows[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(every), min(every, default=None), max(every, default=None))
        assert r["base_labels"] == ",".join(sorted(licenses.BASE[p] for p, x in places.items() if x))
    assert rows[13]["labels"] == "cc-by,cc-by-nc" and rows[13]["score"] == 1.0 and rows[11]["labels"] == ""
    assert licenses.license_scan(nothing).count() == 0
    plan = licenses.license_scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_weak_labels(spark, docs, nothing):
    rng = random.Random(4)
    true = [rng.random() < 0.7 for _ in range(4000)]
    right = [0.95, 0.9, 0.8, 0.7, 0.9]
    patterns = Counter("".join("2" if rng.random() < 0.2 else str(int(t if rng.random() < a else not t)) for a in right) for t in true)
    names = sorted(patterns)
    _, rates, prior = weaklabel.estimate(names, np.array([patterns[n] for n in names], dtype=float))
    assert abs(prior - 0.7) < 0.05
    for j, a in enumerate(right):
        assert abs(rates[1, j, 1] - a) < 0.06 and abs(rates[0, j, 0] - a) < 0.1
    rows = by_id(weaklabel.weak_quality(docs, train_docs=10))
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[1]["score"] == rows[3]["score"]
    assert weaklabel.weak_quality(nothing).count() == 0


def test_weak_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = weaklabel.weak_quality(docs).join(labels, "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in scored if r["quality"] == 1]
    bad = [r["kept"] for r in scored if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_weak_labels_against_a_plain_reimplementation(spark, docs, texts):
    """Patterns, posteriors by EM over single documents, weights by dense gradient steps in the same order, scores and verdicts."""
    got = by_id(weaklabel.weak_quality(docs, train_docs=40))
    plain = {}
    for k, t in texts.items():
        ws = b(t).split()
        plain[k] = "".join(map(str, weaklabel.votes(b(t), ws, np.array([ws.index(w) for w in ws], dtype=np.int64))))
        assert got[k]["pattern"] == plain[k]
    rows = [k for k in texts] + [1]  # one row twice
    v = [[int(c) for c in plain[k]] for k in rows]
    post = [(x.count(1) + 1) / (x.count(1) + 3 * x.count(0) + 2) for x in v]
    for _ in range(200):
        prior = (sum(post) + 1) / (len(v) + 2)
        rates = []
        for c in (0, 1):
            weight = [p if c else 1 - p for p in post]
            sums = [[0.5 + sum(w for w, x in zip(weight, v, strict=True) if x[j] == k) for k in (0, 1)] for j in range(len(v[0]))]
            rates.append([[s[0] / sum(s), s[1] / sum(s)] for s in sums])
        like = [[(prior if c else 1 - prior) * math.prod(rates[c][j][k] for j, k in enumerate(x) if k != 2) for c in (0, 1)] for x in v]
        post = [g / (g + h) for h, g in like]
    posterior = dict(zip(rows, post, strict=True))
    features = {}
    for k, t in texts.items():
        ws, f = b(t).split(), Counter()
        for w in ws:
            f[weaklabel.slot(w.lower(), 1)] += 1 / len(ws)
            f[weaklabel.slot(weaklabel.shape(w), 2)] += 1 / len(ws)
        if ws:
            low = [w.lower() for w in ws]
            f[weaklabel.slot(b"n%d" % (len(ws) + 1).bit_length(), 3)] += 1
            f[weaklabel.slot(b"v%d" % (10 * len(set(low)) // len(ws)), 3)] += 1
            f[weaklabel.slot(b"s%d" % min(50 * sum(x == y for x, y in zip(low, low[1:], strict=False)) // len(ws), 9), 3)] += 1
        features[k] = f
    hashed = spark.createDataFrame([(k,) for k in texts], "k long").select("k", F.xxhash64("k")).collect()
    order = sorted(rows, key=dict(map(tuple, hashed)).get)
    w, g2, bias, bias2 = Counter(), Counter(), 0.0, 1e-6
    for _ in range(weaklabel.EPOCHS):
        for k in order:
            f = features[k]
            err = 1 / (1 + math.exp(-(sum(w[d] * x for d, x in f.items()) + bias))) - posterior[k]
            for d, x in f.items():
                step = err * x + weaklabel.L2 * w[d]
                g2[d] += step**2
                w[d] -= weaklabel.RATE * step / math.sqrt(g2[d] + 1e-6)
            bias2 += err**2
            bias -= weaklabel.RATE * err / math.sqrt(bias2)
    for k, r in got.items():
        want = 1 / (1 + math.exp(-(sum(w[d] * x for d, x in features[k].items()) + bias)))
        assert r["posterior"] == pytest.approx(posterior[k], abs=1e-5)
        assert r["score"] == pytest.approx(want, abs=1e-4) and r["kept"] == (r["score"] >= 0.8)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 5), (1000, 1001), (1000, 1 << 48), (20000, 1 << 40), (5000, 35000), (9000, 40), (4, 1 << 62)):
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano.build(v, top)
        assert (ef.access(np.arange(n)) == v).all()
        if n > 1:
            a, z = ef.access_two(np.arange(n - 1))
            assert (a == v[:-1]).all() and (z == v[1:]).all()
        q = np.r_[rng.integers(0, top, 300).astype(np.uint64), v[:300]]
        at, hit = ef.successor(q)
        assert (hit == np.isin(q, v)).all() and (not hit.any() or (v[at[hit]] == q[hit]).all())


def brute_lm(copies):
    """(score of a token list, base log10 of a token, tokens, count of a token) of a trigram model by plain dictionaries."""
    toks = lambda t: b(t).lower().split() + [None]
    uni, pair, triple = Counter(), Counter(), Counter()
    for k, t in copies:
        if zlib.crc32(str(k).encode()) % 10:
            ws = toks(t)
            uni.update(ws)
            pair.update(zip([0, *ws], ws, strict=False))
            triple.update(zip([0, *ws], ws, ws[1:], strict=False))
    total, size, n_texts = sum(uni.values()), len(uni), uni[None]
    after, after2 = Counter(x for x, _ in pair), Counter(x[:2] for x in triple)
    d = lm.DISCOUNT

    def score(ws):
        out = 0.0
        for i, w in enumerate(ws):
            p = (uni[w] + 0.1) / (total + 0.1 * (size + 1))
            x = ws[i - 1] if i else 0
            of = uni[x] if i else n_texts
            if after[x]:
                p = max(pair[x, w] - d, 0) / of + d * after[x] / of * p
            if i:
                y = ws[i - 2] if i > 1 else 0
                if after2[y, x]:
                    p = max(triple[y, x, w] - d, 0) / pair[y, x] + d * after2[y, x] / pair[y, x] * p
            out += math.log10(p)
        return out

    return score, lambda w: math.log10((uni[w] + 0.1) / (total + 0.1 * (size + 1))), total, uni


@pytest.mark.parametrize("shard_tokens", [lm.SHARD_TOKENS, 200])
def test_lm(spark, docs, texts, nothing, shard_tokens):
    out = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    rng = random.Random(20)
    more = {1000 + i: " ".join(rng.choice(["of", "the", "of the", "a", "b c", "d", f"r{rng.randrange(300)}"]) for _ in range(rng.randrange(1, 60))) for i in range(60)}
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string")).repartition(4)
    rows = by_id(lm.scores(frame, shard_tokens=shard_tokens))
    score, base, total, uni = brute_lm([*texts.items(), (1, texts[1]), *more.items()])
    for k, t in (texts | more).items():
        ws = b(t).lower().split() + [None]
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(k), len(ws), sum(uni[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(map(base, ws))) and abs(r["score"] - score(ws)) <= 3e-4 * len(ws)
    if shard_tokens == lm.SHARD_TOKENS:
        assert lm.scores(nothing).count() == 0
        none = lm.scores(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0))
        assert {r["train_tokens"] for r in none.collect()} <= {0}


def test_lm_without_a_file_path(spark, texts, monkeypatch):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near = {k: r["score"] for k, r in by_id(lm.scores(frame)).items()}
    monkeypatch.setattr(lm.Store, "new", classmethod(lambda cls, spark: cls(None)))
    assert {k: r["score"] for k, r in by_id(lm.scores(frame)).items()} == near


def test_hot_contexts_are_split(spark):
    """A pair that is a third of all tokens lies in several ranges, and scores as by dictionaries."""
    rng = random.Random(21)
    texts = {i: " ".join(f"hot pair x{rng.randrange(4000)}" for _ in range(60)) for i in range(50)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = lm.train(frame, shard_tokens=500)
    assert model[2].carried and model[2].left and model[2].followers
    score, *_ = brute_lm(texts.items())
    for k, r in by_id(lm.scores(frame, shard_tokens=500)).items():
        ws = b(texts[k]).lower().split() + [None]
        assert abs(r["score"] - score(ws)) <= 3e-4 * len(ws)


def test_toxicity(spark, docs, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = toxicity.toxicity(real, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r["toxic"] == r["predicted"] for r in scored) / len(scored) > 0.85
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 1), (None, 0), (11, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, odd).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in toxicity.toxicity(docs, odd.limit(0)).collect()} == {0}
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_nearest_examples_are_exact():
    rng = random.Random(6)
    bag = lambda: Counter(f"=w{rng.randrange(60)}" for _ in range(rng.randint(1, 9)))
    rows = [(i, rng.randrange(2), bag()) for i in range(600)]
    weight_of = {f"=w{i}": 1.0 + i / 60 for i in range(60)}
    share = {0: 1.0, 1: 3.0}
    index = toxicity.Index(rows, share, weight_of, nearest=7)
    entries = {}
    for i, y, x in rows:
        entries.setdefault(index.vector(x), []).append((i, y))
    for _ in range(100):
        own = bag()
        vec = index.vector(own)
        where, cos = index.search(*index.arrays(vec))
        every = sorted(((-round(sum(q * dict(v).get(t, 0.0) for t, q in vec), 9), min(es)[0], es) for v, es in entries.items()))
        every = [x for x in every if x[0] < 0][:7]
        assert [round(c, 9) for c in cos] == pytest.approx([-c for c, _, _ in every], abs=2e-9)
        yes = no = 0.0
        for c, _, es in every:
            votes = [sum(share[y] for _, y in es if y == k) for k in (0, 1)]
            no, yes = (s + c**4 * v / max(sum(votes), 1.0) ** 0.5 for s, v in zip((no, yes), votes, strict=True))
        raw = (yes + toxicity.PRIOR * toxicity.PRIOR_WEIGHT) / (yes + no + toxicity.PRIOR_WEIGHT)
        assert index.score(*index.arrays(own))[0] == pytest.approx(raw, abs=1e-6)
        if len({round(c, 9) for c in cos}) == len(cos):
            assert index.first[where].tolist() == [i for _, i, _ in every]


def test_scores_are_calibrated(spark):
    """Held-out labels by bins of the score: where a bin has many rows, its share of toxic ones is near its mean score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    both = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    gap = 0.0
    for k in range(5):
        mine = [r for r in both if k / 5 <= r["score"] < (k + 1) / 5 + (k == 4)]
        if mine:
            gap += abs(sum(r["score"] for r in mine) - sum(r["toxic"] for r in mine))
    assert gap / len(both) < 0.08
    assert sum(r["toxic"] == r["predicted"] for r in both) / len(both) > 0.93


def test_mixing(spark, docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    cells = [("a", "x", "t", 100.0), ("a", "y", "t", 300.0), ("b", "x", "u", 500.0), ("b", "y", "u", 100.0)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 0.5, "u": 0.5}}
    p = mixing.rake(cells, targets, 0.2, 40)
    kept = p * np.array([c[3] for c in cells])
    assert kept[:2].sum() == pytest.approx(100, abs=1e-3) and kept[[0, 2]].sum() == pytest.approx(100, abs=1e-3) and (p <= 1).all()
    near, far = ({(r["doc_id"], round(r["_probability"], 9), r["_sampled"]) for r in mixing.mix(docs, max_driver_cells=n, rounds=3).collect()} for n in (1000, 0))
    assert near == far
    assert mixing.mix(nothing).count() == 0
    clash = docs.select("*", F.lit(1).alias("_tokens"), F.lit(2).alias("_CELL"), F.lit(3).alias("topic"), F.lit(4).alias("a.b"))
    rows = mixing.mix(clash).collect()
    assert {(r["doc_id"], round(r["_probability"], 9), r["_sampled"]) for r in mixing.mix(docs).collect()} == {
        (r["doc_id"], round(r["_probability"], 9), r["_sampled"]) for r in rows
    }
    assert all(r["topic"] == 3 and r["a.b"] == 4 for r in rows) and len({r["_tokens"] for r in rows}) > 5


def test_anchors_are_sent_in_parts(monkeypatch):
    """A task held 262,144 anchors and their sorted copies before it sent any."""
    import pyarrow as pa

    from twofold.llm import suffix

    monkeypatch.setattr(suffix, "SLICE_BYTES", 2000)
    monkeypatch.setattr(suffix, "SENT", 50)
    texts = [" ".join(f"w{i * 977 % 10007}x{j * j % 991}" for j in range(60)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(range(40), pa.int64()), pa.array(texts)], ["doc", "tag", "text"])
    parts = list(suffix.find_anchors(suffix.LENGTH)(iter([batch])))
    owner = suffix.anchors([t.encode() for t in texts])[0]
    assert len(parts) > 1 and sum(p.num_rows for p in parts) <= len(owner)
    assert set(np.concatenate([p.column(2).to_numpy() for p in parts])) == set(owner.tolist())
