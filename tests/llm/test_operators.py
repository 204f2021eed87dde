"""Training-data operators on small fixtures: nulls, blanks, repeats, clashing columns, empty tables, against brute force."""

import collections
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from opsloom.llm import licences, packing, privacy, quality, repeats, simhash, tiling, token_files, tokens, toxicity, warc
from opsloom.session import new_path

CLASH = ", _key string, _text string, fp string, key string, places string, term string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
RUN = " ".join(f"r{i}" for i in range(60))
TEXTS = [
    (1, RUN), (2, "x " + RUN + "\ty"), (2, RUN + " again"), (3, None), (4, ""), (5, " \n\t "), (6, "a b " * 120), (7, LONG), (8, "Zé " + LONG),
    (9, RUN), (9, RUN), (None, "q\n" + RUN), (10, "one two three"), (11, "One TWO three"), (12, "\x1c é İΣ 3. don't <|endoftext|> CC BY cc by, mail a@b.co +1 234 567 8901"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["z"] * 6) for i, t in TEXTS], "doc_id long, text string" + CLASH).repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string" + CLASH)


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


# ---------------------------------------------------------------- 1
def fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("how", [{}, {"hot": 0, "block": 2}, {"segments": simhash.WIDE}])
def test_simhash(docs, how):
    got = counted(simhash.near_duplicates(docs, **how).select("doc_id", "fingerprint", "component_id").collect())
    prints = [fingerprint(t) for _, t in TEXTS]
    group = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((TEXTS[i][0] for i in range(len(TEXTS)) if group[i] == g and TEXTS[i][0] is not None), default=None) for g in group}
    assert got == counted((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(TEXTS, prints, group, strict=True))


def test_simhash_dense_group_gives_no_pairs(spark):
    """All 1-bit neighbours of one value: about 2,000 links among 65 fingerprints, one component."""
    near = spark.createDataFrame([(7 ^ (1 << b),) for b in range(63)] + [(7,), (7 | 31 << 40,)], "fp long")
    edges = simhash.connections(near, hot=4, block=16)
    roots = {r.root for r in simhash.components(edges).collect()}
    assert len(roots) == 1


# ---------------------------------------------------------------- 2, 6
def test_licences(docs):
    got = {(r.doc_id, r.n_words): r for r in licences.scan(docs).collect()}
    r = got[(12, 17)] if (12, 17) in got else next(r for (i, _), r in got.items() if i == 12)
    assert (r.n_base, r.base_labels, r.score) == (2, "cc-by", 1.0) and r.first_word < r.last_word
    assert all(r.n_words == 0 and r.first_word is None and r.labels == "" and r.score == 0 for (i, _), r in got.items() if i in (3, 4, 5))


def test_licence_template_threshold(spark):
    d = spark.createDataFrame([(1, "Licensed under the Apache License, version 2"), (2, "licensed under the apache"), (3, "a\nReleased under the MIT License.\nb")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in licences.scan(d).collect()}
    assert got == {1: ("apache-2.0", 0.875), 2: ("", 0.0), 3: ("mit", 1.0)}


def test_wrapped_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided"
    mpl = "x\n# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy"
    deep = "some prose\n" * 40 + "under the GNU Lesser\nGeneral Public\nLicense\n" + "more prose\n" * 40
    one_word = "\n".join(("y " * 50 + "Released under the MIT License. " + "z " * 50).split())
    apart = "redistribution and use in source\n" + "other words\n" * 8 + "and binary forms with or without modification are permitted"
    d = spark.createDataFrame(list(enumerate([bsd, mpl, deep, one_word, apart, "all\n\n\nrights and duties\nreserved"])), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(d).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("mpl-2.0", 1.0), 2: ("gpl,lgpl", 1.0), 3: ("mit", 1.0), 4: ("", 0.0), 5: ("", 0.0)}


def test_quality(docs):
    got = counted(quality.features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, t in TEXTS:
        t = t or ""
        w = WORDS.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == counted(want)


def test_quality_lines(spark):
    prose = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(12))
    menu = "\n".join(f"Home | About | Contact | News {i} |" for i in range(20))
    got = {r.doc_id: r.kept for r in quality.features(spark.createDataFrame([(1, prose), (2, menu), (3, prose + "\n" + menu + "\n" + menu)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


# ---------------------------------------------------------------- 3
def test_repeats(docs):
    none = 1 << 62
    first = {}
    for i, t in TEXTS:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, none), none if i is None else i)
    want = []
    for i, t in TEXTS:
        w = WORDS.findall(t or "")
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (none if i is None else i) for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    assert counted(repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept", "kept_sha256").collect()) == counted(want)


# ---------------------------------------------------------------- 4, 8
@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_token_files(spark, docs, ids):
    folder = new_path(spark, "test-tokens")
    token_files.write(docs, folder)
    got = token_files.read(spark, folder).orderBy("start").collect()
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        own = [*ids(t), 1]
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
        at += len(own)
    assert [tuple(r) for r in got] == want
    assert token_files.document(spark, folder, 11) == [[*ids("One TWO three"), 1]]


def test_packing(docs, ids):
    got = packing.pack_documents(docs).toPandas()
    assert sorted(got[got.piece == 0].doc_id.fillna(-1)) == sorted(-1 if i is None else i for i, _ in TEXTS)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
    assert got.length.sum() == sum(len(ids(t)) + 1 for _, t in TEXTS)
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_local_search_empties_bins():
    rng = np.random.default_rng(1)
    sizes = rng.integers(300, 1400, 400).tolist()
    start, end = packing.best_fit_decreasing(sizes, 2048), packing.pack(sizes)
    assert len(end) <= len(start) and sorted(i for b in end for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in end)


# ---------------------------------------------------------------- 5
def test_tiling(spark):
    item = [f"t{i}" for i in range(30)]
    mixed = " ".join(item[20:] + ["zz"] + item[10:20] + ["yy"] + item[:10])
    d = spark.createDataFrame([(1, "so " + mixed), (2, " ".join(item).upper() + "!"), (3, " ".join(item[:12])), (4, None), (5, ""), (6, "tiny item"), (None, " ".join(item)), (2, "no")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    got = counted(tiling.contaminated(d, b, block_words=8).select("doc_id", "item_id", "n_covered", "n_tiles").collect())
    assert got == counted([(1, 1, 30, 3), (2, 1, 30, 1), (None, 1, 30, 1), (6, 2, 2, 1)])


def test_tiles_do_not_overlap():
    a = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6], np.uint64)
    assert tiling.tile(a, a[:6], 3) == [(6, 0, 0)]


# ---------------------------------------------------------------- 7
def test_warc(spark):
    big, odd = "é" * 80, "a\r\n\r\nb" * 30
    rows = [(1, "u", big), (2, None, big), (1, "u", big), (None, "v", big), (3, "w", None), (4, "w", ""), (5, "x y", odd), (6, "x", odd), (7, "x", "short"), (8, "x", "short")]
    folder = new_path(spark, "test-warc")
    warc.write(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string"), folder)
    records = warc.read(spark, folder)
    assert {(r.page_id, r.payload) for r in records.filter("record_type = 'response'").collect()} == {(1, big), (3, ""), (4, ""), (5, odd), (7, "short"), (8, "short")}
    got = counted(warc.resolved(records).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == counted([(1, 160, "response", None)] * 2 + [(2, 160, "revisit", 1), (None, 160, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 180, "response", None), (6, 180, "revisit", 5), (7, 5, "response", None), (8, 5, "response", None)])


# ---------------------------------------------------------------- 9
def test_toxicity(spark):
    rng = np.random.default_rng(3)
    syllables = np.array(["an", "the", "on", "er", "st", "in", "re", "ti"])
    word = lambda: "".join(rng.choice(syllables, 3))
    rows = [(i, " ".join([word() for _ in range(60)] + ["vilex" + word() for _ in range(3 * (i % 5 == 0))]), int(i % 5 == 0)) for i in range(600)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (9001, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert held and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert 0 <= got[9000].score <= 1 and got[9000].predicted == 0 and got[None].score == got[9000].score


# ---------------------------------------------------------------- 10
def test_privacy_patterns(spark):
    text = "é a@b.c_d@e.f.g ip 1.2.3.4.5.6.7.8 999.1.1.1 007.255.0.1 +1 (234) 555-7777. +12 4111 1111 1111 1111 x 4111-1111-1111-1112 5 𝒳 z@z.z " + "9 " * 3000 + "q" * 5000 + "@x.yy"
    got = privacy.find(spark.createDataFrame([(1, text), (None, None), (2, "")], "doc_id long, text string")).withColumn("spans", privacy.joined("_base")).collect()
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, v):
        n = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(n[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and max(map(int, v.split("."))) <= 255, "card": 13 <= len(n) <= 19 and luhn, "phone": 9 <= len(n) <= 15}[kind]

    want = ",".join(f"{k}:{m.start()}:{m.end()}" for k in forms for m in re.finditer(forms[k], text) if good(k, m.group()))
    assert {r.doc_id: r.spans for r in got} == {1: want, None: "", 2: ""}


def test_privacy_terms(spark):
    rows = [(i, f"the owner Zarquon wrote from zed@mail.example about the thing {i}") for i in range(5)] + [(i, f"the owner wrote about the thing {i} of the day") for i in range(10, 60)]
    found = privacy.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.withColumn("clean", privacy.sanitised(found)).collect()}
    assert {t.value for t in got[0]._terms} == {"Zarquon", "from"} and not got[10]._terms
    assert got[0].clean == "the owner  wrote  [email] about the thing 0" and got[10].clean == rows[5][1]


def test_privacy_needs_evidence(spark):
    """Ordinary rare words of documents with an address stay; an alias met in several documents goes, the fewer the milder."""
    rows = [(i, f"the owner Zarquon wrote to zed@mail.example about rareword{i} the thing") for i in range(6)] + [(i, f"the owner Quux wrote to quux@mail.example about rareword{i} the thing") for i in range(6, 9)]
    rows += [(i, "the owner wrote to someone about the thing of the day") for i in range(10, 60)]
    found = privacy.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.withColumn("clean", privacy.sanitised(found)).collect()}
    assert [(t.value, t.action) for t in got[0]._terms] == [("Zarquon", "remove")] and [(t.value, t.action) for t in got[7]._terms] == [("Quux", "generalise")] and not got[10]._terms
    assert got[7].clean == "the owner [name] wrote to [email] about rareword7 the thing"


def test_privacy_terms_far_from_the_entity(spark):
    far = " the thing about the owner" * 12
    rows = [(i, "Dear Zarquon," + far + " zed@mail.example" + far + " zarquon") for i in range(5)] + [(9, "no zed@mail.example" + far)] + [(i, "the thing about the owner of the day") for i in range(10, 60)]
    got = {r.doc_id: r._terms for r in privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t.value, t.start) for t in got[0]] == [("Dear", 0), ("Zarquon", 5), ("zarquon", len(rows[0][1]) - 7)] and not got[9] and not got[10]


def test_licences_of_repeated_keys(spark):
    rows = [(1, "Released under the MIT License"), (1, "nothing here at all"), (None, "plain"), (None, "All rights reserved"), (1, "nothing here at all"), (2, None)]
    got = counted(licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "labels", "score").collect())
    assert got == counted([(1, "mit", 1.0), (1, "", 0.0), (None, "", 0.0), (None, "reserved", 1.0), (1, "", 0.0), (2, "", 0.0)])


def test_token_ids_of_every_letter():
    """Pieces put together give the library's ids of whole texts, for every letter and mark before full stops and commas."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary()
    whole, own = Tokenizer.from_file(path), tokens.Encoder(path)
    letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c))[0] in "LMN"]
    texts = [f"ab{c}, x {c}. {c}.,{c} {c}" for c in letters] + ["İ, ΑΣ. it's, we'll. <|endoftext|>, e\u0301. a.b,c ..,"]
    ids, counts = own.encode(pa.array(texts))
    got = np.split(ids, np.cumsum(counts)[:-1])
    want = whole.encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a.tolist() != b.ids] == []


def test_packing_deals_out_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a b c")] * 300, "doc_id long, text string")
    got = packing.pack_documents(rows, group=20).collect()
    assert len(got) == 300 and len({r.sequence_id >> 32 for r in got}) > 8


def test_tiles_are_longest_first():
    """Against a plain search that compares all places anew for each tile."""
    rng = np.random.default_rng(3)

    def plain(item, doc, seed):
        free_i, free_d, out = [True] * len(item), [True] * len(doc), []
        while True:
            best = (seed - 1, 0, 0)
            for i in range(len(item)):
                for d in range(len(doc)):
                    k = 0
                    while i + k < len(item) and d + k < len(doc) and free_i[i + k] and free_d[d + k] and item[i + k] == doc[d + k]:
                        k += 1
                    if k > best[0]:
                        best = (k, i, d)
            k, i, d = best
            if k < seed:
                return out
            free_i[i : i + k] = free_d[d : d + k] = [False] * k
            out.append(best)

    pairs = [([1, 1, 1, 3, 1, 3, 1, 3, 2, 3, 2, 3, 3], [2, 3, 3, 1, 2, 1, 1, 3, 1, 3, 3, 1, 3, 2, 3, 3, 2, 2, 3, 2, 3, 1, 3, 2])]
    pairs += [(rng.integers(1, 4, rng.integers(1, 14)).tolist(), rng.integers(1, 4, rng.integers(1, 22)).tolist()) for _ in range(2000)]
    for item, doc in pairs:
        seed = min(3, len(item))
        got = tiling.tile(np.array(item, np.uint64), np.array(doc, np.uint64), seed)
        assert got == plain(item, doc, seed), (item, doc)


# ---------------------------------------------------------------- empty tables
def test_empty_tables(spark):
    d, b = empty(spark), spark.createDataFrame([], "item_id long, text string")
    folder, archive = new_path(spark, "test-empty"), new_path(spark, "test-empty")
    token_files.write(d, folder)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), archive)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (simhash.near_duplicates(d), licences.scan(d), repeats.remove_repeats(d), token_files.read(spark, folder), tiling.contaminated(d, b), quality.features(d), packing.pack_documents(d), toxicity.score_documents(d, labels), privacy.find(d)):
        assert out.count() == 0
