"""The problems' operators: edge rows, and results against brute force, round trips or planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpusline.llm import bitmaps, corpus_encoding, garbled_texts, leaked_passages, near_duplicates, scanned_pages, similar_vectors, split_oversized, truncated_texts
from korpusline.llm.words import words

NOUNS = "бетон щебень песок цемент вагон насос фильтр дренаж договор акт склад график".split()
VERBS = "проверяет передаёт согласует оплачивает хранит уведомляет".split()
WHO = "мастер прораб инженер заказчик поставщик лаборант".split()


def sentence(rng):
    return f"{rng.choice(WHO).capitalize()} {rng.choice(VERBS)} {rng.choice(NOUNS)} и {rng.choice(VERBS)} {rng.choice(NOUNS)} на сумму {rng.randrange(10, 999)} рублей."


# 1


def test_pieces_round_trip_and_limits():
    cfg = split_oversized.SplitConfig(max_tokens=32)
    rng = random.Random(3)
    texts = [" ".join(sentence(rng) for _ in range(30)), "\n\n".join("1. Раздел\n" + sentence(rng) * 3 for _ in range(9)), "я" * 5000, "а б " * 900, "строка;1;2\n" * 80, "\n" * 400, " ".join(["слово"] * 400) + "."]
    for text in texts:
        got = split_oversized.pieces(text, cfg)
        assert "".join(p[repeat:] for p, repeat, _ in got) == text
        assert all(len(p) // 4 <= 32 for p, _, _ in got)
    got = split_oversized.pieces(texts[0], cfg)
    for (a, _, at), (b, repeat, _) in zip(got, got[1:]):
        assert at == "sentence" and repeat > 0 and a.endswith(b[:repeat])


def test_pieces_are_filled_and_overlap():
    rng = random.Random(4)
    cfg = split_oversized.SplitConfig()
    text = " ".join(sentence(rng) for _ in range(400))
    got = split_oversized.pieces(text, cfg)
    # less than a sentence is left free in every piece but the last
    assert all(cfg.max_chars - len(p) < 120 for p, _, _ in got[:-1]) and all(0 < repeat < 120 for _, repeat, _ in got[1:])
    blanks = "".join(sentence(rng) + " " * 600 for _ in range(30))
    got = split_oversized.pieces(blanks, cfg)
    assert "".join(p[repeat:] for p, repeat, _ in got) == blanks and all(p[:repeat].strip() for p, repeat, _ in got[1:])
    # the rest of a divided paragraph goes on with the next one, so no piece is tiny but the last
    mixed = "\n\n".join([" ".join(sentence(rng) for _ in range(33)), *(sentence(rng) for _ in range(20))] * 3)
    got = split_oversized.pieces(mixed, cfg)
    assert "".join(p[repeat:] for p, repeat, _ in got) == mixed and all(len(p) - repeat > 400 for p, repeat, _ in got[:-1])
    long = "слово " * 2000 + "."
    assert all(repeat > 0 for _, repeat, _ in split_oversized.pieces(long, cfg)[1:])


def test_split_edge_rows(spark):
    rows = spark.createDataFrame([("chunk", "a", None, None, 1), ("chunk", "b", "", [], 1), ("chunk", "c", "ж" * 2051, ["Г"], 1), ("chunk", "d", "ж" * 2052, ["Г"], 1), ("chunk", "d", "ж" * 2052, ["Г"], 1)], "item_kind string, item_id string, text string, headings_path array<string>, piece_no int")
    assert [tuple(r) for r in split_oversized.oversized(rows).collect()] == [("chunk", "d")]
    assert split_oversized.split_oversized(rows.filter("false")).count() == 0


# 2


def test_garbled_found_and_restored(spark):
    rng = random.Random(5)
    rows = [(f"g{n}", rng.choice(["doc", "pdf", None]), " ".join(sentence(rng) for _ in range(3))) for n in range(400)]
    truth, texts = {}, []
    swaps = [("utf-8", "cp1251"), ("utf-8", "latin-1"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "latin-1")]
    for n, (key, source, text) in enumerate(rows):
        if n % 8 == 0:
            truth[key] = text
            text = garbled_texts.shown(text, *swaps[n // 8 % len(swaps)])
        texts.append((key, source, text))
    texts += [("n", "doc", None), ("e", "doc", ""), ("b", "doc", "  "), ("f", "doc", "Станция Љубанево — Ђорићка, café à Größe"), texts[0]]
    df = spark.createDataFrame(texts, "id string, source_type string, text string").withColumn("whole", F.lit(1))
    got = {r.id: r for r in garbled_texts.restored_texts(df).collect()}
    assert set(got) == set(truth)
    assert sum(got[k].restored == truth[k] for k in truth) >= 0.9 * len(truth)
    assert garbled_texts.garbled_texts(df.filter("false")).count() == 0


def test_em_learns_without_a_prior():
    rng = random.Random(6)
    counts, pairs = {}, {}
    plain = "".join(sentence(rng).lower() for _ in range(3000))
    cipher = {c: chr(0x2460 + n) for n, c in enumerate(garbled_texts.RUSSIAN)}
    for word in words(plain):
        word = "".join(c for c in word if c in cipher)
        for a, b in zip(" " + word, word + " "):
            counts[a + b] = counts.get(a + b, 0) + 1
            key = (cipher.get(a, " "), cipher.get(b, " "))
            pairs[key] = pairs.get(key, 0) + 1
    table = garbled_texts.learned(pairs, {}, garbled_texts.language(counts), garbled_texts.GarbleConfig())
    used = {c for c in plain if c in cipher and plain.count(c) > 300}
    assert sum(table.get(cipher[c]) == c for c in used) >= 0.9 * len(used)


def varied(rng):
    """A sentence with more forms of words."""
    form = lambda: rng.choice(NOUNS) + rng.choice(["", "а", "у", "ом", "е", "ы", "ов", "ами", "ный", "ного", "ная"])
    return f"{rng.choice(['Завтра', 'Потом', 'Летом', 'Иногда', 'Масса', 'Размер'])} {form()} и {form()} {rng.choice(VERBS)} {form()} для {form()} на сумму {rng.randrange(10, 999)} рублей."


def test_a_swap_that_no_list_has_is_learned_and_without_learning_rows_are_lost(spark):
    rng = random.Random(15)
    rows = [(f"g{n}", rng.choice(["doc", "pdf"]), " ".join(varied(rng) for _ in range(4))) for n in range(400)]
    truth, texts = {}, []
    for n, (key, source, text) in enumerate(rows):
        if n % 4 == 0:  # read as Greek, in one source only
            source, truth[key] = "scan", text
            text = garbled_texts.shown(text, "cp1251", "cp1253")
        elif n % 10 == 1:
            truth[key] = text
            text = garbled_texts.shown(text, "cp1251", "koi8-r")
        texts.append((key, source, text))
    texts += [("real", "scan", "Поставка из Αθήνα и Θεσσαλονίκη, станция Љубанево — Ђорићка")]
    df = spark.createDataFrame(texts, "id string, source_type string, text string")
    got = {r.id: r for r in garbled_texts.restored_texts(df).collect()}
    assert set(got) == set(truth)
    right = [sum(a == b for a, b in zip(got[k].restored, truth[k])) / len(truth[k]) for k in truth]
    assert {got[k].cipher for k in truth if got[k].source_type == "scan"} == {"unknown"} and min(right) > 0.95
    assert garbled_texts.garbled_texts(df, garbled_texts.GarbleConfig(rounds=0)).count() == 0


def test_rare_symbols_are_one(spark):
    rows = [("s", "c", chr(0x100 + n), chr(0x101 + n), 1000 - n) for n in range(50)]
    df = spark.createDataFrame(rows, "source string, cipher string, a string, b string, n bigint")
    got = garbled_texts.cipher_bigrams(df, garbled_texts.GarbleConfig(symbols=10))["s", "c"]
    assert sum(got.values()) == sum(r[4] for r in rows) and len({x for pair in got for x in pair}) == 11


# 3


def brute(texts, size, threshold):
    sets = {k: {tuple(w[n : n + size]) for n in range(len(w) - size + 1)} for k, t in texts.items() if t for w in [words(t)]}
    keys = sorted(k for k, s in sets.items() if s)
    return {(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [200, 2])
def test_pairs_equal_brute_force(spark, hot):
    rng = random.Random(7)
    texts = {}
    for n in range(25):
        base = " ".join(sentence(rng) for _ in range(6))
        for m in range(4):
            own = base.split()
            for _ in range(m):
                own[rng.randrange(len(own))] = rng.choice(NOUNS)
            texts[f"t{n:02}{m}"] = " ".join(own)
    texts |= {"same1": texts["t000"], "same2": texts["t000"], "null": None, "empty": "", "two": "два слова", "two2": "два слова"}
    rows = [(k, t, "x") for k, t in texts.items()] + [("t000", texts["t000"], "x")]
    df = spark.createDataFrame(rows, "id string, text string, key string")
    cfg = near_duplicates.NearConfig(shingle=3, threshold=0.7, hot=hot)
    want = brute(texts, 3, 0.7)
    got = {tuple(r) for r in near_duplicates.similar_pairs(df, cfg).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    assert near_duplicates.similar_pairs(df.filter("false"), cfg).count() == 0


def test_groups_join_what_is_linked(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(1, 30)] + [(100, 101)], "key_a bigint, key_b bigint")
    roots = {r.key: r.root for r in near_duplicates.components(links).collect()}
    assert {roots[k] for k in range(1, 31)} == {1} and roots[101] == roots[100] == 100


# 4


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    noisy = base[rng.integers(0, 300, 200)] + 0.1 * rng.normal(size=(200, 64))
    vectors = np.concatenate([base, noisy, np.repeat(base[:1] * 3, 9, axis=0)])
    rows = [(n, [float(x) for x in v], "x") for n, v in enumerate(vectors)] + [(900, None, "x"), (901, [0.0] * 64, "x"), (3, [float(x) for x in vectors[3]], "x")]
    df = spark.createDataFrame(rows, "row_no bigint, vec array<float>, field string")
    own = similar_vectors.unit_vectors(df, "row_no", "vec").withColumn("field", F.lit("f"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    want = set()
    for a in range(len(unit)):
        order = [b for b in np.lexsort((np.arange(len(unit)), -cosine[a])) if b != a][:5]
        want |= {(min(a, b), max(a, b)) for b in order if cosine[a, b] >= 0.9}
    got = {(r.row_a, r.row_b) for r in similar_vectors.neighbour_pairs(own).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    asked = own.filter("key % 20 = 0")
    near = similar_vectors.knn_scan(asked, own).collect()
    hits = sum(r.other in [b for b in np.lexsort((np.arange(len(unit)), -cosine[r.key])) if b != r.key][:5] for r in near)
    assert hits >= 0.9 * len(near)
    assert similar_vectors.neighbour_pairs(own.filter("false")).count() == 0


def test_neighbours_with_far_more_cells_than_probes(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 64))
    vectors = np.concatenate([base, base[rng.integers(0, 400, 400)] + 0.2 * rng.normal(size=(400, 64))])
    df = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(vectors)], "row_no bigint, vec array<float>")
    own = similar_vectors.unit_vectors(df, "row_no", "vec").withColumn("field", F.lit("f"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    want = set()
    for a in range(len(unit)):
        order = [b for b in np.lexsort((np.arange(len(unit)), -cosine[a])) if b != a][:5]
        want |= {(min(a, b), max(a, b)) for b in order if cosine[a, b] >= 0.9}
    cfg = similar_vectors.KnnConfig(cell_rows=10)
    assert len(unit) // cfg.cell_rows >= 10 * cfg.probes
    got = {(r.row_a, r.row_b) for r in similar_vectors.neighbour_pairs(own, cfg).collect()}
    print("recall", len(got & want), len(want), len(got - want))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.01 * len(want)


# 5


def test_scan_traces_and_repair(spark):
    rng = random.Random(9)
    pages = []
    for doc in range(12):
        for page in range(1, 6):
            body = " ".join(sentence(rng) for _ in range(5))
            pages.append([f"s{doc}-{page}", "К", f"p{doc}.pdf", f"d{doc}", page, page, f"СТП 22{doc:02}-13  Издание 7\n{body}\nСтраница {page}", {"ocr": "rus"}])
    clean = [f"c{n}" for n in range(20)]
    pages += [[k, "К", f"{k}.pdf", k, 1, 1, " ".join(sentence(rng) for _ in range(6)).replace(" и ", "\nи "), {"ocr": "rus"}] for k in clean]
    bad = {"hy": "Мастер проверяет бетон и согла-\nсует график на сумму 5 рублей.", "mi": "Мастер пpоверяет бетон и оплачивает щебень на сумму 5 рублей.", "gl": "Мастер проверяег бетон и оплачивает щебень на сумму 5 рублей."}
    pages += [[k, "К", f"{k}.pdf", k, 1, 1, t, {"ocr": "rus"}] for k, t in bad.items()]
    pages += [["no", "К", "n.pdf", "n", 1, 1, None, {"ocr": "rus"}], ["blank", "К", "n.pdf", "n", 1, 2, " ", {"ocr": "rus"}], ["plain", "К", "n.pdf", "n", 1, 3, bad["mi"], {}], pages[0]]
    df = spark.createDataFrame([tuple(p) for p in pages], "id string, category string, doc_path string, doc_id string, page int, elem_order int, text string, metadata map<string,string>").withColumn("line", F.lit(1))
    got = {r.id: r.traces for r in scanned_pages.noisy_pages(df).collect()}
    assert set(got) == {f"s{d}-{p}" for d in range(12) for p in range(1, 6)} | set(bad)
    assert got["hy"] == ["hyphen"] and "misread" in got["mi"] and "misread" in got["gl"]
    text = {r.file: r.text for r in scanned_pages.repaired_paragraphs(df).collect() if r.file in ("К::hy", "К::mi", "К::gl")}
    assert "согласует" in text["К::hy"] and "проверяет" in text["К::mi"] and "проверяет" in text["К::gl"]
    assert not any("Издание" in r.text or "Страница" in r.text for r in scanned_pages.repaired_paragraphs(df).collect())
    assert scanned_pages.noisy_pages(df.filter("false")).count() == 0


def test_context_turns_look_alikes_away(spark):
    rng = random.Random(16)
    # a rare word that differs from a frequent one by a likely glyph, in other surroundings; and real misreadings of it
    about = lambda: f"мастер проверяет {rng.choice(NOUNS)} и {rng.choice(['старый', 'новый'])} вагон стоит на {rng.choice(['первом', 'втором'])} пути."
    other = lambda: f"Повар {rng.choice(['варит', 'солит'])} густой суп, потом {rng.choice(['режет', 'чистит'])} рыбу и лук."
    pages = [(f"a{n}", n, " ".join(about() for _ in range(6))) for n in range(300)]
    pages += [(f"b{n}", n, " ".join(other() for _ in range(6))) for n in range(100)]
    pages += [(f"like{n}", n, " ".join([other(), "Повар варит густой ватон, потом режет рыбу и лук.", other()])) for n in range(10)]
    pages += [(f"bad{n}", n, " ".join([about(), "мастер проверяет бетон и старый вaгон стоит на первом пути.".replace("a", "а").replace("вагон", "ватон" if n % 2 else "вагоп"), about()])) for n in range(4)]
    df = spark.createDataFrame([(k, "К", f"{k}.pdf", k, p, p, t, {"ocr": "rus"}) for k, p, t in pages], "id string, category string, doc_path string, doc_id string, page int, elem_order int, text string, metadata map<string,string>")
    cfg = scanned_pages.ScanConfig(similar=-1.0, here=0.15, rounds=8)  # links as they are: each occurrence by its own context
    got = {r.id for r in scanned_pages.noisy_pages(df, cfg).collect() if "misread" in r.traces}
    assert {"bad1", "bad3"} <= got and not any(k.startswith(("a", "b0", "like")) for k in got)
    # as a link, a word that mostly stands elsewhere is turned away altogether
    strict = {r.id for r in scanned_pages.noisy_pages(df, scanned_pages.ScanConfig(rounds=8)).collect() if "misread" in r.traces}
    assert not any(k.startswith("like") for k in strict)


def test_page_lines():
    yes = ["Страница 12", "стр. 3", "— 4 —", "[5]", "6/12", "Cтpaница 7 из 9", "Лиcт 8", "Писг 9", "Seite 3 von 4", "page 2", "р. 5"]
    no = ["Лифт 8", "Сумма 12", "Раздел 3", "12", "вагон 7", "страна 5"]
    assert all(map(scanned_pages.is_page_line, yes)) and not any(map(scanned_pages.is_page_line, no))


def test_paragraphs_run_over_pages(spark):
    rng = random.Random(17)
    pages = []
    for doc in range(3):
        for page in range(1, 40):
            head, tail = sentence(rng), sentence(rng)
            pages.append((f"p{doc}-{page}", "К", f"{doc}.pdf", f"d{doc}", page, page, f"{'и потом ' if page % 2 == 0 else ''}{head}\n\n{tail}"[: -1 if page % 3 == 0 else None], {"ocr": "rus"}))
    df = spark.createDataFrame(pages, "id string, category string, doc_path string, doc_id string, page int, elem_order int, text string, metadata map<string,string>")
    got = sorted((r.file, r.paragraph, r.page_from, r.page_to) for r in scanned_pages.repaired_paragraphs(df).collect())
    want = []
    for doc in range(3):
        number, ended = 0, True
        for page in range(1, 40):
            if page % 2 == 0 or not ended:
                want[-1][3] = page
            else:
                number += 1
                want.append([f"К::d{doc}", number, page, page])
            number += 1
            want.append([f"К::d{doc}", number, page, page])
            ended = page % 3 != 0
    assert got == [tuple(x) for x in want]


def test_slot_hash_is_that_of_sql(spark):
    for word in ("бетон", "a", ""):
        assert spark.range(1).select(F.xxhash64(F.lit(word))).first()[0] == scanned_pages.spark_xxhash64(word)


# 6


def test_ids_equal_the_reference_tokenizer_and_decode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = corpus_encoding.VOCABULARY.replace("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["Бетон М300,  щебень\r\n\tи <|endoftext|> it's 12345", "👷‍♂️ naïve   x", "", None, "  ", "a" * 3000, "é" * 50]
    df = spark.createDataFrame([(n, x, 0) for n, x in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in corpus_encoding.encode_corpus(df).collect()}
    assert got == {n: t.encode(x, add_special_tokens=False).ids if x else [] for n, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in corpus_encoding.decode_corpus(corpus_encoding.encode_corpus(df)).collect()}
    assert back == {n: x or "" for n, x in enumerate(texts)}
    assert corpus_encoding.encode_corpus(df.filter("false")).count() == 0


# 7


def test_leaks_equal_brute_force(spark):
    rng = random.Random(10)
    items = {n: " ".join(sentence(rng) for _ in range(4)) for n in range(30)} | {98: "коротко", 99: None}
    docs = {}
    for n in range(60):
        own = [sentence(rng) for _ in range(6)]
        if n % 3 == 0:
            part = items[n % 30].split()
            start = rng.randrange(len(part) - 14)
            own.insert(2, " ".join(part[start : start + rng.choice([11, 12, 13, 14])]).upper().replace(" ", ",\n"))
        docs[n] = " ".join(own)
    docs |= {100: None, 101: "", 102: "коротко"}

    def grams(t):
        w = words(t or "")
        return {tuple(w[k : k + 13]) for k in range(len(w) - 12)}

    want = {(d, i) for d, t in docs.items() for i, x in items.items() if grams(t) & grams(x)}
    d = spark.createDataFrame([(k, t, 1) for k, t in docs.items()] + [(0, docs[0], 1)], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    for radius in (3, 1):
        got = {(r.doc_id, r.item_id) for r in leaked_passages.leaked_passages(d, i, leaked_passages.LeakConfig(radius=radius)).collect()}
        assert got == want
    assert leaked_passages.leaked_passages(d.filter("false"), i).count() == 0
    assert leaked_passages.leaked_passages(d, i.filter("false")).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for blocks in (4, 5, 7):
        masks = leaked_passages.block_masks(blocks, 3)
        for _ in range(50):
            near = prints.copy()
            for bit in rng.choice(64, 3, replace=False):
                near ^= np.uint64(1 << int(bit))
            assert np.all(((prints ^ near)[:, None] & masks == 0).any(axis=1))


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    for size, got in leaked_passages.simhashes(hashes, (13, 32, 100)).items():
        want = [sum(int(bits[a : a + size, j].sum() * 2 > size) << j for j in range(64)) for a in range(300 - size + 1)]
        assert got.tolist() == want


def test_edited_passages_within_the_radius_are_found_and_verified(spark):
    rng = random.Random(13)
    vocabulary = [f"слово{n}" for n in range(400)]
    cfg = leaked_passages.LeakConfig(radius=3, threshold=0.7)
    items, docs = {}, {}
    for n in range(300):
        own = [rng.choice(vocabulary) for _ in range(13)]
        items[n] = " ".join(own)
        docs[n] = " ".join([*own[:12], rng.choice(vocabulary)])  # 8 of 10 shingles in common, if the word is another
    hashes = leaked_passages.WordHashes()

    def fingerprint(text):
        return int(leaked_passages.simhashes(hashes.of(text.split()), (13,))[13][0])

    i = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    similar = leaked_passages.Similarity(leaked_passages.word_weights(i, cfg), cfg)
    want = {n for n in items if (fingerprint(items[n]) ^ fingerprint(docs[n])).bit_count() <= cfg.radius and similar.of(items[n], docs[n]) >= cfg.threshold}
    rows = leaked_passages.similar_passages(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), i, cfg).collect()
    assert {r.doc_id for r in rows if r.doc_id == r.item_id} == want and len(want) >= 10
    assert {r.doc_id for r in rows if r.windows} == {n for n in items if items[n] == docs[n]}


def test_hot_windows_and_bitmap_bounds(spark):
    rng = random.Random(14)
    passage = " ".join(sentence(rng) for _ in range(4))
    d = spark.createDataFrame([(n, passage if n % 3 == 0 else sentence(rng)) for n in range(300)], "doc_id bigint, text string")
    i = spark.createDataFrame([(n, passage if n < 5 else sentence(rng) * 2) for n in range(20)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_passages.leaked_passages(d, i).collect()}
    assert {(n, k) for n in range(0, 300, 3) for k in range(5)} <= got
    assert bitmaps.bits_for(0) == bitmaps.LEAST and bitmaps.bits_for(10**12) == bitmaps.MOST
    packed = bitmaps.of_keys(spark.range(1000).select(F.xxhash64("id").alias("k")))
    known = np.array([r.k for r in spark.range(1000).select(F.xxhash64("id").alias("k")).collect()])
    assert bitmaps.has(packed, known).all() and bitmaps.has(packed, np.arange(10**5)).mean() < 0.01


# 8


def test_truncated_texts(spark):
    rng = random.Random(11)
    rows, cut = [], set()
    closers = ["Копия: лаборатория", "Конец документа", "тел. доб. 17", "С уважением, мастер ООО «Ток»\nКопия: лаборатория"]
    for n in range(600):
        text = "\n".join(" ".join(sentence(rng) for _ in range(3)) for _ in range(3))
        if n % 10 == 0:
            at = len(text) - rng.randrange(8, 60)
            while text[at - 1] in ".\n " or text[at] in ".\n":
                at -= 1
            text = text[:at]
            cut.add(n)
        elif n % 10 == 1:
            text += "\n" + rng.choice(closers)
        elif n % 10 == 2:  # the same lines inside texts
            text = rng.choice(closers) + "\n" + text
        rows.append((n, text, f"src{n % 3}"))
    rows += [(9000, None, None), (9001, "", "src0"), (9002, "  ", None), (9003, rows[0][1][:-1] + "�", "src0"), rows[10]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("total", F.lit(1))
    got = {r.doc_id for r in truncated_texts.truncated_texts(df).collect()}
    assert 9003 in got and not {9000, 9001, 9002} & got
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut - {9003}) <= 0.02 * len(rows)
    shares = {r.source: r.share for r in truncated_texts.truncation_by_source(df).collect()}
    assert all(0.05 < shares[f"src{k}"] < 0.2 for k in range(3))
    assert truncated_texts.truncated_texts(df.filter("false")).count() == 0


def test_remains_of_a_cut_do_not_count_as_known(spark):
    whole = "Die Stückzahl im Lager wurde gestern gezählt und gebucht. Der Rest bleibt im Lager."
    ends = ["Der Rest wurde am 2023-02-17 gezä...", "Der Rest wurde am 2023-02-17 gezä...", "Der Rest wurde am 2023-02-17 gezä…", "Der Rest wurde am 2023-02-17 gezä\n"]
    rows = [(n, whole, "a") for n in range(6)] + [(100 + n, whole + " " + end, "a") for n, end in enumerate(ends)]
    got = truncated_texts.truncated_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert {r.doc_id: r.reason for r in got.collect()} == {100 + n: "word" for n in range(4)}


def test_limits_stand_out_from_neighbours_whatever_their_share(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(100, 3000) for _ in range(900)]
    rows = [("chars", "ab"[n % 2] + f"{n:05}" * (size // 5) + "x" * (size % 5)) for n, size in enumerate(sizes + [4000] * 12)]
    rows += [("bytes", f"{n:05} " + "ы" * ((size - 6) // 2) + "." * (size % 2)) for n, size in enumerate(sizes + [4096] * 9 + [4095] * 7)]
    rows += [("copies", "ы" * size) for size in sizes + [5000] * 40] + [("close", f"{n:05}" + "x" * (50 + n % 3)) for n in range(300)]
    df = spark.createDataFrame(rows, "source string, text string")
    got = {(r["of"], r.unit, r["size"]) for r in truncated_texts.limits(df, truncated_texts.CutConfig()).collect()}
    assert ("chars", "chars", 4001) in got and {("bytes", "bytes", 4095), ("bytes", "bytes", 4096)} <= got
    assert not {x for x in got if x[0] in ("copies", "close") or x[0] == x[1] and x[2] < 3900}


def test_open_ends_at_a_rare_limit_are_found(spark):
    rng = random.Random(6)
    rows = []
    for n in range(400):
        text = " ".join(f"Die Länge {rng.randrange(10**6)} wurde geprüft." for _ in range(rng.randrange(3, 50)))
        rows.append((n, text + "\nLänge bis 17 mm" + ("\nLänge von 9 mm bis oben.\n" if n % 2 else "\nRest."), "mail"))
    for n in range(400, 412):
        body = f"Nummer {n}. " + "".join(f"Die Länge {rng.randrange(10**6)} wurde geprüft. " for _ in range(90))
        end = "Länge bis 17 mm"
        rows.append((n, body[: 3000 - len(end) - 2].rstrip(" ").ljust(3000 - len(end) - 2, "a") + ". " + end, "mail"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.reason for r in truncated_texts.truncated_texts(df).collect()}
    assert {n for n, reason in got.items() if reason == "limit"} == set(range(400, 412))


def test_long_chains_are_one_group(spark):
    rng = random.Random(12)
    keys = rng.sample(range(-(10**12), 10**12), 1101)
    chain, rest = keys[:1001], keys[1001:]
    links = list(zip(chain, chain[1:])) + list(zip(rest[::2], rest[1::2]))
    df = spark.createDataFrame([(min(x), max(x)) for x in links], "key_a bigint, key_b bigint")
    got = [(r.key, r.root) for r in near_duplicates.components(df).collect()]
    want = [(k, min(chain)) for k in chain] + [(k, min(pair)) for pair in zip(rest[::2], rest[1::2]) for k in pair]
    assert sorted(got) == sorted(want)


def test_tables_of_empty_files(spark, tmp_path):
    """A task with no batch at all: empty files, and splits of a file that hold no row group."""
    at = str(tmp_path / "documents")
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(at)
    documents = spark.read.parquet(at)
    assert truncated_texts.truncated_texts(documents).count() == 0 and truncated_texts.truncation_by_source(documents).count() == 0
    one = spark.createDataFrame([(1, "Ein Satz.", "a")], "doc_id bigint, text string, source string").repartition(8)
    assert truncated_texts.truncated_texts(one).count() == 0


def test_degenerate_long_texts(spark):
    """One long run of stops, of one word's letters, of blanks: patterns stay linear in the text."""
    long = 200_000
    texts = ["." * long + "а", "а" * long, " " * long, "а" * long + "1", ".»" * long, "аб-\n" * long]
    for text in texts:
        own = split_oversized.pieces(text)
        assert "".join(piece[repeat:] for piece, repeat, _ in own) == text
    rows = spark.createDataFrame([(n, str(n), t, "a") for n, t in enumerate(texts)], "doc_id bigint, id string, text string, source string")
    assert truncated_texts.truncated_texts(rows).count() <= len(texts)
    assert near_duplicates.similar_pairs(rows, near_duplicates.NearConfig(shingle=3, threshold=0.7)).count() == 0


def test_a_stop_run_across_the_bound_of_an_overlap_keeps_its_sentence():
    sentences = "Он ушёл" + "." * 1500 + " Конец был близко. "
    first, second = split_oversized.pieces(sentences + "слово " * 900)[:2]
    assert second[0][: second[1]] and first[0].endswith(second[0][: second[1]])
    assert split_oversized.overlap_of(sentences, 0, len(sentences), 700) == "Конец был близко. "
    # the bound lies in the run, whose last stop ends the sentence before
    assert split_oversized.overlap_of("Он ушёл" + "." * 50 + " Конец", 0, 63, 20) == "Конец"


def test_repeated_passages_of_an_item_meet_once(spark):
    """An item and a text that repeat one word: windows are as many as different passages, not the product of their places."""
    items = spark.createDataFrame([(1, "слово " * 20_000), (2, "Раздел 1\n" * 40)], "item_id bigint, text string")
    documents = spark.createDataFrame([(1, "слово " * 30_000), (2, "слово " * 12), (3, "Раздел 1\n" * 9)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in leaked_passages.similar_passages(documents, items).collect()}
    assert got[1, 1].windows == 20_000 - 12 and got[1, 1].shared_words == 20_000
    assert got[3, 2].windows == 80 - 12 and (2, 1) not in got
