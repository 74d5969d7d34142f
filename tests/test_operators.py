"""Operators on small hand-made tables, and against plain Python."""

import io
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from korpusline import schema
from korpusline.api import Engine
from korpusline.config import ChunkConfig, ContextConfig
from korpusline.functions import scan, text, vectors
from korpusline.operators import chunking, context, entities, fields, graph, graph_search, ranking, rerank, search
from korpusline.plans import queries as plans
from korpusline.sources import charset, files, markup, office, sinks
from korpusline.streaming import ingest

ELEMENT = dict.fromkeys([x.strip().split(" ")[0] for x in schema.ELEMENTS.split(", ")])


def elements(spark, *rows):
    full = [{**ELEMENT, "element_type": "paragraph", "category": "К/П", "doc_id": "d", **r} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], schema.ELEMENTS)


def test_heading_stack_with_category_prefix(spark):
    lines = ["1. Один", "текст", "1.1 Дальше", "1.1.1 Глубже", "ещё", "1.2 Другое", "2. Два", "конец"]
    rows = elements(spark, *[{"id": f"e{n}", "elem_order": n, "text": t} for n, t in enumerate(lines)])
    got = {r.id: r.path for r in chunking.heading_paths(rows).collect()}
    assert got["e1"] == ["К", "П", "1. Один"]
    assert got["e4"] == ["К", "П", "1. Один", "1.1 Дальше", "1.1.1 Глубже"]
    assert got["e5"] == ["К", "П", "1. Один", "1.2 Другое"]
    assert got["e7"] == ["К", "П", "2. Два"]


def test_chunks_respect_limits_and_numbering(spark):
    long = "Слово за словом идёт предложение. " * 120
    rows = elements(spark, {"id": "a", "elem_order": 1, "text": long}, {"id": "a", "elem_order": 1, "text": long}, {"id": "b", "elem_order": 2, "text": "  "}, {"id": "c", "elem_order": 3, "element_type": "table", "html": "<table>1</table>"}, {"id": "n", "elem_order": None, "text": None})
    got = chunking.build_chunks(rows).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert all(r.token_len <= 512 for r in got) and len({r.id for r in got}) == len(got)
    assert any("<table>" in r.text for r in got)
    assert chunking.build_chunks(rows.filter("false")).count() == 0


def test_pack_is_greedy():
    assert chunking.pack([3, 3, 3], [False] * 3, 6) == [(0, 2), (2, 3)]
    assert chunking.pack([9, 1], [False] * 2, 6) == [(0, 1), (1, 2)]
    assert chunking.pack([1, 1, 1], [False, True, False], 6) == [(0, 1), (1, 3)]
    assert chunking.pack([], [], 6) == []


def test_running_scans_equal_python(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)]), f"t{n:03}", rng.choice([None, f"v{n}"])) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, t string, v string")
    got = {r.t: (r.last, r.pos) for r in scan.running_count(scan.running_last(df, ["k"], "o", "t", "v", "last", block=7), ["k"], "o", "t", "pos", block=7).collect()}
    for k in "ab":
        nulls = [r for r in rows if r[0] == k and r[1] is None]
        own = sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (r[1], r[2]))
        assert sorted(got[r[2]][1] for r in nulls) == list(range(len(nulls)))
        assert [got[r[2]][1] for r in own] == list(range(len(nulls), len(nulls) + len(own)))
        last = None
        for r in own:
            last = r[3] or last
            if last:
                assert got[r[2]][0] == last


def test_search_filters_after_top_k(spark):
    rows = [(f"c{n}", "К" if n % 2 else None, "d", "p", f"бетон слово{n}", n, n, n, 1, 1, ["1. А"]) for n in range(20)]
    chunks = spark.createDataFrame(rows, "id string, category string, doc_id string, doc_path string, text string, chunk_index int, from_order int, to_order int, page_from int, page_to int, heading_path array<string>")
    asked = spark.createDataFrame([(1, "бетон слово3"), (2, None)], "query_id int, query string")
    index = search.index(chunks)
    got = search.search_raw(asked, index, 3, 2, categories=["К"]).filter("query_id = 1").orderBy("rank").collect()
    assert got and got[0].id == "c3" and all(r.category == "К" for r in got) and len(got) <= 3
    docs = search.search_window(asked, index, 2, 2, 1).filter("query_id = 1").collect()
    assert docs and all("бетон" in r.context for r in docs)
    assert search.search_raw(asked, index.filter("false")).count() == 0


def test_hysteresis_keeps_the_row_that_stops(spark):
    hits = spark.createDataFrame([(1, n, f"d{n % 2}") for n in range(1, 11)], "query_id int, rank int, doc_key string")
    assert search.hysteresis(hits, 2).count() == 6


def test_bm25_gate_and_merge(spark):
    docs = spark.createDataFrame([(f"d{n}", (["редкий"] if n == 0 else []) + ["частый"] * (n % 2 + 1)) for n in range(20)] + [("пусто", [])], "doc_key string, nav_tokens array<string>")
    asked = spark.createDataFrame([(1, "редкий частый"), (2, "ничего")], "query_id int, query string")
    scores = {r.doc_key: r.bm25 for r in ranking.bm25(asked, docs).collect()}
    assert max(scores, key=scores.get) == "d0"
    lexicon = docs.select(F.explode(F.array_distinct("nav_tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    gates = {(r.query_id, r.doc_key): r.gate for r in ranking.idf_gate(asked, docs, lexicon, asked.crossJoin(docs)).collect()}
    assert gates[1, "d0"] == 1.0 and gates[1, "d1"] == 0.7 and gates[1, "пусто"] == 0.7 and gates[2, "d1"] == 1.0
    scored = spark.createDataFrame([(1, "К::акт", 1.0)], "query_id int, doc_key string, score double")
    found = spark.createDataFrame([(1, "n1", "акт", 0.5, "т"), (1, "n2", "прочее", 0.4, "т"), (1, "n3", "пустое", 0.4, " ")], "query_id int, node_id string, name string, graph_score double, content string")
    merged = {r.doc_key: (r.score, r.origin) for r in ranking.graph_merge(scored, found).collect()}
    assert merged == {"К::акт": (1.15, "text"), "n2": (0.12, "graph")}


def sequential_chunks(rows, cfg):
    """What chunks are, row after row: (texts, paths) of one document."""
    done, held, size = [], [], 0

    def end():
        nonlocal held, size
        sentences = [s for piece in held for s in piece[0]]
        cuts = [False] * len(sentences)
        if len(sentences) > 2:
            v = vectors.encode_batch(sentences)
            near = (v[1:] * v[:-1]).sum(axis=1)
            cuts = [False, *(near <= np.quantile(near, 0.25))]
        before = []
        for a, b in chunking.pack([max(1, len(s) // 4) for s in sentences], cuts, cfg.max_tokens):
            lead = before[-1:]
            if lead and len("\n".join(lead + sentences[a:b])) // 4 > cfg.max_tokens:
                lead = []
            before = sentences[a:b]
            text = "\n".join(lead + before)
            if done and len(text) // 4 < cfg.min_tokens and len(done[-1] + "\n" + text) // 4 <= cfg.max_tokens:
                done[-1] += "\n" + text
            else:
                done.append(text)
        held, size = [], 0

    for kind, text, sentences in rows:
        tokens = max(1, len(text) // 4)
        if kind == "heading" or kind == "table" or size and size + tokens > cfg.target_tokens:
            end()
        if kind != "heading":
            held.append((sentences,))
            size += tokens
        if kind == "table":
            end()
    end()
    return done


def test_chunks_equal_a_row_by_row_pass(spark):
    rng = random.Random(4)
    cfg = ChunkConfig(target_tokens=60, max_tokens=80, min_tokens=12)
    rows, want = [], {}
    for doc in range(12):
        own = []
        for n in range(rng.choice([3, 40, 120])):
            kind = rng.choices(["text", "heading", "table"], [8, 1, 1])[0]
            said = [f"{rng.choice(['Бетон', 'Песок', 'Щебень'])} {'сорт ' * rng.randrange(1, 9)}{rng.randrange(99)}." for _ in range(rng.randrange(1, 5))]
            text = f"{rng.randrange(1, 9)}. Раздел" if kind == "heading" else " ".join(said)
            own.append((kind, text, said))
            rows.append({"id": f"{doc}-{n:04}", "doc_id": f"d{doc}", "category": None, "page": 1 + n // 7, "elem_order": n, "element_type": "table" if kind == "table" else "paragraph", "text": text, "headings_path": None})
        # a table carries its heading path in a first line, which is a sentence of its own
        path = None
        for k, (kind, text, said) in enumerate(own):
            if kind == "heading":
                path = text
            elif kind == "table" and path:
                own[k] = (kind, path + "\n" + text, [*([path] if not path[1] == "." else [path[:2], path[3:]]), *said])
        want[f"UNK::d{doc}"] = sequential_chunks(own, cfg)
    got = {}
    for r in chunking.build_chunks(elements(spark, *rows), cfg).orderBy("doc_key", "chunk_index").collect():
        got.setdefault(r.doc_key, []).append(r.text)
    assert got == {k: v for k, v in want.items() if v}


def test_products_of_blocks_equal_those_of_broadcast_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(n, [float(x) for x in rng.integers(-3, 4, 6)]) for n in range(300)], "id bigint, vec array<double>")
    asked = rows.filter("id < 40").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    few = sorted(tuple(r) for r in search.top_k(asked, rows, 7).collect())
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    assert sorted(tuple(r) for r in search.top_k(asked, rows, 7).collect()) == few and len(few) == 40 * 7
    assert search.top_k(asked.filter("false"), rows, 7).count() == 0


def test_quoted_csv(spark):
    text = 'имя;число\n"бо;лт";"5\n6"\n\n"г""айка";7\nодин\n'
    got = files.csv_rows(spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "path string, text string")).collect()
    assert [(r.n, r.text) for r in got] == [(0, "имя: бо;лт; число: 5\n6"), (1, 'имя: г"айка; число: 7'), (2, "один")]


def test_entity_match_and_graph_filters(spark):
    node = spark.createDataFrame([("a", "document", 0.5, "x/1", "2024-01-05"), ("b", "document", 0.5, "y/1", "2024-03-01"), ("c", "section", 0.5, None, None)], "id string, type string, importance double, path string, date string").withColumn("date", F.col("date").cast("date"))
    index = spark.createDataFrame([("object_attributes", "ГОСТ 1", "a"), ("actors", "ООО Ток", "a"), ("identifiers", "№ 5", "a"), ("domain", "HR", "b"), ("identifiers", "№ 5", "b")], "kind string, value string, id string")
    asked = spark.createDataFrame([(1, "ГОСТ 1 и ГОСТ 2, № 5, кадры")], "query_id int, query string")
    got = {r.id: r.match for r in graph_search.entity_match(asked, index).collect()}
    # a: attributes and identifiers in both, half of the attributes; b: domain and identifiers, both in full
    assert got == {"a": round((0.2 + 0.3) * 1.5 / 2, 9), "b": 0.6}
    assert [r.id for r in graph_search.filtered(node, dates=("2024-01-01", "2024-01-31")).collect()] == ["a"]
    assert [r.id for r in graph_search.filtered(node, doc_type="document", path_prefix="y").collect()] == ["b"]


def test_universal_search_switches(spark):
    engine = Engine(spark)
    rows = elements(spark, *({"id": f"e{n}", "doc_id": f"d{n % 3}", "category": "Логистика" if n % 2 else "HR", "elem_order": n, "text": f"Текст номер {n} о бетоне и поставке."} for n in range(12)))
    index = engine.index(engine.chunk(rows))
    fields_ = engine.doc_fields(rows)
    asked = spark.createDataFrame([(1, "поставка бетона")], "query_id int, query string")
    near = spark.createDataFrame([(1, "section::9", "нет такого", 0.9, "текст")], "query_id int, node_id string, name string, graph_score double, content string")
    both = engine.search_universal(asked, index, fields_, graph_results=near, categories="graph, HR").collect()
    assert any(r.origin == "graph" for r in both) and all(r.origin == "graph" or r.doc_key.startswith("HR::") for r in both)
    assert all(r.origin == "text" for r in engine.search_universal(asked, index, fields_, use_graph=False, graph_results=near).collect())
    assert engine.search_universal(asked, index, fields_, use_reranker=True).count() > 0


def test_graph_is_saved_and_read(spark, tmp_path):
    rows = elements(spark, {"id": "a", "category": "А", "text": "1. Общие", "headings_path": ["1. Общие"]})
    g = Engine(spark).build_graph(rows)
    g.save(str(tmp_path / "g"))
    again = type(g).load(spark, str(tmp_path / "g"))
    assert again.nodes.count() == g.nodes.count() and again.edges.count() == g.edges.count()
    assert again.get_document_hierarchy(again.nodes.filter("type = 'folder'").select("id")).agg(F.max("depth")).first()[0] == 3


def test_rerank_and_context(spark):
    rows = [(1, "бетон", f"К::d{n % 3}", f"c{n}", "К", "p", n, f"бетон номер {n}. Ещё.", ["1. А"] if n % 2 else None, n, n, n / 10) for n in range(9)]
    hits = spark.createDataFrame(rows, "query_id int, query string, doc_key string, id string, category string, doc_path string, chunk_index int, text string, heading_path array<string>, page_from int, page_to int, score double")
    got = rerank.rerank(hits, 2, 2).collect()
    assert len({r.doc_key for r in got}) == 2 and max(r["rank"] for r in got) <= 2
    placed = context.items(rerank.rerank(hits, 3, 3))
    packed = context.pack(placed, ContextConfig(token_budget=30)).collect()
    assert packed and sum(r.tokens for r in packed) <= 30
    assert all(len([x for x in packed if x.section == r.section]) <= 2 for r in packed)
    assert "=== Раздел: " in context.prompt(context.pack(placed)).first().prompt
    assert context.quality(placed).first()["items"] == placed.count()


def test_coherence_of_page_gaps(spark):
    hits = spark.createDataFrame([(1, "d", p) for p in (1, 2, 9, None)] + [(1, "e", 5)], "query_id int, doc_key string, page_from int")
    assert {r.doc_key: r.coherence for r in rerank.coherence(hits).collect()} == {"d": 0.5, "e": 0.0}


def test_entities(spark):
    asked = spark.createDataFrame([(1, "Договор № 15/7 на цемент ГОСТ 31108-2016, 3000 тонн до 15 марта 2024 с ООО «Ромашка» FCA"), (2, None)], "query_id int, query string")
    got = {r.query_id: r for r in entities.extract(asked).collect()}
    assert got[1].domain == "Юристы" and got[1].object_attributes == ["ГОСТ 31108-2016"] and got[1].raw_dates == ["до 15 марта 2024"]
    assert got[1].identifiers == ["№ 15/7"] and got[1].constraints == ["Инкотермс: FCA"] and got[1].location is None
    assert got[1].confidences == {"domain": 0.9, "quantity": 0.95, "actors": 0.7}
    assert (got[1].quantity.value, got[1].quantity.unit) == (3000.0, "тонн") and got[1].incoterms == ["FCA"] and got[1].actors == ["ООО «Ромашка»"]
    assert got[2].domain is None and got[2].object_attributes == []
    names = spark.createDataFrame([("Отрадная",)], "entry string")
    q = spark.createDataFrame([(1, "станция Отрадная"), (2, "Отрадная, станция")], "query_id int, query string")
    assert {r.query_id: r.place for r in entities.stations(q, names).collect()} == {1: "destination", 2: "origin"}
    found = {r.query_id: r.location for r in entities.extract(q, names).collect()}
    assert found[1].destination == "Отрадная" and found[1].origin is None and found[2].origin == "Отрадная"
    more = spark.createDataFrame([(1, "HR", ["ТУ 1"], None), (2, "иное", None, ["ООО Ток"])], "query_id int, domain string, object_attributes array<string>, actors array<string>")
    merged = {r.query_id: r for r in entities.merge_model(entities.extract(asked), more).collect()}
    assert merged[1].domain == "HR" and merged[1].object_attributes == ["ГОСТ 31108-2016", "ТУ 1"] and merged[2].domain is None and merged[2].actors == ["ООО Ток"]


def test_graph(spark):
    rows = elements(
        spark,
        {"id": "a", "category": "А/Б/В", "elem_order": 1, "text": "1. Общие см. раздел 2", "headings_path": ["1. Общие"]},
        {"id": "b", "category": "А/Б/В", "elem_order": 2, "text": "2 см. глава 1", "headings_path": ["2 Цены"]},
        {"id": "c", "category": None, "doc_id": None, "text": None},
    )
    engine = Engine(spark)
    g = engine.build_graph(rows)
    types = {r.type: r["count"] for r in g.nodes.groupBy("type").count().collect()}
    assert types["folder"] == 3 and types["document"] == 2 and types["section"] == 2
    refs = {(r.src[-1], r.dst[-1]) for r in g.edges.filter("rel = 'references'").collect()}
    assert refs == {("1", "2"), ("2", "1")}
    ranks = graph.pagerank(g.nodes, g.edges)
    assert abs(ranks.agg(F.sum("rank")).first()[0] - 1) < 1e-6
    path = [r.id for r in g.get_structural_path("folder::А", "section::А/Б/В::d::1").orderBy("step").collect()]
    assert path == ["folder::А", "folder::А/Б", "folder::А/Б/В", "document::А/Б/В::d", "section::А/Б/В::d::1"]
    assert g.get_structural_path("section::А/Б/В::d::1", "folder::А").count() == 0
    near = {r.id: r.distance for r in g.get_related_nodes(spark.createDataFrame([("folder::А",)], "id string")).collect()}
    assert near == {"folder::А/Б": 1, "folder::А/Б/В": 2}


def test_graph_search_finds_by_entity(spark):
    node = spark.createDataFrame([("document::1", "document", 0.5), ("document::2", "document", 0.5)], "id string, type string, importance double")
    edge = spark.createDataFrame([("document::1", "document::2", "references", 0.8)], "src string, dst string, rel string, weight double")
    texts = spark.createDataFrame([("document::1", "по ГОСТ 12-34 и ООО «Ток»"), ("document::2", "иное ООО «Ток»")], "id string, text string")
    index = graph.entity_index(node, texts)
    asked = spark.createDataFrame([(1, "что по ГОСТ 12-34")], "query_id int, query string")
    ranks = graph.pagerank(node, edge)
    got = graph_search.search(asked, node, edge, index, ranks, texts.withColumnRenamed("text", "content")).orderBy("rank_no").collect()
    assert got[0].id == "document::1" and len(got) == 2
    similar = graph_search.similar_documents(index, node.select("id").limit(1)).collect()
    assert len(similar) == 1 and similar[0].shared == 1


def test_documents_and_lexicon(spark):
    rows = elements(spark, {"id": "a", "elem_order": 2, "headings_path": ["Б", "А"]}, {"id": "b", "elem_order": 1, "headings_path": ["В", "Б "]}, {"id": "a", "elem_order": 2, "headings_path": ["Б", "А"]})
    assert fields.heading_texts(rows).first().heading_text == "В Б А"
    assert fields.documents_of(rows).first().elements == 2
    assert fields.doc_fields(rows.filter("false")).count() == 0


def test_html_and_markdown():
    page = "<h1>Заг</h1><p>один <b>два<p>три<ul><li>a<li><p>b</p></ul><table><tr><td>1</td><td>2</td></tr></table><script>x</script><img src='u.png'>"
    got = markup.html_elements(page)
    assert [k for k, *_ in got] == ["title", "paragraph", "paragraph", "list", "list", "paragraph", "table", "image"]
    assert got[6][1] == "1\t2" and got[7][2] == "u.png"
    assert markup.html_elements(None) == []
    md = markup.html_elements(markup.markdown_html("# A\n\nтекст\n\n- b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```"))
    assert [k for k, *_ in md] == ["title", "paragraph", "list", "table", "paragraph"]


def test_office_files(tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Абзац</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", doc)
    assert list(office.docx_items(raw.getvalue())) == [("paragraph", "Абзац", None), ("table", "1\t2", None)]


def test_ingest_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes("Строка раз\n\nСтрока два".encode("cp1251"))
    (tmp_path / "t.csv").write_text("имя;число\nболт;5\n", encoding="utf-8")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "~$lock.txt").write_text("x")
    got = Engine(spark).ingest(str(tmp_path)).collect()
    texts = {(r.source_type, r.text) for r in got}
    assert ("txt", "Строка раз") in texts and ("txt", "Строка два") in texts and ("csv", "имя: болт; число: 5") in texts
    assert {r.source_type for r in got if "error" in r.metadata} == {"docx", "pdf"}


def test_charset():
    assert charset.decode_best("Бетон".encode()) == ("Бетон", "utf-8")
    assert charset.decode_best("Бетон".encode("cp1251")) == ("Бетон", "cp1251")
    assert charset.decode_best(b"\xef\xbb\xbfabc") == ("abc", "utf-8-sig")
    assert charset.decode_best(None) == (None, None)


def test_two_columns_of_blocks(spark):
    rows = [("d", 1, f"l{n}", [0.0, float(n), 100.0, n + 1.0]) for n in range(4)] + [("d", 1, f"r{n}", [300.0, float(n), 400.0, n + 1.0]) for n in range(4)] + [("d", 2, "x", [0.0, 5.0, 9.0, 6.0])]
    df = spark.createDataFrame(rows, "doc_key string, page int, id string, bbox array<double>")
    got = {r.id: (r.col_no, r.n) for r in files.block_order(df).collect()}
    assert got["l0"] == (0, 0) and got["r0"] == (1, 4) and got["x"] == (0, 0)


def test_round_trip_of_elements(spark, tmp_path):
    rows = elements(spark, {"id": "a", "text": "ж", "metadata": {"k": "v"}}, {"id": "b"})
    sinks.write_jsonl(rows, str(tmp_path / "e"))
    assert {tuple(map(str, r)) for r in files.read_elements(spark, str(tmp_path / "e")).collect()} == {tuple(map(str, r)) for r in rows.collect()}


def test_upsert_without_a_store(spark):
    class Down:
        def ping(self):
            raise ConnectionError

    assert sinks.upsert(spark.range(3), Down) is False


def test_stream_keeps_rows_older_than_the_watermark(spark, tmp_path):
    parts = [[("a", "2024-02-14"), ("b", "2024-01-01")], [("c", "2024-01-01"), ("a", "2024-02-15")], [("d", "2024-01-02"), ("c", "2024-02-16"), (None, "2024-01-02")]]
    for n, part in enumerate(parts):
        rows = spark.createDataFrame([(key, "x", "pdf", "text", day) for key, day in part], "id string, category string, source_type string, text string, day string")
        rows.withColumn("parsed_at", F.to_timestamp("day")).drop("day").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows.parquet"))
        assert len(list((tmp_path / "rows.parquet").glob("*.parquet"))) == n + 1
    got = ingest.latest_elements(spark, str(tmp_path / "rows.parquet"), 1).collect()
    assert sorted(tuple(r) for r in got) == [(key, "x", "pdf", 4) for key in "abcd"]


def test_columns_of_the_same_name_and_empty_tables(spark):
    """Chunks may bring columns that the search makes itself; a graph without nodes has no ranks."""
    rows = [(f"c{n}", "К", "d", "p", f"бетон слово{n}", n, n, n, 1, 1, ["1. А"], "x", "y") for n in range(4)]
    chunks = spark.createDataFrame(rows, "id string, category string, doc_id string, doc_path string, text string, chunk_index int, from_order int, to_order int, page_from int, page_to int, heading_path array<string>, rank string, score string")
    asked = spark.createDataFrame([(1, "бетон слово3")], "query_id int, query string")
    index = search.index(chunks)
    assert search.search_raw(asked, index, 2, 2).count() == 2
    assert search.search_window(asked, index, 2, 2, 1).count() == 1
    assert graph.pagerank(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES)).count() == 0


def test_long_headings_and_long_numbers(spark, monkeypatch):
    """Chunks below a long heading are handed on in parts; a long number does not overflow the matcher."""
    number = "1." * 50_000 + "1"
    rows = elements(spark, {"id": "a", "elem_order": 1, "text": "1 " + "Общие " * 5_000, "headings_path": None}, {"id": "b", "elem_order": 2, "text": "Бетон сухой. " * 3_000}, {"id": "c", "elem_order": 3, "text": number})
    whole = {r.chunk_index: r.text for r in chunking.build_chunks(rows).collect()}
    monkeypatch.setattr(chunking, "FRAME_CHARS", 100)
    assert {r.chunk_index: r.text for r in chunking.build_chunks(rows).collect()} == whole and len(whole) > 10
    refs = rows.select(text.references("text").alias("r"), text.heading_depth("text").alias("d")).filter("d > 0").first()
    assert refs.d == 50_000 and refs.r == []


def test_pipeline_searches_once(spark, monkeypatch):
    """The index and the hits serve universal search and the contexts alike; without a filter no more hits are sought than are kept."""
    made, sought = [], []
    index, top_k = search.index, search.top_k
    monkeypatch.setattr(search, "index", lambda *a: made.append(1) or index(*a))
    monkeypatch.setattr(search, "top_k", lambda q, rows, k, *a, **b: sought.append(k) or top_k(q, rows, k, *a, **b))
    assert plans.REGISTRY["pipeline_context"](spark, "/root/testdata/sf0.001").count() > 0
    assert made == [1] and sought == [180]


def test_fusion_of_a_document_given_twice(spark):
    asked = spark.createDataFrame([(1, "смета бетона"), (2, None)], "query_id int, query string")
    docs = spark.createDataFrame([("d1", "смета"), ("d1", "смета и бетон"), ("d2", "")], "doc_key string, heading_text string").withColumns({"path_text": F.lit(""), "category": F.lit("К")})
    docs = docs.withColumn("nav_tokens", fields.nav_tokens()).withColumns({f"{x}_vec": vectors.encode(c) for x, c in (("heading", "heading_text"), ("path", "path_text"), ("category", "category"))})
    dense = spark.createDataFrame([(1, "d1", 0.5), (1, "d2", 0.4), (1, "d3", 0.3), (2, "d1", 0.1)], "query_id int, doc_key string, dense double")
    got = ranking.fuse(dense, asked, docs, fields.lexicon(docs), keep=("heading_text",)).collect()
    assert sorted((r.query_id, r.doc_key, r.heading_text) for r in got if r.heading_text is not None) == [(1, "d1", "смета"), (1, "d1", "смета и бетон"), (1, "d2", ""), (2, "d1", "смета"), (2, "d1", "смета и бетон")]
    known = {(r.query_id, r.doc_key): r.bm25 for r in ranking.bm25(asked, docs).collect()}
    assert known and all(r.bm25 == known.get((r.query_id, r.doc_key), 0.0) for r in got)
    # its BM25 of 0 is the largest here, as a token of all documents counts against d1
    assert [(r.gate, r.heading_score, r.fused) for r in got if r.doc_key == "d3"] == [(1.0, 0.0, 0.8)]


def test_graph_search_ties_go_to_the_lower_id(spark):
    """Scores that round to the same tie, whatever the ranks behind them."""
    rows = [(f"s{n:02}", "section", 0.5) for n in range(40)]
    node = spark.createDataFrame(rows, "id string, type string, importance double")
    ranks = spark.createDataFrame([(r[0], n * 1e-8) for n, r in enumerate(rows)], "id string, rank double")
    edge = spark.createDataFrame([], "src string, dst string, rel string, weight double")
    index, contents = spark.createDataFrame([], "kind string, value string, id string"), spark.createDataFrame([], "id string, content string")
    asked = spark.createDataFrame([(1, "что угодно")], "query_id int, query string")
    got = graph_search.search(asked, node, edge, index, ranks, contents).orderBy("rank_no").collect()
    assert [r.id for r in got] == [f"s{n:02}" for n in range(10)]


def test_graph_search_by_blocks_and_by_joins_agree(spark, monkeypatch):
    texts = ["Договор № 7 на ГОСТ 31108-2016, «Север»\u00a0порт", "Поставка, отгрузка. ГОСТ 31108-2016", "", None, "договор " + "я" * 3000, "Кадры\tи персонал № 7"] * 4
    node = spark.createDataFrame([(f"document::{n}", "document", None) for n in range(len(texts))] + [(f"section::{n}", "section", n / 50) for n in range(30)] + [("element::1", "table", 0.9)], "id string, type string, importance double")
    contents = spark.createDataFrame([(f"document::{n}", t) for n, t in enumerate(texts)], "id string, content string")
    ranks = node.select("id", F.round(F.pmod(F.hash("id"), F.lit(1000)) / 1e5, 9).alias("rank"))
    edge = spark.createDataFrame([(f"document::{n}", f"section::{n}", "has_section", 1.0) for n in range(20)] + [("section::1", "element::1", "contains_element", 1.0)], "src string, dst string, rel string, weight double")
    index = graph.entity_index(node, contents.withColumnRenamed("content", "text")).unionByName(spark.createDataFrame([("domain", "HR", "element::1"), ("domain", "HR", "nowhere")], "kind string, value string, id string"))
    asked = spark.createDataFrame([(1, "Договор № 7, ГОСТ 31108-2016 и ГОСТ 5"), (2, "порт яяя яяя"), (3, "кадры № 7"), (4, None), (5, " "), (6, "север»\u00a0п поставка,")], "query_id int, query string")
    found = lambda: graph_search.search(asked, node, edge, index, ranks, contents).select("query_id", "rank_no", "id", "graph_score", "hops", "preview")
    blocks = sorted(map(tuple, found().collect()), key=str)
    monkeypatch.setattr(graph_search, "BROADCAST_QUERIES", 0)
    assert blocks == sorted(map(tuple, found().collect()), key=str)
    assert {r[0] for r in blocks} == {1, 2, 3, 5, 6}


def test_rounding_as_spark_does(spark):
    values = [0.0000005, 0.1234565, 1.0000005, 0.3333335, 2.5e-7, 0.1 + 0.2, 0.14159249999999998, 123.4567895]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert list(graph_search.rounded(np.array(values), 6) / 1e6) == got


def test_pagerank_in_few_jobs(spark, monkeypatch):
    edge = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0), ("a", "a", 0.5), ("d", "c", 1.0), ("b", "elsewhere", 1.0), ("elsewhere", "a", 1.0)], "src string, dst string, weight double")
    node = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    spark.sparkContext.setJobGroup("ranks", "")
    one = {r.id: r["rank"] for r in graph.pagerank(node, edge).collect()}
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranks")) < 30
    monkeypatch.setattr(graph, "CORE_ROWS", 0)
    assert {r.id: r["rank"] for r in graph.pagerank(node, edge).collect()} == one
    held = dict.fromkeys("abcde", 0.2)
    p = {("a", "b"): 2 / 3, ("a", "a"): 1 / 3, ("b", "a"): 0.25, ("b", "c"): 0.5, ("d", "c"): 1.0}
    for _ in range(20):
        idle = (held["c"] + held["e"]) / 5
        held = {x: 0.03 + 0.85 * (sum(held[s] * w for (s, t), w in p.items() if t == x) + idle) for x in held}
    assert one == {x: round(v, 9) for x, v in held.items()}


def test_entities_are_found_in_one_pass(spark):
    """Of the texts one scan, whatever the kinds; null and empty texts have none."""
    texts = spark.createDataFrame([("a", "Договор № 5 с ООО Ток, ГОСТ 1"), ("b", None), ("c", ""), ("d", "ОТГРУЗКА")], "id string, text string")
    index = graph.entity_index(texts.select("id"), texts)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan
    assert {(r.kind, r.value, r.id) for r in index.collect()} == {("object_attributes", "ГОСТ 1", "a"), ("identifiers", "№ 5", "a"), ("actors", "ООО Ток", "a"), ("domain", "Юристы", "a"), ("domain", "Логистика", "d")}


def test_rerank_scores_once(spark):
    rows = [(1, "бетон", f"К::d{n % 3}", f"c{n}", f"бетон номер {n}.", ["1. А"], n, n, n / 10) for n in range(9)]
    hits = spark.createDataFrame(rows, "query_id int, query string, doc_key string, id string, text string, heading_path array<string>, page_from int, page_to int, score double")
    best = rerank.rerank(hits, 2, 2)
    assert "ArrowEvalPython" not in best._jdf.queryExecution().optimizedPlan().toString() and best.count() == 4
