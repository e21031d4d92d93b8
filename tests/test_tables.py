"""Sources, ingest, training samples and the stream."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from qirtas.operators import ingest as ig
from qirtas.operators import training_data as td
from qirtas.sources import tables as src
from qirtas.streaming.crawl import PAGE_SCHEMA, VersionedTable, upsert_stream

NOW = datetime(2025, 1, 10, tzinfo=timezone.utc)
OLD = datetime(2024, 12, 1, tzinfo=timezone.utc)
NEW = datetime(2025, 1, 9, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a", "r1", "t1", OLD, OLD, OLD, "success", 200, None), (2, "b", "r2", "t2", OLD, NEW, NEW, "failed", 500, "HTTP 500"), (3, "c", None, None, OLD, OLD, None, "pending", None, None), (4, "d", "r4", "t4", OLD, NEW, NEW, "success", 200, None)]
    return spark.createDataFrame(rows, src.DOCUMENT_SCHEMA)


def names(df):
    return sorted(r["url"] for r in df.collect())


def test_refresh_modes(spark, docs):
    urls = spark.createDataFrame([(u,) for u in "abcdx"], "url string")
    pick = lambda **mode: names(ig.urls_to_crawl(urls, docs, as_of=NOW, **mode))
    assert pick(refresh=True, retry_failed=True) == list("abcdx") and pick(retry_failed=True, refresh_days=1) == ["b"] and pick(refresh_days=30) == ["a", "c", "x"] and pick() == ["b", "c", "x"]
    listed = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "position int, url string")
    assert names(ig.first_pages(listed, 2)) == ["a", "b"] and names(ig.first_pages(listed, 0)) == ["a", "b", "c"]


FETCHED = "url string, content_raw string, content_text string, crawl_status string, http_status int, error_message string"


def test_upserts_keep_and_clear_what_they_should(spark, docs):
    fetched = spark.createDataFrame([("b", "n2", "m2", "success", 200, None), ("d", None, None, "failed", 404, "HTTP 404"), ("x", "n5", "m5", "success", 200, None), ("w", None, None, "failed", 0, "timeout"), ("w", None, None, "failed", 0, "timeout")], FETCHED)
    out = {r["url"]: r for r in ig.upsert(docs, fetched, NOW).collect()}
    assert len(out) == 6 and (out["w"]["id"], out["x"]["id"]) == (5, 6)
    assert (out["b"]["content_text"], out["b"]["error_message"], out["b"]["id"], out["b"]["crawl_status"]) == ("m2", None, 2, "success") and out["b"]["created_at"] != out["b"]["updated_at"]
    assert (out["d"]["content_raw"], out["d"]["content_text"], out["d"]["crawl_status"], out["d"]["http_status"]) == (None, "t4", "failed", 404)
    assert out["a"]["updated_at"] == docs.where("url = 'a'").first()["updated_at"]
    again = ig.upsert(ig.upsert(docs, fetched, NOW), fetched, NOW)
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in out.values())
    assert ig.upsert(docs, fetched.limit(0), NOW).count() == 4
    assert names(ig.delete_url(docs, "a")) == ["b", "c", "d"]
    added = ig.insert(docs, spark.createDataFrame([("a", "x", "y"), ("z", "x", "y")], "url string, content_raw string, content_text string"), NOW)
    row = added.where("url = 'z'").first()
    assert added.count() == 5 and (row["id"], row["crawl_status"], row["content_text"]) == (5, "pending", "y")


def test_outcomes(spark):
    rows = [(200, "<p>", "t", None), (404, "<p>", "t", None), (200, "", "t", None), (200, "<p>", None, None), (0, None, None, "timeout"), (None, None, None, None)]
    out = spark.createDataFrame(rows, "s int, h string, t string, e string").select(ig.classify_fetch(F.col("s"), F.col("h"), F.col("t"), F.col("e")).alias("o")).select("o.*")
    assert [tuple(r) for r in out.collect()] == [("success", None), ("failed", "HTTP 404"), ("failed", "HTTP 200"), ("failed", "Parsing failed: no content extracted"), ("failed", "timeout"), ("failed", "HTTP 0")]
    assert ig.crawl_counters(out).first().asDict() == {"total": 6, "success": 1, "failed": 5, "skipped": 0}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><body><nav>x</nav><h1>T</h1><p>a <b>b</b> <a href='/u'>c</a></p><ul><li>d</li></ul><script>e</script></body></html>", "# T\na **b** [c](/u)\n* d"), ("<body>x <a href='/ar/services'>الخدمات</a> y</body>", "[الخدمات](/ar/services) y"),
        ("<p>no body</p>", None), ("<body></body>", None), ("", None), (None, None),
    ],
)
def test_pages_to_markdown(page, text):
    assert ig.html_to_markdown(page) == text


def test_preflight(spark, docs):
    assert {r["name"]: r["passed"] for r in ig.preflight(docs).collect()} == dict.fromkeys(("has_rows", "keys_present", "urls_unique", "known_status", "success_has_text"), True)
    assert not {r["name"]: r["passed"] for r in ig.preflight(docs.unionAll(docs)).collect()}["urls_unique"]


def test_ground_truth_files(spark, tmp_path):
    path = tmp_path / "truth.json"
    path.write_text(json.dumps({"queries": [{"id": 1, "query": "a", "relevant_docs": [3, 3, 1]}, {"id": 2, "query": "a", "highly_relevant": [4]}, {"id": 3, "query": "b"}]}))
    assert sorted((r["id"], r["relevant_docs"], r["highly_relevant"]) for r in src.read_ground_truth(spark, str(path)).collect()) == [(2, [], [4]), (3, [], [])]
    path.write_text("{broken")
    assert src.read_ground_truth(spark, str(path)).count() == 0 and src.read_ground_truth(spark, str(tmp_path / "none.json")).count() == 0


def test_sitemaps(spark):
    ns = '<urlset xmlns="http://s.example/x">'
    rows = [(1, f"{ns}<url><loc>https://a/ar/services/1</loc></url><url><loc> https://a/ar/news/2 </loc></url><url><loc>https://a/ar/services/1</loc></url></urlset>"), (2, f"{ns}<url><loc>https://a/ar/services/3</loc></url><url>"), (3, None), (4, "<sitemapindex><sitemap><loc>m.xml</loc></sitemap></sitemapindex>\n"), (5, '<s:urlset xmlns:s="http://s.example/x"><s:url><s:loc>https://a/ar/services/5?a=1&amp;b=2</s:loc></s:url></s:urlset>'), (6, "<urlset>&"), (7, "")]
    maps = spark.createDataFrame(rows, "sitemap_id bigint, xml string")
    assert names(src.sitemap_urls(maps)) == ["https://a/ar/services/1"] * 2 + ["https://a/ar/services/5?a=1&b=2"] and names(src.sitemap_children(maps)) == ["m.xml"]


def test_fetching_folds_errors(spark):
    def fetcher():
        def fetch(url):
            if url == "b":
                raise TimeoutError("too slow")
            return f"<p>{url}</p>", 200, None

        return fetch

    out = src.fetch_pages(spark.createDataFrame([("a",), ("b",)], "url string"), fetcher)
    assert sorted(map(tuple, out.collect())) == [("a", "<p>a</p>", 200, None), ("b", None, 0, "too slow")]


def test_embedding_tables(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0])], "doc_id bigint, embedding array<float>")
    src.write_embeddings(vectors, str(tmp_path), "gemma", "m1")
    assert src.read_embeddings(spark, str(tmp_path), "gemma-int8", "m1").count() == 1
    assert src.read_embeddings(spark, str(tmp_path), "gemma", "m2") is None and src.read_embeddings(spark, str(tmp_path), "other", "m1") is None


def test_folders_and_samples(spark, tmp_path, docs):
    (tmp_path / "a.txt").write_text("x\ny")
    (tmp_path / "b.bin").write_text("z")
    assert [r["text"] for r in src.read_folder(spark, str(tmp_path)).collect()] == ["x\ny"]
    td.write_texts(docs, str(tmp_path / "out"))
    packed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["body"] for r in packed.collect()) == ["Source URL: a\n\nt1", "Source URL: d\n\nt4"]
    assert td.unpack_texts(packed, str(tmp_path / "files")).count() == 2 and (tmp_path / "files" / "doc_1.txt").read_text() == "Source URL: a\n\nt1"
    assert [r["filename"] for r in td.export_texts(docs).orderBy("filename").collect()] == ["doc_1.txt", "doc_4.txt"]


def test_json_lines_resume(spark, tmp_path):
    path, rows = str(tmp_path / "s.jsonl"), lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "doc_id bigint, text string")
    assert td.append_json_lines(spark, rows(1, 2), path) == 2 and td.append_json_lines(spark, rows(3, 2, 1), path) == 1 and td.append_json_lines(spark, rows(1), path) == 0
    assert sorted(r["doc_id"] for r in src.read_json_lines(spark, path, "doc_id bigint, text string").collect()) == [1, 2, 3]


def test_chat_samples(spark):
    turn = lambda role, text: {"role": role, "content": text}
    rows = [(1, [turn("system", "s"), turn("user", "u"), turn("assistant", "<think>t</think>a")]), (2, [turn("system", "s")]), (3, None), (4, [turn("system", "s"), turn("user", None), turn("assistant", "None")])]
    samples = spark.createDataFrame(rows, "sample_id bigint, conversations array<struct<role:string,content:string>>")
    assert [r["text"] for r in td.chat_rows(samples).collect()] == ["<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n<think>t</think>a<|im_end|><|im_end|>"]
    assert [tuple(r) for r in td.think_split(samples).orderBy("sample_id").collect()] == [(1, "t", "a"), (4, None, "None")]
    assert td.chat_to_qfs(samples).first()["text"].endswith("### Input:\nu\n\n### Response:\na<|im_end|>")
    raw = spark.createDataFrame([(1, '{"question":"q","final_response":"r"}'), (2, '{"question":"q"}'), (3, "{"), (4, None)], "doc_id bigint, raw string")
    assert [tuple(r) for r in td.parse_answers(raw).collect()] == [(1, "q", "<think>Answer generated based on context.</think>", "r", "<think>Answer generated based on context.</think>\nr")]


def test_stream_upserts_whole_versions(spark, tmp_path, docs):
    table, landing = VersionedTable(spark, str(tmp_path / "docs")), tmp_path / "pages"
    docs.write.parquet(table.path(0))
    page = lambda *rows: spark.createDataFrame(list(rows), PAGE_SCHEMA).coalesce(1).write.mode("append").json(str(landing))
    page(("a", "<body><p>fresh</p></body>", 200, None), ("n", None, 404, None))
    stream = lambda: upsert_stream(spark.readStream.schema(PAGE_SCHEMA).json(str(landing)), table, str(tmp_path / "ck"), NOW).awaitTermination()
    stream()
    first = {r["url"]: r for r in table.read(1).collect()}
    assert first["a"]["content_text"] == "fresh" and (first["n"]["crawl_status"], first["n"]["id"]) == ("failed", 5)
    page(("n", "<body>now</body>", 200, None))
    stream()
    second = {r["url"]: r for r in table.read(2).collect()}
    assert second["n"]["content_text"] == "now" and second["n"]["id"] == 5 and len(second) == 5


def test_answers_become_conversations(spark):
    rows = [(1, "c", '{"question": "q", "final_response": "r", "thought_process": "<think>t</think>"}'), (2, "c", '{"question": "q", "final_response": "r"}'), (3, "c", '{"question": "q"}'), (4, "c", "{cut"), (5, "c", None)]
    out = td.conversations(td.parse_answers(spark.createDataFrame(rows, "sample_id bigint, context string, raw string")), "system")
    said = {r["sample_id"]: [t["content"] for t in r["conversations"]] for r in out.collect()}
    assert said == {1: ["system", "السياق:\nc\n\nالسؤال:\nq", "<think>t</think>\nr"], 2: ["system", "السياق:\nc\n\nالسؤال:\nq", "<think>Answer generated based on context.</think>\nr"]}


def test_teacher_prompts(spark):
    from qirtas.functions.text import teacher_prompt

    row = spark.range(1).select(teacher_prompt(F.lit("abcdef"), "Ask.", 3, F.lit("f.txt")).alias("a"), teacher_prompt(F.lit("abc"), "Say.", 2, question=F.lit("q?")).alias("b")).first()
    assert row["a"] == "CONTEXT FROM FILE (f.txt):\nabc\n\nINSTRUCTION:\nAsk." and row["b"] == 'CONTEXT:\nab\n\nUSER QUESTION:\n"q?"\n\nINSTRUCTION:\nSay.'


def test_truth_look_ups(spark):
    truth = src.GroundTruth(src.ground_truth(spark.createDataFrame([(1, "q", None, [3, 3], None), (2, "p", "d", None, None)], "id bigint, query string, description string, relevant_docs array<bigint>, highly_relevant array<bigint>")))
    assert truth.count() == 2 and truth.has("q") and not truth.has("x") and truth.get("q").first()["relevant_docs"] == [3] and sorted(r[0] for r in truth.list().collect()) == ["p", "q"]


def test_fewer_embeddings_than_documents_warn(spark, tmp_path):
    src.write_embeddings(spark.createDataFrame([(1, [1.0])], "doc_id bigint, embedding array<float>"), str(tmp_path), "gemma", "m1")
    with pytest.warns(UserWarning, match="1 embeddings for 2"):
        assert src.read_embeddings(spark, str(tmp_path), "gemma", "m1", 2).count() == 1


PAGE = "<html><body><nav>menu</nav><a href='/ar/services'>الخدمات</a><h1>T {}</h1></body></html>"
SITE = {
    "s/": PAGE.format("home"), "s/sitemap.xml": "<sitemapindex><sitemap><loc>s/a.xml</loc></sitemap><sitemap><loc>s/gone.xml</loc></sitemap><sitemap><loc>s/b.xml</loc></sitemap></sitemapindex>",
    "s/a.xml": "<urlset><url><loc>s/ar/services/2</loc></url><url><loc>s/ar/services/1</loc></url><url><loc>s/ar/news/9</loc></url></urlset>", "s/b.xml": "<urlset><url><loc>s/ar/services/3</loc></url><url><loc>s/ar/services/2</loc></url><url><loc>s/ar/services/4</loc></url></urlset>",
    "s/ar/services/1": PAGE.format(1), "s/ar/services/2": PAGE.format(2), "s/ar/services/3": "no page",
}


def site():
    pages = dict(SITE)

    def make():
        def fetch(url):
            if url == "s/ar/services/4":
                raise TimeoutError("too slow")
            return (pages[url], 200, None) if url in pages else ("<body>gone</body>", 404, None)

        return fetch

    return make


def test_a_crawl_from_end_to_end(spark, tmp_path):
    from qirtas.plans import crawl as cr

    bot = cr.SitemapBot("site", site(), "s/", "s/sitemap.xml", "s/ar/services/1")
    assert [r["url"][-1] for r in bot.urls(spark).orderBy("position").collect()] == list("21324")
    empty = spark.createDataFrame([], src.DOCUMENT_SCHEMA)
    run = cr.crawl(bot, empty, site(), delay=0, now=NOW, folder=str(tmp_path))
    assert run.failed == [] and [c[0] for c in run.checks][-2:] == ["fetcher", "site preflight"] and run.counters == {"total": 4, "success": 2, "failed": 2, "skipped": 0}
    rows = {r["url"][-1]: r for r in run.documents.collect()}
    assert (rows["1"]["content_text"], rows["1"]["crawl_status"]) == ("[الخدمات](/ar/services)\n# T 1", "success")
    assert (rows["3"]["content_raw"], rows["3"]["error_message"]) == ("no page", "Parsing failed: no content extracted") and (rows["4"]["content_raw"], rows["4"]["http_status"], rows["4"]["error_message"]) == (None, 0, "too slow")
    again = cr.crawl(bot, run.documents, site(), delay=0, now=NOW, run_preflight=False, max_pages=1)
    assert again.counters["total"] == 1 and again.documents.count() == 4
    none = cr.crawl(bot, run.documents, site(), delay=0, retry_failed=True, max_pages=None, run_preflight=False)
    assert none.counters == {"total": 2, "success": 0, "failed": 2, "skipped": 0}


def test_failing_checks_stop_a_crawl(spark):
    from qirtas.plans import crawl as cr

    empty = spark.createDataFrame([], src.DOCUMENT_SCHEMA)
    for home, sample, why in (("x", "s/", "Main site failed: 404, None"), ("s/", "s/ar/services/3", "Parsing failed: no content extracted")):
        run = cr.crawl(cr.SitemapBot("site", site(), home, "s/sitemap.xml", sample), empty, site(), delay=0)
        assert run.documents is None and run.counters == cr.NOTHING and run.failed == [f"site preflight: {why}"]
    assert cr.site_test("t", lambda: 1 / 0) == ("t", False, "Exception: division by zero")
    assert cr.ListBot("list", spark.createDataFrame([("a",)], "url string")).check() == (True, "list lists addresses")


def test_scratch_tables_are_deleted(spark, docs):
    from qirtas.session import materialise, scratch

    kept = materialise(docs, "kept")
    with scratch(spark):
        gone = materialise(docs, "gone")
        assert gone.count() == 4
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        gone.count()
