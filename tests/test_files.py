"""Files read and written."""

import json

from factloom.sources import files


def test_parsed_documents_and_chunks(spark, tmp_path):
    element = lambda i: {"element_id": f"e{i}", "page": 1, "position_in_page": i, "reading_order": i, "element_type": "text", "content": f"c{i}"}
    (tmp_path / "in").mkdir()
    for d in "ab":
        (tmp_path / "in" / f"{d}.json").write_text(json.dumps({"document_id": d, "total_pages": 1, "pages": [{"page_number": 1, "elements": [element(0), element(1)]}]}, indent=1))
    elements = files.parsed_elements(spark, str(tmp_path / "in"))
    assert elements.count() == 4 and {r.content for r in elements.collect()} == {"c0", "c1"}
    chunks = spark.createDataFrame([("a", "a_chunk_0000", "c0 c1", ["e1", "e0"]), ("b", "b_chunk_0000", "", [])], "document_id string, chunk_id string, text string, element_ids array<string>")
    files.save_chunks(chunks, str(tmp_path / "chunks"))
    loaded = {r.chunk_id: r.elements for r in files.load_chunks(spark, str(tmp_path / "chunks"), elements).collect()}
    assert [e.element_id for e in loaded["a_chunk_0000"]] == ["e0", "e1"] and loaded["b_chunk_0000"] is None
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF")
    assert files.discover(spark, str(tmp_path / "in")).count() == 1


def test_log_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "seq int, event string")
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    built = []
    make = lambda: built.append(1) or rows
    for _ in range(2):
        assert files.snapshot(spark, str(tmp_path / "kept"), "f1", make).count() == 1
    assert len(built) == 1 and files.snapshot(spark, str(tmp_path / "kept"), "f2", make).count() == 1 and len(built) == 2
