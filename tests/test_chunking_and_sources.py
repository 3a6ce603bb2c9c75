import io
import zipfile

import pytest

from tarn.operators import chunking, profiling
from tarn.sources import commits, files, index


def test_sections_have_no_overlap():
    chunks = chunking.chunk("# A\none two three\n\n# B\nfour five", 100, 10)
    assert [(c[1], c[2]) for c in chunks] == [("A", "one two three"), ("B", "four five")]


def test_overflow_repeats_the_tail():
    chunks = chunking.chunk("a b c d\n\ne f g h", 5, 2)
    assert chunks[0][2] == "a b c d" and chunks[1][2] == "c d\n\ne f g h"


def test_oversized_blocks_split_at_sentences():
    assert chunking.split_sentences("one two. three four. five six.", 6) == ["one two.three four.", "five six."]


def test_untitled_blocks_belong_to_what_follows():
    text = "intro\n\n# A\none\n\n# B\ntwo two"
    assert chunking.chunk(text, 100, 10) == [(0, "A", "intro\n\none", 2), (1, "B", "two two", 2)]
    assert chunking.chunk(text, 1, 1) == [(0, None, "intro", 1), (1, "A", "intro\n\none", 2), (2, "B", "two two", 2)]


def test_no_text_gives_no_chunk():
    assert chunking.chunk("", 10, 2) == chunking.chunk("# only a title\n\n", 10, 2) == []


def test_chunks_of_documents(spark):
    rows = spark.createDataFrame([(1, "a b c d\n\ne f g h", ".md"), (2, "x", ".CSV"), (3, "x", ".csv"), (4, None, None)], "doc_id int, text string, file_type string")
    found = chunking.chunk_documents(rows, 5, 2).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.text, r.tokens) for r in found] == [(1, 0, "a b c d", 4), (1, 1, "c d\n\ne f g h", 6), (2, 0, "x", 1)]
    assert len({r.chunk_id for r in found}) == 3 and all(r.chunk_id.startswith("chunk_") for r in found)


def test_parents_and_their_chunks(spark):
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, " "), (2, None, "whole")], "doc_id int, page int, text string")
    parents = chunking.parents_of(pages)
    assert {(r.doc_id, r.page) for r in parents.collect()} == {(1, 1), (2, None)}
    chunks = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 2)], "chunk_id string, doc_id int, page int")
    of = {r.chunk_id: r.parent_id for r in chunking.chunk_parents(chunks, parents).collect()}
    held = {(r.doc_id, r.page): r.parent_id for r in parents.collect()}
    assert of == {"a": held[1, 1], "b": held[2, None], "c": None}


def test_table_elements_are_dropped(spark):
    blocks = spark.createDataFrame([("a", "Table"), ("b", None), ("c", "paragraph"), ("d", "table_row")], "id string, element_type string")
    assert sorted(r.id for r in chunking.drop_table_elements(blocks).collect()) == ["b", "c"]


@pytest.mark.parametrize("text,budget,end", [("a b c", 2, "b c"), ("a b c", 0, ""), ("", 3, ""), ("x café, y", 3, "caf, y"), ("x caféz y", 2, "z y")])
def test_tail(text, budget, end):
    assert chunking.tail(text, budget) == end


def test_line_blocks(spark):
    df = spark.createDataFrame([(1, "x\n# T #x\ny \nz\n\nw")], "doc_id int, text string")
    assert [(r.block, r.section, r.text) for r in chunking.line_blocks(df).orderBy("block").collect()] == [(1, None, "x"), (2, "T #x", "y\nz"), (3, "T #x", "w")]


def test_parents_cover_children(spark):
    rows = chunking.parent_child(spark.createDataFrame([(1, "# A\n" + "word " * 50), (2, None)], "doc_id int, text string"), 10, 2, 40).collect()
    assert rows and all(r.text.split()[0] in r.parent_text for r in rows) and len({r.child_id for r in rows}) == len(rows)


ELEMENTS = "doc_id long, source string, position int, element_id string, element_type string, text string, section string, page_start int, page_end int"


def test_boundaries_of_documents(spark):
    docs = spark.createDataFrame([(1, "never read"), (2, "intro\n\n# One \nbody\n\nmore\n## Two\nend"), (3, " a\nb\n \n\nc "), (4, None), (5, "x")], "doc_id long, text string")
    elements = spark.createDataFrame(
        [
            (1, "elements", 0, "e0", "text", "not the first source", None, 1, 1), (1, "sections", 2, None, None, " second ", "S", 2, None), (1, "sections", 1, "s1", "Paragraph", "first", "S", 1, 2),
            (1, "sections", 3, "s3", "Table-Row", "1 | 2", "S", 2, 2), (1, "sections", 4, "s4", "text", "  ", "S", 2, 2), (5, "pages", 0, "p0", "table", "only a table", None, 1, 1),
        ], ELEMENTS,
    )
    got = [(r.doc_id, r.ordinal, r.text, r.section, r.page_start, r.page_end) for r in chunking.boundary_blocks(docs, elements).orderBy("doc_id", "ordinal").collect()]
    assert got == [
        (1, 0, "first", "S", 1, 2), (1, 1, "second", "S", 2, 2), (2, 0, "intro", None, None, None), (2, 1, "# One\nbody\n\nmore", "One", None, None), (2, 2, "## Two\nend", "Two", None, None),
        (3, 0, "a\nb", None, None, None), (3, 1, "c", None, None, None),
    ]
    assert chunking.boundary_blocks(docs).filter("doc_id = 1").first().text == "never read"


def test_parents_and_children_keep_to_boundaries(spark):
    text = "one two three. four five six. seven eight nine.\n\nten eleven\n\ntwelve thirteen fourteen fifteen sixteen"
    docs = spark.createDataFrame([(1, text.replace("\n\n", "\n")), (2, "a b c d e f g h i j")], "doc_id long, text string")
    elements = spark.createDataFrame([(1, "blocks", 0, "b0", "text", text, None, 4, 5), (1, "blocks", 1, "b1", "text", "z y", None, 6, 6)], ELEMENTS)
    rows = chunking.structured_chunks(chunking.boundary_blocks(docs, elements), child_target=8, child_overlap=1, parent_target=14).orderBy("doc_id", "chunk_index").collect()
    # Of the first boundary: 12, 2 and 5 tokens. A parent holds 14: the first two paragraphs, then the third.
    assert [(r.doc_id, r.part, r.child_index, r.chunk_index, r.page_start, r.text) for r in rows] == [
        (1, 0, 0, 0, 4, "one two three. four five six."), (1, 0, 1, 1, 4, ".\n\nseven eight nine.\n\nten eleven"), (1, 1, 0, 2, 4, "twelve thirteen fourteen fifteen sixteen"), (1, 0, 0, 3, 6, "z y"),
        (2, 0, 0, 0, None, "a b c d e f g h"), (2, 0, 1, 1, None, "h\n\ni j"),
    ]
    assert len({r.parent_id for r in rows}) == 4 and len({r.child_id for r in rows}) == 6
    assert rows[0].parent_text == "one two three. four five six. seven eight nine.\n\nten eleven"


def test_html():
    assert files.html_text("<table><tr><th>a</th><td>b&amp;c</td></tr></table>x", "p") == "HTML table 1: p\na | b&c"
    two = "<table><tr><td> a  b </td><td></td></tr><tr><td></td></tr></table>x<table></table><table><tr><td>1<b>2</b></td></tr></table>"
    assert files.html_text(two, "p") == "HTML table 1: p\na b | \n\nHTML table 2: p\n1 2"
    nested = "<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>late</td></tr><tr><td>z</td></tr></table>"
    assert files.html_text(nested, "p") == "HTML table 1: p\nin\nz"  # the inner row takes the place of the one that is open
    assert files.html_text("<tr><td>no table</td></tr>") == "no table"
    assert files.html_text("<p>x</p><script>y</script>") == "x\ny"
    assert files.html_text(None) == ""


def test_xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>')
    assert files.xlsx_rows(buffer.getvalue()) == [["name", "", "x"], ["5"]]
    assert files.parse_file("a.xlsx", buffer.getvalue()) == "XLSX sheet: sheet1\nname |  | x\n5"
    with zipfile.ZipFile(buffer, "a") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Sales"/></sheets></workbook>')
    assert files.parse_file("a.xlsx", buffer.getvalue()).startswith("XLSX sheet: Sales\n")


def test_load_and_roots(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\nbody")
    (tmp_path / "b.csv").write_bytes("x,y\n\n1,é".encode("latin-1"))
    rows = {r.file_type: r for r in files.load_documents(spark, str(tmp_path), [str(tmp_path)]).collect()}
    assert rows[".md"].title == "Title" and rows[".csv"].text == "CSV table: b.csv\nx | y\n1 | é"


def test_roots_hold_for_every_store(tmp_path):
    root = str(tmp_path)
    for path in (f"{root}/a", f"file://{root}/a/b", root):
        assert files.allowed_path(path, ["hdfs://n/data", root]) == path
    assert files.allowed_path("hdfs://n/data/x", [root, "hdfs://N/data"]) == "hdfs://n/data/x"
    for path in ("/etc/passwd", f"{root}x/a", f"{root}/../other", "hdfs://other/secret", "hdfs://n/data/../secret", "hdfs://n/data%2F..%2Fsecret", "s3a://n/data/x", "file:///etc/passwd"):
        with pytest.raises(ValueError):
            files.allowed_path(path, ["hdfs://n/data", root])
    (tmp_path / "link").symlink_to("/etc")
    with pytest.raises(ValueError):
        files.allowed_path(f"{root}/link/passwd", [root])


def test_pages_of_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0c \x0cthree")
    (tmp_path / "b.bin").write_bytes(b"!")

    def reader(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("\x0c")

    rows = files.paged_documents(spark.read.format("binaryFile").load(f"{tmp_path}/*.bin"), reader).orderBy("uri", "page").collect()
    assert [(r.page, r.text, r.error) for r in rows] == [(1, "one", None), (3, "three", None), (None, None, "ValueError: broken")]


def test_table_form_of_a_file(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("\ufeffYear;Revenue USD;2023;\n2020;1.5;x;y\n;;;\n2021;2;;\n2022;3;z;y\n".encode())
    rows, columns, cards = files.table_cards(spark, str(tmp_path / "t.csv"), "t")
    assert rows.columns == ["year", "revenue_usd", "c_2023", "column_4"] and rows.count() == 3
    found = {r.column_name: (r.role, r.unit, r.nullable) for r in columns.collect()}
    assert found == {"year": ("period", None, False), "revenue_usd": ("unknown", "currency_usd", False), "c_2023": ("unknown", None, True), "column_4": ("unknown", None, True)}
    assert cards.count() == 6 and not any("1.5" in r.text for r in cards.collect())


def test_jsonl_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/x.jsonl"
    for n in (3, 2):
        files.write_jsonl(spark.range(n), path)
        assert files.read_jsonl(spark, path).count() == n


def test_bytes_are_decoded():
    assert files.decode_bytes("\ufeffé".encode()) == "é" and files.decode_bytes("é".encode("latin-1")) == "é"


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_a_csv_file_of_several_splits(spark, tmp_path, size):
    import csv
    import random

    r = random.Random(size)
    cell = lambda: r.choice(["", "a", "b c", 'say "x"', "two\nlines", '"', "three\r\n\nlines", ",;", "é漢", "x" * r.randint(1, 90), "\n" * r.randint(1, 5)])
    rows = [[str(i), *(cell() for _ in range(r.randint(0, 3)))] for i in range(300)]
    with open(tmp_path / "t.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\r\n" if size == 1000 else "\n").writerows([["id", "x", "y", "z"], *rows])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        splits = spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions()
        got = [x.cells for x in files.csv_rows(spark, str(tmp_path / "t.csv"), header=True).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert splits > 4 if size <= 1000 else splits >= 1
    assert sorted(got, key=lambda c: int(c[0])) == [[c or None for c in row] for row in rows]


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Year,Revenue ($),Year\n2022,10,a\n\n2023,15\n")
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["year", "revenue", "year_2"] and df.count() == 2
    kinds = {r.column_name: r.inferred_type for r in profiling.column_profile(df).collect()}
    assert kinds == {"year": "integer", "revenue": "integer", "year_2": "string"}


@pytest.mark.parametrize("cells,kind", [(["0", "1"], "boolean"), (["2023"], "integer"), (["1.5", "(2)"], "number"), (["2020-01-01"], "date"), (["a"], "string"), ([None, " "], "empty")])
def test_inference(spark, cells, kind):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert profiling.column_profile(df).first().inferred_type == kind


def test_facts_and_rejects(spark):
    rows = spark.createDataFrame([("ACME Co", "Net Sales", "2020", "1,000"), ("", "x", "2020", "1"), ("a", "b", "2020", "n/a")], "company string, metric string, period string, value string")
    facts, rejects = profiling.financial_facts(rows)
    assert facts.first().asDict() == {"company": "acme_co", "metric": "net_sales", "period": "2020", "value": 1000.0}
    assert sorted(r.reason for r in rejects.collect()) == ["company", "value"]


def test_index_versions(spark, tmp_path):
    base = f"file://{tmp_path}/index"
    chunks = spark.createDataFrame([("a", "x y x"), ("b", "y")], "chunk_id string, text string")
    index.write_index(chunks, base, "v1")
    index.promote(spark, base, "v1")
    assert index.current(spark, base) == "v1"
    asked = spark.createDataFrame([(1, "x"), (2, "Y")], "query_id int, text string")
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in index.search_index(spark, base, asked, 5).collect()) == [(1, 1, "a"), (2, 1, "b"), (2, 2, "a")]
    with pytest.raises(ValueError):
        index.promote(spark, base, "v2")
    assert index.current(spark, base) == "v1"
    index.write_index(chunks, base, "v3")
    index.promote(spark, base, "v3")  # over the old pointer, in one step
    assert index.current(spark, base) == "v3"
    assert index.discard(spark, base, "v1") and not index.discard(spark, base, "v1") and commits.vacuum(spark, base, keep=1) == 2
    assert index.search_index(spark, base, asked, 5).count() == 3


def test_records_first_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    first, clash = index.dedupe_records(rows, ["k"], ["o"])
    assert {(r.k, r.v) for r in first.collect()} == {(1, "a"), (2, "c")} and [r.k for r in clash.collect()] == [1]


def test_artifacts(spark, tmp_path):
    facts = spark.createDataFrame([(1,)], "a int")
    assert index.write_artifacts({"facts": facts, "cells": facts}, f"file://{tmp_path}/out", "facts") == {"facts": 1, "cells": 1}
    assert set(commits.snapshot(spark, f"file://{tmp_path}/out").tables) == {"facts", "facts_csv", "manifest"}
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c")], "k int, v string")
    assert index.write_artifacts({"facts": twice}, f"file://{tmp_path}/out", keys={"facts": ["k"]}) == {"facts": 2}
    assert {(r.k, r.v) for r in commits.read(spark, f"file://{tmp_path}/out", "facts_csv").collect()} == {(1, "a"), (2, "c")}
    assert '"conflicts": {"facts": 1}' in commits.read(spark, f"file://{tmp_path}/out", "manifest").first().value


def test_vectors_are_upserted(spark, tmp_path):
    kind = "chunk_id string, embedding array<double>"
    path = f"file://{tmp_path}/index"
    index.write_vectors(spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 0.0])], kind), path, "v1")
    index.write_vectors(spark.createDataFrame([("a", [0.0, 2.0]), ("e", [0.0, 1.0])], kind), path, "v1")
    rows = {r.chunk_id: r for r in commits.read(spark, path, "vectors-v1").collect()}
    assert {k: r.unit for k, r in rows.items()} == {"a": [0.0, 1.0], "d": [1.0, 0.0], "e": [0.0, 1.0]} and len({r.point_id for r in rows.values()}) == 3
    index.build_vector_index(spark, path, "v1")
    asked = spark.createDataFrame([(1, [0.0, 5.0])], "query_id int, embedding array<double>")
    assert [(r.chunk_id, r.score) for r in index.search_vectors(spark, path, "v1", asked, 3, exact=True).orderBy("rank").collect()] == [("a", 1.0), ("e", 1.0), ("d", 0.0)]


def test_only_new_content_is_loaded(spark, tmp_path):
    kind, path = "uri string, content_hash string", f"file://{tmp_path}/docs"
    first = index.load_new(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], kind), path)
    again = index.load_new(spark.createDataFrame([("d", "2"), ("e", "3")], kind), path)
    count = lambda df: {r.status: r.n for r in df.collect()}
    assert count(first) == {"loaded": 2, "skipped_duplicate": 1} and count(again) == {"loaded": 1, "skipped_duplicate": 1}
    assert sorted(r.uri for r in commits.read(spark, path, "documents").collect()) == ["a", "c", "e"]


def test_a_large_table_of_one_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    from tarn import session

    path = f"file://{tmp_path}/one"
    spark.range(3000).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 256), 4) AS text").coalesce(1).write.parquet(path)
    assert session.spread_all(spark.read.parquet(path), 10_000).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
