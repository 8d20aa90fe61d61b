"""Chunks, copies, noise, evaluation, index upkeep, readers, conversion, audit."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from notelens import config
from notelens.operators import audit, chunking, convert, dense, dupes, evaluate, fusion, indexing, noise
from notelens.sources import locks, notes, readers

NOTE = """---
tags: [Alpha, "beta"]
---
intro #gamma and `#code`

# One
text

## Two
```
# not a heading #nor-a-tag
```
more #Beta
### Three
end
"""


def limits(**kw):
    return chunking.Limits(**({"most": 400, "overlap": 50, "least": 0} | kw))


def test_sections_tags_and_parents():
    chunks, parents = chunking.chunk_note("f/n.md", NOTE, limits())
    assert [c["heading_path"] for c in chunks] == ["", "One", "One > Two", "One > Two > Three"]
    assert chunks[0]["tags"] == ["Alpha", "beta", "gamma"] and "# not a heading" in chunks[2]["text"]
    assert [p["heading_path"] for p in parents] == ["", "One", "One > Two"]
    assert parents[1]["text"].startswith("# One") and parents[1]["text"].endswith("end")
    assert [c["parent_id"] for c in chunks] == [0, 1, 1, 2]


def test_tag_rules():
    body = "see (#tag) and x,#two and \"#three\" #four a#b &#x /#y ##z\n# #head\n```\n#code\n```\n`#c` #1 #ça-va/b"
    assert chunking.inline_tags(body) == ["tag", "two", "three", "four", "ça-va/b"]
    assert chunking.split_frontmatter("---\nmeta:\n  tags: nested\nTags: [a, 'b', #c]\n---\nx") == (["a", "b", "c"], "x")
    assert chunking.split_frontmatter("---\ntags:\n- '#a b'\n  - \"c\"\nother: d\n---\nx")[0] == ["a b", "c"]
    assert chunking.merge_tags(["straße", "Ab"], ["STRASSE", "aB"]) == ["straße", "Ab", "STRASSE"]


def test_small_sections_join():
    chunks, _ = chunking.chunk_note("n.md", NOTE, limits(least=60))
    assert len(chunks) == 1
    long = "# A\n" + "w " * 100 + "\n# B\nshort"
    assert [c["heading_path"] for c in chunking.chunk_note("n.md", long, limits(least=60))[0]] == ["A"]


def test_windows_lose_no_word_and_fit():
    words = [f"w{i}" for i in range(700)] + ["x" * 9000]
    chunks, _ = chunking.chunk_note("n.md", " ".join(words), limits())
    seen = {w for c in chunks for w in c["text"].split()}
    assert set(words[:700]) <= seen
    for c in chunks:
        assert chunking.count_tokens(chunking.header_text("n.md", [], "") + c["text"]) <= 400


def test_unclosed_frontmatter_and_long_heading_are_text():
    assert chunking.split_frontmatter("---\ntags: a\nbody")[1].startswith("---")
    assert chunking.sections("# " + "x" * 200)[0][0] == ""


def words_text(seed, n):
    r = random.Random(seed)
    return " ".join(f"k{r.randrange(10**6)}" for _ in range(n))


def chunk_rows(spark, texts):
    rows = []
    for path, t in texts.items():
        w = t.split(" ")
        rows += [(path, i, "", " ".join(w[a : a + 60]), [], 0) for i, a in enumerate(range(0, len(w), 60))]
    return spark.createDataFrame(rows, chunking.CHUNKS)


def test_duplicates(spark):
    a, b = words_text(1, 200), words_text(2, 200)
    changed = a.split()
    changed[100:150] = words_text(3, 50).split()
    texts = {
        "x/a.md": a,
        "y/yedek/a2.md": a,
        "x/part.md": " ".join(b.split()[:120]),
        "x/whole.md": b,
        "z/other.md": words_text(9, 150),
        "z/short.md": " ".join(a.split()[:20]),
        "v/old.md": words_text(11, 160),
        "v/new.md": words_text(11, 160).replace("k", "k", 1)[:0] + " ".join([*words_text(11, 160).split()[:125], *words_text(12, 40).split()]),
        "n/bağlam.md": " ".join([*words_text(21, 60).split(), *words_text(22, 90).split()]),
        "m/baglam.md": " ".join([*words_text(21, 60).split(), *words_text(23, 90).split()]),
    }
    got = {tuple(r["paths"]): r for r in dupes.find_duplicates(chunk_rows(spark, texts)).collect()}
    exact = got[("x/a.md", "y/yedek/a2.md")]
    assert exact["kind"] == "exact" and exact["exclude"] == ["y/yedek/a2.md"] and exact["keep"] == ["x/a.md"]
    part = got[("x/part.md", "x/whole.md")]
    assert part["kind"] == "overlap" and part["exclude"] == ["x/part.md"]
    assert got[("v/new.md", "v/old.md")]["kind"] == "similar" and got[("v/new.md", "v/old.md")]["exclude"] == []
    assert got[("m/baglam.md", "n/bağlam.md")]["kind"] == "name"
    assert len(got) == 4 and len(exact["key"]) == 12


def test_boilerplate_is_no_evidence(spark):
    same = words_text(5, 40)
    rows = [(f"n{i:02}.md", same + " " + words_text(100 + i, 40)) for i in range(30)]
    found = dupes.pair_overlaps(dupes.shingles(dupes.note_words(spark.createDataFrame(rows, "path string, text string"))))
    assert found.count() == 0


def test_a_common_name_brings_no_pairs(spark):
    texts = {f"d{i}/README.md": words_text(200 + i, 60) for i in range(40)} | {"x/Readme.md": words_text(201, 60)}
    found = dupes.find_duplicates(chunk_rows(spark, texts)).collect()
    assert [(r["kind"], r["paths"]) for r in found] == [("exact", ["d1/README.md", "x/Readme.md"])]


def test_links(spark):
    rows = [("a/One.md", "[[Two]] [[two.md#x]] [[One]]"), ("b/two.md", "[[x/ONE|y]]"), ("c/two.md", "")]
    got = {r["path"]: (r["inbound"], r["outbound"]) for r in dupes.link_counts(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/One.md": (1, 3), "b/two.md": (1, 1), "c/two.md": (1, 0)}


def test_noise(spark):
    texts = {f"n{i}.md": words_text(i, 50) for i in range(30)} | {"hub.md": words_text(77, 3100), "led.md": words_text(78, 50) + " [[n1]]"}
    chunks = chunk_rows(spark, texts).withColumn("heading_path", F.when(F.col("path") == "led.md", "H").otherwise(F.col("heading_path")))
    counts = spark.createDataFrame([(p, 60 if p in ("hub.md", "led.md") else 3) for p in texts], "path string, appearances long")
    got = noise.find_noise(chunks, counts, 1000).collect()
    assert [(r["path"], r["flags"], r["strength"]) for r in got] == [("hub.md", ["long", "orphan", "unstructured"], "strong"), ("led.md", [], "look")]
    made = noise.make_queries(chunks)
    assert made.count() == 32 * 3 and sorted(map(str, made.collect())) == sorted(map(str, noise.make_queries(chunks).collect()))


def test_metrics(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text('{"question": "a", "expected": "x.md"}\n\n{"question": "b", "expected": ["d/"], "id": "z"}\n{"question": "c", "expected": ["no"]}\n{"question": "e"}\n')
    evaluate.add_question(str(f), "ü", [])
    questions = evaluate.load_questions(str(f))
    assert [q["qid"] for q in questions] == ["q1", "z", "q3", "q4", "q5"]
    results = spark.createDataFrame([("q1", "x.md", 1), ("z", "a", 1), ("z", "d/y.md", 3), ("q3", "no.md", 1)], "qid string, path string, rank int")
    ranks = evaluate.eval_ranks(results, spark.createDataFrame(questions, "qid string, text string, expected array<string>"))
    m = evaluate.eval_metrics(ranks).first()
    assert (m["n"], m["hit1"], m["hit5"], m["mrr"]) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(4 / 9))
    assert evaluate.eval_metrics(ranks.limit(0)).first()["mrr"] == 0
    f.write_text("{}\n")
    with pytest.raises(ValueError, match="line 1"):
        evaluate.load_questions(str(f))


def test_index_life(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for n in ("a", "b", "c"):
        (vault / f"{n}.md").write_text(f"# {n}\nnote {n} words")
    (vault / "_d.md").write_text("hidden kept")

    embedder = dense.HashEmbedder(8)

    def run(embed=None, full=False):
        files = notes.listing(spark, [str(vault)])
        read = lambda changed: notes.read_texts(files.join(changed, "path"))
        default = lambda rows: rows.withColumn("embedding", dense.embed_column(lambda: embedder, "")(F.col("embed_text"))).select("path", "index", "embedding")
        return indexing.update(spark, str(tmp_path / "index"), files, read, embed or default, full=full)

    first = run()
    assert (first.notes, first.changed, first.full, first.written) == (4, 4, True, True)
    assert not run().written
    (vault / "a.md").write_text("# a\nother words now")
    (vault / "b.md").unlink()

    def fails(rows):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        run(fails)
    index = indexing.Index(spark, str(tmp_path / "index"))
    assert index.version() == 1
    second = run()
    assert (second.notes, second.changed, second.deleted, second.full) == (3, 1, 1, False)
    texts = {r["path"]: r["text"] for r in index.table("chunks").collect()}
    assert set(texts) == {"a.md", "c.md", "_d.md"} and "other" in texts["a.md"]
    assert {r["term"] for r in index.table("postings").collect()} >= {"other", "hidden"}
    asked = spark.createDataFrame([(0, "other words"), (1, "hidden"), (2, "note c")], "qid long, text string")
    stored = fusion.IndexSearcher.of(index, lambda q: q.withColumn("q", dense.embed_column(lambda: embedder, "")(F.col("text"))).select("qid", "q"))
    plain = fusion.Searcher(stored.chunks, stored.vectors, stored.embed)
    for mode in fusion.MODES:
        got, want = ([tuple(r) for r in s.search(asked, 3, mode=mode).orderBy("qid", "rank").collect()] for s in (stored, plain))
        assert got == want and len(got) > 3
    plan = stored.search(asked, 3, mode="bm25")._jdf.queryExecution().optimizedPlan().toString()
    assert "embed_text" not in plan
    with open(tmp_path / "index" / "CURRENT", "w") as f:
        f.write("broken")
    assert run().full


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with locks.file_lock(path):
        with pytest.raises(locks.IndexLocked), locks.file_lock(path):
            pass
    with open(path, "w") as f:
        f.write('{"pid": 999999999}')
    with locks.file_lock(path):
        assert locks.owner(path) == os.getpid()
    with open(path, "w") as f:
        f.write("half")
    assert locks.held(path)


def test_listing(tmp_path):
    for n in ("a.md", "B.MD", "x.txt", "skip/c.md", "sub/deep/d.md", "sub/e.md", ".h/f.md"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("t")
    got = [f["path"] for f in notes.list_files([str(tmp_path)], {str(tmp_path): ["skip", "sub/deep/"]})]
    assert got == [".h/f.md", "B.MD", "a.md", "sub/e.md"]


def test_html():
    html = "<html><head><title>T &amp; t</title><style>x</style></head><body><nav>no</nav><h1>Big <b>one</b></h1><p>a <i>b</i><br>c</p><ul><li>x</li><li>y</li></ul><table><tr><th>h</th><th></th></tr><tr><td>1|2</td></tr></table><pre>k\n  v</pre><script>no()</script></body></html>"
    assert readers.html_to_markdown(html) == "## T & t\n\n## Big one\n\na b c\n\n- x\n- y\n\n| h |\n| --- |\n| 1\\|2 |\n\n```\nk\n  v\n```"


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert readers.extract("d/x.docx", office({"word/document.xml": doc})).markdown == "# x\n\n## Head\n\nText\n\n| c |\n| --- |\n"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = {
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S1" r:id="r1"/><sheet name="E" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>",
        "xl/worksheets/s1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f"<worksheet {s}><sheetData/></worksheet>",
    }
    got = readers.extract("b.xlsx", office(book))
    assert got.pages == 2 and got.markdown == "# b\n\n## S1\n\n| name |  | 3 |\n| --- | --- | --- |\n"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    slide = f'<p:sld {a}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Top</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>item</a:t></a:r></a:p></p:sp></p:sld>'
    assert readers.extract("s.pptx", office({"ppt/slides/slide1.xml": slide})).markdown == "# s\n\n## Slayt 1: Top\n\n- item\n"
    with pytest.raises(readers.ReadError):
        readers.extract("x.docx", b"no zip")


def test_decoding_and_cells():
    assert readers.decode(b"\xef\xbb\xbf\xc5\x9f") == readers.decode(b"\xfe") == "ş"
    assert readers.decode(b"\x81\xff") == "\x81ÿ" and readers.decode("\ufffd".encode()) == "\ufffd" and readers.decode(b"") == ""
    assert [readers.cell(v) for v in (None, 3.0, 2.5, True, "a|b\n c", float("inf"))] == ["", "3", "2.5", "True", "a\\|b c", "inf"]
    assert readers.extract("t.tsv", b"a\tb\n1\t2\n").markdown == "# t\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"


def test_text_files(spark):
    assert readers.extract("t.csv", "a;b\n1;ş\n".encode("cp1254")).markdown == "# t\n\n| a | b |\n| --- | --- |\n| 1 | ş |\n"
    assert readers.extract("t.txt", b"a\r\nb\r").markdown == "# t\n\na\nb\n"
    assert readers.extract("t.txt", b" ").hard
    files = spark.createDataFrame([("a.txt", b"hi"), ("b.docx", b"no")], "path string, content binary")
    got = {r["path"]: r for r in readers.extract_files(files).collect()}
    assert got["a.txt"]["markdown"] == "# a\n\nhi\n" and got["b.docx"]["hard"]


def test_convert(tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("hello")
    target = convert.convert_file(str(f), str(tmp_path))
    text = open(target).read()
    header = convert.read_header(text)
    assert convert.is_ours(header) and header["source"] == "a.txt" and text.endswith("# a\n\nhello\n")
    f.write_text("hello again")
    assert "again" in open(convert.convert_file(str(f), str(tmp_path))).read()
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "b.txt.md").write_text("my own note")
    with pytest.raises(convert.ConvertError):
        convert.convert_file(str(tmp_path / "b.txt"), str(tmp_path))
    with pytest.raises(convert.ConvertError):
        convert.convert_file(str(f), str(tmp_path / "other"))
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "c.txt").write_text("x")
    with pytest.raises(convert.ConvertError):
        convert.convert_file(str(tmp_path / "skip" / "c.txt"), str(tmp_path), ["skip"])
    assert convert.read_header("---\na: 1\n b: 2\n- c: 3\nd:e:f\n---\n") == {"a": "1", "d": "e:f"} and convert.read_header("a: 1") == {}


def test_audit(spark, tmp_path):
    path = str(tmp_path / "d.json")
    held = audit.load_decisions(path)
    held = audit.mark(audit.mark(held, "kept_groups", "k1", "2026-01-01"), "excluded", "a.md", "2026-01-01")
    audit.save_decisions(path, held)
    assert audit.load_decisions(path) == held
    groups = spark.createDataFrame([("k1", ["x", "y"]), ("k2", ["a.md", "b"]), ("k3", ["a.md", "b", "c"])], "key string, paths array<string>")
    assert [(r["key"], r["paths"]) for r in audit.open_groups(groups, held).collect()] == [("k3", ["b", "c"])]
    got = audit.plan_exclusion(["a.md", "d/a.md", "d/b.md"], ["d/a.md"], [])
    assert got["removed"] == ["d/a.md"] and got["extra"] == []
    with pytest.raises(audit.ExclusionError):
        audit.plan_exclusion(["a.md"], ["zz.md"], [])
    (tmp_path / "d.json").write_text("[]")
    with pytest.raises(ValueError):
        audit.load_decisions(path)


def test_config(tmp_path):
    (tmp_path / "v").mkdir()
    env = {"NOTELENS_ROOTS": str(tmp_path / "v"), "NOTELENS_INDEX": str(tmp_path / "i")}
    made = config.load_config(env, str(tmp_path / "none"))
    assert made.note_key(str(tmp_path / "v" / "a" / "b.md")) == "a/b.md" and made.resolve_key("a/b.md").endswith("/v/a/b.md")
    for bad in ({"NOTELENS_ROOTS": ""}, env | {"NOTELENS_INDEX": str(tmp_path / "v" / "i")}, env | {"NOTELENS_REINDEX_MINUTES": "x"}):
        with pytest.raises(config.ConfigError):
            config.load_config(bad, str(tmp_path / "none"))
