"""Column functions and small operators on values whose results are typed here."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import naming, numbers, text
from factloom.operators import changes, conversations, entities, facts, linking, triage, views, workqueue
from factloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given,want",
    [("1.234,56", "1234.56"), ("1.234", "1.23"), ("12,5", "12.50"), ("-1088,85", "-1088.85"), ("EUR 12,50", "12.50"), ("12,50 €", "12.50"), ("abc", None), ("", None), ("1-2", "1.00"), (".5", "0.50")],
)
def test_money(spark, given, want):
    assert one(spark, numbers.money_text(numbers.parse_money(F.lit(given)))) == want


@pytest.mark.parametrize("given,want", [("HAUS-12A XEH-12", []), ("see EH-016, HAUS-12 and EH-016", ["EH-016", "HAUS-12"]), ("INV-DUP-00192;TX-1", ["INV-DUP-00192", "TX-1"]), (None, [])])
def test_mentions(spark, given, want):
    assert one(spark, text.mentions(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(
    "path,want",
    [
        ("data/rechnungen/a/A.PDF", "invoice_pdf"), ("data/briefe/x.pdf", "letter_pdf"), ("x/stammdaten/a.csv", "unknown"), ("data/stammdaten/a.json", "master_data"), ("data/bank/bank_index.csv", "index_csv"), ("data/bank/a.CSV", "bank_csv"),
        ("data/bank/a.xml", "bank_xml"), ("data/a/.DS_Store", "system_file"), ("data/a/.~lock", "system_file"), ("data\\emails\\a.EML", "email"), ("data/incremental/day-01/incremental_manifest.json", "incremental_manifest"), ("data/a/.pdf", "unknown"),
    ],
)
def test_classify(spark, path, want):
    assert one(spark, naming.classify(F.lit(path))) == want


@pytest.mark.parametrize(
    "path,want",
    [
        ("data/rechnungen/2024/20240110_DL-FAKE-7_INV-FAKE-2.pdf", "INV-FAKE-2"), ("data/incremental/day-01/incremental_manifest.json", "INCR-DAY-01-MANIFEST"), ("data/incremental/day-01/bank/bank_index.csv", "INDEX-DAY-01-BANK-INDEX"),
        ("data/bank/konto 1.csv", "BANK-BASE-KONTO-1"), ("data/stammdaten/mieter.csv", "MASTER-MIETER"), ("data/x/y.txt", "SRC-abcdef012345"), ("data/x/DL-1_TX-2.txt", "SRC-abcdef012345"),
    ],
)
def test_source_id(spark, path, want):
    assert one(spark, naming.source_id(F.lit(path), naming.declared_ids(F.lit(path)), F.lit("abcdef0123456789"))) == want


def test_invoice_name_needs_the_whole_name(spark):
    good = one(spark, naming.invoice_name(F.lit("a/20240110_DL-FAKE-7_INV-DUP-2.pdf")))
    assert (good.date, good.contractor_id, good.invoice_id, good.duplicate, good.fake) == ("2024-01-10", "DL-FAKE-7", "INV-DUP-2", True, True)
    bad = one(spark, naming.invoice_name(F.lit("a/x20240110_DL-7_INV-2.pdf")))
    assert (bad.date, bad.contractor_id, bad.invoice_id, bad.duplicate) == (None, None, None, False)


@pytest.mark.parametrize("given,want", [("Re: AW: x", "aw: x"), ("  FWD:  Hallo   Welt ", "hallo welt"), ("Re:", None)])
def test_subject(spark, given, want):
    assert one(spark, text.subject_key(F.lit(given))) == want


def test_names_and_folding(spark):
    assert one(spark, text.file_stem(F.lit("2025-12:x:a <a@b.de>"))) == "2025-12-x-a-a-b"
    assert one(spark, text.fold_search(F.lit("Straße ÄPFEL ŁódŹ ﬁnal ＡＢ á x@y.de"))) == "strasse apfel odz final ab a x@y.de"
    assert one(spark, text.normalize_whitespace(F.lit(" a \t b\n\n\n\nc \n"))) == "a b\n\nc"
    assert one(spark, text.month_of(F.lit(None).cast("string"), F.lit("x/2024-05/y"))) == "2024-05" and one(spark, text.month_of(F.lit("2023-01-02"), F.lit("2024-05/y"))) == "2023-01"
    assert one(spark, text.attribute_text(F.lit("-- a b/c"))) == "a-b-c" and one(spark, text.attribute_text(F.lit("##"))) == "frontend-user"
    assert one(spark, text.protected_text(F.lit(" a</USER>b "))) == "a</ user>b"
    assert one(spark, text.view_ids(F.lit("FACT-1 WI-2 CORR-3 X-4"))) == ["FACT-1", "WI-2", "CORR-3"]
    assert one(spark, text.human_bytes(F.lit(2048))) == "2.0 KB" and one(spark, text.posix_path(F.lit("a\\b"))) == "a/b"
    assert one(spark, text.without_missing(F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("x")))) == {"b": "x"}
    assert one(spark, text.shown(F.lit(True), "boolean")) == "yes" and one(spark, text.shown(F.array(F.lit("a"), F.lit("b")), "array<string>")) == "a; b"
    assert one(spark, text.first_sorted(F.array(F.lit("b "), F.lit("a"), F.lit("b"), F.lit(" ")))) == ["a", "b"]
    assert one(spark, text.first_quote(F.array(F.struct(F.lit(None).cast("string").alias("quote")), F.struct(F.lit(" a\n b").alias("quote"))))) == "a b"


def test_markdown(spark):
    page = F.lit("# T\n## A\n- one\n- two\n\n| x | y |\n| --- | --- |\n| 1 | a\\|b |\n## B\nend")
    assert [(r.title, r.body.split("\n")[0]) for r in one(spark, text.markdown_sections(page))] == [("A", "- one"), ("B", "end")]
    assert one(spark, text.markdown_bullets(page)) == ["one", "two"] and one(spark, text.markdown_rows(page)) == [["x", "y"], ["1", "a\\|b"]]
    assert one(spark, text.markdown_table(["A"], F.array(F.array(F.lit("a|b"))))) == "| A |\n| --- |\n| a\\|b |"
    assert one(spark, text.markdown_table(["A"], F.lit(None).cast("array<array<string>>"))) == "_No facts available yet._"


@pytest.mark.parametrize("given,want", [("Fri, 1 Mar 2024 23:30:00 -0100", "2024-03-02"), ("2024-03-01T23:30:00-01:00", "2024-03-02"), ("2024-03-01", "2024-03-01"), ("on 2024-03-05 noon", "2024-03-05"), ("never", None)])
def test_utc_day(spark, given, want):
    assert one(spark, numbers.utc_day(F.lit(given))) == want


def test_known_fact_ids(spark):
    made = lambda kind, subject, statement: one(spark, text.json_id("FACT", kind=F.lit(kind), subjectId=F.lit(subject), statement=F.lit(statement)))
    assert made("building", "HAUS-12", "building HAUS-12 (HAUS-12) is present in canonical master data.") == "FACT-0632F4BA14DAC773"
    assert made("relationship", "unit_in_building:EH-016:HAUS-12", "Relationship unit_in_building: EH-016 -> HAUS-12.") == "FACT-0D578A89EDB919BB"


def test_csv_records(spark):
    content = '﻿a; b ;c\r\n"x""y";"l1\nl2";\r\n;;\r\n1;2;3;4\r\n5\r\n'
    frame = spark.createDataFrame([("p.csv", bytearray(content.encode()))], "path string, content binary")
    assert [r.fields for r in files.csv_rows(frame).orderBy("line_no").collect()] == [{"a": 'x"y', "b": "l1\nl2", "c": ""}, {"a": "1", "b": "2", "c": "3"}, {"a": "5", "b": "", "c": ""}]


def test_json_records_and_missing_tables(spark, tmp_path):
    rows = [("a.json", bytearray(b'{"x": [{"id": "1", "l": ["p", "q"]}], "y": {"id": "2"}}')), ("b.json", bytearray(b'[{"id": 3}]')), ("c.json", bytearray(b"{oops"))]
    got = files.json_records(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "field").collect()
    assert [(r.path, r.field, r.record) for r in got] == [("a.json", "x", {"id": "1", "l": "p;q"}), ("a.json", "y", {"id": "2"}), ("b.json", None, {"id": "3"})]
    assert files.json_documents(spark.createDataFrame(rows, "path string, content binary")).where("document IS NULL").count() == 1
    assert files.read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    files.write_lines(spark.range(2), str(tmp_path / "t"))
    files.write_lines(spark.range(1), str(tmp_path / "t"), append=True)
    assert files.read_table(spark, str(tmp_path / "t"), "id long").count() == 3
    files.write_texts(spark.createDataFrame([("a",)], "text string"), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first().value == "a"


def test_mail_headers(spark):
    raw = b"From: =?utf-8?B?w4RuYQ==?= <a@b>\r\nX: 1\r\nx: 2\r\nFolded: a\r\n\tb\r\nContent-Transfer-Encoding: Quoted-Printable\r\n\r\nf=C3=BCr=\r\n dich\r\n"
    row = files.emails(spark.createDataFrame([("m", bytearray(raw))], "path string, content binary")).first()
    assert row.headers["x"] == "2" and row.headers["folded"] == "a b" and row.body.strip() == "für dich" and row.body_latin1.strip() == "fÃ¼r dich"
    assert one(spark, files.decoded_words(F.lit(row.headers["from"]))) == "Äna <a@b>"


def test_long_chain_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(50)] + [("n50", "n00")], "from_id string, to_id string")
    direct = spark.createDataFrame([("s", "n00", None)], "source_id string, entity_id string, day string")
    assert linking.expand(direct, edges).count() == 51


@pytest.mark.parametrize("day,walked", [("2023-12-31", 0), ("2024-06-01", 1), ("2025-01-01", 0), (None, 1), ("odd", 1)])
def test_tenancies_gate_the_walk(spark, day, walked):
    edges = spark.createDataFrame([("MIE-1", "EH-1")], "from_id string, to_id string")
    gated = spark.createDataFrame([("MIE-1", "2024-01-01", "2024-12-31")], "entity_id string, valid_from string, valid_to string")
    assert linking.expand(spark.createDataFrame([("s", "MIE-1", day)], "source_id string, entity_id string, day string"), edges, gated).count() == walked


def test_short_addresses_are_found(spark):
    texts = spark.createDataFrame([("s", "mail to a@b now"), ("t", None), ("u", "")], "source_id string, text string")
    aliases = spark.createDataFrame([("a@b", "a@b", "e", "email"), ("mail", "mail", "f", "name"), ("s", "mail to", "g", "id"), ("DE", "to", "h", "iban")], "alias string, folded string, entity_id string, alias_type string")
    assert sorted((r.entity_id, r.match_type) for r in linking.alias_links(texts, aliases).collect()) == [("e", "email"), ("h", "alias")]


def test_terms_are_dealt_over_automata(spark, monkeypatch):
    monkeypatch.setattr(linking, "TERM_CHARACTERS", 3)
    texts = spark.createDataFrame([(1, "one two three")], "id int, text string")
    terms = spark.createDataFrame([("one",), ("two",), ("ne t",), ("four",)], "term string")
    assert sorted(r.term for r in linking.contained(texts, terms, "id", "text", "term").collect()) == ["ne t", "one", "two"]


def test_change_set(spark):
    before, after = (spark.createDataFrame(r, "id string, v int") for r in ([("a", 1), ("b", 1)], [("b", 2), ("c", 1)]))
    assert sorted(tuple(r) for r in changes.change_set(before, after, "id", ["v"]).collect()) == [("a", "removed"), ("b", "modified"), ("c", "added")]
    assert one(spark, changes.section_of(F.lit("decision"))) == "documents" and one(spark, changes.section_of(F.lit("relationship"))) == "provenance"


def test_user_blocks_and_edits():
    a = 'x\n<USER id="1">kept</User>\ny\nz\n'
    assert views.guard(a, a + "more") and pytest.raises(ValueError, views.guard, a, a.replace("kept", "lost"))
    assert [op[0] for op in views.line_changes(list("XXX2345"), list("2z3z4z5zXXX"))].count("equal") == 4
    edited = views.wrap_edits(a, a.replace("y\nz", "new</user>\nz"), " me !", "2025-01-02T03:04:05.678Z")
    assert '<user id="USEREDIT-20250102030405-1" author="me" created_at="2025-01-02T03:04:05.678Z" action="replace">\nnew</ user>\n</user>' in edited and edited.endswith("\n")
    dropped = views.wrap_edits("a\nb\n", "a\n", "me", "2025-01-02T03:04:05.678Z")
    assert 'action="delete">\nDeleted generated context:\n\nb\n</user>' in dropped and views.wrap_edits(a, a, "me", "t") == a


def test_save_edits_tells_refusals(spark):
    rows = spark.createDataFrame([(1, "a", "a\nb"), (2, "<user>k</user>", "k")], "k int, a string, b string")
    got = {r.k: r for r in views.save_edits(rows, "k", "a", "b", "me", "2025-01-02T03:04:05.678Z").collect()}
    assert 'action="insert">\nb\n</user>' in got[1].text and got[2].text is None and "Blocked" in got[2].error


def test_merged_document():
    section = lambda i, c: (i, c, views.text_hash(c))
    wrap = lambda i, c, h: f"<!-- BCE:SECTION {i} START hash={h} -->\n{c}\n<!-- BCE:SECTION {i} END -->"
    old = f"# Context: L\n\nGenerated: t0\n\n{wrap('a', 'one', views.text_hash('one'))}\n{wrap('b', 'edited', views.text_hash('two'))}\n<user>u</user>\n"
    new = views.merge_document(old, [section("a", "uno"), section("b", "dos"), section("c", "tres")], "t1")
    assert "Generated: t1" in new and wrap(*[("a", "uno", views.text_hash("uno"))][0]) in new and "edited" in new and "dos" not in new and new.rstrip().endswith("<!-- BCE:SECTION c END -->")


def test_corrections_capture_the_section(spark):
    proposed = spark.createDataFrame([("t", " c ", "r", "s1", ["f", "f"], [], []), ("t", "d", "r", "none", [], [], [])], "thread_id string, correction string, reason string, target_section_id string, target_fact_ids array<string>, target_entity_ids array<string>, target_source_ids array<string>")
    sections = spark.createDataFrame([("s1", "text ")], "section_id string, content string")
    got = {r.correction: r for r in views.corrections(proposed, sections, "L", "now").collect()}
    assert got["c"].target_section_hash == views.text_hash("text") and got["c"].target_fact_ids == ["f"] and got["d"].target_section_hash is None


def test_decisions_and_first_values(spark):
    schema = "observation_id string, phase int, kind string, subject_id string, statement string, attributes string, event_date string, primary_entity_id string, source_id string, decision string"
    rows = [("o2", 0, "issue", "s", "later", "{2}", "d2", None, "b", "keep"), ("o1", 0, "issue", "s", "first", "{1}", None, "e", "a", "needs_review"), ("o0", 1, "issue", "s", "semantic", "{3}", "d3", None, "c", "needs_review"), ("o9", 0, "issue", "s", "x", "{9}", "d", None, "z", "ignore")]
    got = facts.reduce_observations(spark.createDataFrame(rows, schema)).first()
    assert (got.statement, got.attributes, got.event_date, got.primary_entity_id, got.decision, got.merged, got.source_count) == ("first", "{3}", "d2", "e", "keep", 3, 3)


def test_models_answers(spark):
    assert triage.balanced_object('```json\n{"a": "}{\\"", "b": {}} x}```') == '{"a": "}{\\"", "b": {}}' and triage.balanced_object("{oops") is None
    items = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string")
    got = {r.id: (r.answer, r.decision) for r in triage.extract(items, lambda t: '{"facts": []}' if t == "good" else "no").collect()}
    assert got == {1: ('{"facts": []}', "extracted"), 2: (None, "error")}


def test_first_sources_only(spark):
    rows = spark.createDataFrame([("f", f"s{i}") for i in range(9)], "fact_id string, source_id string")
    assert facts.first_values(rows, "fact_id", "source_id", 5).first()["values"] == ["s0", "s1", "s2", "s3", "s4"]


def test_stored_messages(spark):
    calls = [("write_todos", '{"t":1}')]
    rows = [("t", 0, "human", "hi", None, None), ("t", 1, "ai", " ", None, calls), ("t", 2, "tool", "done", "find", None), ("t", 3, "ai", "bye", None, None), ("t", 4, "system", "x", None, None)]
    states = spark.createDataFrame(rows, "thread_id string, place int, type string, text string, name string, calls array<struct<name:string,args:string>>")
    got = [(r.role, r.content) for r in conversations.chat_rows(states).orderBy("place", "part").collect()]
    assert got == [("user", "hi"), ("tool", '[tool call: write_todos, query:{"t":1}]'), ("tool", "[tool result: find] done"), ("agent", "bye")]
    last = conversations.last_call(states, "thread_id", "place", "calls", F.exists("calls", lambda c: c["name"] == "write_todos")).first()
    assert last.calls[0].args == '{"t":1}'
    assert conversations.last_state(states, "thread_id", "place").first().place == 4
    assert one(spark, conversations.flatten_parts(F.array(F.struct(F.lit("a").alias("text")), F.struct(F.lit("").alias("text")), F.struct(F.lit("b").alias("text"))))) == "a\nb"


def test_entity_types(spark):
    assert [one(spark, entities.entity_type(F.lit(p), F.lit(i))) for p, i in (("x/mieter.csv", "1"), ("x", "EIG-1"), ("x", "LIE-1"), ("x", "Q"))] == ["tenant", "owner", "property", "entity"]
    name = lambda *v: one(spark, entities.display_name(*[F.lit(x).cast("string") for x in v]))
    assert name(None, " ", "Ana", "Beck", "i") == "Ana Beck" and name(None, "Co", "A", "B", "i") == "Co" and name(None, None, None, None, None) == "unknown"


def test_top_per_group(spark):
    rows = spark.createDataFrame([(1, i) for i in range(5)], "g int, v int")
    assert [r.v for r in workqueue.top_per_group(rows, ["g"], [F.desc("v")], 2).orderBy("rank").collect()] == [4, 3]
    assert workqueue.first_and_last(rows, "g", "v", "v").first().last_value == 4


def test_order_of_facts(spark):
    rows = spark.createDataFrame([("b", "x", "1"), ("a", "Y", "2"), ("a", "y", "3"), ("a", None, "0")], "kind string, subject_id string, fact_id string")
    assert [r.fact_id for r in sorted(facts.ordered(rows).collect(), key=lambda r: r.place)] == ["0", "3", "2", "1"]


def test_indented_json(spark, tmp_path):
    files.write_json(spark.createDataFrame([("v",)], "a string"), str(tmp_path / "j"))
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("part-*")).split() == ["{", '"a"', ":", '"v"', "}"]


def _walked(direct, edges, gated):
    """Candidates by walking for every source alone."""
    out = set()
    for source, start, day in direct:
        seen, front = {start}, [start]
        while front:
            node = front.pop()
            ranges = [(a, b) for n, a, b in gated if n == node]
            if ranges and day is not None and not any((a is None or a <= day) and (b is None or day <= b) for a, b in ranges):
                continue
            for a, b in edges:
                if a == node:
                    out.add((source, b, a))
                    if b not in seen:
                        seen.add(b)
                        front.append(b)
    return out


@pytest.mark.parametrize("one_task", [0, 500_000])
@pytest.mark.parametrize("seed", range(3))
def test_closure_once_per_entity_equals_walks_of_each_source(spark, monkeypatch, seed, one_task):
    import random

    monkeypatch.setattr(linking, "ONE_TASK", one_task)
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = sorted({(r.choice(nodes), r.choice(nodes)) for _ in range(22)})
    days = ["2020-01-01", "2021-01-01", "2022-01-01", None]
    gated = [(n, r.choice(days), r.choice(days)) for n in r.sample(nodes, 4)] + [("n1", "2020-06-01", "2020-07-01")]
    direct = [(f"s{i}", r.choice(nodes), r.choice(["2019-05-05", "2020-06-15", "2021-01-01", "2023-01-01", None])) for i in range(40)]
    got = linking.expand(
        spark.createDataFrame(direct + direct[:2], "source_id string, entity_id string, day string"), spark.createDataFrame(edges + edges[:2], "from_id string, to_id string"),
        spark.createDataFrame(gated, "entity_id string, valid_from string, valid_to string"),
    ).select("source_id", "entity_id", "inherited_from").collect()
    assert sorted(map(tuple, got)) == sorted(_walked(direct, edges, gated))


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_strong_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(linking, "ONE_TASK", one_task)
    ring = [(f"a{i}", f"a{(i + 1) % 5}") for i in range(5)]
    edges = ring + [("a3", "b1"), ("b1", "b2"), ("b2", "b1"), ("b2", "c1"), ("c1", "c2"), ("d", "a1"), ("e", "e"), (None, "a1"), ("a1", None)]
    rows = linking.strong_components(spark.createDataFrame(edges, "from_id string, to_id string")).collect()
    assert sorted(map(tuple, rows)) == [*((f"a{i}", "a0") for i in range(5)), ("b1", "b1"), ("b2", "b1")]
    assert linking.strong_components(spark.createDataFrame([], "from_id string, to_id string")).count() == 0


def test_search_folding_over_every_code_point(spark):
    import sys
    import unicodedata

    def plain(x):
        for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
            x = x.replace(a, b)
        x = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", x)).lower()
        return re.sub("[^a-z0-9@._+-]+", " ", x).strip()

    rows = [(c, f"a{chr(c)}b") for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["c", "t"]))
    got = frame.select("c", text.fold_search(F.col("t")).alias("f")).toPandas()
    wrong = [(hex(c), f, plain(f"a{chr(c)}b")) for c, f in zip(got["c"], got["f"], strict=True) if f != plain(f"a{chr(c)}b")]
    # Letters of which a lower-case form depends on what stands around them, or that newer tables than Java's know.
    assert len(got) > 1_100_000 and not wrong, wrong[:20]


def test_places_over_ranges(spark):
    from factloom.operators.rounds import numbered

    rows = [(f"{x}",) for x in "b a- a_ a A ab a,b ä z b b".split()] * 30
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "s string, i int").repartition(7)
    got = sorted(numbered(df, [F.collate("s", "UNICODE"), F.col("i")]).collect(), key=lambda r: r.place)
    want = df.orderBy(F.collate("s", "UNICODE"), "i").collect()
    assert [r.place for r in got] == list(range(len(rows))) and [(r.s, r.i) for r in got] == [(r.s, r.i) for r in want]
    assert numbered(df.limit(0), [F.col("i")]).count() == 0
